"""Token arrays: vocabularies, fixed-length encoding, attention masks, causal-LM labels.

A word vocabulary is built by Spark from the data (``build_vocabulary``) and applied row by row
(``encode_words``). The whole text is tokenised; ``fixed_length`` then truncates on the right to
``max_length`` and pads on the right with ``pad_id`` (``truncation=True, padding="max_length"``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .._util import col
from ..session import reliable_checkpoint
from .ordered import ordered_scan
from .split import split_exact

MAX_BROADCAST_ENTRIES = 1_000_000  # vocabulary rows that are broadcast; more are joined
MAX_BROADCAST_BYTES = 64 << 20  # and bytes of their texts

# Fixed values.
# Word tokens: runs of letters (with combining marks), runs of digits, or one other
# non-space character. The space class is spelled out so Java and RE2 engines agree.
WORD_PATTERN = r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\t\n\x0B\f\r ]"
WORD_EOS = "<|endoftext|>"
WORD_UNK = "<|unk|>"
WORD_EOS_ID = 0  # also the pad id, as pad_token = eos_token in the reference
WORD_UNK_ID = 1
LABEL_IGNORE = -100  # label of masked positions in causal-LM training
MAX_LENGTH = 128
BPE_EOS_ID = 50256


def word_tokens(text) -> Column:
    """All word tokens of the whole text, in order."""
    return F.regexp_extract_all(col(text), F.lit(WORD_PATTERN), 0)


def build_vocabulary(df: DataFrame, text_col: str, size: int | None = None) -> DataFrame:
    """``(token, token_id)``: ids 0 and 1 are EOS/pad and unknown, then all distinct tokens (or the
    ``size`` most frequent, where a model has a fixed vocabulary) ranked by count (descending)
    then token text. Checkpointed: the ids are made once for all uses.

    Token counting is a partial aggregation; the ranking is a range-partitioned ordered scan over
    the distinct tokens, so no task sees the whole vocabulary.
    """
    counts = df.select(F.explode(word_tokens(text_col)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    if size is not None:
        counts = counts.orderBy(F.col("n").desc(), F.col("token")).limit(size)
    ranked = ordered_scan(counts, None, [F.col("n").desc(), F.col("token")], cum_col="_before")
    specials = df.sparkSession.createDataFrame([(WORD_EOS, WORD_EOS_ID), (WORD_UNK, WORD_UNK_ID)], "token string, token_id int")
    return reliable_checkpoint(specials.unionByName(ranked.select("token", (F.col("_before") + 2).cast("int").alias("token_id"))))


def fixed_length(ids, max_length: int = MAX_LENGTH, pad_id: int = BPE_EOS_ID) -> Column:
    """Truncate on the right to ``max_length`` and pad on the right with ``pad_id``."""
    ids = col(ids)
    head = F.slice(ids, 1, max_length)
    return F.concat(head, F.array_repeat(F.lit(pad_id).cast("int"), F.lit(max_length) - F.size(head)))


def attention_mask(n_real, max_length: int = MAX_LENGTH) -> Column:
    """1 for the first ``min(n_real, max_length)`` positions, 0 for padding."""
    n = F.least(col(n_real).cast("int"), F.lit(max_length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))


def ones_mask(ids) -> Column:
    """Inference mask: all ones (``np.ones_like(generated)``)."""
    return F.transform(col(ids), lambda x: F.lit(1))


def causal_labels(ids, pad_id: int = BPE_EOS_ID) -> Column:
    """Labels for causal-LM training: a copy of the ids with pad positions set to -100.

    pad = EOS, so real EOS tokens are masked as well.
    """
    return F.transform(col(ids), lambda x: F.when(x == F.lit(pad_id), F.lit(LABEL_IGNORE)).otherwise(x))


def select_model_inputs(df: DataFrame) -> DataFrame:
    """Keep the model input columns only."""
    return df.select("input_ids", "attention_mask")


_kept: dict[int, Callable] = {}


def _positions(name: str, keys: pa.ChunkedArray) -> Callable:
    """Place of a key in the broadcast table, from a dictionary that a worker builds once for a table."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = dict(zip(keys.to_pylist(), range(len(keys)))).get
    return _kept[name]


def _broadcast_size(rows: DataFrame, key: str, value: str):
    """(n, b) rows and bytes of text, added up where the rows lie: a limit would send them to one task."""
    text_bytes = F.sum(F.octet_length(F.col(key).cast("string")) + F.octet_length(F.coalesce(F.col(value).cast("string"), F.lit(""))))
    return rows.agg(F.count("*").alias("n"), F.coalesce(text_bytes, F.lit(0)).alias("b")).first()


def _broadcast_lookup(rows: DataFrame, key: str, value: str, default, whole: bool):
    """The function of an array column that maps its elements through ``rows``, broadcast as Arrow arrays.

    ``whole``: an array of the values, ``default`` for the other elements. Else a struct of that array, ``v``, with
    NULL where the element is not in ``rows``, and those elements in order, ``k``.
    """
    kinds = rows.schema[key].dataType, rows.schema[value].dataType
    known = rows.toArrow().combine_chunks()
    values = pc.fill_null(pa.chunked_array([*known.column(1).chunks, pa.array([default], type=known.schema.types[1])]), default)
    shared = rows.sparkSession.sparkContext.broadcast((known.column(0), values.combine_chunks()))
    (key_arrow, arrow), name = map(to_arrow_type, kinds), uuid.uuid4().hex
    lists = T.ArrayType(kinds[1])

    @F.arrow_udf(lists if whole else T.StructType([T.StructField("v", lists), T.StructField("k", T.ArrayType(kinds[0]))]))
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys, values = shared.value
        position = _positions(name, keys)
        other = len(values) - 1
        for batch in batches:
            offsets = pc.subtract(batch.offsets, batch.offsets[0]) if len(batch) else pa.array([0], type=pa.int32())
            flat = batch.flatten()
            each = pc.dictionary_encode(flat, null_encoding="encode")
            texts = each.dictionary.to_pylist()
            at = [position(x, other if whole or x is None else None) for x in texts]
            found = values.take(pa.array(at, type=pa.int64())).take(each.indices).cast(arrow)
            out = pa.ListArray.from_arrays(offsets, found)
            out = pc.if_else(batch.is_valid(), out, None) if batch.null_count else out
            if not whole:
                lost = found.is_null().to_numpy(zero_copy_only=False)
                ends = np.append(0, np.cumsum(lost, dtype=np.int32))[offsets.to_numpy()].astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(ends), flat.filter(pa.array(lost)).cast(key_arrow))
                out = pa.StructArray.from_arrays([out, rest], names=["v", "k"])
            yield out

    return look_up


def _filled(kind: T.DataType):
    """The function of (values, answers) that puts the answers of a row, in order, where its values are NULL."""

    @F.arrow_udf(T.ArrayType(kind))
    def fill(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for values, answers in batches:
            offsets = pc.subtract(values.offsets, values.offsets[0]) if len(values) else pa.array([0], type=pa.int32())
            flat = values.flatten()
            out = pa.ListArray.from_arrays(offsets, pc.replace_with_mask(flat, flat.is_null(), answers.flatten()))
            yield pc.if_else(values.is_valid(), out, None) if values.null_count else out

    return fill


def _mapped_array(df: DataFrame, array: Column, table: DataFrame, key: str, value: str, default, out_col: str,
                  rank: str | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """``df`` without ``drop``, with ``out_col``: the elements of ``array`` replaced by the table's values, in order.

    Up to ``MAX_BROADCAST_ENTRIES`` rows and ``MAX_BROADCAST_BYTES`` bytes of text (both counted) the
    table is broadcast as Arrow arrays and every row is mapped by itself, without a shuffle: a batch
    looks up its distinct elements once. Of a larger table the rows of the smallest ``rank`` (ids that
    go by frequency) are broadcast within the same limits; rows get an id of their own (written, so it
    is fixed), and only the elements that those leave over meet the rest of the table by key and are
    gathered again under that id. Elements that are NULL, unknown or without a value become ``default``.
    """
    kind = table.schema[value].dataType
    rows = table.select(key, value)
    size = _broadcast_size(rows, key, value)
    if size.n <= MAX_BROADCAST_ENTRIES and size.b <= MAX_BROADCAST_BYTES:
        return df.withColumn(out_col, _broadcast_lookup(rows, key, value, default, True)(array)).drop(*drop)
    first = F.lit(False)
    most = MAX_BROADCAST_ENTRIES if rank else 0
    while most:
        first = F.coalesce(F.col(rank) < most, F.lit(False))
        size = _broadcast_size(table.filter(first).select(key, value), key, value)
        if size.n <= MAX_BROADCAST_ENTRIES and size.b <= MAX_BROADCAST_BYTES:
            break
        first, most = F.lit(False), most // 2
    head, rest = table.filter(first).select(key, value), table.filter(~first).select(key, value)
    looked = _broadcast_lookup(head, key, value, default, False)(array)
    kept = [c for c in df.columns if c not in drop]
    keyed = df.select(*kept, F.monotonically_increasing_id().alias("_slm_row"), looked.alias("_slm_got"))
    keyed = reliable_checkpoint(keyed.select(*kept, "_slm_row", F.col("_slm_got.v").alias("_slm_v"), F.col("_slm_got.k").alias("_slm_k")))
    each = keyed.select("_slm_row", F.posexplode("_slm_k").alias("_pos", key))
    found = each.join(rest, key, "left").select(
        "_slm_row", F.struct("_pos", F.coalesce(F.col(value), F.lit(default).cast(kind)).alias("v")).alias("_s"))
    lists = found.groupBy("_slm_row").agg(F.transform(F.array_sort(F.collect_list("_s")), lambda x: x["v"]).alias("_slm_list"))
    joined = keyed.drop("_slm_k").join(lists, "_slm_row", "left")
    answers = F.coalesce("_slm_list", F.array().cast(T.ArrayType(kind)))
    return joined.withColumn(out_col, _filled(kind)(F.col("_slm_v"), answers)).drop("_slm_row", "_slm_v", "_slm_list")


def encode_words(
    df: DataFrame,
    key_col: str,
    text_col: str,
    vocab: DataFrame,
    max_length: int = MAX_LENGTH,
    pad_id: int = WORD_EOS_ID,
    unk_id: int = WORD_UNK_ID,
) -> DataFrame:
    """``(key, n_tokens, input_ids, attention_mask)`` with the word vocabulary, one row per row of
    ``df`` (keys may repeat). ``n_tokens`` counts the tokens of the whole text; the first
    ``max_length`` are encoded."""
    toks = df.select(col(key_col).alias(key_col), word_tokens(text_col).alias("_t"))
    looked = _mapped_array(toks.select(key_col, F.size("_t").alias("n_tokens"), F.slice("_t", 1, max_length).alias("_t")),
                           F.col("_t"), vocab, "token", "token_id", unk_id, "_ids", "token_id", ["_t"])
    n = F.greatest("n_tokens", F.lit(0))  # a NULL text has no tokens
    ids = F.coalesce("_ids", F.array().cast("array<int>"))
    return looked.select(key_col, n.alias("n_tokens"), fixed_length(ids, max_length, pad_id).alias("input_ids"),
                         attention_mask(n, max_length).alias("attention_mask"))


def lookup_words(df: DataFrame, key_cols, text_col: str, vocab: DataFrame, unk_id: int = WORD_UNK_ID,
                 out_col: str = "ids") -> DataFrame:
    """``(keys..., ids)``: every word token of each whole text mapped through the vocabulary (unknown
    tokens -> ``unk_id``), in text order; no truncation (prompts)."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    toks = df.select(*keys, word_tokens(text_col).alias("_t"))
    return _mapped_array(toks, F.col("_t"), vocab, "token", "token_id", unk_id, out_col, "token_id", ["_t"])


def decode_words(df: DataFrame, key_cols, ids_col: str, vocab: DataFrame, special_ids=(WORD_EOS_ID,),
                 out_col: str = "text", keep_cols=()) -> DataFrame:
    """``(keys..., keep..., text)``: ids mapped back through the vocabulary (ids outside it give
    ``<|unk|>``), special ids skipped, tokens joined with one space."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    special = F.array(*[F.lit(int(s)) for s in special_ids])
    kept = df.select(*keys, *[c for c in keep_cols if c not in keys],
                     F.filter(col(ids_col), lambda x: ~F.array_contains(special, x)).alias("_ids"))
    words = _mapped_array(kept, F.col("_ids"), vocab, "token_id", "token", WORD_UNK, "_words", "token_id", ["_ids"])
    return words.withColumn(out_col, F.array_join("_words", " ")).drop("_words")


def training_table(items: DataFrame, id_col: str, text_col: str, vocab: DataFrame, frac: float = 0.8, seed: int = 42,
                   max_length: int = MAX_LENGTH) -> DataFrame:
    """Items to a training table: ``(id, in_train, input_ids, attention_mask, labels)`` with the exact
    split's flag; the two parts are filters of it (``select_model_inputs`` keeps the model's columns)."""
    flagged = split_exact(items, id_col, frac, seed, flag_col="in_train")
    toks = flagged.select(id_col, "in_train", F.slice(word_tokens(text_col), 1, max_length).alias("_t"))
    looked = _mapped_array(toks, F.col("_t"), vocab, "token", "token_id", WORD_UNK_ID, "_ids", "token_id", ["_t"])
    ids = F.coalesce("_ids", F.array().cast("array<int>"))
    shaped = looked.select(id_col, "in_train", fixed_length(ids, max_length, WORD_EOS_ID).alias("input_ids"),
                           attention_mask(F.size(ids), max_length).alias("attention_mask"))
    return shaped.withColumn("labels", causal_labels("input_ids", WORD_EOS_ID))
