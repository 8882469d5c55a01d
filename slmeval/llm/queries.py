"""Registered queries of the training-data operators, and their SQL where SQL can express them.

Each query applies its operator with production parameters to the whole table and derives the
digest columns of its result from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cdc, collocations, conversations, langid, lines, mixing, outliers, sharding, simhash, suffix_tree, urls, warc
from .common import prepare, read_table, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn

    return deco


def remainder_of(id: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % n


# -- 1. byte-level BPE -----------------------------------------------------------------------


def bpe_files() -> tuple[dict[bytes, int], str]:
    """Ranks and split pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def encoded(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with the ids of its texts and the digests of ids and decoded bytes."""
    ranks, pattern = bpe_files()
    out = bpe.encode_documents(docs, ranks, pattern, decoded="decoded", keep=keep)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        *keep, F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op1_byte_bpe")
def op1(spark, sf_dir):
    """Encode every document by the rank file, decode the ids again."""
    return encoded(read_table(spark, sf_dir, "documents"), ["doc_id"]).drop("ids")


# -- 2. document fingerprints ----------------------------------------------------------------


@register("op2_chunk_fingerprints")
def op2(spark, sf_dir):
    """Fingerprint every document, its edited text and its successor."""
    found = cdc.likeness_to_edits(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                        "edited_fingerprint", "near_edited", "near_next")


# -- 3. URL rules ----------------------------------------------------------------------------

# The rules of the query's contract.
URL_RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]

_URL_SQL = """
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC) AS k
  FROM u JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath))
SELECT u.page_id, u.host, u.path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN (SELECT DISTINCT page_id, host, path, rule, verdict FROM m WHERE k = 1) m USING (page_id, host, path)
"""


@register("op3_url_rules", _URL_SQL)
def op3(spark, sf_dir):
    """Judge every page's url by the rules; the default verdict is allow."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


# -- 4. WARC ---------------------------------------------------------------------------------


@register("op4_warc_segments")
def op4(spark, sf_dir):
    """Write a record per page, read the archives back."""
    path = scratch_path(spark, "warc")
    warc.write_archives(read_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select(
        F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


# -- 5. line dedup ---------------------------------------------------------------------------


@register("op5_fuzzy_lines")
def op5(spark, sf_dir):
    """The class of every line with a word: its first occurrence, and whether it is kept."""
    found = lines.line_classes(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "line_no", F.col("first_id").alias("class_doc_id"),
                        F.col("first_line_no").alias("class_line_no"), "kept")


# -- 6. language ID --------------------------------------------------------------------------


def language_dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Learned from the documents whose remainder modulo 5 is not 0."""
    return langid.learn(docs.filter(remainder_of("doc_id", 5) != 0))


@register("op6_compression_langid")
def op6(spark, sf_dir):
    """Predict every document's language from its text."""
    docs = read_table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), language_dictionaries(docs))
    return found.select("doc_id", (remainder_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "accepted")


# -- 7. mixing -------------------------------------------------------------------------------


@register("op7_source_mixing")
def op7(spark, sf_dir):
    """Mix all documents by source weights 1, 2, 3 in turn."""
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


# -- 8. language-model scores ----------------------------------------------------------------


@register("op8_suffix_tree_lm")
def op8(spark, sf_dir):
    """Score every document, learning from those whose remainder modulo 7 is not 2."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = suffix_tree.score_documents(docs, remainder_of("doc_id", 7) != 2)
    return scored.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


# -- 9. SimHash ------------------------------------------------------------------------------


@register("op9_simhash")
def op9(spark, sf_dir):
    """Fingerprint every document and name its component of near-duplicates."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


# -- 10. quality rules -----------------------------------------------------------------------


@register("op10_robust_outliers")
def op10(spark, sf_dir):
    """Judge every document by the base rules and its robust distance."""
    found = outliers.judge_documents(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept")


# -- 11. conversation structure repair -------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage, by the crc32 of ``conv_id:turn`` modulo 20; nulls are one space."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    told = rows.select("conv_id", "turn", text["role"].alias("role"), text["text"].alias("text"), kind.alias("kind"))
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return told.filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy")


@register("op11_glr_repair")
def op11(spark, sf_dir):
    """Repair the role structure of every damaged conversation at the lowest cost."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repaired_summaries(rows, damaged(rows))


def repaired_summaries(rows: DataFrame, left: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """The summary of every conversation of ``rows``, of which ``left`` are the turns after damage."""
    _, found = conversations.repair_conversations(left, num_partitions=num_partitions)
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


# -- 12. collocations ------------------------------------------------------------------------

_PHRASE_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
p AS (SELECT lang, row_number() OVER () AS nr, piece FROM (SELECT lang, unnest(pieces) AS piece FROM t)),
w AS (SELECT lang, nr, unnest(words) AS w1, generate_subscripts(words, 1) AS i
      FROM (SELECT lang, nr, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p)),
o AS (SELECT lang, w1, lead(w1) OVER x AS w2, lead(w1, 2) OVER x AS w3, lead(w1, 3) OVER x AS w4
      FROM w WINDOW x AS (PARTITION BY nr ORDER BY i)),
g AS MATERIALIZED (SELECT lang, w1 AS phrase, 1 AS size, count(*) AS f FROM o GROUP BY ALL
      UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM o WHERE w2 IS NOT NULL GROUP BY ALL
      UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM o WHERE w3 IS NOT NULL GROUP BY ALL
      UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 4, count(*) FROM o WHERE w4 IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS words FROM g WHERE size > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, size, a, k, array_to_string(words[1 : k], ' ') AS head, array_to_string(words[k + 1 :], ' ') AS rest
         FROM c, (VALUES (1), (2), (3)) s(k) WHERE k < size),
heads AS MATERIALIZED (SELECT cuts.*, g.f AS l FROM cuts JOIN g ON g.lang = cuts.lang AND g.phrase = head),
scored AS (SELECT heads.lang, heads.phrase, heads.size, a, k, l, g.f AS r, ((2000000::HUGEINT * a) // (l + g.f))::BIGINT AS score
           FROM heads JOIN g ON g.lang = heads.lang AND g.phrase = rest),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nr FROM scored) WHERE nr = 1),
kept AS (
  SELECT * FROM lowest b WHERE NOT EXISTS (
    SELECT 1 FROM c d WHERE d.lang = b.lang AND d.size > b.size AND 100 * d.a >= 80 * b.a
                        AND contains(' ' || d.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@register("op12_collocations", _PHRASE_SQL)
def op12(spark, sf_dir):
    """The first 2000 phrases of each language by their lowest cut."""
    return collocations.collocations(read_table(spark, sf_dir, "documents")).drop("words")


# -- 13. sharding ----------------------------------------------------------------------------

SHARDS = 16


@register("op13_virtual_slots")
def op13(spark, sf_dir):
    """Put every document into one of 16 shards by its virtual slot and the edited map."""
    found = sharding.shard_documents(read_table(spark, sf_dir, "documents"), scratch_path(spark, "slot-map"), SHARDS)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
