"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets. Every source's share of all words follows its weight, but stops at ``CAP`` times the
   source's own words; the excess is shared again by weight among the others until none is above.
2. Quotas. Sources are cut into shards of about ``SHARD_WORDS`` words (documents are dealt by a
   seeded hash, so a source with a third of all words has a third of the shards). The total is
   ``floor(words / BLOCK_WORDS)`` blocks; they go to the shards by the highest quotients
   target / (2 * blocks + 1), the target of a shard being its part of its source's target, as far
   as the shard's target has room for whole blocks. The words that blocks leave (parts of blocks, small
   sources) are given in the same way in blocks of one word, by what is missing to the targets.
   Words that a shard cannot take go round again among those with room.
3. Selection. Within a shard the documents stand in seeded order and their words form one ring;
   the shard's blocks are taken from its start, going round again while the quota asks for it.

DataFrame operations only. Scale: words are counted in one pass and kept as (id, source, size)
rows; the per-source and per-shard tables come from grouped sums (combined on the map side). The
targets need one number back from Spark per round of resharing. The quotients start from the
rounded quotas (divisor method with divisor words / blocks), which are off by a few blocks; only
candidates for those are ranked. The only windows run inside a shard, which is bounded. Sources
are numbered by the ordered scan of the library (no single-task window), joined back by key, and
a hot source is split by its shards.

Results: null texts have size 0 and take 0; a null source is a source of its own, the last.
Each source's words are within a word for each
of its shards of its target, rounded. ``taken`` never exceeds ``CAP`` times the document's size; documents
without words stay out of the rings. Equal (id, source, text) rows tie and
may swap their shares, which gives the same rows. Reruns agree: all sums are whole numbers, all
orders are total up to equal rows. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import ordered_scan
from .common import fresh_names, reliable_checkpoint, word_count

CAP = 3
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 20
SEED = 7


def cycle_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Append ``weight``: the weights in turn over the sources by code point, null last."""
    keyed = sources.withColumn("is_null", F.col("source").isNull())
    numbered = ordered_scan(keyed, None, ["is_null", "source"], cum_col="n")  # from 0
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    return numbered.select(*sources.columns, pick.cast("double").alias("weight"))


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Append ``target`` to (source, source_size, weight): the share of all words by weight, at most
    ``cap`` times the source's size, the excess reshared by weight until none is above."""
    sources = reliable_checkpoint(sources)
    top = F.col("source_size") * float(cap)
    level = None  # words for each unit of weight of the sources below their top
    for _ in range(10_000):
        full = F.lit(False) if level is None else F.col("weight") * level >= top
        r = sources.agg(F.sum("source_size").alias("words"), F.sum(F.when(full, F.col("source_size"))).alias("full"),
                        F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not r.words or not r.open:
            break
        following = (r.words - cap * (r.full or 0)) / r.open
        if level is not None and following <= level:
            break
        level = following
    aim = F.least(F.col("weight") * (level or 0.0), top) if level is not None else F.lit(0.0)
    return sources.withColumn("target", aim.cast("double"))


def apportion(cells: DataFrame, seats: int, target: str, limit: str, order: list[str]) -> DataFrame:
    """Append ``quota`` (BIGINT): ``seats`` given to the cells by the highest quotients
    target / (2 * quota + 1), ties by ``order``; then at most ``limit``.

    Rounding target / (sum / seats) is the same method with a divisor that is slightly off; the
    difference is made good with the next (or last) quotients of the cells. A cell can need at
    most its part of half the cells' number, and one more, of those.
    """
    t = F.col(target)
    cells = reliable_checkpoint(cells)
    total = cells.agg(F.sum(t).alias("t"), F.count("*").alias("n")).first()
    if not total.t or seats <= 0:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    divisor = total.t / seats
    rounded = reliable_checkpoint(cells.withColumn("quota", F.floor(t / divisor + 0.5).cast("long")))
    missing = seats - (rounded.agg(F.sum("quota")).first()[0] or 0)
    if missing:
        steps = F.ceil(t / total.t * (total.n / 2.0)).cast("long") + 1
        step = F.explode(F.sequence(F.lit(0).cast("long"), steps))
        key = F.struct(*order)
        if missing > 0:
            quotient = t / (2 * (F.col("quota") + F.col("step")) + 1)
            rows = rounded.select(key.alias("key"), t.alias(target), "quota", step.alias("step"))
            moved = rows.withColumn("q", quotient).orderBy(F.desc("q"), "key", "step").limit(missing)
        else:
            quotient = t / (2 * (F.col("quota") - F.col("step")) - 1)
            rows = rounded.select(key.alias("key"), t.alias(target), "quota", step.alias("step")).filter("quota > step")
            moved = rows.withColumn("q", quotient).orderBy("q", F.desc("key"), "step").limit(-missing)
        change = moved.groupBy("key").agg(F.count("*").alias("by"))
        joined = rounded.withColumn("key", key).join(change, "key", "left")
        sign = 1 if missing > 0 else -1
        rounded = joined.withColumn("quota", F.col("quota") + sign * F.coalesce("by", F.lit(0))).drop("key", "by")
    return rounded.withColumn("quota", F.least("quota", F.col(limit)))


def shard_quotas(cells: DataFrame, words: int, cap: int = CAP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source, shard, cell, words): the words that each shard gives, ``words`` in all where there is room.
    ``cells`` are (source, shard, cell, aim); ``words`` never exceeds ``cap`` times the shard's words."""
    order, aim = ["source", "shard"], F.col("aim")
    blocks = apportion(cells.withColumn("most", F.floor(aim / block_words).cast("long")), words // block_words, "aim", "most", order)
    now = reliable_checkpoint(blocks.select(*order, "cell", "aim", (F.col("quota") * block_words).alias("words")))
    for turn in range(64):
        left = words - (now.agg(F.sum("words")).first()[0] or 0)
        room = F.col("cell") * cap - F.col("words")
        # first what is missing to the targets; what shards without room leave goes by the targets
        missing = F.greatest(aim - F.col("words"), F.lit(0.0)) if turn == 0 else aim
        wanted = now.withColumn("room", room).withColumn("wanted", F.when(F.col("room") > 0, missing).otherwise(0.0))
        if left <= 0 or not wanted.agg(F.sum("wanted")).first()[0]:
            break
        given = apportion(wanted, left, "wanted", "room", order)
        now = reliable_checkpoint(given.select(*order, "cell", "aim", (F.col("words") + F.col("quota")).alias("words")))
    return now.drop("aim")


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, block_words: int = BLOCK_WORDS,
        shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """(id, text_hash, source, size, source_size, target, taken) for each row of ``df``.

    ``text_hash`` (XXH64 of the text) tells rows with a repeated id apart.
    """
    rows = reliable_checkpoint(df.select(
        F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(source).alias("source"),
        word_count(F.col(text)).alias("size")))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = reliable_checkpoint(targets(cycle_weights(sources), cap))
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    known = sources.select(F.col("source").alias("s"), "source_size", "target", shards.alias("shards"))
    place = F.xxhash64(F.lit(seed), F.col("id"), F.col("text_hash"))
    dealt = rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("place", place)
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("place"), F.col("shards"))).drop("shards")
    dealt = reliable_checkpoint(dealt)
    empty, dealt = dealt.filter("size = 0"), dealt.filter("size > 0")
    cells = dealt.groupBy("source", "shard").agg(
        F.sum("size").alias("cell"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    share = F.when(F.col("source_size") > 0, F.col("target") * F.col("cell") / F.col("source_size")).otherwise(0.0)
    cells = cells.select("source", "shard", "cell", share.alias("aim"))
    quotas = shard_quotas(cells, words, cap, block_words).select(
        F.col("source").alias("s"), F.col("shard").alias("k"), "cell", "words")
    ring = Window.partitionBy("source", "shard").orderBy("place", "id", "text_hash")
    before = F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.withColumn("before", F.coalesce(before, F.lit(0)))
    joined = placed.join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("k")))
    rounds, rest = F.expr("words div cell"), F.expr("words % cell")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(rest - F.col("before"), F.col("size")))
    names = ["id", "text_hash", "source", "size", "source_size", "target"]
    return joined.select(*names, taken.cast("long").alias("taken")).union(empty.select(*names, F.lit(0).cast("long").alias("taken")))


def mixed_documents(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as the mix takes its words (rounded half up), with the
    columns of ``df``; texts are not cut. A document without words stays once."""
    shares = mix(df, id, text, source)
    i, h, n = fresh_names(df, "id", "hash", "copies")
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    # rows equal in id and text have equal columns here: their shares are added and split again
    often = reliable_checkpoint(shares.groupBy(F.col("id").alias(i), F.col("text_hash").alias(h)).agg(
        F.floor(F.sum(copies) / F.count("*") + 0.5).cast("int").alias(n)).filter(F.col(n) > 0))
    keyed = df.withColumn(h, F.xxhash64(F.col(text)))
    joined = keyed.join(often, (keyed[h] == often[h]) & keyed[id].eqNullSafe(often[i]))
    repeated = joined.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n))))
    return repeated.select(*[keyed[f"`{c}`"] for c in df.columns])
