"""Quality rules: text statistics, base rules and robust multivariate outliers.

Statistics of every whole text (a word is a run of other than ASCII white space): words, characters
in words, symbols, lines equal to an earlier line, and words inside 8-word windows that occur twice
or more. Windows are compared by a 64-bit hash of the hashes of their words. Two base rules reject
very short and very repetitive texts.

The others are judged by a vector of four transformed statistics: log of the mean word length,
square root of symbols per word, share of repeated lines, share of repeated words. Location and
scatter of the vector are minimum-covariance-determinant estimates for each (language, source),
and for each language, which stands in for sources with fewer than ``MIN_GROUP`` texts. From two
starts (medians with median absolute deviations; means with covariances) concentration steps
keep the ``H`` share of a group with the smallest Mahalanobis distances and estimate again; the
start with the smaller determinant wins. The scatter gets the consistency factor of the share and
a floor on its diagonal (``FLOORS``: differences this small are never remarkable, and a statistic
that is 0 in most texts stays usable). A text is rejected beyond ``CUTOFF`` squared distances.

DataFrame functions only, no Python code on executors. Every step is a grouped aggregation
(combined on the map side, so a group may hold any share of the rows) over the small rows of
statistics, which are kept once; the groups' estimates are joined back by broadcast while there
are at most ``MAX_BROADCAST`` of them (checked), else by key. The distance is a forward substitution
with the Cholesky factor, written out in column expressions. Thresholds come from approximate
percentiles (mergeable, relative rank error 1e-4).

Results: a null text has no words and fails the base rules, as do empty ones. Null languages or
sources are groups of their own. Repeated rows are judged each by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HAS_WORD, reliable_checkpoint

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_GROUP = 40
H = 0.75
STEPS = 4
FLOORS = (0.05, 0.08, 0.12, 0.12)
CUTOFF = 36.0
MAX_BROADCAST = 50_000
ACCURACY = 10_000
P = len(FLOORS)


def text_statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines,
    n_repeat_words (all BIGINT) of each row. ``keep`` columns come first, by position."""
    own = [f"k{i}" for i in range(len(keep))]
    t = df.select(*[F.col(c).alias(o) for c, o in zip(keep, own)], F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(HAS_WORD))
    a = t.select(*own, words.alias("w"), lines.alias("l"), F.regexp_count("t", F.lit(r"[#*$%&|<>]")).alias("sym"))
    b = a.select(*own, "sym", F.size("w").alias("n"), F.length(F.array_join("w", "")).alias("chars"),
                 F.size("l").alias("lines"), (F.size("l") - F.size(F.array_distinct("l"))).alias("dup"),
                 F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    last = F.col("n") - (WINDOW - 1)
    hashed = F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("h", i, WINDOW)))) \
        .otherwise(F.array().cast("array<bigint>"))
    c = b.select(*own, "sym", "n", "chars", "lines", "dup", hashed.alias("v"))
    at = F.transform("v", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    none = F.array().cast("array<struct<x:bigint,i:int>>")
    d = c.select(*own, "sym", "n", "chars", "lines", "dup", F.when(
        F.size(F.array_distinct("v")) < F.size("v"), F.array_sort(at)).otherwise(none).alias("s"))
    same = lambda x, j: F.coalesce(F.get("s", j)["x"] == x["x"], F.lit(False))
    twice = F.filter("s", lambda x, j: same(x, j + 1) | ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))))
    e = d.select(*own, "sym", "n", "chars", "lines", "dup", F.array_sort(F.transform(twice, lambda x: x["i"])).alias("p"))
    # windows at rising places: each covers its words up to the next one's first
    reach = F.transform("p", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("p", j + 1) - x, F.lit(WINDOW))))
    covered = F.aggregate(reach, F.lit(0), lambda s, x: s + x)
    values = {"n_words": "n", "word_chars": "chars", "n_symbols": "sym", "n_lines": "lines", "n_dup_lines": "dup"}
    return e.select(*[F.col(o).alias(c) for c, o in zip(keep, own)],
                    *[F.col(v).cast("long").alias(k) for k, v in values.items()], covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    n = F.greatest("n_words", F.lit(1)).cast("double")
    return [F.log(F.greatest("word_chars", F.lit(1)) / n), F.sqrt(F.col("n_symbols") / n),
            F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), F.col("n_repeat_words") / n]


def consistency(h: float = H, p: int = P) -> float:
    """h / P(chi2 with p + 2 degrees <= its h quantile with p degrees), for even p."""

    def cdf(x: float, k: int) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))

    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid, p) < h else (low, mid)
    return h / cdf(low, p + 2)


X = [f"x{i}" for i in range(P)]
MEANS = [f"m{i}" for i in range(P)]
FACTOR = [f"l{i}{j}" for i in range(P) for j in range(i + 1)]


def _factor(cov: dict[tuple[int, int], Column]) -> dict[str, Column]:
    """Cholesky factor (lower triangle) of a covariance matrix with floors on its diagonal."""
    low: dict[tuple[int, int], Column] = {}
    for i in range(P):
        for j in range(i + 1):
            rest = cov[i, j]
            for k in range(j):
                rest = rest - low[i, k] * low[j, k]
            # the floor keeps pivots positive but for rounding
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2))) if i == j else rest / low[j, j]
    return {f"l{i}{j}": c for (i, j), c in low.items()}


def _distance() -> Column:
    """Squared Mahalanobis distance of x from m: the squared norm of the solution of L y = x - m."""
    y: list[Column] = []
    for i in range(P):
        r = F.col(X[i]) - F.col(MEANS[i])
        for j in range(i):
            r = r - F.col(f"l{i}{j}") * y[j]
        y.append(r / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _estimate(rows: DataFrame, factor: float) -> DataFrame:
    """(grp, start, n, means, factor, log determinant) of the rows of each group."""
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    sums = rows.groupBy("grp", "start").agg(
        F.count("*").alias("n"), *[F.avg(X[i]).alias(MEANS[i]) for i in range(P)],
        *[F.covar_pop(X[i], X[j]).alias(f"c{i}{j}") for i, j in pairs])
    cov = {(i, j): F.col(f"c{i}{j}") * factor + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in pairs}
    return _with_factor(sums, cov)


def _with_factor(groups: DataFrame, cov: dict) -> DataFrame:
    low = groups.select("grp", "start", "n", *MEANS, *[v.alias(k) for k, v in _factor(cov).items()])
    return low.withColumn("logdet", sum((F.log(f"l{i}{i}") for i in range(1, P)), F.log("l00")))


def _joined(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Rows with their group's estimate: broadcast while the groups are few, else joined by key."""
    few = groups.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return rows.join(F.broadcast(groups) if few else groups, on)


def group_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """MCD estimates (grp, n, means, factor) from rows (grp, x0..): ``n`` is the group's size."""
    middle = rows.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, ACCURACY).alias(f"m{i}") for i, x in enumerate(X)])
    middle = reliable_checkpoint(middle)
    away = _joined(rows, middle, ["grp"]).select("grp", *MEANS, *[F.abs(F.col(x) - F.col(m)).alias(x) for x, m in zip(X, MEANS)])
    mad = away.groupBy("grp").agg(F.count("*").alias("n"), *[F.first(m).alias(m) for m in MEANS],
                                  *[F.percentile_approx(x, 0.5, ACCURACY).alias(f"d{i}") for i, x in enumerate(X)])
    diagonal = {(i, j): (F.pow(1.4826 * F.col(f"d{i}"), F.lit(2.0)) + FLOORS[i] ** 2) if i == j else F.lit(0.0)
                for i in range(P) for j in range(i + 1)}
    robust = _with_factor(mad.withColumn("start", F.lit(0)), diagonal)
    plain = _estimate(rows.withColumn("start", F.lit(1)), 1.0)
    now = reliable_checkpoint(robust.unionByName(plain))
    both = reliable_checkpoint(rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))))
    scale = consistency()
    for _ in range(steps):
        near = _joined(both, now.drop("n"), ["grp", "start"]).select("grp", "start", *X, _distance().alias("d"))
        near = reliable_checkpoint(near)
        bound = reliable_checkpoint(near.groupBy("grp", "start").agg(F.percentile_approx("d", H, ACCURACY).alias("bound")))
        core = _joined(near, bound, ["grp", "start"]).filter("d <= bound")
        now = reliable_checkpoint(_estimate(core, scale))
    sizes = rows.groupBy("grp").agg(F.count("*").alias("size"))
    best = now.groupBy("grp").agg(F.min_by(F.struct(*MEANS, *FACTOR), F.struct("logdet", "start")).alias("b"))
    return reliable_checkpoint(best.join(sizes, "grp").select("grp", F.col("size").alias("n"), "b.*"))


def judge_documents(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
                    cutoff: float = CUTOFF) -> DataFrame:
    """(id, lang, source, statistics, base_failed, distance, kept) for each row; ``distance`` is the
    squared Mahalanobis distance, null where the base rules fail."""
    stats = text_statistics(df, text, (id, lang, source))
    names = dict(zip(stats.columns[:3], ("id", "lang", "source")))
    stats = stats.toDF(*[names.get(c, c) for c in stats.columns]).withColumn("base_failed", base_failed())
    stats = reliable_checkpoint(stats.select("*", *[v.alias(x) for v, x in zip(vector(), X)]))
    by_language = F.concat(F.lit("l"), F.to_json(F.struct("lang")))
    by_source = F.concat(F.lit("s"), F.to_json(F.struct("lang", "source")))
    rows = stats.filter(~F.col("base_failed")).select(F.explode(F.array(by_language, by_source)).alias("grp"), *X)
    found = group_estimates(reliable_checkpoint(rows))
    large = found.filter(F.col("grp").startswith("s") & (F.col("n") >= MIN_GROUP)).select(F.col("grp").alias("own"))
    keyed = stats.withColumn("own", by_source)
    few = large.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    marked = keyed.join((F.broadcast(large) if few else large).withColumn("big", F.lit(True)), "own", "left")
    marked = marked.withColumn("grp", F.when(F.col("big"), F.col("own")).otherwise(by_language))
    few = found.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    joined = marked.join((F.broadcast(found) if few else found).drop("n"), "grp", "left")
    distance = F.when(~F.col("base_failed"), _distance())
    return joined.withColumn("distance", distance).select(
        "id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"))
