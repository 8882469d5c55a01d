"""Run-result statistics: means per label, whole-run summary, relative scores, empirical CDFs.

A run table has one row per inference: ``label`` (model / variant), ``answer`` and the cost
metrics ``ram_before``, ``ram_after``, ``cpu_usage``, ``inference_time``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._util import col
from ..functions.arrays import close_loop, radar_angles
from ..functions.metrics import relative_score
from .exact import exact_means
from .ordered import ordered_scan, ranges_for

# The averaged metrics and their order on the radar chart.
DEFAULT_METRICS: dict[str, str] = {
    "avg_time": "inference_time",
    "avg_ram_after": "ram_after",
    "avg_cpu": "cpu_usage",
}
SCORE_NAMES: dict[str, str] = {
    "avg_time": "score_time",
    "avg_ram_after": "score_ram",
    "avg_cpu": "score_cpu",
}


def missing_to_null(c) -> Column:
    """NaN -> NULL, so that aggregates skip both (pandas ``dropna``)."""
    c = col(c).cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is neither NULL nor NaN."""
    c = F.col(column)
    return df.filter(c.isNotNull() & ~F.isnan(c.cast("double")))


def mean_by_label(
    runs: DataFrame,
    label_col: str = "label",
    metrics: Mapping[str, str] | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Mean of each metric per label, NULL and NaN skipped, whatever the partitioning to the last bit
    (:mod:`slmeval.operators.exact`).

    ``digits`` rounds the means; scores are meant to be taken from unrounded ones.
    """
    metrics = dict(metrics or DEFAULT_METRICS)
    clean = {src: f"m{i}" for i, src in enumerate(dict.fromkeys(metrics.values()))}
    rows = runs.select(F.col(label_col).alias("label"), *[missing_to_null(src).alias(n) for src, n in clean.items()])
    means = exact_means(rows, ["label"], {out: clean[src] for out, src in metrics.items()})
    return means if digits is None else means.withColumns({out: F.round(out, digits) for out in metrics})


def run_summary(
    runs: DataFrame,
    metrics: Mapping[str, str] | None = None,
    skip_missing: bool = False,
    digits: int | None = None,
) -> DataFrame:
    """Whole-table means (one row). ``np.mean`` on lists propagates NaN: ``skip_missing=False``."""
    metrics = dict(
        metrics
        or {
            "avg_time": "inference_time",
            "avg_ram_before": "ram_before",
            "avg_ram_after": "ram_after",
            "avg_cpu": "cpu_usage",
        }
    )
    clean = {src: f"m{i}" for i, src in enumerate(dict.fromkeys(metrics.values()))}
    rows = runs.select(*[(missing_to_null(src) if skip_missing else F.col(src).cast("double")).alias(n) for src, n in clean.items()])
    means = exact_means(rows, [], {out: clean[src] for out, src in metrics.items()})
    return means if digits is None else means.withColumns({out: F.round(out, digits) for out in metrics})


def relative_scores(
    averages: DataFrame,
    metrics: Sequence[str] = tuple(DEFAULT_METRICS),
    score_names: Mapping[str, str] | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Per label and metric: ``min over labels / own mean * 100`` if the mean is > 0, else 0.

    The minimum includes non-positive means (a negative minimum gives negative scores) and
    ignores NULL (a label without values has a NULL mean and scores 0). The minima are one
    non-correlated scalar subquery (evaluated once, inlined as a literal): no join.
    """
    names = dict(score_names or SCORE_NAMES)
    minima = averages.agg(F.struct(*[F.min(m).alias(m) for m in metrics]).alias("m")).scalar()
    out = [F.col(c) for c in averages.columns]
    for m in metrics:
        s = relative_score(m, minima.getField(m))
        out.append((F.round(s, digits) if digits is not None else s).alias(names.get(m, f"score_{m}")))
    return averages.select(*out)


def order_labels(df: DataFrame, order: Sequence[str], label_col: str = "label", out_col: str = "label_order") -> DataFrame:
    """Position of each label in a declared order (1-based; 0 when not listed), sorted by it."""
    pos = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(label_col))
    return df.withColumn(out_col, pos.cast("int")).orderBy(F.col(out_col), F.col(label_col))


def empirical_cdf(
    df: DataFrame,
    label_col: str | Sequence[str],
    value_col: str,
    points: str = "rows",
    tie_break: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Empirical CDF per label, missing values dropped.

    ``points='rows'`` (the reference): every row of a label, sorted by value, gets
    ``rank / n`` with rank 1..n, so two equal values of four give 0.25 and 0.5. Output
    ``(labels..., value, rank, cdf)``. ``points='distinct'``: one row per distinct value with
    ``cdf = #(<= value) / n`` (SQL ``cume_dist``), output ``(labels..., value, n_rows, cdf)``.

    Both run on :func:`ordered_scan`, so a label holding most rows, or one value repeated
    many times, is still spread over many tasks. ``distinct`` first combines equal values
    (partial aggregation), ``rows`` ranks the rows with a tie-break column (``tie_break`` or
    an id made here).
    """
    labels = [label_col] if isinstance(label_col, str) else list(label_col)
    v = drop_missing(df.select(*labels, F.col(value_col).cast("double").alias("value")), "value")
    if points in ("rows", "distinct"):
        num_partitions = num_partitions or ranges_for(v)
    if points == "distinct":
        d = v.groupBy(*labels, "value").agg(F.count(F.lit(1)).alias("n_rows"))
        s = ordered_scan(d, labels, ["value"], weight="n_rows", cum_col="_before", total_col="_n",
                         num_partitions=num_partitions)
        return s.select(*labels, "value", "n_rows", ((F.col("_before") + F.col("n_rows")) / F.col("_n")).alias("cdf"))
    if points != "rows":
        raise ValueError("points must be 'rows' or 'distinct'")
    tb = tie_break or "_slm_tb"
    if tie_break is None:
        v = v.withColumn(tb, F.monotonically_increasing_id())
    else:
        v = v.withColumn(tb, F.col(tie_break))
    s = ordered_scan(v, labels, ["value", tb], cum_col="_before", total_col="_n", num_partitions=num_partitions)
    rank = (F.col("_before") + 1).cast("long")
    return s.select(*labels, "value", rank.alias("rank"), (rank / F.col("_n")).alias("cdf"))


def sketch_rank_error(k: int) -> float:
    """The rank error of one quantile of a KLL sketch of size ``k``, with 99 % confidence (published fit)."""
    return 2.296 / k**0.9723


def sketch_cdf(df: DataFrame, label_col: str | Sequence[str], value_col: str, points: int = 100, k: int = 800) -> DataFrame:
    """(labels..., point, cdf, value): ``points`` points of each label's CDF from a mergeable quantile sketch.

    One aggregation whatever the number of rows: partial sketches of a few kilobytes are merged, nothing is sorted or
    collected. ``cdf`` is ``point / points`` and ``value`` a value of the column whose rank is off by at most
    :func:`sketch_rank_error` (99 % confidence, 0.35 % for the default size). Missing values are dropped; a label
    without values has no points. The chart of a billion rows needs no more than this; :func:`empirical_cdf` has
    every row's exact rank.
    """
    labels = [label_col] if isinstance(label_col, str) else list(label_col)
    v = drop_missing(df.select(*labels, F.col(value_col).cast("double").alias("value")), "value")
    sketches = v.groupBy(*labels).agg(F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))
    ranks = F.array(*[F.lit((i + 1) / points) for i in range(points)])
    rows = sketches.select(*labels, F.posexplode(F.arrays_zip(
        ranks.alias("cdf"), F.kll_sketch_get_quantile_double("sketch", ranks).alias("value"))).alias("i", "p"))
    return rows.select(*labels, (F.col("i") + 1).alias("point"), F.col("p.cdf").alias("cdf"), F.col("p.value").alias("value"))


def unpivot_metrics(runs: DataFrame, label_col: str, metrics: Sequence[str]) -> DataFrame:
    """``(label, metric, value)`` long form, so several metric CDFs share one scan."""
    return runs.select(
        F.col(label_col).alias("label"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_mv"),
    ).select("label", "_mv.metric", "_mv.value")


def metric_cdfs(runs: DataFrame, label_col: str = "label",
                metrics: Sequence[str] = ("ram_after", "cpu_usage", "inference_time"),
                points: str = "rows", num_partitions: int | None = None) -> DataFrame:
    """CDF of several metrics per label in one pass: ``(label, metric, value, rank|n_rows, cdf)``."""
    return empirical_cdf(unpivot_metrics(runs, label_col, metrics), ["label", "metric"], "value", points=points,
                         num_partitions=num_partitions)


def radar_points(scores: DataFrame, score_cols: Sequence[str] = ("score_time", "score_ram", "score_cpu"),
                 label_col: str = "label") -> DataFrame:
    """Closed radar polygon per label: ``(label, point, angle, value)`` with the first point
    repeated at the end; angles ``i * 2*pi/N`` from 0, end point excluded, then closed."""
    n = len(score_cols)
    vals = close_loop(F.array(*[F.col(c).cast("double") for c in score_cols]))
    angles = close_loop(radar_angles(n))
    z = F.arrays_zip(angles.alias("angle"), vals.alias("value"))
    return scores.select(F.col(label_col).alias("label"), F.posexplode(z).alias("point", "pv")).select(
        "label", F.col("point").cast("int").alias("point"), F.col("pv.angle").alias("angle"), F.col("pv.value").alias("value")
    )
