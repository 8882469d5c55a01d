"""The registered query set: one Spark plan per operator family, each with a DuckDB oracle.

Each query takes ``(spark, sf_dir)``, reads whole driver tables through
:mod:`slmeval.plans.fixtures` and returns a DataFrame. ``ORACLE_SQL[name]`` is the same result
in SQL over the same tables (DuckDB views named like the tables). Column names match; doubles
that come from sums are rounded to 6 decimals in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import stats
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn

    return deco


# --------------------------------------------------------------------------------------
# 1. run-result means and scores (runs <- lineitem)

_RUN_AVG_SQL = """
SELECT l_returnflag AS label,
       round(avg(l_quantity), 6) AS avg_time,
       round(avg(l_extendedprice), 6) AS avg_ram_after,
       round(avg(l_tax), 6) AS avg_cpu
FROM lineitem GROUP BY l_returnflag
"""


def _sql_mean(column: str) -> str:
    """The exact sum of the binary values (whole numbers after scaling by 2^70), rounded once, over the count."""
    return f"CAST(CAST(sum(CAST(({column}) * 2::DOUBLE^70 AS HUGEINT)) AS VARCHAR) AS DOUBLE) / 2::DOUBLE^70 / count({column})"


_EXACT_AVG = f"""SELECT l_returnflag AS label, {_sql_mean('l_quantity')} AS avg_time, {_sql_mean('l_extendedprice')} AS avg_ram_after,
       {_sql_mean('l_tax')} AS avg_cpu
FROM lineitem GROUP BY l_returnflag"""


# Means are exact in the library; queries whose SQL adds doubles in any order round here.
_AVERAGES = ("avg_time", "avg_ram_after", "avg_cpu")


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in (columns or [c for c, t in df.dtypes if t == "double"])})


@register("mean_by_label", _EXACT_AVG)
def q_mean_by_label(spark, sf_dir):
    """Equal to the last bit, whatever the partitioning."""
    return stats.mean_by_label(fx.runs_from_lineitem(spark, sf_dir).repartition(7))


@register(
    "run_summary",
    f"""
SELECT {_sql_mean('l_quantity')} AS avg_time, {_sql_mean('l_discount * 1000.0')} AS avg_ram_before,
       {_sql_mean('l_extendedprice')} AS avg_ram_after, {_sql_mean('l_tax')} AS avg_cpu
FROM lineitem
""",
)
def q_run_summary(spark, sf_dir):
    return stats.run_summary(fx.runs_from_lineitem(spark, sf_dir))


_SCORES_SQL = """
WITH a AS (SELECT l_returnflag AS label, avg(l_quantity) AS avg_time, avg(l_extendedprice) AS avg_ram_after, avg(l_tax) AS avg_cpu
           FROM lineitem GROUP BY l_returnflag),
m AS (SELECT min(avg_time) AS mt, min(avg_ram_after) AS mr, min(avg_cpu) AS mc FROM a)
SELECT label, round(avg_time, 6) AS avg_time, round(avg_ram_after, 6) AS avg_ram_after, round(avg_cpu, 6) AS avg_cpu,
       CASE WHEN avg_time > 0 THEN round(mt / avg_time * 100.0, 6) ELSE 0.0 END AS score_time,
       CASE WHEN avg_ram_after > 0 THEN round(mr / avg_ram_after * 100.0, 6) ELSE 0.0 END AS score_ram,
       CASE WHEN avg_cpu > 0 THEN round(mc / avg_cpu * 100.0, 6) ELSE 0.0 END AS score_cpu
FROM a, m
"""


@register("relative_scores", _SCORES_SQL)
def q_relative_scores(spark, sf_dir):
    return _rounded(stats.relative_scores(stats.mean_by_label(fx.runs_from_lineitem(spark, sf_dir))))


@register(
    "order_labels",
    f"""
SELECT label, avg_time, avg_ram_after, avg_cpu,
       CAST(coalesce(list_position(['A', 'N', 'R'], label), 0) AS INTEGER) AS label_order
FROM ({_RUN_AVG_SQL})
""",
)
def q_order_labels(spark, sf_dir):
    return _rounded(stats.order_labels(stats.mean_by_label(fx.runs_from_lineitem(spark, sf_dir)), fx.RUN_LABEL_ORDER), *_AVERAGES)


@register(
    "radar_points",
    f"""
WITH s AS ({_SCORES_SQL}),
p AS (SELECT label, [score_time, score_ram, score_cpu, score_time] AS v FROM s)
SELECT label, CAST(i - 1 AS INTEGER) AS point,
       CAST(((i - 1) % 3) AS DOUBLE) * (2.0 * pi() / 3.0) AS angle,
       v[i] AS value
FROM p, range(1, 5) t(i)
""",
)
def q_radar_points(spark, sf_dir):
    return stats.radar_points(q_relative_scores(spark, sf_dir))


# --------------------------------------------------------------------------------------
# 2. empirical CDFs (events by event_type; runs by label for three metrics)


@register(
    "empirical_cdf",
    """
SELECT event_type, value,
       row_number() OVER (PARTITION BY event_type ORDER BY value) AS rank,
       row_number() OVER (PARTITION BY event_type ORDER BY value) / count(*) OVER (PARTITION BY event_type) AS cdf
FROM events WHERE value IS NOT NULL AND NOT isnan(value)
""",
)
def q_empirical_cdf(spark, sf_dir):
    return stats.empirical_cdf(fx.table(spark, sf_dir, "events"), "event_type", "value", points="rows")


@register(
    "empirical_cdf_distinct",
    """
SELECT event_type, value, count(*) AS n_rows, max(cd) AS cdf FROM (
  SELECT event_type, value, cume_dist() OVER (PARTITION BY event_type ORDER BY value) AS cd
  FROM events WHERE value IS NOT NULL AND NOT isnan(value)
) GROUP BY event_type, value
""",
)
def q_empirical_cdf_distinct(spark, sf_dir):
    return stats.empirical_cdf(fx.table(spark, sf_dir, "events"), "event_type", "value", points="distinct")


@register(
    "run_metric_cdf",
    """
WITH u AS (
  SELECT l_returnflag AS label, 'ram_after' AS metric, l_extendedprice AS value FROM lineitem
  UNION ALL SELECT l_returnflag, 'cpu_usage', l_tax FROM lineitem
  UNION ALL SELECT l_returnflag, 'inference_time', l_quantity FROM lineitem
)
SELECT label, metric, value,
       row_number() OVER (PARTITION BY label, metric ORDER BY value) AS rank,
       row_number() OVER (PARTITION BY label, metric ORDER BY value) / count(*) OVER (PARTITION BY label, metric) AS cdf
FROM u WHERE value IS NOT NULL AND NOT isnan(value)
""",
)
def q_run_metric_cdf(spark, sf_dir):
    return stats.metric_cdfs(fx.runs_from_lineitem(spark, sf_dir))


# --------------------------------------------------------------------------------------
# 3. prompts, training text, answer cleaning, reports

from ..functions import format as fmt  # noqa: E402
from ..functions import text as tx  # noqa: E402
from ..operators import split as sp  # noqa: E402

_WS = "(" + " || ".join(f"chr({c})" for c in tx.PY_WHITESPACE_CODEPOINTS) + ")"


def _sql_clean(expr: str) -> str:
    s1 = f"trim({expr}, {_WS})"
    s2 = f"trim(split_part({s1}, chr(10), 1), {_WS})"
    return f"CASE WHEN lower(substring({s2}, 1, 7)) = 'answer:' THEN trim(substring({s2}, 8), {_WS}) ELSE {s2} END"


_SQL_PROMPT = "'Scenario: ' || coalesce(role, 'None') || chr(10) || 'Question: ' || coalesce(text, 'None') || chr(10) || 'Answer:'"


@register("build_prompt", f"SELECT conv_id, turn, {_SQL_PROMPT} AS prompt FROM conversations")
def q_build_prompt(spark, sf_dir):
    it = fx.items_from_conversations(spark, sf_dir)
    return it.select("conv_id", "turn", tx.build_prompt("scenario", "question").alias("prompt"))


@register(
    "build_training_text",
    f"""
SELECT q.conv_id, q.turn, {_SQL_PROMPT.replace('role', 'q.role').replace('text,', 'q.text,')} AS prompt,
       {_SQL_PROMPT.replace('role', 'q.role').replace('text,', 'q.text,')} || ' ' || coalesce(a.text, 'None') AS text
FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
WHERE q.role = 'user'
""",
)
def q_build_training_text(spark, sf_dir):
    t = fx.training_items(spark, sf_dir)
    p = tx.build_prompt("scenario", "question")
    return t.select("conv_id", "turn", p.alias("prompt"), tx.build_training_text(p, "answer").alias("text"))


@register("clean_answer", f"SELECT doc_id, {_sql_clean('text')} AS answer FROM documents")
def q_clean_answer(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.clean_answer("text").alias("answer"))


@register(
    "format_run_report",
    """
SELECT run_no,
       'Run ' || run_no || ': ' || ('status ' || l_linestatus) || chr(10) ||
       '   Time: ' || CAST(l_quantity AS VARCHAR) || 's | RAM: ' || printf('%.2f', l_discount * 1000.0) || '->' ||
       printf('%.2f', l_extendedprice) || ' MB | CPU: ' || printf('%.2f', l_tax) || '%' AS report
FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS run_no FROM lineitem)
""",
)
def q_format_run_report(spark, sf_dir):
    runs = sp.number_runs(fx.runs_from_lineitem(spark, sf_dir), fx.RUN_ORDER)
    return runs.select(
        "run_no",
        fmt.format_run_report("run_no", "answer", "inference_time", "ram_before", "ram_after", "cpu_usage").alias("report"),
    )


def _sql_pad(e: str) -> str:
    return f"CASE WHEN length({e}) >= 15 THEN {e} ELSE rpad({e}, 15, ' ') END"


@register(
    "format_scoreboard",
    f"""
SELECT label,
       concat_ws(' ', {_sql_pad('label')}, {_sql_pad("printf('%.4f', avg_time)")},
                 {_sql_pad("printf('%.2f', avg_ram_after)")}, {_sql_pad("printf('%.2f', avg_cpu)")}) AS averages_line,
       concat_ws(' ', {_sql_pad('label')}, {_sql_pad("printf('%.1f', score_time)")},
                 {_sql_pad("printf('%.1f', score_ram)")}, {_sql_pad("printf('%.1f', score_cpu)")}) AS scores_line
FROM ({_SCORES_SQL})
""",
)
def q_format_scoreboard(spark, sf_dir):
    s = q_relative_scores(spark, sf_dir)
    return s.select(
        "label",
        fmt.format_scoreboard_line("label", ["avg_time", "avg_ram_after", "avg_cpu"], [4, 2, 2]).alias("averages_line"),
        fmt.format_scoreboard_line("label", ["score_time", "score_ram", "score_cpu"], [1, 1, 1]).alias("scores_line"),
    )


# --------------------------------------------------------------------------------------
# 4. exact split, remainder, numbering, batches (documents)

_SQL_SPLIT = """
WITH k AS (SELECT doc_id, md5('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
r AS (SELECT doc_id, h, row_number() OVER (ORDER BY h, doc_id) AS rn, count(*) OVER () AS n FROM k)
"""


@register("split_exact", _SQL_SPLIT + "SELECT doc_id, rn <= round_even(0.8 * n, 0) AS in_train FROM r")
def q_split_exact(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id")
    return sp.split_exact(d, "doc_id", 0.8, 42)


@register("remainder", _SQL_SPLIT + "SELECT doc_id, lang FROM r JOIN documents USING (doc_id) WHERE rn > round_even(0.8 * n, 0)")
def q_remainder(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sp.train_eval(d, "doc_id", 0.8, 42)[1]  # the complement by flag: no anti join


@register(
    "number_runs",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS run_no FROM lineitem",
)
def q_number_runs(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").select(*fx.RUN_ORDER)
    return sp.number_runs(li, fx.RUN_ORDER)


@register(
    "make_batches",
    _SQL_SPLIT + """
, t AS (SELECT doc_id, rn FROM r WHERE rn <= round_even(0.8 * n, 0))
SELECT CAST((rn - 1) // 3 AS BIGINT) AS batch_id, list(doc_id ORDER BY rn) AS ids FROM t GROUP BY 1
""",
)
def q_make_batches(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id")
    train = sp.split_exact(d, "doc_id", 0.8, 42).filter("in_train")
    keyed = train.withColumn("_h", sp.split_key("doc_id", 42))
    return sp.make_batches(keyed, ["_h", "doc_id"], "doc_id", 3)


# --------------------------------------------------------------------------------------
# 5. token arrays (word vocabulary over documents)

from ..functions import arrays as ar  # noqa: E402
from ..operators import tokens as tk  # noqa: E402

_PAT = tk.WORD_PATTERN

_SQL_VOCAB = f"""
SELECT token, token_id FROM (
  SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS token_id
  FROM (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_PAT}')) AS token FROM documents) GROUP BY token)
)
UNION ALL SELECT '{tk.WORD_EOS}', {tk.WORD_EOS_ID} UNION ALL SELECT '{tk.WORD_UNK}', {tk.WORD_UNK_ID}
"""

_SQL_ENCODED = f"""
WITH v AS ({_SQL_VOCAB}),
t AS (SELECT doc_id, regexp_extract_all(text, '{_PAT}') AS toks FROM documents),
e AS (SELECT doc_id, unnest(toks[1:128]) AS token, unnest(generate_series(1, len(toks[1:128]))) AS pos FROM t),
g AS (SELECT e.doc_id, list(coalesce(v.token_id, {tk.WORD_UNK_ID}) ORDER BY pos) AS ids FROM e LEFT JOIN v USING (token) GROUP BY e.doc_id),
enc AS (
  SELECT t.doc_id, CAST(len(t.toks) AS INTEGER) AS n_tokens, coalesce(g.ids, []::INTEGER[]) AS ids,
         list_resize(coalesce(g.ids, []::INTEGER[]), 128, {tk.WORD_EOS_ID}) AS input_ids,
         list_resize(list_resize([]::INTEGER[], CAST(least(len(t.toks), 128) AS INTEGER), 1), 128, 0) AS attention_mask
  FROM t LEFT JOIN g USING (doc_id)
)
"""


def _ids_text(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c.cast("array<string>"), ",")


def _encoded(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    vocab = tk.build_vocabulary(d, "text")
    return tk.encode_words(d, "doc_id", "text", vocab)


@register("word_vocabulary", _SQL_VOCAB)
def q_word_vocabulary(spark, sf_dir):
    return tk.build_vocabulary(fx.table(spark, sf_dir, "documents"), "text")


@register(
    "encode_fixed",
    _SQL_ENCODED + """
SELECT doc_id, n_tokens, array_to_string(input_ids, ',') AS input_ids, array_to_string(attention_mask, ',') AS attention_mask,
       CAST(list_sum(attention_mask) AS INTEGER) AS mask_sum FROM enc
""",
)
def q_encode_fixed(spark, sf_dir):
    e = _encoded(spark, sf_dir)
    return e.select("doc_id", "n_tokens", _ids_text("input_ids").alias("input_ids"),
                    _ids_text("attention_mask").alias("attention_mask"),
                    ar.array_sum_long("attention_mask").cast("int").alias("mask_sum"))


@register(
    "causal_labels",
    _SQL_ENCODED + f"""
SELECT doc_id, array_to_string(list_transform(input_ids, lambda x: CASE WHEN x = {tk.WORD_EOS_ID} THEN {tk.LABEL_IGNORE} ELSE x END), ',') AS labels
FROM enc
""",
)
def q_causal_labels(spark, sf_dir):
    e = _encoded(spark, sf_dir)
    return e.select("doc_id", _ids_text(tk.causal_labels("input_ids", tk.WORD_EOS_ID)).alias("labels"))


# generated = all word ids of a document; prompt = its first 8; EOS = id 2 (the most frequent token)
GEN_PROMPT_LEN, GEN_EOS, GEN_MAX_NEW = 8, 2, 50

_SQL_FULL_IDS = f"""
WITH v AS ({_SQL_VOCAB}),
t AS (SELECT doc_id, regexp_extract_all(text, '{_PAT}') AS toks FROM documents),
e AS (SELECT doc_id, unnest(toks) AS token, unnest(generate_series(1, len(toks))) AS pos FROM t),
g AS (SELECT e.doc_id, list(coalesce(v.token_id, {tk.WORD_UNK_ID}) ORDER BY pos) AS ids FROM e LEFT JOIN v USING (token) GROUP BY e.doc_id),
enc AS (SELECT t.doc_id, coalesce(g.ids, []::INTEGER[]) AS ids FROM t LEFT JOIN g USING (doc_id))
"""


@register(
    "truncate_at_eos",
    _SQL_FULL_IDS + f"""
, n AS (SELECT doc_id, CASE WHEN len(ids) > {GEN_PROMPT_LEN} THEN ids[{GEN_PROMPT_LEN + 1}:] ELSE []::INTEGER[] END AS new_ids FROM enc),
c AS (SELECT doc_id, new_ids, coalesce(list_position(new_ids, {GEN_EOS}), 0) AS pos FROM n)
SELECT doc_id,
       array_to_string(new_ids[1:CASE WHEN pos > 0 THEN least({GEN_MAX_NEW}, pos) ELSE {GEN_MAX_NEW} END], ',') AS answer_ids,
       array_to_string(list_filter(new_ids[1:CASE WHEN pos > 0 THEN least({GEN_MAX_NEW}, pos) ELSE {GEN_MAX_NEW} END], lambda x: x <> {GEN_EOS}), ',') AS kept_ids,
       pos > 0 AND pos <= {GEN_MAX_NEW} AS hit_eos
FROM c
""",
)
def q_truncate_at_eos(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    vocab = tk.build_vocabulary(d, "text")
    e = tk.lookup_words(d, ["doc_id"], "text", vocab)  # every token of the whole text
    new = ar.new_tokens("ids", GEN_PROMPT_LEN)
    cut = ar.truncate_at_eos(new, GEN_EOS, GEN_MAX_NEW)
    pos = F.array_position(new, GEN_EOS)
    return e.select(
        "doc_id",
        F.array_join(cut.cast("array<string>"), ",").alias("answer_ids"),
        F.array_join(ar.strip_special_tokens(cut, [GEN_EOS]).cast("array<string>"), ",").alias("kept_ids"),
        ((pos > 0) & (pos <= GEN_MAX_NEW)).alias("hit_eos"),
    )


# --------------------------------------------------------------------------------------
# 6. device telemetry (counters, memory gauges, latest reading) from events

from ..operators import logs as lg  # noqa: E402
from ..operators import telemetry as tm  # noqa: E402
from ..operators import vectors as vc  # noqa: E402
from ..operators.ordered import ordered_scan  # noqa: E402

_SQL_COUNTERS = """
WITH b AS (
  SELECT user_id AS device_id, ts, event_id,
         CASE WHEN event_type = 'view' THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS busy,
         CASE WHEN event_type = 'view' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END AS idle
  FROM events),
c AS (
  SELECT device_id, ts, event_id,
         sum(busy) OVER w + sum(idle) OVER w AS total, sum(idle) OVER w AS idle_c
  FROM b WINDOW w AS (PARTITION BY device_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (
  SELECT *, total - lag(total) OVER w2 AS dt, idle_c - lag(idle_c) OVER w2 AS di
  FROM c WINDOW w2 AS (PARTITION BY device_id ORDER BY ts, event_id))
"""


@register(
    "counter_delta",
    _SQL_COUNTERS + """
SELECT device_id, ts, event_id,
       CASE WHEN dt >= 0 AND di >= 0 THEN dt END AS d_total,
       CASE WHEN dt >= 0 AND di >= 0 THEN di END AS d_idle,
       CASE WHEN dt > 0 AND di >= 0 THEN (100 * (dt - di)) // dt END AS cpu_pct
FROM d
""",
)
def q_counter_delta(spark, sf_dir):
    snaps = fx.counters_from_events(spark, sf_dir)
    out = tm.counter_delta(snaps, "device_id", "ts", "counters", tie_cols=["event_id"])
    return out.select("device_id", "ts", "event_id", "d_total", "d_idle", "cpu_pct")


@register(
    "memory_usage",
    f"""
SELECT event_id, user_id AS device_id, {fx.MEMORY_TOTAL_MB} - CAST(floor(value * 10) AS BIGINT) AS used_mb,
       100.0 * ({fx.MEMORY_TOTAL_MB} - CAST(floor(value * 10) AS BIGINT)) / {fx.MEMORY_TOTAL_MB}.0 AS used_pct,
       100.0 * CAST(floor(value * 10) AS BIGINT) / {fx.MEMORY_TOTAL_MB}.0 AS available_pct,
       printf('%dMB / %dMB (%.1f%%)', {fx.MEMORY_TOTAL_MB} - CAST(floor(value * 10) AS BIGINT), {fx.MEMORY_TOTAL_MB},
              100.0 * ({fx.MEMORY_TOTAL_MB} - CAST(floor(value * 10) AS BIGINT)) / {fx.MEMORY_TOTAL_MB}.0) AS used_text,
       printf('%dMB (%.1f%%)', CAST(floor(value * 10) AS BIGINT), 100.0 * CAST(floor(value * 10) AS BIGINT) / {fx.MEMORY_TOTAL_MB}.0) AS available_text
FROM events
""",
)
def q_memory_usage(spark, sf_dir):
    m = tm.memory_usage(fx.memory_from_events(spark, sf_dir))
    return m.select("event_id", "device_id", "used_mb", "used_pct", "available_pct", "used_text", "available_text")


@register(
    "latest_reading",
    """
SELECT user_id AS device_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value
FROM events GROUP BY user_id
""",
)
def q_latest_reading(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events").withColumnRenamed("user_id", "device_id")
    return tm.latest_reading(ev, "device_id", "ts", ["event_type", "value"])


@register(
    "event_gaps",
    """
SELECT event_id, user_id,
       CAST(sign(g) * ((abs(g) + 500) // 1000) AS DOUBLE) / 1000.0 AS gap_s
FROM (SELECT event_id, user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS g FROM events)
""",
)
def q_event_gaps(spark, sf_dir):
    from ..functions.metrics import elapsed_between

    ev = fx.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    s = ordered_scan(ev, ["user_id"], ["ts", "event_id"], carry=["ts"], cum_col=None)
    return s.select("event_id", "user_id", elapsed_between("prev_ts", "ts").alias("gap_s"))


# --------------------------------------------------------------------------------------
# 7. trainer log series, vectors


@register(
    "loss_series",
    """
WITH r AS (SELECT user_id AS run_id, event_id AS seq, event_type, value FROM events),
rec AS (
  SELECT run_id, seq, 'loss' AS kind, value AS loss FROM r WHERE event_type IN ('click', 'purchase')
  UNION ALL
  SELECT run_id, seq, 'eval_loss', CASE WHEN event_type = 'purchase' THEN value / 2 ELSE value END FROM r
  WHERE event_type IN ('view', 'purchase'))
SELECT run_id, kind, row_number() OVER (PARTITION BY run_id, kind ORDER BY seq) AS step, seq, loss FROM rec
""",
)
def q_loss_series(spark, sf_dir):
    return lg.loss_series(fx.logs_from_events(spark, sf_dir))


@register(
    "quantize_int8",
    """
WITH s AS (SELECT vec_id, embedding,
                  list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / 127.0 AS scale FROM embeddings)
SELECT vec_id, scale,
       array_to_string(CASE WHEN scale > 0
         THEN list_transform(embedding, lambda x: CAST(greatest(-127, least(127, round_even(CAST(x AS DOUBLE) / scale, 0))) AS INTEGER))
         ELSE list_transform(embedding, lambda x: 0) END, ',') AS q
FROM s
""",
)
def q_quantize_int8(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    q = vc.quantize_int8(e, "embedding")
    return q.select("vec_id", "scale", F.array_join(F.col("q").cast("array<string>"), ",").alias("q"))


@register(
    "vector_stats",
    """
SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax,
       round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS mean
FROM embeddings
""",
)
def q_vector_stats(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    s = vc.vector_stats(e, "embedding")
    return s.select("vec_id", "label", F.col("argmax").cast("int").alias("argmax"), F.round("mean", 6).alias("mean"))


# --------------------------------------------------------------------------------------
# 9. streams (driven to completion with availableNow triggers), sources and sinks

from ..operators.ordered import ordered_scan  # noqa: E402
from ..session import scratch_path  # noqa: E402
from ..sources import runs as sr  # noqa: E402
from ..streaming import cpu as scpu  # noqa: E402
from ..streaming import memory as smem  # noqa: E402

STREAM_SLICES = 2


def _run_available_now(df, out_path, ck_path, output_mode="append"):
    q = (df.writeStream.format("parquet").outputMode(output_mode).option("path", out_path)
         .option("checkpointLocation", ck_path).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _sliced_stream_run(spark, table, build, out_cols, name):
    """Stage ``table`` as event-id (time) order slices written one after another, each slice
    hash-partitioned by device so one device's rows of a slice are in one file; one
    ``availableNow`` run then reads them in file order, a slice per micro-batch, so state
    is carried across micro-batches. Returns the sink table. Rows without an event id are in the
    first slice."""
    base = scratch_path(spark, name)
    staged, src, out, ck = f"{base}/staged", f"{base}/in", f"{base}/out", f"{base}/ck"
    table.write.parquet(staged)
    staged_df = spark.read.parquet(staged)
    low, high = staged_df.agg(F.min("event_id"), F.max("event_id")).first()
    number = F.coalesce(F.floor((F.col("event_id") - F.lit(low)) * STREAM_SLICES / F.lit((high or 0) - (low or 0) + 1)), F.lit(0))
    n_files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in range(STREAM_SLICES):
        staged_df.filter(number == k).repartition(n_files, "device_id").write.mode("append").parquet(src)
    stream = spark.readStream.schema(staged_df.schema).option("maxFilesPerTrigger", n_files).parquet(src)
    _run_available_now(build(stream), out, ck)
    return spark.read.parquet(out).select(*out_cols)


DEVICE_ROWS = 100_000


def _device_stream_run(spark, table, build, out_cols, name):
    """Stage ``table`` in slices of at most ``DEVICE_ROWS`` rows a device, numbered in (time, event id)
    order without one task per device, and run the stream to the end of each slice, so that state is
    carried across at least ``STREAM_SLICES`` micro-batches and their number grows with the longest
    device. Returns the sink table."""
    base = scratch_path(spark, name)
    staged, src, out, ck = f"{base}/staged", f"{base}/in", f"{base}/out", f"{base}/ck"
    numbered = ordered_scan(table, ["device_id"], ["ts", "event_id"], cum_col="slice_row")
    last = numbered.agg(F.max("slice_row")).first()[0]
    empty, longest = last is None, int(last or 0) + 1
    rows = min(DEVICE_ROWS, -(-longest // STREAM_SLICES))
    sliced = numbered.select(*table.columns, F.floor(F.col("slice_row") / F.lit(rows)).cast("int").alias("slice"))
    sliced.write.partitionBy("slice").parquet(staged)
    n_files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in range(-(-longest // rows)):
        part = spark.read.schema(table.schema).parquet(f"{staged}/slice={k}") if not empty else table
        part.repartition(n_files, "device_id").write.mode("append").parquet(src)
        _run_available_now(build(spark.readStream.schema(table.schema).parquet(src)), out, ck)
    return spark.read.parquet(out).select(*out_cols)


@register("cpu_usage_stream", ORACLE_SQL["counter_delta"])
def q_cpu_usage_stream(spark, sf_dir):
    snaps = fx.counters_from_events(spark, sf_dir)
    build = lambda s: scpu.cpu_usage_stream(s, "device_id", "ts", "counters", tie_col="event_id")
    return _device_stream_run(spark, snaps, build, ["device_id", "ts", "event_id", "d_total", "d_idle", "cpu_pct"], "cpu-stream")


@register("memory_usage_stream", ORACLE_SQL["memory_usage"])
def q_memory_usage_stream(spark, sf_dir):
    gauges = fx.memory_from_events(spark, sf_dir)
    cols = ["event_id", "device_id", "used_mb", "used_pct", "available_pct", "used_text", "available_text"]
    return _sliced_stream_run(spark, gauges, lambda s: smem.memory_usage_stream(s), cols, "memory-stream")


@register("labelled_runs", _RUN_AVG_SQL)
def q_labelled_runs(spark, sf_dir):
    """Run tables of all labels, those of label R with the older ``latency`` header, united by name and
    averaged: one tagged scan, whatever the labels."""
    runs = fx.runs_from_lineitem(spark, sf_dir)
    old = F.col("label") == "R"
    united = runs.withColumns({sr.OLD_TIME_COLUMN: F.when(old, F.col("inference_time")),
                               "inference_time": F.when(~F.coalesce(old, F.lit(False)), F.col("inference_time"))})
    return _rounded(stats.mean_by_label(sr.normalise_time_column(united)))


@register("runs_csv_roundtrip", _RUN_AVG_SQL)
def q_runs_csv_roundtrip(spark, sf_dir):
    """Run rows written as CSV (one folder per label) and read back through partition discovery."""
    path = scratch_path(spark, "runs-csv")
    sr.write_runs(fx.runs_from_lineitem(spark, sf_dir).select("label", *sr.RUN_COLUMNS), path)
    return _rounded(stats.mean_by_label(sr.read_labelled_runs(spark, path)))


from ..sources import items as si  # noqa: E402
from ..sources import telemetry as st  # noqa: E402


@register("items_jsonl_roundtrip", ORACLE_SQL["build_prompt"])
def q_items_jsonl_roundtrip(spark, sf_dir):
    """Items written as JSON lines and read back with a fixed schema and required fields."""
    path = scratch_path(spark, "items-jsonl")
    it = fx.items_from_conversations(spark, sf_dir)
    it.select("conv_id", "turn", "scenario", "question").write.mode("overwrite").json(path)
    back = si.read_items(spark, path, fields=("conv_id", "turn", "scenario", "question"),
                         required=("scenario", "question"), multi_line=False)
    return back.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       tx.build_prompt("scenario", "question").alias("prompt"))


@register("recorded_counters", ORACLE_SQL["counter_delta"])
def q_recorded_counters(spark, sf_dir):
    """Counter snapshots written as recorder lines (``<ts> <device> cpu n1 n2 ...``), parsed back,
    then differenced."""
    path = scratch_path(spark, "cpu-lines")
    snaps = fx.counters_from_events(spark, sf_dir)
    lines = st.format_counter_lines(snaps.withColumn("device_id", F.concat_ws(":", "device_id", "event_id")))
    lines.write.mode("overwrite").text(path)
    parsed = st.read_counters(spark, path, ts_type="timestamp_ntz")
    ids = F.split("device_id", ":")
    parsed = parsed.select(ids.getItem(0).cast("long").alias("device_id"), "ts",
                           ids.getItem(1).cast("long").alias("event_id"), "counters")
    out = tm.counter_delta(parsed, "device_id", "ts", "counters", tie_cols=["event_id"])
    return out.select("device_id", "ts", "event_id", "d_total", "d_idle", "cpu_pct")


@register("recorded_memory", ORACLE_SQL["memory_usage"])
def q_recorded_memory(spark, sf_dir):
    """Memory gauges written as ``free -m`` recorder lines, parsed back (awk fields 2 and 7)."""
    path = scratch_path(spark, "mem-lines")
    g = fx.memory_from_events(spark, sf_dir)
    st.format_memory_lines(g.withColumn("device_id", F.concat_ws(":", "device_id", "event_id"))).write.mode("overwrite").text(path)
    parsed = st.read_memory(spark, path, ts_type="timestamp_ntz")
    ids = F.split("device_id", ":")
    parsed = parsed.select(ids.getItem(1).cast("long").alias("event_id"), ids.getItem(0).cast("long").alias("device_id"),
                           "ts", "total_mb", "available_mb")
    m = tm.memory_usage(parsed)
    return m.select("event_id", "device_id", "used_mb", "used_pct", "available_pct", "used_text", "available_text")


# --------------------------------------------------------------------------------------
# 10. whole chains and forms with NULLs (made in SQL from the tables, which hold none)

from ..functions import metrics as mt  # noqa: E402
from ..streaming import latest as sla  # noqa: E402
from ..streaming import runs as sru  # noqa: E402


@register("runs_csv_mixed_headers", _RUN_AVG_SQL)
def q_runs_csv_mixed_headers(spark, sf_dir):
    """Run rows in CSV files with two headers (older time name, other column order), read by name."""
    path = scratch_path(spark, "runs-mixed")
    runs = fx.runs_from_lineitem(spark, sf_dir).select("label", *sr.RUN_COLUMNS)
    old = F.col("label") == "R"
    sr.write_runs(runs.filter(~F.coalesce(old, F.lit(False))), path)
    back = runs.filter(old).withColumnRenamed("inference_time", sr.OLD_TIME_COLUMN)
    sr.write_runs(back.select("label", "cpu_usage", sr.OLD_TIME_COLUMN, "answer", "ram_after", "ram_before"), path, mode="append")
    return _rounded(stats.mean_by_label(sr.read_labelled_runs(spark, path)))


_SQL_NULL_EVENTS = """
WITH e AS (SELECT nullif(event_type, 'view') AS kind, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events)
"""


def _events_with_nulls(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    return ev.select(F.nullif("event_type", F.lit("view")).alias("kind"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"))


@register("cdf_null_groups", _SQL_NULL_EVENTS + """
SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY value) AS rank,
       row_number() OVER (PARTITION BY kind ORDER BY value) / count(*) OVER (PARTITION BY kind) AS cdf
FROM e WHERE value IS NOT NULL
""")
def q_cdf_null_groups(spark, sf_dir):
    return stats.empirical_cdf(_events_with_nulls(spark, sf_dir), "kind", "value")


@register("cdf_distinct_null_groups", _SQL_NULL_EVENTS + """
SELECT kind, value, count(*) AS n_rows, max(cd) AS cdf FROM (
  SELECT kind, value, cume_dist() OVER (PARTITION BY kind ORDER BY value) AS cd FROM e WHERE value IS NOT NULL) GROUP BY kind, value
""")
def q_cdf_distinct_null_groups(spark, sf_dir):
    return stats.empirical_cdf(_events_with_nulls(spark, sf_dir), "kind", "value", points="distinct")


_SKETCH_POINTS = 100


@register("sketch_cdf", f"""
SELECT event_type, CAST(i AS INTEGER) AS point, i / {_SKETCH_POINTS}.0::DOUBLE AS cdf, true AS within_bound
FROM (SELECT DISTINCT event_type FROM events), range(1, {_SKETCH_POINTS} + 1) r(i)
""")
def q_sketch_cdf(spark, sf_dir):
    """The sketched curve; each of its values is looked up in the exact curve, whose ranks must hold the
    point's within twice the stated error."""
    ev = fx.table(spark, sf_dir, "events")
    curve = stats.sketch_cdf(ev, "event_type", "value", points=_SKETCH_POINTS)
    exact = stats.empirical_cdf(ev, "event_type", "value", points="distinct")
    share = F.col("cdf") - F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy("event_type"))
    exact = exact.select("event_type", "value", F.col("cdf").alias("upto"), share.alias("below"))
    slack = 2 * stats.sketch_rank_error(800)
    good = (F.col("below") - slack <= F.col("cdf")) & (F.col("cdf") <= F.col("upto") + slack)
    return curve.join(exact, ["event_type", "value"], "left").select(
        "event_type", F.col("point").cast("int").alias("point"), "cdf", F.coalesce(good, F.lit(False)).alias("within_bound"))


@register("decimal_text", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%.2f', l_partkey / 8.0::DOUBLE) AS eighths,
       printf('%.1f', l_extendedprice / 1000) AS thousands, printf('%.0f', l_suppkey / 2.0::DOUBLE) AS halves,
       printf('%.3f', l_extendedprice * 1e20) AS large
FROM lineitem
""")
def q_decimal_text(spark, sf_dir):
    """Doubles printed with a fixed number of digits, decimal ties and whole numbers above 2^53 among them."""
    li = fx.table(spark, sf_dir, "lineitem")
    return li.select(*fx.RUN_ORDER, fmt.fixed(F.col("l_partkey") / F.lit(8.0), 2).alias("eighths"),
                     fmt.fixed(F.col("l_extendedprice") / 1000, 1).alias("thousands"),
                     fmt.fixed(F.col("l_suppkey") / F.lit(2.0), 0).alias("halves"),
                     fmt.fixed(F.col("l_extendedprice") * F.lit(1e20), 3).alias("large"))


@register("mean_with_nulls", _SQL_NULL_EVENTS + f"SELECT kind AS label, {_sql_mean('value')} AS avg_value FROM e GROUP BY kind")
def q_mean_with_nulls(spark, sf_dir):
    ev = _events_with_nulls(spark, sf_dir).withColumnRenamed("kind", "label")
    return stats.mean_by_label(ev, metrics={"avg_value": "value"})


@register("loss_series_null_run", """
WITH r AS (SELECT nullif(user_id, (SELECT min(user_id) FROM events)) AS run_id, event_id AS seq, event_type, value FROM events),
rec AS (
  SELECT run_id, seq, 'loss' AS kind, value AS loss FROM r WHERE event_type IN ('click', 'purchase')
  UNION ALL
  SELECT run_id, seq, 'eval_loss', CASE WHEN event_type = 'purchase' THEN value / 2 ELSE value END FROM r
  WHERE event_type IN ('view', 'purchase'))
SELECT run_id, kind, row_number() OVER (PARTITION BY run_id, kind ORDER BY seq) AS step, seq, loss FROM rec
""")
def q_loss_series_null_run(spark, sf_dir):
    logs = fx.logs_from_events(spark, sf_dir)
    least = logs.agg(F.min("run_id")).scalar()
    return lg.loss_series(logs.withColumn("run_id", F.nullif("run_id", least)))


_SQL_SCOREBOARD = ORACLE_SQL["format_scoreboard"]


def _sql_report(section: int, line: str) -> str:
    title, header = fmt.SCOREBOARD[section]
    titles = ", ".join(_sql_pad("'" + h + "'") for h in header)
    return f"""
  SELECT {section} AS section, 0 AS line_no, '{title}' AS line
  UNION ALL SELECT {section}, 1, concat_ws(' ', {titles})
  UNION ALL SELECT {section}, CAST(1 + row_number() OVER (ORDER BY label) AS INTEGER), {line} FROM ({_SQL_SCOREBOARD})"""


@register("scoreboard_report", f"SELECT * FROM ({_sql_report(0, 'averages_line')} UNION ALL {_sql_report(1, 'scores_line')})")
def q_scoreboard_report(spark, sf_dir):
    """Both printed tables with their titles."""
    s = q_format_scoreboard(spark, sf_dir)
    parts = [fmt.scoreboard_report(s, k, "label", line).withColumn("section", F.lit(k))
             for k, line in enumerate(("averages_line", "scores_line"))]
    return parts[0].unionByName(parts[1]).select("section", "line_no", "line")


@register("metric_units", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(floor(l_extendedprice * 1000 + 0.5) AS BIGINT) / 1048576.0 AS ram_mib,
       round(CAST(l_linenumber AS DOUBLE) * 0.25 + 1.5 - 1.5, 3) AS seconds
FROM lineitem
""")
def q_metric_units(spark, sf_dir):
    """Resident bytes in MiB and the seconds between two clock readings."""
    li = fx.table(spark, sf_dir, "lineitem")
    size = F.floor(F.col("l_extendedprice") * 1000 + 0.5).cast("long")
    end = F.col("l_linenumber").cast("double") * 0.25 + 1.5
    return li.select(*fx.RUN_ORDER, mt.bytes_to_mib(size).alias("ram_mib"), mt.elapsed_seconds(F.lit(1.5), end).alias("seconds"))


@register("append_token", _SQL_FULL_IDS + "SELECT doc_id, array_to_string(list_append(ids, len(ids)::INTEGER), ',') AS ids FROM enc")
def q_append_token(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    e = tk.lookup_words(d, ["doc_id"], "text", tk.build_vocabulary(d, "text"))
    return e.select("doc_id", _ids_text(ar.append_token("ids", F.size("ids"))).alias("ids"))


@register("training_table", _SQL_ENCODED.replace("WITH v", "WITH k AS (SELECT doc_id, md5('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents), "
          "r AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS rn, count(*) OVER () AS n FROM k), v", 1) + f"""
SELECT doc_id, rn <= round_even(0.8 * n, 0) AS in_train, array_to_string(input_ids, ',') AS input_ids,
       array_to_string(attention_mask, ',') AS attention_mask,
       array_to_string(list_transform(input_ids, lambda x: CASE WHEN x = {tk.WORD_EOS_ID} THEN {tk.LABEL_IGNORE} ELSE x END), ',') AS labels
FROM enc JOIN r USING (doc_id)
""")
def q_training_table(spark, sf_dir):
    """Texts -> exact split -> encoded ids, mask and labels of both parts."""
    d = fx.table(spark, sf_dir, "documents")
    t = tk.training_table(d, "doc_id", "text", tk.build_vocabulary(d, "text"))
    return t.select("doc_id", "in_train", *[_ids_text(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@register("model_inputs", _SQL_ENCODED.replace("WITH v", "WITH k AS (SELECT doc_id, md5('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents), "
          "r AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS rn, count(*) OVER () AS n FROM k), v", 1) + """
SELECT array_to_string(input_ids, ',') AS input_ids, array_to_string(attention_mask, ',') AS attention_mask
FROM enc JOIN r USING (doc_id) WHERE rn <= round_even(0.8 * n, 0)
""")
def q_model_inputs(spark, sf_dir):
    """The training part of the training table, model input columns only."""
    d = fx.table(spark, sf_dir, "documents")
    t = tk.training_table(d, "doc_id", "text", tk.build_vocabulary(d, "text"))
    return tk.select_model_inputs(t.filter("in_train")).select(*[_ids_text(c).alias(c) for c in ("input_ids", "attention_mask")])


ARRAY_BITS = 10


@register("items_json_array", ORACLE_SQL["build_prompt"])
def q_items_json_array(spark, sf_dir):
    """Items written as JSON arrays of at most 2^ARRAY_BITS items, a file each, and read back in that
    form: an array takes neighbouring rows of an input split, so that its length is bounded whatever a
    conversation's, and the number of files grows with the table."""
    path = scratch_path(spark, "items-array")
    it = fx.items_from_conversations(spark, sf_dir)
    fields = ("conv_id", "turn", "scenario", "question")
    one = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in fields]), {"ignoreNullFields": "false"})
    numbered = it.withColumn("b", F.shiftright(F.monotonically_increasing_id(), ARRAY_BITS))
    arrays = numbered.groupBy("b").agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)  # a file holds one array
    back = si.read_items(spark, path, fields=fields, required=("scenario", "question"))
    return back.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       tx.build_prompt("scenario", "question").alias("prompt"))


@register("csv_quoted_breaks", """
SELECT doc_id, coalesce(nullif(lang, ''), '-') AS lang, md5(text) AS md5, CAST(length(text) AS BIGINT) AS n_chars FROM documents
""")
def q_csv_quoted_breaks(spark, sf_dir):
    """Texts with line breaks, quotes and commas as CSV, a file for each input split, read back by as many tasks
    as the files have splits."""
    from ..sources import split_csv

    path = scratch_path(spark, "quoted-csv")
    docs = fx.table(spark, sf_dir, "documents")
    sr.write_runs(docs.select("text", "doc_id", "lang"), path)
    back = split_csv.read_csv(spark, path)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("-")).alias("lang"),
                       F.md5("text").alias("md5"), F.length("text").cast("long").alias("n_chars"))


@register("items_split_array", """
SELECT doc_id, md5('Scenario: ' || lang || chr(10) || 'Question: ' || text || chr(10) || 'Answer:') AS prompt_md5 FROM documents
""")
def q_items_split_array(spark, sf_dir):
    """One JSON array for each input split, read back by as many tasks as the files have splits."""
    path = scratch_path(spark, "items-split")
    docs = fx.table(spark, sf_dir, "documents")
    si.write_items(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("scenario"),
                               F.col("text").alias("question")), path)
    back = si.read_items(spark, path, fields=("doc_id", "scenario", "question"), required=("scenario", "question"))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(tx.build_prompt("scenario", "question")).alias("prompt_md5"))


FRAME_FILES = 500  # that a task writes


@register("read_frames", """
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(strlen(html) AS BIGINT) AS length, md5(html) AS md5 FROM pages
""")
def q_read_frames(spark, sf_dir):
    """Binary files read as frames: each page's bytes in a file of its own, after a line with its number; a folder
    holds the files of a writing task."""
    from ..sources import frames as sfr

    path = scratch_path(spark, "frames")
    pages = fx.table(spark, sf_dir, "pages").select("page_id", "html")
    tasks = max(1, -(-pages.count() // FRAME_FILES))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    files = pages.select(F.encode(F.concat(number, F.lit("\n"), F.coalesce("html", F.lit(""))), "UTF-8").alias("content"))
    sfr.write_frames(files.repartition(tasks).sortWithinPartitions("content"), path)
    frames = sfr.read_frames(spark, path).coalesce(tasks).withColumn(
        "number", F.expr(r"substring_index(CAST(substring(content, 1, 21) AS STRING), '\n', 1)"))
    parts = frames.select("content", "number", (F.length("number") + 1).alias("start"), F.col("length").cast("int").alias("length"))
    return parts.select(F.col("number").try_cast("long").alias("page_id"), (F.col("length") - F.col("start") - 1).cast("long").alias("length"),
                        F.md5(F.expr("substring(content, start + 1, length - start - 1)")).alias("md5"))


@register("latest_reading_stream", ORACLE_SQL["latest_reading"])
def q_latest_reading_stream(spark, sf_dir):
    """The latest reading per device kept by a stream over two micro-batches."""
    base = scratch_path(spark, "latest")
    ev = fx.table(spark, sf_dir, "events").withColumnRenamed("user_id", "device_id")
    for k in range(2):
        ev.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == k).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(ev.schema).parquet(f"{base}/in")
        latest = sla.latest_reading_stream(stream, "device_id", "ts", ["event_type", "value"])
        sla.write_latest(latest, f"{base}/table", f"{base}/ck", "device_id", "ts").trigger(availableNow=True).start().awaitTermination()
    return sla.read_latest(spark, f"{base}/table")


@register("loss_records_stream", """
WITH r AS (SELECT user_id AS run_id, event_id AS seq, event_type, value FROM events)
SELECT run_id, seq, 'loss' AS kind, value AS loss FROM r WHERE event_type IN ('click', 'purchase')
UNION ALL
SELECT run_id, seq, 'eval_loss', CASE WHEN event_type = 'purchase' THEN value / 2 ELSE value END FROM r
WHERE event_type IN ('view', 'purchase')
""")
def q_loss_records_stream(spark, sf_dir):
    base = scratch_path(spark, "loss-stream")
    fx.logs_from_events(spark, sf_dir).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("run_id bigint, seq bigint, logs map<string,double>").parquet(f"{base}/in")
    _run_available_now(sru.loss_records_stream(stream), f"{base}/out", f"{base}/ck")
    return spark.read.parquet(f"{base}/out").select("run_id", "seq", "kind", "loss")


@register("runs_csv_stream", _RUN_AVG_SQL)
def q_runs_csv_stream(spark, sf_dir):
    """Run rows appended to a CSV sink as they arrive, read back and averaged."""
    base = scratch_path(spark, "runs-stream")
    runs = fx.runs_from_lineitem(spark, sf_dir).select("label", *sr.RUN_COLUMNS)
    runs.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(runs.schema).parquet(f"{base}/in")
    sru.write_runs_stream(stream, f"{base}/out", f"{base}/ck").trigger(availableNow=True).start().awaitTermination()
    return _rounded(stats.mean_by_label(sr.read_runs(spark, f"{base}/out")))


# --------------------------------------------------------------------------------------
# 10. streams with ordered state, packed frames

from ..sources import frames as sfr  # noqa: E402
from ..streaming import deltas as sde  # noqa: E402
from ..streaming import hooks as sho  # noqa: E402
from ..streaming import series as sse  # noqa: E402

ARRIVALS = 3


def _arrivals(spark, rows, position, source, step):
    """Deal ``rows`` to ``ARRIVALS`` arrivals by equal ranges of ``position`` (rows without one come first),
    append them to the folder ``source`` one after another and call ``step`` after each with a stream of it."""
    staged = f"{source}-staged"
    rows.withColumn("_position", position.cast("double")).write.parquet(staged)
    table = spark.read.parquet(staged)
    low, high = table.agg(F.min("_position"), F.max("_position")).first()
    width = ((high or 0.0) - (low or 0.0)) / ARRIVALS or 1.0
    number = F.coalesce(F.least(F.floor((F.col("_position") - F.lit(low)) / F.lit(width)), F.lit(ARRIVALS - 1)), F.lit(0))
    for k in range(ARRIVALS):
        table.filter(number == k).drop("_position").write.mode("append").parquet(source)
        query = step(spark.readStream.schema(rows.schema).parquet(source)).trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception() is not None:
            raise RuntimeError(str(query.exception()))


@register("counter_delta_stream", ORACLE_SQL["counter_delta"])
def q_counter_delta_stream(spark, sf_dir):
    """Counter deltas of a stream that is stopped and started again after each arrival; a device's rows of
    a micro-batch are spread over tasks."""
    base = scratch_path(spark, "delta-stream")
    _arrivals(spark, fx.counters_from_events(spark, sf_dir), F.unix_micros(F.col("ts").cast("timestamp")), f"{base}/in",
              lambda s: sde.write_counter_deltas(s, f"{base}/table", f"{base}/ck", tie_cols=["event_id"]))
    return sde.read_counter_deltas(spark, f"{base}/table").select("device_id", "ts", "event_id", "d_total", "d_idle", "cpu_pct")


LOG_DELAY = 500


@register("loss_series_stream", ORACLE_SQL["loss_series"])
def q_loss_series_stream(spark, sf_dir):
    """Step numbers given while the records arrive, up to ``LOG_DELAY`` numbers out of order, by a stream
    that is stopped and started again after each arrival."""
    base = scratch_path(spark, "series-stream")
    arrival = F.col("seq") + F.pmod(F.xxhash64("seq"), F.lit(LOG_DELAY))
    _arrivals(spark, fx.logs_from_events(spark, sf_dir), arrival, f"{base}/in",
              lambda s: sse.write_loss_series(s, f"{base}/table", f"{base}/ck", delay=LOG_DELAY))
    return sse.read_loss_series(spark, f"{base}/table").drop("late")


@register("log_hook_stream", """
WITH r AS (SELECT event_type, value FROM events),
rec AS (
  SELECT 'loss' AS kind, value AS loss FROM r WHERE event_type IN ('click', 'purchase')
  UNION ALL
  SELECT 'eval_loss', CASE WHEN event_type = 'purchase' THEN value / 2 ELSE value END FROM r
  WHERE event_type IN ('view', 'purchase'))
SELECT kind, count(*) AS records, count(*) AS hooked, min(loss) AS least, max(loss) AS largest FROM rec GROUP BY kind
""")
def q_log_hook_stream(spark, sf_dir):
    """A hook that reports each micro-batch's loss range under its batch id, against the ledger's counts."""
    base = scratch_path(spark, "hook-stream")

    def report(records, batch_id):
        records.groupBy("kind").agg(F.count(F.lit(1)).alias("hooked"), F.min("loss").alias("least"),
                                    F.max("loss").alias("largest")).write.mode("overwrite").parquet(f"{base}/report/batch={batch_id}")

    _arrivals(spark, fx.logs_from_events(spark, sf_dir), F.col("seq"), f"{base}/in",
              lambda s: sho.write_log_hook(s, report, f"{base}/ledger", f"{base}/ck"))
    entered = sho.read_ledger(spark, f"{base}/ledger").groupBy("kind").agg(F.sum("records").alias("records"))
    hooked = spark.read.parquet(f"{base}/report").groupBy("kind").agg(
        F.sum("hooked").alias("hooked"), F.min("least").alias("least"), F.max("largest").alias("largest"))
    return entered.join(hooked, "kind", "full").select("kind", "records", "hooked", "least", "largest")


def _packed_pages(spark, sf_dir, path):
    """The pages as frames, packed at ``path``."""
    html = F.encode("html", "UTF-8")
    pages = fx.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("path"),
        F.timestamp_seconds(F.lit(0)).alias("modificationTime"), F.octet_length(html).cast("long").alias("length"),
        html.alias("content"))
    sfr.pack_frames(pages, path)


def _frame_digests(frames):
    return frames.select(F.expr("CAST(substring(path, 6) AS BIGINT)").alias("page_id"), "length", F.md5("content").alias("md5"))


@register("packed_frames", ORACLE_SQL["read_frames"])
def q_packed_frames(spark, sf_dir):
    """Frames packed by bytes and read back."""
    path = f"{scratch_path(spark, 'packed-frames')}/packed"
    _packed_pages(spark, sf_dir, path)
    return _frame_digests(sfr.read_packed_frames(spark, path))


@register("packed_frames_stream", ORACLE_SQL["read_frames"])
def q_packed_frames_stream(spark, sf_dir):
    """Packed frames read as a stream of micro-batches bounded by bytes."""
    base = scratch_path(spark, "packed-frames")
    _packed_pages(spark, sf_dir, f"{base}/packed")
    stream = sfr.read_packed_frames(spark, f"{base}/packed", stream=True, maxBytesPerTrigger=1 << 30)
    _run_available_now(_frame_digests(stream), f"{base}/out", f"{base}/ck")
    return spark.read.parquet(f"{base}/out")
