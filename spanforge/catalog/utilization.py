"""Queries of hardware utilization per kernel and in summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import counters as ct
from spanforge.operators import utilization as ut
from spanforge.plans import suggestions as sg

from .registry import query
from .runtime import _FRACTION
from .tables import _BREAKDOWN, breakdown

_FILLED = """sums AS (SELECT device_id, line_id, counter_id, CAST(sum(value) AS BIGINT) AS value FROM counters GROUP BY ALL),
nominal AS (SELECT device_id, line_id, CAST(floor(max(dur) / 1000.0 * 940) AS BIGINT) AS nominal FROM counters GROUP BY ALL),
filled AS (SELECT coalesce(s.device_id, n.device_id) AS device_id, coalesce(s.line_id, n.line_id) AS line_id, coalesce(s.counter_id, n.c) AS counter_id, CASE WHEN n.c IS NOT NULL AND nominal > 0 AND coalesce(value, 0) = 0 THEN nominal ELSE value END AS value
  FROM sums s FULL JOIN (FROM nominal, (VALUES (3), (900)) v(c) WHERE nominal > 0) n ON s.device_id = n.device_id AND s.line_id = n.line_id AND s.counter_id = n.c)"""


@query("a23_cycles_from_time", "SELECT * FROM filled", _FILLED)
def cycles(t):
    durations = t.counters.groupBy("device_id", "line_id").agg((F.max("dur") / 1000.0).alias("duration_us"))
    return ut.with_cycle_counts(ct.counter_values(t.counters, "sum"), durations, 940.0, [3, 900])


#: Counters as metrics: some are the precisions of the matrix units, some memory, some numbered units.
_NAMES = "CASE c % 9 WHEN 0 THEN 'Avg MXU Busy' WHEN 1 THEN 'MXU BF16' WHEN 2 THEN 'MXU I8' WHEN 3 THEN 'HBM Rd+Wr' WHEN 4 THEN 'HBM Rd+Wr (per chip)' WHEN 5 THEN 'Vector ALUs' WHEN 6 THEN 'Scalar Unit' ELSE concat('MXU', c % 4) END"
_RATED = f"rated AS (SELECT device_id, line_id AS kernel, {_NAMES} AS metric, value AS achieved, CASE WHEN c % 5 = 0 THEN 0 ELSE value + c END AS peak FROM (SELECT *, CAST(counter_id AS INTEGER) AS c FROM (SELECT device_id, line_id, counter_id, CAST(sum(value) AS BIGINT) AS value FROM counters GROUP BY ALL)))"


def rated(t):
    rows = ct.counter_values(t.counters, "sum").withColumn("c", F.col("counter_id").cast("int"))
    return rows.select("device_id", F.col("line_id").alias("kernel"), F.expr(_NAMES).alias("metric"), F.col("value").alias("achieved"), F.when(F.col("c") % 5 == 0, 0).otherwise(F.col("value") + F.col("c")).alias("peak"))


@query(
    "a23_kernel_report",
    """SELECT device_id, kernel, mxu_utilization, mxu_utilization > 100 AS mxu_is_anomaly, bf16, coalesce(hbm, -1) AS hbm, vector FROM (SELECT device_id, kernel, round(10000.0 * sum(achieved) FILTER (metric = 'Avg MXU Busy') / sum(peak) FILTER (metric = 'Avg MXU Busy')) / 100 AS mxu_utilization,
  round(10000.0 * sum(achieved) FILTER (metric = 'MXU BF16') / sum(achieved) FILTER (metric IN ('MXU BF16', 'MXU I8'))) / 100 AS bf16, round(10000.0 * sum(achieved) FILTER (metric LIKE 'HBM Rd+Wr%' AND peak > 0) / sum(peak) FILTER (metric LIKE 'HBM Rd+Wr%' AND peak > 0)) / 100 AS hbm,
  round(10000.0 * sum(achieved) FILTER (metric = 'Vector ALUs' AND peak > 0) / sum(peak) FILTER (metric = 'Vector ALUs' AND peak > 0)) / 100 AS vector FROM rated GROUP BY ALL)""",
    _RATED,
)
def kernel_report(t):
    out = ut.kernel_report(rated(t), ["device_id", "kernel"])
    other = F.col("other_metrics")
    return out.select("device_id", "kernel", "mxu_utilization", "mxu_is_anomaly", F.col("mxu_cycles_breakdown")["BF16"].alias("bf16"), F.coalesce(F.try_element_at(other, F.lit(ut.HBM_NAME)), F.lit(-1.0)).alias("hbm"), F.try_element_at(other, F.lit("Vector ALUs")).alias("vector"))


@query(
    "a24_utilization_report",
    """SELECT name, percent FROM named UNION ALL SELECT 'hbm_bandwidth_utilization_percent', round(avg(100.0 * achieved / peak), 2) FROM rated WHERE peak > 0 AND metric LIKE 'HBM Rd+Wr%'
  UNION ALL SELECT 'vector_alu_utilization_percent', percent FROM named WHERE name = 'Vector ALUs' UNION ALL SELECT 'scalar_unit_utilization_percent', percent FROM named WHERE name = 'Scalar Unit'
  UNION ALL SELECT 'mxu_utilization_percent', percent FROM named WHERE name = 'Avg MXU Busy' UNION ALL SELECT 'idleness_percent', greatest(round(100 - max(percent), 2), 0) FROM named WHERE regexp_matches(name, '^MXU[0-9]+$')""",
    _RATED + ", named AS (SELECT metric AS name, round(avg(100.0 * achieved / peak) FILTER (peak > 0), 2) AS percent FROM rated GROUP BY metric HAVING count(*) FILTER (peak > 0) > 0)",
)
def utilization_report(t):
    return ut.utilization_report(rated(t).withColumnRenamed("metric", "name"))


_SUGGEST = (
    _BREAKDOWN
    + ", "
    + _FRACTION
    + """, shared AS (SELECT avg(v) AS v, avg(c) AS c FROM (SELECT step, sum(CASE WHEN category = 'view' THEN time ELSE 0 END) / sum(time) AS v, sum(CASE WHEN category IN ('click', 'purchase') THEN time ELSE 0 END) / sum(time) AS c FROM breakdown GROUP BY step HAVING sum(time) > 0)),
perhost AS (SELECT plane_id AS host, avg(fraction) * 100 AS p FROM fraction GROUP BY plane_id),
away AS (SELECT host, p, abs(p - (SELECT p FROM (SELECT p, row_number() OVER (ORDER BY p, host) AS r FROM perhost) WHERE r = (SELECT count(*) // 2 + 1 FROM perhost))) AS d FROM perhost),
odd AS (SELECT host, d, (SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d, host) AS r FROM away) WHERE r = (SELECT count(*) // 2 + 1 FROM away)) AS mad FROM away),
factrow AS (SELECT (SELECT avg(fraction) * 100 FROM fraction) AS barrier_percent, (SELECT count(*) FROM odd WHERE CASE WHEN mad > 0 THEN 0.6745 * d / greatest(mad, 0.1) > 3.5 ELSE d > 1e-10 END AND (SELECT count(*) FROM perhost) >= 3) AS straggler_hosts, 100 * v AS input_percent, 100 * c AS collective_percent FROM shared)"""
)


def _suggest_input(t):
    views = t.spans.where("name = 'view'").withColumn("step", F.expr("begin DIV 86400000000"))
    return views, t.steps, "plane_id", breakdown(t), {"input": ["view"], "collective": ["click", "purchase"]}


@query("r19_facts_of_trace", "SELECT round(barrier_percent, 6) AS barrier_percent, straggler_hosts, round(input_percent, 6) AS input_percent, round(collective_percent, 6) AS collective_percent FROM factrow", _SUGGEST)
def suggestion_facts(t):
    out = sg.suggestion_facts(*_suggest_input(t))
    return out.select(*(F.round(x, 6).alias(x) if x.endswith("percent") else x for x in out.columns))


@query(
    "r19_suggest",
    """SELECT v.rule FROM factrow, LATERAL (VALUES ('input_bound', input_percent > 10), ('collective_bound', collective_percent > 20), ('barrier_cores', barrier_percent > 3), ('stragglers', straggler_hosts > 0)) v(rule, holds) WHERE v.holds""",
    _SUGGEST,
)
def suggest(t):
    return sg.suggest(*_suggest_input(t)).select("rule")
