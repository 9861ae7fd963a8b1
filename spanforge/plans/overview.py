"""R1 as one report: what the overview shows, section by section, in one table.

Rows are (section, place, name, value, text): numbers in value, what is shown as words in text. A section whose input is missing
is left out, but for what a reader must know (``diagnostics``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import columns as c
from spanforge.operators import intervals as iv
from spanforge.operators.ranks import ranked
from spanforge.plans import reports as rp

LATENCY_PERCENTS = (50.0, 75.0, 90.0, 99.0, 99.9)
LATENCIES = ("host", "device", "communication", "total")
LOW_PRECISION_PERCENT = 10
_NO_DEVICE = "No device events were collected: the job did not run on a device while the trace was taken, or not all of it was kept."


def latency_table(requests: DataFrame, order: str = "request_id") -> DataFrame:
    """requests(order, total, device, communication) -> (place, label, host, device, communication, total): the means, then the requests at the
    percentiles of the total, with their own parts. The host's part is what the others leave."""
    parts = requests.select(order, (F.col("total") - F.col("device") - F.col("communication")).alias("host"), "device", "communication", "total")
    mean = parts.agg(F.count("*").alias("_n"), *(F.avg(x).alias(x) for x in LATENCIES)).where("_n > 0").select(F.lit(0).alias("place"), F.lit("Avg").alias("label"), *LATENCIES)
    at = [F.struct(F.lit(k + 1).alias("place"), F.lit(f"{p:.1f}%").alias("label"), F.least(F.floor(F.lit(p) * F.col("_n") / 100), F.col("_n") - 1).alias("i")) for k, p in enumerate(LATENCY_PERCENTS)]
    rows = ranked(parts, ["total", order], (), "_i", "_n").select(*LATENCIES, "_i", F.explode(F.array(*at)).alias("at")).where("at.i = _i")
    return mean.unionByName(rows.select("at.place", "at.label", *(F.col(x).cast("double").alias(x) for x in LATENCIES)))


def op_shares(host_ops: DataFrame, device_ops: DataFrame) -> DataFrame:
    """host_ops and device_ops(occurrences, self_time, category, eager) -> one row of percentages, null where there is nothing to divide by: ops on
    either side, and the eager part of each side's time. IDLE counts as an op without time."""
    busy = F.when(F.col("category") != "IDLE", F.col("self_time")).otherwise(0)
    side = lambda df, x: df.agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias(f"{x}_n"), F.coalesce(F.sum(busy), F.lit(0)).alias(f"{x}_time"), F.coalesce(F.sum(F.when(F.col("eager"), busy)), F.lit(0)).alias(f"{x}_eager"))
    both = side(host_ops, "host").crossJoin(side(device_ops, "device"))
    share = lambda a, b: F.when(b != 0, 100 * a / b)
    every = F.col("host_n") + F.col("device_n")
    return both.select(
        share(F.col("host_n"), every).alias("host_tf_op_percent"), share(F.col("device_n"), every).alias("device_tf_op_percent"),
        share(F.col("host_eager"), F.col("host_time")).alias("host_op_time_eager_percent"), share(F.col("device_eager"), F.col("device_time")).alias("device_op_time_eager_percent"),
    )


def _section(df: DataFrame, section: str, place: Column, name: Column, value: Column, text: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), place.cast("bigint").alias("place"), name.cast("string").alias("name"), value.cast("double").alias("value"), text.cast("string").alias("text"))


def _unpivot(df: DataFrame, section: str, names: list[str], show: Column | None = None) -> DataFrame:
    """One-row df as a row for each of its columns; show makes the text of the column value."""
    rows = df.select(F.posexplode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))).alias("place", "x")).select("place", "x.*")
    return _section(rows, section, F.col("place"), F.col("name"), F.col("value"), F.lit(None) if show is None else show)


def overview_report(
    spans: DataFrame, steps: DataFrame, off_duty: Column, framework_ops: DataFrame, host_ops: DataFrame, device_ops: DataFrame, verdict: DataFrame,
    precision: DataFrame | None = None, requests: DataFrame | None = None, top: int = 10,
) -> DataFrame:
    """Environment (A38), properties (A38 shares, A18 duty, A19 precision), top_ops (W1), recommendation (R7's verdict), latency (A30, only of requests)
    and diagnostics, ordered by section and place. precision(compute_16, compute_32) is one row; requests is that of latency_table, in us and shown in ms."""
    shown = F.when(F.col("value") >= 0, c.percent_text(F.col("value"))).otherwise("unknown")
    environment = rp.run_environment(spans)
    parts = [_unpivot(environment, "environment", environment.columns)]
    shares = op_shares(host_ops, device_ops)
    busy = iv.duty_cycle(spans, ["plane_id"], off_duty).agg(F.sum("busy").alias("b"), F.sum("idle").alias("i"))
    shares = shares.crossJoin(busy.select(F.when(F.col("b") + F.col("i") != 0, 100 * F.col("b") / (F.col("b") + F.col("i"))).alias("device_duty_cycle_percent")))
    if precision is not None:
        part = lambda x: F.when(F.col("compute_16") + F.col("compute_32") != 0, 100 * F.col(x) / (F.col("compute_16") + F.col("compute_32")))
        shares = shares.crossJoin(precision.select(part("compute_16").alias("device_compute_16bit_percent"), part("compute_32").alias("device_compute_32bit_percent")))
    parts.append(_unpivot(shares, "properties", shares.columns, shown))
    ops = rp.overview_top_ops(framework_ops, top)
    parts.append(_section(ops, "top_ops", F.col("rank"), F.col("op_name"), F.col("fraction"), F.col("op_type")))
    advice = rp.overview_recommendation(verdict).select(F.posexplode(F.array(
        F.struct(F.lit("bottleneck").alias("name"), F.col("bottleneck").alias("text")), F.struct(F.lit("statement").alias("name"), F.col("statement").alias("text")),
        F.struct(F.lit("tools").alias("name"), F.array_join("tools", ", ").alias("text")),
    )).alias("place", "x"))
    parts.append(_section(advice, "recommendation", F.col("place"), F.col("x.name"), F.lit(None), F.col("x.text")))
    if precision is not None:
        share = 100 * c.safe_divide(F.col("compute_16"), F.col("compute_16") + F.col("compute_32"))
        low = precision.where((F.col("compute_16") + F.col("compute_32") > 0) & (share < LOW_PRECISION_PERCENT))
        hint = F.concat(F.lit("Only "), c.percent_text(share), F.lit(" of the device's compute time is in 16 bits; more ops in 16 bits would be faster where the accuracy allows."))
        parts.append(_section(low, "recommendation", F.lit(3), F.lit("precision"), share, hint))
    if requests is not None:
        table = latency_table(requests)
        each = table.select("place", "label", F.posexplode(F.array(*(F.col(x) / 1000 for x in LATENCIES))).alias("k", "ms"), F.array(*(F.lit(x) for x in LATENCIES)).alias("names"))
        parts.append(_section(each, "latency", F.col("place") * len(LATENCIES) + F.col("k"), F.concat_ws(" ", F.get("names", F.col("k")), "label"), F.col("ms"), F.lit(None)))
    told = rp.overview_diagnostics(spans, steps)
    parts.append(_section(told, "diagnostics", F.lit(1), F.col("level"), F.lit(None), F.col("text")))
    device = spans.agg(F.count_if(F.col("plane").startswith("/device:")).alias("n")).where("n = 0")
    parts.append(_section(device, "diagnostics", F.lit(0), F.lit("error"), F.lit(None), F.lit(_NO_DEVICE)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("section", "place", "text")
