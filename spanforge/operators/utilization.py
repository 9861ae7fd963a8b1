"""Hardware utilization per kernel and in summary: A23 with cycles from time, A24 with its averages and the idleness rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: names of metrics
MXU_BUSY, MXU_IDLE = "Avg MXU Busy", "No MXU Busy"
PRECISIONS = {"BF16": "MXU BF16", "FP8": "MXU E4M3 + E5M2", "Int4": "MXU I4", "Int8": "MXU I8"}
HBM, HBM_NAME = "HBM Rd+Wr", "HBM Bandwidth Utilization"
SUMMARY = {
    "ici_read_utilization_percent": "ICI (Read)", "ici_write_utilization_percent": "ICI (Write)", "vector_alu_utilization_percent": "Vector ALUs",
    "scalar_unit_utilization_percent": "Scalar Unit", "vmem_cmem_stores_utilization_percent": "Vmem/Cmem Stores",
    "vmem_loads_utilization_percent": "Vmem Loads", "cmem_loads_utilization_percent": "Cmem Loads",
}
_NUMBERED = r"^(XLU|MXU)\d+$"


def with_cycle_counts(sums: DataFrame, durations: DataFrame, mhz: float, cycle_counters: Sequence[int], duration_us: float = 0.0, force: bool = False) -> DataFrame:
    """sums(device_id, line_id, counter_id, value) where the cycle counters of a kernel that has counters, if they are missing or zero or all of
    them with force, are what its time gives at the device's frequency. durations(device_id, line_id, duration_us); duration_us overrides them."""
    keys = ["device_id", "line_id"]
    time = durations.select(*keys, "duration_us") if duration_us <= 0 else sums.select(*keys).distinct().withColumn("duration_us", F.lit(float(duration_us)))
    nominal = sums.select(*keys).distinct().join(time, keys).select(*keys, F.floor(F.col("duration_us") * mhz).cast("bigint").alias("nominal")).where("nominal > 0")
    filled = nominal.select(*keys, F.explode(F.array(*(F.lit(x).cast("bigint") for x in cycle_counters))).alias("counter_id"), "nominal")
    both = sums.join(filled, [*keys, "counter_id"], "full")
    value = F.when(F.col("nominal").isNotNull() & (F.lit(force) | (F.coalesce("value", F.lit(0)) == 0)), F.col("nominal")).otherwise(F.col("value"))
    return both.select(*keys, "counter_id", value.alias("value"))


def _percent(value: Column, total: Column) -> Column:
    return F.round(value / total * 10_000) / 100


def kernel_report(utilization: DataFrame, by: Sequence[str]) -> DataFrame:
    """utilization(by..., metric, achieved, peak) -> per kernel (by): use of the matrix units and whether it is above their peak, the shares of its precisions, and
    the use of every other metric with a peak as a map, those of memory together."""
    metric, peak = F.col("metric"), F.col("peak")
    named = [MXU_BUSY, *PRECISIONS.values()]
    own = lambda name, x: F.coalesce(F.sum(F.when(metric == name, F.col(x))), F.lit(0))
    head = utilization.groupBy(*by).agg(own(MXU_BUSY, "achieved").alias("_busy"), own(MXU_BUSY, "peak").alias("_peak"), *(own(name, "achieved").alias(f"_{k}") for k, name in PRECISIONS.items()))
    total = sum((F.col(f"_{k}") for k in PRECISIONS), F.lit(0))
    use = F.when(F.col("_peak") > 0, _percent(F.col("_busy"), F.col("_peak"))).otherwise(0.0)
    shares = F.create_map(*(x for k in PRECISIONS for x in (F.lit(k), F.when(total > 0, _percent(F.col(f"_{k}"), total)).otherwise(0.0))))
    label = F.when(metric.startswith(HBM), HBM_NAME).otherwise(metric)
    rest = utilization.where((peak > 0) & ~metric.isin(*named)).groupBy(*by, label.alias("label")).agg(_percent(F.sum("achieved"), F.sum("peak")).alias("use"))
    rest = rest.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "use")))).alias("other_metrics"))
    out = head.join(rest, list(by), "left").withColumn("other_metrics", F.coalesce("other_metrics", F.create_map().cast("map<string,double>")))
    return out.select(*by, use.alias("mxu_utilization"), (use > 100).alias("mxu_is_anomaly"), shares.alias("mxu_cycles_breakdown"), "other_metrics")


def utilization_report(rows: DataFrame) -> DataFrame:
    """rows(name, achieved, peak) of one device -> (name, percent): each metric's mean over its rows with a peak (0 if it has none and nothing was achieved),
    and the figures made of them: memory, averages over numbered units, the matrix units, and idleness, which is the share of time without any of them busy, else what the busiest
    one leaves, else what their average leaves."""
    share = F.when(F.col("peak") > 0, F.col("achieved") * 100 / F.col("peak"))
    mean = F.coalesce(F.round(F.avg(share), 2), F.when(F.max(F.abs("achieved")) == 0, F.lit(0.0)))
    each = rows.groupBy("name").agg(mean.alias("percent"))
    hbm = rows.where(F.col("name").isin(HBM, f"{HBM} (per chip)")).agg(mean.alias("hbm"))
    name, percent = F.col("name"), F.col("percent")
    numbered = lambda prefix: F.when(name.rlike(_NUMBERED) & name.startswith(prefix), percent)
    one = lambda x: F.max(F.when(name == x, percent))
    facts = each.agg(
        *(one(x).alias(k) for k, x in SUMMARY.items()), F.round(F.avg(numbered("XLU")), 2).alias("xlu_utilization_percent"), one(MXU_BUSY).alias("_busy"), F.round(F.avg(numbered("MXU")), 2).alias("_mxu"),
        F.max(numbered("MXU")).alias("_most"), one(MXU_IDLE).alias("_idle"), F.bool_or(name == MXU_IDLE).alias("_told"), F.count("*").alias("_n"),
    ).crossJoin(hbm)
    idle = F.when(F.col("_told"), F.col("_idle")).when(F.col("_most").isNotNull(), F.greatest(F.round(100 - F.col("_most"), 2), F.lit(0.0))).otherwise(F.round(100 - F.coalesce("_busy", F.lit(0.0)), 2))
    made = {"hbm_bandwidth_utilization_percent": F.col("hbm")} | {k: F.col(k) for k in (*SUMMARY, "xlu_utilization_percent")}
    made |= {"mxu_utilization_percent": F.coalesce("_busy", "_mxu"), "idleness_percent": F.when(F.col("_n") > 0, idle)}
    told = facts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("percent")) for k, v in made.items()))).alias("x")).select("x.*")
    return told.unionByName(each).where("percent is not null")
