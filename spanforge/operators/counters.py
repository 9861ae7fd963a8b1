"""Counter samples and hardware utilization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.columns import safe_divide


def counter_values(counters: DataFrame, mode: str = "last") -> DataFrame:
    """Per (device, line, counter) the last sample in (offset, -dur, seq) order, or the sum."""
    by = counters.groupBy("device_id", "line_id", "counter_id")
    if mode == "sum":
        return by.agg(F.sum("value").alias("value"))
    return by.agg(F.max_by("value", F.struct("offset", -F.col("dur"), "seq")).alias("value"))


def hw_utilization(values: DataFrame, formulas: DataFrame) -> DataFrame:
    """formulas(metric, counter_id, weight, peak_counter, factor): achieved is the weighted
    sum of the counters of a metric, peak the value of its peak counter times factor. The
    formula table is part of the device's description and small by nature."""
    per = values.groupBy("device_id", "counter_id").agg(F.sum("value").alias("value"))
    achieved = per.join(F.broadcast(formulas), "counter_id").groupBy("device_id", "metric").agg(
        F.sum(F.col("weight") * F.col("value")).alias("achieved"), F.first("peak_counter").alias("peak_counter"), F.first("factor").alias("factor")
    )
    peak = per.select("device_id", F.col("counter_id").alias("peak_counter"), F.col("value").alias("peak_value"))
    out = achieved.join(peak, ["device_id", "peak_counter"], "left")
    return out.select("device_id", "metric", "achieved", (F.coalesce("peak_value", F.lit(0)) * F.col("factor")).alias("peak"))


def kernel_utilization(counters: DataFrame, formulas: DataFrame, busy_metric: str) -> DataFrame:
    """Summed counters per line (kernel), each metric as percent of its peak, and an
    anomaly flag where the busy metric is above its peak."""
    sums = counter_values(counters, "sum")
    out = None
    per = sums.withColumnRenamed("line_id", "kernel")
    joined = per.join(F.broadcast(formulas), "counter_id").groupBy("device_id", "kernel", "metric").agg(
        F.sum(F.col("weight") * F.col("value")).alias("achieved"), F.first("peak_counter").alias("peak_counter"), F.first("factor").alias("factor")
    )
    peak = per.select("device_id", "kernel", F.col("counter_id").alias("peak_counter"), F.col("value").alias("peak_value"))
    out = joined.join(peak, ["device_id", "kernel", "peak_counter"], "left")
    percent = 100 * safe_divide(F.col("achieved"), F.coalesce("peak_value", F.lit(0)) * F.col("factor"))
    return out.select("device_id", "kernel", "metric", percent.alias("percent"), ((F.col("metric") == busy_metric) & (percent > 100)).alias("anomaly"))


def utilization_summary(utilization: DataFrame) -> DataFrame:
    """Mean of achieved * 100 / peak per metric over rows with a peak."""
    share = F.when(F.col("peak") > 0, F.col("achieved") * 100 / F.col("peak"))
    return utilization.groupBy("metric").agg(F.avg(share).alias("percent"))


def perf_counters(counters: DataFrame, description: Column) -> DataFrame:
    """Sample rows with description and the value in hexadecimal."""
    return counters.select("device_id", "line_id", "counter_id", description.alias("description"), "offset", "dur", "value", F.concat(F.lit("0x"), F.lower(F.hex("value"))).alias("hex"), "seq")
