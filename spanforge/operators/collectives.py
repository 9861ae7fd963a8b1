"""Collective operations: slack and stall per rendezvous, flows, counters over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def slack_overlap(visits: DataFrame) -> DataFrame:
    """For each recv-done after a send of its rendezvous: slack is the time from the send to
    the recv-done minus all tracked ops of the device from the send (included) to the
    recv-done (excluded); stall is the time of its own ops from send to recv-done, both
    included; observed is the whole from send to the end of recv-done."""
    tracked = visits.where("opcode <> 'other'")
    dev = W.partitionBy("device_id").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy("device_id", "rendezvous").orderBy("ts", "seq")
    rows = tracked.withColumn("_all", F.coalesce(F.sum("dur").over(dev), F.lit(0))).withColumn("_own", F.coalesce(F.sum("dur").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    send = F.last(F.when(F.col("opcode") == "send", F.struct("ts", "_all", "_own", "dur")), True).over(own.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_s", send).where("opcode = 'recv-done' and _s is not null")
    slack = F.col("ts") - F.col("_s.ts") - (F.col("_all") - F.col("_s._all"))
    stall = F.col("_own") + F.col("dur") - F.col("_s._own")
    return rows.select("device_id", "rendezvous", "seq", slack.alias("slack"), stall.alias("stall"), (F.col("ts") + F.col("dur") - F.col("_s.ts")).alias("observed"), F.col("_s.dur").alias("send"))


def collective_summary(overlaps: DataFrame) -> DataFrame:
    """Per rendezvous the means over its occurrences."""
    mean = lambda c: F.expr(f"sum({c}) DIV count(*)").alias(c)
    return overlaps.groupBy("rendezvous").agg(F.count("*").alias("occurrences"), *(mean(c) for c in ("slack", "stall", "observed", "send")))


def merge_collectives(summaries: DataFrame) -> DataFrame:
    """Summaries of several hosts, weighted by their occurrences."""
    mean = lambda c: F.expr(f"sum({c} * occurrences) DIV sum(occurrences)").alias(c)
    return summaries.groupBy("rendezvous").agg(*(mean(c) for c in ("slack", "stall", "observed", "send")), F.sum("occurrences").alias("occurrences"))


def counter_series(df: DataFrame, by: Sequence[str], amount: Column) -> DataFrame:
    """+amount at begin and -amount at the end of each span -> the running level, one row per
    time."""
    d = df.withColumn("_a", amount)
    up = d.select(*by, F.col("ts").alias("t"), F.col("_a").alias("d"))
    down = d.select(*by, (F.col("ts") + F.col("dur")).alias("t"), (-F.col("_a")).alias("d"))
    points = up.unionByName(down).groupBy(*by, "t").agg(F.sum("d").alias("d"))
    w = W.partitionBy(*by).orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return points.withColumn("level", F.sum("d").over(w)).drop("d")


def infer_run_ids(df: DataFrame, by: Sequence[str], run: str) -> DataFrame:
    """The run id of the row, else a running count of rows without one."""
    w = W.partitionBy(*by).orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("run_id", F.coalesce(run, F.sum(F.when(F.col(run).isNull(), 1).otherwise(0)).over(w)))


def hide_tiny(df: DataFrame, by: Sequence[str], tick: int, limit: int) -> DataFrame:
    """Two or more consecutive events shorter than limit within one tick of time become one
    row with joined names; others stay as they are."""
    w = W.partitionBy(*by, "_c").orderBy("ts", "seq")  # rows of several ticks never join
    cell = F.floor(F.col("ts") / tick)
    tiny = F.col("dur") < limit
    rows = df.withColumn("_c", cell).withColumn("_t", tiny)
    same = F.col("_t") & F.coalesce(F.lag("_t").over(w), F.lit(False)) & F.col("_c").isNotNull()
    rows = rows.withColumn("_n", F.when(same, 0).otherwise(1)).withColumn("_i", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "name"))), lambda x: x["name"]), ", ")
    return rows.groupBy(*by, "_c", "_i").agg(F.min("seq").alias("seq"), F.min("ts").alias("ts"), (F.max(F.col("ts") + F.col("dur")) - F.min("ts")).alias("dur"), names.alias("name"), F.count("*").alias("events")).drop("_c", "_i")
