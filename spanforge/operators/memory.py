"""Allocator events: profiles, peaks, live sets, buffer timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanforge.functions.columns import numbered_base
from spanforge.plans.work import checkpointed



def in_use():
    return F.col("heap") + F.col("stack")


def step_carry(events: DataFrame) -> DataFrame:
    """A missing step (-1) is the last known step plus one, 0 before any."""
    w = W.partitionBy("allocator").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    known = F.when(F.col("step_id") >= 0, F.col("step_id"))
    return events.withColumn("step", F.coalesce(known, F.last(known, True).over(w) + 1, F.lit(0)))


def sample_buckets(events: DataFrame, n: int = 1000) -> DataFrame:
    """At most n rows per allocator: contiguous buckets of w and w + 1 rows, of each the row
    with the most memory in use, the earliest of several."""
    order = W.partitionBy("allocator").orderBy("ts", "seq")
    rows = events.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(W.partitionBy("allocator")))
    width = F.expr(f"_n DIV {n}")
    first = n * (width + 1) - F.col("_n")  # so many buckets of the smaller width
    late = first + F.expr("(_i - {f}) DIV ({w} + 1)".format(f=f"({n} * (_n DIV {n} + 1) - _n) * (_n DIV {n})", w=f"_n DIV {n}"))
    bucket = F.when(F.col("_n") <= n, F.col("_i")).when(F.col("_i") < first * width, F.expr(f"_i DIV greatest(_n DIV {n}, 1)")).otherwise(late)
    best = F.row_number().over(W.partitionBy("allocator", "_b").orderBy(in_use().desc(), "_i"))
    return rows.withColumn("_b", bucket).withColumn("_r", best).where("_r = 1").drop("_i", "_n", "_b", "_r")


def memory_summary(events: DataFrame) -> DataFrame:
    """Per allocator the latest row with the most memory in use, and the capacity."""
    top = F.max_by(F.struct("ts", "seq", "heap", "stack", "free"), F.struct(in_use(), "ts", "seq"))
    out = events.groupBy("allocator").agg(top.alias("t"), F.max("heap").alias("lifetime_peak"))
    return out.select("allocator", F.col("t.ts").alias("peak_ts"), F.col("t.seq").alias("peak_seq"), (F.col("t.heap") + F.col("t.stack")).alias("peak"), (F.col("t.heap") + F.col("t.stack") + F.col("t.free")).alias("capacity"), "lifetime_peak")


def live_at_peak(events: DataFrame) -> DataFrame:
    """Allocations that live when the allocator peaks, grouped by op: count and bytes,
    with the stack and what no live allocation explains as rows of their own."""
    peak = memory_summary(events).select("allocator", "peak_ts", "peak_seq")
    upto = events.join(peak, "allocator").where((F.col("ts") < F.col("peak_ts")) | ((F.col("ts") == F.col("peak_ts")) & (F.col("seq") <= F.col("peak_seq"))))
    last = upto.groupBy("allocator", "address").agg(F.max_by(F.struct("kind", "bytes", "op"), F.struct("ts", "seq")).alias("x"))
    live = last.where("x.kind = 'alloc'").groupBy("allocator", F.col("x.op").alias("op")).agg(F.count("*").alias("count"), F.sum("x.bytes").alias("bytes"))
    at = events.join(peak.select("allocator", F.col("peak_seq").alias("seq")), ["allocator", "seq"])
    total = live.groupBy("allocator").agg(F.sum("bytes").alias("mapped"))
    stack = at.select("allocator", F.lit("stack").alias("op"), F.lit(1).cast("bigint").alias("count"), F.col("stack").alias("bytes"))
    rest = at.join(total, "allocator", "left").select("allocator", F.lit("unmapped").alias("op"), F.lit(1).cast("bigint").alias("count"), F.greatest(F.col("heap") - F.coalesce("mapped", F.lit(0)), F.lit(0)).alias("bytes"))
    return live.unionByName(stack).unionByName(rest)


def peak_allocations(buffers: DataFrame, min_bytes: int, limit: int) -> DataFrame:
    """buffers(module, name, size): name.N of equal size as name.*, small ones as Others,
    the largest rows per module."""
    small = F.col("size") < min_bytes
    named = buffers.select("module", F.when(small, F.lit("Others")).otherwise(numbered_base(F.col("name"))).alias("name"), F.when(small, F.lit(0)).otherwise(F.col("size")).alias("unit"), "size")
    out = named.groupBy("module", "name", "unit").agg(F.count("*").alias("count"), F.sum("size").alias("bytes"))
    r = F.row_number().over(W.partitionBy("module").orderBy(F.col("bytes").desc(), "name", "unit"))
    return out.withColumn("_r", r).where(F.col("_r") <= limit).drop("_r")


def buffer_timeline(events: DataFrame) -> DataFrame:
    """events(program_id, seq, kind alloc/free/share, buffer_id, canonical_id, size) -> the
    heap level after each event. A shared buffer uses its canonical one, which is held until
    its reference count returns to 0."""
    root = events.where("kind = 'share'").select("program_id", F.col("buffer_id").alias("b"), F.col("canonical_id").alias("c"))
    chain = checkpointed(root)
    while True:  # chains of shares, shortened until none points at another
        nxt = chain.select("program_id", F.col("b").alias("c"), F.col("c").alias("c2"))
        step = checkpointed(chain.join(nxt, ["program_id", "c"], "left").select("program_id", "b", F.coalesce("c2", "c").alias("c")))
        if step.exceptAll(chain).isEmpty():
            break
        chain = step
    e = events.join(chain.select("program_id", F.col("b").alias("buffer_id"), F.col("c").alias("_root")), ["program_id", "buffer_id"], "left")
    e = e.withColumn("_root", F.coalesce("_root", "buffer_id"))
    size = events.where("kind = 'alloc'").groupBy("program_id", F.col("buffer_id").alias("_root")).agg(F.max("size").alias("_size"))
    e = e.join(size, ["program_id", "_root"], "left").withColumn("_d", F.when(F.col("kind") == "free", -1).otherwise(1))
    refs = F.sum("_d").over(W.partitionBy("program_id", "_root").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    e = e.withColumn("refs", refs)
    delta = F.when((F.col("_d") == 1) & (F.col("refs") == 1), F.col("_size")).when((F.col("_d") == -1) & (F.col("refs") == 0), -F.col("_size")).otherwise(0)
    level = F.sum(F.coalesce("delta", F.lit(0))).over(W.partitionBy("program_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return e.withColumn("delta", delta).withColumn("level", level).select("program_id", "seq", "kind", "buffer_id", "refs", "level")


def heap_peak(timeline: DataFrame) -> DataFrame:
    """The first event at the peak level of each program."""
    return timeline.groupBy("program_id").agg(F.max("level").alias("peak"), F.min_by("seq", F.struct(-F.col("level"), "seq")).alias("peak_seq"))
