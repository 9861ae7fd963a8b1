"""Aggregations over spans and ops: totals, self time, roll-ups, rooflines, ranks, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanforge.operators.ranks import ranked
from spanforge.functions import columns as c
from spanforge.operators.filters import drop_containers
from spanforge.plans.work import checkpointed


def aggregate_events(spans: DataFrame, plane_re: str = "", event_re: str = "", cut: Column | None = None) -> DataFrame:
    """A1: per event name count, total, average, extremes, sample deviation and cut events."""
    d, cut = F.col("dur"), F.lit(False) if cut is None else cut
    return (
        spans.where(F.col("plane").rlike(plane_re) & F.col("name").rlike(event_re))
        .groupBy("name")
        .agg(
            F.count("*").alias("count"), F.sum(d).alias("total"), F.avg(d).alias("avg"), F.min(d).alias("min"), F.max(d).alias("max"),
            F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("std_dev"), F.count_if(cut).alias("truncated"),
        )
    )


def avg_step_time(spans: DataFrame, func: str = "") -> DataFrame:
    """A3: mean duration of matching module events."""
    return spans.where(F.col("name").rlike(func)).agg(F.count("*").alias("count"), F.avg("dur").alias("avg"))


def kernel_stats(spans: DataFrame, name: Column, limit: int) -> DataFrame:
    """A2: device kernels by name: count, total, average; the largest limit of them."""
    out = spans.groupBy(name.alias("kernel")).agg(F.count("*").alias("count"), F.sum("dur").alias("total"))
    return out.withColumn("avg", c.safe_divide(F.col("total"), F.col("count"))).orderBy(F.col("total").desc(), "kernel").limit(limit)


def kernel_summary(spans: DataFrame, modules: DataFrame, by: Sequence[str]) -> DataFrame:
    """A2, summary form: per device the union time of its kernels, and the count, mean and
    deviation of its module events."""
    from spanforge.operators.intervals import busy_time

    steps = summary_stats(modules.withColumn("_one", F.lit(1)), "dur", by)
    count = modules.groupBy(*by).agg(F.count("*").alias("steps"))
    return busy_time(spans, by).join(steps, list(by), "left").join(count, list(by), "left")


def op_metrics(events: DataFrame, ops: DataFrame, scale: float = 1.0) -> DataFrame:
    """A4: per (program, symbol): occurrences (at least one per event), time, self time (column
    self_dur, else time), normalized and least time, stall; flops and bytes are those of an
    occurrence times the occurrences, but for custom calls the sums of the events' own ones."""
    own = F.col("self_dur") if "self_dur" in events.columns else F.col("dur")
    measured = [x for x in ("flops", "bytes") if x in events.columns]
    per = events.where("symbol_id <> 0").groupBy("program_id", "symbol_id").agg(
        F.sum(F.greatest("occurrences", F.lit(1))).alias("occurrences"), F.sum("dur").alias("time"), F.sum(own).alias("self_time"),
        F.min("dur").alias("min_time"), F.sum("dma_stall").alias("dma_stall"), *(F.sum(x).alias(f"_{x}") for x in measured),
    )
    out = per.join(ops, ["program_id", "symbol_id"]).withColumn("normalized_time", F.col("time") * scale)
    for x in ("flops", "bytes"):
        each = F.col(x) * F.col("occurrences")
        out = out.withColumn(x, F.when(F.col("category") == "custom-call", F.coalesce(f"_{x}", each)).otherwise(each) if x in measured else each)
    return out.drop("_flops", "_bytes")


def merge_op_metrics(parts: DataFrame, by: Sequence[str] = ("program_id", "name")) -> DataFrame:
    """A5: op metrics of several cores or hosts by module and name."""
    return parts.groupBy(*by).agg(
        F.sum("occurrences").alias("occurrences"), F.sum("time").alias("time"), F.sum("self_time").alias("self_time"),
        F.min("min_time").alias("min_time"), F.sum("flops").alias("flops"), F.sum("bytes").alias("bytes"),
        F.min(F.nullif("category", F.lit(""))).alias("category"), F.count("*").alias("parts"),
    )


def with_idle(metrics: DataFrame, total: Column) -> DataFrame:
    """Plus one row IDLE: the part of the total time in no op."""
    used = metrics.agg(F.coalesce(F.sum("self_time"), F.lit(0)).alias("used"), total.alias("total"))
    idle = used.select(F.lit("IDLE").alias("name"), F.lit("IDLE").alias("category"), (F.greatest("total", "used") - F.col("used")).alias("self_time"))
    return metrics.unionByName(idle, allowMissingColumns=True)


def framework_ops(metrics: DataFrame) -> DataFrame:
    """Device ops rolled up to framework ops by provenance: occurrences are the maximum,
    the others sums."""
    op = c.parse_op(F.col("provenance"))
    out = metrics.withColumn("_op", op)
    return out.groupBy(F.col("_op.name").alias("op_name"), F.col("_op.type").alias("op_type")).agg(
        F.max("occurrences").alias("occurrences"), F.sum("time").alias("time"), F.sum("self_time").alias("self_time"), F.sum("flops").alias("flops"), F.sum("bytes").alias("bytes")
    )


def host_ops(spans: DataFrame) -> DataFrame:
    """Host ops by parsed name: occurrences, time and self time (column self_dur)."""
    op = c.parse_op(F.col("name"))
    out = spans.withColumn("_op", op)
    return out.groupBy(F.col("_op.category").alias("category"), F.col("_op.name").alias("op_name")).agg(
        F.count("*").alias("occurrences"), F.sum("dur").alias("time"), F.sum("self_dur").alias("self_time")
    )


def gpu_op_metrics(spans: DataFrame, ops: DataFrame, by: Sequence[str]) -> DataFrame:
    """kernels(by, begin, dur, seq, program_id, name, group_id): consecutive kernels of one op and
    group on a stream form one run of the op, from the first begin to the last end. Per
    (program, op): runs, kernels, time, and flops and bytes: those of the program's op per kernel, or the sums of
    the kernels' own ones where the program knows none. ops(program_id, name, category, flops, bytes)."""
    from spanforge.operators.intervals import merge_runs

    keys = ["program_id", "name"]
    runs = merge_runs(spans, by, [*keys, "group_id"]).groupBy(*keys).agg(F.count("*").alias("runs"), F.sum("events").alias("occurrences"), F.sum("dur").alias("time"))
    own = spans.groupBy(*keys).agg(*((F.sum(x) if x in spans.columns else F.lit(0)).cast("bigint").alias(f"_{x}") for x in ("flops", "bytes")))
    out = runs.join(own, keys).join(ops.select(*keys, "category", "flops", "bytes"), keys, "left")
    cost = {x: F.when(F.col(x) > 0, F.col(x) * F.col("occurrences")).otherwise(F.coalesce(f"_{x}", F.lit(0))) for x in ("flops", "bytes")}
    return out.withColumns(cost).withColumn("category", F.coalesce("category", F.lit("unknown"))).drop("_flops", "_bytes")


def gpu_kernel_stats(spans: DataFrame, keys: Sequence[str], limit: int = 1000) -> DataFrame:
    """A10: kernels by launch key: total, least, greatest, count; zero durations drop out."""
    out = spans.where("dur > 0").groupBy(*keys).agg(F.sum("dur").alias("total"), F.min("dur").alias("min"), F.max("dur").alias("max"), F.count("*").alias("count"))
    return out.orderBy(F.col("total").desc(), *keys).limit(limit)


def kernels_by_op(kernels: DataFrame, op: str, tensor_core: Column) -> DataFrame:
    """Total and tensor-core time by op."""
    return kernels.groupBy(op).agg(F.sum("total").alias("total"), F.coalesce(F.sum(F.when(tensor_core, F.col("total"))), F.lit(0)).alias("tensor_core"))


def merge_memory(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bytes of memory breakdowns by (operation, space)."""
    items = df.select(*by, F.explode("memory").alias("m"))
    return items.groupBy(*by, F.col("m.op").alias("op"), F.col("m.space").alias("space")).agg(F.sum("m.bytes").alias("bytes"))


def step_breakdown(events: DataFrame, steps: DataFrame, by: Sequence[str], category: str) -> DataFrame:
    """events(by, step, category, self_dur) -> self time per step and category, plus the
    rest of the step as idle."""
    parts = events.where("step is not null").groupBy(*by, "step", F.col(category).alias("category")).agg(F.sum("self_dur").alias("time"))
    used = parts.groupBy(*by, "step").agg(F.sum("time").alias("used"))
    idle = steps.join(used, [*by, "step"], "left").select(*by, "step", F.lit("idle").alias("category"), F.greatest(F.col("dur") - F.coalesce("used", F.lit(0)), F.lit(0)).alias("time"))
    return parts.unionByName(idle)


def step_times(markers: DataFrame, by: Sequence[str]) -> DataFrame:
    """markers(by..., step, device, begin, dur) -> (by..., step, begin, dur): the longest device marker of a step, or the longest host marker where
    there is no device marker or the host's encloses it."""
    longest = lambda side: F.max_by(F.struct("begin", "dur"), F.when(side, F.struct("dur", (-F.col("begin")).alias("b"))))
    per = markers.groupBy(*by, "step").agg(longest(F.col("device")).alias("d"), longest(~F.col("device")).alias("h"))
    end = lambda x: F.col(f"{x}.begin") + F.col(f"{x}.dur")
    encloses = (F.col("h.begin") <= F.col("d.begin")) & (end("d") <= end("h"))
    chosen = F.when(F.col("d").isNull() | encloses, F.col("h")).otherwise(F.col("d"))
    return per.select(*by, "step", chosen.alias("t")).select(*by, "step", "t.*")


def clip_to_steps(spans: DataFrame, steps: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """Spans cut at the bounds of steps(by..., step, begin, dur), one row for each step they cross."""
    from spanforge.operators.intervals import overlap_join

    begin, end = F.greatest("begin", "r_begin"), F.least(F.col("begin") + F.col("dur"), F.col("r_begin") + F.col("r_dur"))
    pairs = overlap_join(spans, steps.select(*by, "step", "begin", "dur"), by, width).withColumn("step", F.col("r_step"))
    out = pairs.withColumns({"begin": begin, "dur": end - begin}).where("dur > 0")
    return out.drop("r_step", "r_begin", "r_dur")


def step_kinds(clipped: DataFrame, steps: DataFrame, by: Sequence[str], kinds: int, needed: Sequence[int], unknown: int = 0) -> DataFrame:
    """A13 by event kind: clipped(by..., step, kind 1..kinds, begin, dur) -> (by..., step, kind, time): the time in which a kind is the highest active one;
    the rest of the step is unknown. Steps without time of any of the needed kinds (compute) are left out."""
    from spanforge.operators.intervals import priority_timeline

    keys = [*by, "step"]
    known = priority_timeline(clipped, keys, F.col("kind"), kinds).where("kind > 0 and time > 0")
    whole = known.groupBy(*keys).agg(F.sum("time").alias("_known"), F.bool_or(F.col("kind").isin(*needed)).alias("_good")).where("_good")
    rest = steps.select(*keys, "dur").join(whole, keys).select(*keys, F.lit(unknown).alias("kind"), (F.col("dur") - F.col("_known")).alias("time")).where("time > 0")
    return known.join(whole.select(*keys), keys, "left_semi").unionByName(rest)


def program_totals(metrics: DataFrame, include_infeed: bool = True) -> DataFrame:
    """Sums over ops without containers."""
    return drop_containers(metrics, include_infeed).agg(
        F.sum("self_time").alias("self_time"), F.sum("flops").alias("flops"), F.sum("bytes").alias("bytes"), F.count("*").alias("ops")
    )


def op_profile(metrics: DataFrame) -> DataFrame:
    """Time rolled up root -> program -> category -> op: one row per node with its level."""
    rolled = metrics.rollup("program_id", "category", "name").agg(
        F.sum("self_time").alias("self_time"), F.sum("flops").alias("flops"), F.sum("occurrences").alias("occurrences"), F.grouping_id().alias("_g")
    )
    level = F.when(F.col("_g") == 7, 0).when(F.col("_g") == 3, 1).when(F.col("_g") == 1, 2).otherwise(3)
    return rolled.withColumn("level", level).drop("_g")


def op_profile_by_scope(metrics: DataFrame, max_depth: int = 100) -> DataFrame:
    """A15 by provenance: time of every prefix of the scope path."""
    path = F.split("provenance", "/")
    prefixes = metrics.select("self_time", F.posexplode(F.slice(path, 1, max_depth)).alias("depth", "_part"), path.alias("path"))
    named = prefixes.withColumn("scope", F.array_join(F.slice("path", F.lit(1), F.col("depth") + 1), "/"))
    return named.groupBy("depth", "scope").agg(F.sum("self_time").alias("self_time"), F.count("*").alias("ops"))


def time_by_class(metrics: DataFrame) -> DataFrame:
    """Leaf time as compute, HBM or ICI."""
    return metrics.groupBy(c.time_class(F.col("name"), F.col("category")).alias("class")).agg(F.sum("self_time").alias("time"))


def summary_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Average, sample deviation (0 if all equal), extremes; zeros for no rows."""
    v = F.col(value)
    sd = F.when(F.min(v) == F.max(v), F.lit(0.0)).otherwise(F.stddev_samp(v))
    stats = {"avg": F.avg(v), "sd": sd, "min": F.min(v), "max": F.max(v)}
    return df.groupBy(*by).agg(*(F.coalesce(x, F.lit(0)).alias(n) for n, x in stats.items()))


def launch_stats(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """First, last, count, greatest and average launch time."""
    return spans.groupBy(*by).agg(F.min("begin").alias("first"), F.max("begin").alias("last"), F.count("*").alias("count"), F.max("dur").alias("max"), F.avg("dur").alias("avg"))


def mode_first(df: DataFrame, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """The most common value, the earliest of several."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("count"), F.min(order).alias("_o"))
    r = F.row_number().over(W.partitionBy(*by).orderBy(F.col("count").desc(), "_o"))
    return n.withColumn("_r", r).where("_r = 1").drop("_r", "_o")


def infeed_ratio(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Enqueue time of all but the last event over the sum of gaps between starts."""
    w = W.partitionBy(*by).orderBy("begin", "seq")
    gaps = spans.withColumn("_next", F.lead("begin").over(w)).where("_next is not null")
    out = gaps.groupBy(*by).agg(F.sum("dur").alias("enqueue"), F.sum(F.col("_next") - F.col("begin")).alias("gaps"))
    return out.withColumn("ratio", c.safe_divide(F.col("enqueue"), F.col("gaps")))


def assign_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """Dense ids of the distinct keys in the order of their first appearance."""
    first = df.groupBy(key).agg(F.min(order).alias("_o"))
    return ranked(first, ["_o", key], rank="id").select(key, "id")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """A45."""
    return df.select(column).distinct()


def rank_cumulative(df: DataFrame, value: str, name: str) -> DataFrame:
    """Rank by value, share of the total and running share. Rows are range-partitioned in that order; each range
    counts and sums its own rows and starts where the ones before it end."""
    order = [F.col(value).desc(), F.col(name)]
    parts = checkpointed(df.repartitionByRange(*order).withColumn("_range_no", F.spark_partition_id()))
    ranges = parts.groupBy("_range_no").agg(F.count("*").alias("_size"), F.sum(value).alias("_sum"))
    before = W.orderBy("_range_no").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    start = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    ranges = ranges.select("_range_no", start("_size").alias("_before"), start("_sum").alias("_ahead"), F.sum("_sum").over(W.partitionBy()).alias("_total"))
    own = W.partitionBy("_range_no").orderBy(*order)
    run = F.coalesce(F.sum(value).over(own.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    out = parts.withColumns({"_own": F.row_number().over(own), "_run": run}).join(F.broadcast(ranges), "_range_no")
    out = out.withColumn("rank", (F.col("_own") + F.col("_before")).cast("int")).withColumn("fraction", c.safe_divide(F.col(value), F.col("_total")))
    out = out.withColumn("cumulative", c.safe_divide(F.col("_run") + F.col("_ahead"), F.col("_total")))
    return out.drop("_range_no", "_own", "_run", "_before", "_ahead", "_total")


def roofline(df: DataFrame, peak_gflops: float, peak_gibps: float) -> DataFrame:
    """Rates and utilization of ops (time in ps), and what bounds them."""
    ns = c.pico_to("ns", F.col("time"))
    rate = c.safe_divide(F.col("flops"), ns)
    bw = c.giga_to_gibi(c.safe_divide(F.col("bytes"), ns))
    u1, u2 = c.safe_divide(rate, F.lit(peak_gflops)), c.safe_divide(bw, F.lit(peak_gibps))
    out = df.withColumns({"flop_rate": rate, "bandwidth": bw, "intensity": c.safe_divide(F.col("flops"), F.col("bytes")), "compute_utilization": u1, "memory_utilization": u2})
    bound = F.when(u2 > u1, "HBM").when(u1 > 0, "Compute").otherwise("Unknown")
    efficiency = F.greatest(u1, u2)
    return out.withColumns({"bound_by": bound, "efficiency": efficiency, "optimal_rate": c.safe_divide(rate, efficiency)})


def top_ops(metrics: DataFrame, limit: int) -> DataFrame:
    """The top ops by time, flops and bytes: (list, name, value)."""
    out = None
    for column in ("self_time", "flops", "bytes"):
        part = metrics.orderBy(F.col(column).desc(), "name", "symbol_id").limit(limit).select(F.lit(column).alias("list"), "name", "symbol_id", F.col(column).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def list_events(spans: DataFrame, max_events: int = 100, offset: int = 0) -> DataFrame:
    """A page of events in file order."""
    return spans.orderBy("seq").offset(offset).limit(max_events)


def matched_events(spans: DataFrame, plane_re: str = "", event_re: str = "", start: int | None = None, end: int | None = None) -> DataFrame:
    """The events whose plane and name match and that lie within start and end."""
    found = spans.where(F.col("plane").rlike(plane_re) & F.col("name").rlike(event_re))
    found = found if start is None else found.where(F.col("begin") >= start)
    return found if end is None else found.where(F.col("begin") + F.col("dur") <= end)


def list_summary(matched: DataFrame, max_events: int = 100, offset: int = 0) -> DataFrame:
    """(returned, total_matched, truncated) of a page of list_events; max_events 0 is no limit."""
    left = F.greatest(F.col("total_matched") - offset, F.lit(0))
    total = matched.agg(F.count("*").alias("total_matched"))
    out = total.select((F.least(left, F.lit(max_events)) if max_events > 0 else left).cast("bigint").alias("returned"), "total_matched")
    return out.withColumn("truncated", F.col("total_matched") > F.col("returned") + offset)


def op_stats_table(metrics: DataFrame, sort_by: str = "self_time", limit: int = 20) -> DataFrame:
    """T3."""
    return metrics.orderBy(F.col(sort_by).desc(), "name", "symbol_id").limit(limit)


def top_per_group(df: DataFrame, group: Sequence[str], value: str, k: int, tie: Sequence[str]) -> DataFrame:
    """T4: the k largest rows per group."""
    r = F.row_number().over(W.partitionBy(*group).orderBy(F.col(value).desc(), *tie))
    return df.withColumn("_r", r).where(F.col("_r") <= k).drop("_r")


def first_events(spans: DataFrame, n: int, order: Sequence[str] = ("begin", "seq")) -> DataFrame:
    """T5: the first n events in time, those of one time in the order of the file. The n-th value is found by counts of ranges that get
    narrower (see ``range_cut``): all rows below it stay, of those at it as many as are left by the next column. Nothing is sorted. Columns of order are whole
    numbers, the last one without repetition."""
    cut = range_cut(spans, order[0], n)
    if cut is None:
        return spans
    value, below = cut
    out, at = spans.where(F.col(order[0]) < value), spans.where(F.col(order[0]) == value)
    return out.unionByName(first_events(at, n - below, order[1:]) if len(order) > 1 else at.limit(n - below))


def range_cut(df: DataFrame, column: str, n: int, parts: int = 1024) -> tuple[int, int] | None:
    """(the n-th least value of a whole-number column, how many rows are below it), None if there are not more than n rows. Each round counts the
    rows of at most parts ranges and goes on within the one that holds the n-th, six or seven rounds for any values."""
    low, high, count = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if count <= n:
        return None
    below = 0
    while low < high:
        width = (high - low) // parts + 1
        at = F.col(column) - low
        part = at - F.pmod(at, F.lit(width))
        for start, rows in sorted(df.where(F.col(column).between(low, high)).groupBy(part.alias("start")).count().collect()):
            if below + rows >= n:
                low, high = low + start, min(high, low + start + width - 1)
                break
            below += rows
    return low, below


def op_profile_view(profile: DataFrame, level: int, top_n: int) -> DataFrame:
    """The largest nodes of one level."""
    return profile.where(F.col("level") == level).orderBy(F.col("self_time").desc_nulls_last(), "program_id", "category", "name").limit(top_n)


def profile_summary(profile: DataFrame, n: int = 10) -> DataFrame:
    """The first nodes in pre-order, larger siblings first."""
    p = W.partitionBy("program_id")
    q = W.partitionBy("program_id", "category")
    top = lambda k, w: F.max(F.when(F.col("level") == k, F.col("self_time"))).over(w)
    keyed = profile.withColumn("_t1", top(1, p)).withColumn("_t2", top(2, q))
    order = [F.when(F.col("level") == 0, 0).otherwise(1), F.col("_t1").desc(), F.col("program_id"), F.when(F.col("level") <= 1, 0).otherwise(1), F.col("_t2").desc(), F.col("category"), F.col("level"), F.col("self_time").desc(), F.col("name")]
    return keyed.orderBy(*order).limit(n).drop("_t1", "_t2")


def capped_scan(df: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """At most n rows, and whether there were more."""
    more = df.limit(n + 1).count() > n
    return df.limit(n), more
