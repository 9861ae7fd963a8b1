"""Step reports: input pipeline, pod view, step trace, boundness, roofline per step, facts.

All start from the step breakdown (plane_id, step, category, time) with the category idle for
what is left of a step, so a step's parts sum up to its duration.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanforge.functions import columns as c
from spanforge.operators import metrics as mt
from spanforge.operators import roofline as rl
from spanforge.operators import serving as sv

IDLE = "idle"
OTHER = "All others"
#: fields of a step, in ms
FIELDS = ("infeed", "outfeed", "compute", "transfer", "idle")
# fixed values: percent of the step time from which a part is worth a remark
OUTPUT_LEVELS = ((20.0, "highly"), (5.0, "moderately"))
KERNEL_LEVELS = ((15.0, "high"), (3.0, "moderate"))


def _time_of(categories: Sequence[str]) -> Column:
    mine = F.col("category").isin(*categories) if categories else F.lit(False)
    return F.sum(F.when(mine, F.col("time")).otherwise(0))


def pod_view(breakdown: DataFrame, classes: Mapping[str, Sequence[str]]) -> DataFrame:
    """(plane_id, step, dur, bottleneck, parts): the time of each class of categories as a
    map; categories of no class are 'All others'. The bottleneck is the largest class, the
    last by name of equal ones."""
    known = [x for names in classes.values() for x in names]
    names = [*classes, *([] if OTHER in classes else [OTHER])]
    rest = ~F.col("category").isin(*known) if known else F.lit(True)
    sums = [_time_of(classes.get(n, ())) + (F.sum(F.when(rest, F.col("time")).otherwise(0)) if n == OTHER else 0) for n in names]
    per = breakdown.groupBy("plane_id", "step").agg(F.sum("time").alias("dur"), *(s.alias(f"_{k}") for k, s in enumerate(sums)))
    largest = c.step_bottleneck({n: F.col(f"_{k}") for k, n in enumerate(names)})
    parts = F.map_from_arrays(F.array(*(F.lit(n) for n in names)), F.array(*(F.col(f"_{k}") for k in range(len(names)))))
    return per.select("plane_id", "step", "dur", largest.alias("bottleneck"), parts.alias("parts"))


def all_reduce_split(collectives: DataFrame) -> DataFrame:
    """(step, all_reduce_compute, all_reduce_sync) of collectives(plane_id, step, id, dur): the
    least duration of a collective over its cores is work, what a core spends above it is
    waiting; of a step, the core with the greatest sum counts."""
    least = collectives.groupBy("step", "id").agg(F.min("dur").alias("least"))
    per = collectives.join(least, ["step", "id"]).groupBy("step", "plane_id").agg(F.sum("least").alias("work"), F.sum(F.col("dur") - F.col("least")).alias("sync"))
    top = F.max_by(F.struct("work", "sync"), F.struct(F.col("work") + F.col("sync"), -F.col("plane_id")))
    return per.groupBy("step").agg(top.alias("t")).select("step", F.col("t.work").alias("all_reduce_compute"), F.col("t.sync").alias("all_reduce_sync"))


def input_pipeline_steps(
    breakdown: DataFrame, infeed: Sequence[str], outfeed: Sequence[str], transfer: Sequence[str], collectives: DataFrame | None = None, *, per_ms: float = 1000.0
) -> DataFrame:
    """One row per step over its cores: the longest wait for input with its core, the mean
    output time, the least time of all else (compute), the longest host transfer and what idles in
    the shortest core beyond them, in ms; mean, least and greatest share of input in percent;
    the split of collectives; a text."""
    per = breakdown.groupBy("plane_id", "step").agg(
        F.sum("time").alias("dur"), _time_of(infeed).alias("i"), _time_of(outfeed).alias("o"), _time_of(transfer).alias("t"), _time_of([IDLE]).alias("w")
    )
    share = 100 * c.safe_divide(F.col("i"), F.col("dur"))
    ms = lambda x: x / F.lit(per_ms)
    out = per.groupBy("step").agg(
        F.count("*").alias("cores"), ms(F.max("i")).alias("infeed"), F.max_by("plane_id", F.struct("i", -F.col("plane_id"))).alias("_core"), ms(F.avg("o")).alias("outfeed"),
        ms(F.min(F.col("dur") - F.col("i") - F.col("o") - F.col("t") - F.col("w"))).alias("compute"), ms(F.max("t")).alias("transfer"), ms(F.min("dur")).alias("_least"),
        F.avg(share).alias("infeed_percent"), F.min(share).alias("infeed_percent_min"), F.max(share).alias("infeed_percent_max"),
    )
    busy = F.col("infeed") + F.col("outfeed") + F.col("compute") + F.col("transfer")
    out = out.withColumn("core", F.when(F.col("infeed") > 0, F.col("_core"))).withColumn("idle", F.greatest(F.col("_least") - busy, F.lit(0.0)))
    if collectives is not None:
        out = out.join(all_reduce_split(collectives), "step", "left")
        out = out.withColumns({x: ms(F.coalesce(x, F.lit(0))) for x in ("all_reduce_compute", "all_reduce_sync")})
    else:
        out = out.withColumns({x: F.lit(0.0) for x in ("all_reduce_compute", "all_reduce_sync")})
    out = out.withColumn("step_time", busy + F.col("idle"))
    text = F.format_string("step %d: waiting for input %.3f ms of %.3f ms", F.col("step"), F.col("infeed"), F.col("step_time"))
    return out.withColumn("tooltip", text).drop("_core", "_least")


def input_pipeline_summary(steps: DataFrame) -> DataFrame:
    """(field, avg, sd, min, max) of the fields of input_pipeline_steps, and of the share of input."""
    fields = [*FIELDS, "step_time", "infeed_percent_max"]
    long = steps.select(F.inline(F.array(*(F.struct(F.lit(x).alias("field"), F.col(x).cast("double").alias("value")) for x in fields))))
    return mt.summary_stats(long, "value", ["field"])


def input_pipeline_verdict(steps: DataFrame) -> DataFrame:
    """Shares of input and output in the time of all steps with what they mean, in one row."""
    out = steps.agg(*((100 * c.safe_divide(F.sum(x), F.sum("step_time"))).alias(f"{x}_percent") for x in ("infeed", "outfeed")), F.count("*").alias("steps"))
    bound = F.when(F.col("steps") == 0, "unknown").otherwise(c.input_bound_class(F.col("infeed_percent"), F.lit(0.0)))
    output = reduce(lambda rest, level: F.when(F.col("outfeed_percent") >= level[0], level[1]).otherwise(rest), reversed(OUTPUT_LEVELS), F.lit("not"))
    shown = {x: F.format_string("%.1f", F.coalesce(f"{x}_percent", F.lit(0.0))) for x in ("infeed", "outfeed")}
    reason = F.when(bound == "unknown", F.lit("No step time was measured."))
    reason = reason.otherwise(F.concat(F.lit("The program is "), bound, F.lit(" input-bound: "), shown["infeed"], F.lit(" % of the step time waits for input.")))
    output_text = F.concat(F.lit("The program is "), output, F.lit(" output-bound: "), shown["outfeed"], F.lit(" % of the step time goes to output."))
    return out.select("steps", "infeed_percent", "outfeed_percent", bound.alias("input_bound"), output.alias("output_bound"), reason.alias("input_text"), output_text.alias("output_text"))


def host_breakdown(host: DataFrame, kinds: Mapping[str, Sequence[str]]) -> DataFrame:
    """(kind, time, percent) of host ops(op_name, self_time) by kind of input work; ops of no kind are 'other'."""
    kind = F.lit("other")
    for name, ops in kinds.items():
        kind = F.when(F.col("op_name").isin(*ops), F.lit(name)).otherwise(kind)
    out = host.groupBy(kind.alias("kind")).agg(F.sum("self_time").alias("time"))
    whole = out.agg(F.sum("time").alias("whole"))
    return out.crossJoin(F.broadcast(whole)).select("kind", "time", (100 * c.safe_divide(F.col("time"), F.col("whole"))).alias("percent"))


def bottleneck_assessment(pod: DataFrame, parts: Mapping[str, str]) -> DataFrame:
    """(part, percent, level) of pod_view's classes in the time of all steps; parts names the classes to judge."""
    whole = F.sum("dur")
    shares = pod.agg(*(F.coalesce(100 * c.safe_divide(F.sum(F.element_at("parts", n)), whole), F.lit(0.0)).alias(f"_{k}") for k, n in enumerate(parts)))
    level = lambda p: reduce(lambda rest, x: F.when(p >= x[0], x[1]).otherwise(rest), reversed(KERNEL_LEVELS), F.lit("no"))
    return shares.select(F.inline(F.array(*(F.struct(F.lit(label).alias("part"), F.col(f"_{k}").alias("percent"), level(F.col(f"_{k}")).alias("level")) for k, label in enumerate(parts.values())))))


def step_trace_view(pod: DataFrame, step: int | None = None, core: int | None = None, limit: int = 20) -> DataFrame:
    """The first ``limit`` rows (step, core) of pod_view with each class as a share in percent."""
    rows = pod if step is None else pod.where(F.col("step") == step)
    rows = rows if core is None else rows.where(F.col("plane_id") == core)
    percent = F.transform_values("parts", lambda _, v: 100 * c.safe_divide(v, F.col("dur")))
    return rows.orderBy("step", "plane_id").limit(limit).select("step", "plane_id", "dur", "bottleneck", percent.alias("percent"))


def step_trace_summary(pod: DataFrame) -> DataFrame:
    """Count, mean, extremes and deviation of the step times (the longest core of a
    step), the most frequent bottleneck, and the share of each class in percent."""
    top = F.max_by("bottleneck", F.struct("dur", -F.col("plane_id")))
    one = pod.groupBy("step").agg(F.max("dur").alias("dur"), top.alias("bottleneck"))
    shares = pod.select(F.explode("parts").alias("class", "time")).groupBy("class").agg(F.sum("time").alias("time"))
    shares = shares.crossJoin(F.broadcast(pod.agg(F.sum("dur").alias("whole"))))
    entries = F.sort_array(F.collect_list(F.struct("class", (100 * c.safe_divide(F.col("time"), F.col("whole"))).alias("percent"))))
    return sv.step_summary(one).crossJoin(shares.agg(F.map_from_entries(entries).alias("percent")))


def step_trace(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """The first table that has rows, with its name: pod view, else input pipeline, else overview."""
    for name, df in sources[:-1]:
        if not df.isEmpty():
            return df.withColumn("source", F.lit(name))
    name, df = sources[-1]
    return df.withColumn("source", F.lit(name))


def boundness(facts: DataFrame) -> DataFrame:
    """facts(idle_percent, barrier_percent, utilization_percent) in one row -> status and the
    reasons for it. An idle device with little waiting at barriers waits for the host."""
    idle, barrier, used = (F.coalesce(x, F.lit(0.0)) for x in ("idle_percent", "barrier_percent", "utilization_percent"))
    status = F.when((idle > 10) & (barrier <= idle / 2), "host_bound").when(barrier > 3, "barrier_bound").otherwise("device_bound")
    reasons = F.filter(
        F.array(
            F.when(idle > 10, F.format_string("The device is idle for %.1f %% of the time.", idle)),
            F.when(barrier > 3, F.format_string("Cores wait at barriers for %.1f %% of the time.", barrier)),
            F.when(used < 30, F.format_string("The units run at %.1f %% of their peak.", used)),
        ),
        lambda x: x.isNotNull(),
    )
    return facts.select(*facts.columns, status.alias("status"), reasons.alias("reasons"))


def roofline_steps(metrics: DataFrame, peaks: dict[str, float], *, top: int | None = None) -> DataFrame:
    """R6 over steps: metrics(step, symbol_id, name, category, time, self_time, flops, bytes,
    occurrences) -> the program (rank 0) and its ops, ranked by self time, for 'Total', for
    'Average' (a step's mean) and for every step; with ``top`` only so many ops of each."""
    sums = ("time", "self_time", "flops", "bytes", "occurrences")
    each = metrics.groupBy(F.col("step").cast("string").alias("step"), "symbol_id", "name", "category").agg(*(F.sum(x).cast("double").alias(x) for x in sums))
    total = each.groupBy("symbol_id", "name", "category").agg(*(F.sum(x).alias(x) for x in sums)).withColumn("step", F.lit("Total"))
    n = metrics.agg(F.count_distinct("step").alias("steps"))
    average = total.crossJoin(F.broadcast(n)).withColumns({x: F.col(x) / F.col("steps") for x in sums}).withColumn("step", F.lit("Average")).drop("steps")
    ops = each.unionByName(total).unionByName(average)
    program = ops.groupBy("step").agg(*(F.sum(x).alias(x) for x in sums)).withColumns({"rank": F.lit(0), "name": F.lit("Program"), "category": F.lit("Program")})
    order = W.partitionBy("step").orderBy(F.col("self_time").desc(), "symbol_id")
    ranked = ops.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    df = rl.roofline_columns(program.unionByName(ranked, allowMissingColumns=True), peaks)
    return df.select("step", "rank", "symbol_id", F.col("name").alias("operation"), "category", "occurrences", c.pico_to("us", F.col("time")).alias("total_time"), "measured_flop_rate", "hbm_bw", "operational_intensity", "bound_by", "roofline_efficiency")


def facts(**tables: tuple[DataFrame, Mapping[str, Column]]) -> DataFrame:
    """One row of all facts: of each one-row table the columns named, as fact names."""
    out = None
    for df, columns in tables.values():
        one = df.agg(*(F.first(x).alias(n) for n, x in columns.items()))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out
