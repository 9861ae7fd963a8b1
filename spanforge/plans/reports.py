"""Reports: compositions of the operators. Each function takes trace tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanforge.functions import columns as c
from spanforge.operators import collectives as cl
from spanforge.operators import counters as ct
from spanforge.operators import intervals as iv
from spanforge.operators import memory as mm
from spanforge.operators import metrics as mt
from spanforge.operators import roofline as rl
from spanforge.operators import serving as sv
from spanforge.plans import steps
from spanforge.plans.work import checkpointed


def run_environment(spans: DataFrame) -> DataFrame:
    """Hosts, planes, tracks, events and names of a trace."""
    return spans.agg(
        F.count_distinct("host").alias("hosts"), F.count_distinct("plane_id").alias("planes"), F.count_distinct("plane_id", "line_id").alias("tracks"),
        F.count("*").alias("events"), F.count_distinct("name").alias("names"), (F.max(F.col("begin") + F.col("dur")) - F.min("begin")).alias("extent"),
    )


def overview(spans: DataFrame, metrics: DataFrame, off_duty: Column) -> DataFrame:
    """Environment, duty cycle and op totals in one row."""
    duty = iv.duty_cycle(spans, ["plane_id"], off_duty).agg(F.sum("busy").alias("busy"), F.sum("idle").alias("idle"))
    duty = duty.withColumn("duty_percent", 100 * c.safe_divide(F.col("busy"), F.col("busy") + F.col("idle")))
    totals = mt.program_totals(metrics, False).select(F.col("self_time").alias("op_time"), "flops", "bytes")
    return run_environment(spans).join(duty).join(totals)


def overview_top_ops(ops: DataFrame, k: int = 10) -> DataFrame:
    """The k framework ops with the most self time, their share and the running share of all."""
    return mt.rank_cumulative(ops, "self_time", "op_name").where(F.col("rank") <= k).select("rank", "op_name", "op_type", "occurrences", "self_time", "fraction", "cumulative")


def overview_recommendation(verdict: DataFrame) -> DataFrame:
    """What to look at, by what bounds the program (R7's verdict): (bottleneck, statement, tools)."""
    bound = F.col("input_bound")
    tools = F.when(bound.isin("highly", "moderately"), F.array(F.lit("input_pipeline"), F.lit("trace_viewer")))
    tools = tools.when(F.col("output_bound") != "not", F.array(F.lit("trace_viewer"), F.lit("memory_profile"))).otherwise(F.array(F.lit("op_profile"), F.lit("roofline_model")))
    statement = F.when(F.col("output_bound").isin("highly", "moderately") & ~bound.isin("highly"), F.col("output_text")).otherwise(F.col("input_text"))
    return verdict.select(F.when(bound.isin("highly", "moderately"), "input").when(F.col("output_bound") != "not", "output").otherwise("device").alias("bottleneck"), statement.alias("statement"), tools.alias("tools"))


def overview_diagnostics(spans: DataFrame, steps: DataFrame) -> DataFrame:
    """(level, text) warnings about the trace itself: no steps, steps that are not on every
    device, devices without events in any step, spans of negative length."""
    devices = steps.agg(F.count_distinct("plane_id").alias("devices"), F.count_distinct("step").alias("steps"))
    whole = iv.intersect_steps(steps, "plane_id", "step").agg(F.count("*").alias("common"))
    planes = spans.agg(F.count_distinct("plane_id").alias("planes"), F.count_if(F.col("dur") < 0).alias("negative"))
    one = devices.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(planes))
    found = F.array(
        F.when(F.col("steps") == 0, F.lit("No step markers were found; step reports are empty.")),
        F.when((F.col("steps") > 0) & (F.col("common") == 0), F.lit("No step is common to all devices.")),
        F.when((F.col("common") > 0) & (F.col("common") < F.col("steps")), F.format_string("%d of %d steps are not on every device.", F.col("steps") - F.col("common"), F.col("steps"))),
        F.when(F.col("planes") > F.col("devices"), F.format_string("%d devices have events but no steps.", F.col("planes") - F.col("devices"))),
        F.when(F.col("negative") > 0, F.format_string("%d events end before they begin.", F.col("negative"))),
    )
    return one.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("text")).select(F.lit("warning").alias("level"), "text")


def kpi_metrics(spans: DataFrame, metrics: DataFrame, alloc_events: DataFrame, off_duty: Column) -> DataFrame:
    """R2: the headline figures: duty, op time and the peak share of memory."""
    peak = mm.memory_summary(alloc_events).agg((100 * c.safe_divide(F.sum("peak"), F.sum("capacity"))).alias("memory_percent"))
    return overview(spans, metrics, off_duty).select("hosts", "duty_percent", "op_time").join(peak)


def device_information(spans: DataFrame, peaks: DataFrame) -> DataFrame:
    """Device capabilities as rows with units; peaks(capability, gflops, gibps) holds
    known devices, and each plane takes the greatest capability not above its own."""
    d = spans.select("plane_id", F.col("plane_id").alias("wanted")).distinct()
    best = d.join(F.broadcast(peaks), F.col("capability") <= F.col("wanted")).groupBy("plane_id").agg(F.max_by(F.struct("gflops", "gibps"), "capability").alias("p"))
    return best.select("plane_id", F.inline(F.array(
        F.struct(F.lit("peak_flop_rate").alias("metric"), F.col("p.gflops").alias("value"), F.lit("GFLOP/s").alias("unit")),
        F.struct(F.lit("peak_bandwidth").alias("metric"), F.col("p.gibps").alias("value"), F.lit("GiB/s").alias("unit")),
    )))


def _times(df: DataFrame) -> DataFrame:
    """Times in us and their averages per occurrence, from op metrics in ps."""
    total, own = c.pico_to("us", F.col("time")), c.pico_to("us", F.col("self_time"))
    n = F.col("occurrences")
    return df.withColumns({"total_time": total, "avg_time": c.safe_divide(total, n), "total_self_time": own, "avg_self_time": c.safe_divide(own, n)})


def _or_empty(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit("" if kind == "string" else 0).cast(kind)


def hlo_stats(metrics: DataFrame, peaks: dict[str, float]) -> DataFrame:
    """The 29 columns of the ranked op table."""
    df = rl.roofline_columns(mt.rank_cumulative(_times(metrics), "self_time", "symbol_id"), peaks)
    long_name = _or_empty(df, "long_name")
    return df.select(
        "rank", F.col("program_id").cast("string").alias("program_id"), "category", F.col("name").alias("hlo_op_name"), long_name.alias("hlo_op_expression"),
        F.col("provenance").alias("tf_op_name"), "occurrences", "total_time", "avg_time", "total_self_time", "avg_self_time",
        F.col("fraction").alias("total_self_time_percent"), F.col("cumulative").alias("cumulative_total_self_time_percent"),
        c.safe_divide(F.col("dma_stall"), F.col("time")).alias("dma_stall_percent"), "model_flop_rate", F.col("measured_flop_rate").alias("normalized_flop_rate"),
        "measured_memory_bw", "hbm_bw", "cmem_read_bw", "cmem_write_bw", "operational_intensity", "bound_by",
        c.is_rematerialized(long_name, F.col("provenance")).alias("hlo_rematerialization"), c.is_outside_compilation(long_name, F.col("provenance")).alias("outside_compilation"),
        c.yes_no(_or_empty(df, "autotuned", "boolean")).alias("autotuned"), _or_empty(df, "source_info").alias("source_info"), _or_empty(df, "core_type").alias("core_type"),
        _or_empty(df, "parent_op_name").alias("parent_op_name"), _or_empty(df, "vdd_energy", "double").alias("vdd_energy"), "symbol_id",
    )


def framework_op_stats(device: DataFrame, host: DataFrame, peaks: dict[str, float], limit: int = 500, exclude_idle: bool = False) -> DataFrame:
    """The 19 columns of framework ops, the largest of the device before those of the host.
    device and host hold op_name, op_type, occurrences, time, self_time, flops, bytes."""
    out = None
    for side, ops in (("Device", device), ("Host", host)):
        ops = ops.where("op_type <> 'IDLE'") if exclude_idle else ops
        ranked = mt.rank_cumulative(ops, "self_time", "op_name").where(F.col("rank") <= limit).withColumn("host_or_device", F.lit(side))
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    df = rl.roofline_columns(_times(out), peaks)
    on = F.col("host_or_device") == "Device"
    share = lambda column, mine: F.when(mine, F.col(column)).otherwise(F.lit(0.0))
    return df.select(
        "rank", "host_or_device", F.col("op_type").alias("type"), F.col("op_name").alias("operation"), "occurrences", "total_time", "avg_time", "total_self_time",
        "avg_self_time", share("fraction", on).alias("device_total_self_time_percent"), share("cumulative", on).alias("device_cumulative_total_self_time_percent"),
        share("fraction", ~on).alias("host_total_self_time_percent"), share("cumulative", ~on).alias("host_cumulative_total_self_time_percent"),
        "measured_flop_rate", "model_flop_rate", "measured_memory_bw", "operational_intensity", "bound_by",
        F.when(_or_empty(df, "is_eager", "boolean"), "Eager").otherwise("Function").alias("eager"),
    )


def roofline_model(metrics: DataFrame, peaks: dict[str, float], cores: int = 1) -> DataFrame:
    """The columns of the roofline table: the whole program (rank 0) and its ranked ops, with
    and without infeed and outfeed."""
    metrics, out = checkpointed(metrics), None  # read four times
    for infeed in (True, False):
        ops = mt.drop_containers(metrics, infeed)
        sums = {x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(x) for x in ("time", "self_time", "flops", "bytes", "occurrences", "dma_stall")}
        total = ops.agg(*sums.values()).withColumns({"rank": F.lit(0), "name": F.lit("Program"), "category": F.lit("Program"), "fraction": F.lit(0.0), "cumulative": F.lit(0.0)})
        rows = total.unionByName(mt.rank_cumulative(ops, "self_time", "symbol_id"), allowMissingColumns=True).withColumn("include_infeed_outfeed", F.lit(infeed))
        out = rows if out is None else out.unionByName(rows)
    df = rl.roofline_columns(_times(out), peaks)
    df = df.join(F.broadcast(out.where("rank = 0").select("include_infeed_outfeed", F.col("time").alias("_whole"))), "include_infeed_outfeed")  # two rows
    return df.select(
        F.lit("Total").alias("step"), "rank", "category", F.col("name").alias("operation"), "occurrences", "total_time", "avg_time", "total_self_time", "avg_self_time",
        F.col("fraction").alias("total_self_time_percent"), F.col("cumulative").alias("cumulative_total_self_time_percent"),
        c.safe_divide(F.col("dma_stall"), F.col("time")).alias("dma_stall_percent"), "measured_flop_rate", "model_flop_rate", "measured_memory_bw",
        *(f"{m}_bw" for m in rl.MEMORIES), "operational_intensity", *(f"{m}_operational_intensity" for m in rl.MEMORIES), "bottleneck_operational_intensity", "bound_by",
        (F.col("total_time") / cores).alias("total_time_per_core"), c.safe_divide(F.col("time"), F.col("_whole")).alias("total_time_in_percentage"), "optimal_flop_rate",
        "roofline_efficiency", "compute_efficiency", "max_mem_bw_utilization", "include_infeed_outfeed", F.col("program_id").cast("string").alias("hlo_module_id"),
        _or_empty(df, "source_info").alias("source_info"), "symbol_id", "self_time",
    )


def input_pipeline(breakdown: DataFrame, input_categories: list[str], other_categories: list[str]) -> DataFrame:
    """Share of input and other time per step with its summary and the verdict."""
    per = breakdown.groupBy("plane_id", "step").agg(
        F.sum("time").alias("t"), F.sum(F.when(F.col("category").isin(*input_categories), F.col("time")).otherwise(0)).alias("i"),
        F.sum(F.when(F.col("category").isin(*other_categories), F.col("time")).otherwise(0)).alias("o"),
    )
    percent = per.agg((100 * c.safe_divide(F.sum("i"), F.sum("t"))).alias("input_percent"), (100 * c.safe_divide(F.sum("o"), F.sum("t"))).alias("other_percent"), F.count("*").alias("steps"))
    return percent.withColumn("bound", c.input_bound_class(F.col("input_percent"), F.col("other_percent")))


def step_trace(breakdown: DataFrame, step: int | None = None) -> DataFrame:
    """The parts of each step and core as a map, with the largest part."""
    rows = breakdown if step is None else breakdown.where(F.col("step") == step)
    return rows.groupBy("plane_id", "step").agg(
        F.sum("time").alias("dur"), F.max_by("category", F.struct("time", "category")).alias("bottleneck"), F.count("*").alias("parts")
    )


def host_boundness(metrics: DataFrame, idle: int) -> DataFrame:
    """Op time by class, the idle share, and whether the host is to blame."""
    by = mt.time_by_class(metrics)
    out = by.groupBy().agg(F.sum("time").alias("busy"), *(F.coalesce(F.sum(F.when(F.col("class") == k, F.col("time"))), F.lit(0)).alias(k.lower()) for k in ("compute", "HBM", "ICI")))
    ratio = 100 * c.safe_divide(F.lit(idle), F.col("busy") + F.lit(idle))
    return out.withColumn("idle_percent", ratio).withColumn("status", F.when(ratio > 10, "host_bound").otherwise("device_bound"))


def memory_profile(alloc_events: DataFrame, samples: int = 1000) -> DataFrame:
    """The sampled allocator timeline with steps and the op each free belongs to."""
    from spanforge.operators.joins import pair_allocations

    return mm.sample_buckets(pair_allocations(mm.step_carry(alloc_events)), samples)


def memory_capacity(alloc_events: DataFrame) -> DataFrame:
    """Capacity of the largest allocator, and peak, stack, heap, free and fragmentation of
    the one that peaks highest (the first of several), in one row; fragmentation is -1 where events carry none."""
    own = F.col("fragmentation") if "fragmentation" in alloc_events.columns else F.lit(-1.0)
    used = F.col("heap") + F.col("stack")
    top = F.max_by(F.struct("heap", "stack", "free", own.alias("fragmentation")), F.struct(used, "ts", "seq"))
    per = alloc_events.groupBy("allocator").agg(top.alias("t"))
    per = per.select("allocator", "t.*", (F.col("t.heap") + F.col("t.stack")).alias("peak"), (F.col("t.heap") + F.col("t.stack") + F.col("t.free")).alias("capacity"))
    best = per.agg(F.max("capacity").alias("capacity"), F.max_by(F.struct("allocator", "peak", "stack", "heap", "free", "fragmentation"), F.struct("peak", -F.col("allocator"))).alias("t"))
    return best.select("capacity", "t.*", (100 * c.safe_divide(F.col("t.peak"), F.col("capacity"))).alias("utilization_percent"))


def memory_modules(alloc_events: DataFrame, modules: DataFrame) -> DataFrame:
    """Per module span(allocator, seq, name, begin, dur) the events, bytes allocated and freed
    and the highest use while it runs."""
    points = alloc_events.select("allocator", "kind", "bytes", (F.col("heap") + F.col("stack")).alias("used"), F.col("ts").alias("begin"), F.lit(0).cast("bigint").alias("dur"))
    extent = modules.agg(F.percentile_approx("dur", 0.99)).first()[0]  # longer ones go into the wide bins
    pairs = iv.overlap_join(modules.select("allocator", "seq", "name", "begin", "dur"), points, ["allocator"], max(1, extent or 1))
    out = pairs.groupBy("allocator", "seq", "name").agg(
        F.count("*").alias("events"), F.sum(F.when(F.col("r_kind") == "alloc", F.col("r_bytes")).otherwise(0)).alias("allocated"),
        F.sum(F.when(F.col("r_kind") == "free", F.col("r_bytes")).otherwise(0)).alias("freed"), F.max("r_used").alias("peak"),
    )
    return out


def memory_blocks(buffer_events: DataFrame) -> DataFrame:
    """(program_id, buffer_id, size, begin_seq, end_seq, indefinite): every allocation up to the
    next free of its buffer; one that is never freed is indefinite."""
    # the running minimum of what comes later, seen from the end
    w = W.partitionBy("program_id", "buffer_id").orderBy(F.col("seq").desc()).rowsBetween(W.unboundedPreceding, -1)
    freed = F.min(F.when(F.col("kind") == "free", F.col("seq"))).over(w)
    out = buffer_events.withColumn("end_seq", freed).where("kind = 'alloc'")
    return out.select("program_id", "buffer_id", "size", F.col("seq").alias("begin_seq"), "end_seq", F.col("end_seq").isNull().alias("indefinite"))


def memory_indefinite(buffer_events: DataFrame) -> DataFrame:
    """Per program the number and bytes of allocations that are never freed, and the largest."""
    lasting = memory_blocks(buffer_events).where("indefinite")
    return lasting.groupBy("program_id").agg(F.count("*").alias("blocks"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))


def memory_view(buffer_events: DataFrame) -> DataFrame:
    """Heap level of each event in MiB, with the peak of its program."""
    line = mm.buffer_timeline(buffer_events)
    return line.join(mm.heap_peak(line), "program_id").withColumn("level_mib", c.mebibytes(F.col("level")))


def megascale_stats(visits: DataFrame) -> DataFrame:
    """Per rendezvous slack, stall and observed time with the bytes it moves."""
    out = cl.collective_summary(cl.slack_overlap(visits))
    sent = c.transmitted_bytes(F.col("observed"), F.lit(4), F.lit("ALL_REDUCE"))
    return out.withColumn("bytes", sent).withColumn("bytes_text", c.human_bytes(sent))


def megascale_sizes(visits: DataFrame, sizes: DataFrame) -> DataFrame:
    """The summary of each rendezvous with the bytes it moves, by sizes(rendezvous, size, group, type)
    of its transfers, and the bytes per tick of observed time."""
    moved = sizes.groupBy("rendezvous").agg(F.sum(c.transmitted_bytes(F.col("size"), F.col("group"), F.col("type"))).alias("bytes"))
    out = cl.collective_summary(cl.slack_overlap(visits)).join(moved, "rendezvous", "left")
    return out.withColumns({"bytes_text": c.human_bytes(F.col("bytes")), "bytes_per_tick": c.safe_divide(F.col("bytes"), F.col("observed"))})


def megascale_by_step(visits: DataFrame, steps: DataFrame, width: int) -> DataFrame:
    """Visits and time of each rendezvous and opcode per step of its device that holds the
    whole visit; steps(device_id, step, begin, dur)."""
    inside = iv.contained_in(visits.withColumnRenamed("ts", "begin"), steps, ["device_id"], width)
    return inside.groupBy("device_id", F.col("r_step").alias("step"), "rendezvous", "opcode").agg(F.count("*").alias("visits"), F.sum("dur").alias("time"))


def megascale_tracks(visits: DataFrame, width: int) -> DataFrame:
    """All rows of the timeline. Slices: sends and receives with their run id (W13, J9), the receive a
    send flows to (J15) and, for receives, the last send that ends inside (W12). Counters: how many
    visits are under way (A42)."""
    from spanforge.operators.joins import pair_fifo

    runs = visits.withColumn("run", F.when(F.col("opcode") == "send", F.col("seq")))
    rows = cl.infer_run_ids(runs, ["device_id"], "run").drop("run")
    sends = visits.where("opcode = 'send'").select("device_id", "ts", F.col("seq").alias("id"))
    begun = iv.asof_run(visits, sends, ["device_id"], "id").select("device_id", "seq", F.col("run_id").alias("last_run"))
    flows = pair_fifo(visits.where("opcode = 'send'"), visits.where("opcode = 'recv-done'"), ["device_id", "rendezvous"]).select(F.col("producer").alias("seq"), F.col("consumer").alias("flow_to"))
    spans = visits.select("device_id", "seq", "opcode", F.col("ts").alias("begin"), "dur")
    last = iv.mark_last_inside(spans.where("opcode = 'recv-done'"), spans.where("opcode = 'send'"), ["device_id"], width).select("device_id", "seq", F.col("last_seq").alias("last_send"))
    slices = rows.join(begun, ["device_id", "seq"], "left").join(flows, "seq", "left").join(last, ["device_id", "seq"], "left")
    slices = slices.select("device_id", F.concat(F.lit("Megascale: "), "rendezvous").alias("track"), "ts", "dur", F.col("opcode").alias("name"), "seq", "run_id", "last_run", "flow_to", "last_send")
    counters = cl.counter_series(visits, ["device_id"], F.lit(1)).select("device_id", F.lit("Under way").alias("track"), F.col("t").alias("ts"), F.col("level").alias("value"))
    return slices.unionByName(counters, allowMissingColumns=True)


def request_phases(events: DataFrame, requests: DataFrame, kinds: int) -> DataFrame:
    """events(request_id, begin, dur, phase 1..kinds) -> per model and phase the requests that
    have it, the time in which it is the highest active one (0: waiting between events; a decimal, as years of
    microseconds of many requests pass 64 bits), its mean per request and its share."""
    exclusive = iv.priority_timeline(events, ["request_id"], F.col("phase"), kinds)
    per = exclusive.join(requests.select("request_id", "model"), "request_id").groupBy("model", F.col("kind").alias("phase"))
    out = per.agg(F.count("*").alias("requests"), F.sum(F.col("time").cast("decimal(38,0)")).alias("time"), F.avg("time").alias("mean"))
    whole = out.groupBy("model").agg(F.sum("time").alias("_all"))
    return out.join(whole, "model").withColumn("percent", 100 * c.safe_divide(F.col("time").cast("double"), F.col("_all").cast("double"))).drop("_all")


def megascale_timeline(visits: DataFrame, tick: int, limit: int) -> DataFrame:
    """Flows between sends and receives on a timeline with tiny events folded."""
    from spanforge.operators.joins import pair_fifo

    flows = pair_fifo(visits.where("opcode = 'send'"), visits.where("opcode = 'recv-done'"), ["device_id", "rendezvous"])
    rows = cl.hide_tiny(visits.withColumnRenamed("opcode", "name"), ["device_id"], tick, limit)
    return rows.join(flows.select(F.col("producer").alias("seq"), F.col("consumer").alias("flow_to")), "seq", "left")


def inference_profile(requests: DataFrame, batches: DataFrame) -> DataFrame:
    """Per model load, batching and latency percentiles."""
    r = requests.withColumn("latency", F.col("end_ts") - F.col("begin"))
    p = sv.pattern_percentiles(r, "latency", ["request_id"], ["model"]).drop("count")
    return sv.serving_stats(requests, batches).join(p, "model").join(sv.throughput_latency(requests, ["model"]).select("model", "per_second"), "model")


def kernel_utilization(counters: DataFrame, formulas: DataFrame, busy_metric: str, kernel: int | None = None) -> DataFrame:
    """Each unit of a kernel (or of all) in percent of its peak, with the anomaly flag."""
    out = ct.kernel_utilization(counters, formulas, busy_metric)
    return out if kernel is None else out.where(F.col("kernel") == kernel)


def utilization_viewer(counters: DataFrame, formulas: DataFrame) -> DataFrame:
    """Achieved against peak of each unit in percent."""
    out = ct.hw_utilization(ct.counter_values(counters, "sum"), formulas)
    return out.withColumn("percent", 100 * c.safe_divide(F.col("achieved"), F.col("peak")))


def module_info(ops: DataFrame) -> DataFrame:
    """Modules with the number of ops and categories."""
    return ops.groupBy("program_id").agg(F.count("*").alias("ops"), F.count_distinct("category").alias("categories"), F.sum("flops").alias("flops"))


def find_instruction(ops: DataFrame, name: str) -> DataFrame:
    """Ops of one name."""
    return ops.where(F.col("name") == name)


def event_details(spans: DataFrame, name: str, begin: int, dur: int) -> DataFrame:
    """All columns of the events with this name, time and duration, as JSON."""
    hit = spans.where((F.col("name") == name) & (F.col("begin") == begin) & (F.col("dur") == dur))
    return hit.select("seq", F.to_json(F.struct(*spans.columns)).alias("args"))


def event_stack(spans: DataFrame, name: str, begin: int, dur: int, by: list[str]) -> DataFrame:
    """For the events with this name, time and duration the frames of their track that enclose
    them, outermost first: (seq, stack)."""
    hit = spans.where((F.col("name") == name) & (F.col("begin") == begin) & (F.col("dur") == dur)).select(*by, "seq")
    outer = spans.where((F.col("begin") <= begin) & (F.col("begin") + F.col("dur") >= begin + dur))
    outer = outer.select(*by, F.struct("begin", (-F.col("dur")).alias("shorter"), F.col("seq").alias("frame"), "name").alias("frame"))
    frames = F.array_sort(F.collect_list(F.when(F.col("frame.frame") != F.col("seq"), F.col("frame"))))
    return hit.join(outer, by).groupBy("seq").agg(F.transform(frames, lambda x: x["name"]).alias("stack"))


RULES: dict[str, tuple[Callable[[DataFrame], Column], str]] = {}


def rule(name: str, condition: Callable[[DataFrame], Column], text: str) -> None:
    """Registers a suggestion: a condition over the one-row facts table and its text."""
    RULES[name] = (condition, text)


# fixed values: thresholds of the rules, in percent
for _name, _fact, _op, _limit, _text in (
    ("input_bound", "input_percent", ">", 10, "The input pipeline holds the device up."),
    ("memory_bound", "hbm_percent", ">", 70, "Memory bandwidth is close to its limit."),
    ("compute_bound", "mxu_percent", ">", 70, "The matrix units are close to their limit."),
    ("collective_bound", "collective_percent", ">", 20, "Collectives take a large part of each step."),
    ("data_shuffle_bound", "shuffle_percent", ">", 20, "Data movement between ops takes a large part of each step."),
    ("idle", "idle_percent", ">", 20, "The device is idle for much of the time."),
    ("memory_capacity", "memory_percent", ">", 90, "Memory is nearly full at its peak."),
    ("debug_print", "debug_percent", ">", 5, "Debugging ops take time."),
    ("sparse_core_bound", "sparse_percent", ">", 30, "The sparse core is the bottleneck."),
    ("barrier_cores", "barrier_percent", ">", 3, "Cores wait for each other at barriers."),
    ("low_duty", "duty_percent", "<", 50, "The device works less than half of the time."),
    ("stragglers", "straggler_hosts", ">", 0, "Some hosts are slower than the others."),
):
    rule(_name, lambda df, f=_fact, o=_op, k=_limit: F.expr(f"{f} {o} {k}") if f in df.columns else F.lit(False), _text)


def suggestions(facts: DataFrame) -> DataFrame:
    """The suggestions whose rule holds for the one-row facts table; missing facts hold
    nothing."""
    rows = [F.struct(F.lit(n).alias("rule"), F.lit(t).alias("text"), F.coalesce(f(facts), F.lit(False)).alias("on")) for n, (f, t) in RULES.items()]
    return facts.select(F.inline(F.array(*rows))).where("on").select("rule", "text")


def reports() -> dict[str, Callable[..., DataFrame]]:
    """Every report by name."""
    found = (
        overview, overview_top_ops, overview_recommendation, overview_diagnostics, megascale_sizes, megascale_by_step, megascale_tracks, request_phases, memory_capacity, memory_modules, memory_blocks, memory_indefinite, kpi_metrics, device_information, hlo_stats, framework_op_stats, roofline_model, input_pipeline, step_trace, host_boundness, memory_profile,
        memory_view, megascale_stats, megascale_timeline, inference_profile, utilization_viewer, kernel_utilization, module_info, find_instruction, event_details, event_stack, suggestions,
    )
    per_step = (
        steps.pod_view, steps.input_pipeline_steps, steps.input_pipeline_summary, steps.input_pipeline_verdict, steps.host_breakdown, steps.bottleneck_assessment,
        steps.step_trace_view, steps.step_trace_summary, steps.boundness, steps.roofline_steps, steps.facts,
    )
    return {f.__name__: f for f in (*found, *per_step)}
