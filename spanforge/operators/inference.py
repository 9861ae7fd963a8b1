"""Requests and batches of a serving job, built from the host's grouped events.

Events are those of groups (J21); a batch's group has its requests' groups as parents. A request's time is the extent of its events and
of its batch. Moments stamped in a batch's group count for all its requests. Each request's phases become spans, and the highest one that
is active takes the time (W6).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanforge.operators.intervals import priority_timeline
from spanforge.plans.work import checkpointed

#: Names of events (fixed values).
USER_REQUEST = "ModelServerRequest_"
BATCHING = "BatchingSessionRun"
REQUEST_KINDS = (("TfrtModelRun",), ("ServingModelRun",), ("SessionRun", "RunGraph"))
MODEL_EVENTS = ("SessionRun", "TfrtModelRun", "ServingModelRun")
SCHEDULE = ("ScheduleWithSplit", "ScheduleWithoutSplit", "ScheduleWithEagerSplit", "ASBSQueue::Schedule")
PROCESS_BATCH = ("ProcessBatch", "OrbaxServing::ProcessBatch")
PADDING = ("ConcatInputTensors", "OrbaxServing::ConcatInputBuffers", "MergeInputTensors", "BrainSessionRun")
READS, WRITES = ("ReadHbm", "TransferD2HRequest"), ("WriteHbm", "TransferH2DRequest", "TransferPreprocessedH2DRequest")
SYSTEM_TRANSFER = "tpu::System::Transfer{}Device=>IssueEvent"
EXECUTE = ("TPUPartitionedCallOp-ExecuteLocal", "TPUPartitionedCallOp-ExecuteRemote", "TPUPartitionedCallOp-InitializeVarOnTPU", "tpu::System::Execute")
LAUNCH, CALLBACK = ("DoEnqueueProgram", "DoEnqueueContinuationProgram"), ("CompleteCallbacks",)

#: Phases of a request, the higher ones first in line for the time.
PHASES = ("preprocess", "postprocess", "batch_formation", "runtime", "write", "read", "compute_32", "compute_16")
#: host events: text and numbers are stats of the event, null where it has none.
EVENTS = "group_id bigint, name string, begin bigint, dur bigint, seq bigint, root bigint, model string, task_size bigint, padding bigint, padded_size bigint, consumer bigint"


def _rank(names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), F.col("name"))


def _last(events: DataFrame, names: tuple[str, ...], value: str, by: str = "group_id") -> DataFrame:
    """(by, value) of the last event of the names, taken name by name."""
    return events.where(F.col("name").isin(*names) & F.col(value).isNotNull()).groupBy(by).agg(F.max_by(value, F.struct(_rank(names), F.col("seq"))).alias(value))


def _request_groups(events: DataFrame) -> DataFrame:
    """(group_id, user): groups that are requests, and whether only a root makes them one."""
    batches = events.where(F.col("name").isin(*PROCESS_BATCH)).select("group_id").distinct()
    present = events.agg(F.bool_or(F.col("name") == BATCHING).alias("b"), *(F.bool_or(F.col("name") == k[0]).alias(f"k{i}") for i, k in enumerate(REQUEST_KINDS[:2])))
    kinds = F.when(F.col("b"), F.array(F.lit(BATCHING)))
    for i, names in enumerate(REQUEST_KINDS[:2]):
        kinds = kinds.when(F.col(f"k{i}"), F.array(*map(F.lit, names)))
    kinds = present.select(kinds.otherwise(F.array(*map(F.lit, REQUEST_KINDS[2]))).alias("_kinds"), F.coalesce("b", F.lit(False)).alias("_batching"))
    marked = events.crossJoin(kinds).withColumn("_kind", F.array_contains("_kinds", F.col("name"))).where(F.col("_kind") | _is_root())
    out = marked.groupBy("group_id").agg((~F.bool_or("_kind")).alias("user"), F.first("_batching").alias("batching"))
    return out.join(batches, "group_id", "left_anti")


def _is_root() -> Column:
    return F.coalesce((F.col("root") == -1) | ((F.col("root") == 1) & F.col("name").startswith(USER_REQUEST)), F.lit(False))


def _models(events: DataFrame) -> DataFrame:
    """(group_id, model): the model named last, roots after all others."""
    named = events.where((F.col("name").isin(*MODEL_EVENTS) | _is_root()) & F.col("model").isNotNull())
    place = F.when(_is_root(), len(MODEL_EVENTS) + 1).otherwise(_rank(MODEL_EVENTS))
    return named.groupBy("group_id").agg(F.max_by("model", F.struct(place, F.col("seq"))).alias("model"))


def build_requests(events: DataFrame, relations: DataFrame, device: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Host events (EVENTS), relations(parent_group, child_group) and device(group_id, begin, dur, half) ->
    requests(request_id, model, begin, end_ts, delay, size, batches, a column of time per phase, idle) and
    batches(batch_id, model, begin, end_ts, delay, size, padding, requests, device_time).

    With batching, a request has the model of its first batch; one that only a root makes has its own model, or the one that all its
    batches share. Requests of no length are left out. Events without a group belong to none."""
    events = events.where("group_id is not null")
    relations = checkpointed(relations.select("parent_group", "child_group").distinct())
    models = checkpointed(_models(events))
    groups = _request_groups(events)
    up = relations.select(F.col("parent_group").alias("group_id"), "child_group").join(models.select(F.col("group_id").alias("child_group"), F.col("model").alias("m")), "child_group", "left")
    children = up.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("child_group", "m"))).alias("kids"))
    extent = events.groupBy("group_id").agg(F.min("begin").alias("begin"), F.max(F.col("begin") + F.col("dur")).alias("end_ts"))
    first = F.get("kids", F.lit(0))["m"]
    named = F.filter(F.transform("kids", lambda x: x["m"]), lambda x, i: F.exists(F.slice("kids", F.lit(1), i + 1), lambda y: y["m"].isNotNull()))
    common = F.when(F.forall(named, lambda x: x.eqNullSafe(F.get(named, F.lit(0)))), F.get(named, F.lit(0)))
    requests = groups.join(children, "group_id", "left").join(models, "group_id", "left").join(extent, "group_id")
    model = F.when(F.col("batching") & ~F.col("user"), first).when(F.col("user") & F.col("model").isNull(), common).otherwise(F.col("model"))
    requests = requests.join(_last(events, SCHEDULE, "task_size"), "group_id", "left")
    requests = checkpointed(requests.select(F.col("group_id").alias("request_id"), model.alias("model"), "begin", "end_ts", F.coalesce("task_size", F.lit(0)).alias("size"), F.coalesce(F.transform("kids", lambda x: x["child_group"]), F.array().cast("array<bigint>")).alias("batches")))

    both = F.struct(_rank(PROCESS_BATCH), F.col("seq"))
    batches = events.where(F.col("name").isin(*PROCESS_BATCH)).groupBy("group_id").agg(F.max_by(F.struct("begin", (F.col("begin") + F.col("dur")).alias("end_ts")), both).alias("t"))
    padded = events.where(F.col("name").isin(*PADDING) & F.col("padding").isNotNull() & F.col("padded_size").isNotNull())
    padded = padded.groupBy("group_id").agg(F.max_by(F.struct("padding", "padded_size"), F.struct(_rank(PADDING), F.col("seq"))).alias("p"))
    batches = batches.join(padded, "group_id", "left").select(F.col("group_id").alias("batch_id"), "t.*", F.coalesce("p.padded_size", F.lit(0)).alias("size"), F.coalesce("p.padding", F.lit(0)).alias("padding"))
    parents = relations.select(F.col("child_group").alias("batch_id"), F.col("parent_group").alias("request_id"))
    every = parents.groupBy("batch_id").agg(F.count("*").alias("requests"), F.min("request_id").alias("first_id"))
    batches = checkpointed(batches.join(every, "batch_id"))

    # a request waits for its first batch and lasts until its end; a batch has waited since its first request began
    taken = requests.select("request_id", F.posexplode("batches").alias("at", "batch_id")).join(batches.select("batch_id", F.col("begin").alias("b"), F.col("end_ts").alias("e")), "batch_id")
    taken = taken.groupBy("request_id").agg(F.min_by(F.struct("b", "e"), "at").alias("x"))
    requests = requests.join(taken, "request_id", "left").withColumn("delay", F.coalesce(F.col("x.b") - F.col("begin"), F.lit(0))).withColumn("end_ts", F.greatest("end_ts", F.coalesce("x.e", "end_ts"))).drop("x")
    requests = checkpointed(requests)
    since = parents.join(requests.select("request_id", F.col("begin").alias("since"), "model"), "request_id")
    low = since.groupBy("batch_id").agg(F.min("since").alias("since"))
    owner = batches.select("batch_id", F.col("first_id").alias("request_id")).join(requests.select("request_id", "model"), "request_id").select("batch_id", "model")
    compute = _device_spans(device)
    own = priority_timeline(compute.withColumnRenamed("group_id", "batch_id").join(batches.select("batch_id"), "batch_id", "left_semi"), ["batch_id"], F.col("phase"), len(PHASES)).where("kind > 0").groupBy("batch_id").agg(F.sum("time").alias("device_time"))
    batches = batches.join(low, "batch_id", "left").join(owner, "batch_id", "left").join(own, "batch_id", "left")
    batches = batches.select("batch_id", "model", "begin", "end_ts", F.coalesce(F.col("begin") - F.col("since"), F.lit(0)).alias("delay"), "size", "padding", "requests", F.coalesce("device_time", F.lit(0)).alias("device_time"))

    spans = _phases(events, requests, relations, compute)
    times = priority_timeline(spans, ["request_id"], F.col("phase"), len(PHASES))
    columns = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("time"))), F.lit(0)).alias(name) for k, name in enumerate(("idle", *PHASES))]
    out = requests.where("end_ts > begin").join(times.groupBy("request_id").agg(*columns), "request_id", "left").na.fill(0, ["idle", *PHASES])
    return out.select("request_id", "model", "begin", "end_ts", "delay", "size", "batches", *PHASES, "idle"), batches


def _device_spans(device: DataFrame) -> DataFrame:
    phase = F.when(F.coalesce("half", F.lit(False)), PHASES.index("compute_16") + 1).otherwise(PHASES.index("compute_32") + 1)
    return device.where("group_id is not null").select("group_id", phase.alias("phase"), "begin", "dur")


def _phases(events: DataFrame, requests: DataFrame, relations: DataFrame, compute: DataFrame) -> DataFrame:
    """(request_id, phase, begin, dur): the spans of each request's phases."""
    number = {name: k + 1 for k, name in enumerate(PHASES)}
    span = lambda phase, begin, end: (F.lit(number[phase]).alias("phase"), begin.alias("begin"), F.greatest(end - begin, F.lit(0)).alias("dur"))
    ids = requests.select("request_id")
    targets = relations.select(F.col("child_group").alias("group_id"), F.col("parent_group").alias("request_id")).unionByName(ids.select(F.col("request_id").alias("group_id"), "request_id")).distinct()
    targets = checkpointed(targets.join(ids, "request_id", "left_semi"))
    moves = events.where(F.col("name").isin(*READS, *WRITES)).select("group_id", F.when(F.col("name").isin(*READS), number["read"]).otherwise(number["write"]).alias("phase"), "begin", "dur")
    for way, phase in (("To", "write"), ("From", "read")):
        name = SYSTEM_TRANSFER.format(way)
        last = F.max_by(F.struct("group_id", "begin", "dur"), "seq")
        start = events.where((F.col("name") == name) & F.col("consumer").isNotNull()).groupBy("consumer").agg(last.alias("s"))
        done = events.where((F.col("name") == name + "=>Done") & F.col("consumer").isNotNull()).join(start, "consumer").where("s.begin < begin")
        done = done.groupBy("consumer").agg(F.first("s").alias("s"), F.max_by(F.struct("begin", "dur"), "seq").alias("d"))
        moves = moves.unionByName(done.select(F.col("s.group_id").alias("group_id"), *span(phase, F.col("s.begin"), F.col("d.begin") + F.col("d.dur"))))
    out = moves.unionByName(compute).join(targets, "group_id").select("request_id", "phase", "begin", "dur")
    stamps = targets
    for label, names in (("schedule", SCHEDULE), ("execute", EXECUTE), ("callback", CALLBACK), ("concat", PADDING)):
        stamps = stamps.join(_last(events, names, "begin").withColumnRenamed("begin", label), "group_id", "left")
    launched = events.where(F.col("name").isin(*LAUNCH)).groupBy("group_id").agg(F.min("begin").alias("launch"))
    stamps = checkpointed(stamps.join(launched, "group_id", "left"))
    out = out.unionByName(stamps.where("execute is not null and launch is not null").select("request_id", *span("runtime", F.col("execute"), F.col("launch"))))
    device_end = out.where(F.col("phase") == number["compute_32"]).groupBy("request_id").agg(F.max(F.col("begin") + F.col("dur")).alias("device_end"))
    per = stamps.groupBy("request_id").agg(
        F.min("execute").alias("execute"), F.min("concat").alias("concat"), F.max("callback").alias("callback"), F.min_by("schedule", F.when(F.col("schedule").isNotNull(), F.col("group_id"))).alias("schedule"),
    ).join(device_end, "request_id", "left").join(requests.select("request_id", F.col("begin").alias("b"), F.col("end_ts").alias("e")), "request_id")
    after = F.coalesce("callback", "device_end")
    parts = [("preprocess", F.col("b"), F.col("execute")), ("postprocess", after, F.col("e")), ("batch_formation", F.col("schedule"), F.col("concat"))]
    for phase, begin, end in parts:
        out = out.unionByName(per.where(begin.isNotNull() & end.isNotNull()).select("request_id", *span(phase, begin, end)))
    return out
