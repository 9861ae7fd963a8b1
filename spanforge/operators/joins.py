"""Equi joins of trace tables: dictionaries, flows, launches, pairings, graph hops."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanforge.plans.work import checkpointed


def with_meta(spans: DataFrame, meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans with their dictionary entry."""
    return spans.join(meta, list(keys))


def with_op_template(events: DataFrame, ops: DataFrame) -> DataFrame:
    """Events with the op of (program, symbol); symbol 0 and unknown ops drop out."""
    return events.where("symbol_id <> 0").join(ops, ["program_id", "symbol_id"])


def with_program_info(spans: DataFrame, ops: DataFrame, keys: Sequence[str] = ("program_id", "name"), order: str = "symbol_id") -> DataFrame:
    """Each span with the first op of its program and name (null if none)."""
    first = ops.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")
    return spans.join(first, list(keys), "left")


def connect_flows(links: DataFrame, cap: int = 64) -> DataFrame:
    """links(role, kind, ctx_id, pid, span) -> (producer, consumer) pairs of a key; a key
    with cap or more on both sides is no flow but a broadcast context and gives none, so a
    key's pairs stay below cap times its links."""
    key = ["kind", "ctx_id", "pid"]
    p = links.where("role = 'producer'").select(*key, F.col("span").alias("producer"))
    c = links.where("role = 'consumer'").select(*key, F.col("span").alias("consumer"))
    n = links.groupBy(*key).agg(F.count_if(F.col("role") == "producer").alias("np"), F.count_if(F.col("role") == "consumer").alias("nc"))
    few = n.where((F.col("np") > 0) & (F.col("nc") > 0) & ((F.col("np") < cap) | (F.col("nc") < cap))).select(*key)
    return p.join(few, key).join(c, key).select("producer", "consumer")


def connect_launches(launches: DataFrame, executes: DataFrame) -> DataFrame:
    """(launch, execute) by correlation_id; the last launch of an id wins."""
    last = launches.groupBy("correlation_id").agg(F.max_by("seq", F.struct("begin", "seq")).alias("launch"))
    return executes.join(last, "correlation_id").select("launch", F.col("seq").alias("execute"))


def pair_start_end(df: DataFrame, start: Column, end: Column, key: Sequence[str]) -> DataFrame:
    """The last start and the last end of an id with start before end, as one span."""
    last = F.struct("begin", "dur", "seq")
    both = df.groupBy(*key).agg(F.max(F.when(start, last)).alias("s"), F.max(F.when(end, last)).alias("e"))
    both = both.where(F.col("s.begin") < F.col("e.begin"))
    return both.select(*key, F.col("s.begin").alias("begin"), (F.col("e.begin") + F.col("e.dur") - F.col("s.begin")).alias("dur"))


#: Rows that one task of a large distinct holds.
ROWS = 500_000


def fan_out_groups(df: DataFrame, edges: DataFrame) -> DataFrame:
    """Each row for its own group and for every parent group of it; tasks grow in number with the rows, not in size."""
    up = df.join(edges.select(F.col("child_group").alias("group_id"), "parent_group"), "group_id")
    out = checkpointed(df.unionByName(up.withColumn("group_id", F.col("parent_group")).select(*df.columns)))
    return out.repartition(out.count() // ROWS + 1, *df.columns).distinct()


def pair_allocations(events: DataFrame) -> DataFrame:
    """A free inherits op from the first allocation of its address since the last free."""
    w = W.partitionBy("allocator", "address").orderBy("ts", "seq")
    frees = F.coalesce(F.sum(F.when(F.col("kind") == "free", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    e = W.partitionBy("allocator", "address", "_epoch").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    out = events.withColumn("_epoch", frees)
    alloc_op = F.first(F.when(F.col("kind") == "alloc", F.col("op")), True).over(e)
    return out.withColumn("paired_op", F.when(F.col("kind") == "free", alloc_op).otherwise(F.col("op"))).drop("_epoch")


def pair_fifo(producers: DataFrame, consumers: DataFrame, key: Sequence[str]) -> DataFrame:
    """The k-th producer with the k-th consumer of a key, in (ts, seq) order."""
    w = W.partitionBy(*key).orderBy("ts", "seq")
    p = producers.select(*key, F.col("seq").alias("producer"), F.row_number().over(w).alias("_k"))
    c = consumers.select(*key, F.col("seq").alias("consumer"), F.row_number().over(w).alias("_k"))
    return p.join(c, [*key, "_k"]).drop("_k")


def has_async_parent(consumers: DataFrame, producers: DataFrame, key: Sequence[str]) -> DataFrame:
    """Consumers whose key some producer has."""
    return consumers.join(producers.select(*key), list(key), "left_semi")


def drop_batch_groups(requests: DataFrame, batches: DataFrame, key: Sequence[str]) -> DataFrame:
    """Requests whose group is no batch group."""
    return requests.join(batches.select(*key), list(key), "left_anti")


def keep_steps_with_ops(steps: DataFrame, ops: DataFrame, key: Sequence[str]) -> DataFrame:
    """Step markers that have ops."""
    return steps.join(ops.select(*key), list(key), "left_semi")


def with_fused_children(metrics: DataFrame, members: DataFrame, depth: int = 2, budget: int = 100, skip: Sequence[str] = ("parameter", "tuple", "get-tuple-element")) -> DataFrame:
    """members(fusion, op, opcode) attached under each op, level by level to depth, at
    most budget per op and level; (name, child, level)."""
    inner = members.where(~F.col("opcode").isin(*skip)).select(F.col("fusion").alias("_parent"), F.col("op").alias("child"))
    level, out = metrics.select("name", F.col("name").alias("_parent")).distinct(), None
    for k in range(1, depth + 1):
        level = level.join(inner, "_parent").withColumn("_r", F.row_number().over(W.partitionBy("name").orderBy("child", "_parent")))
        level = level.where(F.col("_r") <= budget).select("name", "child", F.lit(k).alias("level"))
        out = level if out is None else out.unionByName(level)
        level = level.select("name", F.col("child").alias("_parent"))
    return out


def neighborhood(edges: DataFrame, root: str, radius: int) -> DataFrame:
    """(op, dist) of all ops within radius edges of root, in either direction."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = edges.sparkSession.createDataFrame([(root, 0)], "op string, dist int")
    frontier = seen
    for d in range(1, radius + 1):
        step = both.join(frontier.select(F.col("op").alias("src")), "src").select(F.col("dst").alias("op")).distinct()
        frontier = checkpointed(step.join(seen, "op", "left_anti").withColumn("dist", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def with_batching_params(models: DataFrame, params: DataFrame) -> DataFrame:
    """Parameters labelled {model_name=...} for every model id 'name' or 'name:version'."""
    p = params.withColumn("model_name", F.regexp_extract("label", r"\{model_name=([^}]*)\}", 1))
    return models.withColumn("model_name", F.substring_index("model", ":", 1)).join(p, "model_name")


def union_hosts(parts: Sequence[DataFrame], core: str = "core") -> DataFrame:
    """The traces of several hosts in one table; core ids become host * 1000 + core."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn(core, F.lit(1000 * k).cast("bigint") + F.col(core))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def adjacent(edges: DataFrame, through: Callable[[Column], Column]) -> DataFrame:
    """edges(src, dst) between the ops that are not passed through (a condition on an op's name, such as that of get-tuple-element
    ops), one for every way whose inner ops all are. Chains are followed by pointer jumping: each round doubles the length of what every op knows above
    it, so rounds grow with the logarithm of the longest chain."""
    passed = lambda name: through(F.col(name))
    pairs = edges.where(passed("dst")).select(F.col("dst").alias("op"), F.col("src").alias("above"))
    pairs = checkpointed(pairs.withColumn("_open", passed("above")))
    while not pairs.where("_open").isEmpty():
        jump = pairs.where("_open").select("op", F.col("above").alias("_mid")).join(pairs.select(F.col("op").alias("_mid"), "above", "_open"), "_mid").drop("_mid")
        pairs = checkpointed(pairs.where("not _open").unionByName(jump))
    ends = edges.where(~passed("dst"))
    direct = ends.where(~passed("src")).select("src", "dst")
    return direct.unionByName(ends.where(passed("src")).join(pairs.select(F.col("op").alias("src"), "above"), "src").select(F.col("above").alias("src"), "dst"))

