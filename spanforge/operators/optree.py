"""The op profile as a tree, one row per node, and views of it.

Every op adds to the nodes on its path, all at once by its prefixes: root, program, scopes of the provenance, category, duplicates
of one op, op. Then children beyond the largest k of a node fall out with all below them, a node of duplicates with one op
left gives way to it, one with several is called after the largest, and what stays is put in pre-order by the ranks on the way
from the root. Trees are tables of nodes throughout; the only steps by row number are over the children of one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanforge.functions import columns as c

#: By grouping: the name of the root, and up to which depth all children stay.
GROUPINGS = {"program": ("by_program", 2), "category": ("by_category", 1), "provenance": ("by_provenance", 100)}
IDLE = "IDLE"
SUMS = ("self_time", "time", "flops", "bytes", "occurrences")
_DUPLICATES = " and its duplicate(s)"


def _step(kind: str, key: Column, label: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(kind + ":"), key).alias("key"), label.alias("label"))


def op_tree(metrics: DataFrame, by: str = "program", k: int = 100, exclude_idle: bool = False, total: Column | None = None) -> DataFrame:
    """metrics(program_id, symbol_id, name, category, provenance, self_time, time, flops, bytes, occurrences[, program, dedup_name]) ->
    (place, depth, name, names, kind, category, self_time, time, flops, bytes, occurrences, n_children), place being the pre-order as an
    array of ranks and names the labels from the root on.

    Root, programs and scopes sum self times, and flops and bytes of ops that hold no others; categories, duplicates and ops sum all. Ops that hold
    others count for root and program only. Children come by time, then by name and program; the root's time is total (an aggregate), else the sum.
    Ops called region... are left out, IDLE hangs below the root."""
    root, whole = GROUPINGS[by]
    rows = metrics.where(~F.col("name").startswith("region"))
    rows = rows.where(F.col("category") != IDLE) if exclude_idle else rows
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    idle, inner = F.col("category") == IDLE, F.col("time") > F.col("self_time")
    program = F.concat(F.col("program"), F.lit("("), text("program_id"), F.lit(")")) if "program" in metrics.columns else F.lit(None).cast("string")
    steps = [F.when(~idle, F.array(_step("program", text("program_id"), F.coalesce(program, F.lit("main")))))] if by != "category" else []
    if by == "provenance":
        parts = F.filter(F.split(text("provenance"), "/"), lambda x: x != "")
        named = F.transform(parts, lambda x, i: F.when(i == F.size(parts) - 1, F.substring_index(x, ":", 1)).otherwise(x))
        steps.append(F.when(~idle & ~inner, F.transform(named, lambda x: _step("scope", x, x))))
    dedup = F.coalesce(F.nullif("dedup_name", F.lit("")), F.col("name")) if "dedup_name" in metrics.columns else F.col("name")
    steps.append(F.when(~idle & ~inner, F.array(_step("category", text("category"), F.col("category")), _step("duplicates", dedup, dedup))))
    steps.append(F.when(idle | ~inner, F.array(_step("op", F.concat_ws("/", text("program_id"), text("symbol_id"), "name"), F.col("name")))))
    none = F.array().cast("array<struct<kind:string,key:string,label:string>>")
    path = F.concat(F.array(_step("root", F.lit(""), F.lit(root))), *(F.coalesce(s, none) for s in steps))
    every = rows.select(*SUMS, "category", inner.alias("_inner"), path.alias("_path"))
    at = F.posexplode("_path").alias("depth", "step")
    every = every.select(*SUMS, "category", "_inner", at, F.col("_path.key").alias("_keys"), F.col("_path.label").alias("_names"))
    every = every.withColumns({"keys": F.slice("_keys", F.lit(1), F.col("depth") + 1), "names": F.slice("_names", F.lit(1), F.col("depth") + 1)})
    upper = F.col("step.kind").isin("root", "program", "scope")
    leaf_only = lambda x: F.when(~upper | ~F.col("_inner"), F.col(x)).otherwise(0)
    sums = {"self_time": F.col("self_time"), "time": F.when(upper, F.col("self_time")).otherwise(F.col("time")), "flops": leaf_only("flops"), "bytes": leaf_only("bytes"), "occurrences": F.when(upper, 0).otherwise(F.col("occurrences"))}
    nodes = every.groupBy("keys").agg(
        F.first("depth").alias("depth"), F.first("step.kind").alias("kind"), F.first("step.label").alias("name"), F.first("names").alias("names"),
        F.min(F.when(F.col("step.kind").isin("category", "duplicates", "op"), F.col("category"))).alias("category"), *(F.sum(x).cast("bigint").alias(s) for s, x in sums.items()),
    )
    if total is not None:
        nodes = nodes.crossJoin(metrics.agg(total.cast("bigint").alias("_total"))).withColumn("time", F.when(F.col("depth") == 0, F.col("_total")).otherwise(F.col("time"))).drop("_total")
    return _pruned(nodes, k, whole)


def _parent(keys: str = "keys") -> Column:
    return F.expr(f"slice({keys}, 1, size({keys}) - 1)")


def _pruned(nodes: DataFrame, k: int, whole: int) -> DataFrame:
    siblings = W.partitionBy("_parent").orderBy(F.col("time").desc(), "name", "keys")
    ranked = nodes.withColumn("_parent", _parent()).withColumn("_rank", F.row_number().over(siblings)).withColumn("_stays", (F.col("depth") <= whole) | (F.col("_rank") <= k))
    count = ranked.groupBy(F.col("_parent").alias("keys")).agg(F.count("*").alias("n_children"), F.min_by("name", "_rank").alias("_top"), F.count_if("_stays").alias("_kept"))
    # a node stays if all nodes on its way do; their ranks are its place
    above = ranked.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("keys")), lambda i: F.slice("keys", F.lit(1), i))).alias("prefix"), "keys")
    way = above.join(ranked.select(F.col("keys").alias("prefix"), "_rank", "_stays"), "prefix").groupBy("keys").agg(
        F.bool_and("_stays").alias("_alive"), F.array_sort(F.collect_list(F.struct(F.size("prefix").alias("d"), F.col("_rank").alias("r")))).alias("w"),
    )
    out = ranked.join(way.where("_alive").select("keys", F.col("w.r").alias("place")), "keys").join(count, "keys", "left").na.fill(0, ["n_children", "_kept"])
    # a node of duplicates with one op gives way to it
    lone = count.where("_kept = 1").select(F.col("keys").alias("_parent"), F.lit(True).alias("_lone"))
    out = out.where("not (kind = 'duplicates' and _kept = 1)").join(lone, "_parent", "left")
    rises = F.coalesce(F.col("_lone"), F.lit(False)) & (F.col("kind") == "op") & F.element_at("keys", -2).startswith("duplicates:")
    shown = F.when((F.col("kind") == "duplicates") & (F.col("_kept") > 1), F.concat("_top", F.lit(_DUPLICATES))).otherwise(F.col("name"))
    shorter = lambda x: F.expr(f"slice({x}, 1, size({x}) - 1)")
    # labels on the way: those of duplicates are the shown ones, which only ops are below of
    twin = F.when(F.element_at("keys", -2).startswith("duplicates:"), F.expr("slice(names, 1, size(names) - 2)"))
    top = out.where("kind = 'duplicates'").select(F.col("keys").alias("_parent"), shown.alias("_shown"))
    out = out.join(top, "_parent", "left")
    names = F.when(rises, F.concat(twin, F.array("name"))).when(F.col("_shown").isNotNull(), F.concat(twin, F.array("_shown", "name"))).otherwise(F.concat(shorter("names"), F.array(shown)))
    return out.select(
        F.when(rises, shorter("place")).otherwise(F.col("place")).alias("place"), F.when(rises, F.col("depth") - 1).otherwise(F.col("depth")).cast("int").alias("depth"),
        shown.alias("name"), names.alias("names"), "kind", "category", *SUMS, "n_children",
    )


def tree_leaves(tree: DataFrame) -> DataFrame:
    """(name, category, time, occurrences, flops, bytes, place) of the nodes with time and none below them that has any: name is the way from the root."""
    spent = tree.where("time > 0")
    above = spent.where("depth > 0").select(_parent("place").alias("place")).distinct()
    out = spent.join(above, "place", "left_anti")
    return out.select(F.array_join("names", "/").alias("name"), F.coalesce("category", F.lit("unknown")).alias("category"), "time", F.greatest("occurrences", F.lit(1)).alias("occurrences"), "flops", "bytes", "place")


def op_profile_views(tree: DataFrame, view: str = "grouped", sort_by: str = "time", category: str | None = None, top_n: int = 15, path: str = "", depth: int = 2) -> DataFrame:
    """Flat (the top leaves), category (sums per category), grouped (the top five leaves, or fewer, of each category) or tree (nodes
    below path, so many levels deep). A category, by part of its name, gives its leaves with their share. top_n 0 is no limit."""
    if view not in ("flat", "category", "summary", "grouped", "tree") or sort_by not in ("time", "flops", "bytes"):
        raise ValueError(f"view {view!r} by {sort_by!r}")
    if view == "tree" and category is None:
        return _below(tree, path, depth)
    leaves = tree_leaves(tree)
    order = [F.col(sort_by).desc(), "name", "place"]
    groups = leaves.groupBy("category").agg(
        *(F.sum(x).cast("bigint").alias(x) for x in ("time", "flops", "bytes")), F.count("*").alias("ops"), F.min_by("name", F.struct((-F.col(sort_by)).alias("x"), F.col("name"))).alias("top_op"),
    )
    share = lambda a, b: F.round(c.safe_divide(F.col(a), F.col(b)), 4)
    if category is None and view in ("category", "summary"):
        root = tree.where("depth = 0").select(F.col("time").alias("_all"))
        return groups.crossJoin(root).withColumn("fraction", share("time", "_all")).withColumn("top_op", F.substring_index("top_op", "/", -1)).drop("_all").orderBy(F.col(sort_by).desc(), "category")
    if category is None and view == "flat":
        return (leaves.orderBy(*order).limit(top_n) if top_n > 0 else leaves.orderBy(*order)).drop("place")
    sums = groups.select("category", F.col("time").alias("_all"))
    if category is not None:
        equal = F.lower("category") == category.strip().lower()
        first = groups.where(F.lower("category").contains(category.strip().lower())).orderBy(equal.desc(), F.col(sort_by).desc(), "category").limit(1)
        out = leaves.join(sums, "category").join(first.select("category"), "category", "left_semi").withColumn("fraction", share("time", "_all")).drop("_all").orderBy(*order)
        return (out.limit(top_n) if top_n > 0 else out).drop("place")
    out = leaves.join(sums, "category").withColumn("fraction", share("time", "_all")).drop("_all")
    if top_n > 0:
        out = out.withColumn("_rank", F.row_number().over(W.partitionBy("category").orderBy(*order))).where(F.col("_rank") <= min(top_n, 5)).drop("_rank")
    return out.orderBy("category", *order).drop("place")


def _below(tree: DataFrame, path: str, depth: int) -> DataFrame:
    """The node at path (parts of names, each step to the first child in order that has it) and depth - 1 levels below it that took time."""
    parts = [p.lower() for p in path.strip("/").split("/") if p]
    if parts and parts[0] in ("root", *(name for name, _ in GROUPINGS.values())):
        parts = parts[1:]
    at = tree.where("depth = 0").select(F.col("place").alias("_at"))
    for part in parts:
        child = tree.where(F.lower("name").contains(part)).withColumn("_at", _parent("place"))
        at = at.join(child, "_at").agg(F.min("place").alias("_at")).where("_at is not null")
    under = F.slice("place", F.lit(1), F.size("_at")) == F.col("_at")
    near = F.size("place") - F.size("_at") <= depth - 1
    out = tree.crossJoin(at).where(under & near & ((F.col("time") > 0) | (F.size("place") == F.size("_at"))))
    return out.drop("_at").orderBy("place")
