"""The op tree against a version with nodes as objects."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import optree as ot

METRICS = "program_id bigint, symbol_id bigint, name string, category string, provenance string, self_time bigint, time bigint, flops bigint, bytes bigint, occurrences bigint, program string, dedup_name string"


class Node:
    def __init__(self, name, kind="", category=None, sort=()):
        self.name, self.kind, self.category, self.sort = name, kind, category, sort
        self.sums, self.children = dict.fromkeys(ot.SUMS, 0), {}

    def add(self, m, upper):
        s = self.sums
        s["self_time"] += m["self_time"]
        s["time"] += m["self_time" if upper else "time"]
        if not upper or m["time"] == m["self_time"]:
            s["flops"] += m["flops"]
            s["bytes"] += m["bytes"]
        if not upper:
            s["occurrences"] += m["occurrences"]

    def child(self, kind, key, name, category=None):
        return self.children.setdefault((kind, key), Node(name, kind, category, (kind, key)))


def plain_tree(metrics, by, k, exclude_idle, total=None):
    root_name, whole = ot.GROUPINGS[by]
    root = Node(root_name, "root")
    for m in metrics:
        idle = m["category"] == "IDLE"
        if m["name"].startswith("region") or idle and exclude_idle:
            continue
        root.add(m, True)
        at = root
        if not idle and by != "category":
            at = at.child("program", str(m["program_id"]), f"{m['program']}({m['program_id']})" if m["program"] else "main")
            at.add(m, True)
        key = f"{m['program_id']}/{m['symbol_id']}/{m['name']}"
        if idle:
            root.child("op", key, m["name"], m["category"]).add(m, False)
            continue
        if m["time"] > m["self_time"]:
            continue
        if by == "provenance":
            parts = [p for p in (m["provenance"] or "").split("/") if p]
            for i, p in enumerate(parts):
                p = p.split(":")[0] if i + 1 == len(parts) else p
                at = at.child("scope", p, p)
                at.add(m, True)
        d = m["dedup_name"] or m["name"]
        for step in (("category", m["category"], m["category"], m["category"]), ("duplicates", d, d, m["category"]), ("op", key, m["name"], m["category"])):
            at = at.child(*step)
            at.add(m, False)
    if total is not None:
        root.sums["time"] = total

    def prune(node, depth):
        children = sorted(node.children.values(), key=lambda n: (-n.sums["time"], n.name, n.sort))
        node.n_children = len(children)
        node.kept = children if depth < whole else children[:k]
        for n in node.kept:
            prune(n, depth + 1)

    prune(root, 0)
    out = []

    def walk(node, place, names):
        if node.kind == "duplicates":
            if len(node.kept) == 1:
                node = node.kept[0]
            elif node.kept:
                node.name = node.kept[0].name + " and its duplicate(s)"
        names = [*names, node.name]
        out.append((place, len(place) - 1, node.name, names, node.kind, node.category, *node.sums.values(), node.n_children))
        for i, n in enumerate(node.kept):
            walk(n, [*place, i + 1], names)

    walk(root, [1], [])
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        time = rng.randrange(0, 40)
        name = rng.choice(["fusion", "copy", "dot", "region_x", "conv"]) + f".{rng.randrange(12)}"
        inner = rng.random() < 0.15
        out.append({
            "program_id": rng.randrange(3), "symbol_id": i, "name": name, "category": rng.choice(["loop fusion", "copy", "convolution"]), "provenance": rng.choice(["a/b:Op", "a/b", "a//c/d:E:f", "", None, "b"]),
            "self_time": time, "time": time + 5 if inner else time, "flops": rng.randrange(9), "bytes": rng.randrange(9), "occurrences": rng.randrange(1, 4),
            "dedup_name": rng.choice(["", None, name, "shared"]),
        })
    for m in out:
        m["program"] = ("jit_f", "jit_g", None)[m["program_id"]]
    out.append(dict(out[0], name="IDLE", category="IDLE", self_time=17, time=17, symbol_id=999, program_id=0))
    return out


def frame(spark, metrics):
    names = [c.split()[0] for c in METRICS.split(", ")]
    return spark.createDataFrame([tuple(m[c] for c in names) for m in metrics], METRICS)


@pytest.mark.parametrize("by", ["program", "category", "provenance"])
@pytest.mark.parametrize("k, exclude_idle, total", [(100, False, None), (2, True, 5000)])
def test_tree(spark, by, k, exclude_idle, total):
    metrics = made(len(by) + k)
    tree = ot.op_tree(frame(spark, metrics), by, k, exclude_idle, F.lit(total) if total else None)
    got = [tuple(r) for r in tree.orderBy("place").collect()]
    assert got == plain_tree(metrics, by, k, exclude_idle, total)


def test_views(spark):
    metrics = made(5)
    tree = ot.op_tree(frame(spark, metrics), "category").cache()
    nodes = plain_tree(metrics, "category", 100, False)
    inner = {tuple(n[0][:-1]) for n in nodes if n[7] > 0}
    leaves = [("/".join(n[3]), n[5], n[7], max(1, n[10]), n[8], n[9]) for n in nodes if n[7] > 0 and tuple(n[0]) not in inner]
    leaves = [x for _, x in sorted(zip([n[0] for n in nodes if n[7] > 0 and tuple(n[0]) not in inner], leaves))]
    order = lambda x: (-x[2], x[0])
    assert [tuple(r) for r in ot.op_profile_views(tree, "flat", top_n=7).collect()] == sorted(leaves, key=order)[:7]
    assert [tuple(r) for r in ot.op_profile_views(tree, "flat", top_n=0).collect()] == sorted(leaves, key=order)
    total = nodes[0][7]
    for r in ot.op_profile_views(tree, "category", "flops").collect():
        own = [x for x in leaves if x[1] == r.category]
        assert (r.time, r.flops, r.ops, r.fraction) == (sum(x[2] for x in own), sum(x[4] for x in own), len(own), round(sum(x[2] for x in own) / total, 4))
        assert r.top_op == min(own, key=lambda x: (-x[4], x[0]))[0].rsplit("/", 1)[-1]
    grouped = ot.op_profile_views(tree, "grouped", top_n=3).collect()
    for name in {x[1] for x in leaves}:
        own = sorted((x for x in leaves if x[1] == name), key=order)
        assert [tuple(r)[1:4] for r in grouped if r.category == name] == [(x[0], x[2], x[3]) for x in own[:3]]
    chosen = ot.op_profile_views(tree, category="FUSION", top_n=4).collect()
    own = sorted((x for x in leaves if x[1] == "loop fusion"), key=order)
    assert [(r.name, r.fraction) for r in chosen] == [(x[0], round(x[2] / sum(y[2] for y in own), 4)) for x in own[:4]]
    below = ot.op_profile_views(tree, "tree", path="by_category/conv", depth=2).collect()
    at = next(n for n in nodes if n[1] == 1 and n[2] == "convolution")
    assert [tuple(r) for r in below] == [n for n in nodes if n[0][: len(at[0])] == at[0] and n[1] <= 2 and (n[7] > 0 or n is at)]
    assert ot.op_profile_views(tree, "tree", path="nowhere").count() == 0
    with pytest.raises(ValueError):
        ot.op_profile_views(tree, "other")


def test_no_ops(spark):
    assert ot.op_tree(frame(spark, [])).count() == 0
