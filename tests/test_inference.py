"""Requests and batches against a version that handles one event after the other."""

from __future__ import annotations

import random

import pytest

from spanforge.operators import inference as inf

RELATIONS, DEVICE = "parent_group bigint, child_group bigint", "group_id bigint, begin bigint, dur bigint, half boolean"
NAMES = [c.split()[0] for c in inf.EVENTS.split(", ")]


def plain(events, relations, device):
    events = [e for e in events if e["group_id"] is not None]
    kids, parents = {}, {}
    for p, c in sorted(set(relations)):
        kids.setdefault(p, []).append(c)
        parents.setdefault(c, []).append(p)
    named = lambda names: [e for n in names for e in sorted((e for e in events if e["name"] == n), key=lambda e: e["seq"])]
    roots = [e for e in sorted(events, key=lambda e: e["seq"]) if e["root"] == -1 or e["root"] == 1 and e["name"].startswith("ModelServerRequest_")]
    models = {}
    for e in [e for e in named(inf.MODEL_EVENTS) if e not in roots] + roots:
        if e["model"] is not None:
            models[e["group_id"]] = e["model"]
    batch_groups = {e["group_id"] for e in named(inf.PROCESS_BATCH)}
    present = {e["name"] for e in events}
    batching = inf.BATCHING in present
    kinds = (inf.BATCHING,) if batching else next((k for k in inf.REQUEST_KINDS if k[0] in present), inf.REQUEST_KINDS[2])
    requests = {}
    for e, user in [(e, False) for e in named(kinds)] + [(e, True) for e in roots]:
        g = e["group_id"]
        if g in batch_groups or g in requests:
            continue
        own = kids.get(g, [])
        if batching and not user:
            model = models.get(own[0]) if own else None
        elif user and g not in models:
            common, same = None, True
            for c in own:
                if common is None:
                    common = models.get(c)
                elif models.get(c) != common:
                    same = False
            model = common if same else None
        else:
            model = models.get(g)
        mine = [x for x in events if x["group_id"] == g]
        requests[g] = {"model": model, "batches": own, "begin": min(x["begin"] for x in mine), "end": max(x["begin"] + x["dur"] for x in mine), "size": 0, "delay": 0, "stamps": {}, "spans": []}
    targets = lambda g: [requests[t] for t in {g, *parents.get(g, [])} if t in requests]

    def stamp(names, key, low=False):
        for e in named(names):
            for r in targets(e["group_id"]):
                s = r["stamps"].setdefault(e["group_id"], {})
                s[key] = min(s.get(key, e["begin"]), e["begin"]) if low else e["begin"]

    stamp(inf.SCHEDULE, "schedule")
    for e in named(inf.SCHEDULE):
        if e["group_id"] in requests and e["task_size"] is not None:
            requests[e["group_id"]]["size"] = e["task_size"]
    batches = {}
    for e in named(inf.PROCESS_BATCH):
        if e["group_id"] in parents:
            batches[e["group_id"]] = {"begin": e["begin"], "end": e["begin"] + e["dur"], "size": 0, "padding": 0, "requests": parents[e["group_id"]]}
    stamp(inf.PADDING, "concat")
    for e in named(inf.PADDING):
        if e["group_id"] in batches and e["padding"] is not None and e["padded_size"] is not None:
            batches[e["group_id"]] |= {"size": e["padded_size"], "padding": e["padding"]}
    number = {p: k + 1 for k, p in enumerate(inf.PHASES)}
    found = [(e["group_id"], number["read" if e["name"] in inf.READS else "write"], e["begin"], e["begin"] + e["dur"]) for e in named((*inf.READS, *inf.WRITES))]
    for way, phase in (("To", "write"), ("From", "read")):
        name, pairs = inf.SYSTEM_TRANSFER.format(way), {}
        for e in named((name,)):
            if e["consumer"] is not None:
                pairs[e["consumer"]] = [e, None]
        for e in named((name + "=>Done",)):
            if e["consumer"] in pairs and pairs[e["consumer"]][0]["begin"] < e["begin"]:
                pairs[e["consumer"]][1] = e
        found += [(s["group_id"], number[phase], s["begin"], d["begin"] + d["dur"]) for s, d in pairs.values() if d]
    compute = [(g, number["compute_16" if half else "compute_32"], b, b + d) for g, b, d, half in device if g is not None]
    for g, phase, b, e in found + compute:
        for r in targets(g):
            r["spans"].append((phase, b, max(b, e)))
    stamp(inf.EXECUTE, "execute")
    stamp(inf.LAUNCH, "launch", True)
    stamp(inf.CALLBACK, "callback")
    for r in requests.values():
        b = next((batches[x] for x in r["batches"] if x in batches), None)
        if b:
            r["delay"], r["end"] = b["begin"] - r["begin"], max(r["end"], b["end"])
    for g, b in batches.items():
        begun = [requests[x]["begin"] for x in b["requests"] if x in requests]
        b["delay"] = b["begin"] - min(begun) if begun else 0
        b["model"] = requests[b["requests"][0]]["model"] if b["requests"][0] in requests else None
        b["device"] = sweep([(p, x, y) for h, p, x, y in compute if h == g])
    for r in requests.values():
        stamps = [r["stamps"][g] for g in sorted(r["stamps"])]
        get = lambda key: [s[key] for s in stamps if key in s]
        device_end = max((e for p, _, e in r["spans"] if p == number["compute_32"]), default=None)
        new = [("runtime", s["execute"], s["launch"]) for s in stamps if "execute" in s and "launch" in s]
        if get("execute"):
            new.append(("preprocess", r["begin"], min(get("execute"))))
        after = max(get("callback")) if get("callback") else device_end
        if after is not None:
            new.append(("postprocess", after, r["end"]))
        if get("schedule") and get("concat"):
            new.append(("batch_formation", get("schedule")[0], min(get("concat"))))
        r["spans"] += [(number[p], b, max(b, e)) for p, b, e in new]
    out = {g: (r["model"], r["begin"], r["end"], r["delay"], r["size"], r["batches"], sweep(r["spans"])) for g, r in requests.items() if r["end"] > r["begin"]}
    return out, {g: (b["model"], b["begin"], b["end"], b["delay"], b["size"], b["padding"], len(b["requests"]), sum(b["device"][1:])) for g, b in batches.items()}


def sweep(spans):
    spans = [s for s in spans if s[1] < s[2]]
    times = [0] * (len(inf.PHASES) + 1)
    if spans:
        for t in range(min(s[1] for s in spans), max(s[2] for s in spans)):
            times[max((p for p, b, e in spans if b <= t < e), default=0)] += 1
    return times


@pytest.mark.parametrize("seed, kinds", [(1, ("BatchingSessionRun",)), (2, ("TfrtModelRun", "SessionRun")), (3, ("SessionRun", "RunGraph"))])
def test_requests_and_batches(spark, seed, kinds):
    rng = random.Random(seed)
    maybe = lambda p, x: x if rng.random() < p else None
    pool = [*kinds, *kinds, "ProcessBatch", "ModelServerRequest_x", "other", *inf.SCHEDULE[:2], *inf.PADDING[:2], *inf.READS, *inf.WRITES[:2], *inf.EXECUTE[:2], *inf.LAUNCH, *inf.CALLBACK]
    pool += [inf.SYSTEM_TRANSFER.format(w) + s for w in ("To", "From") for s in ("", "=>Done")]
    events = []
    for i in range(260):
        name = rng.choice(pool)
        group = rng.randrange(14, 20) if name in ("ProcessBatch", *inf.PADDING) else rng.randrange(14 if rng.random() < 0.8 else 20)
        events.append({
            "group_id": maybe(0.95, group), "name": name, "begin": rng.randrange(1, 300), "dur": rng.choice([0, 2, 7, 30]), "seq": i, "root": rng.choice([None, None, 1, -1 if rng.random() < 0.2 else None]),
            "model": maybe(0.4, rng.choice("ab")), "task_size": maybe(0.7, rng.randrange(9)), "padding": maybe(0.7, rng.randrange(4)), "padded_size": maybe(0.8, rng.randrange(4, 9)), "consumer": maybe(0.9, rng.randrange(6)),
        })
    relations = [(rng.randrange(14), rng.randrange(14, 20)) for _ in range(24)]
    device = [(maybe(0.9, rng.randrange(20)), rng.randrange(1, 300), rng.choice([1, 20]), rng.random() < 0.4) for _ in range(40)]
    requests, batches = inf.build_requests(spark.createDataFrame([tuple(e[c] for c in NAMES) for e in events], inf.EVENTS), spark.createDataFrame(relations, RELATIONS), spark.createDataFrame(device, DEVICE))
    want_requests, want_batches = plain(events, relations, device)
    got = {r.request_id: (r.model, r.begin, r.end_ts, r.delay, r.size, r.batches, [r.idle, *(r[p] for p in inf.PHASES)]) for r in requests.collect()}
    assert got == want_requests and len(got) > 5
    assert {r.batch_id: tuple(r)[1:] for r in batches.collect()} == want_batches and want_batches


def test_nothing(spark):
    requests, batches = inf.build_requests(spark.createDataFrame([], inf.EVENTS), spark.createDataFrame([], RELATIONS), spark.createDataFrame([], DEVICE))
    assert requests.count() == batches.count() == 0
