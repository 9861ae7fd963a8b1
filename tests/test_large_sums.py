"""Sums of times beyond 64 bits."""

from __future__ import annotations

from spanforge.catalog.registry import fitting
from spanforge.catalog.spaces import op_times
from spanforge.plans import reports as rp

HUGE = 6 * 10**18


def test_request_phases(spark):
    events = spark.createDataFrame([(k, 0, HUGE, 1) for k in range(3)] + [(3, 0, 7, 2)], "request_id bigint, begin bigint, dur bigint, phase int")
    requests = spark.createDataFrame([(k, "m" if k < 3 else "n") for k in range(4)], "request_id bigint, model string")
    found = {(r.model, r.phase): (r.requests, int(r.time), r.mean, r.percent) for r in fitting(rp.request_phases(events, requests, 2), "time").collect()}
    assert found == {("m", 1): (3, 3 * HUGE, float(HUGE), 100.0), ("n", 2): (1, 7, 7.0, 100.0)}


def test_op_times(spark):
    times = op_times(spark.createDataFrame([("a", HUGE), ("a", HUGE), ("b", 5)], "name string, dur bigint"))
    assert {r.op: (r.n, int(r.time)) for r in fitting(times, "time").collect()} == {"a": (2, 2 * HUGE), "b": (1, 5)}
    assert fitting(times.where("op = 'b'"), "time").schema["time"].dataType.simpleString() == "bigint"
