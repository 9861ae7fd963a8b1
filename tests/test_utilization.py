"""A23 and A24 on small tables, rule by rule."""

from __future__ import annotations

import pytest

from spanforge.operators import utilization as ut

SUMS = "device_id bigint, line_id bigint, counter_id bigint, value bigint"


@pytest.mark.parametrize("force, duration, want", [(False, 0.0, {1: 70, 2: 1000}), (True, 0.0, {1: 1000, 2: 1000}), (False, 3.0, {1: 70, 2: 300})])
def test_cycles_from_time(spark, force, duration, want):
    sums = spark.createDataFrame([(0, 0, 1, 70), (0, 0, 2, 0), (0, 0, 9, 5), (0, 1, 9, 6)], SUMS)
    time = spark.createDataFrame([(0, 0, 10.0), (0, 1, 0.0), (0, 7, 4.0)], "device_id bigint, line_id bigint, duration_us double")
    got = {(r.line_id, r.counter_id): r.value for r in ut.with_cycle_counts(sums, time, 100.0, [1, 2], duration, force).collect()}
    other = {(1, 1): 300, (1, 2): 300} if duration else {}
    assert got == {(0, k): v for k, v in want.items()} | {(0, 9): 5, (1, 9): 6} | other


def test_kernel_report(spark):
    rows = [(1, ut.MXU_BUSY, 30.0, 40.0), (1, ut.MXU_BUSY, 30.0, 0.0), (1, "MXU BF16", 3.0, 0.0), (1, "MXU I8", 1.0, 0.0), (1, "HBM Rd+Wr a", 1.0, 3.0), (1, "HBM Rd+Wr b", 1.0, 3.0), (1, "x", 1.0, 0.0), (2, "x", 1.0, 8.0)]
    got = {r.kernel: r for r in ut.kernel_report(spark.createDataFrame(rows, "kernel bigint, metric string, achieved double, peak double"), ["kernel"]).collect()}
    assert (got[1].mxu_utilization, got[1].mxu_is_anomaly, got[1].other_metrics) == (150.0, True, {ut.HBM_NAME: 33.33})
    assert got[1].mxu_cycles_breakdown == {"BF16": 75.0, "FP8": 0.0, "Int4": 0.0, "Int8": 25.0}
    assert (got[2].mxu_utilization, got[2].mxu_is_anomaly, got[2].other_metrics, set(got[2].mxu_cycles_breakdown.values())) == (0.0, False, {"x": 12.5}, {0.0})


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("MXU0", 1, 4), ("MXU1", 3, 4), ("XLU0", 1, 2), ("XLU1", 1, 4), ("HBM Rd+Wr", 1, 8)], {"mxu_utilization_percent": 50.0, "idleness_percent": 25.0, "xlu_utilization_percent": 37.5, "hbm_bandwidth_utilization_percent": 12.5}),
        ([("MXU0", 1, 4), ("No MXU Busy", 2, 5), ("Avg MXU Busy", 1, 3)], {"mxu_utilization_percent": 33.33, "idleness_percent": 40.0}),
        ([("Avg MXU Busy", 1, 3), ("Scalar Unit", 0, 0), ("Vector ALUs", 1, 0)], {"mxu_utilization_percent": 33.33, "idleness_percent": 66.67, "scalar_unit_utilization_percent": 0.0}),
        ([("other", 1, 2)], {"idleness_percent": 100.0}), ([], {}),
    ],
)
def test_utilization_report(spark, rows, want):
    got = {r.name: r.percent for r in ut.utilization_report(spark.createDataFrame([(n, float(a), float(p)) for n, a, p in rows], "name string, achieved double, peak double")).collect()}
    names = {n for n, _, _ in rows}
    assert {k: v for k, v in got.items() if k not in names} == want
