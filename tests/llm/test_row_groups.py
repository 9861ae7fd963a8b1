"""Tables of slices are written in row groups of some MB, which writers and readers keep in memory."""

from __future__ import annotations

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from spanforge.llm.common import materialize


def test_rows_of_some_mb(spark):
    rows = spark.range(0, 60, 1, 1).select("id", F.transform(F.sequence(F.lit(0), F.lit(150_000)), lambda i: F.xxhash64(i, "id")).alias("keys"))
    out = materialize(rows)
    (path,) = (x.removeprefix("file://") for x in out.inputFiles())
    found = pq.ParquetFile(path).metadata
    groups = [found.row_group(k) for k in range(found.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 60 and max(g.total_byte_size for g in groups) < 25_000_000
    assert out.select(F.size("keys").alias("n")).distinct().collect()[0].n == 150_001
