"""Ranks in a global order, or within keys of any size, without a window over all rows of one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanforge.plans.work import checkpointed


def ranked(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), rank: str = "rank", count: str = "count") -> DataFrame:
    """df with its 0-based rank in (by, order) within each value of by, and the number of rows there.

    Rows are range-partitioned by (by, order), so a key with a third of all rows is spread; each
    partition numbers its own rows and starts where the ones before it end. order must end in a
    unique column for ranks that do not depend on chance.
    """
    keys = [*by, *order]
    parts = checkpointed(df.repartitionByRange(*keys).withColumn("_range_no", F.spark_partition_id()))
    sizes = parts.groupBy(*by, "_range_no").agg(F.count("*").alias("_size"))
    whole = W.partitionBy(*by)  # one row per range partition and key
    before = F.sum("_size").over(whole.orderBy("_range_no").rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")
    sizes = sizes.select(*(F.col(x).alias(f"_by_{x}") for x in by), F.col("_range_no").alias("_range_of"), before.alias("_before"), F.sum("_size").over(whole).alias(count))
    same = F.col("_range_no") == F.col("_range_of")
    for x in by:
        same = same & F.col(x).eqNullSafe(F.col(f"_by_{x}"))
    own = F.row_number().over(W.partitionBy("_range_no", *by).orderBy(*order)) - 1
    out = parts.withColumn("_own", own).join(sizes, same)
    return out.withColumn(rank, (F.col("_own") + F.col("_before")).cast("bigint")).select(*df.columns, rank, count)
