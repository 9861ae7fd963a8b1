"""Filters and predicates over trace tables; all push down to the scan where Spark can."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# fixed values: bookkeeping names and line names of the trace format
INTERNAL_EVENTS = ("ThreadpoolListener::Record", "ThreadpoolListener::StartRegion", "ThreadpoolListener::StopRegion", "ThreadpoolListener::Region")
TPU_LINES = r"^(XLA OPS|PALLAS|LLO OPS)"
OTHER_DROPPED_LINES = r"COUNTER|MODULES|OVERLAY|SYNC FLAG|SENSOR"
CONTAINERS = ("call", "conditional", "while", "megacore fusion")
MAX_SERIAL = 256


def select_hosts(df: DataFrame, host: str | Sequence[str] = "ALL_HOSTS", suffix: str = ".xplane.pb") -> DataFrame:
    """One host, a list, or all. An unknown host is an error."""
    if host == "ALL_HOSTS":
        return df
    names = [host] if isinstance(host, str) else list(host)
    names = [n.removesuffix(suffix) for n in names]
    out = df.where(F.col("host").isin(*names))
    if out.isEmpty():
        raise ValueError(f"no such host: {', '.join(names)}")
    return out


def filter_planes(df: DataFrame, regex: str) -> DataFrame:
    """regex search on the plane name."""
    return df.where(F.col("plane").rlike(regex))


def filter_events(spans: DataFrame, meta: DataFrame, regex: str, keys: Sequence[str]) -> DataFrame:
    """regex search on event names, tested once per dictionary entry: the dictionary is
    filtered first and the spans are semi-joined with what is left."""
    return spans.join(meta.where(F.col("name").rlike(regex)).select(*keys), list(keys), "left_semi")


def filter_contained(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """spans that lie inside [start, end]."""
    out = df if start is None else df.where(F.col("begin") >= start)
    return out if end is None else out.where(F.col("begin") + F.col("dur") <= end)


def filter_overlapping(df: DataFrame, lo: int, hi: int = 0) -> DataFrame:
    """spans that touch [lo, hi]; hi = 0 stands for the end of the trace, bounds are
    clamped to the trace."""
    span = df.agg(F.min("begin").alias("_min"), F.max(F.col("begin") + F.col("dur")).alias("_max"))
    top = F.when(F.lit(hi) == 0, F.col("_max")).otherwise(F.least(F.lit(hi), "_max"))
    low = F.greatest(F.lit(lo), "_min")
    out = df.crossJoin(F.broadcast(span))  # one row
    return out.where((F.col("begin") <= top) & (low <= F.col("begin") + F.col("dur"))).drop("_min", "_max")


def serial(spans: DataFrame, by: Sequence[str], cap: int = MAX_SERIAL) -> DataFrame:
    """Position among the events of one timestamp, capped."""
    n = F.row_number().over(W.partitionBy(*by, "begin").orderBy(F.col("dur").desc(), "seq")) - 1
    return spans.withColumn("serial", F.least(n, F.lit(cap)))


def search_prefix(df: DataFrame, prefix: str, by: Sequence[str]) -> DataFrame:
    """events by name prefix, at most 256 per timestamp."""
    return serial(df.where(F.col("name").startswith(prefix)), by).where(F.col("serial") < MAX_SERIAL)


def drop_internal(df: DataFrame, names: Sequence[str] = INTERNAL_EVENTS) -> DataFrame:
    """without bookkeeping events, and without stats that start with an underscore."""
    out = df.where(~F.col("name").isin(*names))
    if "stats" in df.columns:
        out = out.withColumn("stats", F.map_filter("stats", lambda k, _: ~k.startswith("_")))
    return out


def filter_category(df: DataFrame, value: str, mode: str = "equals") -> DataFrame:
    """category equals or contains value, trimmed and in lower case."""
    have, want = F.lower(F.trim("category")), value.strip().lower()
    return df.where(have == want if mode == "equals" else have.contains(want))


def flag_truncated(df: DataFrame, window: DataFrame) -> DataFrame:
    """F8: adds cut: the event starts before or ends after the capture window(host, start, stop)."""
    out = df.join(window.withColumnsRenamed({"start": "_start", "stop": "_stop"}), "host", "left")
    cut = (F.col("begin") < F.col("_start")) | (F.col("begin") + F.col("dur") > F.col("_stop"))
    return out.withColumn("cut", F.coalesce(cut, F.lit(False))).drop("_start", "_stop")


def pick_indices(df: DataFrame, **wanted) -> tuple[DataFrame, list[str]]:
    """filters on those of the wanted columns that exist; the others come back as warnings."""
    warnings = [f"no column {c}" for c, v in wanted.items() if v is not None and c not in df.columns]
    for c, v in wanted.items():
        if v is not None and c in df.columns:
            df = df.where(F.col(c) == v)
    return df, warnings


def classify_line(df: DataFrame) -> DataFrame:
    """adds device_line: whether the line of a device holds ops."""
    line = F.upper("line")
    return df.withColumn("device_line", F.when(F.upper("plane").contains("TPU"), line.rlike(TPU_LINES)).otherwise(~line.rlike(OTHER_DROPPED_LINES)))


def drop_idle(df: DataFrame) -> DataFrame:
    """F11."""
    return df.where("name <> 'IDLE'")


def drop_region(df: DataFrame) -> DataFrame:
    """F11."""
    return df.where(~F.col("name").startswith("region"))


def drop_containers(df: DataFrame, include_infeed: bool = True) -> DataFrame:
    """F11."""
    names = CONTAINERS if include_infeed else (*CONTAINERS, "infeed", "outfeed")
    return df.where(~F.lower("category").isin(*names))


def stat(name: str, own: str = "stats", meta: str = "meta_stats") -> Column:
    """a stat of the event, else of its metadata."""
    return F.coalesce(F.try_element_at(F.col(own), F.lit(name)), F.try_element_at(F.col(meta), F.lit(name)))


def display_name(name: Column, *alternatives: Column) -> Column:
    """numeric names give way to the first non-empty alternative."""
    return F.when(name.rlike(r"^\d+$"), F.coalesce(*(F.nullif(a, F.lit("")) for a in alternatives), name)).otherwise(name)


def is_tensor_core(plane: Column) -> Column:
    """F14."""
    return plane.rlike(r"^/device:TPU:\d+$")


def is_sparse_core(plane: Column) -> Column:
    return plane.rlike(r"^/device:TPU:\d+ SparseCore \d+$")


def is_host(plane: Column) -> Column:
    return plane.startswith("/host:")


def is_gpu(plane: Column) -> Column:
    return plane.startswith("/device:GPU:")


def drop_dma_flow(df: DataFrame, full_dma: bool = False) -> DataFrame:
    """hides the events in the middle of a flow on DMA devices."""
    return df if full_dma else df.where(~(F.col("dma_device") & (F.col("flow_role") == "mid")))
