"""Writing traces and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def chrome_events(spans: DataFrame, ticks_per_us: float = 1.0) -> DataFrame:
    """One JSON trace event per row: process names, then complete events."""
    named = spans.select(F.col("plane_id").alias("pid"), "plane").distinct()
    meta = named.select(F.to_json(F.struct(F.lit("M").alias("ph"), "pid", F.lit("process_name").alias("name"), F.struct(F.col("plane").alias("name")).alias("args"))).alias("value"))
    ts, dur = F.col("begin") / ticks_per_us, F.greatest(F.col("dur"), F.lit(1)) / ticks_per_us
    body = spans.select(F.to_json(F.struct(F.lit("X").alias("ph"), F.col("plane_id").alias("pid"), F.col("line_id").alias("tid"), ts.alias("ts"), dur.alias("dur"), "name")).alias("value"))
    return meta.unionByName(body)


def trace_rows(spans: DataFrame, ticks_per_us: float = 1.0) -> DataFrame:
    """S8 with all row kinds, as columns: spans(plane_id, plane, line_id, line, begin, dur, name, seq[, flow, flow_entry (start, mid, end), category, unbound,
    group_id]) -> one row per row of the file.

    M: name and place of each process and thread. X: a span of its track, with the flow it is bound to and whether that comes in or goes out. b
    and e: an unbound (asynchronous) span of a flow begins or ends at a point, under the flow's id, so that spans of one track may overlap; one in the middle of a
    flow does both, at its begin and at its end."""
    have = lambda name, kind: F.col(name) if name in spans.columns else F.lit(None).cast(kind).alias(name)
    us = lambda x: x / ticks_per_us
    pid, tid, end = F.col("plane_id"), F.col("line_id"), F.col("begin") + F.col("dur")
    rows = spans.select("plane_id", "plane", "line_id", "line", "begin", "dur", "name", "seq", have("flow", "bigint"), have("flow_entry", "string"), have("category", "string"), have("unbound", "boolean"), have("group_id", "bigint"))
    rows = rows.withColumn("unbound", F.coalesce("unbound", F.lit(False)))
    meta = lambda df, tid, name, label, order: df.select(F.lit("M").alias("ph"), pid.alias("pid"), tid.cast("bigint").alias("tid"), F.lit(name).alias("name"), label.cast("string").alias("arg_name"), order.cast("bigint").alias("arg_sort_index"))
    processes, threads, null = rows.select("plane_id", "plane").distinct(), rows.select("plane_id", "line_id", "line").distinct(), F.lit(None)
    parts = [
        meta(processes, null, "process_name", F.col("plane"), null), meta(processes, null, "process_sort_index", null, pid),
        meta(threads, tid, "thread_name", F.col("line"), null), meta(threads, tid, "thread_sort_index", null, tid),
    ]
    named = [pid.alias("pid"), "name", F.col("seq").alias("arg_uid"), F.col("group_id").alias("arg_group_id")]
    flowing = F.col("flow").isNotNull()
    flag = lambda *entries: F.when(flowing & F.col("flow_entry").isin(*entries), True)
    parts.append(rows.where("not unbound").select(
        F.lit("X").alias("ph"), *named, tid.alias("tid"), us(F.col("begin")).alias("ts"), us(F.greatest("dur", F.lit(1))).alias("dur"), F.col("flow").alias("bind_id"),
        F.when(flowing, F.nullif("category", F.lit(""))).alias("cat"), flag("mid", "end").alias("flow_in"), flag("start", "mid").alias("flow_out"),
    ))
    loose = rows.where("unbound and flow is not null")
    opens = F.col("flow_entry").isin("start", "mid")
    point = lambda df, ph, ts: df.select(ph.alias("ph"), *named, us(ts).alias("ts"), F.col("flow").alias("id"), F.coalesce("category", F.lit("")).alias("cat"))
    parts.append(point(loose, F.when(opens, "b").otherwise("e"), F.col("begin")))
    parts.append(point(loose.where("flow_entry = 'mid'"), F.lit("e"), end).drop("arg_uid"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def trace_lines(rows: DataFrame) -> DataFrame:
    """Rows of trace_rows as JSON, arguments nested, absent fields left out."""
    args = F.struct(*(F.col(c).alias(c.removeprefix("arg_")) for c in rows.columns if c.startswith("arg_")))
    return rows.select(F.to_json(F.struct(*(c for c in rows.columns if not c.startswith("arg_")), args.alias("args"))).alias("value"))


def to_chrome_trace(spans: DataFrame, path: str, ticks_per_us: float = 1.0) -> None:
    """Writes the events as JSON lines, one file per task."""
    chrome_events(spans, ticks_per_us).write.mode("overwrite").text(path)


def to_trace_lines(spans: DataFrame, path: str, ticks_per_us: float = 1.0) -> None:
    """Writes the rows of all kinds as JSON lines, one file per task."""
    trace_lines(trace_rows(spans, ticks_per_us)).write.mode("overwrite").text(path)


def delta_series(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per track (by) and event its start as the difference to the one before, its duration
    and a reference to its name (dense over the names of the track)."""
    w = W.partitionBy(*by).orderBy("begin", F.col("dur").desc(), "seq")
    names = F.dense_rank().over(W.partitionBy(*by).orderBy("name")) - 1
    return spans.select(*by, "seq", (F.col("begin") - F.lag("begin", 1, 0).over(w)).alias("delta"), "dur", names.alias("name_ref"))


def to_delta_series(spans: DataFrame, by: Sequence[str], path: str) -> None:
    """Writes the series, sorted within each file by track and position."""
    delta_series(spans, by).write.mode("overwrite").parquet(path)


def csv_rows(report: DataFrame) -> DataFrame:
    """The text of each row with every cell quoted."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return report.select(F.concat_ws(",", *(cell(c) for c in report.columns)).alias("value"))


def to_csv(report: DataFrame, path: str) -> None:
    """All cells quoted, with a header."""
    report.write.mode("overwrite").option("quoteAll", True).option("escape", '"').option("header", True).csv(path)


def report_table(df: DataFrame, labels: dict[str, str], props: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The report with its labels as column metadata, and its properties as one row."""
    out = df.select(*(F.col(c).alias(c, metadata={"label": labels.get(c, c)}) for c in df.columns))
    return out, df.sparkSession.createDataFrame([tuple(props.values())], ", ".join(f"`{k}` string" for k in props))
