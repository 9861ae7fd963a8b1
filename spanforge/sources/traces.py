"""Reading traces: session listing, table loading, and the bulk conversion of trace files.

A trace file holds one length-delimited message per host: planes with lines of events and a
dictionary of event names. The conversion job reads the files with Spark and decodes each one
inside its task, batch by batch of events, into the span table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = (
    "session string, host string, plane_id bigint, plane string, line_id bigint, line string, seq bigint, meta_id bigint, name string, "
    "begin bigint, dur bigint, error string"
)
MAX_BYTES = 2_000_000_000  # the binary source refuses contents of 2 GiB
_PATH = r"plugins/profile/(.+)/([^/]+)\.xplane\.pb$"


def list_sessions(spark: SparkSession, root: str) -> DataFrame:
    """(session, host, path, bytes, mtime) of the trace files below root; file contents are
    not read. Nested runs keep their prefix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xplane.pb").load(root)
    prefix = F.regexp_extract("path", r"([^/]*)/plugins/profile/", 1)
    session = F.regexp_extract("path", _PATH, 1)
    return files.select(session.alias("session"), F.regexp_extract("path", _PATH, 2).alias("host"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), prefix.alias("run")).where("session <> ''")


def load_trace(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A converted table, read with an explicit schema."""
    return spark.read.schema(schema or SPANS).parquet(path)


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: memoryview) -> Iterator[tuple[int, object]]:
    """(field number, value) pairs of one message: integers, or views of nested bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) != size:
                raise ValueError("truncated message")
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = int.from_bytes(data[at : at + size], "little"), at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def _text(value) -> str:
    return bytes(value).decode("utf-8", "replace")


def decode_space(content: bytes) -> Iterator[tuple]:
    """(plane_id, plane, line_id, line, seq, meta_id, name, begin ps, dur ps) of one file; begin is
    relative to the earliest line."""
    planes = [dict_of for number, dict_of in _fields(memoryview(content)) if number == 1]
    lines, origin = [], None
    for k, plane in enumerate(planes):
        plane_id, name, own, meta = k, "", [], {}
        for number, value in _fields(plane):
            if number == 1:
                plane_id = value
            elif number == 2:
                name = _text(value)
            elif number == 3:
                own.append(value)
            elif number == 4:
                entry = dict(_fields(value))
                inner = dict(_fields(entry[2])) if 2 in entry else {}
                meta[entry.get(1, 0)] = _text(inner.get(4) or inner.get(2, b""))
        for line in own:
            parts = list(_fields(line))
            head = dict((n, v) for n, v in parts if n != 4)
            start = head.get(3, 0) * 1000
            origin = start if origin is None else min(origin, start)
            label = _text(head.get(11) or head.get(2, b""))
            lines.append((plane_id, name, head.get(1, 0), label, start, [v for n, v in parts if n == 4], meta))
    for plane_id, plane, line_id, label, start, events, meta in lines:
        for seq, event in enumerate(events):
            f = dict((n, v) for n, v in _fields(event) if n in (1, 2, 3))
            m = f.get(1, 0)
            yield plane_id, plane, line_id, label, seq, m, meta.get(m, ""), start - origin + f.get(2, 0), f.get(3, 0)


def ingest_spaces(spark: SparkSession, root: str, limit: int = MAX_BYTES) -> DataFrame:
    """S3: the spans of all trace files below root. A file that cannot be decoded to its end, or is
    larger than limit (which its content is not read for), gives one row with the reason in error and no spans."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xplane.pb").load(root)
    return decode_files(files, limit)


def decode_files(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    origin = [F.regexp_extract("path", _PATH, k).alias(n) for k, n in ((1, "session"), (2, "host"))]
    rows = files.where(F.col("length") <= limit).select(*origin, "content")
    names = [x.split()[0] for x in SPANS.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("session", "host", "plane", "line", "name", "error") else pa.int64()) for n in names])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = []

                def flush():
                    return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=schema)

                try:
                    for _ in decode_space(row["content"]):
                        pass  # to the end first, so that a broken file leaves no spans
                    for event in decode_space(row["content"]):
                        out.append((row["session"], row["host"], *event, None))
                        if len(out) == 20_000:
                            yield flush()
                            out.clear()
                except (ValueError, IndexError, TypeError) as reason:
                    out.append((row["session"], row["host"], *[None] * 9, str(reason) or type(reason).__name__))
                if out:
                    yield flush()

    large = files.where(F.col("length") > limit).select(*origin, F.lit("file is too large").alias("error"))
    return rows.mapInArrow(run, SPANS).unionByName(large, allowMissingColumns=True)


def convert(spark: SparkSession, root: str, out: str) -> None:
    """S3: the bulk conversion: one pass over the files, written as Parquet in folders by
    rejected, session and host and sorted by track and time within each file, so that
    ``load_trace(...).where("not rejected and session = ...")`` reads little."""
    spans = ingest_spaces(spark, root).withColumn("rejected", F.col("error").isNotNull())
    spans = spans.repartition("rejected", "session", "host", "plane_id").sortWithinPartitions("rejected", "session", "host", "plane_id", "line_id", "begin", F.col("dur").desc(), "seq")
    spans.write.mode("overwrite").partitionBy("rejected", "session", "host").parquet(out)


def capabilities(spans: DataFrame) -> DataFrame:
    """(session, host, tool): which reports have data."""
    has = spans.groupBy("session", "host").agg(
        F.bool_or(F.col("plane").contains("GPU")).alias("kernel_stats"), F.bool_or(F.col("plane").contains("TPU")).alias("op_profile"),
        F.bool_or(F.col("name").startswith("MegaScale:")).alias("megascale_stats"), F.bool_or(F.col("plane").startswith("/host:")).alias("input_pipeline"),
    )
    tools = F.array(F.lit("trace_viewer"), *(F.when(F.col(c), F.lit(c)) for c in ("kernel_stats", "op_profile", "megascale_stats", "input_pipeline")))
    return has.select("session", "host", F.explode(F.array_compact(tools)).alias("tool"))


def capture_window(planes: DataFrame) -> DataFrame:
    """(host, start_ns, stop_ns) from the properties of the environment plane."""
    p = planes.where("plane = 'Task Environment'")
    stop = lambda k: F.try_element_at(F.col("props"), F.lit(k)).try_cast("bigint")
    return p.select("host", stop("profile_start_time").alias("start_ns"), stop("profile_stop_time").alias("stop_ns"))


def list_hosts(spans: DataFrame) -> DataFrame:
    """S12."""
    return spans.select("host").distinct().orderBy("host")


def list_modules(spans: DataFrame) -> DataFrame:
    """Distinct module names with the program id at their end."""
    return spans.select("name").distinct().select("name", F.regexp_extract("name", r"\((\d+)\)$", 1).try_cast("bigint").alias("program_id")).orderBy("name")
