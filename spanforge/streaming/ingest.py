"""Streaming: incremental ingest of new trace files, and running event totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanforge.plans.work import checkpointed
from spanforge.sources.spaces import TAGGED, decode_tables, tables
from spanforge.sources.traces import _PATH, MAX_BYTES, decode_files

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_ingest(spark: SparkSession, root: str, out: str, checkpoint: str, limit: int = MAX_BYTES) -> StreamingQuery:
    """ST1: new trace files below root are decoded once and appended to the span table; a batch
    that is tried again replaces its own part."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.xplane.pb").load(root)

    def write(batch: DataFrame, number: int) -> None:
        decode_files(batch, limit).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_event_totals(spans: DataFrame, time: str, window: str, watermark: str) -> DataFrame:
    """ST2: count, total and extremes per window and name of arriving spans; rows later than the
    watermark are dropped. Works on streams and, as the same plan, on tables."""
    return (
        spans.withWatermark(time, watermark)
        .groupBy(F.window(time, window), "name")
        .agg(F.count("*").alias("count"), F.sum("dur").alias("total"), F.min("dur").alias("min"), F.max("dur").alias("max"))
        .select(F.col("window.start").alias("start"), "name", "count", "total", "min", "max")
    )


MANIFEST = "path string, mtime timestamp, length bigint, version bigint"


def ingest_changed(spark: SparkSession, root: str, out: str, settle: float = 2.0, limit: int = MAX_BYTES) -> int:
    """ST1 with changed files: decodes the trace files below root that are new, or whose size or time differs from the last version taken, and makes
    them visible at once; returns how many. Files younger than settle seconds wait for the next call, as they may still be written.

    Rows go to out/data/version=n first, where nobody looks yet. Then one file in out/manifest, which appears as a whole, names the version that holds each of the
    files. A run that dies in between leaves the versions before it visible, and the next one writes over what it left. Files that are gone stay as
    they were."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xplane.pb").load(root)
    listed = listed.where(F.col("modificationTime") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(settle)))
    known = _manifest(spark, out)
    latest = known.groupBy("path").agg(F.max_by(F.struct("mtime", "length"), "version").alias("last"))
    same = (F.col("f.path") == F.col("k.path")) & (F.col("f.modificationTime") == F.col("k.last.mtime")) & (F.col("f.length") == F.col("k.last.length"))
    found = listed.select("path", "modificationTime", "length").alias("f").join(latest.alias("k"), same, "left_anti")
    version = (known.agg(F.max("version")).first()[0] or 0) + 1
    entries = checkpointed(found.select("path", F.col("modificationTime").alias("mtime"), "length", F.lit(version).cast("bigint").alias("version")))
    count = entries.count()
    if not count:
        return 0
    # a file that changed again since it was listed is taken as it is now, and once more next time
    files = listed.join(entries.select("path"), "path", "left_semi").select(F.col("path").alias("session"), F.lit("").alias("host"), "length", "content")
    rows = decode_tables(files, limit).withColumn("path", F.col("session")).withColumns({n: F.regexp_extract("path", _PATH, k) for k, n in ((1, "session"), (2, "host"))})
    rows.write.mode("overwrite").parquet(f"{out}/data/version={version}")
    entries.coalesce(1).write.mode("append").parquet(f"{out}/manifest")
    return count


def _manifest(spark: SparkSession, out: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def current_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """S4 of ingest_changed: planes, lines, event_meta, spans and rejected of the last version of each file."""
    last = _manifest(spark, out).groupBy("path").agg(F.max("version").alias("version"))
    rows = spark.read.schema(f"{TAGGED}, path string, version bigint").parquet(f"{out}/data")
    return tables(rows.join(last, ["path", "version"], "left_semi"))


def watch(spark: SparkSession, root: str, out: str, checkpoint: str, every: str = "10 seconds", settle: float = 2.0) -> StreamingQuery:
    """ST1 as a stream: ingest_changed at every tick, until the query is stopped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(batch: DataFrame, number: int) -> None:
        ingest_changed(batch.sparkSession, root, out, settle)

    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
