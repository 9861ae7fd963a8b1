"""Line dedup by prefix doubling over line sequences.

Every document is the sequence of its lines that hold a word; a suffix is a line position.
Prefix doubling ranks the suffixes by their first 1, 2, 4, ... lines: the rank of a run is the
place (doc_id, line) where it first occurs, and the ranks of 2^(k+1) lines follow from the pair
of ranks at the position and 2^k lines further on. Suffixes whose rank is their own alone are
dropped, so each round works on what still repeats, and the rounds end when nothing does.
The suffixes that share a rank are the intervals of the suffix array in which the longest common
prefix has 2^k lines or more. Which suffixes share an interval, and which of them comes first in the
documents, is all that the deletion needs, so suffixes are grouped and not sorted, and no full array is built.

A line is deleted if it lies in a run of ``min_lines`` lines or more that also occurs earlier
(in a smaller doc_id, or before in the same document). A maximal run starts where the
earliest source of the longest ranked run does not continue the one before; its exact length
is the longest common prefix of position and source, read off the ranks from the highest
level down.

Ranks come from grouped minima, which Spark combines before the shuffle, so a line that
stands in a third of all documents costs one row per task there; documents are joined on
(doc_id, line), which is unique.

Odd rows: null or empty text has no lines; blank lines belong to no run and are kept; repeated rows
count as one document and are treated alike; several texts under one doc_id are documents in the order of
their hashes; text that is not valid UTF-8 is cut at its bytes like any other; a null doc_id is left as it is;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, raw


def suffix_ranks(docs: DataFrame) -> list[DataFrame]:
    """Per level k: (doc_id, at, d, p), the suffixes whose first 2^k lines occur more than
    once, with the place (d, p) of the first occurrence."""
    text = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    named = docs.where("doc_id is not null").select("doc_id", F.posexplode(text).alias("at", "line"))
    keyed = named.select("doc_id", "at", F.xxhash64("line").alias("x"), F.xxhash64(F.lit(1), "line").alias("y")).dropDuplicates(["doc_id", "at"])

    def ranked(rows, *keys):
        low = F.min(F.struct("doc_id", "at"))
        group = rows.groupBy(*keys).agg(low.alias("low"), F.max(F.struct("doc_id", "at")).alias("high")).where("low < high")
        group = materialize(group.select(*keys, F.col("low.doc_id").alias("d"), F.col("low.at").alias("p")))
        # a table of its own, so that Spark can split the rows of one hot run over tasks
        return materialize(rows.join(group.hint("merge"), list(keys)).select("doc_id", "at", "d", "p"))

    levels = [ranked(materialize(keyed), "x", "y")]
    while not levels[-1].isEmpty():
        levels.append(ranked(materialize(_paired(levels[-1], 1 << (len(levels) - 1))), "d1", "p1", "d2", "p2"))
    return levels[:-1]


def _paired(ranks: DataFrame, shift: int) -> DataFrame:
    """Ranks at a position and shift lines further on: (doc_id, at, d1, p1, d2, p2)."""
    here = ranks.select("doc_id", "at", F.col("d").alias("d1"), F.col("p").alias("p1"))
    there = ranks.select("doc_id", (F.col("at") - shift).alias("at"), F.col("d").alias("d2"), F.col("p").alias("p2"))
    return here.join(there, ["doc_id", "at"])


def repeated_starts(levels: list[DataFrame], min_lines: int) -> DataFrame | None:
    """(doc_id, at): where a run of min_lines lines starts that also occurs earlier."""
    k = min_lines.bit_length() - 1
    if k >= len(levels):
        return None
    rows = levels[k]
    if min_lines > 1 << k:  # two overlapping runs of 2^k lines name the run
        pair = _paired(rows, min_lines - (1 << k))
        first = pair.groupBy("d1", "p1", "d2", "p2").agg(F.min(F.struct("doc_id", "at")).alias("low"))
        rows = pair.join(first, ["d1", "p1", "d2", "p2"]).select("doc_id", "at", F.col("low.doc_id").alias("d"), F.col("low.at").alias("p"))
    return rows.where("d <> doc_id or p <> at").select("doc_id", "at")


def maximal_runs(levels: list[DataFrame], min_lines: int) -> DataFrame | None:
    """(doc_id, at, d, p, length): maximal repeated runs with their earliest source."""
    if not levels:
        return None
    every = None
    for k, rows in enumerate(levels):
        rows = rows.withColumn("k", F.lit(k))
        every = rows if every is None else every.unionByName(rows)
    later = every.where("d <> doc_id or p <> at")
    top = later.groupBy("doc_id", "at").agg(F.max(F.struct("k", "d", "p")).alias("t")).select("doc_id", "at", "t.*")
    top = materialize(top)
    before = top.select("doc_id", (F.col("at") + 1).alias("at"), F.col("d").alias("bd"), (F.col("p") + 1).alias("bp"))
    runs = top.join(before, ["doc_id", "at"], "left").where("bd is null or bd <> d or bp <> p").select("doc_id", "at", "d", "p", F.lit(0).alias("length"))
    for rows in reversed(list(enumerate(levels))):
        k, rows = rows
        mine = rows.select("doc_id", F.col("at").alias("i"), F.col("d").alias("d1"), F.col("p").alias("p1"))
        theirs = rows.select(F.col("doc_id").alias("d"), F.col("at").alias("j"), F.col("d").alias("d2"), F.col("p").alias("p2"))
        runs = runs.withColumn("i", F.col("at") + F.col("length")).withColumn("j", F.col("p") + F.col("length"))
        runs = runs.join(mine, ["doc_id", "i"], "left").join(theirs, ["d", "j"], "left")
        same = F.coalesce((F.col("d1") == F.col("d2")) & (F.col("p1") == F.col("p2")), F.lit(False))
        runs = runs.select("doc_id", "at", "d", "p", (F.col("length") + F.when(same, 1 << k).otherwise(0)).alias("length"))
    return runs.where(F.col("length") >= min_lines)


def cut_lines(docs: DataFrame, min_lines: int) -> DataFrame:
    """docs(doc_id, text, at array or null, ...): the text without the lines of those runs."""

    def run(batches):
        for part in chunks(batches, limit=8 << 20):
            n, removed, kept = [], [], []
            for text, found in zip(raw(part.column("text")), part.column("at")):
                lines = (text or b"").split(b"\n")
                real = [i for i, x in enumerate(lines) if x.split()]
                gone = set()
                if found.is_valid:
                    for at in np.asarray(found.values).tolist():
                        gone.update(real[at : at + min_lines])
                n.append(len(real))
                removed.append(len(gone))
                kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), part.column("n_runs"), part.column("longest_run"), pa.array(kept, pa.binary())],
                names=["doc_id", "n_lines", "n_removed", "n_runs", "longest_run", "kept_text"],
            )

    return docs.mapInArrow(run, "doc_id bigint, n_lines bigint, n_removed bigint, n_runs bigint, longest_run bigint, kept_text binary").withColumn("kept_text", F.col("kept_text").cast("string"))


def line_dedup(docs: DataFrame, *, min_lines: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, longest_run, kept_text) for every row of
    docs(doc_id, text): the text without later copies of repeated line runs, and the number
    and greatest length of the maximal runs of the document."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a document is an id with a text: repeated rows are one, two texts under one id are two
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    docs = docs.withColumn("doc_id", named)
    levels = suffix_ranks(docs)
    starts, runs = repeated_starts(levels, min_lines), maximal_runs(levels, min_lines)
    if starts is None or runs is None:
        marks = docs.select("doc_id").where("false").withColumn("at", F.array(F.lit(0)))
        tally = docs.select("doc_id").where("false").withColumn("n_runs", F.lit(0).cast("bigint")).withColumn("longest_run", F.lit(0).cast("bigint"))
    else:
        marks = starts.groupBy("doc_id").agg(F.collect_set("at").alias("at"))
        tally = runs.groupBy("doc_id").agg(F.count("*").alias("n_runs"), F.max("length").cast("bigint").alias("longest_run"))
    marks = materialize(marks.join(tally, "doc_id", "full"))
    rows = docs.join(marks.hint("merge"), "doc_id", "left").na.fill(0, ["n_runs", "longest_run"])
    return cut_lines(rows.select("doc_id.doc_id", F.col("text").cast("binary").alias("text"), "at", "n_runs", "longest_run"), min_lines)
