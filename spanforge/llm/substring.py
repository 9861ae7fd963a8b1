"""Substring dedup by difference-cover anchors.

A window is ``length`` consecutive words. Anchors are shorter windows (``length - period + 1``
words) that start only at positions whose residue modulo ``period`` lies in a difference
cover, so for any two equal windows some shift brings both starts onto cover positions: they
share an aligned anchor. Anchors that occur in one place only are thus out after a single
exchange of 3/7 of the positions. Around each shared anchor the match is extended: all windows
that contain it are hashed (96 bits), and a window that also starts in a document with a
smaller id marks its words.

Both exchanges run between slices of documents and buckets of keys (see ``slices``): a slice
sends every key once, however many of its documents hold it, so a passage in a third of all
documents loads no single task, and what a bucket holds depends on the number of buckets only.

Odd rows: null or empty text has no words; texts shorter than a window lose nothing; text that
is not valid UTF-8 is cut at its bytes like any other; repeated rows with one doc_id, also with different texts, count
as one document; a null doc_id is left as it is. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteWords, chunks, materialize, raw, windows
from .slices import answered, flat, lists, sent, settled, sizes

#: A perfect difference cover: every residue modulo 7 is a difference of two members.
PERIOD, COVER = 7, (0, 1, 3)


def text_slices(docs: DataFrame, limit: int) -> DataFrame:
    """(slice, doc_id array, text array, n_bytes) of docs(doc_id, text binary)."""

    def run(batches):
        name = TaskContext.get().partitionId() << 32
        for part in chunks(batches, limit=limit):
            texts = [t or b"" for t in raw(part.column("text"))]
            one = np.array([0, len(texts)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), lists(part.column("doc_id"), one), lists(pa.array(texts, pa.binary()), one), pa.array([sum(map(len, texts))])],
                names=["slice", "doc_id", "text", "n_bytes"],
            )
            name += 1

    return docs.mapInArrow(run, "slice bigint, doc_id array<bigint>, text array<binary>, n_bytes bigint")


def _anchors(split: ByteWords, named: np.ndarray, texts: list, length: int):
    """(word hashes, documents' first words and ends, places of anchors, their keys) of the
    documents that have an id and a window."""
    h, n = split(texts)
    ends = np.cumsum(n)
    starts = ends - n
    width = length - PERIOD + 1
    key = windows(h, width)
    of = np.repeat(np.arange(len(n)), n)[: len(key)]
    at = np.arange(len(key))
    inside = np.isin((at - starts[of]) % PERIOD, COVER) & (at + width <= ends[of]) & ((n >= length) & named)[of]
    at = np.flatnonzero(inside)
    return h, starts, ends, of[at], at, key[at]


def _parts(batch):
    """(slice, ids with 0 for null, which have one, texts) per row of a batch of slices."""
    for i, name in enumerate(batch.column("slice").to_pylist()):
        ids = batch.column("doc_id")[i].values
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        yield name, ids.fill_null(0).to_numpy(), named, raw(batch.column("text")[i].values)


def anchor_keys(slices: DataFrame, length: int, buckets: int) -> DataFrame:
    """(slice, bucket, keys): the different anchors of each slice."""

    def run(batches):
        split = ByteWords()
        for batch in batches:
            for name, _, named, texts in _parts(batch):
                yield sent(name, np.unique(_anchors(split, named, texts, length)[-1]), buckets)

    return slices.mapInArrow(run, "slice bigint, bucket bigint, keys array<bigint>")


def _elsewhere(table: pa.Table) -> pa.Table:
    """Per key, whether another slice sends it too."""
    _, place, n = np.unique(flat(table.column("keys")), return_inverse=True, return_counts=True)
    limits = np.append(0, np.cumsum(sizes(table.column("keys"))))
    return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "shared": lists(n[place] > 1, limits)})


WINDOWS = "slice bigint, bucket bigint, keys array<bigint>, two array<int>, low array<bigint>, of array<int>, at array<int>"


def candidate_windows(slices: DataFrame, answers: DataFrame, length: int, buckets: int) -> DataFrame:
    """WINDOWS: the different windows around shared anchors of each slice, by 64 and 32 bits
    of hash, with the least document of the slice; and in a row without a bucket where all of
    them start, as place of the document in the slice and word."""
    width = length - PERIOD + 1

    def finish(slice_rows: pa.Table, found: pa.Table) -> pa.Table:
        (batch,) = slice_rows.combine_chunks().to_batches()
        ((name, ids, named, texts),) = _parts(batch)
        h, starts, ends, of, at, key = _anchors(ByteWords(), named, texts, length)
        keys, place = np.unique(key, return_inverse=True)
        low, high = (np.full(len(keys), edge) for edge in (np.iinfo(np.int64).max, np.iinfo(np.int64).min))
        np.minimum.at(low, place, ids[of])
        np.maximum.at(high, place, ids[of])
        hit = ((low < high) | flat(found.column("shared")).astype(bool))[place] if len(keys) else np.zeros(0, bool)
        of, at = of[hit], at[hit]
        edge = np.zeros(len(h) + 1, np.int32)
        np.add.at(edge, np.maximum(at - (length - width), starts[of]), 1)
        np.add.at(edge, np.minimum(at, ends[of] - length) + 1, -1)
        at = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        of = np.searchsorted(ends, at, side="right")
        one, two = _window_keys(h, at, length)
        order, first, place = _distinct(one, two)
        least = np.minimum.reduceat(ids[of][order], first) if len(order) else np.empty(0, np.int64)
        out = sent(name, one[order][first], buckets, two=two[order][first], low=least)
        none = pa.nulls(out.num_rows, pa.list_(pa.int32()))
        out = pa.Table.from_batches([out.append_column("of", none).append_column("at", none)])
        whole = np.array([0, len(at)])
        own = {"slice": [name], "bucket": pa.nulls(1, pa.int64()), "of": lists(pa.array(of, pa.int32()), whole), "at": lists(pa.array(at - starts[of], pa.int32()), whole)}
        own = pa.table([own[f.name] if f.name in own else pa.nulls(1, f.type) for f in out.schema], schema=out.schema)
        return pa.concat_tables([out, own]).select([c.split()[0] for c in WINDOWS.split(", ")])

    return settled(slices, answers, finish, WINDOWS)


def _window_keys(h: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    return windows(h, length)[at], (windows(h, length, 3)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _distinct(one: np.ndarray, two: np.ndarray):
    """(order, first, place): an order of the pairs, where in it each different pair begins, and
    the number of each pair among the different ones."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), place


def _least(table: pa.Table) -> pa.Table:
    """Per window, the least document of all slices."""
    order, first, place = _distinct(flat(table.column("keys")).view(np.uint64), flat(table.column("two")))
    low = np.minimum.reduceat(flat(table.column("low"))[order], first) if len(order) else np.empty(0, np.int64)
    limits = np.append(0, np.cumsum(sizes(table.column("keys"))))
    return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "low": lists(low[place], limits)})


KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text binary"


def cut(slices: DataFrame, answers: DataFrame, length: int) -> DataFrame:
    """KEPT of slices(slice, doc_id, text, of, at) and the least document of each window."""

    def finish(slice_rows: pa.Table, found: pa.Table) -> pa.Table:
        (batch,) = slice_rows.combine_chunks().to_batches()
        ((_, ids, _, texts),) = _parts(batch)
        of, at = (np.asarray(batch.column(c)[0].values) for c in ("of", "at"))
        chosen = np.unique(of)
        h, n = ByteWords()([texts[i] for i in chosen])
        begin = np.zeros(len(texts), np.int64)
        begin[chosen] = np.cumsum(n) - n
        one, two = _window_keys(h, begin[of] + at, length)
        order, _, place = _distinct(one, two)
        gone = flat(found.column("low"))[place] < ids[of] if len(of) else np.zeros(0, bool)
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        n_words, removed, kept = [], [], []
        for i, text in enumerate(texts):
            words = text.split()
            n_words.append(len(words))
            starts = at[bounds[i] : bounds[i + 1]][gone[bounds[i] : bounds[i + 1]]]
            if len(starts):
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + length, -1)
                out = np.cumsum(edge)[:-1] > 0
                removed.append(int(out.sum()))
                words = [words[k] for k in np.flatnonzero(~out)]
            else:
                removed.append(0)
            kept.append(b" ".join(words))
        return pa.table([batch.column("doc_id")[0].values, pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return settled(slices, answers, finish, KEPT)


def substring_dedup(docs: DataFrame, *, length: int = 13, slice_bytes: int = 4 << 20, bucket_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row of docs(doc_id, text): the text
    without each word covered by a window of length words that also starts in a document
    with a smaller doc_id. Windows are judged on the input; length must be above 7."""
    if length <= PERIOD:
        raise ValueError(f"length must be above {PERIOD}")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    slices = materialize(text_slices(docs, slice_bytes))
    buckets = (slices.agg(F.sum("n_bytes")).first()[0] or 0) // bucket_bytes + 1
    shared = materialize(answered(anchor_keys(slices, length, buckets), _elsewhere, "slice bigint, bucket bigint, shared array<boolean>"))
    found = materialize(candidate_windows(slices, shared, length, buckets))
    least = answered(found.where("bucket is not null").select("slice", "bucket", "keys", "two", "low"), _least, "slice bigint, bucket bigint, low array<bigint>")
    least = materialize(least)
    out = cut(slices.join(found.where("bucket is null").select("slice", "of", "at"), "slice"), least, length)
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))


#: The query with windows of 13 words, as plain SQL.
SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13)),
low AS (SELECT key, min(doc_id) AS least FROM win GROUP BY key),
gone AS (SELECT DISTINCT doc_id, p + j AS i FROM win JOIN low USING (key), (SELECT unnest(range(13)) AS j) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
tally AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN tally USING (doc_id)"""
