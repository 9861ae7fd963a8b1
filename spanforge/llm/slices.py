"""Slices: documents kept together in the rows of a written table, from which keys travel out
and what is found about them travels back.

A slice holds the documents of one stretch of a task. For each step it derives its distinct keys, sorted, and
sends them cut into buckets: one row per bucket with the keys as one array. All rows of a
bucket meet in one group, whose size follows from the number of buckets, not from how often a
key occurs: a slice sends a key once, however many of its documents hold it. The answer of a
bucket has one place per key sent and goes back to the slice. So the shuffles carry arrays
instead of one row per occurrence.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, signed


def cuts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, limits) of sorted 64-bit keys: the non-empty buckets and where each begins, and the end."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, np.diff(bucket) != 0)) if len(keys) else np.empty(0, np.int64)
    return bucket[first].astype(np.int64), np.append(first, len(keys)) if len(keys) else np.zeros(1, np.int64)


def lists(values, limits: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(limits, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def sent(slice_id: int, keys: np.ndarray, buckets: int, **values: np.ndarray) -> pa.RecordBatch:
    """The rows of one slice: (slice, bucket, keys, further arrays along the keys)."""
    bucket, limits = cuts(keys, buckets)
    columns = {"slice": pa.array(np.full(len(bucket), slice_id)), "bucket": pa.array(bucket), "keys": lists(signed(keys), limits)}
    columns |= {name: lists(v, limits) for name, v in values.items()}
    return pa.RecordBatch.from_pydict(columns)


def flat(column) -> np.ndarray:
    """All values of a list column without nulls, in order."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    found = [np.asarray(c.flatten()) for c in chunks]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def sizes(column) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    found = [np.diff(np.asarray(c.offsets)) for c in chunks]
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


def answered(rows: DataFrame, answer: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """The answers of all buckets of rows(slice, bucket, keys, ...)."""
    return rows.groupBy("bucket").applyInArrow(answer, schema)


def settled(slices: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema: str, by: tuple = ("bucket",)) -> DataFrame:
    """finish(slice row, its answers in the order they were sent in) of every slice."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return finish(left, right.sort_by([(c, "ascending") for c in by]))

    return slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, schema)


def narrow(name: str, values: np.ndarray, limits: np.ndarray) -> dict[str, pa.Array]:
    """Non-negative counts as two list columns: name with 15 bits of each, and name_high with
    what is above them (null if nothing is), for most counts are small."""
    high = values >> 15
    low = lists(pa.array(values & 0x7FFF, pa.int16()), limits)
    return {name: low, f"{name}_high": lists(pa.array(high, pa.int64()), limits) if high.any() else pa.nulls(len(limits) - 1, pa.list_(pa.int64()))}


def widened(table: pa.Table, name: str) -> np.ndarray:
    """The counts that narrow() made two list columns of; null lists are passed over."""
    low, high = table.column(name), table.column(f"{name}_high")
    out = flat(low).astype(np.int64)
    if high.null_count < len(high):
        length = np.where(np.asarray(low.is_null()), 0, sizes(low))
        at = np.append(0, np.cumsum(length))
        for i in np.flatnonzero(np.asarray(high.is_valid())):
            out[at[i] : at[i + 1]] += np.asarray(high[int(i)].values) << 15
    return out


def tallied(rows: DataFrame, slices: int, decorate: Callable[[np.ndarray, np.ndarray], dict], extra: str, word_list: bool = False) -> tuple[DataFrame, DataFrame]:
    """Corpus totals of rows(slice, bucket, keys sorted and distinct, n[, words]), and what decorate(keys, n)
    makes of them, per key of a bucket: named arrays with the types of extra, in order.

    Slices form about sqrt(slices) families. Counts are first added up within (family, bucket), then the
    families of a bucket meet, and totals go back the same way, so what one group holds grows with the
    square root of the number of slices even for a key that every slice sends.
    -> (a table (bucket, keys, n, extra...[, words]) with one row per bucket, of those keys that the mask
    "keep" of decorate chooses, or None without word_list, which says that rows have words (binary values that
    are the same wherever a key is); the answers (slice, bucket, extra...), one row per row of rows)."""
    families = max(1, round(slices**0.5))
    rows = rows.withColumn("family", F.pmod(F.xxhash64("slice"), F.lit(families)))
    names = [x.split()[0] for x in extra.split(", ")]
    text = ", words array<binary>" if word_list else ""

    def gathered(table: pa.Table):
        keys, first, place = np.unique(flat(table.column("keys")), return_index=True, return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, place, flat(table.column("n")))
        words = {}
        if word_list:
            words["words"] = table.column("words").combine_chunks().flatten().take(pa.array(first))
        return keys, n, words, place

    def merge(table: pa.Table) -> pa.Table:
        keys, n, words, _ = gathered(table)
        whole = np.array([0, len(keys)])
        return pa.table({"family": table.column("family")[:1], "bucket": table.column("bucket")[:1], "keys": lists(keys, whole), "n": lists(n, whole), **{k: lists(v, whole) for k, v in words.items()}})

    def total(table: pa.Table) -> pa.Table:
        keys, n, words, place = gathered(table)
        made = decorate(keys, n)
        limits = np.append(0, np.cumsum(sizes(table.column("keys"))))
        out = {"bucket": table.column("bucket"), "family": table.column("family"), "keys": table.column("keys")}
        out |= {name: lists(made[name][place], limits) for name in names}
        if not word_list:
            return pa.table(out)
        at = np.flatnonzero(made["keep"])
        whole = np.array([0, len(at)])
        own = {"bucket": table.column("bucket")[:1], "family": pa.nulls(1, pa.int64()), "keys": lists(keys[at], whole)}
        own |= {name: lists(made[name][at], whole) for name in names}
        own |= {"n": lists(n[at], whole), "words": lists(words["words"].take(pa.array(at)), whole)}
        out |= {"n": pa.nulls(table.num_rows, pa.list_(pa.int64())), "words": pa.nulls(table.num_rows, pa.list_(pa.binary()))}
        return pa.concat_tables([pa.table(out), pa.table(own)])

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        found = flat(right.column("keys"))
        place = np.searchsorted(found, flat(left.column("keys")))
        limits = np.append(0, np.cumsum(sizes(left.column("keys"))))
        out = {"slice": left.column("slice"), "bucket": left.column("bucket")}
        return pa.table(out | {name: lists(flat(right.column(name))[place], limits) for name in names})

    merged = rows.groupBy("family", "bucket").applyInArrow(merge, f"family bigint, bucket bigint, keys array<bigint>, n array<bigint>{text}")
    more = f", n array<bigint>{text}" if word_list else ""
    totals = materialize(materialize(merged).groupBy("bucket").applyInArrow(total, f"bucket bigint, family bigint, keys array<bigint>, {extra}{more}"))
    back = totals.where("family is not null").select("bucket", "family", "keys", *names)
    left = rows.drop("n", "words").groupBy("family", "bucket")
    answers = left.cogroup(back.groupBy("family", "bucket")).applyInArrow(look_up, f"slice bigint, bucket bigint, {extra}")
    return totals.where("family is null").drop("family") if word_list else None, answers
