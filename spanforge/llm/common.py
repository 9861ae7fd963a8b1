"""Shared helpers: input tables, shared work folder, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: White space of the word rule: words are maximal runs of other characters.
SPACE = r"[\x20\x09-\x0D]+"

#: Odd 64-bit multipliers for combining word hashes (fixed values).
MULTIPLIERS = (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
    0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3,
    0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2545F4914F6CDD1D,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the setting is missing (tests, a local session) a temporary folder is made.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A row of slices holds some MB. By default a row group is not closed, nor a page, before 100 rows are in it, and
#: writers and readers keep a whole row group in memory: all slices of a large task. So sizes are looked at from the first row on.
_GROUPS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here,
    and a lost executor costs no recomputation of what went before. The shuffle files of the
    job, needed no more, are removed when it ends."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **_GROUPS).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def chunks(batches, column: str = "text", limit: int = 4 << 20):
    """Arrow batches cut into slices whose column holds about limit bytes, so that memory
    per task stays bounded however long the texts are (a single text is never cut)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(
            pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).cast(pa.int64())
        )
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n) + 64
        yield batch.slice(start)


def raw(column) -> list:
    """The UTF-8 bytes of a string column, None for null."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return column.to_pylist()


class WordHash(dict):
    """64-bit hash of each word, cached; the cache is emptied when it reaches its bound."""

    def __init__(self, bound: int = 500_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class ByteWords:
    """Splits texts (bytes) into words and hashes them, all in array operations.

    A word's hash is a polynomial of a random value per byte, taken from prefix sums and made
    independent of its place with the inverse power (modulo 2^64), then mixed with its length.
    Work goes in segments of about ``segment`` bytes that end at white space, so memory stays
    bounded for texts of any length.
    """

    def __init__(self, segment: int = 1 << 19, seed: int = 20240401):
        rng = np.random.default_rng(seed)
        self.segment = segment
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(2**32, 2**63)) * 8 + 3  # odd
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.powers = self.inverse = np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, factor in (("powers", self.base % 2**64), ("inverse", pow(self.base, -1, 2**64))):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def _segment(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, hash) of each word of x."""
        self._grow(len(x) + 1)
        word = np.zeros(len(x) + 2, np.int8)
        word[1:-1] = ~self.space[x]
        edge = np.diff(word)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(self.value[x] * self.powers[: len(x)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.inverse[start]
        return start, mix(h + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words of all texts in order, number of words of each text)."""
        blob = b"\n".join(texts)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        starts, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
        while at < len(blob):
            to = min(len(blob), at + self.segment)
            if to < len(blob):  # on to the next white space
                found = _BREAK.search(blob, to)
                to = found.start() if found else len(blob)
            start, h = self._segment(np.frombuffer(blob, np.uint8, to - at, at))
            starts.append(start + at)
            hashes.append(h)
            at = to
        starts = np.concatenate(starts)
        return np.concatenate(hashes), np.diff(np.searchsorted(starts, begins))


_BREAK = re.compile(rb"[\x20\x09-\x0d]")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def windows(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of width consecutive word hashes; empty if there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(width):
        m = MULTIPLIERS[(j + 5 * seed) % len(MULTIPLIERS)] + 2 * seed
        out += mix(h[j : j + n] + np.uint64(j + 17 * seed)) * np.uint64(m) if seed else h[j : j + n] * np.uint64(m)
    return mix(out)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
