"""MinHash near-duplicate detection with b-bit signatures.

Each document becomes the set of its distinct word shingles. ``bands * rows`` minima of
seeded 32-bit hashes give two things: the band keys, which propose candidates, and the low
``bits`` of the first ``slots`` minima, packed into 64-bit words. A candidate pair is scored
by XOR and bit counts on the packed words; the share of equal lanes is corrected for chance
collisions (2^-bits), and a pair whose estimate lies ``margin`` below the threshold is
dropped. What is left is confirmed on the full shingle sets.

No group is expanded into all its pairs. Exact copies of a set are first folded onto their
least id. Then every bucket proposes only (member, least member); after the connected
components of those links are known, only buckets that still hold two or more components are
looked at again, and there only the members outside the bucket's largest component meet the
rest. A pair inside one component can add nothing, so no link that matters is lost: a true
pair at the threshold is missed by all bands with probability (1 - t^rows)^bands, 8e-6 for
the defaults, and less above it.

Results for odd rows: null or empty text has an empty set and is linked with nothing; fewer
words than a shingle make one shingle of the whole text; repeated rows and ties share the
least id; of several texts under one doc_id the one with the least hash of its set stands for it;
a null doc_id is returned with a null component and kept. Further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, chunks, materialize, mix, raw, signed, windows
from .graph import connected_components

SIGNATURES = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, sig array<bigint>, bands array<bigint>"


def shingle_set(words: list, hashes: WordHash, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one document."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    return np.unique(windows(h, width) if len(h) >= width else windows(h, len(h), 1))


def set_sum(shingles: np.ndarray) -> np.uint64:
    return shingles.sum(dtype=np.uint64)


def set_mixed_sum(shingles: np.ndarray) -> np.uint64:
    return mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)


def pack_bits(minima: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of each row of minima, packed 64 // bits lanes to a 64-bit word."""
    lanes = 64 // bits
    low = (minima & np.uint32((1 << bits) - 1)).astype(np.uint64).reshape(len(minima), -1, lanes)
    return np.bitwise_or.reduce(low << (np.arange(lanes, dtype=np.uint64) * np.uint64(bits)), axis=2)


def signatures(docs: DataFrame, width: int, bands: int, rows: int, bits: int, slots: int) -> DataFrame:
    """One row per document: set size, 128-bit hash of the set, packed low bits, band keys."""
    count = bands * rows

    def run(batches):
        hashes = WordHash()
        rng = np.random.default_rng(20240229)
        mul = rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        add = rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32)
        weights = np.array([rng.integers(1, 2**63, dtype=np.int64) | 1 for _ in range(rows)], dtype=np.uint64)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for part in chunks(batches):
            n = part.num_rows
            minima = np.full((n, count), 0xFFFFFFFF, np.uint32)
            size, a, b = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            for i, text in enumerate(raw(part.column("text"))):
                shingles = shingle_set((text or b"").lower().split(), hashes, width)
                size[i] = len(shingles)
                if not len(shingles):
                    continue
                a[i], b[i] = set_sum(shingles), set_mixed_sum(shingles)
                x = (shingles >> np.uint64(32)).astype(np.uint32)
                least = minima[i]
                for at in range(0, len(x), 256):
                    np.minimum(least, (x[at : at + 256, None] * mul + add).min(axis=0), out=least)
            full = minima.reshape(n, bands, rows).astype(np.uint64)
            keys = mix(mix((full * weights).sum(axis=2, dtype=np.uint64)) + salt)
            sig = pack_bits(minima[:, :slots], bits)
            empty = size == 0
            where = pa.array(np.concatenate([[0], np.cumsum(np.where(empty, 0, bands))]), pa.int32())
            words = sig.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(size), signed(a), signed(b),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * words, pa.int32()), signed(sig.ravel())),
                    pa.ListArray.from_arrays(where, signed(keys[~empty].ravel())),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "sig", "bands"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SIGNATURES)


def shingle_arrays(docs: DataFrame, width: int) -> DataFrame:
    """(id, set_a, set_b, shingles): the full set of each document as an array of 64-bit hashes."""

    def run(batches):
        hashes = WordHash()
        for part in chunks(batches):
            sets = [shingle_set((t or b"").lower().split(), hashes, width) for t in raw(part.column("text"))]
            where = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32())
            sums = (np.array([f(s) for s in sets], np.uint64) for f in (set_sum, set_mixed_sum))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *map(signed, sums), pa.ListArray.from_arrays(where, signed(np.concatenate(sets)))],
                names=["id", "set_a", "set_b", "shingles"],
            )

    return docs.mapInArrow(run, "id bigint, set_a bigint, set_b bigint, shingles array<bigint>")


def long_signatures(sets: DataFrame, bits: int, slots: int) -> DataFrame:
    """(id, long_sig): a longer packed signature from sets(id, shingles)."""

    def run(batches):
        rng = np.random.default_rng(20240301)
        mul = rng.integers(0, 2**32, slots, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        add = rng.integers(0, 2**32, slots, dtype=np.uint64).astype(np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                minima = np.full((part.num_rows, slots), 0xFFFFFFFF, np.uint32)
                for least, found in zip(minima, part.column("shingles")):
                    x = (np.asarray(found.values).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
                    for k in range(0, len(x), 128):
                        np.minimum(least, (x[k : k + 128, None] * mul + add).min(axis=0), out=least)
                sig = pack_bits(minima, bits)
                where = pa.array(np.arange(part.num_rows + 1) * sig.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(where, signed(sig.ravel()))], names=["id", "long_sig"])

    return sets.mapInArrow(run, "id bigint, long_sig array<bigint>")


def estimate(sig_a: Column, sig_b: Column, bits: int, slots: int) -> Column:
    """Collision-corrected similarity of two packed signatures, from bit counts."""
    lanes = 64 // bits
    ones = sum(1 << (bits * k) for k in range(lanes))
    mask = F.lit(ones - 2**64 if ones >= 2**63 else ones).cast("bigint")
    differ = F.lit(0)
    for k in range(slots // lanes):
        x = sig_a.getItem(k).bitwiseXOR(sig_b.getItem(k))
        step = 1
        while step < bits:  # fold each lane onto its lowest bit
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        differ = differ + F.bit_count(x.bitwiseAND(mask))
    chance = 2.0**-bits
    return (1 - differ / F.lit(float(slots)) - chance) / (1 - chance)


def near_duplicates(
    docs: DataFrame,
    *,
    width: int = 5,
    percent: int = 75,
    bands: int = 60,
    rows: int = 6,
    bits: int = 4,
    slots: int = 256,
    margin: float = 0.2,
    long_slots: int = 1024,
    long_margin: float = 0.06,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of
    width-word shingles; component_id is the least doc_id reachable over links.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = materialize(signatures(docs, width, bands, rows, bits, slots))

    # exact copies of a set fold onto their least id
    known = base.where("n_shingles > 0 and doc_id is not null")
    one = known.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b")).alias("s")).select("doc_id", "s.set_a", "s.set_b")  # of several texts of an id
    least = one.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")).where("rep < most").drop("most")
    member = one.join(materialize(least), ["set_a", "set_b"], "left")
    member = materialize(member.select("doc_id", "set_a", "set_b", F.coalesce("rep", "doc_id").alias("rep")))
    reps = member.where("doc_id = rep").select("doc_id", "set_a", "set_b")
    rep_rows = known.join(reps, ["doc_id", "set_a", "set_b"], "left_semi").dropDuplicates(["doc_id"])

    exploded = rep_rows.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key"))
    shared = exploded.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    buckets = materialize(exploded.join(shared.select("key", "least"), "key"))
    ids = buckets.select("id").distinct()
    facts = rep_rows.join(ids, rep_rows.doc_id == ids.id, "left_semi")
    facts = materialize(facts.select(F.col("doc_id").alias("id"), "n_shingles", "sig", "bands", "set_a", "set_b"))
    sets = shingle_arrays(docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text"), width)
    sets = materialize(sets.join(facts.select("id", "set_a", "set_b").hint("merge"), ["id", "set_a", "set_b"], "left_semi").dropDuplicates(["id"]).select("id", "shingles"))
    facts = facts.drop("set_a", "set_b")

    def side(name):
        return facts.select(*(F.col(c).alias(f"{c}_{name}") for c in ("id", "n_shingles", "sig")))

    def plausible(count, slack):
        fits = F.least("n_shingles_a", "n_shingles_b") * 100 >= F.greatest("n_shingles_a", "n_shingles_b") * percent
        return fits & (estimate(F.col("sig_a"), F.col("sig_b"), bits, count) >= percent / 100 - slack)

    def confirmed(pairs):
        """The pairs (a, b) that are links by their full sets."""
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"
        )
        common = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("bigint").alias("i"), (F.size("x") + F.size("y")).alias("n"))
        return common.where(f"100 * i >= {percent} * (n - i)").select("a", "b")

    first = buckets.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    first = materialize(first.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b")).where(plausible(slots, margin)).select("a", "b"))
    links = materialize(confirmed(first))
    label = connected_components(links)

    # buckets that still hold several components: members outside the largest one meet the rest
    at = buckets.select("key", "band", "id").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    per = at.groupBy("key", "component").agg(F.count("*").alias("n"))
    open_keys = per.groupBy("key").agg(F.count("*").alias("k"), F.max_by("component", F.struct("n", "component")).alias("top")).where("k > 1").drop("k")
    open_rows = materialize(at.join(open_keys, "key"))
    open_ids = open_rows.select("id").distinct()
    detail = long_signatures(sets.join(open_ids, "id", "left_semi"), bits, long_slots).withColumnRenamed("long_sig", "sig")
    open_rows = materialize(open_rows.join(detail.join(facts.drop("sig"), "id"), "id"))

    def renamed(df, name):
        return df.select("key", *(F.col(c).alias(f"{c}_{name}") for c in df.columns if c != "key"))

    meet = (F.col("component_a") != F.col("component_b")) & ((F.col("component_b") == F.col("top_b")) | (F.col("id_a") < F.col("id_b")))
    second = renamed(open_rows.where("component <> top"), "a").join(renamed(open_rows, "b"), "key")
    first_shared = F.expr("forall(slice(arrays_zip(bands_a, bands_b), 1, band_a), x -> x.bands_a <> x.bands_b)")
    second = second.where(meet & plausible(long_slots, long_margin) & first_shared).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    second = second.join(first.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")), (F.least("a", "b") == F.col("p")) & (F.greatest("a", "b") == F.col("q")), "left_anti")
    more = materialize(confirmed(materialize(second)))
    # first-round labels stand for their members: link labels, then rename
    named = more.join(label.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(label.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    over = connected_components(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    final = member.drop("set_a", "set_b").join(label, F.col("rep") == F.col("id"), "left").select("doc_id", F.coalesce("component", "rep").alias("c1"))
    final = final.join(over, F.col("c1") == F.col("id"), "left").select("doc_id", F.coalesce("component", "c1").alias("component_id"))
    out = base.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
