"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared in lower case, without ASCII punctuation. Seeds of a benchmark item are pairs
of words that follow each other directly or with one word between them; in a document they may
stand either way too, so a seed outlives any single change inside it. An alignment that is
accepted keeps, of each two of its neighbouring matches on average, one such pair: with less
than half of the words of an item changed, pairs remain wherever the changes lie. How rare a seed
is follows from the corpus frequencies of its words (the sum of their surprisals in bits), not from
its own frequency, so a leaked passage cannot hide by being frequent. Seeds below ``bits`` are left
out (in a corpus so small that its size has fewer bits, those below these), except where an item
would keep less than half of them: then its rarest half stays. Around the
seeds found in a document its passages are cut out (twice the longest item's length to either side) and joined
to items on the seeds; a passage and an item that share seeds of ``evidence`` bits or more (or half of
what the item has, or twice the bits of the corpus size) are aligned (match +2, mismatch -1, gap -1). The score is the best alignment over all
passages, divided by the item's perfect score; from ``threshold`` on the document is contaminated.
Edited and paraphrased copies lose only what was edited. A document is contaminated as well if a passage
and an item align over ``quote`` words of it or more with one error in five at most, however long the
item is. Only passages are shuffled, never whole texts.

The words and seeds of the benchmark go to the tasks as a bit map of ``map_bits`` bits (8 MB), whatever the
size of the benchmark: what passes it by chance drops out in the exact joins behind it. Passages
have numbers of their own, so one that sits in a third of all documents is spread like the documents.

Odd rows: null or empty texts and items match nothing; items of at most three words seed with their
whole sequence; every text of an item_id counts, and so do items without an id; ties go to the
lowest item_id; repeated rows are judged alike, and one doc_id with several texts is contaminated if one of them is; a null
doc_id is returned as not contaminated; bytes that are not UTF-8 count as U+FFFD; further columns are ignored.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIERS, ByteWords, chunks, materialize, mix, raw, signed, windows

_PUNCTUATION = string.punctuation.encode()


def normal(text) -> bytes:
    """The text in lower case, without ASCII punctuation."""
    text = text or b""
    text = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return text.translate(None, _PUNCTUATION)


def align(item: np.ndarray, passage: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = 1) -> int:
    """Best local alignment score of two sequences of word hashes (linear gap cost)."""
    width = len(passage)
    slope = gap * np.arange(width + 1)
    row = np.zeros(width + 1, np.int64)
    best = 0
    for w in item:
        step = np.empty(width + 1, np.int64)
        step[0] = 0
        np.maximum(row[:-1] + np.where(passage == w, match, mismatch), row[1:] - gap, out=step[1:])
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + slope) - slope  # gaps along the passage
        best = max(best, int(row.max()))
    return best


def quotes(item: np.ndarray, passage: np.ndarray, length: int) -> bool:
    """Whether an alignment of length words of the item or more, from a match to a match, has
    at most one error in five of them. Of one twice as long as length / 0.8, a half without the
    errors at its cut is enough, so the most words with up to e errors are followed for the e
    below that."""
    most = _errors(length)
    rows = np.zeros((most, len(passage) + 1), np.int32)
    need = np.maximum(length, 5 * np.arange(most))[:, None]
    for w in item:
        new = np.zeros_like(rows)
        same = passage == w
        new[:, 1:] = np.where(same, rows[:, :-1] + 1, 0)
        if (new[:, 1:] >= need).any():
            return True
        for e in range(1, most):
            before = np.maximum(rows[e - 1, :-1], rows[e - 1, 1:])
            before = np.maximum(np.where(before > 0, before + 1, 0), new[e - 1, :-1])  # a further passage word adds none
            np.maximum(new[e, 1:], before, out=new[e, 1:])
        rows = new
    return False


def _errors(length: int) -> int:
    return (2 * -(-5 * length // 4) - 1) // 5 + 1


def item_words(items: DataFrame) -> DataFrame:
    """(item, item_id, words): the word hashes of each different text of an item, under a number of its own."""

    def run(batches):
        split = ByteWords()
        for part in chunks(batches):
            h, sizes = split([normal(t) for t in raw(part.column("text"))])
            where = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.ListArray.from_arrays(where, signed(h))], names=["item_id", "words"])

    found = items.mapInArrow(run, "item_id bigint, words array<bigint>")
    found = found.where("size(words) > 0").dropDuplicates(["item_id", "words"])
    return found.select(F.monotonically_increasing_id().alias("item"), "item_id", "words")


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) * np.uint64(MULTIPLIERS[0]) + second)


def item_seeds(items: DataFrame) -> DataFrame:
    """(item, key, words, k): the seeds of items(item, words), once each; k is 2, or the
    number of words of an item of at most SHORT words."""

    def run(batches):
        for batch in batches:
            out = []
            for i, found in zip(batch.column("item").to_pylist(), batch.column("words")):
                h = np.asarray(found.values).view(np.uint64)
                if len(h) <= SHORT:
                    out.append((i, int(windows(h, len(h), 1).view(np.int64)[0]), h.view(np.int64).tolist(), -len(h)))
                    continue
                pairs = np.concatenate([np.stack([h[:-g], h[g:]], 1) for g in (1, 2)])
                keys, at = np.unique(pair_keys(pairs[:, 0], pairs[:, 1]), return_index=True)
                out += [(i, key, words, 2) for key, words in zip(keys.view(np.int64).tolist(), pairs[at].view(np.int64).tolist())]
            item, key, words, k = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array(key, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(k, pa.int32())],
                names=["item", "key", "words", "k"],
            )

    return items.mapInArrow(run, "item bigint, key bigint, words array<bigint>, k int")


SHORT = 3


class _Wanted:
    """Tells which 64-bit keys may be wanted: those whose top bits are set in a bit map."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = np.uint64(64 - (len(bits) * 8).bit_length() + 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return np.flatnonzero((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)


def bit_map(df: DataFrame, width: int):
    """The broadcast bit map of 2^width bits of the keys of df(key); only its bytes that are set
    come to the driver, at most 2^(width - 3) however many keys there are."""
    at = F.shiftrightunsigned("key", 64 - width)
    byte = df.select(F.shiftright(at, 3).alias("byte"), F.expr(f"shiftleft(1, cast(shiftrightunsigned(key, {64 - width}) & 7 as int))").alias("bit"))
    rows = byte.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (width - 3), np.uint8)
    bits[rows["byte"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.uint8)
    return df.sparkSession.sparkContext.broadcast(bits)


def word_counts(docs: DataFrame, wanted) -> DataFrame:
    """(total, key, n): counts of wanted words, and of all words where total holds."""

    def run(batches):
        split, chosen = ByteWords(), _Wanted(wanted.value)
        for part in chunks(batches):
            h, _ = split([normal(t) for t in raw(part.column("text"))])
            keys, counts = np.unique(h[chosen(h)], return_counts=True)
            total = np.zeros(len(keys) + 1, bool)
            total[-1] = True
            keys, counts = np.append(keys, np.uint64(0)), np.append(counts, len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(total), signed(keys), pa.array(counts)], names=["total", "key", "n"])

    return docs.mapInArrow(run, "total boolean, key bigint, n bigint")


def passages(docs: DataFrame, wanted, shorts: list[int], reach: int) -> DataFrame:
    """(passage, doc_id, words, keys): the passages of all documents around wanted seeds (pairs,
    and sequences of the lengths in shorts), as word hashes with the different keys found in them;
    hits whose surroundings of reach words meet share a passage."""

    def run(batches):
        split, chosen, name = ByteWords(), _Wanted(wanted.value), TaskContext.get().partitionId() << 40
        for part in chunks(batches):
            named = part.filter(part.column("doc_id").is_valid())
            h, sizes = split([normal(t) for t in raw(named.column("text"))])
            ends = np.cumsum(sizes)
            at, key, width = [], [], []
            for k in (-1, -2, *shorts):  # the second word of a pair 1 or 2 on, or a whole sequence of k
                g = windows(h, k, 1) if k > 0 else pair_keys(h[:k], h[-k:])
                span = k if k > 0 else 1 - k
                hit = chosen(g)
                hit = hit[hit + span <= ends[np.searchsorted(ends, hit, side="right")]]
                at.append(hit)
                key.append(g[hit])
                width.append(np.full(len(hit), span))
            at, key, width = np.concatenate(at), np.concatenate(key), np.concatenate(width)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, key, width = at[order], key[order], width[order]
            of = np.searchsorted(ends, at, side="right")
            new = np.ones(len(at), bool)
            new[1:] = (of[1:] != of[:-1]) | (np.diff(at) > 2 * reach)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            doc = of[first]
            low = np.maximum(at[first] - reach, (ends - sizes)[doc])
            high = np.minimum(at[last] + width[last] + reach, ends[doc])
            words = np.concatenate([h[a:b] for a, b in zip(low, high)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(name + np.arange(len(first))), named.column("doc_id").take(pa.array(doc)),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(high - low)), pa.int32()), signed(words)),
                    pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), signed(key)),
                ],
                names=["passage", "doc_id", "words", "keys"],
            )
            name += len(first)

    return docs.mapInArrow(run, "passage bigint, doc_id bigint, words array<bigint>, keys array<bigint>")


def aligned(pairs: DataFrame, threshold: float, quote: int) -> DataFrame:
    """pairs(doc_id, item_id, sought, words) -> (doc_id, item_id, score, hit)."""
    errors = np.arange(_errors(quote))
    floor = int((2 * np.maximum(quote, 5 * errors) - 3 * errors).min())  # no quote scores less

    def run(batches):
        for batch in batches:
            score, hit = [], []
            for item, words in zip(batch.column("sought"), batch.column("words")):
                item, words = np.asarray(item.values), np.asarray(words.values)
                best = align(item, words)
                score.append(round(best / (2 * len(item)), 4))
                hit.append(score[-1] >= threshold or (best >= floor and quotes(item, words, quote)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("item_id"), pa.array(score, pa.float64()), pa.array(hit, pa.bool_())],
                names=["doc_id", "item_id", "score", "hit"],
            )

    return pairs.mapInArrow(run, "doc_id bigint, item_id bigint, score double, hit boolean")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    bits: float = 24.0,
    evidence: float = 40.0,
    threshold: float = 0.5,
    quote: int = 13,
    map_bits: int = 26,
) -> DataFrame:
    """(doc_id, item_id, score, contaminated) for every row of docs(doc_id, text): the item of
    items(item_id, text) that contaminates most, with its score; null if none does."""
    binary = lambda df, name: df.select(F.col(name).cast("bigint").alias(name), F.col("text").cast("string").cast("binary").alias("text"))
    docs, items = binary(docs, "doc_id"), binary(items, "item_id")
    items = materialize(item_words(items))
    grams = materialize(item_seeds(items))
    facts = items.agg(F.max(F.size("words")).alias("longest"), F.collect_set(F.when(F.size("words") <= SHORT, F.size("words"))).alias("shorts")).first()
    longest = facts.longest or 0

    words = grams.select(F.explode("words").alias("key")).distinct()
    counts = word_counts(docs, bit_map(words, map_bits)).groupBy("total", "key").agg(F.sum("n").alias("n"))
    counts = materialize(counts)
    corpus = counts.where("total").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("corpus"), F.log2(F.coalesce(F.sum("n"), F.lit(0)) + 2).alias("most"))
    each = grams.select("item", "key", "k", F.explode("words").alias("word"))
    each = each.join(counts.where("not total").select(F.col("key").alias("word"), "n"), "word", "left").join(F.broadcast(corpus))
    surprisal = -F.log2((F.coalesce("n", F.lit(0)) + 1) / (F.col("corpus") + 1))
    each = each.groupBy("item", "key", "k").agg(F.sum(surprisal).alias("bits"), F.max("most").alias("most"))
    middle = each.groupBy("item").agg(F.percentile("bits", 0.5).alias("middle"))
    seeds = each.join(middle, "item").where((F.col("bits") >= F.least(F.lit(bits), F.col("most"))) | (F.col("bits") >= F.col("middle")) | (F.col("k") < 0))
    seeds = materialize(seeds.select("item", "key", "bits", "most"))
    needs = seeds.groupBy("item").agg(F.least(F.lit(evidence), F.sum("bits") / 2, 2 * F.max("most")).alias("need"))

    found = materialize(passages(docs, bit_map(seeds, map_bits), sorted(facts.shorts), 2 * longest))  # as far as an accepted alignment reaches
    shared = found.select("passage", F.explode(F.array_distinct("keys")).alias("key")).join(seeds.select("item", "key", "bits"), "key")
    shared = shared.groupBy("passage", "item").agg(F.sum("bits").alias("shared"))
    shared = shared.join(items.withColumnRenamed("words", "sought").join(needs, "item"), "item").where("shared >= need")
    pairs = shared.select("passage", "item_id", "sought").join(found.select("passage", "doc_id", "words"), "passage")
    best = F.max(F.struct("hit", "score", (-F.col("item_id")).alias("item"))).alias("best")
    top = aligned(pairs.select("doc_id", "item_id", "sought", "words"), threshold, quote).where("hit").groupBy("doc_id").agg(best)
    top = top.select("doc_id", (-F.col("best.item")).alias("item_id"), F.col("best.score").alias("score"), F.col("best.hit").alias("hit"))
    out = docs.select("doc_id").join(top, "doc_id", "left")
    return out.withColumn("contaminated", F.coalesce("hit", F.lit(False))).drop("hit")
