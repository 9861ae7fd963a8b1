"""Cross-entropy difference of two matched n-gram models.

Word bigram models over one shared vocabulary: all words of the corpus, with an edge mark
around each document. Counts are gathered over all documents (background) and over all target
documents and smoothed by interpolation with the shorter context:
p(w|v) = (n(vw) + k p(w)) / (n(v.) + k), p(w) = (n(w) + k / V) / (N + k).

Documents are kept in slices (see ``slices``). A slice sends the counts of its distinct words
and bigrams, as 64-bit keys, to the buckets of the whole corpus (those that stand once go
without a count) and gets back how often each stands elsewhere, where it does; with that it
scores its documents. So what is gathered grows with
the corpus, a bigram that stands in every document costs one entry per slice, texts are read
once and nothing is collected but three sums.

Each document gets the mean loss per token, in bits, under both models and their difference
(negative: closer to the target). The documents of the target itself are scored like all
others.

Odd rows: null or empty text, or one without words, has no tokens and losses 0; repeated rows
count each time; a target without documents gives the uniform model; a null doc_id is scored
and belongs to no target; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteWords, chunks, materialize, mix, raw, signed
from .slices import answered, cuts, flat, lists, narrow, sent, settled, sizes, widened

SLICES = "slice bigint, doc_id array<bigint>, length array<int>, vocabulary array<bigint>, codes array<int>, n bigint"
_EDGE, _LOW = np.uint64(2), np.uint64(1)


def word_slices(docs: DataFrame, limit: int) -> DataFrame:
    """Slices of docs(doc_id, text binary): ids, number of words of each document, sorted word
    hashes and the place of each word among them."""

    def run(batches):
        split, name = ByteWords(), TaskContext.get().partitionId() << 32
        for part in chunks(batches, limit=limit):
            h, length = split([t or b"" for t in raw(part.column("text"))])
            vocabulary, codes = np.unique(np.append(h, _EDGE), return_inverse=True)
            one = lambda values: lists(values, np.array([0, len(values)]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name]), one(part.column("doc_id")), one(pa.array(length, pa.int32())), one(signed(vocabulary)),
                    one(pa.array(codes[:-1], pa.int32())), pa.array([len(h)]),
                ],
                names=["slice", "doc_id", "length", "vocabulary", "codes", "n"],
            )
            name += 1

    return docs.mapInArrow(run, SLICES)


class Grams:
    """Words and bigrams of a slice: their keys, counts and where they stand."""

    def __init__(self, row: dict):
        vocabulary = row["vocabulary"].view(np.uint64)
        codes, length = row["codes"].astype(np.int64), row["length"].astype(np.int64)
        edge = int(np.searchsorted(vocabulary, _EDGE))
        self.full = np.flatnonzero(length)  # documents with words
        self.tokens = np.where(length > 0, length + 1, 0)
        starts = np.cumsum(length[self.full]) - length[self.full]
        before, self.word = np.insert(codes, starts, edge), np.insert(codes, starts + length[self.full], edge)
        pair, self.place = np.unique(before * len(vocabulary) + self.word, return_inverse=True)
        self.context, self.second = pair // len(vocabulary), pair % len(vocabulary)
        word_key = mix(vocabulary) & ~_LOW
        pair_key = mix(mix(vocabulary[self.context]) * np.uint64(0x9E3779B97F4A7C15) + vocabulary[self.second]) | _LOW
        keys = np.concatenate([word_key, pair_key])
        self.words = len(vocabulary)
        chosen = np.zeros(len(length), bool)
        chosen[row["near"]] = True
        near = np.repeat(chosen[self.full], self.tokens[self.full]).astype(np.float64)
        self.n = self.count(None)
        self.near = self.count(near)
        # 0 and 1: stands once, outside or in the target; 2: all others
        self.kind = np.where(self.n == 1, self.near, 2)
        self.order = np.lexsort((keys, self.kind))
        self.keys = keys[self.order]

    def count(self, weights) -> np.ndarray:
        """Counts of all words, then of all bigrams."""
        pairs = np.bincount(self.place, weights, len(self.context))
        return np.concatenate([np.bincount(self.second, pairs, self.words), pairs]).astype(np.int64)

    def losses(self, n: np.ndarray, size: int, total: int, k: float) -> np.ndarray:
        """Loss in bits of each bigram of the slice, by counts over the corpus."""
        p = (n[self.second] + k / max(size, 1)) / (total + k)
        return -np.log2((n[self.words :] + k * p) / (n[self.context] + k))


def _row(table: pa.Table | pa.RecordBatch, i: int) -> dict:
    return {name: np.asarray(table.column(name)[i].values) for name in ("vocabulary", "codes", "length", "near")}


def gram_counts(slices: DataFrame, buckets: int) -> DataFrame:
    """(slice, bucket, kind, keys, n, near): the counts each slice sends, null where the kind tells them."""

    def run(batches):
        for batch in batches:
            for i, name in enumerate(batch.column("slice").to_pylist()):
                grams = Grams(_row(batch, i))
                bounds = np.searchsorted(grams.kind[grams.order], np.arange(4))
                for kind in range(3):
                    here = slice(*bounds[kind : kind + 2])
                    order = grams.order[here]
                    out = sent(name, grams.keys[here], buckets)
                    columns = {c: out.column(c) for c in out.schema.names} | {"kind": pa.array(np.full(out.num_rows, kind))}
                    for c, counts in (("n", grams.n), ("near", grams.near)):
                        if kind == 2:
                            columns |= narrow(c, counts[order], cuts(grams.keys[here], buckets)[1])
                        else:
                            columns |= {c: pa.nulls(out.num_rows, pa.list_(pa.int16())), f"{c}_high": pa.nulls(out.num_rows, pa.list_(pa.int64()))}
                    yield pa.RecordBatch.from_pydict(columns)

    return slices.mapInArrow(run, f"slice bigint, bucket bigint, keys array<bigint>, kind bigint, {_narrow('n')}, {_narrow('near')}")


def _narrow(name: str) -> str:
    return f"{name} array<smallint>, {name}_high array<bigint>"


ANSWERS = f"slice bigint, bucket bigint, kind bigint, sent bigint, {_narrow('gap')}, {_narrow('n')}, {_narrow('near')}, size bigint, words bigint, near_words bigint"


def _elsewhere(table: pa.Table) -> pa.Table:
    """Counts in other slices of the keys that have some, by their distance from the one before; on the first
    row the number of different words of the bucket and how often they stand in corpus and target."""
    found, place = np.unique(flat(table.column("keys")), return_inverse=True)
    length = sizes(table.column("keys"))
    kind = np.repeat(table.column("kind").to_numpy(), length)
    word = (found & 1) == 0
    columns = {c: table.column(c) for c in ("slice", "bucket", "kind")} | {"sent": pa.array(length)}
    sums, other = {"size": int(word.sum())}, {}
    for name, what in (("n", "words"), ("near", "near_words")):
        own = np.minimum(kind, 1) if name == "near" else np.ones(len(kind), np.int64)
        own[kind == 2] = widened(table, name)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, place, own)
        other[name] = total[place] - own
        sums[what] = int(total[word].sum())
    hit = np.flatnonzero(other["n"])
    starts = np.append(0, np.cumsum(length))
    limits = np.searchsorted(hit, starts)
    gap = np.diff(hit, prepend=0)
    begin = np.flatnonzero(np.diff(limits))
    gap[limits[begin]] = hit[limits[begin]] - starts[begin]
    columns |= narrow("gap", gap, limits)
    for name, v in other.items():
        columns |= narrow(name, v[hit], limits)
    for name, value in sums.items():
        column = np.zeros(table.num_rows, np.int64)
        column[0] = value
        columns[name] = pa.array(column)
    return pa.table(columns).select([c.split()[0] for c in ANSWERS.split(", ")])


def _places(found: pa.Table) -> np.ndarray:
    """Where in the order of sending the keys stand that answers(sent, gap) are about."""
    gap, length = widened(found, "gap"), sizes(found.column("gap"))
    before = np.cumsum(np.append(0, found.column("sent").to_numpy()))[:-1]
    first = (np.cumsum(length) - length)[length > 0]
    upto = np.cumsum(gap)
    return upto + np.repeat(before[length > 0] - (upto[first] - gap[first]), length[length > 0])


SCORES = "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double"


def score_words(docs: DataFrame, target_ids: DataFrame, *, k: float = 5.0, slice_bytes: int = 4 << 20, bucket_words: int = 1 << 18) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for every row of docs(doc_id,
    text); target_ids(doc_id) names the target documents."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    slices = materialize(word_slices(docs, slice_bytes))
    ids = target_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    near = slices.select("slice", F.posexplode("doc_id").alias("near", "doc_id")).join(ids, "doc_id", "left_semi")
    near = materialize(near.groupBy("slice").agg(F.collect_list("near").alias("near")))
    marked = slices.join(near, "slice", "left").withColumn("near", F.coalesce("near", F.array().cast("array<int>")))
    buckets = (slices.agg(F.sum("n")).first()[0] or 0) // bucket_words + 1
    answers = materialize(answered(gram_counts(marked, buckets), _elsewhere, ANSWERS))
    size, every, target = (int(x or 0) for x in answers.agg(F.sum("size"), F.sum("words"), F.sum("near_words")).first())

    def finish(slice_rows: pa.Table, found: pa.Table) -> pa.Table:
        grams = Grams(_row(slice_rows.combine_chunks(), 0))
        at, means = grams.order[_places(found)], []
        for own, name, total in ((grams.near, "near", target), (grams.n, "n", every)):
            counts = own.copy()
            counts[at] += widened(found, name)
            loss = grams.losses(counts, size, total, k)[grams.place]
            mean = np.zeros(len(grams.tokens))
            if len(grams.full):
                n = grams.tokens[grams.full]
                mean[grams.full] = np.add.reduceat(loss, np.cumsum(n) - n) / n
            means.append(mean)
        columns = [pa.array(np.round(x, 6)) for x in (*means, means[0] - means[1])]
        ids = slice_rows.column("doc_id").combine_chunks().flatten()
        return pa.table([ids, pa.array(grams.tokens, pa.int64()), *columns], names=[c.split()[0] for c in SCORES.split(", ")])

    return settled(marked, answers.drop("size", "words", "near_words"), finish, SCORES, ("kind", "bucket"))
