"""Phrase collocations from suffix subtrees, built independently by vertical partitioning.

A suffix is a word position with up to two more words of its piece; all suffixes of a language that start with
the same words lie in one subtree. Prefixes are cut out of the corpus so that each subtree fits a memory
budget of suffixes: words that occur at most ``budget`` times are prefixes by themselves, and as many of them as
the budget allows share a group; a more frequent word is extended to prefixes of two words, which are counted and
grouped in the same way, and two words that are still too frequent are extended to the whole three. Words that
occur less than ``least`` times end a suffix, as no phrase with one can reach it.

A group sorts its suffixes, which makes them the leaves of its subtrees in order; a leaf's total is the
count of its three words, and the sum over the leaves below a node that of its two.

Counting of prefixes runs between slices of documents and buckets of keys (see ``slices.tallied``), each
slice of one language; a slice sends each different suffix to its group once, with its count. A word or pair is
known by 64 bits of hash with its language, from the buckets on by a number.

Odd rows: null and empty texts have no words; a null language is ``und``; bytes that are not valid UTF-8 are
parts of words; repeated rows count each time; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ByteWords, chunks, materialize, mix, raw
from .slices import flat, lists, sent, settled, tallied

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PARTING = np.zeros(256, bool)
_PARTING[[*b".,;:!?", *range(10, 14)]] = True
SLICES = "slice bigint, lang string, n_words bigint, keys array<bigint>, words array<binary>, n array<bigint>, codes array<int>"


class PieceWords(ByteWords):
    """Words and pieces of texts: words end at blanks and at what parts pieces."""

    def __init__(self):
        super().__init__()
        self.space[:] = _PARTING
        self.space[[9, 32]] = True

    def located(self, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, hash, piece number) of each word."""
        found, at, piece = [], 0, 0
        while at < len(blob):
            to = min(len(blob), at + self.segment)
            while to < len(blob) and not self.space[blob[to]]:
                to += 1
            x = np.frombuffer(blob, np.uint8, to - at, at)
            start, h = self._segment(x)
            parts = np.cumsum(_PARTING[x])
            found.append((start + at, h, piece + parts[start]))
            piece += int(parts[-1])
            at = to
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*found))


def word_slices(docs: DataFrame, limit: int) -> DataFrame:
    """SLICES of docs(lang, text binary): different words with counts, and the words in order as places among
    them, -1 where a piece ends."""

    def run(batches):
        split, name, held, size = PieceWords(), TaskContext.get().partitionId() << 32, {}, {}

        def made(lang: str):
            nonlocal name
            blob = b"\n".join(held.pop(lang)).translate(_LOWER)
            size.pop(lang)
            start, h, piece = split.located(blob)
            keys, first, place = np.unique(mix(h ^ np.uint64(xxhash.xxh3_64_intdigest(lang))), return_index=True, return_inverse=True)
            n = np.bincount(place, minlength=len(keys))
            words = [_word(blob, int(at)) for at in start[first]]
            codes = np.insert(place.astype(np.int32), np.flatnonzero(np.diff(piece)) + 1, -1)
            name += 1
            one = lambda values: lists(values, np.array([0, len(values)]))
            label = lang.encode()
            words = pa.array([w + b" " + label for w in words], pa.binary())
            columns = {"slice": pa.array([name]), "lang": [lang], "n_words": [len(h)], "keys": one(keys.view(np.int64)), "words": one(words), "n": one(n), "codes": one(pa.array(codes, pa.int32()))}
            return pa.RecordBatch.from_pydict(columns)

        for part in chunks(batches):
            for lang, text in zip(part.column("lang").to_pylist(), raw(part.column("text"))):
                if text:
                    held.setdefault(lang, []).append(text)
                    size[lang] = size.get(lang, 0) + len(text)
                    if size[lang] >= limit:
                        yield made(lang)
            while sum(size.values()) > 2 * limit:
                yield made(max(size, key=size.get))
        for lang in list(held):
            yield made(lang)

    return docs.mapInArrow(run, SLICES)


def _word(blob: bytes, at: int) -> bytes:
    found = _END.search(blob, at)
    return blob[at : found.start()] if found else blob[at:]


_END = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")


def _trees(n: np.ndarray, bucket: np.ndarray, budget: int, kind: int) -> np.ndarray:
    """The group of each prefix of a bucket, -1 where it is above the budget."""
    light = np.where(n <= budget, n, 0)
    return np.where(n <= budget, ((bucket << 24) + (np.cumsum(light) - light) // budget) * 4 + kind, -1)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


CODED = "slice bigint, bucket bigint, keys array<bigint>, words array<binary>, n array<bigint>, ids array<bigint>, trees array<bigint>, codes array<int>"


def _pairs(codes: np.ndarray, size: int, chosen: np.ndarray):
    """(first words, second words, number of each chosen position's pair) of positions followed by a word."""
    pair, place = np.unique(codes[chosen].astype(np.int64) * size + codes[chosen + 1], return_inverse=True)
    return pair // max(1, size), pair % max(1, size), place


def _followed(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + second.view(np.uint64))


def coded(slices: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """CODED: each slice's frequent words by number and tree, and the words in order as places among those (-1
    for a break or another word), in a row without bucket; and the pairs whose first word has no tree."""

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        row = rows.combine_chunks()
        name, codes = row.column("slice")[0].as_py(), np.asarray(row.column("codes")[0].values)
        ids, trees = flat(found.column("ids")), flat(found.column("trees"))
        kept = np.flatnonzero(ids >= 0)
        number = np.full(len(ids) + 1, -1, np.int32)  # the last one for breaks
        number[kept] = np.arange(len(kept))
        codes, ids, trees = number[codes], ids[kept], trees[kept]
        at = _followed(codes)
        first, second, place = _pairs(codes, len(ids), at[trees[codes[at]] < 0] if len(at) else at)
        keys = _pair_keys(ids[first], ids[second])
        order = np.argsort(keys)
        words = np.column_stack([ids[first], ids[second]])[order].astype(">i8")
        out = sent(name, keys[order], buckets, words=pa.array([w.tobytes() for w in words], pa.binary()), n=np.bincount(place, minlength=len(keys))[order])
        own = {"slice": [name], **{c: lists(v, np.array([0, len(v)])) for c, v in (("ids", ids), ("trees", trees), ("codes", pa.array(codes, pa.int32())))}}
        types = {"slice": pa.int64(), "bucket": pa.int64(), "words": pa.list_(pa.binary()), "codes": pa.list_(pa.int32())}
        schema = pa.schema([(c, types.get(c, pa.list_(pa.int64()))) for c in (x.split()[0] for x in CODED.split(", "))])
        sides = [({c: out.column(c) for c in out.schema.names}, out.num_rows), (own, 1)]
        return pa.concat_tables([pa.table([have.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema) for have, n in sides])

    return settled(slices, answers, finish, CODED)


SUFFIXES = "tree bigint, w1 array<bigint>, w2 array<bigint>, w3 array<bigint>, n array<bigint>"


def suffixes(own: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """SUFFIXES of each slice: the different ones of two words and more by tree, -1 for no third word."""

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        row = rows.combine_chunks()
        ids, trees, codes = (np.asarray(row.column(c)[0].values) for c in ("ids", "trees", "codes"))
        at = _followed(codes)
        first, second, place = _pairs(codes, len(ids), at)
        third = np.append(codes, -1)[at + 2].astype(np.int64)
        both, n = np.unique(place * (len(ids) + 1) + third + 1, return_counts=True)
        pair, third = both // (len(ids) + 1), both % (len(ids) + 1) - 1
        tree = trees[first] if len(first) else first
        heavy = np.flatnonzero(tree < 0)
        if len(heavy):  # answers come in the order of the keys
            order = np.argsort(_pair_keys(ids[first[heavy]], ids[second[heavy]]))
            tree[heavy[order]] = flat(found.column("trees"))
        w1, w2, w3 = ids[first[pair]], ids[second[pair]], np.where(third >= 0, np.append(ids, -1)[third], -1)
        tree = tree[pair]
        hot = tree < 0
        tree[hot] = (mix(_pair_keys(w1[hot], w2[hot]) + w3[hot].view(np.uint64)) % np.uint64(parts)).astype(np.int64) * 4 + 2
        order = np.argsort(tree, kind="stable")
        begin = np.flatnonzero(np.append(True, np.diff(tree[order]) != 0)) if len(order) else np.empty(0, np.int64)
        limits = np.append(begin, len(order)) if len(order) else np.zeros(1, np.int64)
        return pa.table({"tree": tree[order][begin], **{c: lists(v[order], limits) for c, v in (("w1", w1), ("w2", w2), ("w3", w3), ("n", n))}})

    return settled(own, answers, finish, SUFFIXES)


def subtrees(rows: DataFrame, least: int) -> DataFrame:
    """(w1, w2, w3 or -1, f): phrases of two and three words with f >= least. Pairs above the budget, whose
    suffixes lie in several trees, are left out."""

    def build(table: pa.Table) -> pa.Table:
        w1, w2, w3, n = (flat(table.column(c)) for c in ("w1", "w2", "w3", "n"))
        order = np.lexsort((w3, w2, w1))
        w1, w2, w3, n = w1[order], w2[order], w3[order], n[order]
        node = np.flatnonzero(np.append(True, (np.diff(w1) != 0) | (np.diff(w2) != 0)))
        leaf = np.flatnonzero(np.append(True, (np.diff(w1) != 0) | (np.diff(w2) != 0) | (np.diff(w3) != 0)))
        total = np.add.reduceat(n, leaf)
        above = np.add.reduceat(n, node)
        leaf_ok = (total >= least) & (w3[leaf] >= 0)
        node_ok = (above >= least) & (table.column("tree")[0].as_py() % 4 != 2)
        leaf, node = leaf[leaf_ok], node[node_ok]
        at = np.append(leaf, node)
        third = np.append(w3[leaf], np.full(len(node), -1))
        return pa.table({"w1": w1[at], "w2": w2[at], "w3": third, "f": np.append(total[leaf_ok], above[node_ok])})

    return rows.groupBy("tree").applyInArrow(build, "w1 bigint, w2 bigint, w3 bigint, f bigint")


def counted(docs: DataFrame, least: int, budget: int, slice_bytes: int, bucket_words: int):
    """(words (id, lang, word, f), phrases (w1, w2, w3, f), occurrences of all words (lang, n))."""
    slices = materialize(word_slices(docs, slice_bytes))
    count, words = slices.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    buckets = words // bucket_words + 1

    def number(keys: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        keep, bucket = n >= least, _bucket(keys, buckets)
        return {"keep": keep, "ids": np.where(keep, (bucket << 24) + np.cumsum(keep) - 1, -1), "trees": _trees(np.where(keep, n, 0), bucket, budget, 0)}

    def split(keys: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        return {"keep": n > budget, "trees": _trees(n, _bucket(keys, buckets), budget, 1)}

    def send(batches):
        for batch in batches:
            for i, name in enumerate(batch.column("slice").to_pylist()):
                keys, words, n = (batch.column(c)[i].values for c in ("keys", "words", "n"))
                yield sent(name, np.asarray(keys).view(np.uint64), buckets, words=words, n=np.asarray(n))

    rows = slices.select("slice", "keys", "words", "n").mapInArrow(send, "slice bigint, bucket bigint, keys array<bigint>, words array<binary>, n array<bigint>")
    known, answers = tallied(rows, count, number, "ids array<bigint>, trees array<bigint>", True)
    codes = materialize(coded(slices.select("slice", "codes"), answers, buckets))
    heavy, answers = tallied(codes.where("bucket is not null").select("slice", "bucket", "keys", "words", "n"), count, split, "trees array<bigint>", True)
    own = codes.where("bucket is null").select("slice", "ids", "trees", "codes")
    phrases = subtrees(suffixes(own, answers, words // budget + 1), least)
    pair = heavy.select(F.explode(F.arrays_zip("words", "n")).alias("x")).select("x.*")
    first, second = (F.conv(F.hex(F.substring("words", at, 8)), 16, 10).cast("bigint") for at in (1, 9))
    pair = pair.select(first.alias("w1"), second.alias("w2"), F.lit(-1).cast("bigint").alias("w3"), F.col("n").alias("f"))
    word = known.select(F.explode(F.arrays_zip("ids", "words", "n")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.words").cast("string").alias("x"), F.col("x.n").alias("f"))
    word = word.select("id", F.expr("substr(x, instr(x, ' ') + 1)").alias("lang"), F.expr("substr(x, 1, instr(x, ' ') - 1)").alias("word"), "f")
    return materialize(word), materialize(phrases.unionByName(pair)), slices.groupBy("lang").agg(F.sum("n_words").alias("n"))


def mine_phrases(docs: DataFrame, *, least: int = 10, top: int = 2000, cover: int = 50, budget: int = 1 << 20, slice_bytes: int = 8 << 20, bucket_words: int = 1 << 18) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): per language of docs(lang, text) the top phrases of two and three
    words with at least least occurrences, by their weakest cut; those within a phrase of three words that
    has cover percent of their occurrences are left out."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    words, phrases, totals = counted(docs, least, budget, slice_bytes, bucket_words)
    two, three = phrases.where("w3 < 0").drop("w3"), phrases.where("w3 >= 0")
    word = lambda k: words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"s{k}"), F.col("f").alias(f"f{k}"), *([F.col("lang")] if k == 1 else []))
    sides = [three.select(F.col(f"w{k}").alias("w1"), F.col(f"w{k + 1}").alias("w2"), "f") for k in (1, 2)]
    above = sides[0].unionByName(sides[1]).groupBy("w1", "w2").agg(F.max("f").alias("above"))
    pairs = two.join(above, ["w1", "w2"], "left").where(f"above is null or 100 * above < {cover} * f").join(word(1), "w1").join(word(2), "w2")
    pairs = pairs.select("lang", F.concat_ws(" ", "s1", "s2").alias("phrase"), F.col("f").alias("a"), F.array(_cut("f1", "f2")).alias("cuts"))
    triples = three.join(two.select("w1", "w2", F.col("f").alias("f12")), ["w1", "w2"]).join(two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23")), ["w2", "w3"])
    triples = triples.join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    triples = triples.select("lang", F.concat_ws(" ", "s1", "s2", "s3").alias("phrase"), F.col("f").alias("a"), F.array(_cut("f1", "f23"), _cut("f12", "f3")).alias("cuts"))
    every = pairs.unionByName(triples)
    scored = F.transform("cuts", lambda c, k: F.struct(_score(c).alias("score"), k.alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    best = every.withColumn("best", F.array_min(scored)).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first ones of parts of a language, then of the language: no task reads all candidates of one
    part = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    first = best.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    out = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _cut(left: str, right: str):
    return F.struct(F.col(left).alias("l"), F.col(right).alias("r"))


def _score(cut):
    """floor(1000000 a^2 / (l r)) in decimals of 38 digits: exact for counts below 10^15."""
    a, number = F.col("a").cast("decimal(15,0)"), "decimal(15,0)"
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (a * a), cut["l"].cast(number) * cut["r"].cast(number))


#: The query as plain SQL.
SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
many AS (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE f >= 10),
cuts AS (SELECT c.lang, c.phrase, c.k, c.f AS a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
         FROM (SELECT *, unnest(range(1, k)) AS j FROM many WHERE k > 1) c
         JOIN many x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[:j], ' ') AND x.k = j
         JOIN many y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:], ' ') AND y.k = c.k - j),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
above AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(f) AS above FROM many, (SELECT unnest([1, 2]) AS i) WHERE k = 3 GROUP BY 1, 2),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best LEFT JOIN above USING (lang, phrase) JOIN n USING (lang)
WHERE above IS NULL OR k = 3 OR 100 * above < 50 * a
QUALIFY rank <= 2000"""
