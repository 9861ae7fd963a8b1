"""Phrases, token alignment and packing against plain versions, on given tables and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import alignment, packing, phrases, queries

SF = "/root/testdata/sf0.001"
CLASH = ["tree", "keys", "n", "codes", "piece", "slot", "dealt", "slice", "count", "words", "offset", "f"]
ODD = [
    "a  b", " a", "<s>x <|endoftext|>", "\nThen\n\n x", "a\n", "a\x00b", "é́ﬁ \r\n x;\r y", "😀▁x", "", "a\tb", "x\r\ny", "a\xa0b  \n \n c",
    "﻿a", None, " ", "\n", "  \n", "　a b\x1c c", "x" * 5000 + " " + "é" * 3000, "it's don't  we'll\n'd. DON'T, «x». a1! İ <|startoftext|>.",
]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    shared = "the same words again, and the same words again; "
    rows = [(1000 + i, t, "en") for i, t in enumerate(ODD)] + [(5, shared * 4, None), (5, shared * 4, None), (None, shared * 7, "und"), (6, (shared * 9).upper(), "de")]
    rows += [(7, " ".join(rng.choice("abcdefgh") for _ in range(20_000)), "de"), (8, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    raw = df.limit(1).select(F.lit(9).cast("bigint").alias("doc_id"), F.expr("cast(unhex('61FF6220C3') as string)").alias("text"), F.lit("en").alias("lang"))
    return df.unionByName(raw).select("*", *(F.lit("clash").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return [(r.doc_id, bytes(r.t) if r.t is not None else None) for r in df.select("doc_id", F.col("text").cast("binary").alias("t")).collect()]


# --- phrases ---------------------------------------------------------------------------------


def plain_phrases(rows, least=10, top=2000):
    """rows: (lang, text bytes)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text or b"")
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, g in f.items():
        found = []
        for p, a in g.items():
            if len(p) > 1 and a >= least:
                cuts = [(10**6 * a * a // (g[p[:k]] * g[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                inside = len(p) == 2 and any(100 * b >= 50 * a for q, b in g.items() if len(q) == 3 and b >= least and p in (q[:2], q[1:]))
                if not inside:
                    found.append((-score, -a, b" ".join(p), g[p[:k]], g[p[k:]]))
        out += [(lang, i + 1, p.decode(errors="replace"), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"budget": 40, "slice_bytes": 3000, "bucket_words": 500}, {"top": 3, "budget": 10**9}])
def test_phrases(odd, limits):
    """Also with budgets so small that words, and pairs of words, are above them."""
    got = sorted(map(tuple, phrases.mine_phrases(odd, **limits).collect()))
    rows = [(r.lang, bytes(r.t) if r.t is not None else None) for r in odd.select("lang", F.col("text").cast("binary").alias("t")).collect()]
    assert got == plain_phrases(rows, top=limits.get("top", 2000)) and len(got) > 5


def test_phrases_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, queries.op11_phrases(spark, SF).collect())) == sorted(con.execute(phrases.SQL).fetchall())


def test_scores_beyond_64_bits(spark):
    """10^6 a^2 and l r are far above 64 bits."""
    a, l, r = 9 * 10**11 + 7, 9 * 10**12 + 1, 8 * 10**12 + 3
    df = spark.createDataFrame([(a, l, r)], "a bigint, l bigint, r bigint").withColumn("cut", F.struct("l", "r"))
    assert df.select(phrases._score(F.col("cut"))).first()[0] == 10**6 * a * a // (l * r)


def test_phrases_of_nothing(docs):
    assert phrases.mine_phrases(docs.where("false")).count() == 0
    assert phrases.mine_phrases(docs.limit(3).withColumn("text", F.lit(None).cast("string"))).count() == 0


# --- alignment -------------------------------------------------------------------------------


def test_galloping():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (np.array(sorted({*rng.sample(range(1, 60), rng.randrange(0, 40)), 99})) for _ in range(2))
        assert alignment.gallop(a, b, np.zeros(len(a), int)).tolist() == np.searchsorted(b, a).tolist()
        common, first, last = alignment.align(a, b, np.zeros(len(a), int), np.zeros(len(b), int))
        assert a[common].tolist() == sorted(set(a) & set(b))
        edges = [0, *a.tolist()]
        for k, (i, j) in enumerate(zip(edges, edges[1:])):
            overlap = [m for m, (x, y) in enumerate(zip([0, *b.tolist()], b.tolist())) if x < j and i < y]
            assert overlap == list(range(first[k], last[k] + 1))


def plain_alignment(rows):
    """Tokens of whole texts, byte by byte: what align_tokens returns for (doc_id, text bytes)."""
    first, second = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
    known = alignment.Stretches(first, second)
    docs, count = [], Counter()
    for i, raw in rows:
        try:
            text = (raw or b"").decode()
        except UnicodeDecodeError:
            text = ""
        x = known.a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = known.b.encode(text) if text else []
        px, py = [known.a_bytes[k] for k in x], [known.b_bytes[k] for k in y]
        if not text or not b"".join(px) == (" " + text).encode() == b"".join(py):
            docs.append((i, None))
            continue
        at_x, at_y = ([k for k, p in enumerate(parts) for _ in p] for parts in (px, py))
        links = sorted(set(zip(at_x, at_y)))
        ex, ey = ({int(e): k for k, e in enumerate(np.cumsum([len(x) for x in p]))} for p in (px, py))
        groups, p, q = [], 0, 0
        for e in sorted(ex.keys() & ey.keys()):
            groups.append(",".join(map(str, x[p : ex[e] + 1])) + "|" + ",".join(map(str, y[q : ey[e] + 1])))
            p, q = ex[e] + 1, ey[e] + 1
        ids = [(x[a], y[b]) for a, b in links]
        count.update(set(ids))
        docs.append((i, (len(x), len(y), len(groups), ids, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    none = (0, 0, 0, 0, 0, 0, "")
    return [(i, *(none if d is None else (*d[:3], len(d[3]), sum(count[p] == best[p[0]] for p in d[3]), sum(count[p] for p in d[3]), d[4]))) for i, d in docs]


def test_alignment(spark, docs, odd):
    for df, limits in ((docs, {}), (odd, {"slice_bytes": 500, "bucket_pairs": 50})):
        got = alignment.align_tokens(df, queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model"), **limits).collect()
        assert sorted(map(tuple, got), key=str) == sorted(plain_alignment(rows_of(df)), key=str)
    assert alignment.align_tokens(docs.where("false"), queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")).count() == 0


# --- packing ---------------------------------------------------------------------------------


def plain_pieces(rows, size):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json")), []
    for i, raw in rows:
        ids = tokenizer.encode((raw or b"").decode(errors="replace"), add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), size)):
            cut = ids[at : at + size]
            out.append((i, k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"size": 64, "group": 10}])
def test_packing(docs, odd, limits):
    for df in (docs, odd):
        got = packing.pack_documents(df, queries.tokenizer("word_bpe_49k.json"), **limits).collect()
        size = limits.get("size", 4096)
        assert sorted((tuple(r)[:5] for r in got), key=str) == plain_pieces(rows_of(df), size)
        sequences = defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append((r.offset, r.length))
        for parts in sequences.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= size
        least = -(-sum(r.length for r in got) // size)
        assert len(sequences) <= least + (1 if not limits else 0.02 * least + 2)
    assert packing.pack_documents(docs.where("false"), queries.tokenizer("word_bpe_49k.json")).count() == 0


def test_packing_where_nothing_fits(spark):
    """Documents of more than half a sequence stay alone, and the rounds end."""
    df = spark.createDataFrame([(i, "a " * (39 + i % 7)) for i in range(300)], "doc_id bigint, text string")
    got = packing.pack_documents(df, queries.tokenizer("word_bpe_49k.json"), size=64, group=16).collect()
    assert len({r.sequence_id for r in got}) == 300 == len(got)


def test_sum_of_squares_rule():
    """One piece after the other, by the sums as they are written down."""
    rng = np.random.default_rng(2)
    size, lengths = 50, rng.integers(1, 50, 200)
    sequence, offset, full = packing.sum_of_squares(lengths, size)
    held = {}
    for i in np.argsort(-lengths, kind="stable"):
        def total(level, held=held):
            n = Counter(h for h in [*held.values(), level] if h < size)
            n[level - lengths[i]] -= 1
            return sum(x * x for x in n.values())

        fits = [k for k, h in held.items() if h + lengths[i] <= size]
        if fits:
            least = min(total(held[k] + lengths[i]) for k in fits)
            assert total(held[sequence[i]] + lengths[i]) == least and held[sequence[i]] == max(held[k] for k in fits if total(held[k] + lengths[i]) == least)
        else:
            assert sequence[i] not in held
        assert offset[i] == held.get(sequence[i], 0)
        held[sequence[i]] = held.get(sequence[i], 0) + lengths[i]
    assert all((held[s] == size) == f for s, f in zip(sequence, full))


@pytest.mark.parametrize("seed", range(3))
def test_word_ids_of_any_text(seed):
    """Ids of words one by one are those of the whole text."""
    rng = random.Random(seed)
    known = packing.WordIds(queries.tokenizer("word_bpe_49k.json"))
    ranges = [(32, 127), (160, 0x500), (0x900, 0x1000), (0x300, 0x370), (0x2000, 0x2100)]
    for _ in range(300):
        text = " ".join("".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(1, 6))) for _ in range(30))
        words = text.encode().split()
        known.learn(words)
        got = np.frombuffer(b"".join(known[w] for w in words), "<u4").tolist()
        assert got == known.tokenizer.encode(text, add_special_tokens=False).ids
