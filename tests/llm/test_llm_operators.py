"""Each operator against brute force on a small table, and on odd rows."""

from __future__ import annotations

import math
import random

import brute
import pytest
from pyspark.sql import functions as F

from spanforge.llm.decontam import decontaminate
from spanforge.llm.html import extract_text, main_text
from spanforge.llm.lines import line_dedup
from spanforge.llm.minhash import near_duplicates
from spanforge.llm.mixing import marginals, mix_sources
from spanforge.llm.quality import quality_rules
from spanforge.llm.sharding import shard
from spanforge.llm.substring import substring_dedup
from spanforge.llm.urls import filter_urls

SF = "/root/testdata/sf0.001"
CLASH = ["id", "key", "at", "n", "kept", "component_id", "row", "level", "path", "score", "topic", "p", "w", "line", "rule", "sig"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing column names."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(900)]
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    prose = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(9)) for _ in range(6))
    rows = [
        (1, prose, "en", "a"), (1, prose, "en", "a"), (2, prose, None, "a"), (3, None, "en", None), (4, "", "fr", "b"),
        (5, long, "en", "b"), (6, long + " tail", "en", "b"), (7, " \t\n\x0b\x0c\r ", "en", "a"), (8, "one two", "en", "a"),
        (9, "ONE two", "en", "a"), (None, prose, "en", "a"), (None, None, None, None), (10, "no break\u00a0space É\nx\nx", "es", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH))


def unique(rows):
    return {r[0]: r[1] for r in rows if r[0] is not None}.items()


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def empty(df):
    return df.where("false")


def test_near_duplicates(docs, odd):
    for df in (docs, odd):
        out = near_duplicates(df).collect()
        want = brute.near_duplicates(unique(pairs(df)))
        assert len(out) == df.count()
        for r in out:
            if r.doc_id is not None:
                assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
            else:
                assert r.component_id is None and r.kept
    assert near_duplicates(empty(docs)).count() == 0


def test_near_duplicates_of_ids_with_two_texts(spark):
    """One id with two texts gives two rows of one component, decided by one of them."""
    words = [f"w{k}" for k in range(60)]
    one, two = " ".join(words[:30]), " ".join(words[30:])
    df = spark.createDataFrame([(5, one), (5, two), (1, one), (2, two), (9, one)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect())
    mine = {c for i, _, c in got if i == 5}
    assert len(got) == 5 and len(mine) == 1 and mine <= {1, 2}
    assert [x for x in got if x[0] != 5] == [(1, 26, 1), (2, 26, 2), (9, 26, 1)]


def test_near_duplicate_chains_and_hot_groups(spark):
    """Links that only later rounds can find: a chain in which neighbours are linked and ends
    are not, and a large group of near copies of near copies."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(80)]
    rows, words = [], list(base)
    for i in range(40):
        rows.append((i, " ".join(words)))
        words[(7 * i) % 80] = f"c{i}"
    for i in range(40, 160):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(80)] = f"d{rng.randrange(50)}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute.near_duplicates(rows)


def test_substring_dedup(docs, odd):
    for df in (docs, odd):
        out = substring_dedup(df).collect()
        want = brute.substring_dedup(unique(pairs(df)))
        assert len(out) == df.count()
        for r in out:
            if r.doc_id is not None:
                assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id]
            else:
                assert r.n_removed == 0
    assert substring_dedup(empty(docs)).count() == 0
    small = substring_dedup(docs.repartition(3), slice_bytes=20_000, bucket_bytes=3_000).collect()
    assert sorted(small) == sorted(substring_dedup(docs).collect())


def test_substring_dedup_of_odd_texts(spark):
    """Ids beyond 53 bits, one id with two texts, and text that is not valid UTF-8."""
    run = " ".join(f"v{k}" for k in range(20))
    big = 2**53
    rows = [(big, f"{run} a"), (big + 1, f"b {run}"), (big + 1, f"{run} c"), (big + 2, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("text", F.when(F.col("doc_id") == big + 1, F.concat(F.expr("cast(x'ff20' as string)"), "text")).otherwise(F.col("text")))
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(df).select("doc_id", "n_words", "n_removed").collect())
    assert got == [(big, 21, 0), (big + 1, 22, 20), (big + 1, 22, 20), (big + 2, 0, 0)]


def test_url_rules(spark):
    rules = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
    urls = {
        "http://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://a.example.net/fr/1": ("a.example.net", "/fr/1", "net/", "block"),
        "http://net": ("net", "", None, "allow"),
        "http://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"),
        "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "x://y.org/fr/a#http://z": ("y.org", "/fr/a", "org/fr/", "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://h?q=/en/": ("h", "", None, "allow"),
    }
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(None, "http://q/", "clash"), (0, list(urls)[0], "clash")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, template string")
    labels = spark.createDataFrame([(2, None), (None, True)], "page_id bigint, bad boolean")
    got = filter_urls(pages, labels, rules).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == list(urls.values())[r.page_id]
    assert filter_urls(empty(pages), labels, rules).count() == 0


def test_url_templates(spark):
    """A bad section of a host is split off and blocked, the rest stays."""
    rows = [(i, f"http://h.example/{'spam' if i % 4 == 0 else 'news'}/{i}.html") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(0, 400, 3)], "page_id bigint, bad boolean")
    got = filter_urls(pages, labels).collect()
    assert all((r.verdict == "block") == (r.page_id % 4 == 0) for r in got)
    assert {r.template for r in got} == {"/spam/**", "/news/**"}


def test_url_tree(spark):
    """Templates and purities of a plain tree; below seven common segments bad branches still
    split off, alike siblings merge and unlike ones differ in verdict."""
    rng = random.Random(3)
    deep = "/a/b/c/d/e/f/g"
    rows = []
    for i in range(2000):
        host = rng.choice(["x.org", "x.org", "y.net", f"small{rng.randrange(40)}.com"])
        area, lang = rng.choice(["buy", "blog", "wiki"]), rng.choice(["de", "en", "fr", "es"])
        path = rng.choice([f"{deep}/{area}/{i}", f"/{lang}/{area}/{i}.html", f"/{lang}/{i}", f"/{i}/{rng.randrange(10**6)}", "", "/", f"//{lang}//"])
        bad = rng.random() < (0.95 if area == "buy" and area in path else 0.7 if "/fr/" in path else 0.1)
        rows.append((i, f"http://{host}{path}?q", bad if i % 2 else None))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "page_id bigint, bad boolean")
    got = {r.page_id: r for r in filter_urls(pages, labels).collect()}
    want = brute.url_templates(rows)
    for i, (template, purity) in want.items():
        assert got[i].template == template, (got[i], template)
        assert got[i].purity == pytest.approx(purity, abs=2e-6) and got[i].verdict == ("block" if purity >= 0.5 else "allow")
    found = {t for t, _ in want.values()}
    assert any(t.endswith("/f/g/buy/**") for t in found) and any("{" in t for t in found) and {r.verdict for r in got.values()} == {"block", "allow"}


def test_long_urls(spark):
    pages = spark.createDataFrame([(0, "http://h/" + "s/" * 50_000), (1, "http://h/" + "x" * 1_000_000), (2, "http://h/s")], "page_id bigint, url string")
    labels = spark.createDataFrame([(0, True), (2, False)], "page_id bigint, bad boolean")
    got = {r.page_id: (len(r.path), r.template) for r in filter_urls(pages, labels).collect()}
    assert got == {0: (100_001, "/**"), 1: (1_000_001, "/**"), 2: (2, "/**")}


def test_html(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body class='no-sidebar'><header>top</header><nav><ul><li><a href=x>a</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies on this long long site of ours, accept them all.</div><main><article><h1>Head &amp; more</h1>"
        "<p>First <b>bold</b>\n text&nbsp;here.<p>x<br>y<div class=ad>Buy</div><form>name <input></form><script>var t='</p>';</script>"
        "<ul><li>one<li>two</ul></article><aside>side</aside><section id='comments'><p>A reader writes something quite long here.</p></section></main>"
        "<footer>&copy; end</footer>"
    )
    assert main_text(page) == "Head & more\n\nFirst bold text here.\n\nx y\n\none\n\ntwo"
    plain = "<body><div id=menu>m</div><div class=content><p>" + "Long text of the page. " * 9 + "</p><p>short</p></div><div>c</div></body>"
    assert main_text(plain).endswith("short") and "m" not in main_text(plain).split()
    odd = [None, "", "   ", "<p>", "a < b & c", "<![weird]><p>ok</p>", "<nav>only menu</nav>", "<p>" + "x" * 3_000_000, "&#0;&bogus;"]
    df = spark.createDataFrame([(i, None, h, "clash") for i, h in enumerate(odd)] + [(None, "u", "<p>t", "clash")] * 2, "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in extract_text(df).collect()}
    assert [got[i].text for i in range(7)] == ["", "", "", "", "a < b & c", "ok", ""]
    assert got[7].n_chars == 3_000_000 and got[None].text == "t"
    assert extract_text(empty(df)).count() == 0


def test_quality(docs, odd):
    for df in (docs, odd):
        out = quality_rules(df).collect()
        want = {i: brute.quality_base(t) for i, t in unique(pairs(df))}
        assert len(out) == df.count()
        for r in out:
            if r.doc_id is not None:
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert quality_rules(empty(docs)).count() == 0


def test_quality_verdicts(spark):
    """Verdicts of a plain version on a whole table; no constant decides by itself."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in table.select("doc_id", "text", "lang", "source").collect()]
    got = {r.doc_id for r in quality_rules(table).where("kept").collect()}
    assert got == brute.quality_kept(rows) and 0.6 < len(got) / len(rows) < 0.95
    for other in ({"fence": 3}, {"z": 1.5}):
        changed = got ^ {r.doc_id for r in quality_rules(table, **other).where("kept").collect()}
        assert len(changed) < 0.05 * len(rows)


def test_quality_thresholds_adapt(spark):
    """The same ratio passes in a source where it is usual and fails where it is not."""
    rng = random.Random(3)

    def text(symbols):
        w = [f"word{rng.randrange(10**6)}" for _ in range(200)]
        return " ".join(x + "#" * (k < symbols) for k, x in enumerate(w))

    rows = [(i, text(100 + i % 9), "en", "code") for i in range(150)] + [(i, text(i % 2), "en", "news") for i in range(150, 300)]
    rows += [(300, text(104), "en", "code"), (301, text(104), "en", "news")]
    kept = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert kept.pop(301) is False and all(kept.values())


def test_mixing(spark, docs, odd):
    for df in (docs, odd):
        out = mix_sources(df).collect()
        assert len(out) == df.count() and all(0 <= r.probability <= 1 for r in out)
    assert mix_sources(empty(docs)).count() == 0
    assert {r.doc_id for r in mix_sources(docs).where("sampled").collect()} == brute.mixed([tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()])


def test_mixing_meets_its_marginals(spark):
    """Expected shares of the sample are the targets within 1 %, also where cells are taken whole."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert max(abs(r.residual) for r in marginals(mix_sources(table)).collect()) < 0.01
    for budget in (0.05, 0.8):
        given = [("lang", "en", 0.4), ("lang", "fr", 0.3), ("lang", "xx", 0.2)] + [("source", f"src{k}", 1.0) for k in range(20)] + [("topic", "x", 1.0), ("topic", "y", 1.0)]
        targets = spark.createDataFrame(given, "dimension string, value string, share double")
        topics = table.withColumn("topic", F.when(F.col("doc_id") % 3 == 0, "x").otherwise("y"))
        out = mix_sources(topics, targets, topic="topic", budget=budget, rounds=20)
        assert out.where("lang in ('de', 'es') and n_words > 0 and sampled").count() == 0
        report = {(r.dimension, r.value): r for r in marginals(out, targets).collect()}
        assert report["lang", "fr"].target == pytest.approx(3 / 7) and report["lang", "de"].expected == 0
        assert max(abs(r.residual) for r in report.values() if r.target) < 0.01
        assert any(r.probability > 0.9 for r in out.collect()) == (budget > 0.1)


def test_decontamination(spark, docs, odd):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    out = {r.doc_id: r for r in decontaminate(docs, items).collect()}

    def normal(text):
        return "".join(" " if c in "\n\t" else c for c in text.lower() if c not in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").split()

    known = {r.item_id: " ".join(normal(r.text)) for r in items.collect()}
    leaks = {i for i, t in pairs(docs) if any(f" {x} " in f" {' '.join(normal(t))} " for x in known.values())}
    assert leaks and {i for i, r in out.items() if r.contaminated} == leaks
    rng = random.Random(2)
    filler = [f"f{k}" for k in range(400)]
    edited = []
    for k, text in list(known.items())[:12]:
        w = [x if rng.random() > 0.15 else f"edit{k}" for x in text.split()]
        edited.append((1000 + k, " ".join([*rng.choices(filler, k=60), *w, *rng.choices(filler, k=60)])))
    edited += [(i, " ".join(rng.choices(filler, k=200))) for i in range(5)]
    got = {r.doc_id: r for r in decontaminate(spark.createDataFrame(edited, "doc_id bigint, text string"), items).collect()}
    assert all(r.contaminated == (i >= 1000) for i, r in got.items())
    odd_items = spark.createDataFrame([(1, None), (2, ""), (None, "one two"), (3, "one two"), (3, "one two")], "item_id bigint, text string")
    out = decontaminate(odd, odd_items).collect()
    assert len(out) == odd.count()
    assert {r.doc_id for r in out if r.contaminated} == {8, 9}
    assert decontaminate(docs, empty(items)).where("contaminated").count() == 0
    assert decontaminate(empty(docs), items).count() == 0


def test_decontamination_with_a_full_map(spark, docs):
    """A bit map that lets everything through changes nothing."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    small = docs.where("doc_id < 40")
    a, b = (sorted(map(tuple, decontaminate(small, items, map_bits=n).collect())) for n in (26, 4))
    assert a == b


def test_line_dedup(docs, odd):
    for df, m in ((docs, 2), (odd, 3)):
        out = line_dedup(df, min_lines=m).collect()
        want = brute.line_dedup(unique(pairs(df)), m)
        assert len(out) == df.count()
        for r in out:
            if r.doc_id is not None:
                assert tuple(r[1:]) == want[r.doc_id]
            else:
                assert r.n_removed == 0
    assert line_dedup(empty(docs)).count() == 0


def test_line_dedup_of_odd_texts(spark):
    """One id with two texts, and text that is not valid UTF-8."""
    df = spark.createDataFrame([(1, "a b\nc d"), (2, "c d\ne f"), (2, "g h\na b"), (2, "c d\ne f")], "doc_id bigint, text string")
    df = df.withColumn("text", F.concat(F.expr("cast(x'ff0a' as string)"), "text"))
    got = sorted((r.doc_id, r.n_lines, r.n_removed) for r in line_dedup(df, min_lines=1).drop("kept_text").collect())
    assert got == [(1, 3, 0), (2, 3, 2), (2, 3, 2), (2, 3, 2)]
    big = spark.createDataFrame([(k, "same\nline") for k in range(300)], "doc_id bigint, text string")
    shards = [r.n_bytes for r in shard(big.withColumn("doc_id", F.lit(7).cast("bigint")), limit=100).groupBy("shard").agg(F.sum("n_bytes").alias("n_bytes")).collect()]
    assert max(shards) <= 100 and sum(shards) == 2700


def test_sharding(docs, odd):
    for df, limit in ((docs, 20_000), (odd, 1_000)):
        out = [tuple(r) for r in shard(df, limit=limit).collect()]
        assert len(out) == df.count()
        size, count = {}, {}
        for _, n, s, depth in out:
            assert len(s) == depth
            size[s], count[s] = size.get(s, 0) + n, count.get(s, 0) + 1
        assert all(size[s] <= limit or count[s] == 1 for s in size)
        names = sorted(size)
        assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # prefix-free
        for s in names:  # a bucket was split only if it had to
            if s:
                both = [x for x in names if x.startswith(s[:-1])]
                assert sum(size[x] for x in both) > limit
    assert shard(empty(docs)).count() == 0
    assert {r.shard for r in shard(docs).collect()} == {""}


def test_sharding_of_a_repeated_id(spark):
    rows = spark.range(300).select((F.col("id") * 0).alias("doc_id"), F.lit("x" * 100).alias("text"))
    out = shard(rows, limit=1_000).groupBy("shard").agg(F.sum("n_bytes").alias("b"))
    assert out.where("b > 1000").count() == 0 and out.agg(F.sum("b")).first()[0] == 30_000


def test_byte_words():
    """Word hashes do not depend on the place, the segment or the batch, and tell words apart."""
    from spanforge.llm.common import ByteWords

    rng = random.Random(9)
    texts = ["", "  ", "a", *(" ".join(rng.choice("abé xyz") * rng.randrange(1, 9) + str(rng.randrange(500)) for _ in range(300)) for _ in range(20)), "x" * 5000]
    blobs = [t.encode() for t in texts]
    small, large = ByteWords(segment=64), ByteWords()
    h, sizes = small(blobs)
    assert sizes.tolist() == [len(b.split()) for b in blobs]
    assert (h == large(blobs)[0]).all()
    flat = [w for b in blobs for w in b.split()]
    seen = {}
    for word, value in zip(flat, h.tolist()):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    assert small([])[0].size == 0
