"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from html import unescape

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforge.llm import queries
from spanforge.llm.decontam import decontaminate
from spanforge.llm.html import main_text
from spanforge.llm.lines import line_dedup
from spanforge.llm.scoring import score_words
from spanforge.llm.slices import narrow, widened

SF = "/root/testdata/sf0.001"


def word_losses(texts, target, k=5.0):
    """[(tokens, target loss, background loss)] by plain dictionaries."""

    def grams(text):
        w = ["<edge>", *brute.words(text), "<edge>"]
        return list(zip(w, w[1:])) if len(w) > 2 else []

    every = [grams(t) for t in texts]
    size = len({b for g in every for _, b in g})

    def model(chosen):
        pair = Counter(x for g in chosen for x in g)
        before, after = Counter(), Counter()
        for (a, b), n in pair.items():
            before[a] += n
            after[b] += n
        total = sum(after.values())
        return lambda a, b: -math.log2((pair[a, b] + k * (after[b] + k / size) / (total + k)) / (before[a] + k))

    models = model([g for g, t in zip(every, target) if t]), model(every)
    return [(len(g), *(sum(f(*x) for x in g) / max(1, len(g)) for f in models)) for g in every]


def test_lm_scoring_by_words(spark):
    """The query's model knows words and their order: exact against dictionaries, also for
    repeated rows, null ids and texts without words."""
    rng = random.Random(4)
    words = ["stone", "tones", "notes", "onset", "été", "x"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(60)]
    rows += [(None, "stone tones"), (3, "notes onset notes"), (70, None), (71, " \n\t"), (72, rows[5][1]), (72, rows[5][1])]
    ids = {*range(0, 60, 3), 72}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    target = spark.createDataFrame([(i,) for i in ids] + [(0,), (None,)], "doc_id bigint")
    out = score_words(df, target).collect()
    assert sorted(score_words(df, target, slice_bytes=200, bucket_words=20).collect(), key=str) == sorted(out, key=str)
    want = word_losses([t for _, t in rows], [i in ids for i, _ in rows])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in out), key=key)
    for g, w in zip(got, sorted(((i, *x) for (i, _), x in zip(rows, want)), key=key), strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], abs=1e-5)
    assert all(r.score == pytest.approx(r.target_loss - r.background_loss, abs=2e-6) for r in out)
    assert score_words(df.where("false"), df.select("doc_id")).count() == 0


def test_counts_of_any_size():
    """Counts keep their value on the way to and from a slice, also above 15 bits."""
    limits = np.array([0, 2, 2, 5])
    for values in ([1, 2, 3, 4, 5], [1, 2**40 + 7, 0, 2**31, 2**31 - 1]):
        assert widened(pa.table(narrow("n", np.array(values), limits)), "n").tolist() == values


def test_lm_scoring_query_uses_words(spark):
    """Tokens of the query are words and an end mark, not bytes."""
    docs = {r.doc_id: len(brute.words(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op6_lm_scoring(spark, SF).collect():
        assert r.n_tokens == (docs[r.doc_id] + 1 if docs[r.doc_id] else 0)


def test_line_dedup_of_single_lines(spark):
    """A repeated line between differing neighbours goes, in all but its first place."""
    rows = [(1, "a b\nshared line\nc d"), (2, "e f\nshared line\ng h\n\nshared line"), (3, "shared line"), (4, "i\nc d\nshared line"), (None, "c d")]
    got = line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), min_lines=1).collect()
    want = brute.line_dedup(rows[:-1], 1)
    assert {r.doc_id: tuple(r[1:]) for r in got if r.doc_id is not None} == want
    assert want[2][-1] == "e f\ng h\n" and want[3][-1] == ""


def test_line_dedup_query_leaves_no_later_copy(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute.line_dedup(docs, 1)
    for r in queries.op9_lines(spark, SF).collect():
        assert (r.n_lines, r.n_removed, r.n_runs, r.longest_run, r.kept_sha256) == (*want[r.doc_id][:4], brute.sha(want[r.doc_id][4]))


def test_decontamination_against_full_alignment(spark):
    """Items edited at 5 to 50 %: whatever full alignment over the whole document accepts is
    found, with its item and score; and nothing else is."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(3000)]
    weights = [1 / (k + 3) for k in range(3000)]
    items = {i: rng.choices(words, weights, k=rng.randrange(8, 50)) for i in range(12)}
    docs = {}
    for rate in (0.05, 0.2, 0.3, 0.4, 0.5):
        for i, item in items.items():
            out = []
            for w in item:
                kind = rng.randrange(3) if rng.random() < rate else 3
                out += [[rng.choice(words)], [], [w, rng.choice(words)], [w]][kind]
            docs[len(docs)] = rng.choices(words, weights, k=25) + out + rng.choices(words, weights, k=25)
    for k in range(3):  # every third word replaced, as two words of three in a row still match
        docs[len(docs)] = [w if (j + k) % 3 else f"x{j}" for j, w in enumerate(items[k])]
    docs |= {1000 + k: rng.choices(words, weights, k=90) for k in range(12)}
    as_rows = lambda d: [(i, " ".join(w)) for i, w in d.items()]
    df = spark.createDataFrame(as_rows(docs), "doc_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate(df, spark.createDataFrame(as_rows(items), "item_id bigint, text string")).collect()}
    scores = brute.alignments(docs, items)
    found = 0
    for i in docs:
        score, item = max((round(s / (2 * len(items[k])), 4), -k) for k, s in scores[i].items())
        if score >= 0.5:
            found += 1
            assert got[i].contaminated and (got[i].score, got[i].item_id) == (score, -item), i
        elif i >= 1000:
            assert not got[i].contaminated
    assert found > 40


def test_decontamination_of_repeated_items(spark):
    """Every text under one item_id counts, and so does an item without an id."""
    texts = {k: " ".join(f"{k}{j}" for j in range(20)) for k in "abc"}
    items = spark.createDataFrame([(1, texts["a"]), (1, texts["b"]), (None, texts["c"]), (2, None)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, texts["a"]), (2, f"x {texts['b']} y"), (3, texts["c"]), (4, "none of it"), (4, "nor here")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.contaminated) for r in decontaminate(docs, items).collect())
    assert got == [(1, 1, True), (2, 1, True), (3, None, True), (4, None, False), (4, None, False)]


def test_decontamination_of_partial_quotes(spark):
    """Part of a long item is a leak, verbatim or slightly edited; a dozen words are not."""
    rng = random.Random(8)
    item = [f"q{k}" for k in range(500)]

    def around(part):
        return " ".join([*(f"f{rng.randrange(400)}" for _ in range(80)), *part, *(f"f{rng.randrange(400)}" for _ in range(80))])

    edited = [f"e{k}" if k % 6 == 3 else w for k, w in enumerate(item[300:330])]
    gaps = [w for k, w in enumerate(item[300:340]) if k % 7 != 3]
    poor = [f"e{k}" if k % 3 == 1 else w for k, w in enumerate(item[300:330])]
    parts = {1: item[100:300], 2: item[40:65], 3: item[7:20], 4: edited, 5: gaps, 6: item[7:19], 7: poor, 8: []}
    docs = spark.createDataFrame([(i, around(p)) for i, p in parts.items()], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "some other short item")], "item_id bigint, text string")
    assert {r.doc_id for r in decontaminate(docs, items).collect() if r.contaminated} == {1, 2, 3, 4, 5}


def test_html_without_article():
    """All paragraphs of the main text stay, one in each div or cell, however short."""
    parts = ["Head", "a " * 50, "b " * 60, "c " * 400, "d " * 450, "end"]
    parts = [" ".join(x.split()) for x in parts]
    divs = "".join(f"<div>{x}</div>" for x in parts)
    cells = "<table>" + "".join(f"<tr><td><div>{x}</div></td></tr>" for x in parts) + "</table>"
    deep = f"<div class=content><div><h1>{parts[0]}</h1><p>{parts[1]}</p></div>" + "".join(f"<section><p>{x}</p></section>" for x in parts[2:]) + "</div>"
    for page in (divs, cells, deep):
        assert main_text(f"<body><div id=menu>m</div>{page}<footer>f</footer></body>") == "\n\n".join(parts)
    assert "links" not in main_text(f"<body>{deep}<div><p>links</p><p>more</p></div></body>")


def test_html_names_and_articles():
    """Parts of hyphenated names are no furniture, articles never are, and short ones stay."""
    text = "Long text of the page. " * 20
    assert main_text(f"<div class='post-with-share no-sidebar'><p>{text}</p><p>short</p></div>").endswith("short")
    page = f"<body><article class='comment related'><p>{text}</p></article><article><p>tiny</p></article></body>"
    assert main_text(page) == text.strip() + "\n\ntiny"


LONG = "This is a long sentence of the main text, one of many that follow each other. " * 3


def test_html_furniture_only_weighs():
    """Names of wrappers, parts of names, headers of articles and formulas lose no text."""
    text = LONG.strip()
    for page in (
        f'<div class="layout with-sidebar"><article><p>{text}</p></article></div>',
        f'<div class="sidebar nav"><article><p>{text}</p></article></div><div><p>x</p></div>',
        f'<div id="page" class="nav-open"><div><p>{text}</p></div></div>',
    ):
        assert text in main_text(f"<body><nav><a>a</a><a>b</a></nav>{page}<footer>foot</footer></body>"), page
    price = f'<article><p>{text}</p><p class="share-price">12 EUR</p></article>'
    assert main_text(price) == f"{text}\n\n12 EUR"
    assert main_text(f"<article><header><h1>Head</h1></header><p>{text}</p></article>") == f"Head\n\n{text}"
    assert main_text(f"<article><p>{text} so <math><mi>x</mi></math> holds</p></article>") == f"{text} so x holds"
    talk = f'<section class="comments"><article class="comment"><p>{LONG}{LONG}</p></article></section>'
    assert main_text(f"<article><p>{text}</p><p>end</p>{talk}</article>") == f"{text}\n\nend"
    assert main_text(f"<article><p>{text}</p></article>{talk}") == text
    assert main_text("<nav><a>one</a></nav><footer>two</footer>") == ""


def test_html_regions_come_from_smoothed_ratios(monkeypatch):
    """Without any mark or article, ratios alone tell lists of links and teasers from the text,
    and a short line among long ones is content by its neighbours only."""
    links = "".join(f"<li><a href='/{k}'>link {k}</a></li>" for k in range(12))
    teasers = "".join(f"<div><a href=x><img><b>More</b></a><span>on {k}</span></div>" for k in range(4))
    body = f"<div><h2>Head</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div>"
    page = f"<body><div><ul>{links}</ul></div>{body}<div>{teasers}</div><div><span><i>c</i></span> 2020</div></body>"
    want = f"Head\n\n{LONG.strip()}\n\nYes.\n\n{LONG.strip()}"
    assert main_text(page) == want
    with monkeypatch.context() as m:
        m.setattr("spanforge.llm.html.smooth", lambda values, sigma: [1.0] * len(values))
        assert main_text(page) != want and "link 3" in main_text(page)
    # content by neighbours: the spread cells of one text, against the same page unsmoothed
    cells = "".join(f"<div><p>{LONG if k % 3 else 'Hm so.'}</p><section><i>x</i><b>y</b> z{k}</section></div>" for k in range(9))
    page = f"<body>{cells}<div><ul>{links}</ul></div></body>"
    assert main_text(page, sigma=1.0) != main_text(page, sigma=0.01) or main_text(page).count("Hm so.") == 3


def plain_article(html):
    """Text of the article of the generated pages, by regular expressions."""
    html = re.sub(r"<!--.*?-->|<(script|style)>.*?</\1>", "", html or "", flags=re.S)
    found = re.search(r"<article>(.*?)(?:</article>|$)", html, re.S)
    text = re.sub(r"</?(?:p|h1|ul|ol|li|div|article)\b[^>]*>", "\0", found[1] if found else "")
    text = unescape(re.sub(r"<br>", " ", text).replace("<b>", "").replace("</b>", ""))
    return "\n\n".join(x for x in (" ".join(part.split()) for part in text.split("\0")) if x)


def test_html_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain_article(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in queries.op4_html(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == want.keys() and sum(map(bool, want.values())) > 200
    for i, text in want.items():
        assert (got[i].text, got[i].n_chars) == (text, len(text)), i
