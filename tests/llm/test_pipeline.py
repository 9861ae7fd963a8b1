"""The pipeline against brute force, stage after stage."""

from __future__ import annotations

import random
from collections import Counter

import brute
import corpus_pipeline as cp
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = brute.quality_kept(docs)
    docs = [d for d in docs if d[0] in good]
    groups = brute.near_duplicates([d[:2] for d in docs])
    docs = [d for d in docs if groups[d[0]][1] == d[0]]
    leaks = brute.contaminated([d[:2] for d in docs], items)
    docs = [d for d in docs if d[0] not in leaks]
    taken = brute.mixed(docs)
    docs = [d for d in docs if d[0] in taken]
    got = {r.doc_id: r.shard for r in cp.run(spark, SF).collect()}
    assert got == brute.shards([d[:2] for d in docs])
    assert leaks and len(got) > 50


def test_stages_keep_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty, long and invalid texts, repeated rows, ties and clashing columns."""
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("stone", "river", "cloud", "field") for b in range(300)]
    prose = [" ".join(rng.choices(words, k=80)) for _ in range(6)]
    rows = [(i, prose[i], "en", "a") for i in range(6)]
    rows += [(0, prose[0], "en", "a"), (10, prose[1], None, "a"), (11, prose[2], "en", None), (12, None, "en", "a"), (13, "", None, None)]
    rows += [(14, " ".join(rng.choices(words, k=60_000)), "en", "b"), (None, prose[3], "en", "a"), (None, None, None, None), (15, "a b", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    bad = docs.where("doc_id = 5").withColumn("text", F.concat(F.expr("cast(x'ff20' as string)"), "text")).withColumn("doc_id", F.lit(16).cast("bigint"))
    docs = docs.unionByName(bad)
    for name in ("_chosen_id", "ids", "docs", "id", "key", "kept", "topic", "p", "h", "shard", "slice", "bucket"):
        docs = docs.withColumn(name, F.lit("clash"))
    ids = Counter(r.doc_id for r in docs.collect())
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        found = Counter(r.doc_id for r in out.collect())
        assert all(found[i] in (0, ids[i]) for i in found), name
        if name == cp.STAGES[-1][0]:
            assert found == ids
        else:
            assert out.columns == docs.columns
        if name == "near_dedup":
            assert found == ids - Counter({10: 1, 11: 1, 16: 1}) | Counter({16: found[16]})
        if name == "quality_rules":
            assert not found.keys() & {12, 13, 15} and found[0] == 2
        if name == "decontamination":
            assert found == ids
