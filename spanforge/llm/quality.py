"""Quality rules with adaptive thresholds, in DataFrame functions only.

Four ratios per document (thousandths): word length, symbols per word, repeated lines per
line, repeated words per word. Their distribution among the documents that pass the base rules is kept
per language, source and size class (binary order of the number of words, as ratios of short documents
scatter more) as a mergeable quantile sketch: counts per logarithmic bucket (values keep their
top ``BITS`` bits, so a quantile is at most 1/512 below the exact one). Sketches of all three add
up to those of language and size, of the language and of the corpus; a group below ``min_group``
documents takes the next wider one.

Thresholds are fences: the inner quantile of a side plus ``fence`` times its distance from the
median, quartiles on both sides for the word length and the ninth decile, upper side only, for
the three counts of something unwanted. A count must also exceed its fence by ``z`` standard errors of
itself (repeated words come in tens). So all thresholds follow from the data; ``fence`` and ``z``
only say how far from usual is too far. They are joined back for the verdict.

Odd rows: null or empty text has no words and fails the base rules; null language or source
form a group of their own; repeated rows are judged alike and count in the sketches; a null doc_id is judged as any other; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, materialize

BITS = 10

#: ratio -> (numerator, denominator, quantiles below, in the middle and above, in twentieths, words of one event);
#: without a quantile below only the upper fence counts, and only beyond chance
RATIOS = {
    "word_length": ("word_chars", "n_words", 5, 10, 15, None),
    "symbols": ("n_symbols", "n_words", None, 10, 18, 1),
    "dup_lines": ("n_dup_lines", "n_lines", None, 10, 18, 1),
    "repeats": ("n_repeat_words", "n_words", None, 10, 18, 10),
}
CUTS = (5, 10, 15, 18)

_REPEATS = """
CASE WHEN size(words) < 5 THEN 0 ELSE transform(array(transform(words, w -> xxhash64(w))), h ->
  transform(array(transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i+1], h[i+2], h[i+3], h[i+4]))), k ->
    CASE WHEN size(array_distinct(k)) = size(k) THEN 0 ELSE
      transform(array(array_sort(transform(k, (x, i) -> struct(x AS x, i AS i)))), s ->
        aggregate(
          array_sort(transform(filter(s, (e, j) -> (j > 0 AND s[greatest(j - 1, 0)].x = e.x)
            OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].x = e.x)), e -> e.i)),
          struct(-5 AS last, 0 AS n),
          (a, p) -> struct(p AS last, a.n + least(5, p - a.last) AS n),
          a -> a.n))[0]
    END)[0])[0] END
"""


def base_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, size)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "").alias("lines"),
    )
    counted = rows.select(
        "doc_id", "lang", "source", F.size("words").cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr(_REPEATS).cast("bigint").alias("n_repeat_words"), F.size("lines").cast("bigint").alias("n_lines"),
    )
    return counted.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")).withColumn("size", F.length(F.bin("n_words")))


def bucket(v: Column) -> Column:
    """Lower end of the sketch bucket of a non-negative integer."""
    shift = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def thresholds(counts: DataFrame, min_group: int) -> DataFrame:
    """(lang, source, size, q): the quantiles at CUTS of each ratio, from the merged sketches."""
    good = counts.where("not base_failed")
    pairs = F.explode(F.array(*(
        F.struct(F.lit(name).alias("ratio"), F.expr(f"1000 * {num} DIV greatest({den}, 1)").alias("v")) for name, (num, den, *_) in RATIOS.items()
    )))
    sketch = good.select("lang", "source", "size", pairs.alias("x")).select("lang", "source", "size", "x.ratio", bucket(F.col("x.v")).alias("b"))
    sketch = materialize(sketch.groupBy("lang", "source", "size", "ratio", "b").agg(F.count("*").alias("n")))

    def quantiles(keys):
        merged = sketch.groupBy(*keys, "ratio", "b").agg(F.sum("n").alias("n"))
        part = W.partitionBy(*keys, "ratio")
        run = merged.withColumn("upto", F.sum("n").over(part.orderBy("b"))).withColumn("total", F.sum("n").over(part))
        at = [F.min(F.when(F.col("upto") * 20 >= F.col("total") * k, F.col("b"))) for k in CUTS]
        wide = run.groupBy(*keys, "ratio").agg(F.max("total").alias("total"), F.array(*at).alias("q"))
        return wide.groupBy(*keys).agg(F.max("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("ratio", "q"))).alias("q"))

    joined = counts.select("lang", "source", "size").distinct()
    q = F.lit(None)
    for level, keys in enumerate((["lang", "source", "size"], ["lang", "size"], ["lang"])):
        found = quantiles(keys).where(F.col("total") >= min_group).select(*keys, F.col("q").alias(f"q{level}"))
        joined = joined.join(found, keys, "left")
        q = F.coalesce(q, F.col(f"q{level}")) if level else F.col("q0")
    every = quantiles([]).agg(F.first("q").alias("all_q"))
    return joined.crossJoin(F.broadcast(every)).select("lang", "source", "size", F.coalesce(q, "all_q").alias("q"))


def quality_rules(docs: DataFrame, *, fence: int = 6, z: float = 3.0, min_group: int = 100) -> DataFrame:
    """Base counts, base_failed and kept for every row of docs(doc_id, text, lang, source)."""
    counts = materialize(base_counts(docs))
    joined = counts.join(thresholds(counts, min_group), ["lang", "source", "size"], "left")
    strange = F.lit(False)
    for name, (num, den, below, middle, above, event) in RATIOS.items():
        v = F.expr(f"1000 * {num} DIV greatest({den}, 1)")
        q = {cut: F.col("q")[name][k] for k, cut in enumerate(CUTS)}
        high = q[above] + fence * (q[above] - q[middle])
        if below is not None:
            odd = (v > high) | (v < q[below] - fence * (q[middle] - q[below]))
        else:
            over = F.lit(1000.0) * F.col(num) - (high * F.col(den)).cast("double")
            odd = (over > 0) & (over * over > F.lit(z * z * 1e6 * event) * F.col(num))
        strange = strange | F.coalesce(odd, F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~strange).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql(fence: int = 6, z: float = 3.0, min_group: int = 100) -> str:
    bucketed = f"CASE WHEN length(bin(v)) > {BITS} THEN (v >> (length(bin(v)) - {BITS})) << (length(bin(v)) - {BITS}) ELSE v END"
    value = "CAST(1000 * {num} // greatest({den}, 1) AS BIGINT)"
    ratios = " UNION ALL ".join(
        f"SELECT lang, source, size, '{name}' AS ratio, {value.format(num=num, den=den)} AS v FROM counts WHERE NOT base_failed" for name, (num, den, *_) in RATIOS.items()
    )

    def quant(name, keys):
        k = "".join(f"{x}, " for x in keys)
        at = ", ".join(f"min(b) FILTER (upto * 20 >= total * {cut}) AS q{cut}" for cut in CUTS)
        return f"""{name} AS (SELECT {k}ratio, max(total) AS total, {at}
          FROM (SELECT {k}ratio, b, sum(n) OVER (PARTITION BY {k}ratio ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {k}ratio) AS total
                FROM (SELECT {k}ratio, b, sum(n) AS n FROM sketch GROUP BY {k}ratio, b)) GROUP BY {k}ratio)"""

    tests = []
    for name, (num, den, below, middle, above, event) in RATIOS.items():
        v, high = value.format(num=num, den=den), f"(q{above} + {fence} * (q{above} - q{middle}))"
        if below is not None:
            test = f"{v} > {high} OR {v} < q{below} - {fence} * (q{middle} - q{below})"
        else:
            over = f"(CAST(1000 AS DOUBLE) * {num} - CAST({high} * {den} AS DOUBLE))"
            test = f"{over} > 0 AND {over} * {over} > CAST({z * z * 1e6 * event} AS DOUBLE) * {num}"
        tests.append(f"(ratio = '{name}' AND ({test}))")
    chosen = ", ".join(
        f"CASE WHEN o.total >= {min_group} THEN o.q{c} WHEN s.total >= {min_group} THEN s.q{c} WHEN l.total >= {min_group} THEN l.q{c} ELSE e.q{c} END AS q{c}" for c in CUTS
    )
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM words),
grams AS (SELECT doc_id, p, lead(p, 4) OVER d AS last,
  (word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d) AS g FROM pos WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams WHERE last IS NOT NULL) WHERE c > 1),
reps AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
counts AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, length(bin(n_words)) AS size FROM (
  SELECT d.doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines
  FROM documents d JOIN words USING (doc_id) LEFT JOIN reps USING (doc_id))),
sketch AS (SELECT lang, source, size, ratio, {bucketed} AS b, count(*) AS n FROM ({ratios}) GROUP BY ALL),
{quant('own', ['lang', 'source', 'size'])}, {quant('bysize', ['lang', 'size'])}, {quant('bylang', ['lang'])}, {quant('every', [])},
th AS (SELECT g.lang, g.source, g.size, e.ratio, {chosen}
  FROM (SELECT DISTINCT lang, source, size FROM counts) g CROSS JOIN every e
  LEFT JOIN bylang l ON l.lang = g.lang AND l.ratio = e.ratio
  LEFT JOIN bysize s ON s.lang = g.lang AND s.size = g.size AND s.ratio = e.ratio
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.size = g.size AND o.ratio = e.ratio),
odd AS (SELECT doc_id, bool_or({' OR '.join(tests)}) AS odd FROM counts JOIN th USING (lang, source, size) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(odd, FALSE) AS kept
FROM counts LEFT JOIN odd USING (doc_id)"""


SQL = _sql()
