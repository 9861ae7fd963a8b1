"""Mixing to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are counted in cells of source, language and topic (words as the unit of weight).
The cell weights are raked to the target marginals of the three dimensions in turn. No cell can
give more words than it has, so its weight is bounded by its words over the budget while raking: where a
marginal is too low only the cells below their bound grow, and where it is too high all shrink. The
budget is the share of all words to keep, lowered where a single marginal could not be met otherwise
(to ``slack`` of what it allows). A cell's weight times the budget over its words is the inclusion
probability of its documents, so the expected words of the sample have the target marginals;
``marginals`` reports target, expectation and what is left between them. Whether a document is
taken depends only on its id and the seed.

The rounds run on the table of cells by grouped sums that are joined back, one small job a round, and a
source that holds a third of all rows is one set of cells like any other.

Targets may be given as rows (dimension, value, share) for source, lang and topic; values
without a target get weight 0 if their dimension has targets, and targets of values that do not occur
are passed over. Without targets each marginal is flattened: share^alpha, renormalised. ``topic``
names a column; without one the topic is the form of a document.

Odd rows: null source or language is the value ''; null or empty text has no words, and a cell
without any words is kept whole; repeated rows are taken or left together; a null doc_id is drawn
as the id ''; further columns are ignored unless ``topic`` names one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

DIMENSIONS = ("source", "lang", "topic")
_WORD = r"[^\x20\x09-\x0D]+"


def form_topic(text: Column, n_words: Column) -> Column:
    """The default topic of a document: its form."""
    bars = F.length(text) - F.length(F.translate(text, "|", ""))
    return (
        F.when(bars * 5 >= F.greatest(n_words, F.lit(5)), "table").when(n_words < 100, "brief").when(n_words < 1000, "article").otherwise("book")
    )


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id and the seed."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


_FULL = 1 - 1e-12  # of its bound, from which a cell counts as full


def with_targets(cells: DataFrame, targets: DataFrame | None, alpha: float) -> DataFrame:
    """cells(source, lang, topic, n) with the target words of each of their values, t_<dimension>."""
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("all_n"))
    out = cells.crossJoin(F.broadcast(total))
    for d in DIMENSIONS:
        values = cells.groupBy(d).agg(F.sum("n").cast("double").alias("have")).where("have > 0").crossJoin(F.broadcast(total))
        if targets is None:
            share = F.pow(F.col("have") / F.col("all_n"), F.lit(alpha))
        else:
            own = targets.where(F.col("dimension") == d).groupBy(F.coalesce("value", F.lit("")).alias(d)).agg(F.sum("share").cast("double").alias("share"))
            values, share = values.join(own.where("share > 0"), d), F.col("share")
        values = values.select(d, share.alias("share"))
        whole = values.agg(F.sum("share").alias("whole"))
        values = values.crossJoin(F.broadcast(whole)).select(d, (F.col("share") / F.col("whole")).alias("share"))
        out = out.join(values, d, "left").withColumn(f"t_{d}", F.coalesce("share", F.lit(0.0)) * F.col("all_n")).drop("share")
    return out


def feasible(cells: DataFrame, budget: float, slack: float) -> DataFrame:
    """(budget): the asked one, or slack of the most that every single marginal allows."""
    most = None
    for d in DIMENSIONS:
        one = cells.where(F.col(f"t_{d}") > 0).groupBy(d).agg((F.sum("n") / F.max(f"t_{d}")).alias("most")).agg(F.min("most").alias("most"))
        most = one if most is None else most.unionByName(one)
    return most.agg(F.least(F.lit(budget), slack * F.min("most")).alias("budget"))


def rake(cells: DataFrame, rounds: int) -> DataFrame:
    """cells(source, lang, topic, n, budget, t_...) with column w: bounded raked weights."""
    out = cells.withColumn("w", F.col("n").cast("double")).withColumn("most", F.col("n") / F.col("budget"))
    for _ in range(rounds):
        for d in DIMENSIONS:
            full = F.col("w") >= F.col("most") * _FULL
            sums = out.groupBy(d).agg(F.sum("w").alias("all_w"), F.sum(F.when(full, F.col("w")).otherwise(0.0)).alias("full_w"))
            out = out.join(sums, d)
            down = F.try_divide(f"t_{d}", "all_w")
            up = F.coalesce(F.try_divide(F.col(f"t_{d}") - F.col("full_w"), F.col("all_w") - F.col("full_w")), F.lit(1.0))
            w = F.when(down <= 1, F.col("w") * down).when(down.isNull() | full, F.col("w")).otherwise(F.least("most", F.col("w") * up))
            out = out.withColumn("w", w).drop("all_w", "full_w")
        out = materialize(out)
    return out


def marginals(mixed: DataFrame, targets: DataFrame | None = None, *, alpha: float = 0.9) -> DataFrame:
    """(dimension, value, target, expected, residual) of mix_sources' result: the target share of
    each value, its share of the expected words of the sample, and the relative difference."""
    cells = mixed.groupBy(*DIMENSIONS).agg(F.sum("n_words").alias("n"), F.sum(F.col("n_words") * F.col("probability")).alias("e"))
    wanted = with_targets(cells.select(*DIMENSIONS, "n"), targets, alpha)
    out = None
    for d in DIMENSIONS:
        target = wanted.groupBy(d).agg((F.max(f"t_{d}") / F.max("all_n")).alias("target"))
        got = cells.groupBy(d).agg(F.sum("e").alias("e"))
        got = got.crossJoin(F.broadcast(cells.agg(F.sum("e").alias("all_e")))).select(d, F.try_divide("e", "all_e").alias("expected"))
        one = target.join(got, d).select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "target", "expected")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("residual", F.try_divide(F.col("expected"), F.col("target")) - 1)


def mix_sources(
    docs: DataFrame,
    targets: DataFrame | None = None,
    *,
    topic: str | None = None,
    rounds: int = 8,
    alpha: float = 0.9,
    budget: float = 0.8,
    slack: float = 0.9,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, source, lang, topic, n_words, probability, sampled) for every row of
    docs(doc_id, text, source, lang)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = F.regexp_count(text, F.lit(_WORD)).cast("bigint")
    kind = F.coalesce(F.col(topic).cast("string"), F.lit("")) if topic else form_topic(text, F.col("n_words"))
    rows = docs.withColumn("n_words", n).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")),
        kind.alias("topic"), "n_words",
    )
    rows = materialize(rows)
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("n_words").alias("n"))
    cells = materialize(with_targets(materialize(cells), targets, alpha))
    cells = materialize(cells.crossJoin(F.broadcast(feasible(cells, budget, slack))))
    p = F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("w") / F.col("most"), F.lit(1.0))))
    joined = rows.join(rake(cells, rounds).select(*DIMENSIONS, p.alias("p")), list(DIMENSIONS))
    return joined.select(
        "doc_id", *DIMENSIONS, "n_words", F.round("p", 6).alias("probability"), (uniform(F.col("doc_id"), seed) < F.col("p")).alias("sampled")
    )


def _sql(rounds: int = 8, alpha: float = 0.9, budget: float = 0.8, slack: float = 0.9, seed: int = 7) -> str:
    shares = [
        f"t_{d} AS (SELECT {d}, pow(n / total, {alpha}) / sum(pow(n / total, {alpha})) OVER () * total AS t_{d}, n AS n_{d} FROM "
        f"(SELECT {d}, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(sum(n)) OVER () AS DOUBLE) AS total FROM cells GROUP BY {d}) WHERE n > 0)"
        for d in DIMENSIONS
    ]
    columns = "source, lang, topic, n, most, t_source, t_lang, t_topic"
    steps, at = [], "w0"
    for k in range(rounds):
        for d in DIMENSIONS:
            full = f"w >= most * {_FULL!r}"
            s, sc = f"sum(w) OVER (PARTITION BY {d})", f"sum(CASE WHEN {full} THEN w ELSE 0 END) OVER (PARTITION BY {d})"
            steps.append(
                f"w{k}{d[0]} AS (SELECT {columns}, CASE WHEN t_{d} / nullif(s, 0) <= 1 THEN w * (t_{d} / nullif(s, 0)) WHEN s = 0 OR {full} THEN w "
                f"ELSE least(most, w * coalesce((t_{d} - sc) / nullif(s - sc, 0), 1)) END AS w FROM (SELECT *, {s} AS s, {sc} AS sc FROM {at}))"
            )
            at = f"w{k}{d[0]}"
    lowest = " UNION ALL ".join(f"SELECT min(n_{d} / t_{d}) AS most FROM t_{d}" for d in DIMENSIONS)
    return f"""
WITH counted AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_words FROM documents),
docs AS (SELECT doc_id, source, lang, n_words,
  CASE WHEN (length(text) - length(replace(text, '|', ''))) * 5 >= greatest(n_words, 5) THEN 'table' WHEN n_words < 100 THEN 'brief'
       WHEN n_words < 1000 THEN 'article' ELSE 'book' END AS topic FROM counted),
cells AS (SELECT source, lang, topic, CAST(sum(n_words) AS DOUBLE) AS n FROM docs GROUP BY ALL),
{', '.join(shares)},
least_most AS (SELECT least({budget}, {slack} * min(most)) AS budget FROM ({lowest})),
w0 AS (SELECT source, lang, topic, n, n / budget AS most, coalesce(t_source, 0) AS t_source, coalesce(t_lang, 0) AS t_lang, coalesce(t_topic, 0) AS t_topic, n AS w
  FROM cells CROSS JOIN least_most LEFT JOIN t_source USING (source) LEFT JOIN t_lang USING (lang) LEFT JOIN t_topic USING (topic)),
{', '.join(steps)},
p AS (SELECT source, lang, topic, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, w / most) END AS p FROM {at})
SELECT doc_id, source, lang, topic, n_words, round(p, 6) AS probability,
  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{seed}'), 1, 13) AS BIGINT) / 4503599627370496.0 < p AS sampled
FROM docs JOIN p USING (source, lang, topic)"""


SQL = _sql()
