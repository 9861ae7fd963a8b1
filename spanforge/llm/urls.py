"""URL filter: explicit rules, else a path-template tree per host.

Pages are first counted per host and path. The tree grows one level at a time, down to the real depth
of the paths. At a node (a host and a template so far)

* a segment is a branch of its own if it holds ``share`` of the node's pages or more, where the
  node borrows ``borrow`` pages of the same node over all hosts, so that a small site generalises
  like the others; all other segments vary and become the wildcard ``*``;
* branches that are statistically alike are merged: in the order of their shares of bad labels
  they are cut in two where the two parts differ most, if they differ by more than ``z`` standard errors
  (a chi-square test), and the parts again, until no part can be cut; branches without labels go with the
  least bad. A part is named by its segments, ``{de|en}``, or ``*`` if it holds the wildcard or more than one, but everything.

A node whose labels cannot be cut any more, fewer than z^2 or all alike, ends in ``**``: no
branching below could change a verdict, so only nodes with enough labels are carried on. A leaf
is a template; its purity is the share of bad labels, smoothed towards the host's share with
weight ``prior`` (and the host's towards the corpus share), and templates whose smoothed
purity reaches ``reject`` are blocked.

Rules fit a host and all its subdomains if the path starts with theirs; the longest wins.

Odd rows: a null url, or one without ``://``, has empty host and path, fits no rule and is
judged as any other path; null or missing labels count as unlabelled; several labels of a page count as the worst; repeated page ids are
counted and judged row by row; urls of any length and depth are taken whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"^[\s\S]*?://([^/?#]*)([^?#]*)"


def host_and_path(df: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    return df.withColumn("host", F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(url, _URL, 2))


def matching_rule(rules: Sequence[tuple[str, str]]):
    """Column: the longest fitting rule as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # later, longer ones override
        host, _, rest = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _chi_square(b1, l1, b, l):
    """Chi-square of a part with b1 bad of l1 labels against the rest of b and l."""
    d = b1 * l - l1 * b
    return F.coalesce(F.when((l1 > 0) & (l1 < l) & (b > 0) & (b < l), d * d * l / (l1 * (l - l1) * b * (l - b))), F.lit(0.0))


def merged(branches: DataFrame, z: float) -> DataFrame:
    """branches(host, template, name, l, b) -> the same with column part, the number of the
    part of its node that the branch belongs to."""
    parts = branches.withColumn("part", F.lit(1).cast("bigint")).withColumn("open", F.lit(True))
    while True:
        whole = W.partitionBy("host", "template", "part")
        order = whole.orderBy(F.coalesce(F.try_divide("b", "l"), F.lit(0.0)), "name").rowsBetween(W.unboundedPreceding, 0)
        cut = parts.select("*", *(F.sum(c).over(w).cast("double").alias(c + n) for c in "bl" for w, n in ((order, "1"), (whole, "all"))))
        cut = cut.withColumn("chi", F.when(F.col("open"), _chi_square(F.col("b1"), F.col("l1"), F.col("ball"), F.col("lall"))).otherwise(0.0))
        cut = cut.withColumn("most", F.max("chi").over(whole))
        cut = cut.withColumn("edge", F.min(F.when(F.col("chi") == F.col("most"), F.struct("l1", "b1", "name"))).over(whole))
        cut = cut.withColumn("above", F.struct("l1", "b1", "name") > F.col("edge")).withColumn("open", F.col("most") > z * z)
        parts = materialize(cut.select(*branches.columns, (2 * F.col("part") + F.when(F.col("open") & F.col("above"), 1).otherwise(0)).alias("part"), "open"))
        if parts.where("open").isEmpty():
            return parts.drop("open")


def templates(paths: DataFrame, z: float, share: float, borrow: float) -> DataFrame:
    """paths(host, path, segments, n, labelled, bad) -> the same with column template."""
    done, alive = None, paths.withColumn("template", F.lit(""))
    level = 0
    while True:
        node = alive.groupBy("host", "template").agg(F.sum("n").alias("nn"), F.sum("labelled").alias("nl"), F.sum("bad").alias("nb"))
        going = node.where((F.col("nl") > z * z) & (F.col("nb") > 0) & (F.col("nb") < F.col("nl"))).select("host", "template", "nn")
        rows = materialize(alive.join(going, ["host", "template"], "left"))
        more = (F.size("segments") > level) & F.col("nn").isNotNull()
        rest = F.when(F.size("segments") > level, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
        ended = rows.where(~more).withColumn("template", rest).drop("nn")
        done = ended if done is None else done.unionByName(ended)
        rows = rows.where(more).withColumn("step", F.col("segments").getItem(level))
        if rows.isEmpty():
            return done
        child = materialize(rows.groupBy("host", "template", "step").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")), F.max("nn").alias("nn")))
        everywhere = child.groupBy("template", "step").agg(F.sum("n").alias("en"))
        total = child.groupBy("template").agg(F.sum("n").alias("tn"))
        child = child.join(everywhere, ["template", "step"]).join(total, "template")
        own = (F.col("n") + borrow * F.col("en") / F.col("tn")) / (F.col("nn") + borrow) >= share
        child = child.withColumn("name", F.when(own, F.col("step")).otherwise("*"))
        branch = materialize(child.groupBy("host", "template", "name").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")))
        part = merged(branch, z)
        named = part.groupBy("host", "template", "part").agg(F.sort_array(F.collect_list("name")).alias("names"))
        named = named.withColumn("parts", F.count("*").over(W.partitionBy("host", "template")))
        label = F.when(F.size("names") == 1, F.col("names")[0]).when((F.col("parts") == 1) | F.array_contains("names", "*"), F.lit("*"))
        label = label.otherwise(F.concat(F.lit("{"), F.array_join("names", "|"), F.lit("}")))
        part = materialize(part.join(named.withColumn("label", label), ["host", "template", "part"]).select("host", "template", "name", "label"))
        rows = rows.join(part.select("host", "template", F.col("name").alias("step"), "label"), ["host", "template", "step"], "left")
        # what is no branch of its own belongs to the wildcard, wherever that went
        alive = rows.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("label", F.lit("*")))).drop("nn", "step", "label")
        level += 1


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    *,
    z: float = 2.58,
    share: float = 0.05,
    borrow: float = 40.0,
    prior: float = 8.0,
    reject: float = 0.5,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of pages(page_id,
    url); labels(page_id, bad boolean) may cover any part of the pages."""
    bad = labels.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("bad").cast("int").alias("bad"))
    bad = bad.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = host_and_path(pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))).drop("url")
    counted = rows.join(bad, "page_id", "left").groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    counted = materialize(counted.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")))
    tree = templates(counted, z, share, borrow)

    total = counted.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 10)).alias("p0"))
    host = counted.groupBy("host").agg(F.sum("bad").alias("hb"), F.sum("labelled").alias("hl")).crossJoin(F.broadcast(total))
    host = host.select("host", ((F.col("hb") + prior * F.col("p0")) / (F.col("hl") + prior)).alias("ph"))
    leaf = tree.groupBy("host", "template").agg(F.sum("bad").alias("tb"), F.sum("labelled").alias("tl")).join(host, "host")
    leaf = leaf.select("host", "template", F.round((F.col("tb") + prior * F.col("ph")) / (F.col("tl") + prior), 6).alias("purity"))
    judged = materialize(tree.select("host", "path", "template").join(leaf, ["host", "template"]))

    out = rows.join(judged.hint("merge"), ["host", "path"], "left").withColumn("found", matching_rule(rules))
    own = F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "template", "purity")
