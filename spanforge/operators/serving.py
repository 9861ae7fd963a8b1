"""Serving requests and batches, percentiles, and event fractions across hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanforge.functions.columns import safe_divide
from spanforge.operators.ranks import ranked

PERCENTS = (50.0, 75.0, 90.0, 95.0, 99.0, 99.9)


def throughput_latency(requests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests per second and mean latency in us (ticks are us)."""
    d = F.col("end_ts") - F.col("begin")
    extent = (F.max("end_ts") - F.min("begin")) / 1e6
    return requests.groupBy(*by).agg(F.count("*").alias("requests"), safe_divide(F.count("*"), extent).alias("per_second"), F.avg(d).alias("latency"))


def serving_stats(requests: DataFrame, batches: DataFrame) -> DataFrame:
    """Per model: requests, batches, mean latency, mean requests per batch, share of all
    requests."""
    joined = requests.join(batches, "request_id")
    b = joined.groupBy("model").agg(F.count_distinct("batch_id").alias("batches"), F.count("*").alias("pairs"))
    r = requests.groupBy("model").agg(F.count("*").alias("requests"), F.avg(F.col("end_ts") - F.col("begin")).alias("latency"))
    total = requests.agg(F.count("*").alias("all"))
    out = r.join(b, "model", "left").join(F.broadcast(total))
    return out.select("model", "requests", "batches", "latency", safe_divide(F.col("pairs"), F.col("batches")).alias("per_batch"), (F.col("requests") / F.col("all")).alias("share"))


def pattern_percentiles(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], percents: Sequence[float] = PERCENTS) -> DataFrame:
    """Exact percentiles by index floor(p * n) of the sorted values: (by, count, p50, ...)."""
    rows = ranked(df, [value, *order], by, "_i", "_n")
    pick = [F.max(F.when(F.col("_i") == F.least(F.floor(F.lit(p) * F.col("_n") / 100), F.col("_n") - 1), F.col(value))).alias(f"p{p:g}".replace(".", "_")) for p in percents]
    return rows.groupBy(*by).agg(F.count("*").alias("count"), *pick)


def sample_percentiles(df: DataFrame, value: str, order: Sequence[str], percents: Sequence[float] = (50, 75, 90, 99, 99.9, 99.99), near: int = 10, small: int = 60) -> DataFrame:
    """All rows up to ``small``; else the rows around each percentile, at most ``near``."""
    rows = ranked(df, [value, *order], (), "_i", "_n")
    keep = F.col("_n") <= small
    for p in percents:
        at = F.floor(F.lit(float(p)) * F.col("_n") / 100)
        keep = keep | ((F.col("_i") >= at - near // 2) & (F.col("_i") < at + near // 2))
    return rows.where(keep).drop("_i", "_n")


def latency_breakdown(requests: DataFrame, parts: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Mean and index percentiles of total and part latencies, one row per part."""
    long = requests.select(*order, F.posexplode(F.array(*parts)).alias("_p", "value")).withColumn("part", F.element_at(F.array(*(F.lit(p) for p in parts)), F.col("_p") + 1))
    out = pattern_percentiles(long, "value", order, ["part"])
    return out.join(long.groupBy("part").agg(F.avg("value").alias("avg")), "part")


def event_fraction(spans: DataFrame, steps: DataFrame, by: str) -> DataFrame:
    """Share of the step time per step and plane. Of three or more steps the first and
    the last are left out; of two the one shorter than 1 % of the other."""
    s = steps.groupBy("step").agg(F.max("dur").alias("_len"))
    n = F.count("*").over(W.partitionBy())
    longest = F.max("_len").over(W.partitionBy())
    edge = (F.col("step") == F.min("step").over(W.partitionBy())) | (F.col("step") == F.max("step").over(W.partitionBy()))
    s = s.withColumn("_drop", F.when(n >= 3, edge).when(n == 2, F.col("_len") * 100 < longest).otherwise(F.lit(False))).where("not _drop").select("step")
    used = spans.groupBy(by, "step").agg(F.sum("dur").alias("used"))
    out = steps.join(s, "step", "left_semi").join(used, [by, "step"], "left")
    return out.select(by, "step", safe_divide(F.coalesce("used", F.lit(0)), F.col("dur")).alias("fraction"))


def stragglers(hosts: DataFrame, value: str) -> DataFrame:
    """hosts(host, value) whose modified z-score |0.6745 (x - median) / max(MAD, 0.1)| is
    above 3.5; with MAD 0 every deviation counts; fewer than three hosts give none. The
    median is the upper one."""
    w = W.partitionBy()

    def upper_median(df, column, name):
        r = F.row_number().over(W.orderBy(column, "host"))
        ranked = df.withColumn("_r", r).withColumn("_n", F.count("*").over(w))
        return ranked.withColumn(name, F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col(column))).over(w))

    df = upper_median(hosts, value, "_m").withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    df = upper_median(df, "_d", "_mad")
    score = 0.6745 * (F.col(value) - F.col("_m")) / F.greatest("_mad", F.lit(0.1))
    odd = F.when(F.col("_mad") > 0, F.abs(score) > 3.5).otherwise(F.col("_d") > 1e-10)
    return df.where((F.col("_n") >= 3) & odd).select(*hosts.columns)


def category_share(breakdown: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Mean over steps of the matched share of the step's time."""
    per = breakdown.groupBy("step").agg(F.sum("time").alias("t"), F.coalesce(F.sum(F.when(F.col("category").isin(*categories), F.col("time"))), F.lit(0)).alias("m"))
    return per.where("t > 0").agg(F.avg(F.col("m") / F.col("t")).alias("share"))


def step_summary(steps: DataFrame) -> DataFrame:
    """steps(step, dur, bottleneck): mean, extremes, deviation, the most common bottleneck."""
    stats = steps.agg(F.count("*").alias("steps"), F.avg("dur").alias("avg"), F.min("dur").alias("min"), F.max("dur").alias("max"), F.coalesce(F.stddev_samp("dur"), F.lit(0.0)).alias("sd"))
    n = steps.groupBy("bottleneck").agg(F.count("*").alias("_c"), F.min("step").alias("_o"))
    return stats.join(n.orderBy(F.col("_c").desc(), "_o").limit(1).select("bottleneck"))


def tensor_patterns(tensors: DataFrame, owner: Sequence[str]) -> DataFrame:
    """tensors(owner..., name, shape, dims, kind, layout, dur) -> (owner..., pattern, time): the transfers of a request or batch as one
    text, each as name, shape (else its kind in small letters with its dimensions) and layout, sorted and joined, and their time. An
    owner with a tensor whose shape or layout is unknown has no pattern."""
    shape = F.coalesce("shape", F.concat(F.coalesce(F.lower("kind"), F.lit("")), "dims"), F.lit(""))
    whole = (shape != "") & F.col("layout").isNotNull()
    part = F.concat_ws(" ", "name", shape, "layout")
    per = tensors.groupBy(*owner).agg(F.bool_and(whole).alias("_whole"), F.array_sort(F.collect_list(part)).alias("_parts"), F.sum("dur").alias("time"))
    return per.where("_whole").select(*owner, F.array_join("_parts", "<br>").alias("pattern"), "time")


def pattern_table(details: DataFrame, order: Sequence[str], by: Sequence[str] = ("model",), percents: Sequence[float] = PERCENTS) -> DataFrame:
    """details(by..., pattern, time, order...) -> (by..., pattern_id, pattern, count, percentiles of the time): patterns are numbered over all
    models, the most frequent first, then by text."""
    out = pattern_percentiles(details, "time", order, [*by, "pattern"], percents)
    known = out.groupBy("pattern").agg(F.sum("count").alias("_n")).withColumn("_less", -F.col("_n"))
    numbered = ranked(known, ["_less", "pattern"]).select("pattern", F.col("rank").alias("pattern_id"))
    return out.join(numbered, "pattern").select(*by, "pattern_id", "pattern", *(c for c in out.columns if c not in (*by, "pattern")))


def serving_by_batch_size(requests: DataFrame, batches: DataFrame, links: DataFrame, request_parts: Sequence[str], batch_parts: Sequence[str]) -> DataFrame:
    """A27 per padded batch size: requests(request_id, model, begin, end_ts, parts...), batches(batch_id, model, size, padding, begin, end_ts, parts...),
    links(request_id, batch_id) -> per model and size: how often a request was in such a batch and its mean latency and parts, the
    batches with their mean latency, parts and efficiency, and both's share of the model's throughput. Means are whole numbers (div)."""
    whole = lambda name, x: F.call_function("div", F.sum(x), F.count("*")).alias(name)
    d = F.col("end_ts") - F.col("begin")
    rate = lambda df: df.groupBy("model").agg(F.count("*").alias("_all"), safe_divide(F.count("*") * 1e6, F.max("end_ts") - F.min("begin")).alias("_rate"))
    sized = requests.join(links, "request_id").join(batches.select("batch_id", "model", "size"), ["batch_id", "model"])
    r = sized.groupBy("model", "size").agg(F.count("*").alias("requests"), whole("latency", d), *(whole(x, F.col(x)) for x in request_parts))
    b = batches.groupBy("model", "size").agg(
        F.count("*").alias("batches"), whole("batch_latency", d), *(whole(f"batch_{x}", F.col(x)) for x in batch_parts), safe_divide(F.sum(F.col("size") - F.col("padding")), F.sum("size")).alias("efficiency"),
    )
    out = b.join(r, ["model", "size"], "left").na.fill(0, ["requests"])
    share = lambda n: safe_divide(F.col(n) * F.col("_rate"), F.col("_all"))
    out = out.join(rate(requests), "model", "left").withColumn("requests_per_second", F.coalesce(share("requests"), F.lit(0.0))).drop("_all", "_rate")
    return out.join(rate(batches), "model").withColumn("batches_per_second", share("batches")).drop("_all", "_rate")
