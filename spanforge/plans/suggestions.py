"""R19 from the trace: the facts the suggestion rules ask for, by A31 (event fractions), A32 (stragglers) and A33 (category shares)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators import serving as sv
from spanforge.plans.reports import suggestions

#: Categories of step time (fixed values).
COLLECTIVES = ("all-gather", "all-reduce", "all-to-all", "collective-permute", "reduce-scatter", "collective-broadcast")


def host_percents(events: DataFrame, steps: DataFrame, host: str) -> DataFrame:
    """A31 by host: events(host, step, dur) -> (host, percent): the mean share of the steps' time that the events of a host take."""
    fractions = sv.event_fraction(events, steps, host)
    return fractions.groupBy(F.col(host).alias("host")).agg((100 * F.avg("fraction")).alias("percent"))


def straggler_hosts(events: DataFrame, steps: DataFrame, host: str) -> DataFrame:
    """The hosts whose percentage lies far from that of the others."""
    return sv.stragglers(host_percents(events, steps, host), "percent")


def suggestion_facts(events: DataFrame, steps: DataFrame, host: str, breakdown: DataFrame, categories: dict[str, Sequence[str]], more: dict[str, tuple[DataFrame, Column]] | None = None) -> DataFrame:
    """One row of facts: barrier_percent is the mean over all hosts and steps of the events' share (A31), straggler_hosts their outliers
    (A32), each of categories (name -> categories of the breakdown) the mean share of the steps (A33) as name_percent; more adds facts (name -> table, aggregate)."""
    fractions = sv.event_fraction(events, steps, host)
    out = fractions.agg(F.coalesce(100 * F.avg("fraction"), F.lit(0.0)).alias("barrier_percent"))
    out = out.crossJoin(straggler_hosts(events, steps, host).agg(F.count("*").alias("straggler_hosts")))
    for name, chosen in categories.items():
        out = out.crossJoin(sv.category_share(breakdown, chosen).select(F.coalesce(100 * F.col("share"), F.lit(0.0)).alias(f"{name}_percent")))
    for name, (df, x) in (more or {}).items():
        out = out.crossJoin(df.agg(x.alias(name)))
    return out


def suggest(events: DataFrame, steps: DataFrame, host: str, breakdown: DataFrame, categories: dict[str, Sequence[str]], more: dict[str, tuple[DataFrame, Column]] | None = None) -> DataFrame:
    """The rules that hold for the facts of the trace."""
    return suggestions(suggestion_facts(events, steps, host, breakdown, categories, more))
