"""The driver's tables in the shapes of a trace, for queries and tests.

Each adapter is one SELECT, written once with ``{us(x)}``-style helpers that differ between
Spark SQL and the SQL of the oracle. Ticks are microseconds.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

ORIGIN_US = 1704067200000000
DAY = 86_400_000_000


def _us(column: str, spark: bool) -> str:
    return f"unix_micros(CAST({column} AS TIMESTAMP))" if spark else f"epoch_us({column})"


def _div(a: str, b: str, spark: bool) -> str:
    return f"({a}) DIV ({b})" if spark else f"({a}) // ({b})"


def _cents(column: str) -> str:
    return f"CAST(round({column} * 100) AS BIGINT)"


def definitions(spark: bool) -> dict[str, str]:
    """Adapter name -> SELECT, in dependency order."""
    us = lambda c: _us(c, spark)
    step = _div("begin", str(DAY), spark)
    number = lambda x: f"CAST({x} AS STRING)" if spark else f"CAST({x} AS VARCHAR)"
    return {
        "spans": f"""SELECT 's0' AS session, concat('h', {number('user_id % 4')}) AS host, CAST(user_id % 8 AS BIGINT) AS plane_id,
            concat('/device:TPU:', {number('user_id % 8')}) AS plane, CAST(user_id % 2 AS BIGINT) AS line_id, 'XLA Ops' AS line,
            event_id AS seq, event_type AS name, {us('ts')} - {ORIGIN_US} AS begin, {_cents('value')} * 360000 AS dur,
            user_id AS correlation_id FROM events""",
        "steps": f"""SELECT DISTINCT plane_id, {step} AS step, ({step}) * {DAY} AS begin, CAST(82800000000 AS BIGINT) AS dur FROM spans""",
        "ops": f"""SELECT CAST(p_partkey % 7 AS BIGINT) AS program_id, p_partkey AS symbol_id, p_name AS name, p_type AS category,
            concat(p_brand, '/', p_type, '/', p_name, ':Op') AS provenance, CAST(p_size * 1000 AS BIGINT) AS flops,
            {_cents('p_retailprice')} AS bytes FROM part""",
        "op_events": f"""SELECT concat('h', {number('l_suppkey % 4')}) AS host, l_suppkey AS plane_id, CAST(l_partkey % 7 AS BIGINT) AS program_id,
            l_partkey AS symbol_id, l_orderkey, l_linenumber, {us('l_shipdate')} AS begin, {_cents('l_extendedprice')} AS dur,
            CAST(l_quantity AS BIGINT) AS occurrences, {_cents('l_discount')} AS dma_stall FROM lineitem""",
        "alloc_events": f"""SELECT CAST(o_custkey % 4 AS BIGINT) AS allocator, {us('o_orderdate')} AS ts, o_orderkey AS seq,
            CASE WHEN o_orderstatus = 'F' THEN 'free' ELSE 'alloc' END AS kind, o_custkey AS address, {_cents('o_totalprice')} AS bytes,
            {_cents('o_totalprice')} AS heap, CAST((o_orderkey % 16) * 1024 AS BIGINT) AS stack, 100000000000 - {_cents('o_totalprice')} AS free,
            CASE WHEN o_orderkey % 3 = 0 THEN CAST(-1 AS BIGINT) ELSE CAST(o_orderkey % 50 AS BIGINT) END AS step_id, o_orderpriority AS op FROM orders""",
        "counters": f"""SELECT CAST(l_suppkey % 2 AS BIGINT) AS device_id, CAST(l_linenumber AS BIGINT) AS line_id, CAST(l_partkey % 64 AS BIGINT) AS counter_id,
            {us('l_shipdate')} AS "offset", l_orderkey AS dur, CAST(l_quantity AS BIGINT) AS value,
            l_partkey * 1000000 + l_suppkey AS seq FROM lineitem""".replace('"offset"', "`offset`" if spark else '"offset"'),
        "hlo_edges": f"""SELECT DISTINCT concat('p', {number('l_partkey')}) AS src, concat('s', {number('l_suppkey')}) AS dst FROM lineitem""",
        "visits": f"""SELECT CAST(user_id % 2 AS BIGINT) AS device_id, concat('rv', {number('user_id % 20')}) AS rendezvous,
            CASE event_type WHEN 'signup' THEN 'send' WHEN 'view' THEN 'send-done' WHEN 'click' THEN 'recv' WHEN 'purchase' THEN 'recv-done'
            ELSE 'other' END AS opcode, event_id AS seq, {us('ts')} - {ORIGIN_US} AS ts, {_cents('value')} AS dur FROM events""",
        "requests": f"""SELECT o_orderkey AS request_id, o_orderpriority AS model, {us('o_orderdate')} AS begin,
            {us('o_orderdate')} + {_cents('o_totalprice')} AS end_ts FROM orders""",
        "request_batch": "SELECT DISTINCT l_orderkey AS request_id, l_suppkey AS batch_id FROM lineitem",
    }


#: The adapters as common table expressions of the oracle.
PRELUDE = "WITH RECURSIVE " + ",\n".join(f"{name} AS ({text})" for name, text in definitions(False).items())


class Trace:
    """The trace tables of one sf directory as lazy DataFrames: ``Trace(spark, dir).spans``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _adapter(self, name: str, source: str | None = None) -> DataFrame:
        text = definitions(True)[name]
        source = text.rsplit("FROM", 1)[1].strip()
        df = getattr(self, source) if source in definitions(True) else self.table(source)
        return self.spark.sql(text.rsplit("FROM", 1)[0] + "FROM {source}", source=df)


def _lazy(name: str) -> cached_property:
    prop = cached_property(lambda self: self._adapter(name))
    prop.__set_name__(Trace, name)
    return prop


for _name in definitions(True):
    setattr(Trace, _name, _lazy(_name))
