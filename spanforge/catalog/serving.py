"""Queries of serving: tensor patterns of requests, and figures per padded batch size."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import serving as sv

from .registry import query

_PCTS = ", ".join(f"list_sort(list(time))[1 + CAST(least(floor({p} * count(*) / 100), count(*) - 1) AS BIGINT)] AS p{f'{p:g}'.replace('.', '_')}" for p in sv.PERCENTS)
#: Orders as requests with one tensor a line item; some have no layout, some a shape only by kind and dimensions.
_PATTERNS = """tensors AS (SELECT l_orderkey AS request_id, CASE WHEN l_linenumber % 2 = 0 THEN 'TransferIn' ELSE 'TransferOut' END AS name, CASE WHEN l_quantity < 25 THEN concat('f32[', CAST(l_linenumber % 3 AS VARCHAR), ']') END AS shape,
  concat('[', CAST(l_linenumber % 2 AS VARCHAR), ']') AS dims, l_returnflag AS kind, CASE WHEN l_quantity <> 50 THEN l_linestatus END AS layout, CAST(l_quantity AS BIGINT) AS dur FROM lineitem),
parts AS (SELECT request_id, dur, CASE WHEN layout IS NULL THEN NULL ELSE concat_ws(' ', name, coalesce(shape, lower(kind) || dims), layout) END AS part FROM tensors),
patterned AS (SELECT request_id, array_to_string(list_sort(list(part)), '<br>') AS pattern, CAST(sum(dur) AS BIGINT) AS time FROM parts GROUP BY request_id HAVING count(*) = count(part)),
known AS (SELECT pattern, row_number() OVER (ORDER BY count(*) DESC, pattern) - 1 AS pattern_id FROM patterned JOIN requests USING (request_id) GROUP BY pattern)"""


def patterns(t):
    text = lambda x: F.col(x).cast("string")
    number, quantity = F.col("l_linenumber"), F.col("l_quantity")
    tensors = t.table("lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.when(number % 2 == 0, "TransferIn").otherwise("TransferOut").alias("name"),
        F.when(quantity < 25, F.concat(F.lit("f32["), (number % 3).cast("string"), F.lit("]"))).alias("shape"), F.concat(F.lit("["), (number % 2).cast("string"), F.lit("]")).alias("dims"),
        text("l_returnflag").alias("kind"), F.when(quantity != 50, text("l_linestatus")).alias("layout"), quantity.cast("bigint").alias("dur"),
    )
    return sv.tensor_patterns(tensors, ["request_id"])


@query("r15_tensor_patterns", "SELECT * FROM patterned", _PATTERNS)
def tensor_patterns(t):
    return patterns(t)


@query("r15_pattern_table", f"SELECT model, pattern_id, pattern, count(*) AS count, {_PCTS} FROM patterned JOIN requests USING (request_id) JOIN known USING (pattern) GROUP BY ALL", _PATTERNS)
def pattern_table(t):
    return sv.pattern_table(patterns(t).join(t.requests.select("request_id", "model"), "request_id"), ["request_id"])


#: Suppliers as batches of the model that takes part most; a request's phases are parts of its price.
_SIZED = """rq AS (SELECT r.*, o_custkey AS device_time, o_orderkey % 1000 AS delay FROM requests r JOIN orders ON o_orderkey = request_id),
bt AS (SELECT s_suppkey AS batch_id, CASE s_suppkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE '5-LOW' END AS model, 8 * (1 + s_nationkey % 4) AS size, s_suppkey % 7 AS padding, s_suppkey * 1000 AS begin, s_suppkey * 1000 + 5000 + s_nationkey AS end_ts, s_nationkey AS device_time FROM supplier),
rr AS (SELECT model, count(*) AS n, count(*) * 1e6 / (max(end_ts) - min(begin)) AS rate FROM rq GROUP BY model),
br AS (SELECT model, count(*) AS n, count(*) * 1e6 / (max(end_ts) - min(begin)) AS rate FROM bt GROUP BY model),
rs AS (SELECT q.model, b.size, count(*) AS requests, CAST(sum(q.end_ts - q.begin) // count(*) AS BIGINT) AS latency, CAST(sum(q.device_time) // count(*) AS BIGINT) AS device_time, CAST(sum(q.delay) // count(*) AS BIGINT) AS delay
  FROM rq q JOIN request_batch USING (request_id) JOIN bt b USING (batch_id, model) GROUP BY ALL),
bs AS (SELECT model, size, count(*) AS batches, CAST(sum(end_ts - begin) // count(*) AS BIGINT) AS batch_latency, CAST(sum(device_time) // count(*) AS BIGINT) AS batch_device_time, round(sum(size - padding) / sum(size), 8) AS efficiency FROM bt GROUP BY ALL)"""


@query(
    "a27_by_batch_size",
    """SELECT bs.model, bs.size, batches, batch_latency, batch_device_time, efficiency, coalesce(requests, 0) AS requests, latency, rs.device_time, delay,
  round(coalesce(requests * rr.rate / rr.n, 0), 8) AS requests_per_second, round(batches * br.rate / br.n, 8) AS batches_per_second
  FROM bs LEFT JOIN rs ON rs.model = bs.model AND rs.size = bs.size LEFT JOIN rr ON rr.model = bs.model JOIN br ON br.model = bs.model""",
    _SIZED,
)
def by_batch_size(t):
    orders = t.table("orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("device_time"), (F.col("o_orderkey") % 1000).alias("delay"))
    s = t.table("supplier")
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")
    batches = s.select(
        k.alias("batch_id"), F.when(k % 3 == 0, "1-URGENT").when(k % 3 == 1, "2-HIGH").otherwise("5-LOW").alias("model"), (8 * (1 + nation % 4)).alias("size"), (k % 7).alias("padding"),
        (k * 1000).alias("begin"), (k * 1000 + 5000 + nation).alias("end_ts"), nation.alias("device_time"),
    )
    out = sv.serving_by_batch_size(t.requests.join(orders, "request_id"), batches, t.request_batch, ["device_time", "delay"], ["device_time"])
    return out.withColumns({x: F.round(x, 8) for x in ("efficiency", "requests_per_second", "batches_per_second")})


#: Users as requests of the batch of their last digit; purchases process batches, views schedule, clicks read.
_BUILT = """ev AS (SELECT CASE WHEN name = 'purchase' THEN 100000 + correlation_id % 10 ELSE correlation_id END AS g, correlation_id AS u, name, begin, begin + dur AS e, seq FROM spans),
bt AS (SELECT g, arg_max(begin, seq) AS b, arg_max(e, seq) AS e FROM ev WHERE name = 'purchase' GROUP BY g),
base AS (SELECT g, min(begin) AS b, max(e) AS e, arg_max(seq % 10, seq) FILTER (name = 'view') AS size FROM ev WHERE name <> 'purchase' GROUP BY g HAVING bool_or(name = 'signup')),
rq AS (SELECT r.g AS request_id, 'm' || (r.g % 3) AS model, r.b AS begin, greatest(r.e, coalesce(bt.e, r.e)) AS end_ts, coalesce(bt.b - r.b, 0) AS delay, coalesce(size, 0) AS size FROM base r LEFT JOIN bt ON bt.g = 100000 + r.g % 10),
ba AS (SELECT bt.g AS batch_id, bt.b AS begin, bt.e AS end_ts, coalesce(bt.b - (SELECT min(begin) FROM rq WHERE 100000 + request_id % 10 = bt.g), 0) AS delay, (SELECT count(DISTINCT u) FROM ev WHERE 100000 + u % 10 = bt.g) AS requests,
  (SELECT arg_min(model, request_id) FROM rq WHERE request_id = (SELECT min(u) FROM ev WHERE 100000 + u % 10 = bt.g)) AS model FROM bt),
clicks AS (SELECT g, begin, e, max(e) OVER (PARTITION BY g ORDER BY begin, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM ev WHERE name = 'click'),
reading AS (SELECT g, CAST(sum(greatest(e - greatest(begin, coalesce(until, begin)), 0)) AS BIGINT) AS read FROM clicks GROUP BY g)"""


def built(t):
    from spanforge.operators.inference import build_requests

    name, user = F.col("name"), F.col("correlation_id")
    none = {c: F.lit(None).cast("bigint") for c in ("root", "padding", "padded_size", "consumer")}
    kind = F.when(name == "signup", "SessionRun").when(name == "purchase", "ProcessBatch").when(name == "view", "ScheduleWithSplit").when(name == "click", "ReadHbm").otherwise(name)
    events = t.spans.select(
        F.when(name == "purchase", 100000 + user % 10).otherwise(user).alias("group_id"), kind.alias("name"), "begin", "dur", "seq", F.when(name == "signup", F.concat(F.lit("m"), (user % 3).cast("string"))).alias("model"),
        F.when(name == "view", F.col("seq") % 10).alias("task_size"), *(v.alias(k) for k, v in none.items()),
    )
    relations = t.spans.select(user.alias("parent_group"), (100000 + user % 10).alias("child_group")).distinct()
    return build_requests(events, relations, t.spans.where("false").select(user.alias("group_id"), "begin", "dur", F.lit(False).alias("half")))


@query("r15_requests", "SELECT request_id, model, begin, end_ts, delay, rq.size, coalesce(read, 0) AS read FROM rq LEFT JOIN reading ON g = request_id WHERE end_ts > begin", _BUILT)
def built_requests(t):
    return built(t)[0].select("request_id", "model", "begin", "end_ts", "delay", "size", "read")


@query("r15_batches", "SELECT batch_id, model, begin, end_ts, delay, requests FROM ba", _BUILT)
def built_batches(t):
    return built(t)[1].select("batch_id", "model", "begin", "end_ts", "delay", "requests")
