"""Queries of the interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import intervals as iv

from .registry import query

WIDTH = 6 * 3_600_000_000
CLASS = "CASE name WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"

PARENTS = """parents AS (SELECT s.plane_id, s.seq, s.dur, arg_max(p.seq, p.begin) AS parent_seq FROM spans s LEFT JOIN spans p
  ON p.plane_id = s.plane_id AND p.begin < s.begin AND p.begin + p.dur >= s.begin + s.dur GROUP BY s.plane_id, s.seq, s.dur)"""
ISLANDS = """flagged AS (SELECT {k}, begin, begin + dur AS e, CASE WHEN begin > max(begin + dur) OVER (PARTITION BY {k} ORDER BY begin, begin + dur
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM {src}),
numbered AS (SELECT *, sum(f) OVER (PARTITION BY {k} ORDER BY begin, e ROWS UNBOUNDED PRECEDING) AS i FROM flagged),
islands AS (SELECT {k}, min(begin) AS begin, max(e) AS end_ts FROM numbered GROUP BY {k}, i)"""


def islands(k="plane_id", src="spans", tag=""):
    out = ISLANDS.format(k=k, src=src)
    return out.replace("flagged", "flagged" + tag).replace("numbered", "numbered" + tag).replace("islands", "islands" + tag)


@query(
    "j6_nest",
    "SELECT plane_id, seq, parent_seq, CAST(depth AS INTEGER) AS depth FROM tree",
    PARENTS + """, tree AS (SELECT plane_id, seq, parent_seq, 0 AS depth FROM parents WHERE parent_seq IS NULL
  UNION ALL SELECT p.plane_id, p.seq, p.parent_seq, t.depth + 1 FROM parents p JOIN tree t ON p.parent_seq = t.seq)""",
)
def nest(t):
    return iv.nest(t.spans, ["plane_id"], strict=True).select("plane_id", "seq", "parent_seq", "depth")


@query(
    "w2_self_time",
    """SELECT p.plane_id, p.seq, CAST(greatest(p.dur - coalesce(c.inner_dur, 0), 0) AS BIGINT) AS self_dur FROM parents p
  LEFT JOIN (SELECT parent_seq, sum(dur) AS inner_dur FROM parents GROUP BY parent_seq) c ON c.parent_seq = p.seq""",
    PARENTS,
)
def self_time(t):
    return iv.self_time(t.spans, ["plane_id"], strict=True).select("plane_id", "seq", "self_dur")


@query("a17_busy_time", "SELECT plane_id, CAST(sum(end_ts - begin) AS BIGINT) AS busy, count(*) AS islands FROM islands GROUP BY plane_id", islands())
def busy_time(t):
    return iv.busy_time(t.spans, ["plane_id"])


@query("a17_union_intervals", "SELECT plane_id, begin, end_ts FROM islands", islands())
def union_intervals(t):
    return iv.union_intervals(t.spans, ["plane_id"])


@query(
    "a18_duty_cycle",
    """SELECT e.plane_id, CAST(b.busy AS BIGINT) AS busy, CAST(e.hi - e.lo - b.busy AS BIGINT) AS idle FROM
  (SELECT plane_id, min(begin) AS lo, max(begin + dur) AS hi FROM spans GROUP BY plane_id) e
  JOIN (SELECT plane_id, sum(end_ts - begin) AS busy FROM islands GROUP BY plane_id) b USING (plane_id)""",
    islands(src="(SELECT * FROM spans WHERE name NOT IN ('error', 'view'))"),
)
def duty_cycle(t):
    return iv.duty_cycle(t.spans, ["plane_id"], F.col("name").isin("error", "view"))


@query(
    "j7_contained_in",
    """SELECT s.plane_id, s.seq, t.step FROM spans s JOIN steps t ON s.plane_id = t.plane_id
  AND s.begin >= t.begin AND s.begin + s.dur <= t.begin + t.dur""",
)
def contained_in(t):
    return iv.contained_in(t.spans, t.steps, ["plane_id"], WIDTH).select("plane_id", "seq", F.col("r_step").alias("step"))


@query(
    "j8_assign_step",
    """SELECT s.plane_id, s.seq, min(t.step) AS step FROM spans s LEFT JOIN steps t ON s.plane_id = t.plane_id
  AND s.begin <= t.begin + t.dur AND t.begin <= s.begin + s.dur GROUP BY s.plane_id, s.seq""",
)
def assign_step(t):
    return iv.assign_step(t.spans, t.steps, ["plane_id"], WIDTH).select("plane_id", "seq", "step")


@query(
    "j9_asof_run",
    """SELECT e.device_id, e.seq, (SELECT max(r.seq) FROM visits r WHERE r.opcode = 'send' AND r.device_id = e.device_id AND r.ts =
  (SELECT max(q.ts) FROM visits q WHERE q.opcode = 'send' AND q.device_id = e.device_id AND q.ts <= e.ts)) AS run_id
  FROM visits e WHERE opcode = 'recv-done'""".replace("(SELECT max(r.seq)", "(SELECT max(r.seq)"),
)
def asof_run(t):
    runs = t.visits.where("opcode = 'send'").select("device_id", "ts", F.col("seq").alias("id"))
    return iv.asof_run(t.visits.where("opcode = 'recv-done'"), runs, ["device_id"], "id").select("device_id", "seq", "run_id")


_CLICK, _VIEW = "(SELECT * FROM spans WHERE name = 'click')", "(SELECT * FROM spans WHERE name <> 'click')"


@query(
    "j19_overlap_time",
    """SELECT plane_id, CAST(coalesce(sum(greatest(least(a.end_ts, b.end_ts) - greatest(a.begin, b.begin), 0)), 0) AS BIGINT) AS overlap
  FROM islands1 a JOIN islands2 b USING (plane_id) GROUP BY plane_id""",
    islands(src=_CLICK, tag="1") + ", " + islands(src=_VIEW, tag="2"),
)
def overlap_time(t):
    return iv.overlap_time(t.spans.where("name = 'click'"), t.spans.where("name <> 'click'"), ["plane_id"])


_SWEEP = """k AS (SELECT *, {c} AS k FROM spans WHERE dur > 0),
cuts AS (SELECT DISTINCT plane_id, t FROM (SELECT plane_id, begin AS t FROM k UNION ALL SELECT plane_id, begin + dur FROM k)),
pieces AS (SELECT plane_id, t, lead(t) OVER (PARTITION BY plane_id ORDER BY t) AS u FROM cuts),
best AS (SELECT p.plane_id, p.t, p.u, coalesce(max(k.k), 0) AS kind FROM pieces p LEFT JOIN k ON k.plane_id = p.plane_id AND k.begin <= p.t AND k.begin + k.dur >= p.u
  WHERE p.u IS NOT NULL GROUP BY p.plane_id, p.t, p.u)"""


@query(
    "w6_priority_timeline",
    "SELECT plane_id, CAST(kind AS INTEGER) AS kind, CAST(sum(u - t) AS BIGINT) AS time FROM best GROUP BY plane_id, kind",
    _SWEEP.format(c=CLASS),
)
def priority_timeline(t):
    return iv.priority_timeline(t.spans, ["plane_id"], F.expr(CLASS), 4)


@query(
    "a19_precision_split",
    """SELECT plane_id, CAST(coalesce(sum(u - t) FILTER (kind = 2), 0) AS BIGINT) AS compute_16, CAST(coalesce(sum(u - t) FILTER (kind = 1), 0) AS BIGINT) AS compute_32
  FROM best GROUP BY plane_id""",
    _SWEEP.format(c="CASE WHEN name = 'view' THEN 2 ELSE 1 END"),
)
def precision_split(t):
    return iv.precision_split(t.spans, ["plane_id"], F.col("name") == "view")


@query(
    "w3_merge_runs",
    """SELECT plane_id, name, min(begin) AS begin, max(begin + dur) AS end_ts, count(*) AS events, min(seq) AS seq FROM (
  SELECT *, row_number() OVER (PARTITION BY plane_id ORDER BY begin, dur DESC, seq) - row_number() OVER (PARTITION BY plane_id, name ORDER BY begin, dur DESC, seq) AS g FROM spans)
  GROUP BY plane_id, name, g""",
)
def merge_runs(t):
    return iv.merge_runs(t.spans, ["plane_id"], ["name"]).select("plane_id", "name", "begin", "end_ts", "events", "seq")


@query("w3_merge_runs_gap")
def merge_runs_gap(t):
    """Order-dependent merging; compared with a plain fold in the tests."""
    return iv.merge_runs_gap(t.spans, ["plane_id"], "name")


@query(
    "w5_fill_group",
    """SELECT plane_id, seq, last_value(CASE WHEN name = 'signup' THEN seq END IGNORE NULLS) OVER (PARTITION BY plane_id ORDER BY begin, dur, seq
  ROWS UNBOUNDED PRECEDING) AS group_id FROM spans""",
)
def fill_group(t):
    return iv.fill_group(t.spans.withColumn("group_id", F.expr("CASE WHEN name = 'signup' THEN seq END")), ["plane_id"]).select("plane_id", "seq", "group_id")


@query(
    "w10_pair_regions",
    """SELECT plane_id, line_id, seq, b AS begin, begin + dur - b AS dur, start_seq FROM (SELECT *,
  last_value(CASE WHEN name = 'signup' THEN begin END IGNORE NULLS) OVER w AS b, last_value(CASE WHEN name = 'signup' THEN seq END IGNORE NULLS) OVER w AS start_seq
  FROM spans WINDOW w AS (PARTITION BY plane_id, line_id ORDER BY begin, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE name = 'purchase' AND b IS NOT NULL""",
)
def pair_regions(t):
    return iv.pair_regions(t.spans, ["plane_id", "line_id"], F.col("name") == "signup", F.col("name") == "purchase")


@query(
    "w12_mark_last_inside",
    """SELECT o.plane_id, o.seq, arg_max(i.seq, i.begin + i.dur) AS last_seq FROM spans o JOIN spans i ON o.plane_id = i.plane_id AND o.name = 'signup' AND i.name = 'click'
  AND i.begin + i.dur BETWEEN o.begin AND o.begin + o.dur GROUP BY o.plane_id, o.seq""",
)
def mark_last_inside(t):
    return iv.mark_last_inside(t.spans.where("name = 'signup'"), t.spans.where("name = 'click'"), ["plane_id"], WIDTH)


_HOST = "hs AS (SELECT host, row_number() OVER (PARTITION BY host ORDER BY begin, seq) AS idx, begin, dur FROM spans WHERE name = 'purchase')"


@query(
    "j13_align_hosts",
    """SELECT host, "offset", overlap FROM (SELECT host, "offset", CAST(overlap AS BIGINT) AS overlap,
  row_number() OVER (PARTITION BY host ORDER BY overlap DESC, "offset" < 0, abs("offset")) AS r FROM (
    SELECT s.host, c.idx - s.idx AS "offset", sum(least(s.begin + s.dur, c.begin + c.dur) - greatest(s.begin, c.begin)) AS overlap
    FROM hs s, hs c WHERE c.host = (SELECT host FROM hs GROUP BY host ORDER BY max(begin + dur) - min(begin), host LIMIT 1)
      AND s.begin < c.begin + c.dur AND c.begin < s.begin + s.dur GROUP BY ALL)) WHERE r = 1""",
    _HOST,
)
def align_hosts(t):
    w = F.row_number().over(iv.W.partitionBy("host").orderBy("begin", "seq"))
    s = t.spans.where("name = 'purchase'").select("host", w.cast("bigint").alias("idx"), "begin", "dur")
    return iv.align_hosts(s)


@query(
    "j13_step_intersection",
    """SELECT host, f - "offset" AS first_step, greatest(t - f + 1, 0) AS n FROM (SELECT *, max(lo + "offset") OVER () AS f, min(hi + "offset") OVER () AS t FROM
  (SELECT host, min(idx) AS lo, max(idx) AS hi FROM hs GROUP BY host) JOIN (SELECT host, "offset" FROM (SELECT host, "offset", row_number() OVER (PARTITION BY host ORDER BY overlap DESC, "offset" < 0, abs("offset")) AS r FROM (
    SELECT s.host, c.idx - s.idx AS "offset", sum(least(s.begin + s.dur, c.begin + c.dur) - greatest(s.begin, c.begin)) AS overlap
    FROM hs s, hs c WHERE c.host = (SELECT host FROM hs GROUP BY host ORDER BY max(begin + dur) - min(begin), host LIMIT 1)
      AND s.begin < c.begin + c.dur AND c.begin < s.begin + s.dur GROUP BY ALL)) WHERE r = 1) USING (host))""",
    _HOST,
)
def step_intersection(t):
    w = F.row_number().over(iv.W.partitionBy("host").orderBy("begin", "seq"))
    return iv.step_intersection(t.spans.where("name = 'purchase'").select("host", w.cast("bigint").alias("idx"), "begin", "dur"))


@query(
    "j10_intersect_steps",
    "SELECT step FROM steps GROUP BY step HAVING count(DISTINCT plane_id) = (SELECT count(DISTINCT plane_id) FROM steps)",
)
def intersect_steps(t):
    return iv.intersect_steps(t.steps, "plane_id")


@query(
    "a44_collective_overlap",
    """SELECT plane_id, step, CAST(busy AS BIGINT) AS busy, CAST(coalesce(compute, 0) AS BIGINT) AS compute, CAST(coalesce(coll, 0) AS BIGINT) AS collective,
  CAST(coalesce(hidden, 0) AS BIGINT) AS hidden, CAST(coalesce(coll, 0) - coalesce(hidden, 0) AS BIGINT) AS exposed FROM
  (SELECT plane_id, step, sum(end_ts - begin) AS busy FROM islands0 GROUP BY ALL)
  LEFT JOIN (SELECT plane_id, step, sum(end_ts - begin) AS compute FROM islands1 GROUP BY ALL) USING (plane_id, step)
  LEFT JOIN (SELECT plane_id, step, sum(end_ts - begin) AS coll FROM islands2 GROUP BY ALL) USING (plane_id, step)
  LEFT JOIN (SELECT plane_id, step, sum(greatest(least(a.end_ts, b.end_ts) - greatest(a.begin, b.begin), 0)) AS hidden FROM islands1 a JOIN islands2 b USING (plane_id, step) GROUP BY ALL)
  USING (plane_id, step)""",
    "inside AS (SELECT s.*, t.step FROM spans s JOIN steps t ON s.plane_id = t.plane_id AND s.begin >= t.begin AND s.begin + s.dur <= t.begin + t.dur), "
    + islands("plane_id, step", "inside", "0") + ", " + islands("plane_id, step", "(SELECT * FROM inside WHERE name <> 'click')", "1")
    + ", " + islands("plane_id, step", "(SELECT * FROM inside WHERE name = 'click')", "2"),
)
def collective_overlap(t):
    return iv.collective_overlap(t.spans, t.steps, ["plane_id"], F.col("name") != "click", F.col("name") == "click", WIDTH)
