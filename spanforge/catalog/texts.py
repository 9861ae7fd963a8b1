"""Scalar functions over texts made of the parts' names, types and sizes; the SQL reads each answer off the text itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import columns as c

from .registry import query

#: (Spark SQL and DuckDB) one text per kind and part.
_TEXTS = """SELECT p_partkey AS id, p_size AS n, lower(replace(p_name, ' ', '/')) AS path, replace(p_type, ' ', '') AS word, lower(replace(p_type, ' ', '_')) AS low, p_name, p_type FROM part"""
_FULL = (
    "concat(path, ':', word)", "concat(path, '_', n, ':')", "concat(path, ':', low, '[', n, ']')", "concat('Iterator:', word)", "concat('MemcpyHToD ', path)", "concat('memcpydtoh', n)",
    "p_name", "concat(p_name, ':', p_type)", "concat('jit(', path, ')/', low, '_', n, ':')", "concat('InfeedEnqueueTuple.', n)", "concat('x:InfeedEnqueue', word)", "concat('IteratorGetNext', n, ' half ')",
    "concat('ncclKernel_', low)", "concat('gemm_fp16_', n)", "concat('Iterator::Batch::', word, 'RecordReader')", "concat('Iterator::Root::Prefetch::', word)", "concat('gradient_tape/', path, '/MatMul:', word)", "concat('gradients/', path, ':', word)",
    "concat('jit(f)/transpose(jvp(', low, '))/', low, ':', low)", "concat('volta_h884gemm_', n)", "concat('net/', word, '/Conv2D')", "concat(path, '/BatchMatMulV', n)",
)
_KINDS = ", ".join(f"({i}, {text})" for i, text in enumerate(_FULL))
TEXTS = f"""texts AS (SELECT id, n, k, text FROM ({_TEXTS}), LATERAL (VALUES {_KINDS}) v(k, text)),
cut AS (SELECT *, split_part(text, ':', 1) AS name, CASE WHEN contains(text, ':') THEN substr(text, strpos(text, ':') + 1) ELSE '' END AS kind, contains(text, ':') AS colon FROM texts),
derived AS (SELECT *, CASE WHEN kind = '' THEN regexp_replace(string_split(name, '/')[-1], '(.)_\\s*[-+]?[0-9]+\\s*$', '\\1') ELSE kind END AS made FROM cut),
sorted AS (SELECT *, CASE WHEN NOT colon THEN CASE WHEN regexp_matches(lower(text), '^memcpy(htod|dtoh|dtod|htoh)') THEN 'Memcpy' ELSE 'Unknown' END WHEN name = 'Iterator' THEN 'TfData'
  WHEN regexp_full_match(name, '[A-Za-z0-9.][A-Za-z0-9_.\\\\/>-]*') AND regexp_full_match(kind, '[A-Z_][A-Za-z0-9_]*') THEN 'TensorFlow' WHEN regexp_full_match(made, '[a-z_][a-z0-9_.-]*(\\[.*\\])?') THEN 'Jax' WHEN kind = '' THEN 'TensorFlow' ELSE 'Unknown' END AS category FROM derived),
ops1 AS (SELECT *, CASE WHEN category IN ('TensorFlow', 'Jax') THEN name ELSE text END AS op_name, CASE category WHEN 'Memcpy' THEN 'Memcpy' || CASE substr(lower(text), 7, 4) WHEN 'htod' THEN 'HToD' WHEN 'dtoh' THEN 'DToH' WHEN 'dtod' THEN 'DToD' ELSE 'HToH' END WHEN 'TfData' THEN 'Dataset' WHEN 'TensorFlow' THEN made
  WHEN 'Jax' THEN split_part(made, '[', 1) ELSE '' END AS type FROM sorted)"""


def texts(t):
    base = t.spark.sql(_TEXTS.replace("FROM part", "FROM {part}"), part=t.table("part"))
    kinds = F.array(*(F.struct(F.lit(i).alias("k"), F.expr(x).alias("text")) for i, x in enumerate(_FULL)))
    return base.select("id", "n", F.explode(kinds).alias("v")).select("id", "n", "v.k", "v.text")


@query("x1_parse_texts", "SELECT id, k, category, op_name AS name, type FROM ops1", TEXTS)
def parse_texts(t):
    op = c.parse_op(F.col("text"))
    return texts(t).select("id", "k", op["category"].alias("category"), op["name"].alias("name"), op["type"].alias("type"))


@query(
    "x2_scopes_of_texts",
    """SELECT id, k, CASE category WHEN 'Unknown' THEN rtrim(op_name) WHEN 'TfData' THEN 'Iterator::' || string_split(op_name, '::')[-1] ELSE type END AS shown,
  CASE WHEN category IN ('TensorFlow', 'Jax') THEN array_to_string(string_split(op_name, '/')[:-2], '|') ELSE '' END AS scope FROM ops1""",
    TEXTS,
)
def scopes_of_texts(t):
    op = c.parse_op(F.col("text"))
    return texts(t).select("id", "k", c.event_name(op).alias("shown"), F.array_join(c.scopes(op), "|").alias("scope"))


@query(
    "x8_launch_texts",
    """SELECT id, CAST(regexp_extract(text, 'grid:([0-9]+),', 1) AS BIGINT) AS grid_x, CAST(regexp_extract(text, 'block:[0-9]+,[0-9]+,([0-9]+)', 1) AS BIGINT) AS block_z, TRY_CAST(regexp_extract(text, 'regs:([0-9]+)', 1) AS BIGINT) AS regs,
  TRY_CAST(regexp_extract(text, 'occ_pct:([0-9.]+)', 1) AS DOUBLE) AS occupancy FROM (SELECT p_partkey AS id, concat(CASE WHEN p_size < 25 THEN concat('regs:', p_size, ' ') ELSE '' END, 'grid:', p_partkey, ',', p_size, ',1 block:', p_size, ',1,', length(p_name), CASE WHEN p_type LIKE '%TIN' THEN '' ELSE concat(' occ_pct:', p_size, '.5') END) AS text FROM part)""",
)
def launch_texts(t):
    text = F.expr("concat(CASE WHEN p_size < 25 THEN concat('regs:', p_size, ' ') ELSE '' END, 'grid:', p_partkey, ',', p_size, ',1 block:', p_size, ',1,', length(p_name), CASE WHEN p_type LIKE '%TIN' THEN '' ELSE concat(' occ_pct:', p_size, '.5') END)")
    p = c.launch_params(text)
    return t.table("part").select(F.col("p_partkey").alias("id"), p["grid"][0].alias("grid_x"), p["block"][2].alias("block_z"), p["regs"].alias("regs"), p["occupancy"].alias("occupancy"))


_SUFFIX, _INFIX, _KERNEL = ("|".join(x) for x in (c.TENSOR_CORE_SUFFIXES, c.TENSOR_CORE_INFIXES, c.TENSOR_CORE_KERNELS))
_EQUATION = "concat(substr(p_name, 1, 2), CASE WHEN p_size % 2 = 0 THEN ',' ELSE '' END, substr(p_type, 1, 1), CASE WHEN p_size > 10 THEN '->' ELSE '' END, substr(p_type, 2, 1))"


@query("x9_tensor_core_texts", f"SELECT id, k, regexp_matches(text, '({_SUFFIX})$') OR regexp_matches(text, '{_INFIX}') AS eligible, regexp_matches(text, '{_KERNEL}') AS kernel FROM texts", TEXTS)
def tensor_core_texts(t):
    return texts(t).select("id", "k", c.tensor_core_eligible(F.col("text"), F.lit("")).alias("eligible"), c.tensor_core_kernel(F.col("text")).alias("kernel"))


@query("x9_equations", f"SELECT id, regexp_full_match(e, '[^,>]*,[^,>]*->[^>]*') AS eligible FROM (SELECT p_partkey AS id, {_EQUATION} AS e FROM part)")
def equations(t):
    return t.table("part").select(F.col("p_partkey").alias("id"), c.tensor_core_eligible(F.lit("net/Add"), F.expr(_EQUATION)).alias("eligible"))


@query(
    "x11_human_bytes_all_sizes",
    """SELECT id, e, CASE WHEN b < 1024 THEN b || 'B' WHEN b < 1048576 THEN printf('%.1f', b / 1024.0) || 'K' WHEN b < 1073741824 THEN printf('%.2f', b / 1048576.0) || 'M' ELSE printf('%.2f', b / 1073741824.0) || 'G' END AS text
  FROM (SELECT p_partkey AS id, e, (p_partkey * 37 + 1) * CAST(pow(10, e) AS BIGINT) AS b FROM part, (SELECT unnest([0, 3, 5, 7, 9]) AS e))""",
)
def human_bytes(t):
    b = (F.col("id") * 37 + 1) * F.pow(F.lit(10), F.col("e")).cast("bigint")
    rows = t.table("part").select(F.col("p_partkey").alias("id"), F.explode(F.array(*map(F.lit, (0, 3, 5, 7, 9)))).alias("e"))
    return rows.select("id", "e", c.human_bytes(b).alias("text"))


_KEY = "concat(CASE WHEN p_size % 9 = 0 THEN 'dev_' ELSE 'device_' END, p_size, '_gid_', replace(p_name, ' ', '-'), CASE WHEN p_partkey % 2 = 0 THEN '@x' ELSE '' END)"
_SIZES = "concat('all (', p_size, ',', length(p_name), '):', p_partkey, ';(1,', p_size, '):7', CASE WHEN p_size > 25 THEN ' (2,3)' ELSE '' END)"


@query(
    "x13_keys_of_texts",
    f"""SELECT id, TRY_CAST(regexp_extract(key, 'device_([0-9]+)_gid_', 1) AS BIGINT) AS device, regexp_extract(key, 'device_[0-9]+_gid_([A-Za-z0-9_.-]*)', 1) AS rendezvous, len(items) AS items, CAST(list_sum(list_transform(items, lambda x: CAST(split_part(x, ':', 2) AS BIGINT))) AS BIGINT) AS bytes
  FROM (SELECT id, key, regexp_extract_all(sizes, '\\([0-9]+,[0-9]+\\):[0-9]+') AS items FROM (SELECT p_partkey AS id, {_KEY} AS key, {_SIZES} AS sizes FROM part))""",
)
def keys_of_texts(t):
    key, sizes = c.graph_key(F.expr(_KEY)), c.buffer_sizes(F.expr(_SIZES))
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x["size"])
    return t.table("part").select(F.col("p_partkey").alias("id"), key["device"].alias("device"), key["rendezvous"].alias("rendezvous"), F.size(sizes).cast("bigint").alias("items"), total.alias("bytes"))


@query(
    "x17_training_texts",
    """SELECT id, k, CASE WHEN regexp_full_match(kind, '[A-Z_][A-Za-z0-9_]*') AND regexp_full_match(name, '[A-Za-z0-9.][A-Za-z0-9_.\\\\/>-]*') THEN regexp_matches(name, '(^|/)gradient(_tape/|s[^/]*/)')
  ELSE (kind = '' OR (name <> '' AND regexp_full_match(kind, '[a-z_][a-z0-9_.-]*(\\[.*\\])?') AND contains(string_split(name, '/')[-1], kind))) AND regexp_matches(name, '(^|/)transpose\\(') END AS training FROM cut""",
    TEXTS,
)
def training_texts(t):
    return texts(t).select("id", "k", c.is_training_op(F.substring_index("text", ":", 1), F.when(F.col("text").contains(":"), F.expr("substr(text, instr(text, ':') + 1)")).otherwise("")).alias("training"))


_OPCODES = ("fusion", "convolution", "transpose", "dynamic-reshape", "tanh", "shift-left", "all-reduce", "while", "copy")


@query(
    "x22_op_categories",
    f"""SELECT id, o.opcode, CASE WHEN o.opcode = 'fusion' THEN coalesce(map {{'kLoop': 'loop fusion', 'kInput': 'input fusion', 'kOutput': 'output fusion'}}[f], 'custom fusion') WHEN o.opcode = 'convolution' THEN concat('convolution', CASE WHEN b THEN ' base-dilated' ELSE '' END, CASE WHEN w THEN ' window-dilated' ELSE '' END)
  WHEN o.opcode IN ('transpose', 'copy', 'reshape', 'dynamic-reshape') THEN 'data formatting' WHEN o.opcode IN ('tanh', 'shift-left') THEN 'non-fusion elementwise' ELSE o.opcode END AS category
  FROM (SELECT p_partkey AS id, CASE WHEN p_type LIKE 'S%' THEN 'kLoop' WHEN p_type LIKE 'M%' THEN 'kInput' WHEN p_type LIKE 'L%' THEN 'kOutput' ELSE p_type END AS f, p_size > 25 AS b, p_name LIKE '%e%' AS w FROM part), (VALUES {", ".join(f"('{x}')" for x in _OPCODES)}) o(opcode)""",
)
def op_categories(t):
    part = t.table("part")
    kind = F.expr("CASE WHEN p_type LIKE 'S%' THEN 'kLoop' WHEN p_type LIKE 'M%' THEN 'kInput' WHEN p_type LIKE 'L%' THEN 'kOutput' ELSE p_type END")
    rows = part.select(F.col("p_partkey").alias("id"), kind.alias("f"), (F.col("p_size") > 25).alias("b"), F.col("p_name").contains("e").alias("w"), F.explode(F.array(*map(F.lit, _OPCODES))).alias("opcode"))
    return rows.select("id", "opcode", c.op_category(F.col("opcode"), F.col("f"), F.col("b"), F.col("w")).alias("category"))


@query(
    "x23_kinds_of_texts",
    """SELECT id, k, CASE WHEN type LIKE 'InfeedEnqueue%' OR NOT colon AND type = 'MemcpyHToD' THEN 'host_to_device' WHEN NOT colon AND type = 'MemcpyHToH' THEN 'host_to_host' WHEN lower(text) LIKE 'iteratorgetnext%' THEN 'host_wait_input' ELSE 'host_compute' END AS host,
  CASE WHEN NOT colon AND type = 'MemcpyHToD' THEN 'host_to_device' WHEN NOT colon AND type = 'MemcpyDToH' THEN 'device_to_host' WHEN NOT colon AND type = 'MemcpyDToD' THEN 'device_to_device' WHEN lower(text) LIKE 'nccl%' THEN 'device_collectives'
  WHEN regexp_matches(text, 'half|fp16') THEN 'device_compute_16' ELSE 'device_compute_32' END AS device FROM ops1""",
    TEXTS,
)
def kinds_of_texts(t):
    text = F.col("text")
    return texts(t).select("id", "k", c.host_event_kind(text).alias("host"), c.device_event_kind(text, F.lit("")).alias("device"))


@query(
    "x24_input_texts",
    """SELECT id, k, CASE WHEN type LIKE 'InfeedEnqueue%' OR type = 'MemcpyHToD' THEN 'Enqueue' WHEN regexp_matches(text, '::(MemoryReader|MemoryWriter|Interleave|Prefetch|ParallelMap)') THEN 'Advanced file read' WHEN text LIKE 'Iterator::%' AND regexp_matches(text, 'Record|TextLine|FixedLength') THEN 'Demanded file read'
  WHEN text LIKE 'Iterator::%' THEN 'Preprocessing' ELSE 'Unknown' END AS kind FROM ops1""",
    TEXTS,
)
def input_texts(t):
    return texts(t).select("id", "k", c.input_category(F.col("text"), c.parse_op(F.col("text"))["type"]).alias("kind"))


_LONG = "concat(p_name, CASE WHEN p_size < 20 THEN '.remat' ELSE '' END, ' = ', CASE WHEN p_type LIKE '%TIN' THEN 'send-done' ELSE p_type END, '(), is_host_transfer=', CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE '.remat' END)"
_FROM = "concat(p_type, CASE WHEN p_type LIKE '%STEEL' THEN '/rematted_computation' ELSE '' END, CASE WHEN p_type LIKE 'S%' THEN ':XlaSendToHost' WHEN p_type LIKE 'M%' THEN ':XlaRecvFromHost' WHEN p_type LIKE 'E%' THEN ':XlaRecvFromHost/x' ELSE '' END)"


@query(
    "x28_flags_of_texts",
    f"""SELECT id, CASE WHEN contains(split_part(l, '=', 1), '.remat') OR contains(f, 'rematted_computation') THEN 'Yes' ELSE 'No' END AS remat, CASE WHEN f LIKE '%:XlaSendToHost' OR f LIKE '%:XlaRecvFromHost' OR (l LIKE '%send-done%' AND l LIKE '%is_host_transfer=true%') THEN 'Yes' ELSE 'No' END AS outside
  FROM (SELECT p_partkey AS id, {_LONG} AS l, {_FROM} AS f FROM part)""",
)
def flags_of_texts(t):
    return t.table("part").select(F.col("p_partkey").alias("id"), c.is_rematerialized(F.expr(_LONG), F.expr(_FROM)).alias("remat"), c.is_outside_compilation(F.expr(_LONG), F.expr(_FROM)).alias("outside"))
