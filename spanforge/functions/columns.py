"""Scalar functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names and codes of the trace format
DATA_TYPES = (
    "INVALID float double int32 uint8 int16 int8 string complex64 int64 bool qint8 quint8 qint32 bfloat16 qint16 quint16 uint16 "
    "complex128 half resource variant uint32 uint64 float8_e5m2 float8_e4m3fn float8_e4m3fnuz float8_e4m3b11fnuz float8_e5m2fnuz int4 uint4"
).split()
MEMCPY = ("MemcpyHToD", "MemcpyDToH", "MemcpyDToD", "MemcpyHToH")
TENSOR_CORE_SUFFIXES = (
    "Conv2D Conv2DBackpropFilter Conv2DBackpropInput Conv3D DepthwiseConv2dNative DepthwiseConv2dNativeBackpropFilter "
    "DepthwiseConv2dNativeBackpropInput /MatMul FusedMatMul /CudnnRNN XlaDot XlaDotV2"
).split()
TENSOR_CORE_INFIXES = "BatchMatMul CudnnRNNV CudnnRNNForward CudnnRNNBackprop".split()
TENSOR_CORE_KERNELS = (
    "16816 c1688 conv1x1 conv2d_c1_k1 dgrad_1x1_stride_2x2 direct_group first_layer_wgrad_kernel h1688 h884 hmma i16832 i8816 s884 s1688 "
    "xmma_gemm xmma_implicit_gemm xmma_sparse_conv xmma_sparse_gemm xmma_warp_specialized_implicit_gemm"
).split()
ICI_PATTERNS = ("all-reduce", "all-gather", "all-to-all", "reduce-scatter", "collective-broadcast", "collective-permute")
HBM_PATTERNS = ("copy-start", "copy", "copy-done")
ADVANCED_READERS = ("::MemoryReader", "::MemoryWriter", "::Interleave", "::Prefetch", "::ParallelMap")
ELEMENTWISE = (
    "abs acos acosh asin asinh atanh round-nearest-afz round-nearest-even ceil count-leading-zeros convert bitcast-convert copy cosine cosh "
    "erf exponential exponential-minus-one floor imag is-finite log log-plus-one not negate popcnt real reduce-precision rsqrt logistic "
    "sign sine sinh sqrt cbrt tan tanh add atan2 compare complex divide maximum minimum multiply mulhi power remainder subtract and or xor "
    "shift-left shift-right-arithmetic shift-right-logical stochastic-convert select clamp constant rng"
).split()
_TF_NAME, _TF_TYPE, _JAX_TYPE = r"^[A-Za-z0-9.][A-Za-z0-9_.\\/>-]*$", r"^[A-Z_][A-Za-z0-9_]*$", r"^[a-z_][a-z0-9_.-]*(\[.*\])?$"


def safe_divide(a: Column, b: Column) -> Column:
    """A / b, 0 where |b| < 1e-10."""
    return F.when(F.abs(b) < 1e-10, F.lit(0.0)).otherwise(a / b)


def parse_op(full: Column) -> Column:
    """struct(category, name, type) of a text ``name:Type``."""
    at = F.instr(full, ":")
    name, kind = F.substring_index(full, ":", 1), F.regexp_extract(full, r"^[^:]*:([\s\S]*)$", 1)
    last = F.element_at(F.split(name, "/"), -1)
    derived = F.when(kind == "", F.regexp_replace(last, r"(?<=.)_\s*[-+]?\d+\s*$", "")).otherwise(kind)

    def made(category, n, t):
        return F.struct(F.lit(category).alias("category"), n.alias("name"), t.alias("type"))

    plain = made("Unknown", full, F.lit(""))
    for m in reversed(MEMCPY):
        plain = F.when(F.lower(full).startswith(m.lower()), made("Memcpy", full, F.lit(m))).otherwise(plain)
    return (
        F.when(at == 0, plain)
        .when(name == "Iterator", made("TfData", full, F.lit("Dataset")))
        .when(name.rlike(_TF_NAME) & kind.rlike(_TF_TYPE), made("TensorFlow", name, kind))
        .when(derived.rlike(_JAX_TYPE), made("Jax", name, F.regexp_replace(derived, r"\[[\s\S]*$", "")))
        .when(kind == "", made("TensorFlow", name, derived))
        .otherwise(made("Unknown", full, F.lit("")))
    )


def event_name(op: Column) -> Column:
    """The display name of a parsed op."""
    return (
        F.when(op["category"] == "Unknown", F.regexp_replace(op["name"], r"\s+$", ""))
        .when(op["category"] == "TfData", F.concat(F.lit("Iterator::"), F.element_at(F.split(op["name"], "::"), -1)))
        .otherwise(op["type"])
    )


def scopes(op: Column) -> Column:
    """The path of a parsed op without the op itself."""
    parts = F.split(op["name"], "/")
    return F.when(op["category"].isin("TensorFlow", "Jax"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(F.array().cast("array<string>"))


def hlo_op_name(expression: Column) -> Column:
    """The text before ' = ', without '%'."""
    return F.regexp_replace(F.substring_index(expression, " = ", 1), "^%", "")


def canonical_kernel(name: Column) -> Column:
    """The first token before a colon."""
    return F.substring_index(F.element_at(F.split(F.trim(name), r"\s+"), 1), ":", 1)


def pico_to(unit: str, c: Column) -> Column:
    """Picoseconds to ns, us, ms or s."""
    return c / F.lit({"ns": 1e3, "us": 1e6, "ms": 1e9, "s": 1e12}[unit])


def giga_to_gibi(c: Column) -> Column:
    return c * F.lit(1e9 / 2**30)


def mebibytes(c: Column) -> Column:
    return c / F.lit(float(2**20))


def launch_params(text: Column) -> Column:
    """struct(grid, block, regs, occupancy) of 'grid:x,y,z block:x,y,z regs:n occ_pct:p'."""
    found = F.str_to_map(text, F.lit(" "), F.lit(":"))

    def three(name):
        return F.transform(F.split(F.try_element_at(found, F.lit(name)), ","), lambda x: x.try_cast("bigint"))

    return F.struct(
        three("grid").alias("grid"), three("block").alias("block"), F.try_element_at(found, F.lit("regs")).try_cast("bigint").alias("regs"),
        F.try_element_at(found, F.lit("occ_pct")).try_cast("double").alias("occupancy"),
    )


def tensor_core_eligible(op: Column, equation: Column) -> Column:
    """By the op's name, or a two-operand einsum equation."""
    by_name = op.rlike("(" + "|".join(TENSOR_CORE_SUFFIXES) + ")$") | op.rlike("|".join(TENSOR_CORE_INFIXES))
    sides = F.split(equation, "->")
    return by_name | ((equation != "") & (F.size(sides) == 2) & (F.size(F.split(sides[0], ",")) == 2))


def tensor_core_kernel(kernel: Column) -> Column:
    return kernel.rlike("|".join(TENSOR_CORE_KERNELS))


def human_bytes(n: Column) -> Column:
    """X11: 512B, 1.2K, 3.00M; ties to even."""
    k, m, g = F.lit(1024.0), F.lit(1024.0**2), F.lit(1024.0**3)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
        .when(n < 1024**2, F.concat(F.format_string("%.1f", F.bround(n / k, 1)), F.lit("K")))
        .when(n < 1024**3, F.concat(F.format_string("%.2f", F.bround(n / m, 2)), F.lit("M")))
        .otherwise(F.concat(F.format_string("%.2f", F.bround(n / g, 2)), F.lit("G")))
    )


def transmitted_bytes(size: Column, group: Column, kind: Column) -> Column:
    """Network bytes of a collective over group members."""
    share = (group - 1) / group
    whole = (
        F.when(kind == "ONE_TO_ONE", (group * size).cast("double"))
        .when(kind == "ALL_GATHER", ((group - 1) * size) / group)
        .when(kind == "ALL_REDUCE", 2 * share * size)
        .when(kind == "ALL_TO_ALL", share * size)
        .when(kind == "REDUCE_SCATTER", (size * (group - 1)).cast("double"))
        .otherwise(F.lit(0.0))
    )
    return F.when(group == 0, F.lit(0)).otherwise(F.floor(whole)).cast("bigint")


def graph_key(key: Column) -> Column:
    """struct(device, rendezvous) of a key 'device_<n>_gid_<name>'."""
    return F.struct(
        F.regexp_extract(key, r"device_(\d+)_gid_", 1).try_cast("bigint").alias("device"),
        F.regexp_extract(key, r"device_\d+_gid_([A-Za-z0-9_.-]*)", 1).alias("rendezvous"),
    )


def buffer_sizes(text: Column) -> Column:
    """Array of struct(src, dst, size) of '(src,dst):size' items."""
    item = r"\((\d+),(\d+)\):(\d+)"
    return F.transform(
        F.arrays_zip(*(F.regexp_extract_all(text, F.lit(item), F.lit(k)).alias(n) for k, n in ((1, "src"), (2, "dst"), (3, "size")))),
        lambda x: F.struct(*(x[n].cast("bigint").alias(n) for n in ("src", "dst", "size"))),
    )


def dtype_name(n: Column) -> Column:
    """The name of a type code; codes above 100 are references."""
    names = F.array(*(F.lit(x) for x in DATA_TYPES))

    def name(v):
        found = F.when(v.between(0, len(DATA_TYPES) - 1), F.get(names, v.cast("int")))
        return F.coalesce(found, F.concat(F.lit("unknown dtype enum ("), v.cast("string"), F.lit(")")))

    return F.when(n > 100, F.concat(name(n - 100), F.lit("_ref"))).otherwise(name(n))


def kernel_metadata(expression: Column, path: str) -> Column:
    """A value of the JSON object embedded in an expression text."""
    return F.get_json_object(F.regexp_extract(expression, r"(\{[\s\S]*\})", 1), path)


def round_n(c: Column, digits: int) -> Column:
    return F.round(c, digits)


def percent_text(c: Column) -> Column:
    """X16: '12.3%'."""
    return F.concat(F.format_string("%.1f", F.round(c, 1)), F.lit("%"))


def is_training_op(name: Column, kind: Column) -> Column:
    """Gradient scopes of framework ops, transposed scopes of functional ops."""
    parts = F.split(name, "/")
    outer = F.slice(parts, 1, F.size(parts) - 1)
    gradient = F.exists(outer, lambda s: s.rlike("^gradient(_tape$|s)"))
    last = F.element_at(parts, -1)
    transposed = ((kind == "") | ((name != "") & kind.rlike(_JAX_TYPE) & last.contains(kind))) & F.exists(parts, lambda s: s.startswith("transpose("))
    return F.when(kind.rlike(_TF_TYPE) & name.rlike(_TF_NAME), gradient).otherwise(transposed)


def link_id(kind: Column, *parts: Column) -> Column:
    """One 64-bit key of a link."""
    return F.xxhash64(kind, *parts)


def strip_html(cell: Column) -> Column:
    """The text of a source cell."""
    text = F.regexp_replace(cell, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def source_text(file: Column, line: Column) -> Column:
    """X19: 'file:line', empty without a file or with line -1."""
    return F.when((file == "") | (line == -1), F.lit("")).otherwise(F.concat_ws(":", file, line.cast("string")))


def numbered_base(name: Column) -> Column:
    """Name.12 -> name.*"""
    return F.regexp_replace(name, r"\.\d+$", ".*")


def time_class(name: Column, category: Column) -> Column:
    """ICI, HBM or compute by substrings of name and category."""

    def has(patterns):
        pattern = "|".join(patterns)
        return F.lower(name).rlike(pattern) | F.lower(category).rlike(pattern)

    return F.when(has(ICI_PATTERNS), "ICI").when(has(HBM_PATTERNS), "HBM").otherwise("compute")


def op_category(opcode: Column, fusion_kind: Column, base_dilated: Column, window_dilated: Column) -> Column:
    """The category of an op from its opcode."""
    fusion = F.when(fusion_kind == "kLoop", "loop fusion").when(fusion_kind == "kInput", "input fusion").when(fusion_kind == "kOutput", "output fusion").otherwise("custom fusion")
    convolution = F.concat(F.lit("convolution"), F.when(base_dilated, " base-dilated").otherwise(""), F.when(window_dilated, " window-dilated").otherwise(""))
    return (
        F.when(opcode == "fusion", fusion)
        .when(opcode == "convolution", convolution)
        .when(opcode.isin("transpose", "copy", "reshape", "dynamic-reshape"), "data formatting")
        .when(opcode.isin(*ELEMENTWISE), "non-fusion elementwise")
        .otherwise(opcode)
    )


def host_event_kind(name: Column) -> Column:
    """The kind of time a host event stands for."""
    kind = parse_op(name)["type"]
    bare = ~name.contains(":")
    return (
        F.when(kind.startswith("InfeedEnqueue") | (bare & (kind == "MemcpyHToD")), "host_to_device")
        .when(bare & (kind == "MemcpyHToH"), "host_to_host")
        .when(F.lower(name).startswith("iteratorgetnext"), "host_wait_input")
        .otherwise("host_compute")
    )


def device_event_kind(name: Column, shape: Column) -> Column:
    """The kind of time a device event stands for."""
    kind, bare = parse_op(name)["type"], ~name.contains(":")
    half = ((shape == "") & name.rlike("half|fp16")) | shape.contains("half")
    return (
        F.when(bare & (kind == "MemcpyHToD"), "host_to_device")
        .when(bare & (kind == "MemcpyDToH"), "device_to_host")
        .when(bare & (kind == "MemcpyDToD"), "device_to_device")
        .when(F.lower(name).startswith("nccl"), "device_collectives")
        .when(half, "device_compute_16")
        .otherwise("device_compute_32")
    )


def input_category(name: Column, kind: Column) -> Column:
    """Where an input-pipeline op spends its time."""
    advanced = name.rlike("|".join(ADVANCED_READERS))
    return (
        F.when(kind.startswith("InfeedEnqueue") | (kind == "MemcpyHToD"), "Enqueue")
        .when(advanced, "Advanced file read")
        .when(name.startswith("Iterator::") & name.rlike("Record|TextLine|FixedLength"), "Demanded file read")
        .when(name.startswith("Iterator::"), "Preprocessing")
        .otherwise("Unknown")
    )


def parse_number(text: Column, kind: str = "double", default=0) -> Column:
    """Text to number; blank, None and nan give the default."""
    clean = F.trim(text)
    return F.coalesce(F.when(~F.lower(clean).isin("", "none", "nan"), clean.try_cast(kind)), F.lit(default).cast(kind))


def memory_sum(memory: Column, operation: int | None, space: int) -> Column:
    """Bytes of a memory breakdown array for one space (and operation)."""
    mine = F.filter(memory, lambda m: (m["space"] == space) & (F.lit(True) if operation is None else m["op"] == operation))
    return F.aggregate(mine, F.lit(0).cast("bigint"), lambda a, m: a + m["bytes"])


def step_bottleneck(parts: dict[str, Column]) -> Column:
    """The name of the largest part; ties go to the greater name."""
    return F.array_max(F.array(*(F.struct(c.alias("v"), F.lit(n).alias("n")) for n, c in parts.items())))["n"]


def input_bound_class(input_percent: Column, other_percent: Column) -> Column:
    """How input-bound a program is."""
    return F.when(input_percent >= 20, "highly").when(input_percent >= 5, "moderately").when(other_percent >= 3, "other").otherwise("not")


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")


def is_rematerialized(long_name: Column, provenance: Column) -> Column:
    """X28."""
    return yes_no(F.substring_index(long_name, "=", 1).contains(".remat") | provenance.contains("rematted_computation"))


def is_outside_compilation(long_name: Column, provenance: Column) -> Column:
    """X28."""
    return yes_no(
        provenance.rlike(":Xla(SendToHost|RecvFromHost)$") | (long_name.contains("send-done") & long_name.contains("is_host_transfer=true"))
    )
