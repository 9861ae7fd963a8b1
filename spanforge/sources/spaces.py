"""Trace files with all they hold: planes, lines, event dictionary and spans, each with typed stats.

A stat is a name and one value: an integer, a number, a text, bytes, or a reference to an entry of the plane's
dictionary, which is a text written once. ``decode_tables`` reads every file once, in one task, into rows of one tagged
table (``kind`` tells of what); the four tables are filters of it. A file's rows are kept as compressed Arrow batches until
its end is reached, so that a broken file leaves nothing but its reason.

``encode_spaces`` is the way back: spans with stats as the contents of trace files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators.filters import stat
from spanforge.operators.ranks import ranked
from spanforge.sources.traces import _PATH, MAX_BYTES, _fields, _text

#: The value of a stat: one of the four is set.
VALUE = "struct<int: bigint, real: double, text: string, raw: binary>"
TAGGED = (
    "session string, host string, kind string, plane_id bigint, plane string, line_id bigint, line string, seq bigint, meta_id bigint, name string, "
    f"display string, begin bigint, dur bigint, occurrences bigint, stats map<string, {VALUE}>, error string"
)
#: The columns of each table.
TABLES = {
    "planes": ("plane", ["session", "host", "plane_id", "plane", "stats"]),
    "lines": ("line", ["session", "host", "plane_id", "plane", "line_id", "line", "display", "begin", "dur"]),
    "event_meta": ("event_meta", ["session", "host", "plane_id", "meta_id", "name", "display", "stats"]),
    "spans": ("span", ["session", "host", "plane_id", "plane", "line_id", "line", "seq", "meta_id", "name", "begin", "dur", "occurrences", "stats"]),
    "rejected": ("rejected", ["session", "host", "error"]),
}
#: Times since 1970 in ns above this are of a clock; a file's spans then count from its first line.
_EPOCH_NS = 10**15
_VALUE = pa.struct([("int", pa.int64()), ("real", pa.float64()), ("text", pa.string()), ("raw", pa.binary())])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _stats(bodies: list, names: dict[int, str]) -> list[tuple[str, tuple]]:
    """(name, value) of each stat; the first of a name counts, one without a known name or a value drops out."""
    found = {}
    for body in bodies:
        name, value = None, None
        for number, x in _fields(body):
            if number == 1:
                name = names.get(x)
            elif number == 2:
                value = (None, struct.unpack("<d", x.to_bytes(8, "little"))[0], None, None)
            elif number in (3, 4):
                value = (_signed(x), None, None, None)
            elif number == 5:
                value = (None, None, _text(x), None)
            elif number == 6:
                value = (None, None, None, bytes(x))
            elif number == 7:
                value = (None, None, names.get(x, ""), None)
        if name and value:
            found.setdefault(name, value)
    return list(found.items())


def _packed(batch: pa.RecordBatch) -> pa.Buffer:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def _unpacked(buffer: pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(buffer).read_next_batch()


class _Rows:
    """Tagged rows as Arrow batches, compressed until they are asked for."""

    def __init__(self, session: str, host: str, size: int = 2_000):
        self.origin, self.size, self.rows, self.batches = (session, host), size, [], []
        names = [c.split()[0] for c in TAGGED.replace(f"map<string, {VALUE}>", "map").split(", ")]
        kinds = {"session": 1, "host": 1, "kind": 1, "plane": 1, "line": 1, "name": 1, "display": 1, "error": 1}
        self.schema = pa.schema([(n, pa.map_(pa.string(), _VALUE) if n == "stats" else pa.string() if n in kinds else pa.int64()) for n in names])

    def add(self, kind, plane_id=None, plane=None, line_id=None, line=None, seq=None, meta_id=None, name=None, display=None, begin=None, dur=None, occurrences=None, stats=None, error=None):
        self.rows.append((*self.origin, kind, plane_id, plane, line_id, line, seq, meta_id, name, display, begin, dur, occurrences, stats, error))
        if len(self.rows) == self.size:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            columns = list(zip(*self.rows))
            batch = pa.RecordBatch.from_arrays([pa.array([_named(s) for s in c] if f.name == "stats" else c, f.type) for f, c in zip(self.schema, columns)], schema=self.schema)
            self.batches.append(_packed(batch))
            self.rows = []

    def all(self) -> Iterator[pa.RecordBatch]:
        self.flush()
        for batch in self.batches:
            yield _unpacked(batch)


def _named(stats):
    return None if stats is None else [(k, dict(zip(("int", "real", "text", "raw"), v))) for k, v in stats]


def _read(content, rows: _Rows) -> None:
    planes = [x for number, x in _fields(memoryview(content).cast("B")) if number == 1]
    parts = [[(n, x) for n, x in _fields(plane)] for plane in planes]
    bodies_of = [[x for n, x in plane if n == 3] for plane in parts]
    times = [next((x for n, x in _fields(line) if n == 3), 0) for lines in bodies_of for line in lines]
    earliest = min((t for t in times if 0 < t < 1 << 63), default=0)
    origin = earliest if earliest > _EPOCH_NS else 0
    for k, (plane, lines) in enumerate(zip(parts, bodies_of)):
        own = dict((n, x) for n, x in plane if n in (1, 2))
        plane_id, label = _signed(own.get(1, k)), _text(own.get(2, b""))
        names = {}
        for number, entry in plane:
            if number == 5:
                entry = dict(_fields(entry))
                inner = dict(_fields(entry.get(2, b"")))
                names[entry.get(1, inner.get(1, 0))] = _text(inner.get(2, b""))
        rows.add("plane", plane_id, label, stats=_stats([x for n, x in plane if n == 6], names))
        metas = {}
        for number, entry in plane:
            if number == 4:
                entry = dict(_fields(entry))
                inner = list(_fields(entry.get(2, b"")))
                one = dict((n, x) for n, x in inner if n in (1, 2, 4))
                meta_id, name, display = entry.get(1, one.get(1, 0)), _text(one.get(2, b"")), _text(one.get(4, b""))
                metas[meta_id] = display or name
                rows.add("event_meta", plane_id, label, meta_id=_signed(meta_id), name=name, display=display, stats=_stats([x for n, x in inner if n == 5], names))
        for line in lines:
            head = dict((n, x) for n, x in _fields(line) if n != 4)
            line_id, title, shown = _signed(head.get(1, 0)), _text(head.get(2, b"")), _text(head.get(11, b""))
            start = max(0, _signed(head.get(3, 0)) - origin) * 1000
            rows.add("line", plane_id, label, line_id, title, display=shown, begin=start, dur=_signed(head.get(9, 0)))
            seq = 0
            for number, event in _fields(line):
                if number == 4:
                    f, bodies = {}, []
                    for n, x in _fields(event):
                        if n == 4:
                            bodies.append(x)
                        else:
                            f[n] = x
                    meta_id = f.get(1, 0)
                    rows.add("span", plane_id, label, line_id, shown or title, seq, _signed(meta_id), metas.get(meta_id, ""), None, start + _signed(f.get(2, 0)), _signed(f.get(3, 0)), f.get(5, 1), _stats(bodies, names))
                    seq += 1


def decode_tables(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """S3: the tagged rows of files(path, length, content) or files(session, host, length, content). A file that cannot be decoded
    to its end, or is larger than limit (which its content is not read for), gives one row of kind ``rejected``."""
    if "path" in files.columns:
        files = files.withColumns({n: F.regexp_extract("path", _PATH, k) for k, n in ((1, "session"), (2, "host"))})
    rows = files.where(F.col("length") <= limit).select("session", "host", "content")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                session, host = (batch.column(c)[k].as_py() for c in ("session", "host"))
                rows = _Rows(session, host)
                try:
                    _read(batch.column("content")[k].as_buffer() or b"", rows)
                except (ValueError, IndexError, TypeError, AttributeError, OverflowError) as reason:
                    rows = _Rows(session, host)
                    rows.add("rejected", error=str(reason) or type(reason).__name__)
                yield from rows.all()

    large = files.where(F.col("length") > limit).select("session", "host", F.lit("rejected").alias("kind"), F.lit("file is too large").alias("error"))
    return rows.mapInArrow(run, TAGGED).unionByName(large, allowMissingColumns=True)


def tables(tagged: DataFrame) -> dict[str, DataFrame]:
    """S3: planes, lines, event_meta, spans and rejected of tagged rows."""
    return {name: tagged.where(F.col("kind") == kind).select(*columns) for name, (kind, columns) in TABLES.items()}


def convert_spaces(spark: SparkSession, root: str, out: str, limit: int = MAX_BYTES) -> None:
    """S3: the bulk conversion of all trace files below root: one pass over them, written in folders by kind, session and
    host, spans in the order of tracks and time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xplane.pb").load(root)
    write_tagged(decode_tables(files, limit), out)


def write_tagged(tagged: DataFrame, out: str, mode: str = "overwrite") -> None:
    order = ["kind", "session", "host", "plane_id", "line_id", "begin", F.col("dur").desc(), "seq"]
    tagged.repartition("kind", "session", "host", "plane_id").sortWithinPartitions(*order).write.mode(mode).partitionBy("kind", "session", "host").parquet(out)


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that convert_spaces wrote; a filter by session and host reads their folders only."""
    return tables(spark.read.schema(TAGGED).parquet(path))


# --- stats ------------------------------------------------------------------------------------


def with_stats(spans: DataFrame, event_meta: DataFrame) -> DataFrame:
    """Spans with the stats of their dictionary entry, as meta_stats."""
    keys = ["session", "host", "plane_id", "meta_id"]
    return spans.join(event_meta.select(*keys, F.col("stats").alias("meta_stats")), keys, "left")


def stat_int(name: str) -> Column:
    """the integer of a stat (of the event, else of its entry), null if it is none."""
    return stat(name)["int"]


def stat_text(name: str) -> Column:
    """a stat as text, whatever its type."""
    x = stat(name)
    return F.coalesce(x["text"], x["int"].cast("string"), x["real"].cast("string"), F.hex(x["raw"]))


#: Names of events whose stats connect them, by context: producer, consumers, the stats of the key (fixed values).
CONNECTIONS = (
    (
        11, ("EnqueueRequestLocked",),
        (
            "RunProgramRequest", "HostCallbackRequest", "TransferH2DRequest", "TransferPreprocessedH2DRequest", "TransferD2HRequest",
            "OnDeviceSendRequest", "OnDeviceRecvRequest", "OnDeviceSendRecvLocalRequest", "CustomWait", "OnDeviceSendRequestMulti",
            "OnDeviceRecvRequestMulti", "PjrtAsyncWait",
        ),
        ("request_id", "queue_addr"),
    ),
    (12, ("DoEnqueueProgram",), ("CompleteCallbacks",), ("device_ordinal", "queue_id", "run_id", "core_type")),
    (1, ("ExecutorState::Process",), ("TpuExecuteOp",), ("id", "iter_num")),
)
LAUNCH_CONTEXT, RUN_ID_BITS = 12, 27


def flow_links(spans: DataFrame, span: Column) -> DataFrame:
    """Input of J4 from spans with stats: links(role, kind, ctx_id, pid, span). A span is producer or consumer by its own stats
    (_pt and _p, _ct and _c), or by its name and the stats that key the context; the latter take precedence. The process is that of the
    stat _pid; links of program launches have none, as they connect processes. Contexts hold within a file (session, host)."""
    at = {x: stat_int(x) for x in ("_p", "_pt", "_c", "_ct", "_pid")}
    role = {"producer": F.struct(at["_pt"].alias("kind"), at["_p"].alias("ctx_id")), "consumer": F.struct(at["_ct"].alias("kind"), at["_c"].alias("ctx_id"))}
    for kind, producers, consumers, keys in CONNECTIONS:
        parts = []
        for k in keys:
            x = stat_int(k)
            x = F.coalesce(x, F.lit(0)) if k == "core_type" else x
            parts.append(x.bitwiseAND((1 << RUN_ID_BITS) - 1) if k == "run_id" and kind == LAUNCH_CONTEXT else x)
        there = F.forall(F.array(*parts), F.isnotnull)
        key = F.struct(F.lit(kind).cast("bigint").alias("kind"), F.xxhash64(F.lit(kind), *parts).alias("ctx_id"))
        for side, names in (("producer", producers), ("consumer", consumers)):
            role[side] = F.when(F.col("name").isin(*names) & there, key).otherwise(role[side])
    links = F.array(*(F.struct(F.lit(side).alias("role"), x["kind"].alias("kind"), x["ctx_id"].alias("ctx_id")) for side, x in role.items()))
    out = spans.select("session", "host", span.alias("span"), at["_pid"].alias("pid"), F.explode(links).alias("link")).where("link.kind is not null and link.ctx_id is not null")
    pid = F.when(F.col("link.kind") != LAUNCH_CONTEXT, F.coalesce("pid", F.lit(-1))).otherwise(-2)
    return out.select("link.role", "link.kind", F.xxhash64("session", "host", "link.ctx_id").alias("ctx_id"), pid.alias("pid"), "span")


def launches(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Input of J5: spans with a correlation id (made unique for the file), those of host planes (launches) and of devices (executes)."""
    correlated = spans.where(stat_int("correlation_id").isNotNull()).withColumn("correlation_id", F.xxhash64("session", "host", stat_int("correlation_id")))
    host = F.col("plane").startswith("/host:")
    return correlated.where(host), correlated.where(~host)


#: Tools that every trace has, and those that depend on what it holds, in order (fixed values).
BASE_TOOLS = ("trace_viewer@", "overview_page", "input_pipeline_analyzer", "framework_op_stats", "memory_profile", "op_profile", "hlo_stats", "roofline_model")
FOUND_TOOLS = (("kernel_stats",), ("memory_viewer", "graph_viewer"), ("megascale_stats",), ("perf_counters", "utilization_viewer", "kernel_utilization"))


def tools_of(found: dict[str, DataFrame]) -> DataFrame:
    """S6 of decoded files: (session, host, tool, place): those of every trace; kernels of GPU planes; programs that the metadata plane carries;
    transfers between slices among the names of the host plane; counters, if an event of a device plane has a counter's value."""
    keys = ["session", "host"]
    planes, meta, spans = found["planes"], found["event_meta"], found["spans"]
    named = meta.join(planes.select(*keys, "plane_id", "plane"), [*keys, "plane_id"])
    flag = lambda df, condition, k: df.where(condition).select(*keys, F.lit(k).alias("k")).distinct()
    has = lambda stat_name: F.map_contains_key(F.coalesce("stats", F.create_map().cast(f"map<string, {VALUE}>")), F.lit(stat_name))
    parts = [
        flag(planes, F.col("plane").startswith("/device:GPU:"), 0), flag(named, (F.col("plane") == "/host:metadata") & has("Hlo Proto"), 1),
        flag(named, (F.col("plane") == "/host:CPU") & F.col("name").startswith("MegaScale:"), 2), flag(spans, F.col("plane").startswith("/device:TPU:") & has("counter_value"), 3),
    ]
    there = planes.select(*keys, F.lit(-1).alias("k")).distinct()
    for part in parts:
        there = there.unionByName(part)
    tools = F.when(F.col("k") == -1, F.array(*map(F.lit, BASE_TOOLS)))
    for k, names in enumerate(FOUND_TOOLS):
        tools = tools.when(F.col("k") == k, F.array(*map(F.lit, names)))
    out = there.select(*keys, "k", F.posexplode(tools).alias("at", "tool"))
    return out.select(*keys, "tool", (100 * (F.col("k") + 1) + F.col("at")).alias("place"))


#: Stats whose long texts are frames, texts above which they are, and where a display cuts them (fixed values).
FRAME_STATS, FRAME_LENGTH, TEXT_LIMIT = ("long_name", "hlo_text"), 16, 10_000


def _frame_texts(spans: DataFrame, longer: int, limit: int | None) -> DataFrame:
    text = lambda name: stat(name)["text"]
    cut = lambda x: x if limit is None else F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("...<truncated>"))).otherwise(x)
    long = F.filter(F.array(*(cut(text(name)) for name in FRAME_STATS)), lambda x: F.length(x) > longer)
    return spans.withColumn("_frame", F.get(long, F.lit(0)))


def frame_table(spans: DataFrame, longer: int = FRAME_LENGTH, limit: int | None = TEXT_LIMIT) -> DataFrame:
    """(frame, fingerprint, text): the long texts of spans with stats, each once, in the order of their fingerprints from 1;
    those above limit are cut there, as a display shows them, and without a limit none is."""
    texts = _frame_texts(spans, longer, limit).where("_frame is not null").select(F.xxhash64("_frame").alias("fingerprint"), F.col("_frame").alias("text")).distinct()
    return ranked(texts, ["fingerprint", "text"]).select((F.col("rank") + 1).alias("frame"), "fingerprint", "text")


def with_frame(spans: DataFrame, frames: DataFrame, longer: int = FRAME_LENGTH, limit: int | None = TEXT_LIMIT) -> DataFrame:
    """Spans with the number of the frame recorded for them (null if none): its text is that of frame_table with the same limit."""
    # spans without a frame match nothing, so any key does; one for all would send them to one task
    nowhere = F.xxhash64("_frame", *(c for c in ("session", "host", "plane_id", "line_id", "seq", "begin") if c in spans.columns))
    out = _frame_texts(spans, longer, limit).withColumn("fingerprint", F.when(F.col("_frame").isNull(), nowhere).otherwise(F.xxhash64("_frame")))
    return out.join(frames.select("fingerprint", F.col("text").alias("_frame"), "frame"), ["fingerprint", "_frame"], "left").drop("fingerprint", "_frame")


# --- the way back -----------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _body(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


class _Names:
    """A dictionary of a plane: texts by number, from 1."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def __call__(self, name: str) -> int:
        return self.number.setdefault(name, len(self.number) + 1)


def _stat(names: _Names, name: str, value: dict, often: set[int]) -> bytes:
    out = _number(1, names(name))
    if value["int"] is not None:
        return out + _number(3 if value["int"] >= 0 else 4, value["int"])
    if value["real"] is not None:
        return out + _varint(2 << 3 | 1) + struct.pack("<d", value["real"])
    if value["raw"] is not None:
        return out + _body(6, value["raw"])
    text = value["text"] or ""
    return out + (_number(7, names(text)) if hash(text) in often else _body(5, text.encode()))


class _Space:
    """A trace file of spans that come in the order of planes, lines and time. They are kept as compressed batches until all
    are there, as only then it is known which texts repeat."""

    def __init__(self, session: str, host: str, origin_ns: int):
        self.origin, self.origin_ns, self.space = (session, host), origin_ns, bytearray()
        self.plane = self.line = None
        self.batches, self.once, self.often = [], set(), set()

    def keep(self, batch: pa.RecordBatch) -> None:
        self.batches.append(_packed(batch))
        stats = batch.column("stats")
        first, *_, end = stats.offsets.to_pylist()  # items are those of all rows, also outside of the batch
        for text in stats.items.slice(first, end - first).field("text").to_pylist():
            if text is not None:  # two texts with one hash count as one that repeats, which is as right in a file
                (self.often if (key := hash(text)) in self.once else self.once).add(key)

    def add(self, r: dict) -> None:
        if self.plane is None or r["plane_id"] != self.plane[0]:
            self.end_plane()
            self.plane, self.body = (r["plane_id"], r["plane"]), bytearray(_number(1, r["plane_id"]) + _body(2, r["plane"].encode()))
            self.metas, self.meta_stats, self.names = _Names(), {}, _Names()
        if self.line is None or r["line_id"] != self.line[0]:
            self.end_line()
            start = r["begin"] // 1000  # ns
            self.line = (r["line_id"], start, bytearray(_number(1, r["line_id"]) + _body(2, r["line"].encode()) + _number(3, self.origin_ns + start)))
        self.meta_stats.setdefault(r["name"], r["meta_stats"])
        event = _number(1, self.metas(r["name"])) + _number(2, r["begin"] - self.line[1] * 1000) + _number(3, r["dur"])
        self.line[2].extend(_body(4, event + b"".join(_body(4, _stat(self.names, k, v, self.often)) for k, v in r["stats"] or ())))

    def end_line(self) -> None:
        if self.line is not None:
            self.body += _varint(3 << 3 | 2) + _varint(len(self.line[2]))
            self.body += self.line[2]
            self.line = None

    def end_plane(self) -> None:
        if self.plane is None:
            return
        self.end_line()
        for name, k in self.metas.number.items():
            entry = _number(1, k) + _body(2, name.encode()) + b"".join(_body(5, _stat(self.names, s, v, self.often)) for s, v in self.meta_stats[name] or ())
            self.body += _body(4, _number(1, k) + _body(2, entry))
        for name, k in self.names.number.items():
            self.body += _body(5, _number(1, k) + _body(2, _number(1, k) + _body(2, name.encode())))
        self.space += _varint(1 << 3 | 2) + _varint(len(self.body))
        self.space += self.body
        self.plane = self.body = None

    def file(self) -> pa.RecordBatch:
        for batch in self.batches:
            for r in _unpacked(batch).to_pylist():
                self.add(r)
        self.end_plane()
        size = len(self.space)
        content = pa.Array.from_buffers(pa.binary(), 1, [None, pa.array([0, size], pa.int32()).buffers()[1], pa.py_buffer(self.space)])
        session, host = (pa.array([x], pa.string()) for x in self.origin)
        return pa.RecordBatch.from_arrays([session, host, pa.array([size], pa.int64()), content], names=["session", "host", "length", "content"])


def encode_spaces(spans: DataFrame, event_meta: DataFrame | None = None, origin_ns: int = 0) -> DataFrame:
    """(session, host, length, content): a trace file per (session, host) of spans(session, host, plane_id, plane, line_id, line,
    seq, name, begin in ps after origin_ns, dur ps, stats). Texts that repeat in a file are written once per plane and referred to. event_meta(name, stats) gives
    dictionary entries their stats. Spark sorts the spans; a task keeps those of one file, compressed, and the file's bytes."""
    columns = ["session", "host", "plane_id", "plane", "line_id", "line", "seq", "name", "begin", "dur", "stats"]
    rows = spans.select(*columns)
    if event_meta is not None:
        rows = rows.join(event_meta.select("name", F.col("stats").alias("meta_stats")), "name", "left").select(*columns, "meta_stats")
    else:
        rows = rows.withColumn("meta_stats", F.lit(None).cast(f"map<string, {VALUE}>"))

    def run(batches):
        space = None
        for batch in batches:
            at = 0
            for origin, same in groupby(zip(batch.column("session").to_pylist(), batch.column("host").to_pylist())):
                if space is None or origin != space.origin:
                    if space is not None:
                        yield space.file()
                    space = _Space(*origin, origin_ns)
                end = at + sum(1 for _ in same)
                for k in range(at, end, 1000):
                    space.keep(batch.slice(k, min(1000, end - k)))
                at = end
        if space is not None:
            yield space.file()

    order = ["session", "host", "plane_id", "line_id", "begin", F.col("dur").desc(), "seq"]
    return rows.repartition("session", "host").sortWithinPartitions(*order).mapInArrow(run, "session string, host string, length bigint, content binary")
