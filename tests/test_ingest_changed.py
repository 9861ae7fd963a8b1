"""ST1: files that appear, change, or are still being written."""

from __future__ import annotations

import os
import time

from test_spaces import body, number

from spanforge.streaming import ingest


def content(*names):
    meta = b"".join(body(4, number(1, k + 1) + body(2, number(1, k + 1) + body(2, n.encode()))) for k, n in enumerate(names))
    line = body(3, number(1, 1) + body(2, b"l") + b"".join(body(4, number(1, k + 1) + number(2, k) + number(3, 1)) for k in range(len(names))))
    return body(1, number(1, 1) + body(2, b"p") + meta + line)


def put(folder, name, data, age=100.0):
    path = folder / name
    path.write_bytes(data)
    at = time.time() - age
    os.utime(path, (at, at))


def names(spark, out):
    return sorted((r.host, r.name) for r in ingest.current_tables(spark, out)["spans"].collect())


def test_changed_files(spark, tmp_path, monkeypatch):
    folder = tmp_path / "run" / "plugins" / "profile" / "s"
    folder.mkdir(parents=True)
    root, out = str(tmp_path / "run"), str(tmp_path / "out")
    put(folder, "a.xplane.pb", content("x", "y"))
    put(folder, "b.xplane.pb", content("z"))
    assert ingest.ingest_changed(spark, root, out) == 2
    assert names(spark, out) == [("a", "x"), ("a", "y"), ("b", "z")]
    assert ingest.ingest_changed(spark, root, out) == 0
    put(folder, "c.xplane.pb", content("new"), age=50)
    put(folder, "d.xplane.pb", content("young"), age=-60)
    assert ingest.ingest_changed(spark, root, out) == 1
    put(folder, "a.xplane.pb", content("w"), age=40)  # another size and time
    put(folder, "b.xplane.pb", content("q"), age=30)  # the same size
    assert ingest.ingest_changed(spark, root, out) == 2
    assert names(spark, out) == [("a", "w"), ("b", "q"), ("c", "new")]
    put(folder, "c.xplane.pb", b"\x0a\xff", age=20)  # broken now
    assert ingest.ingest_changed(spark, root, out) == 1
    assert names(spark, out) == [("a", "w"), ("b", "q")]
    assert [(r.session, r.host) for r in ingest.current_tables(spark, out)["rejected"].collect()] == [("s", "c")]
    put(folder, "c.xplane.pb", content("back"), age=10)
    assert ingest.ingest_changed(spark, root, out) == 1
    assert names(spark, out) == [("a", "w"), ("b", "q"), ("c", "back")]


def test_a_run_that_dies_shows_nothing(spark, tmp_path):
    folder = tmp_path / "run" / "plugins" / "profile" / "s"
    folder.mkdir(parents=True)
    root, out = str(tmp_path / "run"), str(tmp_path / "out")
    put(folder, "a.xplane.pb", content("x"))
    ingest.ingest_changed(spark, root, out)
    put(folder, "a.xplane.pb", content("y", "z"), age=50)
    spark.range(3).selectExpr("'left over' AS name").write.parquet(f"{out}/data/version=2")  # data without an entry
    assert names(spark, out) == [("a", "x")]
    assert ingest.ingest_changed(spark, root, out) == 1
    assert names(spark, out) == [("a", "y"), ("a", "z")]


def test_watch(spark, tmp_path):
    folder = tmp_path / "run" / "plugins" / "profile" / "s"
    folder.mkdir(parents=True)
    put(folder, "a.xplane.pb", content("x"))
    query = ingest.watch(spark, str(tmp_path / "run"), str(tmp_path / "out"), str(tmp_path / "state"), "1 second")
    try:
        for _ in range(60):
            time.sleep(0.5)
            assert query.exception() is None
            if (tmp_path / "out" / "manifest").exists() and names(spark, str(tmp_path / "out")):
                break
        assert names(spark, str(tmp_path / "out")) == [("a", "x")]
    finally:
        query.stop()
