"""The keyed table: replayed batches, killed writers, late orders, compaction, a restarted stream."""

import os
import time

import pytest

from tarnbeck.streaming import events as S
from tarnbeck.streaming import upserts as U

KIND = "k string, at long, v string"


def table(spark, path):
    return sorted((tuple(r) for r in U.read_upserts(spark, path, ["k"], "at").collect()), key=str)


def test_batches(spark, tmp_path):
    path, df = str(tmp_path), lambda *rows: spark.createDataFrame(rows, KIND)
    assert U.read_upserts(spark, path, ["k"], "at") is None
    write = U.upsert(path, ["k"], "at")
    write(df(("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "x"), (None, 1, "n"), (None, 2, "m")), 0)
    assert table(spark, path) == [("a", 3, "y"), ("b", 1, "x"), (None, 2, "m")]
    write(df(("a", 3, "same order, later batch"), ("b", 0, "too old")), 1)
    want = [("a", 3, "same order, later batch"), ("b", 1, "x"), (None, 2, "m")]
    assert table(spark, path) == want
    # replays, of the last batch and of an older one, with other rows
    write(df(("a", 9, "replayed")), 1)
    write(df(("c", 9, "replayed")), 0)
    assert table(spark, path) == want and len(os.listdir(f"{path}/data")) == 2


def test_a_killed_writer_leaves_nothing(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path), lambda *rows: spark.createDataFrame(rows, KIND)
    write = U.upsert(path, ["k"], "at")
    write(df(("a", 1, "x")), 0)
    with monkeypatch.context() as m:
        m.setattr(U, "_enter", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            write(df(("a", 2, "half"), ("b", 1, "half")), 1)
    assert table(spark, path) == [("a", 1, "x")] and len(os.listdir(f"{path}/data")) == 2
    write(df(("a", 2, "whole")), 1)
    assert table(spark, path) == [("a", 2, "whole")]


def test_compaction(spark, tmp_path):
    path, df = str(tmp_path), lambda *rows: spark.createDataFrame(rows, KIND)
    write = U.upsert(path, ["k"], "at")
    for i in range(4):
        write(df(("a", i, f"v{i}"), (f"k{i}", 0, "x")), i)
    before = table(spark, path)
    U.compact(spark, path, ["k"], "at")
    assert table(spark, path) == before and len(U.manifest(spark, path)) == 1
    U.compact(spark, path, ["k"], "at")
    write(df(("a", 9, "replayed")), 3)
    assert table(spark, path) == before
    write(df(("a", 9, "new")), 4)
    assert ("a", 9, "new") in table(spark, path) and len(table(spark, path)) == len(before)
    assert [s for _, _, s in U.manifest(spark, path)] == [True, False]


def test_stream(spark, tmp_path):
    def put(i, *rows):
        spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        (name,) = [f for f in os.listdir(f"{tmp_path}/{i}") if f.startswith("part-")]
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{tmp_path}/{i}/{name}", f"{tmp_path}/in/{i}.parquet")
        os.utime(f"{tmp_path}/in/{i}.parquet", (time.time() - 1000 + i,) * 2)

    def run():
        src = S.event_stream(spark, f"{tmp_path}/in", KIND)
        sink = src.writeStream.foreachBatch(U.upsert(f"{tmp_path}/t", ["k"], "at")).option("checkpointLocation", f"{tmp_path}/c")
        sink.trigger(availableNow=True).start().awaitTermination()

    put(0, ("a", 1, "x"), ("b", 1, "x"))
    put(1, ("a", 2, "y"))
    run()
    assert table(spark, f"{tmp_path}/t") == [("a", 2, "y"), ("b", 1, "x")]
    # the writer was killed after the batch was entered and before the stream noted it: the batch comes again
    os.remove(f"{tmp_path}/c/commits/1")
    if os.path.exists(f"{tmp_path}/c/commits/.1.crc"):
        os.remove(f"{tmp_path}/c/commits/.1.crc")
    put(2, ("b", 5, "z"))
    run()
    assert table(spark, f"{tmp_path}/t") == [("a", 2, "y"), ("b", 5, "z")]
    assert [b for b, _, _ in U.manifest(spark, f"{tmp_path}/t")] == [0, 1, 2]
