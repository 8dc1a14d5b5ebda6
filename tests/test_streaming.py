from pyspark.sql import functions as F

from tarnbeck.operators import ledger
from tarnbeck.streaming import events as S


def drained(df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_rungs_as_in_batch(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", (F.col("event_type") == "purchase").cast("double").alias("reward"))
    ev.orderBy("event_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.rung_stream(S.event_stream(spark, str(tmp_path / "in"), "event_id long, user_id long, reward double"), "user_id", "event_id", "reward")
    got = {tuple(r) for r in drained(stream, "rungs").collect()}
    assert got == {tuple(r) for r in ledger.rung_schedule(ev, "user_id", "event_id", "reward").collect()}


def test_windows_as_in_batch(spark, sf):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = S.event_stream(spark, f"{sf}/event[s].parquet", schema.replace("ts timestamp", "ts timestamp_ntz")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = drained(S.windowed_errors(src, "ts", F.col("event_type") == "error", "user_id", "1 day"), "errors", "update")
    last = out.groupBy("window", "user_id").agg(F.max("n").alias("n"))
    want = ev.groupBy(F.window("ts", "1 day"), "user_id").agg(F.count("*").alias("n"))
    assert last.exceptAll(want).isEmpty() and want.exceptAll(last).isEmpty()


def files(spark, path, *batches):
    """One file for each batch of (seconds, key), in order; the stream takes one at a time."""
    import os
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "s long, key string").select(F.timestamp_seconds("s").alias("ts"), "key").coalesce(1).write.parquet(f"{path}/{i}")
        for f in os.listdir(f"{path}/{i}"):
            if f.startswith("part-"):
                at = time.time() - 1000 + i
                os.makedirs(f"{path}/in", exist_ok=True)
                os.rename(f"{path}/{i}/{f}", f"{path}/in/{i}.parquet")
                os.utime(f"{path}/in/{i}.parquet", (at, at))
    return S.event_stream(spark, f"{path}/in", "ts timestamp, key string")


def test_sessions_and_sliding_windows(spark, tmp_path):
    src = files(spark, tmp_path, [(0, "a"), (100, "a"), (50, "b")], [(1000, "a"), (100_000, "z")], [(200_000, "z")])
    out = drained(S.sessions(src, "ts", "key", "10 minutes", "1 minute"), "sessions")
    got = {(r.key, r.n, int(r.session_window.start.timestamp())) for r in out.collect()}
    assert {("a", 2, 0), ("b", 1, 50), ("a", 1, 1000)} <= got
    rates = drained(S.sliding_rates(src, "ts", F.col("key") == "a", "1 hour", "30 minutes", "1 minute"), "rates")
    assert {(r.n, round(r.rate, 4)) for r in rates.where("window.start = timestamp_seconds(0)").collect()} == {(4, 0.75)}


def test_repeats_go_and_silence_is_told(spark, tmp_path):
    src = files(spark, tmp_path, [(0, "a"), (1, "b")], [(5, "a"), (6, "c")], [(1000, "d")], [(2000, "d")])
    assert sorted(r.key for r in drained(S.once(src, "ts", ["key"], "10 minutes"), "once").collect())[:3] == ["a", "b", "c"]
    told = {(r.key, r.since) for r in drained(S.stall_stream(src, "key", "ts", 300, "1 second"), "stalls").collect()}
    assert {("a", 5000), ("b", 1000), ("c", 6000)} <= told
