"""The supervisor's stream against its batch form and against plain Python: shuffled arrival, a restart, both clocks."""

import os
import random
import time
from types import SimpleNamespace

from pyspark.sql import functions as F

from tarnbeck.operators import ledger
from tarnbeck.streaming import events as S
from tarnbeck.streaming.supervisor import Supervisor, supervised

SCHEMA = "id long, k string, ms long, kind string"
OPTIONS = {"stall_ms": 50_000, "window": 6, "share": 0.5, "fails": 3}


def made(rng, n):
    out, at = [], {k: 1_000_000 for k in "abc"}
    for i in range(n):
        k = rng.choice("aaab" + "c" * (i > n // 2))
        at[k] += rng.choice([0, 1000, 5000, 9000, 50_000, 70_000]) if rng.random() < 0.5 else 1000
        out.append((i, k, at[k], rng.choice(["result", "failure", "failure", "healthy", "unhealthy", "unhealthy", "other"])))
    return out


def plain(rows, until, stall_ms, window, share, fails):
    out = []
    for k in {r[1] for r in rows}:
        mine = sorted((ms, i, kind) for i, key, ms, kind in rows if key == k and ms <= until)
        if not mine:
            continue
        last, stalled, recent, erring, failed = mine[0][0], False, [], False, 0
        for ms, _, kind in [*mine, (until, 0, "other")]:
            if not stalled and ms - last >= stall_ms:
                out.append((k, "stall", last + stall_ms))
                stalled = True
            if kind in ("result", "failure"):
                last, stalled, recent = ms, False, [*recent, kind == "failure"][-window:]
                held = len(recent) >= max(3, window // 2) and sum(recent) >= share * len(recent)
                out += [(k, "errors", ms)] * (held and not erring)
                erring = held
            if kind in ("healthy", "unhealthy"):
                failed = failed + 1 if kind == "unhealthy" else 0
                out += [(k, "health", ms)] * (failed == fails)
    return sorted(out)


def test_batch(spark):
    for seed in range(4):
        rows = made(random.Random(seed), 120)
        df = spark.createDataFrame(rows, SCHEMA)
        until = max(r[2] for r in rows) + 10_000 * seed
        got = sorted(map(tuple, ledger.alarms(df, "k", "ms", "id", "kind", F.lit(until), **OPTIONS).collect()))
        assert got == plain(rows, until, **OPTIONS) and {r for _, r, _ in got} == {"stall", "errors", "health"}


def test_stream_as_in_batch_with_shuffled_arrival_and_restart(spark, tmp_path):
    rows = made(random.Random(9), 90)
    # a file holds a stretch of time, its rows in any order and some of them late, within the watermark's delay
    order = sorted(rows, key=lambda r: (r[2] + random.Random(r[0]).randrange(15_000)))
    # in the end another key's events carry the watermark past all others
    end = max(r[2] for r in rows) + 100_000
    parts = [order[i : i + 15] for i in range(0, len(order), 15)] + [[(1000, "z", end, "result")], [(1001, "z", end + 20_000, "result")]]
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def put(i, part):
        spark.createDataFrame(part, SCHEMA).withColumn("ts", F.timestamp_millis("ms")).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        (name,) = [f for f in os.listdir(f"{tmp_path}/{i}") if f.startswith("part-")]
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{tmp_path}/{i}/{name}", f"{tmp_path}/in/{i}.parquet")
        os.utime(f"{tmp_path}/in/{i}.parquet", (time.time() - 1000 + i,) * 2)

    def run():
        src = S.event_stream(spark, f"{tmp_path}/in", f"{SCHEMA}, ts timestamp")
        out = supervised(src, "k", "ts", "id", "kind", "20 seconds", **OPTIONS)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    try:
        for i, part in enumerate(parts):
            put(i, part)
            if i in (2, len(parts) - 1):
                run()  # the second run goes on from the first one's state
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = ledger.alarms(spark.createDataFrame(sum(parts, []), SCHEMA), "k", "ms", "id", "kind", F.lit(end), **OPTIONS)
    assert got == sorted(map(tuple, want.collect())) and len(got) > 5


class State:
    def __init__(self):
        self.held = []

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held if not isinstance(self.held, tuple) else self.held

    def put(self, rows):
        self.held = list(rows)

    update = lambda self, row: setattr(self, "held", row)
    appendList = lambda self, rows: self.held.extend(rows)
    clear = lambda self: setattr(self, "held", [])


def test_processing_time():
    import pandas as pd

    timers = []
    handle = SimpleNamespace(getListState=lambda *a: State(), getValueState=lambda *a: State(), registerTimer=timers.append)
    s = Supervisor("k", 1000, 6, 0.5, 2, event_time=False)
    s.init(handle)
    clock = lambda now: SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)
    batch = lambda *rows: iter([pd.DataFrame(rows, columns=["ms", "ord", "kind"])])
    told = lambda frames: [tuple(r) for f in frames for r in f.itertuples(index=False)]
    assert told(s.handleInputRows(("a",), batch((5000, 1, "result"), (5100, 2, "unhealthy")), clock(5200))) == [] and timers == [6000]
    assert told(s.handleInputRows(("a",), batch((5300, 3, "unhealthy")), clock(5300))) == [("a", "health", 5300)]
    assert told(s.handleExpiredTimer(("a",), clock(6001), None)) == [("a", "stall", 6000)]
    assert told(s.handleExpiredTimer(("a",), clock(9000), None)) == []  # told once
