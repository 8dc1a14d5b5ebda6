"""Streaming forms of the event-log operators.

Sources are folders of files with a stated schema; keys carry the state, which is of bounded size for each key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnbeck.operators.ledger import schedule


def event_stream(spark: SparkSession, path: str, schema: str, files: int = 1, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def windowed_errors(events: DataFrame, ts: str, error: Column, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, key, n, errors): tumbling windows; events later than `late` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.count_if(error).alias("errors"))


def sliding_rates(events: DataFrame, ts: str, passed: Column, width: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, step)).agg(F.count("*").alias("n"), F.avg(passed.cast("double")).alias("rate"))


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def once(events: DataFrame, ts: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Events without repeats of their keys."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def rung_stream(events: DataFrame, key: str, order: str, reward: str, start: str = "L3") -> DataFrame:
    """(key, order, rung): the streaming form of operators.ledger.rung_schedule; events of a batch are taken in order."""
    kinds = dict(events.dtypes)

    def step(k: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history, rung = (list(state.get[0]), state.get[1]) if state.exists else ([], start)
        pdf = pd.concat(list(frames)).sort_values(order)
        out = []
        for r in pdf["reward"]:
            history, rung = schedule(history, rung, [r])
            out.append(rung)
        state.update((history, rung))
        yield pd.DataFrame({key: k[0], order: pdf[order], "rung": out})

    src = events.select(key, order, F.col(reward).cast("double").alias("reward"))
    return src.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, rung string", "history array<double>, rung string", "append", GroupStateTimeout.NoTimeout)


def stall_stream(events: DataFrame, key: str, ts: str, seconds: int = 300, late: str = "1 minute") -> DataFrame:
    """(key, since): keys that have been silent for so long in event time."""
    kinds = dict(events.dtypes)

    def step(k: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            since = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "since": [since]})
            return
        last = max((int(p["ms"].max()) for p in frames), default=0)
        last = max(last, state.get[0]) if state.exists else last
        state.update((last,))
        state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [], "since": []}).astype({"since": "int64"})

    src = events.withWatermark(ts, late).withColumn("ms", F.unix_millis(F.col(ts)))
    return src.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, since long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
