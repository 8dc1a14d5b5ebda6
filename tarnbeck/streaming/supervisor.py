"""A supervisor over a stream of events: silent keys, shares of failures and failed health checks, one alarm each.

The streaming form of operators.ledger.alarms. A key's state is what has arrived and is not yet due, the last results' outcomes
(a window of them), and a few facts. In event time, events wait until the watermark has passed them and are then taken in
order, so the order of arrival does not matter, and a timer ends a silence. In processing time, events are taken as they come and
the silence is that of the clock. Timers and state survive a restart with the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Supervisor(StatefulProcessor):
    def __init__(self, key: str, stall_ms: int, window: int, share: float, fails: int, event_time: bool):
        self.key, self.stall_ms, self.window, self.share, self.fails, self.event_time = key, stall_ms, window, share, fails, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "ms long, ord long, kind string")
        self.recent = handle.getListState("recent", "bad boolean")
        #: last: time of the last result; stalled, erring: alarms that still hold; failed: checks failed in a row
        self.facts = handle.getValueState("facts", "last long, stalled boolean, erring boolean, failed int")

    def close(self) -> None:
        pass

    def _alarms(self, rows: list[tuple[int, int, str]], now: int) -> list[tuple[str, int]]:
        """Alarms of rows in order, all of them up to `now`; sets the timer of the next silence."""
        out, facts = [], self.facts.get() if self.facts.exists() else None
        last, stalled, erring, failed = facts or (None, False, False, 0)
        recent = [r[0] for r in self.recent.get()]
        for ms, _, kind in rows:
            last = ms if last is None else last
            if not stalled and ms - last >= self.stall_ms:
                out.append(("stall", last + self.stall_ms))
                stalled = True
            if kind in ("result", "failure"):
                last, stalled = ms, False
                recent = [*recent, kind == "failure"][-self.window :]
                held = len(recent) >= max(3, self.window // 2) and sum(recent) >= self.share * len(recent)
                if held and not erring:
                    out.append(("errors", ms))
                erring = held
            elif kind in ("healthy", "unhealthy"):
                failed = failed + 1 if kind == "unhealthy" else 0
                if failed == self.fails:
                    out.append(("health", ms))
        if last is not None and not stalled and last + self.stall_ms <= now:
            out.append(("stall", last + self.stall_ms))
            stalled = True
        if last is not None:
            self.facts.update((last, bool(stalled), bool(erring), int(failed)))
            if not stalled:
                self.handle.registerTimer(last + self.stall_ms)
        if recent:
            self.recent.put([(bool(b),) for b in recent])
        return out

    def _due(self, now: int) -> list[tuple[int, int, str]]:
        """Takes what waits and is due, in order, and sets a timer for the first of the rest."""
        waiting = sorted(tuple(r) for r in self.pending.get())
        due, rest = [r for r in waiting if r[0] <= now], [r for r in waiting if r[0] > now]
        if rest:
            self.pending.put(rest)
            self.handle.registerTimer(rest[0][0])
        elif waiting:
            self.pending.clear()
        return due

    def _frame(self, key: Any, found: list[tuple[str, int]]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame({self.key: [key[0]] * len(found), "reason": [r for r, _ in found], "at": [a for _, a in found]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((int(m), int(o), k) for p in rows for m, o, k in zip(p["ms"], p["ord"], p["kind"], strict=True))
        if self.event_time:
            self.pending.appendList(new)
            now = timerValues.getCurrentWatermarkInMs()
            new = self._due(now)
            if not new:
                return
        else:
            now = timerValues.getCurrentProcessingTimeInMs()
        yield from self._frame(key, self._alarms(new, now))

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.event_time:
            now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
            yield from self._frame(key, self._alarms(self._due(now), now))
        else:
            yield from self._frame(key, self._alarms([], timerValues.getCurrentProcessingTimeInMs()))


def supervised(
    events: DataFrame, key: str, ts: str, order: str, kind: str, late: str = "1 minute", stall_ms: int = 300_000, window: int = 10, share: float = 0.5, fails: int = 3, event_time: bool = True
) -> DataFrame:
    """(key, reason, at in milliseconds) as in operators.ledger.alarms, up to the watermark; null keys and times are left out.

    Sets the session's state store to the one that keeps timers, which holds for queries that start from now on.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kinds = dict(events.dtypes)
    src = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key), F.col(ts), F.col(order).cast("long").alias("ord"), F.col(kind).alias("kind"))
    if event_time:
        src = src.withWatermark(ts, late)
    src = src.withColumn("ms", F.unix_millis(F.col(ts)))
    processor = Supervisor(key, stall_ms, window, share, fails, event_time)
    return src.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kinds[key]}, reason string, at long", "append", "EventTime" if event_time else "ProcessingTime")
