"""Event ledgers: intervals, spend, last values, monitors and the rung schedule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rungs in order of the help they give.
RUNGS = ("L1", "L2", "L3", "L4")


def intervals(events: DataFrame, key: str, ts: str, opens: Column, closes: Column, now: Column, order: str) -> DataFrame:
    """(key, start, stop, open): an opening event lasts until the next opening or closing one, else until now.

    `order` breaks ties of ts; events of other kinds do not matter.
    """
    w = Window.partitionBy(key).orderBy(ts, order)
    own = events.where(opens | closes).withColumn("__next", F.lead(ts).over(w))
    return own.where(opens).select(key, F.col(ts).alias("start"), F.coalesce("__next", now).alias("stop"), F.col("__next").isNull().alias("open"))


def spend(spans: DataFrame, key: str, since: Column, rate: Column) -> DataFrame:
    """(key, total, session): hours times rate of all intervals, and of their parts after `since`."""
    return spans.groupBy(key).agg(
        F.sum((F.col("stop") - F.col("start")) / 3600 * rate).alias("total"),
        F.sum(F.greatest(F.lit(0.0), F.col("stop") - F.greatest(F.col("start"), since)) / 3600 * rate).alias("session"),
    )


def admission(spent: DataFrame, step_seconds: float, rate: float, session_cap: float, total_cap: float, eps: float = 1e-9) -> DataFrame:
    """spent with verdict: whether another step fits both caps."""
    step = step_seconds / 3600 * rate
    return spent.withColumn("verdict", F.when(F.col("session") + step > session_cap + eps, "session cap").when(F.col("total") + step > total_cap + eps, "total cap").otherwise("go"))


def last_known(events: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """(key, fields): the last value that is not null of each field."""
    at = F.struct(*order)
    return events.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields))


def stalls(events: DataFrame, key: str, ts: str, order: str, seconds: float) -> DataFrame:
    """(key, start, gap): pauses of more than so many seconds between neighbouring events."""
    w = Window.partitionBy(key).orderBy(ts, order)
    return events.withColumn("__prev", F.lag(ts).over(w)).where(F.col(ts) - F.col("__prev") > seconds).select(key, F.col("__prev").alias("start"), (F.col(ts) - F.col("__prev")).alias("gap"))


def error_share(events: DataFrame, key: str, order: list[str], error: Column, window: int = 10, least: int = 5, share: float = 0.5) -> DataFrame:
    """(key, alarms): events at which at least `least` of the last `window` are there and `share` of them are errors."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(window - 1), 0)
    each = events.select(key, F.count("*").over(w).alias("n"), F.count_if(error).over(w).alias("bad"))
    return each.groupBy(key).agg(F.count_if((F.col("n") >= least) & (F.col("bad") >= share * F.col("n"))).alias("alarms"))


def steps_per_second(stamps: DataFrame, key: str, ts: str, warmup: int = 3) -> DataFrame:
    """(key, rate): after the first stamps are dropped, (n - 1) / (last - first); null with fewer than three left."""
    w = Window.partitionBy(key).orderBy(ts)
    rest = stamps.withColumn("__i", F.row_number().over(w)).withColumn("__v", F.when(F.col("__i") > warmup, F.col(ts)))
    return rest.groupBy(key).agg(F.when(F.count("__v") >= 3, F.try_divide((F.count("__v") - 1).cast("double"), F.max("__v") - F.min("__v"))).alias("rate"))


def schedule(history: list[float], rung: str, rewards: list[float], window: int = 8, promote_below: float = 0.25, demote_above: float = 0.75, floor: str = "L1") -> tuple[list[float], str]:
    """One step of a task's schedule: rolling pass rate over the last rewards; high rates take help away, low ones give more."""
    history = (history + [1.0 if r >= 1 else 0.0 for r in rewards])[-window:]
    rate, at = (sum(history) / len(history) if history else 0.0), RUNGS.index(rung)
    if rate >= demote_above and at > RUNGS.index(floor):
        at -= 1
    elif rate <= promote_below and at < len(RUNGS) - 1:
        at += 1
    return history, RUNGS[at]


def rung_schedule(events: DataFrame, key: str, order: str, reward: str, start: str = "L3") -> DataFrame:
    """(key, order, rung): the rung after each event of a task, one reward an event; the batch twin of the streaming form.

    The state is eight numbers, so each task's rows are read in sorted order and never held as a whole.
    """
    kinds = dict(events.dtypes)
    src = events.select(key, order, F.col(reward).cast("double").alias("reward")).repartition(key).sortWithinPartitions(key, order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, history, rung = object(), [], start
        for pdf in frames:
            out = []
            for k, r in zip(pdf[key], pdf["reward"], strict=True):
                if k != last:
                    last, history, rung = k, [], start
                history, rung = schedule(history, rung, [r])
                out.append(rung)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "rung": out})

    return src.mapInPandas(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, rung string")


#: What an event tells a supervisor: a result, a failed result, a health check that passed, one that failed.
KINDS = ("result", "failure", "healthy", "unhealthy")


def alarms(events: DataFrame, key: str, ms: str, order: str, kind: str, until: Column, stall_ms: int = 300_000, window: int = 10, share: float = 0.5, fails: int = 3) -> DataFrame:
    """(key, reason, at): alarms of a key's events (time in milliseconds, one of KINDS) up to and including `until`.

    stall: no result for stall_ms since the last one (or the key's first event), at the end of that time; a result ends it.
    errors: of the last `window` results, at least max(3, window // 2), a share are failures; told when it begins to hold.
    health: `fails` failed checks in a row; a passed one ends it. Ties of time go by `order`; other kinds only mark time.
    """
    src = events.where((F.col(ms) <= until) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(ms).alias("ms"), F.col(order).alias("o"), F.col(kind).alias("kind"))
    w = Window.partitionBy("k").orderBy("ms", "o")
    result, check = F.col("kind").isin("result", "failure"), F.col("kind").isin("healthy", "unhealthy")
    # a key's first event counts as a result for the stall alone
    marks = src.withColumn("first", F.row_number().over(w) == 1).where(result | F.col("first")).withColumn("next", F.lead("ms").over(w))
    end = F.col("ms") + stall_ms
    # a first event that is no result, and the result after it, are neighbours like any two results
    stalls_ = marks.where((F.coalesce("next", until + 1) >= end) & (end <= until)).select("k", F.lit("stall").alias("reason"), end.alias("at"))
    last = w.rowsBetween(-(window - 1), 0)
    rolled = src.where(result).select("k", "ms", "o", F.count(F.lit(1)).over(last).alias("n"), F.count_if(F.col("kind") == "failure").over(last).alias("bad"))
    held = rolled.withColumn("held", (F.col("n") >= max(3, window // 2)) & (F.col("bad") >= share * F.col("n")))
    errors = held.withColumn("before", F.lag("held", 1, False).over(w)).where("held and not before").select("k", F.lit("errors").alias("reason"), F.col("ms").alias("at"))
    runs = src.where(check).withColumn("run", F.count_if(F.col("kind") == "healthy").over(w)).where("kind = 'unhealthy'")
    nth = runs.withColumn("i", F.row_number().over(Window.partitionBy("k", "run").orderBy("ms", "o"))).where(F.col("i") == fails)
    health = nth.select("k", F.lit("health").alias("reason"), F.col("ms").alias("at"))
    return stalls_.unionByName(errors).unionByName(health).withColumnRenamed("k", key)
