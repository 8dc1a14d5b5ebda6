"""Run records, corrected gold, costs by stage: small joins and folds over provenance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_launches(launches: DataFrame, run: str, order: str, kept: list[str], ids: str) -> DataFrame:
    """(run, kept, launches, ids): values of the first launch, number of launches, union of all their ids in order."""
    first = launches.groupBy(run).agg(*(F.min_by(c, order).alias(c) for c in kept), F.count("*").alias("launches"))
    union = launches.select(run, F.explode(ids).alias("__id")).distinct().groupBy(run).agg(F.sort_array(F.collect_list("__id")).alias(ids))
    return first.join(union, run, "left").withColumn(ids, F.coalesce(ids, F.array().cast(dict(launches.dtypes)[ids])))


def clashing(launches: DataFrame, run: str, settings: list[str]) -> DataFrame:
    """(run, settings that differ between launches); a missing value is a value of its own."""
    odd = [F.when(F.min(F.coalesce(F.col(c).cast("string"), F.lit("<unrecorded>"))) != F.max(F.coalesce(F.col(c).cast("string"), F.lit("<unrecorded>"))), F.lit(c)) for c in settings]
    return launches.groupBy(run).agg(F.array_compact(F.array(*odd)).alias("settings")).where(F.size("settings") > 0)


def resolved(tasks: DataFrame, current: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """tasks with the current value, else the superseded one, and which it is."""
    a, b = current.select(key, F.col(value).alias("__a")), old.select(key, F.col(value).alias("__b"))
    both = tasks.join(a, key, "left").join(b, key, "left")
    return both.select(*tasks.columns, F.coalesce("__a", "__b").alias(value), F.when(F.col("__a").isNotNull(), "current").when(F.col("__b").isNotNull(), "superseded").otherwise("none").alias("source"))


def regraded_by_source(trials: DataFrame, by: str, source: str, old: Column, new: Column) -> DataFrame:
    """(by, source, n, old_passes, new_passes, flips) of trials graded twice."""
    return trials.groupBy(by, source).agg(F.count("*").alias("n"), F.count_if(old).alias("old_passes"), F.count_if(new).alias("new_passes"), F.count_if(old != new).alias("flips"))


def staged_costs(stages: DataFrame, order: str, seconds: str, price: float) -> DataFrame:
    """stages (a plan's few rows) with dollars of each and of all up to it."""
    cost = F.col(seconds) / 3600 * price
    return stages.withColumn("dollars", cost).withColumn("so_far", F.sum(cost).over(Window.orderBy(order)))


def remaining(stages: DataFrame, order: str, name: str, prefix: str) -> DataFrame:
    """The stages from the first whose name has the prefix."""
    return stages.withColumn("__on", F.max(F.col(name).startswith(prefix).cast("int")).over(Window.orderBy(order))).where("__on = 1").drop("__on")


def expected_trials(plan: DataFrame, tag: str, share: float = 0.9) -> DataFrame:
    """(tag, expected, least) from rows (tag, tasks, samples): what a complete run has, and what still counts as one."""
    return plan.groupBy(tag).agg(F.sum(F.col("tasks") * F.col("samples")).alias("expected")).withColumn("least", F.ceil(F.col("expected") * share - 1e-9))


def complete(expected: DataFrame, results: DataFrame, tag: str) -> DataFrame:
    """expected with found and complete."""
    found = results.groupBy(tag).agg(F.count("*").alias("__n"))
    return expected.join(found, tag, "left").withColumn("found", F.coalesce("__n", F.lit(0))).drop("__n").withColumn("complete", F.col("found") >= F.col("least"))


def stop_shares(results: DataFrame, by: str, reason: str) -> DataFrame:
    """(by, reason, n, share) of stop reasons."""
    n = results.groupBy(by, F.coalesce(reason, F.lit("other")).alias(reason)).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))
