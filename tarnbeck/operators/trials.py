"""Two-level statistics over trials (task, rung, sample, finished, passed).

A trial that did not finish is a harness failure and enters no rate. Rates are means over tasks of each task's share of
passes, never means over trials. Null in the engine stands for "not measured".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbeck.functions.stats import sign_test

#: Rungs in order.
RUNGS = ("L1", "L2", "L3", "L4")


def overlaid(trials: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """Trials with the verdicts of their successful re-verification (keys, new_status, new_reward) in place of the recorded ones."""
    ok = again.where("new_status = 'exit 0'").select(*keys, "new_reward", F.lit(True).alias("recovered"))
    both = trials.join(ok, keys, "left")
    status = F.coalesce("verify_status", F.lit("exit 0")) == "exit 0"
    return both.select(
        *trials.columns,
        (F.coalesce("agent_status", F.lit("")).eqNullSafe("exit 0") & (status | F.coalesce("recovered", F.lit(False)))).alias("finished"),
        (F.coalesce("new_reward", "reward", F.lit(0.0)) >= 1).alias("passed"),
    )


def fractions(trials: DataFrame, by: tuple[str, ...] = ("task", "rung")) -> DataFrame:
    """(by, fraction, n): share of passes among finished trials of a cell; cells without any are absent."""
    return trials.where("finished").groupBy(*by).agg(F.avg(F.col("passed").cast("double")).alias("fraction"), F.count("*").alias("n"))


def rung_stats(trials: DataFrame, by: str = "rung") -> DataFrame:
    """(by, attempted, scored, trials, failures, pass_rate): tasks tried, tasks with a finished trial, trials, failures, mean over tasks."""
    cells = trials.groupBy(by, "task").agg(
        F.count("*").alias("trials"), F.count_if("finished").alias("done"), F.avg(F.when(F.col("finished"), F.col("passed").cast("double"))).alias("fraction")
    )
    return cells.groupBy(by).agg(
        F.count("*").alias("attempted"), F.count("fraction").alias("scored"), F.sum("trials").alias("trials"),
        F.sum(F.col("trials") - F.col("done")).alias("failures"), F.avg("fraction").alias("pass_rate"),
    )


def by_rung(trials: DataFrame, rungs: tuple[str, ...] = RUNGS) -> DataFrame:
    """(task, one column for each rung): fractions side by side, by one aggregate and one shuffle of a row a task."""
    return trials.where("finished").groupBy("task").agg(*(F.avg(F.when(F.col("rung") == r, F.col("passed").cast("double"))).alias(r) for r in rungs))


def monotonicity(trials: DataFrame, rungs: tuple[str, ...] = RUNGS) -> DataFrame:
    """(step, paired, fell, rose, unpaired, p) of each two neighbouring rungs."""
    wide = by_rung(trials, rungs)
    steps = F.array(*(F.struct(F.lit(f"{a}-{b}").alias("step"), F.col(a).alias("lo"), F.col(b).alias("hi")) for a, b in zip(rungs, rungs[1:], strict=False)))
    each = wide.select(F.explode(steps).alias("s")).select("s.*")
    out = each.groupBy("step").agg(
        F.count_if(F.col("lo").isNotNull() & F.col("hi").isNotNull()).alias("paired"), F.count_if(F.expr("hi < lo")).alias("fell"), F.count_if(F.expr("hi > lo")).alias("rose"),
        F.count_if(F.col("lo").isNull() != F.col("hi").isNull()).alias("unpaired"),
    )
    return out.withColumn("p", sign_test(F.col("fell"), F.col("rose")))


def first_passing(rungs: tuple[str, ...] = RUNGS, has_reference: Column | None = None) -> Column:
    """Label of the first rung with a strict majority of passes; then never, no reference, or not scored. A tie is not a pass."""
    out = F.lit(None).cast("string")
    for r in reversed(rungs):
        out = F.when(F.col(r) > 0.5, F.lit(r)).otherwise(out)
    scored = F.coalesce(*(F.col(r) for r in rungs)).isNotNull()
    missing = F.lit("no reference") if has_reference is not None else F.lit("never")
    last = F.when(~scored, "not scored").when(F.lit(True) if has_reference is None else has_reference, "never").otherwise(missing)
    return F.coalesce(out, last)


def partition(trials: DataFrame, rungs: tuple[str, ...] = RUNGS, extra: tuple[str, ...] = ("never", "not scored")) -> DataFrame:
    """(bucket, tasks): every bucket, with 0 where it is empty; the counts add up to the tasks."""
    all_tasks = trials.select("task").distinct().join(by_rung(trials, rungs), "task", "left")
    counts = all_tasks.groupBy(first_passing(rungs).alias("bucket")).agg(F.count("*").alias("n"))
    names = trials.sparkSession.createDataFrame([(b,) for b in (*rungs, *extra)], "bucket string")
    return names.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("tasks"))


def paired_effect(trials: DataFrame, base: str = "L1", other: str = "L2") -> DataFrame:
    """One row: paired, rescued, hurt, mean_delta, p of two rungs over the tasks that both have scored."""
    both = by_rung(trials, (base, other)).where(F.col(base).isNotNull() & F.col(other).isNotNull())
    out = both.agg(F.count("*").alias("paired"), F.count_if(F.col(other) > F.col(base)).alias("rescued"), F.count_if(F.col(other) < F.col(base)).alias("hurt"), F.avg(F.col(other) - F.col(base)).alias("mean_delta"))
    return out.withColumn("p", sign_test(F.col("hurt"), F.col("rescued")))


def consistency(trials: DataFrame) -> DataFrame:
    """(rung, cells, agreeing, share) over cells of two or more finished trials."""
    cells = trials.where("finished").groupBy("rung", "task").agg(F.count("*").alias("n"), F.min("passed").alias("lo"), F.max("passed").alias("hi")).where("n >= 2")
    return cells.groupBy("rung").agg(F.count("*").alias("cells"), F.count_if(F.expr("lo = hi")).alias("agreeing"), F.avg((F.col("lo") == F.col("hi")).cast("double")).alias("share"))


def headroom(trials: DataFrame, rung: str = "L1") -> DataFrame:
    """Tasks with two or more finished trials on the first rung, not all passed."""
    first = trials.where(F.col("finished") & (F.col("rung") == rung)).groupBy("task")
    return first.agg(F.count("*").alias("n"), F.min("passed").alias("all_passed")).where("n >= 2 and not all_passed").select("task")


def ceiling(trials: DataFrame, rung: str = "L1") -> DataFrame:
    """One row: tasks by how their first rung went: passed_all, failed_once, unmeasured (fewer than two finished trials)."""
    each = trials.groupBy("task").agg(F.count_if(F.col("finished") & (F.col("rung") == rung)).alias("n"), F.min(F.when(F.col("finished") & (F.col("rung") == rung), F.col("passed"))).alias("ok"))
    return each.agg(F.count_if(F.expr("n >= 2 and ok")).alias("passed_all"), F.count_if(F.expr("n >= 2 and not ok")).alias("failed_once"), F.count_if(F.expr("n < 2")).alias("unmeasured"))


def grouped_and_total(trials: DataFrame, flag: str) -> DataFrame:
    """(flag, attempted, rescued) for each value of the flag and, with a null flag, for all."""
    cells = trials.where("finished").groupBy("task", flag).agg(F.max("passed").alias("ok"))
    sets = cells.groupingSets([[], [flag]], flag)
    return sets.agg(F.count("*").alias("attempted"), F.count_if("ok").alias("rescued"))


def mixed_cells(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Cells that hold more than one value of a column; a missing value counts as one of its own."""
    seen = [F.size(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("<unrecorded>")))).alias(f"n_{c}") for c in columns]
    kinds = df.select(*by, *columns).distinct().groupBy(*by).agg(*seen)
    return kinds.where(F.greatest(*(F.col(f"n_{c}") for c in columns), F.lit(0)) > 1)


def common_set(trials: DataFrame, rungs: tuple[str, ...], excluded: DataFrame | None = None) -> DataFrame:
    """rung_stats over the tasks that all rungs have scored, without the excluded ones (task)."""
    scored = trials.where(F.col("finished") & F.col("rung").isin(*rungs)).groupBy("task").agg(F.count_distinct("rung").alias("n")).where(F.col("n") == len(rungs)).select("task")
    if excluded is not None:
        scored = scored.join(excluded, "task", "left_anti")
    return rung_stats(trials.where(F.col("rung").isin(*rungs)).join(scored, "task", "left_semi"))


def retry_agreement(trials: DataFrame, answer: str = "prediction") -> DataFrame:
    """(outcome, tasks): tasks by whether the finished trials' answers agree, and on a pass."""
    each = trials.where("finished").groupBy("task").agg(F.count_distinct(F.trim(F.coalesce(F.col(answer).cast("string"), F.lit("")))).alias("answers"), F.count("*").alias("n"), F.max("passed").alias("ok"))
    outcome = F.when(F.col("n") < 2, "single").when(F.col("answers") > 1, "disagree").when(F.col("ok"), "agree right").otherwise("agree wrong")
    return each.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("tasks"))


def climb_gaps(trials: DataFrame, rungs: tuple[str, ...] = RUNGS) -> DataFrame:
    """(task, gap): rungs without a finished trial below the first rung that passed."""
    wide = trials.select("task").distinct().join(by_rung(trials, rungs), "task", "left")
    gaps = []
    for i, r in enumerate(rungs):
        below = F.lit(False)
        for q in rungs[:i]:
            below = below | (F.coalesce(F.col(q), F.lit(0.0)) > 0.5)
        above = F.lit(False)
        for q in rungs[i + 1 :]:
            above = above | (F.coalesce(F.col(q), F.lit(0.0)) > 0.5)
        gaps.append(F.when(F.col(r).isNull() & ~below & above, F.lit(r)))
    return wide.select("task", F.explode(F.array_compact(F.array(*gaps))).alias("gap"))


def climb(trials: DataFrame, rungs: tuple[str, ...] = RUNGS) -> DataFrame:
    """The trials that a climb would have run: those on rungs up to the first that has a pass."""
    at = F.array_position(F.array(*map(F.lit, rungs)), F.col("rung"))
    stop = trials.where(F.col("finished") & F.col("passed")).groupBy("task").agg(F.min(at).alias("stop"))
    return trials.join(stop, "task", "left").where(at <= F.coalesce("stop", F.lit(len(rungs)))).drop("stop")


def decision(stats: DataFrame, max_failures: float = 0.1) -> DataFrame:
    """stats (base_rate, other_rate, p, failures, expected) with an ordered list of reasons and a verdict."""
    reasons = F.array_compact(F.array(
        F.when(F.col("failures") > max_failures * F.col("expected"), F.lit("too many failures")),
        F.when(F.col("other_rate") < F.col("base_rate"), F.lit("worse than base")),
        F.when(F.coalesce(F.col("p"), F.lit(1.0)) > 0.05, F.lit("no significant difference")),
    ))
    return stats.withColumn("reasons", reasons).withColumn("verdict", F.when(F.size("reasons") == 0, "go").otherwise("no go"))
