"""Costs of a session: seconds and money of a plan's stages from measured or assumed rates, token counts, machine hours.

A plan is a table of a few dozen rows; what grows is the token and machine tables that are summed for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: rates, margins and reserves of a plan ----
SAFETY, OVERHEAD_SECONDS = 1.15, 150.0
ASSUMED_TRIALS_A_MINUTE, ASSUMED_TOKENS_A_SECOND = 22.0, 4600.0
EVAL_UNCERTAINTY, TRIAL_FLOOR = 0.30, 0.9
DEADLINE_FACTOR, DEADLINE_RESERVE_MINUTES = 1.25, 15.0
# -------------------------------------------------------------


def tuning_seconds(tokens: Column, tokens_per_second: Column) -> Column:
    """Of a training run, with a margin; null without a rate."""
    return F.when(tokens_per_second > 0, tokens / tokens_per_second * SAFETY + OVERHEAD_SECONDS)


def trial_rate(measured: Column, assumed: float = ASSUMED_TRIALS_A_MINUTE) -> Column:
    """struct<rate, basis>: a measured rate counts only where it is below the assumed one."""
    lower = (measured > 0) & (measured < assumed)
    return F.struct(F.when(lower, measured).otherwise(assumed).alias("rate"), F.when(lower, "measured").otherwise("assumed").alias("basis"))


def evaluation(arms: DataFrame, rate: float, tasks: int, samples: int, late_samples: int, rungs: tuple[str, ...], gate_tasks: int) -> DataFrame:
    """(stage, trials, seconds) of the evaluation of arms (arm, gated): the gate, the first rung without the gate's trials, a second sample, the later rungs."""
    n = arms.agg(F.count("*").alias("arms"), F.count_if("gated").alias("gated"))
    gate = F.col("gated") * gate_tasks
    first = F.greatest(F.col("arms") * tasks * samples - gate, F.lit(0)) if rungs[:1] == ("L1",) else F.lit(0)
    second = F.col("arms") * tasks if rungs[:1] == ("L1",) and samples == 1 else F.lit(0)
    later = F.col("arms") * tasks * late_samples * len([r for r in rungs if r != "L1"])
    rows = [("gate", gate), ("L1", first), ("second sample", second), ("later rungs", later)]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(s).alias("stage"), c.cast("long").alias("trials")) for i, (s, c) in enumerate(rows)))).alias("r")
    return n.select(each).select("r.*").withColumn("seconds", F.col("trials") * 60.0 / rate)


def projection(fixed: list[tuple[str, float, str]], training: DataFrame, evaluated: DataFrame, spark: SparkSession, price: float) -> DataFrame:
    """(place, stage, seconds, basis, dollars) in order: fixed stages, training (arm, tokens, tokens_per_second), evaluation."""
    a = spark.createDataFrame([(0, i, s, float(x), b) for i, (s, x, b) in enumerate(fixed)], "part int, place int, stage string, seconds double, basis string")
    b = training.select(F.lit(1).alias("part"), F.lit(0).alias("place"), F.concat(F.lit("train "), "arm").alias("stage"), F.coalesce(tuning_seconds(F.col("tokens"), F.col("tokens_per_second")), F.lit(0.0)).alias("seconds"),
                        F.when(F.col("tokens").isNull(), "no token count").when(F.col("tokens_per_second") > 0, "tokens by rate").otherwise("no rate").alias("basis"))
    c = evaluated.select(F.lit(2).alias("part"), "place", F.concat(F.lit("eval "), "stage").alias("stage"), "seconds", F.lit("trials by rate").alias("basis"))
    rows = a.unionByName(b).unionByName(c)
    return rows.withColumn("dollars", F.col("seconds") / 3600 * price).orderBy("part", "place", "stage")


def evaluation_range(rows: DataFrame, uncertainty: float = EVAL_UNCERTAINTY) -> DataFrame:
    """One row (total, low, high): all dollars, with the evaluation's moved by its uncertainty."""
    ev = F.sum(F.when(F.col("stage").startswith("eval"), F.col("dollars")).otherwise(0.0))
    return rows.agg(F.sum("dollars").alias("total"), ev.alias("__e")).select("total", (F.col("total") - F.col("__e") * uncertainty).alias("low"), (F.col("total") + F.col("__e") * uncertainty).alias("high"))


def deadline_minutes(rows: DataFrame, budget: float, price: float) -> DataFrame:
    """One row (minutes): a margin over the projected time, never more than the budget buys."""
    projected = F.sum("seconds") * DEADLINE_FACTOR / 60 + DEADLINE_RESERVE_MINUTES
    return rows.agg(F.ceil(F.least(F.lit(budget / price * 60), projected)).cast("long").alias("minutes"))


def tokens_per_second(steps_per_second: Column, batch: Column, mean_tokens: Column) -> Column:
    return steps_per_second * batch * mean_tokens


def best_config(configs: DataFrame) -> DataFrame:
    """The fastest of the configurations (tokens_per_s, ok) that ran, none if none did."""
    return configs.where("ok").orderBy(F.desc("tokens_per_s"), *(c for c in configs.columns if c not in ("ok", "tokens_per_s"))).limit(1)


def all_passed(checks: DataFrame) -> DataFrame:
    """One row (checks, failed, ok) of checks (name, ok); nothing checked is not ok."""
    return checks.agg(F.count("*").alias("checks"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed")).withColumn("ok", F.expr("checks > 0 and failed = 0"))


def machine_dollars(machines: DataFrame, created: Column, now: float, hourly: Column, default: float) -> DataFrame:
    """One row (dollars): age times price of all machines; those without a readable time count nothing."""
    age = F.greatest(F.lit(0.0), F.lit(now) - created) / 3600
    return machines.agg(F.coalesce(F.sum(age * F.coalesce(F.nullif(hourly, F.lit(0.0)), F.lit(default))), F.lit(0.0)).alias("dollars"))


def counted_sets(lengths: DataFrame, name: str, tokens: str, limit: int) -> DataFrame:
    """(name, rows, raw, kept) of each set, and of all of them together under the name of all joined by +."""
    sums = [F.count("*").alias("rows"), F.sum(tokens).alias("raw"), F.sum(F.least(F.col(tokens), F.lit(limit))).alias("kept")]
    each = lengths.groupBy(name).agg(*sums)
    total = each.agg(F.array_join(F.sort_array(F.collect_set(name)), "+").alias(name), *(F.sum(c).alias(c) for c in ("rows", "raw", "kept")))
    return each.unionByName(total)


def stale_counts(counts: DataFrame, found: DataFrame, name: str, limit: int) -> DataFrame:
    """(name, reason): counted sets (name, rows, max_length) that no longer fit the data (name, rows): other cut, other rows, gone."""
    both = counts.select(name, F.col("rows").alias("__was"), "max_length").join(found.select(name, F.col("rows").alias("__now")), name, "left")
    why = F.when(F.col("max_length") != limit, "counted at another length").when(F.col("__now").isNull(), "no data").when(F.col("__was") != F.col("__now"), "other number of rows")
    return both.select(name, why.alias("reason")).where("reason is not null")


def required_trials(plan: DataFrame, floor: float = TRIAL_FLOOR) -> DataFrame:
    """plan (tag, tasks, samples) with expected and least trials."""
    return plan.withColumn("expected", F.col("tasks") * F.col("samples")).withColumn("least", F.ceil(F.col("expected") * floor - 1e-9).cast("long"))
