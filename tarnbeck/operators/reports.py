"""Reports over runs: judged criteria, verdict flips, hint checks, coverage of downloads, stop reasons, submission idioms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbeck.functions.stats import kappa, wilson

# ---- fixed values ----
ANSWER_STOPS = ("submitted", "answered", "stop")
IDIOMS = (("echo -n", r"^echo -n "), ("echo", r"^echo "), ("printf", r"^printf "), ("python", r"\bpython3?\b"), ("heredoc", r"<<"))
# ----------------------


def criteria(judged: DataFrame, by: str, names: list[str]) -> DataFrame:
    """(by, criterion, yes, n, rate, low, high) of boolean columns; rows without a verdict are not counted."""
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), F.col(c).cast("boolean").alias("y")) for c in names))).alias("r")
    each = judged.select(by, rows).select(by, "r.*").groupBy(by, "criterion").agg(F.count_if("y").alias("yes"), F.count("y").alias("n"))
    w = wilson(F.col("yes"), F.col("n"))
    return each.select(by, "criterion", "yes", "n", F.try_divide("yes", "n").alias("rate"), w["low"].alias("low"), w["high"].alias("high"))


def repeat_agreement(first: DataFrame, again: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(criterion, n, agree, kappa) of rows that were judged twice."""
    pair = lambda c: F.struct(F.lit(c).alias("criterion"), F.col(f"a.{c}").cast("boolean").alias("x"), F.col(f"b.{c}").cast("boolean").alias("y"))
    each = first.alias("a").join(again.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}")).select(F.explode(F.array(*map(pair, names))).alias("r")).select("r.*").where("x is not null and y is not null")
    share = lambda c: F.avg(c.cast("double"))
    g = each.groupBy("criterion").agg(F.count("*").alias("n"), share(F.col("x") == F.col("y")).alias("agree"), share(F.col("x")).alias("__a"), share(F.col("y")).alias("__b"))
    return g.select("criterion", "n", "agree", kappa(F.col("agree"), F.col("__a"), F.col("__b")).alias("kappa"))


def flips(graded: DataFrame, by: str, strict: str, other: str) -> DataFrame:
    """(by, rows, strict, other, gained, lost): passes under two ways of grading."""
    a, b = F.col(strict), F.col(other)
    return graded.groupBy(by).agg(F.count("*").alias("rows"), F.count_if(a).alias("strict"), F.count_if(b).alias("other"), F.count_if(~a & b).alias("gained"), F.count_if(a & ~b).alias("lost"))


def hint_checks(hints: DataFrame, leak: Column, names_column: Column, copied: Column) -> DataFrame:
    """One row (rows, empty, leaking, without_column, copied) over hints (hint, ...)."""
    empty = F.trim(F.coalesce("hint", F.lit(""))) == ""
    return hints.agg(F.count("*").alias("rows"), F.count_if(empty).alias("empty"), F.count_if(~empty & leak).alias("leaking"), F.count_if(~empty & ~names_column).alias("without_column"), F.count_if(~empty & copied).alias("copied"))


def coverage(needed: DataFrame, index: DataFrame, sizes: DataFrame, dataset: str, file: str) -> DataFrame:
    """(dataset, files, missing, covered, bytes): whether the index has all files of a dataset, and what it weighs, null if unknown."""
    known = index.select(dataset, file).distinct().withColumn("__has", F.lit(1))
    g = needed.select(dataset, file).distinct().join(known, [dataset, file], "left").groupBy(dataset).agg(F.count("*").alias("files"), F.count_if(F.col("__has").isNull()).alias("missing"))
    return g.join(sizes.groupBy(dataset).agg(F.max("bytes").alias("bytes")), dataset, "left").select(dataset, "files", "missing", (F.col("missing") == 0).alias("covered"), "bytes")


def download_total(covered: DataFrame) -> DataFrame:
    """One row (datasets, priced, unpriced, bytes) of what is not covered yet."""
    rest = covered.where("not covered")
    return rest.agg(F.count("*").alias("datasets"), F.count("bytes").alias("priced"), F.count_if(F.col("bytes").isNull()).alias("unpriced"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def reference_state(tasks: DataFrame, references: DataFrame, key: str, launched: Column) -> DataFrame:
    """tasks with had_reference: whether one was made before the launch."""
    made = references.groupBy(key).agg(F.min("made_at").alias("__made"))
    return tasks.join(made, key, "left").withColumn("had_reference", F.coalesce(F.col("__made") <= launched, F.lit(False))).drop("__made")


def submission_idioms(last_commands: DataFrame, command: str = "command") -> DataFrame:
    """(idiom, n): how answers are written, by the first idiom that fits."""
    kind = F.coalesce(*(F.when(F.col(command).rlike(p), F.lit(n)) for n, p in IDIOMS), F.lit("other"))
    return last_commands.groupBy(kind.alias("idiom")).agg(F.count("*").alias("n"))


def model_stats(results: DataFrame, expected: int, by: str = "arm") -> DataFrame:
    """(by, clean, failures, passes, answered): finished trials, those missing from the expected ones, passes, ends with an answer."""
    done = F.col("finished")
    said = F.col("stop_reason").isin(*ANSWER_STOPS) & (F.trim(F.coalesce(F.col("prediction").cast("string"), F.lit(""))) != "")
    return results.groupBy(by).agg(F.count_if(done).alias("clean"), (F.lit(expected) - F.count_if(done)).alias("failures"), F.count_if(done & F.col("passed")).alias("passes"), F.count_if(done & said).alias("answered"))


def recheck_counts(checks: DataFrame, by: str) -> DataFrame:
    """(by, checked, recovered, changed, failed) of re-verified trials (old_reward, new_reward, new_status)."""
    ok = F.col("new_status") == "exit 0"
    old, new = F.coalesce("old_reward", F.lit(0.0)) >= 1, F.coalesce("new_reward", F.lit(0.0)) >= 1
    return checks.groupBy(by).agg(F.count("*").alias("checked"), F.count_if(ok & F.col("old_reward").isNull()).alias("recovered"), F.count_if(ok & (old != new)).alias("changed"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"))
