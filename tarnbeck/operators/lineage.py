"""Keyed lookups between tasks, references, hints, trials and runs: which row counts, which is missing, and why.

A key with many rows is always reduced by a partial minimum or maximum before it meets a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .conversations import reasons


def first_by(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first row of each key, by order; all columns."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*key, "__r.*").select(*rows.columns)


def last_by(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last row of each key, by order; all columns."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*key, "__r.*").select(*rows.columns)


def union_of(sources: dict[str, DataFrame], name: str = "split") -> DataFrame:
    """All sources as one table with their name and rank; columns that one lacks are null there."""
    out = None
    for rank, (label, df) in enumerate(sources.items()):
        df = df.withColumns({name: F.lit(label), f"{name}_rank": F.lit(rank)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def catalogue(sources: dict[str, DataFrame], key: str, name: str = "split") -> DataFrame:
    """One row for each key over all sources, that of the first source that has it."""
    rows = union_of(sources, name)
    return first_by(rows, [key], f"{name}_rank", *(c for c in rows.columns if c not in (key, f"{name}_rank") and dict(rows.dtypes)[c] in ("string", "bigint", "int", "double")))


def reference_of(tasks: DataFrame, roots: list[DataFrame], key: str) -> DataFrame:
    """tasks with reference: the code (key, code, reward) of the first root that has the task, null if that one did not pass."""
    found = union_of({str(i): r.select(key, "code", "reward") for i, r in enumerate(roots)}, "root")
    best = first_by(found, [key], "root_rank", "code", "reward").select(key, F.when(F.col("reward") >= 1, F.col("code")).alias("reference"))
    return tasks.join(best, key, "left")


def valid_hints(tasks: DataFrame, hints: DataFrame, key: str, version: str) -> DataFrame:
    """tasks (key, reference_hash) with hint: the cached one (key, reference_hash, prompt_version, failed, hint) if it is still good.

    Good: not failed, of this version, made from this reference, and not empty.
    """
    good = hints.where((F.col("prompt_version") == version) & ~F.coalesce("failed", F.lit(False)) & (F.trim(F.coalesce("hint", F.lit(""))) != ""))
    return tasks.join(good.groupBy(key, "reference_hash").agg(F.min("hint").alias("hint")), [key, "reference_hash"], "left")


def to_generate(tasks: DataFrame, cache: DataFrame, on: list[str]) -> DataFrame:
    """tasks that the cache holds no answer to, failed ones included, under the same key, reference, version and model."""
    return tasks.join(cache.select(*on).distinct(), on, "left_anti")


def promoted(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """The first verified attempt of each task; tasks without one are absent."""
    return first_by(attempts.where("reward >= 1"), [key], order)


def failed_everywhere(results: DataFrame, key: str) -> DataFrame:
    """(key) of tasks that failed somewhere and passed nowhere."""
    return results.groupBy(key).agg(F.max(F.coalesce("reward", F.lit(0.0))).alias("best")).where("best < 1").select(key)


def side_records(trials: DataFrame, checks: DataFrame, earlier: DataFrame, key: list[str]) -> DataFrame:
    """(key, old_reward, new_reward, new_status, attempts): what a re-verification adds beside the trials; attempts counts on."""
    n = earlier.groupBy(*key).agg(F.max("attempts").alias("__n"))
    both = checks.join(trials.select(*key, F.col("reward").alias("old_reward")), key).join(n, key, "left")
    return both.select(*key, "old_reward", "new_reward", "new_status", (F.coalesce("__n", F.lit(0)) + 1).alias("attempts"))


def failure_rows(failed: DataFrame, key: list[str], error: str, like: DataFrame) -> DataFrame:
    """Failures of the harness as rows of the results' shape: no reward, the error as status, all else null."""
    given = {"agent_status": F.col(error).cast("string"), "reward": F.lit(None).cast("double")}
    return failed.select(*(F.col(f.name) if f.name in key else given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in like.schema))


def skipped(planned: DataFrame, attempted: DataFrame, key: str) -> DataFrame:
    """One row (planned, skipped, ids): how many were planned, and those left out in order.

    The ids are a report over a plan of a few hundred tasks; larger plans are told by the anti-join alone.
    """
    rest = planned.select(key).distinct().join(attempted.select(key).distinct(), key, "left_anti")
    count = planned.agg(F.count_distinct(key).alias("planned"))
    return count.crossJoin(rest.agg(F.count("*").alias("skipped"), F.sort_array(F.collect_list(key)).alias("ids")))


def trace_rows(trials: DataFrame, tasks: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """trials with reason: why a trial gives no training row, null if it gives one.

    In order: unknown task, held out, not finished, not passed, no transcript.
    """
    known = tasks.select(key).distinct().withColumn("__known", F.lit(True))
    out = held.select(key).distinct().withColumn("__held", F.lit(True))
    both = trials.join(known, key, "left").join(out, key, "left")
    chain = [("unknown task", F.col("__known").isNull()), ("held out", F.col("__held")), ("not finished", ~F.col("finished")), ("not passed", ~F.col("passed")), ("no transcript", F.col("transcript").isNull())]
    return reasons(both, chain).select(*trials.columns, "reason")


def fallback_rows(references: DataFrame, pool: DataFrame, exported: DataFrame, key: str) -> DataFrame:
    """references with reason: not in the pool, already exported, no verified value; null for those that stand in for a trace."""
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    both = references.join(mark(pool, "__pool"), key, "left").join(mark(exported, "__done"), key, "left")
    chain = [("not in the pool", F.col("__pool").isNull()), ("already exported", F.col("__done")), ("no verified value", F.trim(F.coalesce(F.col("prediction").cast("string"), F.lit(""))) == "")]
    return reasons(both, chain).select(*references.columns, "reason")


def rung_rows(tasks: DataFrame, references: DataFrame, held: DataFrame, rungs: tuple[str, ...], key: str) -> DataFrame:
    """(key, rung) for every task that has a reference and is not held out; the first rung needs no reference."""
    each = tasks.select(key).distinct().join(held.select(key).distinct(), key, "left_anti").withColumn("rung", F.explode(F.array(*map(F.lit, rungs))))
    has = references.select(key).distinct().withColumn("__has", F.lit(True))
    return each.join(has, key, "left").where((F.col("rung") == rungs[0]) | F.col("__has")).select(key, "rung")


def aligned(a: DataFrame, b: DataFrame, place: str, value: str, least: float = 0.99) -> DataFrame:
    """One row (both, same, share, accepted): two exports side by side by place."""
    j = a.select(place, F.col(value).alias("x")).join(b.select(place, F.col(value).alias("y")), place)
    n = j.agg(F.count("*").alias("both"), F.count_if(F.col("x").eqNullSafe(F.col("y"))).alias("same"))
    share = F.coalesce(F.try_divide("same", "both"), F.lit(0.0))
    return n.withColumns({"share": share, "accepted": share >= least})


def tasks_present(results: DataFrame, tags: list[str], key: str) -> DataFrame:
    """(key) that all or any of the tags have results for, in order."""
    return results.where(F.col("tag").isin(tags)).select(key).distinct().orderBy(key)


def common_tasks(results: DataFrame, tags: list[str], key: str, excluded: DataFrame | None = None) -> DataFrame:
    """(key) that every tag has a result for, without the excluded ones."""
    n = results.where(F.col("tag").isin(tags)).groupBy(key).agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(tags)).select(key)
    return n if excluded is None else n.join(excluded.select(key).distinct(), key, "left_anti")


def finished_steps(events: DataFrame) -> DataFrame:
    """(step) that ended with code 0 at any time."""
    return events.where("event = 'step_end' and code = 0").select("step").distinct()


def last_decision(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, go): the latest decision under each key."""
    return events.where(F.col("go").isNotNull()).groupBy(*key).agg(F.max_by("go", order).alias("go"))


def blockers(wanted: DataFrame, checks: DataFrame, merges: DataFrame) -> DataFrame:
    """wanted (model) with reason: why it must not be evaluated yet, null if nothing stands against it."""
    both = wanted.join(checks.select("model", "differs", "calls_ok"), "model", "left").join(merges.select("model", "tensors"), "model", "left")
    chain = [("never served", F.col("calls_ok").isNull()), ("no merge report", F.col("tensors").isNull()), ("merge changed nothing", F.col("tensors") == 0), ("answers as the base does", ~F.col("differs")), ("no tool call came back", ~F.col("calls_ok"))]
    return reasons(both, chain).select(*wanted.columns, "reason")


def reclaimed(open_: DataFrame, live: DataFrame, now: Column, grace: float = 120.0, pending_grace: float = 900.0) -> DataFrame:
    """Open intervals (key, id, start) that no live machine (id) stands behind any more, with closed = now; young ones wait, longer without an id."""
    known = live.select("id").distinct()
    limit = F.when(F.col("id").isNull(), pending_grace).otherwise(grace)
    return open_.join(known, "id", "left_anti").where(now - F.col("start") >= limit).withColumn("closed", now)


def junk(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """(path, size) of files and folders (path, size) whose name matches a pattern, without what lies below another of them."""
    name = F.element_at(F.split("path", "/"), -1)
    hit = paths.where(name.rlike("|".join(f"(?:{p})" for p in patterns)))
    above = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/")))
    inner = hit.select("path", above.alias("top")).where("top <> path").join(hit.select(F.col("path").alias("top")), "top", "left_semi").select("path").distinct()
    return hit.join(inner, "path", "left_anti").select("path", "size")


def fingerprint(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """One row (sha256) over the files' names and contents in order of names; a few files of code."""
    each = files.select(F.struct(F.col(name), F.sha2(F.col(content), 256)).alias("f"))
    return each.agg(F.sha2(F.to_json(F.sort_array(F.collect_list("f"))), 256).alias("sha256"))
