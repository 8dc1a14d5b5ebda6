"""Conversations as rows (conv, turn, role, text) or as arrays of messages: shapes, loops, refusals, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.functions import text as T


def messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, messages): array<struct<turn, role, text>> in order of turns."""
    return turns.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(turn, "role", "text"))).alias("messages"))


def shape(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turns, assistant_turns, chars, est_tokens, code_chars) of each conversation."""
    code = F.aggregate(F.regexp_extract_all("text", F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1)), F.lit(0), lambda a, x: a + F.length(x))
    return turns.groupBy(conv).agg(
        F.count("*").alias("turns"), F.count_if(F.expr("role = 'assistant'")).alias("assistant_turns"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"),
        F.floor(F.coalesce(F.sum(F.length("text")), F.lit(0)) / 4).alias("est_tokens"), F.coalesce(F.sum(code), F.lit(0)).alias("code_chars"),
    )


def runs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", by: str = "role") -> DataFrame:
    """(conv, run, by, start, length): stretches of neighbouring turns with the same value."""
    w = Window.partitionBy(conv).orderBy(turn)
    new = (~F.col(by).eqNullSafe(F.lag(by).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return turns.withColumn("__new", new).withColumn("run", F.sum("__new").over(w)).groupBy(conv, "run", by).agg(F.min(turn).alias("start"), F.count("*").alias("length"))


def looped(commands: Column, last: int = 4) -> Column:
    """Whether the last commands are all the same, and there are so many."""
    return (F.size(commands) >= last) & (F.size(F.array_distinct(F.slice(commands, -last, last))) == 1)


def repeats(events: DataFrame, key: str, order: str, value: str, times: int) -> DataFrame:
    """(key, longest, stopped): longest stretch of equal values, and whether it reaches `times`."""
    r = runs(events.select(key, order, value), key, order, value)
    return r.groupBy(key).agg(F.max("length").alias("longest")).withColumn("stopped", F.col("longest") >= times)


def answered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, last_assistant, closes): text of the last assistant turn, and whether nothing follows it."""
    return turns.groupBy(conv).agg(F.max_by("text", F.when(F.col("role") == "assistant", F.col(turn))).alias("last_assistant"), (F.max(F.when(F.col("role") == "assistant", F.col(turn))) == F.max(turn)).alias("closes"))


def reasons(rows: DataFrame, chain: list[tuple[str, Column]]) -> DataFrame:
    """rows with reason: the first of the chain that applies, null for rows that may be exported."""
    return rows.withColumn("reason", F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in chain), F.lit(None).cast("string")))


def export_chain(turns: DataFrame, benchmark: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, reason): why a conversation may not be exported.

    In order: held out (a user turn is a benchmark text in normal form), no assistant turn, does not end with the assistant,
    empty answer, machine leak.
    """
    held = benchmark.select(T.normalise_question(F.col("text")).alias("__norm")).where("__norm <> ''").distinct()
    asked = turns.where("role = 'user'").select(conv, T.normalise_question(F.col("text")).alias("__norm"))
    hit = asked.join(held, "__norm", "left_semi").select(conv).distinct().withColumn("held_out", F.lit(True))
    leak = turns.groupBy(conv).agg(F.bool_or(F.size(T.machine_leaks(F.col("text"))) > 0).alias("leak"))
    each = answered(turns, conv).join(leak, conv).join(hit, conv, "left")
    chain = [
        ("held out", F.col("held_out")), ("no assistant turn", F.col("closes").isNull()), ("wrong ending", ~F.col("closes")),
        ("empty answer", F.trim(F.coalesce("last_assistant", F.lit(""))) == ""), ("machine leak", F.col("leak")),
    ]
    return reasons(each, chain).select(conv, "reason")


def token_budget(lengths: DataFrame, by: str, tokens: str, limit: int = 8192) -> DataFrame:
    """(by, rows, raw, kept, over): rows, tokens before and after cutting each row at the limit, rows over it."""
    return lengths.groupBy(by).agg(F.count("*").alias("rows"), F.sum(tokens).alias("raw"), F.sum(F.least(F.col(tokens), F.lit(limit))).alias("kept"), F.count_if(F.col(tokens) > limit).alias("over"))


def row_tokens(msgs: Column, tools: Column | None = None, per_message: int = 8) -> Column:
    """Estimated tokens of a conversation: a fourth of the characters, and a fixed cost of each message and of the tools once."""
    body = F.aggregate(msgs, F.lit(0).cast("long"), lambda a, m: a + F.ceil(F.length(F.coalesce(m["text"], F.lit(""))) / 4) + per_message)
    return body + (F.ceil(F.length(tools) / 4) if tools is not None else F.lit(0))


def matched_results(calls: DataFrame, results: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Calls (conv, call_id, command) with their results (conv, call_id, output); unmatched calls have none, of several results the last (seq) counts."""
    last = results.groupBy(conv, "call_id").agg(F.max_by("output", "seq").alias("output"))
    return calls.join(last, [conv, "call_id"], "left")


def last_submission(msgs: Column, pattern: str = r"(?m)^\s*(?:echo|printf)\s+['\"]?(.*?)['\"]?\s*>\s*\S*answer\.txt") -> Column:
    """Value of the last submission in any message, or null."""
    found = F.flatten(F.transform(msgs, lambda m: F.regexp_extract_all(F.coalesce(m["text"], F.lit("")), F.lit(pattern), F.lit(1))))
    return F.try_element_at(found, F.lit(-1))


def chat(system: Column, user: Column) -> Column:
    """Two messages (role, content)."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(one("system", system), one("user", user))


def first_difference(a: Column, b: Column) -> Column:
    """Place (from 0) at which two arrays first differ, null if they are equal."""
    n = F.greatest(F.size(a), F.size(b))
    return F.get(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i))), F.lit(0))
