"""Queries over training rows, lineage, costs and reports; conversations stand in for agent traces, events for trials.

An assistant turn calls a command that its length picks, the user turn that follows it is the tool's answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnbeck.functions import logs
from tarnbeck.functions import text as T
from tarnbeck.operators import chats as C
from tarnbeck.operators import conversations, costs, lineage, reports, synthetic, trials

from .event_queries import TRIALS, events, r6, seconds, trial_rows

COMMANDS = ('python3 -c "import pandas; print(pandas.__version__)"', "cat > /workdir/solution.py << 'EOF'\nprint(1)\nEOF", "python3 solution.py", "cd . && ls input")
NOW = 1_707_000_000.0


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def turn_rows(spark, d) -> DataFrame:
    """(conv_id, turn, role, text, kind, is_tool): kind picks the command of an assistant turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, d, "conversations").withColumn("kind", F.length(F.coalesce("text", F.lit(""))) % 4)
    return c.withColumns({"is_tool": (F.col("role") == "user") & (F.lag("role").over(w) == "assistant"), "before": F.lag("kind").over(w)})


def chat_rows(spark, d) -> DataFrame:
    """(conv_id, messages)."""
    name = lambda t: F.concat(F.lit("c"), t.cast("string"))
    command = F.get(F.array(*map(F.lit, COMMANDS)), F.col("kind"))
    one = (
        F.when(F.col("role") == "assistant", C.message("assistant", F.col("text"), F.array(C.call(name(F.col("turn")), command))))
        .when(F.col("is_tool"), C.message("tool", F.when(F.col("before") == 1, C.EMPTY).otherwise(F.col("text")), answers=name(F.col("turn") - 1)))
        .when(F.col("role") == "system", C.message("system", F.col("text"))).otherwise(C.message("user", F.col("text")))
    )
    rows = turn_rows(spark, d).select("conv_id", F.struct("turn", one.alias("m")).alias("r"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("r"))["m"].alias("messages"))


def chat_commands(spark, d):
    c = C.commands(F.col("messages"))
    return chat_rows(spark, d).select("conv_id", F.size(c).cast("long").alias("commands"), F.sha2(F.array_join(c, "|"), 256).alias("sha"))


def chat_turns(spark, d):
    steps = F.flatten(F.transform(C.turns(F.col("messages")), lambda t: t["steps"]))
    return chat_rows(spark, d).select("conv_id", F.size(steps).cast("long").alias("steps"), F.size(F.filter(steps, lambda s: s["output"].isNull())).cast("long").alias("open"), F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + F.length(T.text(s["output"]))), F.lit(0)).alias("chars"))


def chat_lean(spark, d):
    out = chat_rows(spark, d).select("conv_id", C.lean(F.col("messages")).alias("l"))
    return out.select("conv_id", *(F.col(f"l.{c}").cast("long").alias(c) for c in ("removed", "folded", "empty")), F.size("l.messages").cast("long").alias("messages"))


def chat_translated(spark, d):
    out = chat_rows(spark, d).select(C.translated(F.col("messages"), F.lit("")).alias("t"))
    return out.groupBy(F.coalesce("t.refusal", F.lit("kept")).alias("refusal")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("t.messages")), F.lit(0)).alias("messages"))


def chat_audit(spark, d):
    rows = chat_rows(spark, d).withColumn("rendered", C.rendered(F.col("messages")))
    return C.audit_rows(C.checked(rows, "conv_id"), "conv_id")


def chat_renamed(spark, d):
    done = chat_rows(spark, d).select("conv_id", C.renamed(F.col("messages"), F.size("messages") - 1, F.lit("42"), T.text).alias("m"))
    last = F.try_element_at(C.commands(F.col("m")), F.lit(-1))
    return done.select("conv_id", F.size("m").cast("long").alias("messages"), last.alias("last"), F.size(F.filter("m", lambda x: x["answers"] == "call_0_0")).cast("long").alias("first_answers"))


def chat_kinds(spark, d):
    each = chat_rows(spark, d).select(F.explode("messages").alias("m"))
    return each.groupBy(F.col("m.role").alias("role"), C.message_kind(F.col("m")).alias("kind")).agg(F.count("*").alias("n"))


def chat_prepared(spark, d):
    row = chat_rows(spark, d).select("conv_id", C.training_row(F.slice("messages", 1, 1), F.slice("messages", F.lit(2), F.greatest(F.size("messages") - 1, F.lit(0)))).alias("r"))
    return row.select("conv_id", *(C.prepared(F.col("r.messages"), F.col("r.tools"), p).isNotNull().alias(p) for p in ("program", "bash")))


def training_prompts(spark, d):
    b = read(spark, d, "benchmark")
    p = C.prompt(F.col("text"), F.array(F.concat(F.lit("t"), F.col("item_id").cast("string"), F.lit(".csv"))), "Solve it.", "{question}\n\nFiles:\n{files}\n\n{format}", F.lit("One number."))
    f = C.fallback_turns(F.col("text"), F.col("item_id").cast("string"))
    row = b.select("item_id", C.training_row(p, f).alias("r"))
    asked = C.question_of(F.col("r.messages"), "", r"\n\nFiles:")
    return row.select("item_id", F.sha2(F.get("r.messages", F.lit(1))["content"], 256).alias("user"), F.size("r.messages").cast("long").alias("messages"), F.sha2(asked, 256).alias("question"), F.sha2(F.get(C.commands(F.col("r.messages")), F.lit(0)), 256).alias("wrote"))


def tool_results(spark, d):
    t = F.coalesce("text", F.lit(""))
    shown = C.tool_result(t, F.lit(0), F.lit(False))
    out = read(spark, d, "documents").select("doc_id", shown.alias("s")).select("doc_id", F.sha2("s", 256).alias("shown"), C.recorded_result(F.col("s")).alias("r"))
    return out.select("doc_id", "shown", F.length("r.output").cast("long").alias("chars"), F.col("r.cut").alias("cut"))


def transcript_events(spark, d) -> DataFrame:
    """(conv_id, seq, value): each assistant turn as the end of a message with a call, each answer as two updates."""
    t = turn_rows(spark, d)
    block = F.array(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"), F.struct(F.col("text").alias("command")).alias("input")))
    ended = t.where("role = 'assistant'").select("conv_id", (F.col("turn") * 3).alias("seq"), F.to_json(F.struct(F.struct(F.lit("message_end").alias("type"), block.alias("content")).alias("event"))).alias("value"))
    update = lambda c: F.to_json(F.struct(F.struct(F.lit("tool_update").alias("type"), F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("toolCallId"), F.array(F.struct(F.lit("text").alias("type"), c.alias("text"))).alias("partial")).alias("event")))
    shown = t.where("is_tool")
    return ended.unionByName(shown.select("conv_id", (F.col("turn") * 3).alias("seq"), update(F.substring("text", 1, 3)).alias("value"))).unionByName(shown.select("conv_id", (F.col("turn") * 3 + 1).alias("seq"), update(F.col("text")).alias("value"))).unionByName(shown.select("conv_id", (F.col("turn") * 3 + 2).alias("seq"), F.lit("no event").alias("value")))


def transcript_settled(spark, d):
    m = C.transcript_turns(transcript_events(spark, d))
    tools = F.filter("messages", lambda x: x["role"] == "tool")
    return m.select("conv_id", F.size("messages").cast("long").alias("messages"), F.sha2(F.array_join(F.transform(tools, lambda x: x["content"]), "|"), 256).alias("outputs"))


def recorded_replies(spark, d):
    rows = chat_rows(spark, d).select("conv_id", C.question_of(F.col("messages"), "^", "$").alias("question"), F.array(F.lit("a.csv")).alias("files"), "messages")
    asked = rows.where(T.normalise_question(F.col("question")) != "").select("conv_id", F.upper("question").alias("question"), F.array(F.lit("b.csv")).alias("files"), F.lit(0).alias("done"))
    return C.recorded_reply(rows, asked).select("conv_id", F.col("reply").isNotNull().alias("found"))


def row_tokens(spark, d):
    return conversations.messages(read(spark, d, "conversations")).select("conv_id", conversations.row_tokens(F.col("messages")).alias("tokens"))


def catalogue_splits(spark, d):
    docs, known = read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels").select("doc_id")
    return lineage.catalogue({"labelled": known, "all": docs}, "doc_id").groupBy("split").agg(F.count("*").alias("n"), F.count("lang").alias("langs"))


def trace_reasons(spark, d):
    t = trial_rows(spark, d).withColumn("transcript", F.when(F.col("sample") > 0, "t"))
    tasks, held = read(spark, d, "customer").select(F.col("c_custkey").alias("task")), read(spark, d, "region").select(F.col("r_regionkey").alias("task"))
    return lineage.trace_rows(t, tasks, held, "task").groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def fallback_reasons(spark, d):
    refs = read(spark, d, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("prediction"), F.col("o_custkey"))
    pool, done = read(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("task")), read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("task"))
    return lineage.fallback_rows(refs, pool, done, "task").groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def rung_rows(spark, d):
    t = trial_rows(spark, d)
    out = lineage.rung_rows(t.select("task"), t.where("passed and rung = 'L4'").select("task"), read(spark, d, "region").select(F.col("r_regionkey").alias("task")), trials.RUNGS, "task")
    return out.groupBy("rung").agg(F.count("*").alias("n"))


def failed_everywhere(spark, d):
    t = trial_rows(spark, d).where("finished").select("task", "rung", "sample", F.col("passed").cast("double").alias("reward"))
    return lineage.failed_everywhere(t.withColumn("key", F.concat_ws(":", F.col("task").cast("string"), "rung", F.col("sample").cast("string"))), "key")


def promoted_attempts(spark, d):
    t = trial_rows(spark, d).select("task", "event_id", "rung", F.when(F.col("finished"), F.col("passed").cast("double")).alias("reward"))
    return lineage.promoted(t, "task", "event_id").select("task", "event_id", "rung")


def side_records(spark, d):
    t = trial_rows(spark, d)
    old = t.select("event_id", F.col("passed").cast("double").alias("reward"), "rung")
    checks = t.where("prediction = 1").select("event_id", (F.col("sample") > 5).cast("double").alias("new_reward"), F.when(F.col("finished"), "exit 0").otherwise("timeout").alias("new_status"))
    made = lineage.side_records(old, checks, checks.where("new_reward > 0").select("event_id", F.lit(2).alias("attempts")), ["event_id"])
    return reports.recheck_counts(made.join(old.select("event_id", "rung"), "event_id"), "rung").join(made.join(old.select("event_id", "rung"), "event_id").groupBy("rung").agg(F.sum("attempts").alias("attempts")), "rung")


def valid_hints(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("reference_hash"))
    hints = docs.join(read(spark, d, "labels"), "doc_id").select("doc_id", F.when(F.col("toxic") == 1, "old").otherwise(F.col("reference_hash")).alias("reference_hash"), F.lit("v3").alias("prompt_version"), (F.col("quality") == 0).alias("failed"), F.lit("group, then count").alias("hint"))
    left = lineage.to_generate(docs, hints, ["doc_id", "reference_hash"]).agg(F.count("*").alias("to_generate"))
    return lineage.valid_hints(docs, hints, "doc_id", "v3").agg(F.count("*").alias("tasks"), F.count("hint").alias("hints")).crossJoin(left)


def aligned_exports(spark, d):
    """The first and the second line of each order, side by side."""
    line = lambda n: read(spark, d, "lineitem").where(F.col("l_linenumber") == n).select("l_orderkey", "l_returnflag")
    return r6(lineage.aligned(line(1), line(2), "l_orderkey", "l_returnflag"), "share")


def common_tasks(spark, d):
    t = trial_rows(spark, d).withColumn("tag", F.concat(F.lit("s"), F.col("sample").cast("string")))
    return lineage.common_tasks(t, ["s1", "s2", "s3"], "task", t.where("rung = 'L1' and sample = 9").select("task"))


def reclaimed(spark, d):
    e = events(spark, d).withColumn("s", seconds())
    last = e.groupBy("user_id").agg(F.max("s").alias("start"), F.max_by(F.when(F.col("event_type") != "error", F.col("user_id")), "event_id").alias("id"))
    live = e.where("value > 50").select(F.col("user_id").alias("id"))
    return lineage.reclaimed(last, live, F.lit(NOW)).select("user_id")


def model_blockers(spark, d):
    """Log lines of every user's events, parsed again; the last line of a model counts."""
    e = events(spark, d).withColumn("model", F.concat(F.lit("m"), F.col("user_id").cast("string")))
    line = F.concat(F.lit("ADAPTER_CHECK model="), "model", F.lit(" differs="), (F.col("event_type") != "error").cast("int").cast("string"), F.lit(" tool_calls_ok="), (F.col("value") > 5).cast("int").cast("string"))
    merge = F.concat(F.lit("MERGE_OK model="), "model", F.lit(" modules_applied=3 tensors_changed="), F.floor("value").cast("string"))
    text = e.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", F.concat_ws("\n", line, F.when(F.col("value") > 2, merge)).alias("l")))), lambda x: x["l"]), "\n").alias("log"))
    each = lambda m, *c: text.select(F.explode(m).alias("model", "v")).select("model", *(f"v.{x}" for x in c))
    out = lineage.blockers(e.select("model").distinct(), each(logs.serve_checks(F.col("log")), "differs", "calls_ok"), each(logs.serve_merges(F.col("log")), "tensors"))
    return out.groupBy(F.coalesce("reason", F.lit("ready")).alias("reason")).agg(F.count("*").alias("n"))


def counted_sets(spark, d):
    return costs.counted_sets(read(spark, d, "documents").select("lang", F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).alias("tokens")), "lang", "tokens", 500)


def _session(spark, d):
    """(arms, training): sources as arms, large ones gated, and languages as training runs."""
    docs = read(spark, d, "documents")
    arms = docs.groupBy(F.col("source").alias("arm")).agg((F.count("*") > 60).alias("gated"))
    tokens = docs.groupBy(F.col("lang").alias("arm")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("tokens"))
    return arms, tokens.withColumn("tokens_per_second", F.lit(costs.ASSUMED_TOKENS_A_SECOND))


def session_projection(spark, d):
    arms, training = _session(spark, d)
    ev = costs.evaluation(arms, costs.ASSUMED_TRIALS_A_MINUTE, 250, 1, 1, trials.RUNGS, 60)
    rows = costs.projection([("boot", 120.0, "estimate"), ("bootstrap", 720.0, "measured")], training, ev, spark, 2.0)
    return r6(rows.select("stage", "seconds", "dollars"), "seconds", "dollars")


def session_range(spark, d):
    arms, training = _session(spark, d)
    rows = costs.projection([("boot", 900.0, "estimate")], training, costs.evaluation(arms, 20.0, 250, 1, 1, trials.RUNGS, 60), spark, 2.0)
    return r6(costs.evaluation_range(rows).crossJoin(costs.deadline_minutes(rows, 100_000.0, 2.0)), "total", "low", "high")


def machine_dollars(spark, d):
    e = events(spark, d).withColumn("at", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_type") != "error", "Z").otherwise("?")))
    return r6(costs.machine_dollars(e, logs.created_at(F.col("at")), NOW, F.when(F.col("value") > 10, F.col("value")), 3.0), "dollars")


def judged_criteria(spark, d):
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return r6(reports.criteria(rows, "lang", ["quality", "toxic"]).select("lang", "criterion", "yes", "n", "rate"), "rate")


def verdict_flips(spark, d):
    rows = read(spark, d, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").alias("a"), (F.col("o_totalprice") > 100000).alias("b"))
    return reports.flips(rows, "o_orderpriority", "a", "b")


def download_coverage(spark, d):
    need = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("dataset"), F.col("l_partkey").alias("file"))
    have = read(spark, d, "lineitem").where("l_quantity < 40").select(F.col("l_suppkey").alias("dataset"), F.col("l_partkey").alias("file"))
    sizes = read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("dataset"), F.col("s_suppkey").alias("bytes"))
    return reports.download_total(reports.coverage(need, have, sizes, "dataset", "file"))


def submission_idioms(spark, d):
    last = chat_rows(spark, d).select(F.try_element_at(C.commands(F.col("messages")), F.lit(-1)).alias("command")).where("command is not null")
    return reports.submission_idioms(last)


def model_stats(spark, d):
    t = trial_rows(spark, d).withColumn("stop_reason", F.when(F.col("event_id") > 100, "submitted").otherwise("timeout"))
    return reports.model_stats(t, 100_000, "rung")


def overlaid_trials(spark, d):
    t = trial_rows(spark, d)
    rows = t.select("event_id", "rung", F.lit("exit 0").alias("agent_status"), F.when(~F.col("finished"), "timeout").alias("verify_status"), F.col("passed").cast("double").alias("reward"))
    again = t.where("not finished and sample > 3").select("event_id", F.when(F.col("prediction") > 0, "exit 0").otherwise("timeout").alias("new_status"), F.col("prediction").cast("double").alias("new_reward"))
    return trials.overlaid(rows, again, ["event_id"]).groupBy("rung").agg(F.count_if("finished").alias("finished"), F.count_if("passed").alias("passed"))


def same_values(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    near = T.same_value(F.col("p").cast("string"), F.round("p", 0).cast("decimal(18,0)").cast("string"))
    return o.select("o_orderkey", near.alias("near"), T.same_value(F.concat(F.col("o_orderkey").cast("string"), F.lit(" %")), F.col("o_orderkey").cast("string")).alias("plain"))


def verdicts(spark, d):
    reply = F.concat(F.lit('Sure: {"answerable": '), F.when(F.col("quality") == 1, "true").otherwise("false"), F.lit(', "unambiguous": "'), F.col("toxic").cast("string"), F.lit('", "reason": "r"} done'))
    v = T.verdict(F.when(F.col("doc_id") > 50, reply).otherwise("no idea"))
    return read(spark, d, "labels").select("doc_id", v.alias("v")).select("doc_id", "v.answerable", "v.unambiguous", "v.reason", "v.error")


def sql_facts(spark, d):
    q = F.concat(F.lit("SELECT o_orderkey FROM orders WHERE o_orderkey = "), F.col("o_orderkey").cast("string"), F.lit(" AND o_orderstatus = '"), "o_orderstatus", F.lit("' GROUP BY 1"))
    s = read(spark, d, "orders").select("o_orderkey", F.get(T.sql_statements(q), F.lit(0)).alias("s"))
    return s.select("o_orderkey", F.array_join(T.sql_predicates(F.col("s")), "|").alias("predicates"))


def fenced_code(spark, d):
    t = F.concat(F.lit("Here:\n```python\nprint('"), F.substring("text", 1, 20), F.lit("')\n```\nThe answer is\n"), F.col("turn").cast("string"))
    c = read(spark, d, "conversations").where("text not like '%`%'")
    return c.select("conv_id", "turn", F.sha2(F.regexp_replace(T.extract_code(t), r"\s+$", ""), 256).alias("code"), T.last_line(t).alias("answer"), T.is_command(F.lit("ls -la && cat x.txt")).alias("command"))


def synthetic_tasks(spark, d):
    return synthetic.tasks(read(spark, d, "part"), "part.csv", "part").select("task_id", "question", F.when(F.col("reward_mode") == "numeric", F.round(F.col("answer").try_cast("double"), 4).cast("string")).otherwise(F.col("answer")).alias("answer"))


QUERIES = {f.__name__: f for f in (
    chat_commands, chat_turns, chat_lean, chat_translated, chat_audit, chat_renamed, chat_kinds, chat_prepared, training_prompts, tool_results, transcript_settled, recorded_replies, row_tokens,
    catalogue_splits, trace_reasons, fallback_reasons, rung_rows, failed_everywhere, promoted_attempts, side_records, valid_hints, aligned_exports, common_tasks, reclaimed, model_blockers,
    counted_sets, session_projection, session_range, machine_dollars, judged_criteria, verdict_flips, download_coverage, submission_idioms, model_stats, overlaid_trials, same_values, verdicts, sql_facts, fenced_code, synthetic_tasks,
)}

_Q = lambda s: s.replace("'", "''")
_CMD = "[" + ", ".join(f"'{_Q(c)}'" for c in COMMANDS) + "]"
CHAT = f"""a AS (SELECT *, length(coalesce(text, '')) % 4 AS kind, role = 'user' AND coalesce(lag(role) OVER w, '') = 'assistant' AS is_tool, lag(length(coalesce(text, '')) % 4) OVER w AS before, lead(role) OVER w AS nxt, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, ({_CMD})[kind + 1] AS command, CASE WHEN nxt = 'user' THEN CASE WHEN kind = 1 THEN '{C.EMPTY}' ELSE reply END END AS output FROM a)"""
LEAK = f"(regexp_matches(output, '(?i)/(home|Users)/[^u]') OR contains(output, '/var/tmp/') OR contains(output, '/tmp/smol') OR contains(output, 'kaggle/datasets') OR regexp_matches(output, '{_Q(T.SECRET)}'))"
ARMS = "a AS (SELECT source AS arm, count(*) > 60 AS gated FROM documents GROUP BY source), n AS (SELECT count(*) AS arms, count(*) FILTER (gated) AS gated FROM a)"


def _eval(rate: float) -> str:
    return f"SELECT 'eval gate' AS stage, gated * 60 * 60.0 / {rate} AS seconds FROM n UNION ALL SELECT 'eval L1', (arms * 250 - gated * 60) * 60.0 / {rate} FROM n UNION ALL SELECT 'eval second sample', arms * 250 * 60.0 / {rate} FROM n UNION ALL SELECT 'eval later rungs', arms * 250 * 3 * 60.0 / {rate} FROM n"


_FORM = "text || chr(10) || chr(10) || 'Files:' || chr(10) || '- t' || item_id || '.csv' || chr(10) || chr(10) || 'One number.'"
ORACLE = {
    "chat_commands": f"WITH {CHAT} SELECT conv_id, count(*) FILTER (role = 'assistant') AS commands, sha256(coalesce(string_agg(command, '|' ORDER BY turn) FILTER (role = 'assistant'), '')) AS sha FROM b GROUP BY conv_id",
    "chat_turns": f"WITH {CHAT} SELECT conv_id, count(*) FILTER (role = 'assistant') AS steps, count(*) FILTER (role = 'assistant' AND output IS NULL) AS open, coalesce(sum(length(output)) FILTER (role = 'assistant'), 0)::BIGINT AS chars FROM b GROUP BY conv_id",
    "chat_lean": f"""WITH {CHAT}, s AS (SELECT conv_id, kind, output, lag(kind) OVER v AS pk, lag(output) OVER v AS po FROM b WHERE role = 'assistant' AND kind <> 0 WINDOW v AS (PARTITION BY conv_id ORDER BY turn)),
        f AS (SELECT conv_id, count(*) FILTER (kind = 2 AND pk = 1 AND po = '{C.EMPTY}') AS folded FROM s GROUP BY conv_id),
        g AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS steps, count(*) FILTER (role = 'assistant' AND kind = 0) AS removed, count(*) FILTER (role <> 'assistant' AND NOT is_tool) AS head FROM b GROUP BY conv_id)
        SELECT conv_id, removed, coalesce(folded, 0) AS folded, removed + coalesce(folded, 0) AS empty, head + 2 * (steps - removed - coalesce(folded, 0)) AS messages FROM g LEFT JOIN f USING (conv_id)""",
    "chat_translated": f"""WITH {CHAT}, g AS (SELECT conv_id, bool_or(role = 'assistant' AND output IS NULL) AS open, bool_or(role = 'assistant' AND coalesce({LEAK}, false)) AS leak, count(*) FILTER (role <> 'assistant' AND NOT is_tool) + 2 * count(*) FILTER (role = 'assistant') AS m FROM b GROUP BY conv_id)
        SELECT CASE WHEN open THEN 'a call without a result' WHEN leak THEN 'an output shows the machine' ELSE 'kept' END AS refusal, count(*) AS n, coalesce(sum(m) FILTER (NOT open AND NOT leak), 0)::BIGINT AS messages FROM g GROUP BY 1""",
    "chat_audit": "SELECT count(DISTINCT conv_id) AS rows, count(*) AS segments, count(*) AS messages, count(*) FILTER (role = 'assistant') AS calls_rendered, count(*) FILTER (role = 'assistant') AS calls, 0 AS wrong, CAST(NULL AS BIGINT) AS first_wrong FROM conversations",
    "chat_renamed": f"WITH {CHAT} SELECT conv_id, 2 * count(*) FILTER (role = 'assistant') + 2 AS messages, 'echo -n ''42'' > /workdir/answer.txt' AS last, least(count(*) FILTER (role = 'assistant'), 1) AS first_answers FROM b GROUP BY conv_id",
    "chat_kinds": f"WITH {CHAT}, m AS (SELECT CASE WHEN is_tool THEN 'tool' ELSE role END AS role, CASE WHEN role = 'assistant' THEN 'tool_call' WHEN contains(coalesce(text, ''), '<tool_call>') OR contains(coalesce(text, ''), '<function=') THEN 'leaked' WHEN trim(coalesce(text, '')) <> '' OR (is_tool AND before = 1) THEN 'prose' ELSE 'empty' END AS kind FROM b) SELECT role, kind, count(*) AS n FROM m GROUP BY ALL",
    "chat_prepared": "WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) SELECT conv_id, NOT bool_or(role = 'assistant' AND i > 1) AS program, bool_or(role = 'assistant' AND i > 1) AS bash FROM o GROUP BY conv_id",
    "training_prompts": f"SELECT item_id, sha256({_FORM}) AS user, 8::BIGINT AS messages, sha256(trim(text)) AS question, sha256('cat > solution.py << ''EOF''' || chr(10) || regexp_replace(text, '\\n+$', '') || chr(10) || 'EOF') AS wrote FROM benchmark",
    "tool_results": f"SELECT doc_id, sha256(CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN '{C.EMPTY}' WHEN length(text) > 8000 THEN substr(text, 1, 8000) || chr(10) || '... [output truncated]' ELSE text END) AS shown, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 0 ELSE least(length(text), 8000) END AS chars, length(coalesce(text, '')) > 8000 AS cut FROM documents",
    "transcript_settled": f"WITH {CHAT} SELECT conv_id, 2 * count(*) AS messages, sha256(string_agg(CASE WHEN nxt = 'user' THEN coalesce(reply, '') ELSE '' END, '|' ORDER BY turn)) AS outputs FROM b WHERE role = 'assistant' GROUP BY conv_id",
    "recorded_replies": """WITH o AS (SELECT *, role = 'user' AND coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') = 'assistant' AS is_tool FROM conversations),
        q AS (SELECT conv_id, trim(regexp_replace(regexp_replace(lower(trim(arg_min(text, turn) FILTER (role = 'user' AND NOT is_tool))), '[$`\\\\*_>]+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS n, count(*) FILTER (role = 'assistant') AS k FROM o GROUP BY conv_id),
        m AS (SELECT conv_id, n, k, row_number() OVER (PARTITION BY n ORDER BY k = 0 DESC) AS i, bool_or(k = 0) OVER (PARTITION BY n) AS nothing FROM q WHERE n <> '') SELECT conv_id, NOT nothing AS found FROM m""",
    "row_tokens": "SELECT conv_id, sum(ceil(length(coalesce(text, '')) / 4) + 8)::BIGINT AS tokens FROM conversations GROUP BY conv_id",
    "catalogue_splits": "WITH k AS (SELECT DISTINCT doc_id FROM labels), r AS (SELECT 'labelled' AS split, NULL AS lang FROM k UNION ALL SELECT 'all', lang FROM (SELECT doc_id, min(lang) AS lang FROM documents GROUP BY doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM k)) SELECT split, count(*) AS n, count(lang) AS langs FROM r GROUP BY split",
    "trace_reasons": f"WITH {TRIALS} SELECT CASE WHEN task NOT IN (SELECT c_custkey FROM customer) THEN 'unknown task' WHEN task IN (SELECT r_regionkey FROM region) THEN 'held out' WHEN NOT finished THEN 'not finished' WHEN NOT passed THEN 'not passed' WHEN sample = 0 THEN 'no transcript' ELSE 'kept' END AS reason, count(*) AS n FROM t GROUP BY 1",
    "fallback_reasons": "SELECT CASE WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10) THEN 'not in the pool' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'already exported' WHEN trim(coalesce(o_orderstatus, '')) = '' THEN 'no verified value' ELSE 'kept' END AS reason, count(*) AS n FROM orders GROUP BY 1",
    "rung_rows": f"WITH {TRIALS}, x AS (SELECT DISTINCT task FROM t WHERE task NOT IN (SELECT r_regionkey FROM region)), h AS (SELECT DISTINCT task FROM t WHERE passed AND rung = 'L4') SELECT rung, count(*) AS n FROM x, (VALUES ('L1'), ('L2'), ('L3'), ('L4')) r(rung) WHERE rung = 'L1' OR task IN (SELECT task FROM h) GROUP BY rung",
    "failed_everywhere": f"WITH {TRIALS} SELECT task || ':' || rung || ':' || sample AS key FROM t WHERE finished GROUP BY task, rung, sample HAVING NOT max(passed)",
    "promoted_attempts": f"WITH {TRIALS} SELECT task, min(event_id) AS event_id, arg_min(rung, event_id) AS rung FROM t WHERE finished AND passed GROUP BY task",
    "side_records": f"WITH {TRIALS} SELECT rung, count(*) AS checked, 0::BIGINT AS recovered, count(*) FILTER (finished AND passed <> (sample > 5)) AS changed, count(*) FILTER (NOT finished) AS failed, sum(CASE WHEN sample > 5 THEN 3 ELSE 1 END)::BIGINT AS attempts FROM t WHERE prediction = 1 GROUP BY rung",
    "valid_hints": "SELECT count(*) AS tasks, count(*) FILTER (toxic <> 1 AND quality <> 0) AS hints, count(*) FILTER (toxic IS NULL OR toxic = 1) AS to_generate FROM documents LEFT JOIN labels USING (doc_id)",
    "aligned_exports": "WITH j AS (SELECT a.l_returnflag AS x, b.l_returnflag AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2) SELECT count(*) AS both, count(*) FILTER (x = y) AS same, round(count(*) FILTER (x = y) / count(*), 6) AS share, count(*) FILTER (x = y) / count(*) >= 0.99 AS accepted FROM j",
    "common_tasks": f"WITH {TRIALS} SELECT task FROM t WHERE sample IN (1, 2, 3) AND task NOT IN (SELECT task FROM t WHERE rung = 'L1' AND sample = 9) GROUP BY task HAVING count(DISTINCT sample) = 3",
    "reclaimed": f"WITH g AS (SELECT user_id, max(epoch_us(ts) / 1000000.0) AS start, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id) SELECT user_id FROM g WHERE (last = 'error' OR user_id NOT IN (SELECT user_id FROM events WHERE value > 50)) AND {NOW} - start >= CASE WHEN last = 'error' THEN 900 ELSE 120 END",
    "model_blockers": """WITH g AS (SELECT user_id, arg_max(event_type <> 'error', event_id) AS differs, arg_max(value > 5, event_id) AS calls_ok, arg_max(floor(value), event_id) FILTER (value > 2) AS tensors FROM events GROUP BY user_id)
        SELECT CASE WHEN tensors IS NULL THEN 'no merge report' WHEN tensors = 0 THEN 'merge changed nothing' WHEN NOT differs THEN 'answers as the base does' WHEN NOT calls_ok THEN 'no tool call came back' ELSE 'ready' END AS reason, count(*) AS n FROM g GROUP BY 1""",
    "counted_sets": "WITH t AS (SELECT lang, ceil(length(coalesce(text, '')) / 4)::BIGINT AS n FROM documents), g AS (SELECT lang, count(*) AS rows, sum(n)::BIGINT AS raw, sum(least(n, 500))::BIGINT AS kept FROM t GROUP BY lang) SELECT * FROM g UNION ALL SELECT string_agg(lang, '+' ORDER BY lang), sum(rows)::BIGINT, sum(raw)::BIGINT, sum(kept)::BIGINT FROM g",
    "session_projection": f"WITH {ARMS}, r AS (SELECT 'boot' AS stage, 120.0::DOUBLE AS seconds UNION ALL SELECT 'bootstrap', 720.0 UNION ALL SELECT 'train ' || lang, sum(length(coalesce(text, ''))) / 4600.0 * 1.15 + 150 FROM documents GROUP BY lang UNION ALL {_eval(22.0)}) SELECT stage, round(seconds::DOUBLE, 6) AS seconds, round(seconds::DOUBLE / 3600 * 2, 6) AS dollars FROM r",
    "session_range": f"WITH {ARMS}, e AS ({_eval(20.0)}), t AS (SELECT sum(length(coalesce(text, ''))) / 4600.0 * 1.15 + 150 AS s FROM documents GROUP BY lang), s AS (SELECT sum(seconds)::DOUBLE AS ev, 900 + (SELECT sum(s) FROM t)::DOUBLE AS rest FROM e) SELECT round((ev + rest) / 1800, 6) AS total, round((ev * 0.7 + rest) / 1800, 6) AS low, round((ev * 1.3 + rest) / 1800, 6) AS high, ceil(least(3000000, (ev + rest) * 1.25 / 60 + 15))::BIGINT AS minutes FROM s",
    "machine_dollars": f"SELECT round(sum(greatest(0, {NOW} - epoch(date_trunc('second', ts))) / 3600 * CASE WHEN value > 10 THEN value ELSE 3.0 END) FILTER (event_type <> 'error'), 6) AS dollars FROM events",
    "judged_criteria": "WITH j AS (SELECT lang, quality, toxic FROM labels JOIN documents USING (doc_id)), e AS (SELECT lang, 'quality' AS criterion, quality AS y FROM j UNION ALL SELECT lang, 'toxic', toxic FROM j) SELECT lang, criterion, count(*) FILTER (y = 1) AS yes, count(y) AS n, round(avg(y), 6) AS rate FROM e GROUP BY ALL",
    "verdict_flips": "WITH g AS (SELECT o_orderpriority, o_orderstatus = 'F' AS a, o_totalprice > 100000 AS b FROM orders) SELECT o_orderpriority, count(*) AS rows, count(*) FILTER (a) AS strict, count(*) FILTER (b) AS other, count(*) FILTER (b AND NOT a) AS gained, count(*) FILTER (a AND NOT b) AS lost FROM g GROUP BY 1",
    "download_coverage": "WITH n AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS f FROM lineitem), h AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS f, 1 AS x FROM lineitem WHERE l_quantity < 40), g AS (SELECT k, count(*) FILTER (x IS NULL) AS missing FROM n LEFT JOIN h USING (k, f) GROUP BY k), c AS (SELECT s.s_suppkey AS b FROM g LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) s ON s.s_suppkey = k WHERE missing > 0) SELECT count(*) AS datasets, count(b) AS priced, count(*) FILTER (b IS NULL) AS unpriced, coalesce(sum(b), 0)::BIGINT AS bytes FROM c",
    "submission_idioms": f"WITH {CHAT}, l AS (SELECT arg_max(kind, turn) AS k FROM b WHERE role = 'assistant' GROUP BY conv_id) SELECT CASE k WHEN 1 THEN 'heredoc' WHEN 3 THEN 'other' ELSE 'python' END AS idiom, count(*) AS n FROM l GROUP BY 1",
    "model_stats": f"WITH {TRIALS} SELECT rung, count(*) FILTER (finished) AS clean, 100000 - count(*) FILTER (finished) AS failures, count(*) FILTER (finished AND passed) AS passes, count(*) FILTER (finished AND event_id > 100) AS answered FROM t GROUP BY rung",
    "overlaid_trials": f"WITH {TRIALS}, o AS (SELECT *, NOT finished AND sample > 3 AND prediction > 0 AS back FROM t) SELECT rung, count(*) FILTER (finished OR back) AS finished, count(*) FILTER (CASE WHEN back THEN prediction >= 1 ELSE passed END) AS passed FROM o GROUP BY rung",
    "same_values": "WITH p AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS x FROM orders) SELECT o_orderkey, abs(x - round(x, 0)) <= greatest(1e-4, 1e-4 * abs(x)) AS near, true AS plain FROM p",
    "verdicts": "SELECT doc_id, CASE WHEN doc_id > 50 THEN quality = 1 END AS answerable, CAST(NULL AS BOOLEAN) AS unambiguous, CASE WHEN doc_id > 50 THEN 'r' ELSE '' END AS reason, CASE WHEN doc_id > 50 THEN NULL ELSE 'no object in reply' END AS error FROM labels",
    "sql_facts": "SELECT o_orderkey, 'o_orderkey = ' || o_orderkey || '|o_orderstatus = ''' || o_orderstatus || '''' AS predicates FROM orders",
    "fenced_code": "SELECT conv_id, turn, sha256('print(''' || substr(text, 1, 20) || ''')') AS code, turn::VARCHAR AS answer, true AS command FROM conversations WHERE text NOT LIKE '%`%'",
}
