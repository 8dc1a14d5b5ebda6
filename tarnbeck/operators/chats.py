"""Conversations as training rows: arrays of messages with tool calls, built, taken apart, rewritten, checked and rendered.

A message is struct<role, content, calls array<struct<id, name, arguments>>, answers>; arguments are JSON text, answers is the
id of the call that a tool message answers. Everything is a Column expression over one row's messages, so none of it
shuffles; only transcripts that come as single events are grouped, by conversation.

Nulls count as empty texts and empty arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbeck.functions import text as T

# ---- fixed values: marks, paths and limits of the formats ----
CALLS = "array<struct<id:string,name:string,arguments:string>>"
MESSAGE = f"struct<role:string,content:string,calls:{CALLS},answers:string>"
STEP = "struct<turn:int,id:string,command:string,output:string>"
EMPTY = "(empty output, rc=0)"
TIMED_OUT = "[shell_exec] error: RuntimeError: Command timed out after"
CUT = "\n... [output truncated]"
TOOL = "bash"
INPUT, WORK, ANSWER = "/home/user/input", "/workdir", "/workdir/answer.txt"
SUBMISSION = r"(?s)^echo -n (['\"])(.*)\1 > /workdir/answer\.txt$"
WRITES = r"^cat > /workdir/solution\.py << ?'EOF"
RUNS = r"^[^\n]*\bpython3? (?:/workdir/)?solution\.py[^\n]*$"
LEAKED = ("<tool_call>", "<function=")
#: Ways to name the input folder, with what each becomes; the last two are for commands only.
INPUT_RULES = (
    (r"(?<![\w/.\-])(?:\./)?input(?=/)", INPUT), (r"(?<![\w/.\-])\./input(?![\w/.\-])", INPUT),
    (r"((?<![=!<>])[(=]\s*)(['\"])input\2", f"$1$2{INPUT}$2"), (r"(?m)(\b(?:cd|ls|du|tree|find|stat|file)\b(?:\s+-\S+)*\s+)input(?=\s|$|[;&|)])", f"$1{INPUT}"),
)
# --------------------------------------------------------------


def none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def message(role: str, content: Column, calls: Column | None = None, answers: Column | None = None) -> Column:
    return F.struct(
        F.lit(role).alias("role"), T.text(content).alias("content"),
        (F.array().cast(CALLS) if calls is None else calls.cast(CALLS)).alias("calls"), (F.lit(None) if answers is None else answers).cast("string").alias("answers"),
    )


def call(id_: Column, command: Column) -> Column:
    """A call of the shell tool."""
    return F.struct(id_.cast("string").alias("id"), F.lit(TOOL).alias("name"), F.to_json(F.struct(command.alias("command"))).alias("arguments"))


def call_id(row: Column, n: Column) -> Column:
    """A stable id of a row's n-th call."""
    return F.concat(F.lit("chatcmpl-tool-"), F.substring(F.sha1(F.concat_ws(":", row.cast("string"), n.cast("string"))), 1, 16))


def arguments(one: Column) -> Column:
    """A call's arguments as a map; what is no JSON object is empty."""
    return F.coalesce(F.from_json(one["arguments"], "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def command_of(one: Column) -> Column:
    return T.text(F.get_json_object(one["arguments"], "$.command"))


def commands(messages: Column) -> Column:
    """Commands of all assistant turns, in order."""
    own = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.flatten(F.transform(own, lambda m: F.transform(F.coalesce(m["calls"], none(CALLS[6:-1])), command_of)))


def is_version_check(command: Column) -> Column:
    has = lambda s: F.contains(command, F.lit(s))
    return has("__version__") & ~has(INPUT) & ~has("solution.py") & ~has("<<")


def heredoc(path: str, code: Column) -> Column:
    """A command that writes code to a path; the mark is the first of EOF, EOF_1, ... that is no line of it."""
    lines = F.split(code, "\n")
    mark = lambda k: F.when(k == 0, "EOF").otherwise(F.concat(F.lit("EOF_"), k.cast("string")))
    free = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.size(lines)), mark), lambda m: ~F.array_contains(lines, m)), F.lit(0))
    return F.concat(F.lit(f"cat > {path} << '"), free, F.lit("'\n"), F.regexp_replace(code, r"\n+$", ""), F.lit("\n"), free)


def shell_turn(command: Column, output: Column, id_: Column) -> Column:
    """An assistant turn that calls the shell, and the tool's answer."""
    return F.array(message("assistant", F.lit(""), F.array(call(id_, command))), message("tool", output, answers=id_))


def submission_command(value: Column) -> Column:
    """Writes an answer that is not empty and has no line end, else null."""
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when((F.trim(T.text(value)) != "") & ~F.contains(value, F.lit("\n")), F.concat(F.lit("echo -n "), quoted, F.lit(f" > {ANSWER}")))


def submission_turn(value: Column) -> Column:
    return shell_turn(submission_command(value), F.lit(EMPTY), F.lit("call_submit"))


def closing_turn(text: Column) -> Column:
    return message("assistant", text)


def fallback_turns(code: Column, value: Column, opening: str = "I'll write a program that computes the answer.", closing: str = f"The answer is written to {ANSWER}.") -> Column:
    """What is known without a trace: the program is written, its value submitted, and nothing else claimed."""
    wrote = shell_turn(heredoc("solution.py", code), F.lit(EMPTY), F.lit("call_write"))
    return F.concat(F.array(message("assistant", F.lit(opening))), wrote, submission_turn(value), F.array(closing_turn(F.lit(closing))))


def program_turns(prompt: Column, code: Column, value: Column) -> Column:
    """A question and its answer as one fenced program, with the value that it prints."""
    reply = F.concat(F.lit("```python\n"), F.regexp_replace(code, r"\n+$", ""), F.lit("\n```\n\nIt prints: "), T.text(value))
    return F.array(message("user", prompt), message("assistant", reply))


def listing(files: Column, otherwise: str = f"- No file names are given; list {INPUT} first.") -> Column:
    """One line for each file."""
    return F.when(F.size(F.coalesce(files, none("string"))) > 0, F.array_join(F.transform(files, lambda f: F.concat(F.lit("- "), f)), "\n")).otherwise(otherwise)


def prompt(question: Column, files: Column, system: str, form: str, answer_format: Column | None = None) -> Column:
    """System and user message; form holds {question}, {files} and {format}."""
    body = F.lit(form)
    for name, value in (("{format}", T.text(F.lit("") if answer_format is None else answer_format)), ("{files}", listing(files)), ("{question}", T.text(question))):
        body = F.replace(body, F.lit(name), value)
    return F.array(message("system", F.lit(system)), message("user", body))


def training_row(opening: Column, turns: Column) -> Column:
    """struct<messages, tools>: an opening and turns; assistant turns that neither say nor call anything go."""
    said = F.filter(turns, lambda m: (m["role"] != "assistant") | (m["content"] != "") | (F.size(m["calls"]) > 0))
    uses = F.exists(said, lambda m: F.size(m["calls"]) > 0)
    return F.struct(F.concat(opening, said).alias("messages"), F.when(uses, F.array(F.lit(TOOL))).otherwise(none("string")).alias("tools"))


def prepared(messages: Column, tools: Column, protocol: str) -> Column:
    """What a trainer reads: program: roles and contents of rows without tools; bash: all of it; null where a row does not fit."""
    if protocol not in ("program", "bash"):
        raise ValueError(f"unknown protocol {protocol!r}")
    plain = F.size(tools) == 0
    fits = plain if protocol == "program" else ~plain
    return F.when(fits & (F.size(messages) > 0), F.struct(messages.alias("messages"), tools.alias("tools")))


def between(text: Column, before: str, after: str) -> Column:
    """What stands between two patterns, trimmed; empty where they are not found."""
    return F.trim(F.regexp_extract(T.text(text), f"(?s){before}(.*?){after}", 1))


def question_of(messages: Column, before: str = "", after: str = r"(?:\n\n|$)") -> Column:
    """The question in the first user message."""
    first = F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"]
    return between(first, before, after)


def tool_result(output: Column, code: Column, timed_out: Column, seconds: int = 120, limit: int = T.MAX_OUTPUT) -> Column:
    """What a model is shown of a command's result."""
    cut = F.when(F.length(output) > limit, F.concat(F.substring(output, 1, limit), F.lit(CUT))).otherwise(output)
    nothing = F.concat(F.lit("(empty output, rc="), code.cast("string"), F.lit(")"))
    return F.when(timed_out, f"{TIMED_OUT} {seconds} seconds").when(F.trim(output) == "", nothing).otherwise(cut)


def recorded_result(content: Column) -> Column:
    """struct<output, code, timed_out, cut>: a result of which tool_result would show this."""
    code = F.regexp_extract(content, r"^\(empty output, rc=(-?\d+)\)$", 1)
    late, cut = content.startswith(TIMED_OUT), content.endswith(CUT)
    body = F.when((code != "") | late, "").when(cut, F.substr(content, F.lit(1), F.length(content) - len(CUT))).otherwise(content)
    return F.struct(body.alias("output"), F.when(late, -1).when(code != "", code.cast("int")).otherwise(0).alias("code"), late.alias("timed_out"), cut.alias("cut"))


def replays(messages: Column) -> Column:
    """How many tool messages are not what tool_result shows of the result they record."""

    def differs(m: Column) -> Column:
        r = recorded_result(m["content"])
        shown = tool_result(F.concat(r["output"], F.when(r["cut"], F.repeat(F.lit("z"), 500)).otherwise("")), r["code"], r["timed_out"])
        return ~r["timed_out"] & (shown != m["content"])

    return F.size(F.filter(messages, lambda m: (m["role"] == "tool") & differs(m)))


def message_kind(m: Column) -> Column:
    """tool_call, leaked (a call's mark as plain text), prose or empty."""
    calls = F.exists(F.coalesce(m["calls"], none(CALLS[6:-1])), lambda c: (c["name"] == TOOL) & F.get_json_object(c["arguments"], "$.command").isNotNull())
    marks = [F.contains(T.text(m["content"]), F.lit(x)) for x in LEAKED]
    return F.when(calls, "tool_call").when(marks[0] | marks[1], "leaked").when(F.trim(T.text(m["content"])) != "", "prose").otherwise("empty")


def turns(messages: Column) -> Column:
    """array<struct<content, steps array<STEP>>>: each assistant turn with its calls and their last answers.

    Answers without a call go; a call without an answer has a null output; turns that neither say nor call anything go.
    """
    told = F.filter(messages, lambda m: m["role"] == "tool")
    # of answers to one call the last counts
    output = lambda id_: F.get(F.reverse(F.filter(told, lambda m: m["answers"] == id_)), F.lit(0))["content"]
    own = F.filter(messages, lambda m: (m["role"] == "assistant") & ((F.trim(m["content"]) != "") | (F.size(m["calls"]) > 0)))
    step = lambda c, i: F.struct(i.cast("int").alias("turn"), c["id"].alias("id"), command_of(c).alias("command"), output(c["id"]).alias("output"))
    return F.transform(own, lambda m, i: F.struct(m["content"].alias("content"), F.transform(m["calls"], lambda c: step(c, i)).alias("steps")))


def messages_of(taken: Column) -> Column:
    """turns() put together again: an assistant message for each turn, then its answers."""

    def again(t: Column) -> Column:
        calls = F.transform(t["steps"], lambda s: call(s["id"], s["command"]))
        return F.concat(F.array(message("assistant", t["content"], calls)), F.transform(t["steps"], lambda s: message("tool", s["output"], answers=s["id"])))

    return F.flatten(F.transform(taken, again))


def renamed(messages: Column, stop: Column, value: Column, clean: Callable[[Column], Column] = T.scrub) -> Column:
    """The messages up to `stop` as turns with ids by place, without `cd . &&`, cleaned, and with the submission."""
    bare = lambda c: F.regexp_replace(c, r"^cd \./?\s*&&\s*", "")
    named = lambda s, j: F.struct(s["turn"].alias("turn"), F.concat_ws("_", F.lit("call"), s["turn"].cast("string"), j.cast("string")).alias("id"), bare(clean(s["command"])).alias("command"), clean(T.text(s["output"])).alias("output"))
    kept = turns(F.slice(messages, F.lit(1), F.greatest(stop + 1, F.lit(0)).cast("int")))
    return F.concat(messages_of(F.transform(kept, lambda t: F.struct(clean(t["content"]).alias("content"), F.transform(t["steps"], named).alias("steps")))), submission_turn(value))


def answered_inline(taken: Column, value: Column) -> Column:
    """Whether a Python command before the first program that is written already ends its output with the answer."""
    steps = F.flatten(F.transform(taken, lambda t: t["steps"]))
    writes = F.array_position(F.transform(steps, lambda s: s["command"].rlike(WRITES)), True)
    before = F.when(writes > 0, F.slice(steps, F.lit(1), F.greatest(writes - 1, F.lit(0)).cast("int"))).otherwise(steps)
    return F.exists(before, lambda s: F.contains(s["command"], F.lit("python")) & (T.last_line(s["output"]) == F.trim(value)) & (F.trim(value) != ""))


def lean(messages: Column) -> Column:
    """struct<messages, removed, folded, empty>: the conversation without steps that do nothing.

    `cd . &&` goes from commands, version checks and failed `cd /app` go as steps; a program that is written and at once run is
    one step; of turns that lose all their steps the prose moves on to the next turn that has none.
    """
    head, tail = F.filter(messages, lambda m: m["role"].isin("system", "user")), F.filter(messages, lambda m: (m["role"] == "assistant") & (F.size(m["calls"]) == 0))
    taken = F.filter(turns(messages), lambda t: F.size(t["steps"]) > 0)
    bare = lambda s: F.struct(s["id"].alias("id"), F.regexp_replace(s["command"], r"^cd \. && ", "").alias("command"), T.text(s["output"]).alias("output"))
    idle = lambda s: is_version_check(s["command"]) | (s["command"].rlike(r"^cd /app\b") & F.contains(s["output"], F.lit("cd: /app: No such file or directory")))
    all_ = F.flatten(F.transform(taken, lambda t, i: F.transform(t["steps"], lambda s: F.struct(i.cast("int").alias("turn"), *(bare(s)[c].alias(c) for c in ("id", "command", "output"))))))
    steps = F.filter(all_, lambda s: ~idle(s))

    def fold(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joins = F.coalesce(last["command"].rlike(WRITES) & (last["output"] == EMPTY) & s["command"].rlike(RUNS), F.lit(False))
        both = F.struct(last["turn"].alias("turn"), last["id"].alias("id"), F.concat_ws("\n", last["command"], F.trim(s["command"])).alias("command"), s["output"].alias("output"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(s)))

    folded = F.aggregate(steps, none(STEP), fold)

    def regroup(acc: Column, t: Column) -> Column:
        own = F.filter(folded, lambda s: s["turn"] == t["i"])
        gone = F.struct(F.when(acc["carried"] == "", t["content"]).otherwise(acc["carried"]).alias("carried"), acc["out"].alias("out"), (acc["empty"] + 1).alias("empty"))
        said = F.when(t["content"] == "", acc["carried"]).otherwise(t["content"])
        kept = F.struct(F.lit("").alias("carried"), F.concat(acc["out"], F.array(F.struct(said.alias("content"), own.alias("steps")))).alias("out"), acc["empty"].alias("empty"))
        return F.when(F.size(own) == 0, gone).otherwise(kept)

    start = F.struct(F.lit("").alias("carried"), none(f"struct<content:string,steps:array<{STEP}>>").alias("out"), F.lit(0).alias("empty"))
    made = F.aggregate(F.transform(taken, lambda t, i: F.struct(i.cast("int").alias("i"), t["content"].alias("content"))), start, regroup)
    return F.struct(F.concat(head, messages_of(made["out"]), tail).alias("messages"), (F.size(all_) - F.size(steps)).alias("removed"), (F.size(steps) - F.size(folded)).alias("folded"), made["empty"].alias("empty"))


def world_text(text: Column, scratch: Column, command: bool = False) -> Column:
    """struct<text, work, input>: a recorded text as the sandbox spells it, with the number of paths that were rewritten.

    scratch: the recording's own folder of the row, as plain text.
    """
    t = T.text(text)
    hits = F.when(scratch != "", F.size(F.split(t, F.concat(F.lit(r"\Q"), scratch, F.lit(r"\E")), -1)) - 1).otherwise(0)
    out, count = F.when(scratch != "", F.replace(t, scratch, F.lit(WORK))).otherwise(t), F.lit(0)
    for pattern, target in INPUT_RULES if command else INPUT_RULES[:2]:
        count = count + F.regexp_count(out, F.lit(pattern))
        out = F.regexp_replace(out, pattern, target)
    return F.struct(out.alias("text"), hits.alias("work"), count.alias("input"))


def environment_leaks(text: Column, is_listing: Column) -> Column:
    """What would be false in the sandbox: marks of the recording machine, of its linked input folder, of its scratch folder."""
    t = T.text(text)
    return F.concat(T.machine_leaks(t), T.compact(F.when(t.rlike(r"\binput -> "), F.lit("symlinked input listing")), F.when(is_listing & t.rlike(r"(?m)^input$"), F.lit("scratch directory listing"))))


def translated(messages: Column, scratch: Column) -> Column:
    """struct<messages, refusal>: commands and outputs as the sandbox spells them; null messages where the result would be false.

    Refused, in this order: a call without an answer, a call of another tool, an output that still shows the machine.
    """
    world = lambda c, command: world_text(c, scratch, command)["text"]
    taken = F.transform(turns(messages), lambda t: F.struct(world(t["content"], False).alias("content"), F.transform(t["steps"], lambda s: F.struct(
        s["turn"].alias("turn"), s["id"].alias("id"), world(s["command"], True).alias("command"), F.when(s["output"].isNotNull(), world(s["output"], False)).alias("output"))).alias("steps")))
    steps = F.flatten(F.transform(taken, lambda t: t["steps"]))
    is_listing = lambda s: s["command"].rlike(r"(?m)(?<![\w/.\-])ls(?=\s*(?:$|[;&|)]))")
    refusal = F.coalesce(
        F.when(F.exists(steps, lambda s: s["output"].isNull()), "a call without a result"),
        F.when(F.exists(F.flatten(F.transform(messages, lambda m: m["calls"])), lambda c: c["name"] != TOOL), "a call of another tool"),
        F.when(F.exists(steps, lambda s: F.size(environment_leaks(s["output"], is_listing(s))) > 0), "an output shows the machine"),
    )
    head = F.filter(messages, lambda m: m["role"].isin("system", "user"))
    return F.struct(F.when(refusal.isNull(), F.concat(head, messages_of(taken))).alias("messages"), refusal.alias("refusal"))


def marks_in(messages: Column, marks: Column, roles: tuple[str, ...] = ("system", "user")) -> Column:
    """Those of the marks (array of texts) that the messages of the roles hold."""
    said = F.array_join(F.transform(F.filter(messages, lambda m: m["role"].isin(*roles)), lambda m: T.text(m["content"])), "\n")
    return F.filter(marks, lambda x: (x != "") & F.contains(said, x))


def rendered(messages: Column, start: str = "<|im_start|>", stop: str = "<|im_end|>") -> Column:
    """The messages as one text: a marked segment each, calls as tagged JSON."""
    tagged = lambda c: F.concat(F.lit("\n<tool_call>\n"), F.to_json(F.struct(c["name"].alias("name"), c["arguments"].alias("arguments"))), F.lit("\n</tool_call>"))
    one = lambda m: F.concat(F.lit(start), m["role"], F.lit("\n"), T.text(m["content"]), F.array_join(F.transform(m["calls"], tagged), ""), F.lit(stop + "\n"))
    return F.array_join(F.transform(messages, one), "")


def audit(messages: Column, text: Column, start: str = "<|im_start|>") -> Column:
    """struct<segments, messages, calls_rendered, calls, texts_missing>: whether a rendered text holds all of its messages."""
    occurrences = lambda mark: F.size(F.split(text, rf"\Q{mark}\E", -1)) - 1
    missing = F.size(F.filter(messages, lambda m: (T.text(m["content"]) != "") & ~F.contains(text, m["content"])))
    return F.struct(occurrences(start).alias("segments"), F.size(messages).alias("messages"), occurrences("<tool_call>\n").alias("calls_rendered"), F.size(F.flatten(F.transform(messages, lambda m: m["calls"]))).alias("calls"), missing.alias("texts_missing"))


def audit_rows(rows: DataFrame, key: str, messages: str = "messages", text: str = "rendered") -> DataFrame:
    """One row: sums over rows (key, messages, text), how many are wrong, the least key of those."""
    each = rows.select(F.col(key).alias("key"), audit(F.col(messages), F.col(text)).alias("a")).select("key", "a.*")
    wrong = (F.col("segments") != F.col("messages")) | (F.col("calls_rendered") != F.col("calls")) | (F.col("texts_missing") > 0)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("segments", "messages", "calls_rendered", "calls")]
    return each.agg(F.count("*").alias("rows"), *sums, F.count_if(wrong).alias("wrong"), F.min(F.when(wrong, F.col("key"))).alias("first_wrong"))


def checked(rows: DataFrame, key: str, messages: str = "messages", text: str = "rendered") -> DataFrame:
    """rows, whose reading fails at a row whose rendered text lacks a segment or a call."""
    a = audit(F.col(messages), F.col(text))
    fine = (a["segments"] == a["messages"]) & (a["calls_rendered"] == a["calls"])
    return rows.where(F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("not rendered as it stands: "), F.col(key).cast("string"))).cast("boolean")))


def transcript_turns(events: DataFrame, conv: str = "conv_id", seq: str = "seq", value: str = "value") -> DataFrame:
    """(conv, messages) from an event stream as JSON lines (conv, seq, value); lines that are no event are passed over.

    Only settled events count: the end of a message, and of a call's updates the last that shows anything. Calls stand
    where they first came up; a closing text goes with the last call before it.
    """
    block = "struct<type:string,text:string,id:string,input:struct<command:string>>"
    kind = f"struct<event:struct<type:string,toolCallId:string,content:array<{block}>,partial:array<struct<type:string,text:string>>>>"
    e = events.select(conv, seq, F.from_json(value, kind)["event"].alias("e")).where("e.type in ('message_end', 'tool_update')")
    words = lambda blocks, sep: F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (T.text(b["text"]) != "")), lambda b: b["text"]), sep)
    uses = F.filter("e.content", lambda b: (b["type"] == "tool_use") & b["id"].isNotNull())
    ended = e.where("e.type = 'message_end'").select(conv, seq, uses.alias("uses"), words(F.col("e.content"), "\n\n").alias("said"))
    made = ended.select(conv, seq, F.posexplode("uses").alias("at", "u")).groupBy(conv, F.col("u.id").alias("id")).agg(F.min(F.struct(seq, "at")).alias("first"), F.max_by(T.text(F.col("u.input.command")), F.struct(seq, "at")).alias("command"))
    shown = e.where("e.type = 'tool_update'").select(conv, seq, F.col("e.toolCallId").alias("id"), words(F.col("e.partial"), "").alias("output")).where("output <> ''").groupBy(conv, "id").agg(F.max_by("output", seq).alias("output"))
    steps = made.join(shown, [conv, "id"], "left").select(conv, F.col(f"first.{seq}").alias(seq), F.col("first.at").alias("at"), shell_turn(F.col("command"), F.col("output"), F.col("id")).alias("messages"))
    closing = ended.where((F.size("uses") == 0) & (F.col("said") != "")).select(conv, seq, F.lit(-1).alias("at"), F.array(closing_turn(F.col("said"))).alias("messages"))
    parts = F.sort_array(F.collect_list(F.struct(seq, "at", "messages")))
    return steps.unionByName(closing).groupBy(conv).agg(F.flatten(parts["messages"]).alias("messages"))


def recorded_reply(rows: DataFrame, asked: DataFrame, question: str = "question", files: str = "files") -> DataFrame:
    """asked (question, files, done) with reply: the next assistant message of the recorded row (question, files, messages) that is asked for.

    Of rows with the same question the one with the same files counts, else the one whose files come first; null beyond its end.
    """
    said = rows.select(T.normalise_question(F.col(question)).alias("__q"), F.array_sort(files).alias("__f"), F.filter("messages", lambda m: m["role"] == "assistant").alias("__m"))
    one = said.groupBy("__q", "__f").agg(F.min("__m").alias("__m"))
    any_ = one.groupBy("__q").agg(F.min_by("__m", "__f").alias("__any"))
    mine = asked.withColumns({"__q": T.normalise_question(F.col(question)), "__f": F.array_sort(files)})
    both = mine.join(one, ["__q", "__f"], "left").join(any_, "__q", "left")
    return both.select(*asked.columns, F.get(F.coalesce("__m", "__any"), F.col("done")).alias("reply"))
