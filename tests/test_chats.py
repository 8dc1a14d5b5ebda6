"""Training rows and their rewriting against literal conversations."""

import json

import pytest
from pyspark.sql import functions as F

from tarnbeck.operators import chats as C

EMPTY = C.EMPTY


def say(role, content="", calls=(), answers=None):
    return (role, content, [(i, "bash", json.dumps({"command": c})) for i, c in calls], answers)


def rows(spark, *conversations):
    return spark.createDataFrame([(i, m) for i, m in enumerate(conversations)], f"id long, m {C.MESSAGE.join(['array<', '>'])}")


WRITE = "cat > /workdir/solution.py << 'EOF'\nprint(5)\nEOF"
CHAT = [
    say("system", "s"), say("user", "q"),
    say("assistant", "look", [("a", "cd . && ls input")]), say("tool", "t.csv", answers="a"),
    say("assistant", "check", [("b", "python3 -c 'import x; print(x.__version__)'")]), say("tool", "1", answers="b"),
    say("assistant", "", [("c", WRITE)]), say("tool", EMPTY, answers="c"),
    say("assistant", "", [("d", "python3 solution.py")]), say("tool", "5", answers="d"),
    say("assistant", "", [("e", "cd /app && ls")]), say("tool", "sh: cd: /app: No such file or directory", answers="e"),
    say("assistant", "done"),
]


def test_lean(spark):
    out = rows(spark, CHAT, [], CHAT[:2]).select("id", C.lean(F.col("m")).alias("l")).orderBy("id").collect()
    l = out[0].l
    assert (l.removed, l.folded, l.empty) == (2, 1, 3)
    assert [m.role for m in l.messages] == ["system", "user", "assistant", "tool", "assistant", "tool", "assistant"]
    commands = [json.loads(c.arguments)["command"] for m in l.messages for c in m.calls]
    assert commands == ["ls input", WRITE + "\npython3 solution.py"]
    # the prose of the step that went moves to the next turn without any
    assert [m.content for m in l.messages if m.role == "assistant"] == ["look", "check", "done"] and [m.content for m in l.messages if m.role == "tool"] == ["t.csv", "5"]
    assert out[1].l.messages == [] and len(out[2].l.messages) == 2


def test_turns(spark):
    odd = [say("assistant", "", [("x", "ls"), ("y", "pwd")]), say("tool", "1", answers="x"), say("tool", "2", answers="x"), say("tool", "?", answers="zz"), say("assistant", " "), ("assistant", None, None, None)]
    t, = rows(spark, odd).select(C.turns(F.col("m")).alias("t")).first()
    assert [[(s.id, s.command, s.output) for s in x.steps] for x in t] == [[("x", "ls", "2"), ("y", "pwd", None)]]
    assert rows(spark, odd).select(C.commands(F.col("m"))).first()[0] == ["ls", "pwd"]
    assert rows(spark, []).select(C.turns(F.col("m"))).first()[0] == []


def test_translation(spark):
    fine = [say("user", "q"), say("assistant", "", [("a", "ls input; cat ./input/t.csv")]), say("tool", "see /var/scratch/7/input/t.csv", answers="a")]
    open_, other = fine[:2], [fine[0], ("assistant", "", [("a", "read", "{}")], None), fine[2]]
    leak = [*fine[:2], say("tool", "in /home/alice/x", answers="a")]
    got = [r.t for r in rows(spark, fine, open_, other, leak).orderBy("id").select(C.translated(F.col("m"), F.lit("/var/scratch/7")).alias("t")).collect()]
    assert [g.refusal for g in got] == [None, "a call without a result", "a call of another tool", "an output shows the machine"]
    assert json.loads(got[0].messages[1].calls[0].arguments)["command"] == "ls /home/user/input; cat /home/user/input/t.csv" and got[0].messages[2].content == "see /workdir/input/t.csv"
    assert all(g.messages is None for g in got[1:])


@pytest.mark.parametrize("command, path", [(False, "x == 'input' and df['input'] and input/a"), (True, "listdir('input') cd input && x")])
def test_world_text(spark, command, path):
    r = spark.createDataFrame([(path,), (None,)], "t string").select(C.world_text(F.col("t"), F.lit(""), command).alias("w")).collect()
    want = {False: ("x == 'input' and df['input'] and /home/user/input/a", 1), True: ("listdir('/home/user/input') cd /home/user/input && x", 2)}[command]
    assert (r[0].w.text, r[0].w.input) == want and r[1].w.text == ""


def test_results_and_their_inverse(spark):
    cases = [("out", 0, False), ("", 3, False), ("  ", 0, False), ("x" * 9000, 0, False), ("late", 0, True)]
    df = spark.createDataFrame(cases, "o string, c int, t boolean").select(C.tool_result(F.col("o"), F.col("c"), F.col("t")).alias("s"))
    got = [(r.s, r.r) for r in df.select("s", C.recorded_result(F.col("s")).alias("r")).collect()]
    assert [s for s, _ in got][:3] == ["out", "(empty output, rc=3)", EMPTY] and got[3][0] == "x" * 8000 + C.CUT
    assert [(len(r.output), r.code, r.timed_out) for _, r in got] == [(3, 0, False), (0, 3, False), (0, 0, False), (8000, 0, False), (0, -1, True)]
    m = [say("tool", s) for s, _ in got] + [say("tool", "z" * 8001)]
    assert rows(spark, m).select(C.replays(F.col("m"))).first()[0] == 1


def test_small_pieces(spark):
    one = spark.range(1)
    code = one.select(C.heredoc("f.py", F.lit("a\nEOF\nEOF_1\n\n")).alias("h")).first().h
    assert code == "cat > f.py << 'EOF_2'\na\nEOF\nEOF_1\nEOF_2"
    refused = one.select(*(C.submission_command(F.lit(v).cast("string")).alias(f"c{i}") for i, v in enumerate(["it's", "", "a\nb", None]))).first()
    assert list(refused) == ["echo -n 'it'\"'\"'s' > /workdir/answer.txt", None, None, None]
    a, b = one.select(C.call_id(F.lit("t"), F.lit(1)), C.call_id(F.lit("t"), F.lit(2))).first()
    assert a != b and len(a) == len("chatcmpl-tool-") + 16
    kinds = rows(spark, [say("assistant", "x", [("a", "ls")]), say("assistant", "<tool_call>ls"), say("assistant", "hm"), say("assistant"), ("assistant", "", [("a", "bash", "no json")], None)])
    assert kinds.select(F.transform("m", C.message_kind)).first()[0] == ["tool_call", "leaked", "prose", "empty", "empty"]
    assert rows(spark, CHAT).select(C.answered_inline(C.turns(F.col("m")), F.lit("t.csv"))).first()[0] is False
    inline = [say("assistant", "", [("a", "python3 -c 'print(5)'")]), say("tool", "x\n5\n", answers="a")]
    assert rows(spark, inline).select(C.answered_inline(C.turns(F.col("m")), F.lit("5"))).first()[0] is True
    assert rows(spark, CHAT).select(C.marks_in(F.col("m"), F.array(F.lit("q"), F.lit("t.csv"), F.lit("")))).first()[0] == ["q"]
    with pytest.raises(ValueError):
        C.prepared(F.col("m"), F.col("t"), "other")


def test_audit_fails_where_a_segment_is_missing(spark):
    df = rows(spark, CHAT, []).withColumn("rendered", C.rendered(F.col("m")))
    assert C.checked(df, "id", "m").count() == 2
    cut = df.withColumn("rendered", F.replace("rendered", F.lit("<|im_start|>tool"), F.lit("")))
    r = C.audit_rows(cut, "id", "m").first()
    assert (r.rows, r.wrong, r.first_wrong) == (2, 1, 0)
    with pytest.raises(Exception, match="not rendered"):
        C.checked(cut, "id", "m").collect()


def test_transcripts(spark):
    ev = lambda **e: json.dumps({"event": e})
    use = {"type": "tool_use", "id": "a", "input": {"command": "ls"}}
    part = lambda t: [{"type": "text", "text": t}]
    lines = [ev(type="delta"), ev(type="message_end", content=[{"type": "text", "text": "hi"}, use]), ev(type="tool_update", toolCallId="a", partial=part("1")), ev(type="tool_update", toolCallId="a", partial=part("12")), ev(type="tool_update", toolCallId="a", partial=[]), "{broken", ev(type="message_end", content=part("bye"))]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(lines)] + [(2, 0, None)], "conv_id long, seq long, value string")
    r, = C.transcript_turns(df).collect()
    assert [(m.role, m.content) for m in r.messages] == [("assistant", ""), ("tool", "12"), ("assistant", "bye")]
