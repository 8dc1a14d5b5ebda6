import time

import pytest
from pyspark.sql import functions as F

from tarnbeck.functions import text as T
from tarnbeck.operators import algebra, conversations, frames, grading, ledger, overlap, pool, profile, sampling, trials

TRIAL = "task string, rung string, finished boolean, passed boolean"


@pytest.fixture
def few(spark):
    rows = [("a", "L1", True, False), ("a", "L1", True, True), ("a", "L2", True, True), ("b", "L1", True, True), ("b", "L2", True, False), ("c", "L1", False, True), ("d", "L3", True, True)]
    return spark.createDataFrame(rows, TRIAL)


def test_rates_are_means_over_tasks(few):
    got = {r.rung: r for r in trials.rung_stats(few).collect()}
    assert got["L1"].pass_rate == 0.75 and got["L1"].attempted == 3 and got["L1"].scored == 2 and got["L1"].failures == 1


def test_a_tie_is_no_pass_and_buckets_add_up(few):
    got = {r.bucket: r.tasks for r in trials.partition(few).collect()}
    assert got == {"L1": 1, "L2": 1, "L3": 1, "L4": 0, "never": 0, "not scored": 1} and sum(got.values()) == 4


def test_monotonicity_and_effect(few):
    got = {r.step: r for r in trials.monotonicity(few).collect()}
    assert (got["L1-L2"].paired, got["L1-L2"].fell, got["L1-L2"].rose, got["L1-L2"].p) == (2, 1, 1, 1.0) and got["L3-L4"].p is None
    e = trials.paired_effect(few).first()
    assert (e.paired, e.rescued, e.hurt, e.mean_delta) == (2, 1, 1, -0.25)


def test_effect_over_many_tasks(spark):
    """50,000 tasks fall and 50,000 rise: the exact p takes time in proportion to them, not to their square."""
    each = spark.range(100_000).select(F.concat(F.lit("t"), "id").alias("task"), F.explode(F.array(F.lit("L1"), F.lit("L2"))).alias("rung"), F.lit(True).alias("finished"), "id")
    began = time.time()
    e = trials.paired_effect(each.withColumn("passed", (F.col("id") % 2 == 0) == (F.col("rung") == "L1"))).first()
    assert (e.paired, e.rescued, e.hurt, e.mean_delta, e.p) == (100_000, 50_000, 50_000, 0.0, 1.0) and time.time() - began < 100


def test_rungs_side_by_side_in_one_shuffle(spark):
    rows = [("a", "L1", True, True), ("a", "L1", True, False), ("a", "L2", False, True), ("b", "L3", True, True), ("b", None, True, True), (None, "L2", True, True), ("c", "L1", True, None), ("d", "L1", False, True)]
    got = trials.by_rung(spark.createDataFrame(rows, TRIAL), ("L1", "L2"))
    assert got.columns == ["task", "L1", "L2"] and {tuple(r) for r in got.collect()} == {("a", 0.5, None), ("b", None, None), (None, None, 1.0), ("c", None, None)}
    each = spark.range(10).select(F.col("id").alias("task"), F.lit("L1").alias("rung"), F.lit(True).alias("finished"), F.lit(True).alias("passed"), F.rand().alias("x"))
    plan = trials.paired_effect(each.repartition(3, "x"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(task") == 1


def test_overlay(spark):
    t = spark.createDataFrame([(1, "exit 0", "exit 1", 0.0), (2, "exit 0", None, 1.0), (3, "timeout", None, 1.0)], "task int, agent_status string, verify_status string, reward double")
    again = spark.createDataFrame([(1, "exit 0", 1.0)], "task int, new_status string, new_reward double")
    assert {r.task: (r.finished, r.passed) for r in trials.overlaid(t, again, ["task"]).collect()} == {1: (True, True), 2: (True, True), 3: (False, True)}


def test_mixed_cells_count_missing_as_a_value(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "x"), ("b", "x")], "k string, v string")
    assert [r.k for r in trials.mixed_cells(df, ["k"], ["v"]).collect()] == ["a"]


def test_firewall_names_the_first_key_and_keeps_rows_once(spark):
    rows = spark.createDataFrame([("1", "Q one"), ("2", "q two"), ("3", None), ("1", "Q one")], "id string, q string")
    held = spark.createDataFrame([("id", "1"), ("q", "q one"), ("q", "q two")], "name string, value string")
    got = overlap.firewall(rows, held, {"id": F.col("id"), "q": F.lower("q")}).collect()
    assert sorted((r.id, r.held_out or "") for r in got) == [("1", "id"), ("1", "id"), ("2", "q"), ("3", "")]


def test_overlap_share_of_nothing(spark):
    empty = spark.createDataFrame([], "k long")
    assert tuple(overlap.overlap_share(empty, empty, "k", "x").first()) == ("x", 0, 0, 0.0)


def test_near_duplicates(spark):
    s = spark.createDataFrame([(1, "What is the average price of cars sold in Norway?"), (2, "List every blue boat")], "id int, question string")
    r = spark.createDataFrame([(7, "What is the average price of cars sold in  norway"), (8, "What is the average price of the cars sold in Norway and"), (9, "unrelated words entirely")], "id int, question string")
    assert {(x.s_id, x.r_id) for x in overlap.near_duplicate_pairs(s, r, (0.8, 0.6)).collect()} == {(1, 8)}
    assert {(x.s_id, x.r_id) for x in overlap.near_duplicate_pairs(s, r, (0.8, 0.6), exclude_exact=False).collect()} == {(1, 7), (1, 8)}


def test_funnel_counts_every_row_once(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 1), (4, None, 9), (2, "a", 6)], "pos int, k string, n int")
    marked = pool.funnel(rows, [("small", F.col("n") < 3)], F.col("k"), "pos")
    got = {r.exit_reason: r.n for r in pool.exit_counts(marked).collect()}
    assert got == {"kept": 2, "small": 1, "duplicate": 2} and sum(got.values()) == 5


def test_algebra(spark):
    df = spark.createDataFrame([(1, "x", "10"), (1, "y", "n/a"), (2, "x", "30"), (2, "y", None)], "g int, t string, v string")
    value = lambda *ops: algebra.run(df, list(ops)).first().value
    assert value("mean(v)") == 20.0 and value("filter(g==2)", "sum(v)") == 30.0 and value("value_counts(t)", "argmax") is None
    assert value("filter(v==10)", "value_counts(t)", "argmax") == "x" and value("median(v)") == 20.0
    assert algebra.verified(df, ["filter(g==1)", "max(v)"], "t_algebra") and algebra.verified(df, ["value_counts(t)", "argmax"], "t_algebra")
    assert algebra.unique_max(df, "g").first().value is None
    with pytest.raises(ValueError):
        algebra.parse(["explode(v)"])


def test_grading(spark):
    rows = [("numeric", "5", "it is 5.00 ok", 1.0), ("numeric", "5", "none", 0.0), ("exact_short", "North  America", "north america", 1.0), ("exact_bool", "yes", "no", 0.0), ("list", "a, b", "B;a", 1.0), ("odd", "a", "a", 0.0)]
    df = spark.createDataFrame(rows, "m string, a string, p string, w double")
    got = df.select("w", grading.grade(F.col("a"), F.col("p"), F.col("m"), F.lit(1e-4), F.lit(1e-4)).alias("g")).collect()
    assert [r.g for r in got] == [r.w for r in got]
    shown = spark.createDataFrame([(1e7,), (0.5,), (float("nan"),)], "x double").select(grading.shown(F.col("x")).alias("s")).collect()
    assert [r.s for r in shown] == ["10000000.0", "0.5", ""]


def test_intervals_and_spend(spark):
    ev = spark.createDataFrame([(1, 0.0, "open"), (2, 3600.0, "open"), (3, 7200.0, "close"), (4, 9000.0, "other"), (5, 10800.0, "open")], "id int, ts double, kind string").withColumn("k", F.lit(1))
    spans = ledger.intervals(ev, "k", "ts", F.col("kind") == "open", F.col("kind") == "close", F.lit(14400.0), "id")
    assert sorted((r.start, r.stop, r.open) for r in spans.collect()) == [(0.0, 3600.0, False), (3600.0, 7200.0, False), (10800.0, 14400.0, True)]
    s = ledger.spend(spans, "k", F.lit(5400.0), F.lit(2.0)).first()
    assert (s.total, s.session) == (6.0, 3.0)
    assert ledger.admission(ledger.spend(spans, "k", F.lit(5400.0), F.lit(2.0)), 3600, 2.0, 4.0, 99.0).first().verdict == "session cap"


def test_schedule(spark):
    ev = spark.createDataFrame([("a", i, 1.0) for i in range(4)] + [("b", i, 0.0) for i in range(3)], "k string, o int, r double")
    got = {(r.k, r.o): r.rung for r in ledger.rung_schedule(ev, "k", "o", "r").collect()}
    assert [got["a", i] for i in range(4)] == ["L2", "L1", "L1", "L1"] and [got["b", i] for i in range(3)] == ["L4", "L4", "L4"]


def test_runs_and_loops(spark):
    t = spark.createDataFrame([(1, i, r) for i, r in enumerate("aabba")], "conv_id int, turn int, role string")
    assert [(r.role, r.length) for r in conversations.runs(t).orderBy("run").collect()] == [("a", 2), ("b", 2), ("a", 1)]
    c = spark.createDataFrame([(["x"] * 4,), (["x", "y", "y", "y"],), (["x"],)], "c array<string>")
    assert [r[0] for r in c.select(conversations.looped(F.col("c"))).collect()] == [True, False, False]


def test_splits(spark):
    rows = spark.range(200)
    got = sampling.split_by_hash(rows, F.col("id"), 0.05, 3)
    assert got.where("part = 'val'").count() == 10 and sampling.split_by_hash(rows, F.col("id"), 0.0, 3).where("part = 'val'").count() == 0
    stable = {r.id: r.part for r in sampling.split_stable(rows, F.col("id"), 0.1, 3).collect()}
    assert all(stable[r.id] == r.part for r in sampling.split_stable(rows.where("id % 3 = 0"), F.col("id"), 0.1, 3).collect())
    q = {r.s: r.quota for r in sampling.quotas(spark.createDataFrame([("a", 50), ("b", 30), ("c", 20)], "s string, size long"), "s", 7).collect()}
    assert q == {"a": 4, "b": 2, "c": 1}


def test_profile_has_no_values(spark):
    df = spark.createDataFrame([(float(i), f"name{i % 4}", None) for i in range(100)], "v double, t string, e string")
    got = {r.column: r.profile for r in profile.describe_table(df).collect()}
    assert got == {"v": "numeric, all values present, spread evenly across its range", "t": "text, all values present, a few distinct values, short labels", "e": "text, no values present"}


def test_asof_and_fills(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), (None, 2, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0), ("b", 10, 9.0)], "k string, t int, v double")
    assert {r.id: r.v for r in frames.asof_join(left, right, "k", "t", ["v"]).collect()} == {1: 50.0, 2: None, 3: None, 4: None}
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate((None, 1.0, None, 3.0, None))], "k string, o int, v double")
    assert [r.v for r in frames.interpolated(df, "k", "o", "v").orderBy("o").collect()] == [None, 1.0, 2.0, 3.0, 3.0]
    assert [r.v for r in frames.filled(df, "k", ["o"], "v").orderBy("o").collect()] == [None, 1.0, 1.0, 3.0, 3.0]
    import pandas as pd

    got = [r.ewm for r in frames.ewm_mean(df, "k", "o", "v", 0.5).orderBy("o").collect()]
    want = pd.Series([None, 1.0, None, 3.0, None]).ewm(alpha=0.5).mean().tolist()
    assert got[1:] == pytest.approx(want[1:]) and got[0] is None


@pytest.mark.parametrize("k", [1, 10, 100, 100_000])
def test_top_pairs(spark, k):
    import random

    rng = random.Random(7)
    words = [f"w{i}" for i in range(25)]
    made = lambda n: [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(n)]
    s, r = made(60) + [(60, None), (61, ""), (62, "w1 w2 w3"), (63, "w1 w2 w3")], made(50) + [(50, "W1, w2 w3!"), (51, "w3 w2 w1"), (52, None)]
    forms = {}
    for name, rows in (("s", s), ("r", r)):
        df = spark.createDataFrame(rows, "id long, q string").select("id", F.coalesce(T.normalise_question(F.col("q")), F.lit("")).alias("n"), T.tokens(F.col("q")).alias("t"))
        forms[name] = [(x.id, x.n, set(x.t or [])) for x in df.withColumn("g", T.char_ngrams(F.col("n"))).collect()], {x.id: set(x.g or []) for x in df.withColumn("g", T.char_ngrams(F.col("n"))).collect()}
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    every = []
    for i, n, t in forms["s"][0]:
        for j, m, u in forms["r"][0]:
            if t & u and n != m:
                every.append((-share(t, u), -share(forms["s"][1][i], forms["r"][1][j]), i, j))
    df = lambda rows: spark.createDataFrame(rows, "id long, question string")
    got = [(-x.jaccard, -x.ngram, x.s_id, x.r_id) for x in overlap.top_pairs(df(s), df(r), k).collect()]
    want = sorted(every)[:k]
    assert [(round(a, 9), round(b, 9), i, j) for a, b, i, j in got] == [(round(a, 9), round(b, 9), i, j) for a, b, i, j in want]
