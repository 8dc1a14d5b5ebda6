from pyspark.sql import functions as F

from tarnbeck.functions import prompts
from tarnbeck.operators import records


def test_launches(spark):
    df = spark.createDataFrame([("r", 1, "m1", ["b", "a"]), ("r", 2, "m2", ["c", "a"]), ("s", 5, None, None)], "run string, at int, model string, ids array<string>")
    got = {r.run: r for r in records.merged_launches(df, "run", "at", ["model"], "ids").collect()}
    assert (got["r"].model, got["r"].launches, got["r"].ids) == ("m1", 2, ["a", "b", "c"]) and got["s"].ids == []
    assert [(r.run, r.settings) for r in records.clashing(df, "run", ["model"]).collect()] == [("r", ["model"])]


def test_gold_and_costs(spark):
    t = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    cur, old = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert sorted((r.k, r.v, r.source) for r in records.resolved(t, cur, old, "k", "v").collect()) == [(1, "x", "current"), (2, "z", "superseded"), (3, None, "none")]
    s = spark.createDataFrame([(1, "a", 3600.0), (2, "b1", 1800.0), (3, "c", 1800.0)], "o int, name string, sec double")
    assert [r.so_far for r in records.staged_costs(s, "o", "sec", 2.0).orderBy("o").collect()] == [2.0, 3.0, 4.0]
    assert [r.name for r in records.remaining(s, "o", "name", "b").orderBy("o").collect()] == ["b1", "c"]
    e = records.expected_trials(spark.createDataFrame([("t", 10, 1), ("t", 5, 2)], "tag string, tasks int, samples int"), "tag")
    assert (e.first().expected, e.first().least) == (20, 18) and records.complete(e, spark.range(18).select(F.lit("t").alias("tag")), "tag").first().complete


def test_prompts(spark):
    df = spark.createDataFrame([("L1",), ("L2",), ("L4",), ("odd",)], "rung string")
    got = [r[0] for r in df.select(prompts.prompt(F.col("rung"), F.lit("Q?"), F.array(F.lit("t.csv")), F.lit("col a"), F.lit("mean"), F.lit("x = 1"))).collect()]
    assert got[0] == got[3] == "Q?\n\nFiles:\n- t.csv" and got[1].endswith("Where to look:\ncol a") and got[2].endswith("A program to start from:\nx = 1")
    sha = df.select(prompts.condition_sha(F.lit("p"), F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))), prompts.condition_sha(F.lit("p"), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("1"))), prompts.condition_sha(F.lit("p"), F.lit(None).cast("map<string,string>"))).first()
    assert sha[0] == sha[1] != sha[2]
    why = df.select(prompts.hint_problems(F.array(F.lit("A b")), F.array(F.lit("a_B")), F.array(F.lit("f")), F.array(F.lit("g")), F.lit("x"), F.lit("X "), F.array().cast("array<string>"))).first()[0]
    assert why == ["method adds nothing"]
    assert df.select(prompts.files_line(F.array(*(F.lit(str(i)) for i in range(8))))).first()[0] == "0, 1, 2, 3, 4, 5, ... (8 total)"
