"""Lookups, costs, log facts and made tasks against literal rows."""

import pytest
from pyspark.sql import functions as F

from tarnbeck.functions import logs
from tarnbeck.operators import costs, lineage, reports, synthetic


def test_first_and_last_rows(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None), (None, 5, "n")], "k string, o int, v string")
    assert {(r.k, r.v) for r in lineage.first_by(df, ["k"], "o").collect()} == {("a", "y"), ("b", None), (None, "n")}
    assert {(r.k, r.v) for r in lineage.last_by(df, ["k"], "o").collect()} == {("a", "x"), ("b", None), (None, "n")}
    both = lineage.catalogue({"p": df.where("k = 'b'"), "q": df.drop("o")}, "k")
    assert {(r.k, r.split) for r in both.collect()} == {("b", "p"), ("a", "q"), (None, "q")}
    with pytest.raises(ValueError):
        lineage.union_of({})


def test_references(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    one = spark.createDataFrame([("a", "bad", 0.0), ("b", "good", 1.0)], "k string, code string, reward double")
    two = spark.createDataFrame([("a", "later", 1.0), ("c", "only", 1.0)], "k string, code string, reward double")
    # the first root that has a task decides, even if its result did not pass
    assert {(r.k, r.reference) for r in lineage.reference_of(tasks, [one, two], "k").collect()} == {("a", None), ("b", "good"), ("c", "only")}


def test_skipped_and_failures(spark):
    planned, done = spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), spark.createDataFrame([("b",)], "k string")
    assert tuple(lineage.skipped(planned, done, "k").first()) == (3, 2, ["a", "c"])
    like = spark.createDataFrame([("x", "exit 0", 1.0, 3)], "k string, agent_status string, reward double, turns int")
    made = lineage.failure_rows(spark.createDataFrame([("q", "boom")], "k string, e string"), ["k"], "e", like).first()
    assert tuple(made) == ("q", "boom", None, None)


def test_junk_and_fingerprint(spark):
    p = spark.createDataFrame([("r/node_modules", 1), ("r/node_modules/x/node_modules", 2), ("r/a.pyc", 3), ("r/a.py", 4)], "path string, size long")
    assert {r.path for r in lineage.junk(p, [r"^node_modules$", r"\.pyc$"]).collect()} == {"r/node_modules", "r/a.pyc"}
    f = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string")
    assert lineage.fingerprint(f).first() == lineage.fingerprint(f.orderBy(F.desc("path"))).first() != lineage.fingerprint(f.limit(1)).first()


def test_logs(spark):
    log = "noise\nADAPTER_CHECK model=a differs=0 tool_calls_ok=1\nADAPTER_CHECK model=a differs=1 tool_calls_ok=0\nMERGE_OK model=b modules_applied=7 tensors_changed=0\n"
    r = spark.createDataFrame([(log,), (None,)], "l string").select(logs.serve_checks(F.col("l")).alias("c"), logs.serve_merges(F.col("l")).alias("m")).collect()
    assert {k: tuple(v) for k, v in r[0].c.items()} == {"a": (True, False)} and {k: tuple(v) for k, v in r[0].m.items()} == {"b": (7, 0)} and r[1].c == {}
    one = spark.range(1)
    assert one.select(logs.created_at(F.lit("1970-01-02T00:00:01Z")), logs.created_at(F.lit("soon")), logs.sample_of(F.lit("x/L1/s12/result.json")), logs.sample_of(F.lit("x/L1"))).first()[:] == (86401.0, None, 12, 0)
    assert one.select(logs.package_version(F.lit("Scikit_Learn-1.5.0.dist-info")).alias("p"), logs.percent(F.lit(1), F.lit(8)), logs.percent(F.lit(1), F.lit(0))).first()[:] == (("scikit-learn", "1.5.0"), "12.5%", "n/a")
    assert one.select(logs.throttled(F.lit("HTTP 429")), logs.throttled(F.lit("fine")), logs.rung_name(F.lit("L1"), {"L1": "none"}), logs.run_path("r", F.lit("t"), F.lit("s"))).first()[:] == (True, False, "none", "r/t/s")
    with pytest.raises(Exception, match="no path segment"):
        one.select(logs.run_path("r", F.lit("a/b"), F.lit("s"))).collect()
    m = one.select(logs.measurements(F.lit('{"best": {"tokens_per_s": 5.5, "grad_accum": 2}, "checks_ok": true}')).alias("m")).first().m
    assert tuple(m) == (5.5, None, 2, True, None)


def test_costs(spark):
    one = spark.range(1)
    assert one.select(costs.tuning_seconds(F.lit(4600), F.lit(46.0)), costs.tuning_seconds(F.lit(1), F.lit(0.0))).first()[:] == (pytest.approx(265.0), None)
    assert one.select(costs.trial_rate(F.lit(30.0))["rate"], costs.trial_rate(F.lit(11.0))["basis"], costs.trial_rate(F.lit(None).cast("double"))["rate"]).first()[:] == (22.0, "measured", 22.0)
    c = spark.createDataFrame([(4, 10.0, True), (8, 12.0, False), (2, 10.0, True)], "batch int, tokens_per_s double, ok boolean")
    assert costs.best_config(c).first().batch == 2 and costs.best_config(c.where("not ok")).count() == 0
    checks = spark.createDataFrame([("a", True), ("b", None)], "name string, ok boolean")
    assert tuple(costs.all_passed(checks).first()) == (2, 1, False) and costs.all_passed(checks.limit(0)).first().ok is False
    counts = spark.createDataFrame([("A", 3, 8192), ("B", 2, 8192), ("C", 1, 4096)], "set string, rows long, max_length int")
    found = spark.createDataFrame([("A", 3), ("C", 1)], "set string, rows long")
    assert {tuple(r) for r in costs.stale_counts(counts, found, "set", 8192).collect()} == {("B", "no data"), ("C", "counted at another length")}
    plan = costs.required_trials(spark.createDataFrame([("t", 251, 1)], "tag string, tasks int, samples int")).first()
    assert (plan.expected, plan.least) == (251, 226)


def test_reports(spark):
    a = spark.createDataFrame([(i, i % 2 == 0) for i in range(10)], "k int, good boolean")
    b = spark.createDataFrame([(i, i % 2 == 0 or i == 1) for i in range(10)], "k int, good boolean")
    r = reports.repeat_agreement(a, b, "k", ["good"]).first()
    assert (r.n, r.agree) == (10, pytest.approx(0.9)) and r.kappa == pytest.approx(0.8)
    hints = spark.createDataFrame([("", 1), ("use col a", 2), ("answer is 5", 3), (None, 4)], "hint string, k int")
    got = reports.hint_checks(hints, F.col("hint").contains("5"), F.col("hint").contains("col"), F.lit(False)).first()
    assert tuple(got) == (4, 2, 1, 1, 0)


def test_made_tasks_equal_pandas(spark, sf):
    import pandas as pd

    df = pd.read_parquet(f"{sf}/part.parquet")
    got = {r.question: r.answer for r in synthetic.tasks(spark.read.parquet(f"{sf}/part.parquet"), "part.csv", "part").collect()}
    assert len(got) > 8
    for c in ("p_partkey", "p_size", "p_retailprice"):
        for name, v in (("mean", df[c].mean()), ("median", df[c].median())):
            assert float(got[f"What is the {name} of {c} across all rows?"]) == pytest.approx(v)
        asked = f"What is the largest value of {c} in the table?"
        assert (asked in got) == ((df[c] == df[c].max()).sum() == 1)
    for c in ("p_brand", "p_type"):
        n = df[c].value_counts()
        asked = f"Which value of {c} appears most often in the table?"
        assert (asked in got) == (n.iloc[0] != n.iloc[1]) and (asked not in got or got[asked] == n.index[0])
    none = synthetic.tasks(spark.createDataFrame([(1,)], "id int"), "t", "t")
    assert none.count() == 0
    cells = spark.createDataFrame([(1, "b"), (2, " a "), (3, "a")], "i int, c string")
    assert synthetic.first_matching(cells, "c", "a", "i").first().value == " a " and synthetic.first_matching(cells, "c", "z", "i").first().value is None
    assert synthetic.column_names({"x": cells, "y": cells.drop("c")}) == ["c", "i"]


def test_sql_and_hint_texts(spark):
    from tarnbeck.functions import prompts
    from tarnbeck.functions import text as T

    one = spark.range(1)
    sql = "SELECT a.x, sum(y) FROM t JOIN u ON t.k = u.k WHERE name = 'in it' AND z NOT IN (1, 2) GROUP BY w"
    assert one.select(T.sql_columns(F.lit(sql))).first()[0] == ["a", "k", "name", "sum", "t", "u", "x", "y", "z"]
    assert one.select(T.sql_operator(F.lit("z NOT IN (1)")), T.sql_operator(F.lit("z = 1")), T.sandbox_paths(F.lit("read('./input/a') input/b my_input/c")), T.one_line(F.lit(" a \n b "))).first()[:] == ("!=", "==", "read('/home/user/input/a') /home/user/input/b my_input/c", "a b")
    replies = ['{"l2": {"files": "a.csv"}, "l3": "sum it"}', '{"hint": {"L2": {"columns": "x"}, "method": "count"}}', '{"files": "b.csv", "columns": "y"}', "no json", None]
    got = [r.h for r in spark.createDataFrame([(x,) for x in replies], "t string").select(T.hint_fields(F.col("t")).alias("h")).collect()]
    assert [(g.l2, g.l3) for g in got] == [({"files": "a.csv"}, "sum it"), ({"columns": "x"}, "count"), ({"files": "b.csv", "columns": "y"}, ""), ({}, ""), ({}, "")]
    assert one.select(prompts.hint_text(F.create_map(F.lit("files"), F.lit("a"), F.lit("columns"), F.lit("x")), F.lit("sum"))).first()[0] == "columns: x\nfiles: a\nsum"


def test_expressions_and_rewards(spark):
    from tarnbeck.operators import grading

    cases = [("1/2", "0.5", True), ("2^3 + 1", "9", True), ("50%", "1/2", True), ("28*28", "784", True), ("x + 1", "x + 1", True), ("1/0", "1/0", False), (None, "1", False), ("9" * 300, "9" * 300, True), ("2^999", "2^999", True), ("0.1 + 0.2", "0.3", True), ("1,000", "1000", True), ("1 + 1", "3", False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    assert [r[0] for r in df.select(grading.same_expression("a", "b")).collect()] == [c for _, _, c in cases]
    r = spark.createDataFrame([("5", "5.0"), ("5", "no"), ("5", None)], "a string, p string").select(grading.rewards(F.col("a"), F.col("p"), F.lit("numeric"), F.lit(0.1), F.lit(0.0)).alias("r")).collect()
    assert [tuple(x.r) for x in r] == [(1.0, 1.0, 1.1), (0.0, 1.0, 0.1), (0.0, 0.0, 0.0)]


def test_split_bound_and_bench_rows(spark):
    import hashlib

    from tarnbeck.operators import sampling

    n = 3000
    df = spark.range(n).withColumnRenamed("id", "k")
    val = {r.k for r in sampling.split_by_hash(df, F.col("k"), 0.05, 3).where("part = 'val'").collect()}
    assert val == set(sorted(range(n), key=lambda k: hashlib.sha256(f"3:{k}".encode()).hexdigest())[:150])
    assert sampling.split_by_hash(df.limit(0), F.col("k"), 0.5, 3).count() == 0
    rows = [r.k for r in sampling.bench_rows([df.where("k < 10"), df.where("k >= 10 and k < 20").withColumn("x", F.lit(1))], F.col("k"), 4).collect()]
    assert rows == sorted(range(20), key=lambda k: hashlib.sha256(f"0:{k}".encode()).hexdigest())[:4]


def test_report_and_heartbeat(spark, tmp_path):
    from tarnbeck.sources import sinks

    df = spark.createDataFrame([("a", "val"), ("b", "train"), ("c", "train")], "k string, part string")
    assert sinks.write_report(df, spark.createDataFrame([("held out", 4)], "reason string, n int"), str(tmp_path / "r")) == {"rows": 3, "val": 1, "train": 2}
    got = {r.name: r.value for r in spark.read.json(str(tmp_path / "r" / "manifest")).collect()}
    assert got == {"rows": 3, "val": 1, "train": 2, "dropped: held out": 4}
    beat = lambda tag, t: sinks.write_heartbeat(spark.createDataFrame([(tag, t)], "tag string, at double"), str(tmp_path / "h"), "tag")
    beat("a", 1.0), beat("b", 2.0), beat("a", 3.0)
    assert {(r.tag, r.at) for r in spark.read.json(str(tmp_path / "h")).collect()} == {("a", 3.0), ("b", 2.0)}


def test_quoted_separators(spark, tmp_path):
    from tarnbeck.sources import readers

    (tmp_path / "a.csv").write_text('"x, y";z\n1;2\n')
    assert readers.sniff(spark, str(tmp_path / "a.csv")) == ";" and readers.read_delimited(spark, str(tmp_path / "a.csv")).columns == ["x, y", "z"]


def test_one_value_is_constant_text(spark):
    from tarnbeck.operators import profile

    got = {r.column: r.profile for r in profile.describe_table(spark.createDataFrame([("a", None), ("a", None)], "c string, e string")).collect()}
    assert got == {"c": "constant text, all values present", "e": "text, no values present"}
