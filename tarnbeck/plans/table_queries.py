"""Queries over the star schema, standing in for shipped tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.functions import programs
from tarnbeck.functions import text as T
from tarnbeck.operators import algebra, frames, grading, linear, overlap, pool, profile, ranks, sampling, staging, trials
from tarnbeck.sources import readers


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def integrity_mixed_cells(spark, d):
    cells = trials.mixed_cells(read(spark, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])
    return cells.groupBy("n_l_returnflag", "n_l_linestatus").agg(F.count("*").alias("orders"))


def stratified_subset(spark, d):
    return sampling.stratified(read(spark, d, "orders"), "o_orderpriority", "o_orderkey", 101, 7)


def overlap_share(spark, d):
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders").where("o_orderstatus = 'F'")
    a = overlap.overlap_share(li.select(F.col("l_orderkey").alias("k")), o.select(F.col("o_orderkey").alias("k")), "k", "order")
    b = overlap.overlap_share(li.select(F.col("l_partkey").alias("k")), o.select(F.col("o_custkey").alias("k")), "k", "number")
    return a.unionByName(b).withColumn("share", F.round("share", 6))


def file_set_overlap(spark, d):
    files = lambda df, p: df.groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit(p), F.col("l_returnflag"), F.lit(".csv"))).alias("files")).select("l_orderkey", T.file_key(F.col("files")).alias("k"))
    li = read(spark, d, "lineitem")
    return overlap.overlap_share(files(li.where("l_linestatus = 'F'"), "a/"), files(li.where("l_linestatus = 'O'"), "b/X/"), "k", "files").withColumn("share", F.round("share", 6))


def classify_answers(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.array("p_name", F.col("p_size").cast("string"), F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit("%"))).alias("a")).select("p_partkey", F.posexplode("a").alias("pos", "answer"))
    c = T.classify(F.col("answer"))
    tol = T.tolerance(c["mode"], c["value"])
    return p.select("p_partkey", "pos", c["mode"].alias("mode"), c["value"].alias("value"), F.round(F.coalesce(tol, F.lit(0.0)), 6).alias("tol"), T.answer_type(F.coalesce(c["mode"], F.lit(""))).alias("kind"))


def grade_numeric(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("answer: "), F.floor("l_extendedprice").cast("long").cast("string")).alias("prediction"), F.col("l_quantity").alias("q"), F.floor("l_extendedprice").alias("v"), F.col("l_extendedprice").alias("gold"))
    near = grading.grade(F.col("v").cast("string"), F.col("prediction"), F.lit("numeric"), F.lit(0.5), F.lit(0.0))
    far = F.abs(F.col("v") - F.col("gold")) <= 0.5
    return li.agg(F.sum(near).alias("same"), F.count_if(far).alias("near"), F.count("*").alias("n"))


def regrade_flips(spark, d):
    o = read(spark, d, "orders").select("o_orderpriority", F.concat(F.when(F.col("o_orderkey") % 3 == 0, "ANSWER: ").otherwise(""), F.col("o_orderstatus")).alias("prediction"), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_orderstatus")).alias("answer"))
    r = grading.regraded(o, "answer", "prediction", F.lit("exact_short"), F.lit(0.0), F.lit(0.0))
    return r.groupBy("o_orderpriority").agg(F.sum("strict").alias("strict"), F.sum("stripped").alias("stripped"), F.count_if("flipped").alias("flips"))


def profile_columns(spark, d):
    return profile.columns_profile(read(spark, d, "orders"))


def profile_words(spark, d):
    return profile.describe_table(read(spark, d, "customer"))


def decile_shape(spark, d):
    a = profile.decile_shape(read(spark, d, "lineitem"), "l_quantity")
    return a.unionByName(profile.decile_shape(read(spark, d, "part"), "p_size")).withColumn("widest", F.round("widest", 6))


def usable_columns(spark, d):
    return profile.usable_columns(read(spark, d, "part"))


ALGEBRA = {
    "mean": ("lineitem", ["mean(l_quantity)"]),
    "median": ("orders", ["median(o_totalprice)"]),
    "sum": ("lineitem", ["sum(l_extendedprice)"]),
    "max": ("orders", ["max(o_totalprice)"]),
    "min": ("orders", ["min(o_totalprice)"]),
    "mode": ("orders", ["value_counts(o_orderpriority)", "argmax"]),
    "filter_mean": ("lineitem", ["filter(l_linenumber==3)", "mean(l_extendedprice)"]),
    "filter_mode": ("part", ["filter(p_size==7)", "value_counts(p_brand)", "argmax"]),
}


def _algebra(spark, d, name):
    view, ops = ALGEBRA[name]
    df = algebra.run(read(spark, d, view), ops)
    return df if name.endswith("mode") else df.withColumn("value", F.round("value", 4))


def algebra_by_sql(spark, d):
    df = read(spark, d, "lineitem")
    df.createOrReplaceTempView("tarnbeck_algebra")
    return spark.sql(algebra.to_sql("tarnbeck_algebra", df.schema, ["filter(l_returnflag==R)", "mean(l_quantity)"])).withColumn("value", F.round("value", 4))


def unique_max(spark, d):
    return algebra.unique_max(read(spark, d, "part"), "p_size").unionByName(algebra.unique_max(read(spark, d, "orders").select("o_orderkey"), "o_orderkey"))


def coverage_all_files(spark, d):
    li, p = read(spark, d, "lineitem"), read(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return pool.coverage(li, "l_orderkey", "l_partkey", p).groupBy("items", "hit", "complete").agg(F.count("*").alias("orders"))


def input_bytes(spark, d):
    li = read(spark, d, "lineitem")
    tasks = li.groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("data/"), F.col("l_partkey").cast("string"), F.lit(".CSV"))).alias("files"))
    sizes = read(spark, d, "part").where("p_size > 3").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".csv")).alias("name"), F.col("p_size").cast("long").alias("size"))
    return pool.input_bytes(tasks, sizes, "l_orderkey")


def split_notebook_overlap(spark, d):
    o = read(spark, d, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit("_qa_"), F.col("o_orderkey").cast("string")).alias("id"))
    c = read(spark, d, "customer").where("c_acctbal < 0").select(T.notebook(F.concat(F.col("c_custkey").cast("string"), F.lit("_qa_1"))).alias("book"))
    return o.withColumn("book", T.notebook(F.col("id"))).join(c, "book", "left_semi").select("id")


def upsert_sizes(spark, d):
    old = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("v"))
    new = read(spark, d, "supplier").select((F.col("s_suppkey") * 30).alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("v"))
    return pool.upsert(old, new, "k", "v")


def carried_rows(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return pool.carried(o, read(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "o_orderkey")


def pivot_table(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.avg("l_quantity"), 6)).withColumnsRenamed({"F": "mean_f", "O": "mean_o"})


def melt(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return s.unpivot("s_suppkey", ["nation", "balance"], "variable", "value")


def dummies(spark, d):
    return frames.dummies(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", F.col("c_mktsegment_BUILDING").alias("building"), F.col("c_mktsegment_MACHINERY").alias("machinery"))


def factorize(spark, d):
    return frames.factorized(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").select("c_custkey", F.col("code").cast("long").alias("code"))


def group_mode(spark, d):
    return frames.unique_mode(read(spark, d, "part"), ["p_brand"], "p_size")


def describe_numbers(spark, d):
    v, li = F.col("l_extendedprice"), read(spark, d, "lineitem")
    q = ranks.percentiles(li, ["l_returnflag"], "l_extendedprice", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    rest = li.groupBy("l_returnflag").agg(F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
    return rest.join(q.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("p25", "p50", "p75"))), "l_returnflag")


def correlations(spark, d):
    return read(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"), F.round(F.covar_samp("l_quantity", "l_discount"), 6).alias("cov"))


def band_join(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("price"))
    p = read(spark, d, "part").select("p_partkey", F.floor("p_retailprice").cast("long").alias("lo")).withColumn("hi", F.col("lo") + 50)
    return frames.range_join(o, p, "price", "lo", "hi", 100).groupBy("p_partkey").agg(F.count("*").alias("orders"))


def top_orders(spark, d):
    return read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


def revenue_by_nation(spark, d):
    li, o, c, n = (read(spark, d, x) for x in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


def median_by_priority(spark, d):
    return ranks.nearest_ranks(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderdate", {"p10": 0.1, "p50": 0.5, "p99": 0.99})


def rank_test_two(spark, d):
    out = ranks.mann_whitney(read(spark, d, "lineitem"), "l_returnflag", "l_quantity", "R", "A")
    return out.select("n_a", "n_b", "u_a", F.round("z", 6).alias("z"))


def rank_test_many(spark, d):
    return ranks.kruskal_wallis(read(spark, d, "part"), "p_brand", "p_size").select("n", "n_groups", F.round("h", 6).alias("h"))


def rank_correlation(spark, d):
    li = read(spark, d, "lineitem").select("l_quantity", F.floor("l_extendedprice").alias("price"))
    return ranks.spearman(li, "l_quantity", "price").select("n", F.round("rho", 9).alias("rho"))


def least_squares(spark, d):
    fit = linear.least_squares(read(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"], ["l_returnflag"])
    one = lambda i, name: F.round(F.col("coefficients")[i], 4).alias(name)
    return fit.select("l_returnflag", "n", F.round("intercept", 3).alias("intercept"), one(0, "b_quantity"), one(1, "b_tax"), F.round("r2", 9).alias("r2"))


#: Programs over a part's values, by p_size modulo their number, and the operations that they call on data.
PROGRAMS = (
    ("import os\nimport pandas as pd\ndf = pd.read_csv(os.path.join('in', '{b}.csv'))\nprint(', '.join(df.columns))\nx = df.groupby('{t}').mean()", "groupby, mean"),
    ("import sqlite3\ncur = sqlite3.connect('{b}.db').cursor()\nrows = cur.execute('select {n}').fetchall()\nprint(len(rows))", "sql"),
    ("import csv\nrows = list(csv.DictReader(open('{b}.csv')))\nseen = {{}}\nfor r in rows:\n    k = r.get('{t}').replace(' ', '')\n    seen[k] = seen.get(k, 0) + 1", "get"),
    ("import pandas as pd\ndef load(p):\n    return pd.read_csv(p)\na, b = load('{b}.csv'), load('x.csv')\nm = pd.merge(a, b).dropna()['{t}'].value_counts().head({n})", "dropna, head, merge, value_counts"),
    ("path = '{b}'\nname = path.replace('#', '').join(['{t}'])", ""),
)
#: Pairs of expressions with p_size in them, and SQL for when they are equal.
EXPRESSIONS = (
    ("{n}(x+1)", "{n}x+{n}", "true"),
    ("(x+{n})^2", "x^2+{n}x+{n}x+{n}^2", "true"),
    ("{n}x/y", "x*7/y", "p_size = 7"),
    ("(x^2-{n}^2)/(x-{n})", "x+{n}", "true"),
    ("{n}%", "{n}/50", "p_size = 0"),
    ("a_{n}", "a", "false"),
)


def _filled(template: str) -> F.Column:
    """A template with a part's values in the places of {b}, {t} and {n}."""
    out = F.lit(template.replace("{{", "{").replace("}}", "}"))
    for mark, value in (("{b}", "p_brand"), ("{t}", "p_type"), ("{n}", "p_size")):
        out = F.replace(out, F.lit(mark), F.col(value).cast("string"))
    return out


def method_hints(spark, d):
    p = read(spark, d, "part")
    source = F.get(F.array(*(_filled(s) for s, _ in PROGRAMS)), F.col("p_size") % len(PROGRAMS))
    return p.select("p_partkey", programs.method_hint(source).alias("hint"))


def symbolic_answers(spark, d):
    pairs = F.array(*(F.struct(F.lit(i).alias("pair"), _filled(a).alias("gold"), _filled(b).alias("got")) for i, (a, b, _) in enumerate(EXPRESSIONS)))
    cells = read(spark, d, "part").select("p_partkey", F.explode(pairs).alias("x")).select("p_partkey", "x.*")
    return cells.select("p_partkey", "pair", grading.same_expression("gold", "got").alias("same"))


#: Separator and encoding of the files that tree_scan writes, by c_custkey modulo their number.
DIALECTS = ((",", "UTF-8"), (";", "ISO-8859-1"), ("\t", "UTF-8"))


def tree_scan(spark, d):
    c, root = read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), staging.shared_path(spark, "tree")
    for i, (sep, encoding) in enumerate(DIALECTS):
        c.where(F.col("c_custkey") % len(DIALECTS) == i).write.csv(f"{root}/{i}", sep=sep, header=True, encoding=encoding)
    rows, v = readers.read_tree(spark, root, split_bytes=16_384), F.col("values")
    total = F.round(F.sum(v["c_acctbal"].cast("double")), 2).alias("total")
    return rows.groupBy(v["c_mktsegment"].alias("segment")).agg(F.count("*").alias("n"), total, F.count("error").alias("errors"))


QUERIES = {f.__name__: f for f in (
    tree_scan, method_hints, symbolic_answers, median_by_priority, rank_test_two, rank_test_many, rank_correlation, least_squares,
    integrity_mixed_cells, stratified_subset, overlap_share, file_set_overlap, classify_answers, grade_numeric, regrade_flips, profile_columns, profile_words, decile_shape, usable_columns,
    algebra_by_sql, unique_max, coverage_all_files, input_bytes, split_notebook_overlap, upsert_sizes, carried_rows, pivot_table, melt, dummies, factorize, group_mode, describe_numbers,
    correlations, band_join, top_orders, revenue_by_nation,
)} | {f"algebra_{n}": partial(_algebra, name=n) for n in ALGEBRA}


def _quote(p: str) -> str:
    return p.replace("'", "''")


DECILE = """{n} AS (SELECT CAST({c} AS DOUBLE) AS v FROM {t} WHERE {c} IS NOT NULL), {n}e AS (SELECT list_distinct([x for x in quantile_cont(v, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) if x <> 0]) AS e FROM {n}),
{n}b AS (SELECT len([x for x in e if x < v]) AS band, count(*) AS k FROM {n}, {n}e GROUP BY 1), {n}w AS (SELECT '{c}' AS "column", round(max(k) / sum(k), 6) AS widest FROM {n}b)"""
NUM = "try_cast({c} AS DOUBLE)"
MODE = "WITH c AS (SELECT {c} AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL{w} GROUP BY 1), m AS (SELECT v FROM c WHERE n = (SELECT max(n) FROM c)) SELECT CASE WHEN count(*) = 1 THEN max(v) END AS value FROM m"

_PRESENCE = "CASE WHEN t = n THEN 'all values present' WHEN n = 0 THEN 'no values present' WHEN (t - n) * 100 < t THEN 'a few values missing' WHEN (t - n) * 2 < t THEN 'some values missing' ELSE 'most values missing' END"
_SPREAD = "CASE WHEN d < 3 THEN 'a couple of distinct values' WHEN d < 6 THEN 'a few distinct values' WHEN d < 13 THEN 'a handful of distinct values' WHEN d < 51 THEN 'many distinct values' ELSE 'a different value in most rows' END"


def _counts(table: str, c: str, kind: str) -> str:
    return f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count({c}) AS n, count(DISTINCT {c}) AS d, count(*) AS t, max(length(CAST({c} AS VARCHAR))) AS l FROM {table}"


def _shape(table: str, c: str) -> str:
    bands = f"SELECT len([x for x in e if x < {c}]) AS band, count(*) AS k FROM {table}, (SELECT list_distinct([x for x in quantile_cont({c}::DOUBLE, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) if x <> 0]) AS e FROM {table}) WHERE {c} IS NOT NULL GROUP BY 1"
    return f"SELECT '{c}' AS \"column\", max(k) / sum(k) AS w FROM ({bands})"


_CUSTOMER = {"c_custkey": "numeric", "c_name": "text", "c_nationkey": "numeric", "c_acctbal": "numeric", "c_mktsegment": "text"}
_PART = {"p_partkey": "numeric", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "numeric", "p_retailprice": "numeric"}
MIDRANKS = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
NEAREST = ", ".join(f"v[round_even({q} * (n - 1), 0)::BIGINT + 1] AS {name}" for name, q in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)))
_HINTS = " ".join(f"WHEN {i} THEN '{hint}'" for i, (_, hint) in enumerate(PROGRAMS))
ORACLE = {
    "tree_scan": "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total, 0 AS errors FROM customer GROUP BY 1",
    "method_hints": f"SELECT p_partkey, CASE p_size % {len(PROGRAMS)} {_HINTS} END AS hint FROM part",
    "symbolic_answers": " UNION ALL ".join(f"SELECT p_partkey, {i} AS pair, {when} AS same FROM part" for i, (_, _, when) in enumerate(EXPRESSIONS)),
    "median_by_priority": f"WITH s AS (SELECT o_orderstatus, o_orderpriority, list(o_orderdate ORDER BY o_orderdate) AS v, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderstatus, o_orderpriority, {NEAREST} FROM s",
    "rank_test_two": f"""WITH r AS (SELECT l_returnflag = 'R' AS is_a, {MIDRANKS.format(c='l_quantity')} AS r FROM lineitem WHERE l_returnflag IN ('R', 'A')),
        t AS (SELECT sum(k * k * k - k) AS ties FROM (SELECT count(*)::DOUBLE AS k FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY l_quantity) x),
        s AS (SELECT count(*) FILTER (is_a) AS n_a, count(*) FILTER (NOT is_a) AS n_b, sum(r) FILTER (is_a) AS ra FROM r),
        u AS (SELECT n_a, n_b, ra - n_a::DOUBLE * (n_a + 1) / 2 AS u_a, (n_a + n_b)::DOUBLE AS n, ties FROM s, t)
        SELECT n_a, n_b, u_a, round((u_a - n_a::DOUBLE * n_b / 2) / sqrt(n_a::DOUBLE * n_b / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM u""",
    "rank_test_many": f"""WITH r AS (SELECT p_brand, {MIDRANKS.format(c='p_size')} AS r FROM part WHERE p_size IS NOT NULL AND p_brand IS NOT NULL), g AS (SELECT count(*) AS n, sum(r) AS s FROM r GROUP BY p_brand),
        t AS (SELECT sum(k * k * k - k) AS ties FROM (SELECT count(*)::DOUBLE AS k FROM part WHERE p_size IS NOT NULL AND p_brand IS NOT NULL GROUP BY p_size) x), a AS (SELECT sum(n)::BIGINT AS n, count(*) AS n_groups, sum(s * s / n) AS q FROM g)
        SELECT n, n_groups, round((12 / (n::DOUBLE * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n::DOUBLE * n * n - n)), 6) AS h FROM a, t""",
    "rank_correlation": f"WITH v AS (SELECT l_quantity, floor(l_extendedprice) AS price FROM lineitem), r AS (SELECT {MIDRANKS.format(c='l_quantity')} AS x, {MIDRANKS.format(c='price')} AS y FROM v) SELECT count(*) AS n, round(corr(x, y), 9) AS rho FROM r",
    "least_squares": """WITH c AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_tax) AS m2, var_pop(l_quantity) AS s11, covar_pop(l_quantity, l_tax) AS s12, var_pop(l_tax) AS s22,
          covar_pop(l_quantity, l_extendedprice) AS t1, covar_pop(l_tax, l_extendedprice) AS t2, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1),
        b AS (SELECT *, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) AS b1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM c)
        SELECT l_returnflag, n, round(my - b1 * m1 - b2 * m2, 3) AS intercept, round(b1, 4) AS b_quantity, round(b2, 4) AS b_tax, round((b1 * t1 + b2 * t2) / v, 9) AS r2 FROM b""",
    "profile_words": f"""WITH c AS ({' UNION ALL '.join(_counts('customer', c, k) for c, k in _CUSTOMER.items())}), s AS ({' UNION ALL '.join(_shape('customer', c) for c, k in _CUSTOMER.items() if k == 'numeric')})
        SELECT "column", CASE WHEN kind = 'numeric' THEN concat_ws(', ', 'numeric', {_PRESENCE}, CASE WHEN w > 0.5 THEN 'almost all its values in one band' WHEN w < 0.25 THEN 'spread evenly across its range' ELSE 'spread across its range, heaviest in one band' END)
        WHEN d = 1 THEN concat_ws(', ', 'constant text', {_PRESENCE}) WHEN d = 0 THEN concat_ws(', ', 'text', {_PRESENCE}) ELSE concat_ws(', ', 'text', {_PRESENCE}, {_SPREAD}, CASE WHEN l <= 20 THEN 'short labels' ELSE 'long labels' END) END AS profile FROM c LEFT JOIN s USING ("column")""",
    "usable_columns": f"""WITH c AS ({' UNION ALL '.join(_counts('part', c, k) for c, k in _PART.items())}), u AS (SELECT "column", CASE WHEN kind = 'numeric' AND n > 20 AND d > 3 THEN 'measure' WHEN kind = 'text' AND n > 20 AND d BETWEEN 2 AND 60 AND n * 2 > t THEN 'group' END AS use FROM c) SELECT * FROM u WHERE use IS NOT NULL""",
    "integrity_mixed_cells": "WITH c AS (SELECT l_orderkey, count(DISTINCT l_returnflag)::INT AS n_l_returnflag, count(DISTINCT l_linestatus)::INT AS n_l_linestatus FROM lineitem GROUP BY 1) SELECT n_l_returnflag, n_l_linestatus, count(*) AS orders FROM c WHERE greatest(n_l_returnflag, n_l_linestatus) > 1 GROUP BY ALL",
    "stratified_subset": """WITH c AS (SELECT o_orderpriority AS s, count(*) AS size FROM orders GROUP BY 1), e AS (SELECT s, size, 101.0 * size / sum(size) OVER () AS x FROM c),
        b AS (SELECT *, floor(x) AS base, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, s) AS r FROM e), q AS (SELECT s, least(size, base + CASE WHEN r <= 101 - sum(base) OVER () THEN 1 ELSE 0 END) AS quota FROM b),
        k AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('7:' || o_orderpriority || ':' || o_orderkey), o_orderkey) AS n FROM orders) SELECT o_orderkey, o_orderpriority FROM k JOIN q ON s = o_orderpriority WHERE n <= quota""",
    "overlap_share": "WITH o AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT 'order' AS label, count(*) FILTER (l_orderkey IN (SELECT o_orderkey FROM o)) AS hits, count(*) AS total FROM lineitem UNION ALL SELECT 'number', count(*) FILTER (l_partkey IN (SELECT o_custkey FROM o)), count(*) FROM lineitem) SELECT *, round(coalesce(hits / nullif(total, 0), 0), 6) AS share FROM a",
    "file_set_overlap": "WITH a AS (SELECT l_orderkey, list_sort(list_distinct(list(lower(l_returnflag)))) AS k FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_orderkey, list_sort(list_distinct(list(lower(l_returnflag)))) AS k FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), c AS (SELECT count(*) FILTER (k IN (SELECT k FROM b)) AS hits, count(*) AS total FROM a) SELECT 'files' AS label, hits, total, round(hits / total, 6) AS share FROM c",
    "classify_answers": f"""WITH p AS (SELECT p_partkey, 0 AS pos, p_name AS a FROM part UNION ALL SELECT p_partkey, 1, CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 2, '$' || p_size || '%' FROM part), r AS (SELECT *, trim(coalesce(a, '')) AS raw FROM p),
        m AS (SELECT *, CASE WHEN raw = '' OR length(raw) > 60 OR regexp_matches(raw, '{_quote(T.NO_ANSWER)}') OR regexp_matches(raw, '{_quote(T.NOISY)}') THEN NULL WHEN lower(raw) IN ('yes', 'no') THEN 'exact_bool' WHEN regexp_matches(raw, '{_quote(T.NUMERIC)}') THEN 'numeric' WHEN regexp_matches(raw, '{_quote(T.LABEL)}') THEN 'exact_short' END AS mode FROM r),
        v AS (SELECT *, CASE mode WHEN 'exact_bool' THEN lower(raw) WHEN 'numeric' THEN trim(regexp_replace(raw, '[$,%]', '', 'g')) WHEN 'exact_short' THEN raw END AS value FROM m)
        SELECT p_partkey, pos, mode, value, CASE WHEN mode = 'numeric' THEN round(least(greatest(pow(10, -(CASE WHEN contains(value, '.') THEN length(split_part(value, '.', 2)) ELSE 0 END + 1)), 1e-4), 0.05), 6) ELSE 0.0 END AS tol, CASE mode WHEN 'numeric' THEN 'numeric' WHEN 'exact_short' THEN 'label' WHEN 'exact_bool' THEN 'bool' ELSE 'unknown' END AS kind FROM v""",
    "grade_numeric": "SELECT count(*)::DOUBLE AS same, count(*) FILTER (abs(floor(l_extendedprice) - l_extendedprice) <= 0.5) AS near, count(*) AS n FROM lineitem",
    "regrade_flips": "WITH o AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 'ANSWER: ' ELSE '' END || o_orderstatus AS p, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderstatus END AS a FROM orders), g AS (SELECT o_orderpriority, (lower(p) = lower(a))::INT::DOUBLE AS s, (lower(replace(p, 'ANSWER: ', '')) = lower(a))::INT::DOUBLE AS t FROM o) SELECT o_orderpriority, sum(s) AS strict, sum(t) AS stripped, count(*) FILTER (s <> t) AS flips FROM g GROUP BY 1",
    "profile_columns": " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{k}' AS kind, count(*) AS total, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "distinct", max(length(CAST({c} AS VARCHAR)))::INT AS longest FROM orders""" for c, k in (("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "text"), ("o_orderpriority", "text"), ("o_totalprice", "numeric"), ("o_orderdate", "datetime"))),
    "decile_shape": f"""WITH {DECILE.format(n='a', c='l_quantity', t='lineitem')}, {DECILE.format(n='b', c='p_size', t='part')}, u AS (SELECT * FROM aw UNION ALL SELECT * FROM bw) SELECT *, CASE WHEN widest > 0.5 THEN 'almost all its values in one band' WHEN widest < 0.25 THEN 'spread evenly across its range' ELSE 'spread across its range, heaviest in one band' END AS shape FROM u""",
    "algebra_mean": "SELECT round(avg(l_quantity), 4) AS value FROM lineitem",
    "algebra_median": "SELECT round(median(o_totalprice), 4) AS value FROM orders",
    "algebra_sum": "SELECT round(sum(l_extendedprice), 4) AS value FROM lineitem",
    "algebra_max": "SELECT round(max(o_totalprice), 4) AS value FROM orders",
    "algebra_min": "SELECT round(min(o_totalprice), 4) AS value FROM orders",
    "algebra_mode": MODE.format(c="o_orderpriority", t="orders", w=""),
    "algebra_filter_mean": "SELECT round(avg(l_extendedprice), 4) AS value FROM lineitem WHERE l_linenumber = 3",
    "algebra_filter_mode": MODE.format(c="p_brand", t="part", w=" AND p_size = 7"),
    "algebra_by_sql": "SELECT round(avg(l_quantity), 4) AS value FROM lineitem WHERE l_returnflag = 'R'",
    "unique_max": "SELECT CASE WHEN count(*) FILTER (p_size = m) = 1 THEN max(p_size) END::BIGINT AS value FROM part, (SELECT max(p_size) AS m FROM part) UNION ALL SELECT max(o_orderkey) FROM orders",
    "coverage_all_files": "WITH e AS (SELECT DISTINCT l_orderkey, l_partkey, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 5) AS h FROM lineitem), g AS (SELECT l_orderkey, count(*) AS items, count(*) FILTER (h) AS hit, bool_and(h) AS complete FROM e GROUP BY 1) SELECT items, hit, complete, count(*) AS orders FROM g GROUP BY ALL",
    "input_bytes": "WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), j AS (SELECT l_orderkey, p_size FROM e LEFT JOIN (SELECT * FROM part WHERE p_size > 3) ON l_partkey = p_partkey) SELECT l_orderkey, CASE WHEN count(*) = count(p_size) THEN sum(p_size)::BIGINT END AS input_bytes FROM j GROUP BY 1",
    "split_notebook_overlap": "SELECT o_custkey || '_qa_' || o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "upsert_sizes": "WITH o AS (SELECT p_partkey AS k, p_size::BIGINT AS v FROM part), n AS (SELECT s_suppkey * 30 AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS v FROM supplier) SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.k = n.k",
    "carried_rows": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)",
    "pivot_table": "SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS mean_f, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS mean_o FROM lineitem GROUP BY 1",
    "melt": "SELECT s_suppkey, 'nation' AS variable, s_nationkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier",
    "dummies": "SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS building, (c_mktsegment = 'MACHINERY')::INT AS machinery FROM customer",
    "factorize": "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer",
    "group_mode": "WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY p_brand) AS top FROM c) SELECT p_brand, CASE WHEN count(*) = 1 THEN max(p_size) END AS mode FROM m WHERE n = top GROUP BY 1",
    "describe_numbers": "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75 FROM lineitem GROUP BY 1",
    "correlations": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr, round(covar_samp(l_quantity, l_discount), 6) AS cov FROM lineitem",
    "band_join": "WITH p AS (SELECT p_partkey, floor(p_retailprice)::BIGINT AS lo FROM part) SELECT p_partkey, count(*) AS orders FROM p JOIN orders ON floor(o_totalprice)::BIGINT >= lo AND floor(o_totalprice)::BIGINT < lo + 50 GROUP BY 1",
    "top_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "revenue_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
}
