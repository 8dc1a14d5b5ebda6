"""Queries over the table vocabulary: backward fills, bounds, masks, running products, stacking, durations and file readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.operators import frames, staging
from tarnbeck.sources import readers, sinks


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def backward_fill(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_totalprice") > 150_000, F.col("o_totalprice")).alias("v"))
    return frames.filled(o, "o_custkey", ["o_orderkey"], "v", forward=False)


def bounded_columns(spark, d):
    """clip, mask, replace and isin side by side."""
    c = F.col("c_acctbal")
    named = frames.replaced(F.col("c_mktsegment"), {"BUILDING": "house", "MACHINERY": "engine"})
    return read(spark, d, "customer").select(
        "c_custkey",
        frames.clip(c, 0.0, 5000.0).alias("clipped"),
        frames.mask(c, c < 0).alias("masked"),
        named.alias("segment"),
        F.col("c_nationkey").isin(1, 3, 5).alias("chosen"),
    )


def expanding_columns(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", (1 - F.col("o_orderkey") % 7 / 10).alias("keep"))
    out = frames.expanding(o, "o_custkey", ["o_orderkey"], "keep")
    return out.select("o_custkey", "o_orderkey", *(F.round(c, 9).alias(c) for c in ("cum_prod", "cum_min", "expanding_mean")))


def stacked(spark, d):
    """Counts by flag and status, unstacked into columns and stacked again; empty cells go."""
    counts = read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    wide = frames.unstack(counts, ["l_returnflag"], "l_linestatus", "n", ["F", "O", "X"])
    return frames.stack(wide, ["l_returnflag"], ["F", "O", "X"], "l_linestatus", "n")


def durations(spark, d):
    li = read(spark, d, "lineitem")
    text = F.concat(F.when(F.col("l_tax") > 0.04, F.lit("-")).otherwise(""), F.col("l_linenumber"), F.lit(" days "), F.format_string("%02d:%02d:07.5", F.pmod("l_partkey", F.lit(24)), F.pmod("l_suppkey", F.lit(60))))
    broken = F.when(F.col("l_linenumber") == 7, F.lit("soon")).otherwise(text)
    return li.select("l_orderkey", "l_linenumber", frames.seconds_of(broken).alias("seconds"))


def lines_round_trip(spark, d):
    """Rows written as JSON lines and read again, beside a line that is no object."""
    path = staging.shared_path(spark, "lines")
    sinks.write_lines(read(spark, d, "nation"), path)
    spark.createDataFrame([("no object",)], "value string").coalesce(1).write.mode("append").text(path)
    back = readers.read_lines(spark, path, "n_nationkey int, n_name string, n_regionkey int")
    return back.join(read(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("customers"))


def check_lines(spark, d):
    """Lines of checks as a tool writes them, read as a table."""
    path = staging.shared_path(spark, "checks")
    state = F.when(F.col("o_totalprice") > 100_000, "PASS").otherwise("FAIL")
    read(spark, d, "orders").select(F.concat_ws("\t", state, F.concat(F.lit("order "), "o_orderpriority"))).write.text(path)
    return readers.read_checks(spark, path).groupBy("name").agg(F.count_if("ok").alias("passed"), F.count("*").alias("n"))


def hashed_files(spark, d):
    """Files by nation: their number, and as many hashes as there are different ones."""
    path = staging.shared_path(spark, "files")
    read(spark, d, "supplier").repartition(1, "s_nationkey").select("s_nationkey", F.col("s_suppkey").cast("string").alias("value")).write.partitionBy("s_nationkey").text(path)
    found = readers.file_hashes(spark, path).where("path like '%/part-%'")
    return found.agg(F.count("*").alias("files"), F.count_distinct("sha256").alias("hashes"), F.sum("bytes").alias("bytes"))


QUERIES = {f.__name__: f for f in (backward_fill, bounded_columns, expanding_columns, stacked, durations, lines_round_trip, check_lines, hashed_files)}
_RUN = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)"
ORACLE = {
    "backward_fill": """WITH a AS (SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice > 150000 THEN o_totalprice END AS v FROM orders), b AS (SELECT x.o_custkey, x.o_orderkey, min(y.o_orderkey) AS at FROM a x
        LEFT JOIN a y ON y.o_custkey = x.o_custkey AND y.o_orderkey >= x.o_orderkey AND y.v IS NOT NULL GROUP BY ALL) SELECT b.o_custkey, b.o_orderkey, a.v FROM b LEFT JOIN a ON a.o_orderkey = b.at""",
    "bounded_columns": """SELECT c_custkey, greatest(0.0::DOUBLE, least(5000.0::DOUBLE, c_acctbal)) AS clipped, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS masked,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'house' WHEN 'MACHINERY' THEN 'engine' ELSE c_mktsegment END AS segment, c_nationkey IN (1, 3, 5) AS chosen FROM customer""",
    "expanding_columns": f"""WITH a AS (SELECT o_custkey, o_orderkey, 1 - o_orderkey % 7 / 10.0::DOUBLE AS k FROM orders)
        SELECT o_custkey, o_orderkey, round(exp(sum(ln(k)) {_RUN}), 9) AS cum_prod, round(min(k) {_RUN}, 9) AS cum_min, round(avg(k) {_RUN}, 9) AS expanding_mean FROM a""",
    "stacked": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL",
    "durations": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 7 THEN (CASE WHEN l_tax > 0.04 THEN -1 ELSE 1 END) * (l_linenumber * 86400 + (l_partkey % 24) * 3600 + (l_suppkey % 60) * 60 + 7.5)::DOUBLE END AS seconds FROM lineitem""",
    "lines_round_trip": "SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
    "check_lines": "SELECT 'order ' || o_orderpriority AS name, count(*) FILTER (o_totalprice > 100000) AS passed, count(*) AS n FROM orders GROUP BY 1",
    "hashed_files": "SELECT count(DISTINCT s_nationkey) AS files, count(DISTINCT s_nationkey) AS hashes, sum(length(s_suppkey::VARCHAR) + 1)::BIGINT AS bytes FROM supplier",
}
