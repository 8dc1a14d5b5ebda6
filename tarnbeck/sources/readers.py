"""Readers by format: delimited text with sniffed separators, JSON documents, JSON lines, SQLite, spreadsheets, result trees.

Everything that grows with the data is read by Spark. Only the sniff looks at one file's first bytes, through Spark as well,
so that paths in any store work.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import register
from .trees import TextTables

SEPARATORS = (",", ";", "\t", "|")
SNIFF_LINES = 50


def sniff(spark: SparkSession, path: str) -> str:
    """The separator that the suffix suggests, or the first other one, that gives the head of a file more than one column.

    A separator within quotes splits nothing.
    """
    preferred = "\t" if path.lower().endswith((".tsv", ".tab")) else ","
    head = [r[0] for r in spark.read.text(path).limit(SNIFF_LINES).collect()]
    for sep in dict.fromkeys((preferred, *SEPARATORS)):
        if head and len(next(csv.reader(head[:1], delimiter=sep), [])) > 1:
            return sep
    return preferred


def read_delimited(spark: SparkSession, path: str, strict: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """All rows of delimited files; strict: a row that does not fit fails the query."""
    reader = spark.read.option("sep", sniff(spark, path)).option("header", True).option("inferSchema", True).option("encoding", encoding)
    return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path)


def read_json_table(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document that is a list of objects, or an object of objects, as a table; anything else has no rows."""
    raw = spark.read.text(path, wholetext=True).withColumn("value", F.trim("value"))
    rows = raw.select(F.explode(F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.map_values(F.from_json("value", "map<string,string>")))).alias("value")).where("value like '{%'")
    # the reader infers a schema from strings only as an RDD
    return spark.read.json(rows.rdd.map(lambda r: r[0]))


def read_lines(spark: SparkSession, paths: str | list[str], schema=None, drop_bad: bool = True) -> DataFrame:
    """JSON lines; lines that are no object are dropped, or kept with _corrupt_record."""
    reader = spark.read.option("mode", "DROPMALFORMED" if drop_bad else "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(paths)


def read_any(spark: SparkSession, path: str, tables: Sequence[str] | None = None) -> DataFrame:
    """A table by its suffix; of SQLite files and spreadsheets those tables that are asked for."""
    asked = {} if tables is None else {"tables": json.dumps(list(tables))}
    suffix = path.lower().rsplit(".", 1)[-1]
    if suffix in ("parquet", "parq"):
        return spark.read.parquet(path)
    if suffix in ("jsonl", "ndjson"):
        return read_lines(spark, path)
    if suffix == "json":
        return read_json_table(spark, path)
    if suffix in ("sqlite", "sqlite3", "db"):
        register(spark)
        return spark.read.format("sqlite_tables").options(path=path, **asked).load()
    if suffix in ("xlsx", "xlsm"):
        register(spark)
        return spark.read.format("xlsx_rows").options(path=path, **asked).load()
    return read_delimited(spark, path)


def read_tree(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """(path, at, values, error) of all delimited files below a folder; see sources.trees for the options."""
    spark.dataSource.register(TextTables)
    return spark.read.format("text_tables").options(**options).load(root)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str | None = None, where: Sequence[tuple] = (), **options: object) -> DataFrame:
    """A table of a SQLite file with its own columns, or those of schema alone.

    where: (column, sign, value) tests that all hold, with =, >, >=, <, <=, in or is not null; they go into the query, and are
    tested again here. The columns tested have to be among those read.
    """
    register(spark)
    reader = spark.read.format("sqlite_tables").options(path=path, table=table, where=json.dumps(list(where)), **options)
    df = (reader.schema(schema) if schema else reader).load()
    for name, sign, value in where:
        c = F.col(f"`{name}`")
        tests = {"=": c.__eq__, ">": c.__gt__, ">=": c.__ge__, "<": c.__lt__, "<=": c.__le__, "in": c.isin, "is not null": lambda _, c=c: c.isNotNull()}
        df = df.where(tests[sign](value))
    return df


def read_results(spark: SparkSession, root: str, schema) -> DataFrame:
    """Result files <root>/<task>/<rung>[/s<sample>]/result.json, with task, rung and sample from the path; a recorded sample wins.

    An unreadable file is a row whose agent_status says so.
    """
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "result.json").option("multiLine", True).json(root)
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, r"/([^/]+)/([^/]+)(?:/s(\d+))?/result\.json$", i)
    sample = F.coalesce(F.col("sample") if "sample" in df.columns else F.lit(None), F.nullif(part(3), F.lit("")).try_cast("int"), F.lit(0))
    rest = [c for c in df.columns if c not in ("task_id", "rung", "sample", "agent_status")]
    return df.select(part(1).alias("task_id"), part(2).alias("rung"), sample.cast("int").alias("sample"), F.coalesce("agent_status", F.lit("unreadable result")).alias("agent_status"), *rest)


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """(ok, name) from lines of PASS or FAIL, a tab and a name."""
    return spark.read.csv(path, sep="\t", schema="state string, name string").select((F.col("state") == "PASS").alias("ok"), "name")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
