"""Sinks: JSON lines, partitioned results, split exports with an index and a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_results(df: DataFrame, path: str) -> None:
    """Results by tag, split and rung, so that a reader of one rung reads no other."""
    df.write.mode("append").partitionBy("tag", "split", "rung").parquet(path)


def export_split(df: DataFrame, path: str, part: str = "part", index: tuple[str, ...] = ()) -> dict[str, int]:
    """Rows below path/rows/part=..., their provenance columns below path/index; returns the counts, observed while writing."""
    seen = Observation("export")
    counted = df.observe(seen, F.count("*").alias("rows"), F.count_if(F.col(part) == "val").alias("val"))
    counted.drop(*index).write.mode("errorifexists").partitionBy(part).json(f"{path}/rows")
    if index:
        df.select(*index, part).write.mode("errorifexists").json(f"{path}/index")
    return {"rows": seen.get["rows"], "val": seen.get["val"], "train": seen.get["rows"] - seen.get["val"]}


def write_report(df: DataFrame, dropped: DataFrame, path: str, part: str = "part", index: tuple[str, ...] = ()) -> dict[str, int]:
    """export_split, with the counts of what was dropped (reason, n) beside them in a manifest."""
    counts = export_split(df, path, part, index)
    spark = df.sparkSession
    kept = spark.createDataFrame([(k, v) for k, v in counts.items()], "name string, value long")
    write_manifest(kept.unionByName(dropped.select(F.concat(F.lit("dropped: "), "reason").alias("name"), F.col("n").cast("long").alias("value"))), f"{path}/manifest")
    return counts


def write_heartbeat(row: DataFrame, path: str, key: str) -> None:
    """Replaces the one row of each key in row; the file of another key stays as it is."""
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def write_manifest(counts: DataFrame, path: str) -> None:
    """A small table of (name, value) as one JSON file."""
    counts.coalesce(1).write.mode("overwrite").json(path)
