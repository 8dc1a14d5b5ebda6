"""A keyed table written by streams: last wins, a replayed batch changes nothing, a killed writer leaves nothing that counts.

A batch's rows are reduced to the last one of each key and written to a folder of their own; only then is the batch entered in
the manifest, one small file a batch, which is what readers follow. So files of an attempt that did not get so far are never
read, and a batch that is entered is not written again. Compaction writes the table of all batches so far as a snapshot and
enters it in the same way.

layout: <path>/data/<folder>, <path>/manifest/batch=<id> with (folder, snapshot): snapshot is true where the folder holds the
whole table up to and including that batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "folder string, snapshot boolean"


def manifest(spark: SparkSession, path: str) -> list[tuple[int, str, bool]]:
    """(batch, folder, snapshot) of what readers see, in order: the last snapshot and the batches after it."""
    try:
        rows = spark.read.schema(f"{_ENTRY}, batch long").json(f"{path}/manifest").where("folder is not null").collect()  # one small row a batch
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    rows = sorted((r.batch, not r.snapshot, r.folder) for r in rows)
    start = max((i for i, r in enumerate(rows) if not r[1]), default=0)
    # a batch that its snapshot holds sorts behind it and adds nothing
    return [(b, f, not plain) for b, plain, f in rows[start:] if not plain or b > rows[start][0] or rows[start][1]]


def _enter(spark: SparkSession, path: str, batch: int, folder: str, snapshot: bool) -> None:
    entry = spark.createDataFrame([(folder, snapshot)], _ENTRY).coalesce(1)
    entry.write.mode("append" if snapshot else "errorifexists").json(f"{path}/manifest/batch={batch}")


def last_rows(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the greatest order of each key; of equal ones the greatest row."""
    row = F.struct(*df.columns)
    held = df.groupBy(*(F.col(k).alias(f"__{i}") for i, k in enumerate(keys))).agg(F.max(F.struct(order.alias("order"), row.alias("row"))).alias("best"))
    return held.select("best.row.*")


def upsert(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """The function for foreachBatch that writes batches to the table; one writer at a time."""

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        if any(b >= batch for b, _, _ in manifest(spark, path)):
            return  # entered before: the stream is replaying it
        folder = f"{batch}-{uuid.uuid4().hex}"
        last_rows(df, keys, F.col(order)).write.parquet(f"{path}/data/{folder}")
        _enter(spark, path, batch, folder, False)

    return write


def read_upserts(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame | None:
    """The table: the last row of each key over the batches entered, by order and then by batch; None before the first batch."""
    entered = manifest(spark, path)
    if not entered:
        return None
    at = {folder: batch for batch, folder, _ in entered}
    df = spark.read.option("mergeSchema", True).parquet(*(f"{path}/data/{f}" for f in at))
    if len(at) == 1:
        return df
    columns = df.columns
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(\d+)-[^/]*/[^/]*$", 1).cast("long")
    return last_rows(df.select(*columns, name.alias("__batch")), keys, F.struct(F.col(order), F.col("__batch"))).select(*columns)


def compact(spark: SparkSession, path: str, keys: list[str], order: str) -> None:
    """Writes the table as one snapshot; readers that began before go on with the older files, which stay."""
    entered = manifest(spark, path)
    if len(entered) < 2:
        return
    batch, folder = entered[-1][0], f"{entered[-1][0]}-{uuid.uuid4().hex}"
    read_upserts(spark, path, keys, order).write.parquet(f"{path}/data/{folder}")
    _enter(spark, path, batch, folder, True)
