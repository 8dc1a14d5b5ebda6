"""Tables between the steps of a job: written to the folder that the driver and all executors see, and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_name(uri: str) -> str | None:
    """The plain path of a file: URI or path, else None."""
    u = urlparse(uri)
    return (u.path if u.scheme == "file" else uri) if u.scheme in ("", "file") else None


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset, one of our own: in local mode a temporary folder that goes when the driver ends, on a cluster one
    below the warehouse, which all executors see unless it is a local folder: that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            own = tempfile.mkdtemp(prefix="tarnbeck-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            root = "file://" + own
        else:
            root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
            if local_name(root) is not None:
                raise ValueError(f"set spark.checkpoint.dir to a folder that all executors see; the warehouse {root} is a local one")
        spark.conf.set("spark.checkpoint.dir", root)
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: later steps neither recompute it nor lose it with an executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, a written table, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df
