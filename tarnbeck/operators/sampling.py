"""Deterministic samples and splits by hash rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(seed: int, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)


def smallest(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows by hash rank: each task keeps its own n, so nothing is sorted as a whole."""
    return rows.withColumn("__h", draw_key(seed, F.col(key))).orderBy("__h", key).limit(n).drop("__h")


def blind_sample(rows: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each label by hash rank, without the label, with their place in the shuffled order."""
    w = Window.partitionBy(label).orderBy("__h", key)
    picked = rows.withColumn("__h", draw_key(seed, F.col(label), F.col(key))).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    return picked.select(key, F.row_number().over(Window.orderBy("__h", key)).alias("place"))


def quotas(counts: DataFrame, stratum: str, n: int) -> DataFrame:
    """(stratum, quota): largest remainders, ties by name. counts: (stratum, size), a few rows."""
    total = counts.select(stratum, "size", (F.lit(n) * F.col("size") / F.sum("size").over(Window.partitionBy(F.lit(0)))).alias("exact"))
    part = total.withColumn("base", F.floor("exact")).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("exact") - F.floor("exact"), 9)), stratum)))
    left = F.lit(n) - F.sum("base").over(Window.partitionBy(F.lit(0)))
    return part.select(stratum, F.least("size", F.col("base") + (F.col("rank") <= left).cast("long")).alias("quota"))


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """(key, stratum) of n rows, each stratum by its share, drawn by hash rank."""
    q = quotas(rows.groupBy(stratum).agg(F.count("*").alias("size")), stratum, n)
    ranked = rows.select(key, stratum, draw_key(seed, F.col(stratum), F.col(key)).alias("__h"))
    # the bound on the rank is pushed below the shuffle: each task sends at most n rows of a stratum
    w = Window.partitionBy(stratum).orderBy("__h", key)
    return ranked.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).join(q, stratum).where("__n <= quota").select(key, stratum)


def split_by_hash(rows: DataFrame, position: Column, fraction: float, seed: int) -> DataFrame:
    """rows with part: val for the half-even round(n * fraction) rows with the smallest sha256("seed:position"), else train.

    The bound is the k-th smallest hash. Counts by the first 16 bits, one table of 65,536 rows, tell the part of the range
    that holds it; only the hashes of that part are sorted, and the rows are then compared with the bound in place.
    """
    marked = rows.withColumn("__h", draw_key(seed, position))
    counts = sorted((r.p, r.n) for r in marked.groupBy(F.substring("__h", 1, 4).alias("p")).agg(F.count("*").alias("n")).collect())
    k = int(round(sum(n for _, n in counts) * fraction))
    if not k:
        return marked.withColumn("part", F.lit("train")).drop("__h")
    for prefix, n in counts:
        if k <= n:
            break
        k -= n
    bound = marked.select("__h").where(F.substring("__h", 1, 4) == prefix).orderBy("__h").limit(k).agg(F.max("__h").alias("__b"))
    return marked.crossJoin(F.broadcast(bound)).withColumn("part", F.when(F.col("__h") <= F.col("__b"), "val").otherwise("train")).drop("__h", "__b")


def bench_rows(tables: list[DataFrame], key: Column, n: int, seed: int = 0) -> DataFrame:
    """The n rows of all tables together with the smallest hashes of their key, in that order."""
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows.withColumn("__h", draw_key(seed, key)).orderBy("__h").limit(n).drop("__h")


def split_stable(rows: DataFrame, key: Column, fraction: float, seed: int) -> DataFrame:
    """rows with part, by the first 32 bits of the key's hash: a row keeps its part whatever else is there."""
    u = F.conv(F.substring(draw_key(seed, key), 1, 8), 16, 10).cast("double") / float(2**32)
    return rows.withColumn("part", F.when(u < fraction, "val").otherwise("train"))
