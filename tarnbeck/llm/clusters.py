"""Operator 11, centroid clustering with weighted deduplication.

Vectors are turned into integers; identical ones become one row with a multiplicity. Lloyd's rounds run over those distinct
rows only: each task adds up its vectors times their multiplicities per centroid, exactly, and sends one partial sum for each
centroid and component; the new centroids (k rows) go to the next round. At the end the assignments of the distinct vectors
are joined back to the keys, so copies cost one distance whatever their number.

Left out: null vectors, vectors of another length, vectors with a null or non-finite component. Components of 2**27 and more
after scaling raise an error, since their squared distances do not fit a long. A null key stays; it is never a start.
Rows that repeat count each; a repeated key with different vectors starts by hash, then vector. With fewer kept vectors than
centroids there are as many centroids as vectors; without vectors the result is empty. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, written

#: Bound of a component after scaling: 64 squares of differences stay below 2**62.
LIMIT = 1 << 27
#: Below this, products of 64 components are exact in floating point, which multiplies matrices faster.
EXACT = 1 << 22


def quantised(vectors: DataFrame, key: str, vector: str, dimension: int, scale: int) -> DataFrame:
    """(key, q array<int>): the whole vectors with floor(scale * x) for each component."""
    c = F.col(vector)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    cell = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    fits = lambda v: F.when(F.abs(v) < LIMIT, v).otherwise(F.raise_error(F.lit(f"a scaled component is {LIMIT} or more")).cast("bigint"))
    return vectors.where((F.size(c) == dimension) & finite).select(F.col(key).alias("key"), F.transform(F.transform(c, cell), fits).cast("array<int>").alias("q"))


def matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each vector; ties go to the smaller number."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        cross = (v.astype(float) @ centroids.T.astype(float)).astype(np.int64)
    else:
        cross = v @ centroids.T
    far = (v * v).sum(1)[:, None] - 2 * cross + (centroids * centroids).sum(1)
    near = far.argmin(1)
    return near, far[np.arange(len(v)), near]


def partial_sums(centroids: np.ndarray):
    """Batches of (q, weight) to one row for each centroid and component that the task's vectors add to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        n, total = [0] * k, np.zeros((k, width), object)
        for b in batches:
            if not b.num_rows:
                continue
            v, w = matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            near, _ = nearest(v, centroids)
            if int(w.sum(dtype=object)) * int(np.abs(v).max(initial=0)) >= 1 << 62:
                v, w = v.astype(object), w.astype(object)
            for c in np.unique(near).tolist():
                mine = near == c
                n[c] += int(w[mine].sum())
                total[c] += (w[mine, None] * v[mine]).sum(0).astype(object)
        met = [c for c in range(k) if n[c]]
        if met:
            sums = [Decimal(int(x)) for c in met for x in total[c]]
            cells = [np.repeat(met, width).astype(np.int32), np.tile(np.arange(width, dtype=np.int32), len(met)), np.repeat([n[c] for c in met], width)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cells), pa.array(sums, pa.decimal128(38, 0))], names=["cluster", "at", "n", "total"])

    return run


def assignments(centroids: np.ndarray):
    """Batches of (q, weight) with cluster and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near, far = nearest(matrix(b.column(0)), centroids)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(far)], names=["q", "weight", "cluster", "distance"])

    return run


def centroid_clusters(
    vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3, dimension: int = 64, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid) of every kept vector after so many rounds.

    The start: the vectors with the k smallest sha256 of `seed:key`. A round that moves no centroid ends the rounds, as
    all later ones would change nothing.
    """
    spark = vectors.sparkSession
    kept = quantised(vectors, key, vector, dimension, scale)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    start = kept.select(draw.alias("draw"), "q").orderBy(F.col("draw").asc_nulls_last(), "q").limit(k).collect()
    centroids = np.array([r.q for r in start], np.int64).reshape(len(start), dimension)
    groups = written(kept.groupBy("q").agg(F.count(F.lit(1)).alias("weight")), "distinct-vectors")
    for _ in range(rounds if start else 0):
        parts = groups.mapInArrow(lean(partial_sums(centroids)), "cluster int, at int, n long, total decimal(38,0)")
        moved = centroids.copy()
        for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            moved[r.cluster, r.at] = int(r.total) // r.n
        if (moved == centroids).all():
            break
        centroids = moved
    if not start:
        kind = vectors.select(key).schema[0].dataType.simpleString()
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<bigint>")
    placed = written(groups.mapInArrow(lean(assignments(centroids)), "q array<int>, weight long, cluster int, distance long"), "assignments")
    cost = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("weight").cast("decimal(19,0)"))
    spent = {r.cluster: int(r.cost) for r in placed.groupBy("cluster").agg(cost.alias("cost")).collect()}
    about = [(c, spent.get(c, 0), sum(spent.values()), row) for c, row in enumerate(centroids.tolist())]
    known = F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<bigint>"))  # k rows
    return kept.join(placed.drop("weight"), "q").join(known, "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroid_clusters(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.withColumn("centroid_sha256", digest).drop("centroid")


def _sql(k: int = 8, rounds: int = 10) -> str:
    """The same over one row for each vector and component, the rounds written out one after the other."""
    near = """
    select vec_no, vec_id, arg_min(c, d) as c, min(d) as d from (
      select vec_no, vec_id, c, d * {k} + c as d_c, d from (
        select v.vec_no, v.vec_id, m.c, sum((v.x - m.x) * (v.x - m.x)) as d from v join c{r} m on v.i = m.i group by v.vec_no, v.vec_id, m.c))
    group by vec_no, vec_id""".replace("arg_min(c, d)", "arg_min(c, d_c)").replace("{k}", str(k))
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} as ({near.replace('{r}', str(r))})")
        if r < rounds:
            steps.append(
                f"""s{r + 1} as (select a.c, v.i, cast(sum(v.x) as bigint) as s, count(*) as n from v join a{r} a on a.vec_no = v.vec_no group by a.c, v.i),
c{r + 1} as (select o.c, o.i, case when s.n is null then o.x else (s.s - ((s.s % s.n) + s.n) % s.n) // s.n end as x from c{r} o left join s{r + 1} s on s.c = o.c and s.i = o.i)"""
            )
    last = f"a{rounds}"
    return f"""
with kept as (
  select row_number() over (order by vec_id) as vec_no, vec_id, embedding from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
v as (
  select vec_no, vec_id, i, cast(floor(1024 * cast(embedding[i] as double)) as bigint) as x
  from kept, (select unnest(range(1, 65)) as i) places),
ranked as (select vec_no, row_number() over (order by sha256('3:' || vec_id)) - 1 as c from kept),
c0 as (select r.c, v.i, v.x from ranked r join v on v.vec_no = r.vec_no where r.c < {k}),
{", ".join(steps)},
costs as (select c, sum(d) as cluster_inertia from {last} group by c),
ends as (select c, sha256(string_agg(cast(x as varchar), ',' order by i)) as centroid_sha256 from c{rounds} group by c)
select a.vec_id, cast(a.c as int) as cluster, cast(a.d as bigint) as distance, cast(costs.cluster_inertia as bigint) as cluster_inertia,
  cast((select sum(d) from {last}) as bigint) as inertia, ends.centroid_sha256
from {last} a join costs on costs.c = a.c join ends on ends.c = a.c"""


OP11_SQL = _sql()
