"""Order statistics and rank tests without sorting a group in one task.

Selection: a group's values are counted in ranges (by magnitude first, then in equal cells between the least and the greatest
value of the range that holds a wanted rank); each round keeps only those ranges, for all groups and ranks at once, until
a range is one value or small enough to be counted value by value. What is shuffled is counts: some thousand a group and round.

Ranks: distinct values with their counts are sorted into ranges; running counts within a range, and the totals of the ranges
before it (one row a range), give each value the number of rows below it. Equal values are one row, so ties never straddle.

Nulls are left out, NaN is the greatest value, -0.0 equals 0.0. Groups without a value have no row; null groups are groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import small, written

#: Cells of a range in one round, and rows of a range that are counted value by value.
CELLS, FINISH = 4096, 100_000
BROADCAST_ROWS = 500_000
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _key(c: Column, kind: T.DataType) -> Column:
    """A value as a long or a double of the same order."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), c)
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (c * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("long")
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return c.cast("long")
    raise TypeError(f"no ranks of {kind.simpleString()}")


def _value(c: Column, kind: T.DataType) -> Column:
    """The value of a key."""
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(c.cast("int"))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_add("MICROSECOND", c, F.expr(_EPOCH))
    if isinstance(kind, T.DecimalType):
        return (c.cast(f"decimal(38,{kind.scale})") / F.lit(10**kind.scale).cast("decimal(19,0)")).cast(kind)
    return c.cast(kind)


def _magnitude(v: Column, exact: bool) -> Column:
    """A first range of some thousand, in the values' order: leading bits of longs, binary exponents of doubles."""
    if exact:
        return F.shiftright(v, 52)
    step = F.when(F.abs(v) == float("inf"), 2500).otherwise(F.floor(F.log2(F.abs(v))) + 1100).cast("long")
    return F.when(F.isnan(v), F.lit(5000).cast("long")).when(v == 0, F.lit(0).cast("long")).otherwise(F.when(v > 0, step).otherwise(-step))


def at_ranks(df: DataFrame, by: list[str], value: str, wanted: Callable[[Column], Column], finish: int = FINISH) -> DataFrame:
    """(g, n, r, value): for each group g, struct of by, of n values the value at each rank r (from 0) of wanted(n), array<long>."""
    kind = df.schema[value].dataType
    exact = not isinstance(kind, (T.FloatType, T.DoubleType))
    group = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("all"))
    rows = df.where(F.col(value).isNotNull()).select(group.alias("g"), _key(F.col(value), kind).alias("v"))

    def placed(cells: DataFrame, keys: list[str], order: str, ranks: Column) -> DataFrame:
        """The wanted ranks with the cell that holds them; rest: the rank among the cell's rows. ranks: array<(n, r, rest)>."""
        w = Window.partitionBy(*keys)
        cells = cells.withColumns({"upto": F.sum("c").over(w.orderBy(order)), "n_all": F.sum("c").over(w)})
        held = F.filter(ranks, lambda x: (x["rest"] >= F.col("upto") - F.col("c")) & (x["rest"] < F.col("upto")))
        return cells.withColumn("x", F.explode(held)).select("g", "x.n", "x.r", (F.col("x.rest") - (F.col("upto") - F.col("c"))).alias("rest"), "low", "high", "c")

    def inside(brackets: DataFrame) -> DataFrame:
        """(g, lo, hi, v): rows within a bracket of their group."""
        listed = brackets.groupBy("g").agg(F.collect_set(F.struct(F.col("low").alias("lo"), F.col("high").alias("hi"))).alias("brackets"))
        own = F.filter("brackets", lambda x: (F.col("v") >= x["lo"]) & (F.col("v") <= x["hi"]))
        return rows.join(small(written(listed, "brackets"), BROADCAST_ROWS), "g").select("g", F.explode(own).alias("x"), "v").select("g", "x.lo", "x.hi", "v")

    def asked(targets: DataFrame) -> DataFrame:
        return targets.groupBy("g", F.col("low").alias("lo"), F.col("high").alias("hi")).agg(F.collect_list(F.struct("n", "r", "rest")).alias("ranks"))

    ends = [F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high")]
    first = rows.groupBy("g", _magnitude(F.col("v"), exact).alias("cell")).agg(*ends)
    n = F.col("n_all")
    start = F.transform(F.array_distinct(wanted(n)), lambda r: F.struct(n.alias("n"), r.cast("long").alias("r"), r.cast("long").alias("rest")))
    now = written(placed(first, ["g"], "cell", start), "ranks")
    single = F.col("low") == F.col("high")
    while not (wide := now.where(~single & (F.col("c") > finish))).isEmpty():
        part = (F.col("v") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double")
        cells = inside(wide).groupBy("g", "lo", "hi", F.floor(part * CELLS).alias("cell")).agg(*ends)
        keys = ["g", "lo", "hi"]
        now = written(now.where(single | (F.col("c") <= finish)).unionByName(placed(cells.join(asked(wide), keys), keys, "cell", F.col("ranks"))), "ranks")
    few = now.where(~single)
    values = inside(few).groupBy("g", "lo", "hi", "v").agg(F.count(F.lit(1)).alias("c")).withColumns({"low": F.col("v"), "high": F.col("v")})
    keys = ["g", "lo", "hi"]
    last = now if few.isEmpty() else now.where(single).unionByName(placed(values.join(asked(few), keys), keys, "v", F.col("ranks")))
    return last.select("g", "n", "r", _value(F.col("low"), kind).alias("value"))


def _spread(found: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    out = found.groupBy("g", "n").agg(*(c.alias(name) for name, c in columns.items()))
    return out.select(*(F.col("g")[c].alias(c) for c in by), "n", *columns)


def nearest_ranks(df: DataFrame, by: list[str], value: str, qs: dict[str, float], finish: int = FINISH) -> DataFrame:
    """by, and a column for each q: the value at half-even round(q * (n - 1)) of a group's sorted values."""
    rank = lambda n, q: F.bround(F.lit(q) * (n - 1), 0).cast("long")
    found = at_ranks(df, by, value, lambda n: F.array(*(rank(n, q) for q in qs.values())), finish)
    return _spread(found, by, {k: F.max(F.when(F.col("r") == rank(F.col("n"), q), F.col("value"))) for k, q in qs.items()}).drop("n")


def percentiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float], finish: int = FINISH) -> DataFrame:
    """by, and a double for each q: on the line between the values at the ranks beside q * (n - 1)."""
    at = lambda n, q: F.lit(q) * (n - 1)
    found = at_ranks(df, by, value, lambda n: F.array(*(f(at(n, q)).cast("long") for q in qs.values() for f in (F.floor, F.ceil))), finish)
    held = lambda f, q: F.max(F.when(F.col("r") == f(at(F.col("n"), q)), F.col("value").cast("double")))
    line = lambda q: held(F.floor, q) + (held(F.ceil, q) - held(F.floor, q)) * (at(F.col("n"), q) - F.floor(at(F.col("n"), q)))
    return _spread(found, by, {k: line(q) for k, q in qs.items()}).drop("n")


# ---- ranks of all rows ---------------------------------------------------------------------------------------------


def below(counts: DataFrame, value: str, n: str = "n") -> DataFrame:
    """counts, one row for each value, with below: the sum of n over smaller values."""
    schema = T.StructType([*counts.schema, T.StructField("__part", T.IntegerType()), T.StructField("__upto", T.LongType())])
    at = counts.columns.index(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            if b.num_rows:
                upto = np.cumsum(b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)) + total
                total = int(upto[-1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto)], names=schema.names)

    dealt = counts.repartitionByRange(F.col(value)).sortWithinPartitions(value).withColumn("__part", F.spark_partition_id())
    out = written(dealt.mapInArrow(run, schema), "running")
    before, offsets = 0, []
    for part, total in sorted(map(tuple, out.groupBy("__part").agg(F.max("__upto")).collect())):  # one row a range
        offsets.append((part, before))
        before += total
    known = F.broadcast(counts.sparkSession.createDataFrame(offsets, "__part int, __before long"))
    return out.join(known, "__part").withColumn("below", F.col("__before") + F.col("__upto") - F.col(n)).select(*counts.columns, "below")


def midranks(counts: DataFrame, value: str, n: str = "n") -> DataFrame:
    """counts, one row for each value, with midrank: the mean rank, from 1, of its rows."""
    return below(counts, value, n).withColumn("midrank", F.col("below") + (F.col(n) + 1) / 2.0).drop("below")


def _ties(n: Column) -> Column:
    c = n.cast("double")
    return F.sum(c * c * c - c)


@F.pandas_udf(T.DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    """Probability of a normal value at least as far from 0."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x else None)


def _gamma_above(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * total:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    # modified Lentz
    b = x + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 10_000):
        an, b = -i * (i - a), b + 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


@F.pandas_udf(T.DoubleType())
def chi_square_above(x: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([_gamma_above(k / 2, v / 2) if v == v and k > 0 else None for v, k in zip(x, freedom, strict=True)], dtype=object)


def mann_whitney(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """One row (n_a, n_b, u_a, z, p): pairs in which a's value is larger, ties a half, and its normal approximation.

    z is corrected for ties, p (two-sided) for continuity too; both are null without spread or without rows of a group.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(group).isin(a, b))
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == a).alias("n_a"), F.count(F.lit(1)).alias("n"))
    sums = midranks(counts, "v").agg(F.sum("n_a").alias("n_a"), F.sum(F.col("n") - F.col("n_a")).alias("n_b"), F.sum(F.col("n_a") * F.col("midrank")).alias("r_a"), _ties(F.col("n")).alias("ties"))
    x, y = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    out = sums.where("n_a is not null").withColumn("u_a", F.col("r_a") - x * (x + 1) / 2)
    spread = F.sqrt(x * y / 12 * (x + y + 1 - F.try_divide(F.col("ties"), (x + y) * (x + y - 1))))
    off = F.col("u_a") - x * y / 2
    near = F.greatest(F.abs(off) - 0.5, F.lit(0.0))
    return out.select("n_a", "n_b", "u_a", F.try_divide(off, spread).alias("z"), two_sided(F.try_divide(near, spread)).alias("p"))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row (n, n_groups, h, p): whether groups differ in rank, corrected for ties; null without spread."""
    cells = written(df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(value).alias("v"), F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("c")), "cells")
    ranked = written(midranks(cells.groupBy("v").agg(F.sum("c").alias("n")), "v"), "midranks")
    sums = cells.join(ranked, "v").groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("midrank")).alias("r"))
    ties = ranked.agg(_ties(F.col("n")).alias("ties"))
    # about one row: sums over groups, and over values
    one = sums.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s")).where("n_groups > 0")
    one = one.withColumn("ties", F.lit(ties.first()[0]))
    n = F.col("n").cast("double")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.try_divide(F.col("ties"), n * n * n - n))
    return one.withColumn("h", h).select("n", "n_groups", "h", chi_square_above(F.col("h"), (F.col("n_groups") - 1).cast("double")).alias("p"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho): correlation of the midranks of the rows that have both values; rho is null without spread."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("c"))
    pairs = written(pairs, "pairs")
    side = lambda c: midranks(pairs.groupBy(c).agg(F.sum("c").alias("n")), c).select(c, F.col("midrank").alias(f"r_{c}"))
    n = pairs.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    dx, dy, c = F.col("r_x") - (n + 1) / 2, F.col("r_y") - (n + 1) / 2, F.col("c")
    sums = pairs.join(side("x"), "x").join(side("y"), "y").agg(F.sum(c * dx * dy).alias("xy"), F.sum(c * dx * dx).alias("xx"), F.sum(c * dy * dy).alias("yy"))
    return sums.select(F.lit(n).cast("long").alias("n"), F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))
