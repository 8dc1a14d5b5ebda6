"""Table vocabulary that Spark has no single call for: as-of joins, fills, interpolation, smoothing, bias-corrected moments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import below


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, values: list[str], tie: str | None = None) -> DataFrame:
    """left with the values of the last right row of the same key at or before its time; null without one.

    Both sides go through one window over their union, so a key costs its rows and no pairs. Of right rows at the same time
    the one with the largest `tie` counts.
    """
    tag = F.struct(*values) if not tie else F.struct(*values, F.col(tie).alias("__tie"))
    r = right.where(F.col(on).isNotNull()).select(F.col(by).alias("__by"), F.col(on).alias("__on"), tag.alias("__v"), F.lit(0).alias("__side"), (F.col(tie) if tie else F.lit(0)).cast("string").alias("__t"))
    own = F.struct(*left.columns)
    a = left.select(F.col(by).alias("__by"), F.col(on).alias("__on"), own.alias("__l"), F.lit(1).alias("__side"))
    both = a.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy("__by").orderBy("__on", "__side", "__t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select("__l.*", *(F.col(f"__v.{v}").alias(v) for v in values))


def filled(df: DataFrame, by: str, order: list[str], column: str, forward: bool = True) -> DataFrame:
    """df with the nulls of a column filled from the last (or next) value."""
    w = Window.partitionBy(by).orderBy(*order)
    c = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if forward else F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(column, c)


def interpolated(df: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """df with nulls between two values on the line through them by row place; after the last value it stays."""
    w = Window.partitionBy(by).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    place = F.when(F.col(column).isNotNull(), F.col("__i"))
    d = df.withColumn("__i", F.row_number().over(w))
    d = d.withColumns({"__a": F.last(column, ignorenulls=True).over(back), "__b": F.first(column, ignorenulls=True).over(ahead), "__ia": F.last(place, ignorenulls=True).over(back), "__ib": F.first(place, ignorenulls=True).over(ahead)})
    line = F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__i") - F.col("__ia")) / (F.col("__ib") - F.col("__ia"))
    return d.withColumn(column, F.coalesce(F.col(column), line, F.col("__a"))).drop("__i", "__a", "__b", "__ia", "__ib")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over the session's cores if its scan has fewer tasks, as a file of one row group has; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ewm_mean(df: DataFrame, by: str, order: str, column: str, alpha: float) -> DataFrame:
    """(by, order, ewm): exponentially weighted mean with adjusted weights; rows stream in order, the state is two numbers."""
    kinds = dict(df.dtypes)
    src = df.select(by, order, F.col(column).cast("double").alias("v")).repartition(by).sortWithinPartitions(by, order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, top, weight = object(), 0.0, 0.0
        for pdf in frames:
            out = []
            for k, v in zip(pdf[by], pdf["v"], strict=True):
                if k != last:
                    last, top, weight = k, 0.0, 0.0
                top, weight = top * (1 - alpha), weight * (1 - alpha)
                if v == v:
                    top, weight = top + v, weight + 1
                out.append(top / weight if weight else None)
            yield pd.DataFrame({by: pdf[by], order: pdf[order], "ewm": out})

    return src.mapInPandas(run, f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, ewm double")


def skew(c: Column) -> Column:
    """Aggregate: bias-corrected skewness, null with fewer than three values."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1.0)) / (n - 2))


def kurt(c: Column) -> Column:
    """Aggregate: bias-corrected excess kurtosis, null with fewer than four values."""
    n = F.count(c)
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(c) + 6))


def sem(c: Column) -> Column:
    """Aggregate: standard error of the mean."""
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def unique_mode(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, mode): the most frequent value, null if several are."""
    n = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    top = n.groupBy(*by).agg(F.max(F.struct("n", column)).alias("hi"), F.min(F.struct(-F.col("n"), F.col(column))).alias("lo"))
    return top.select(*by, F.when(F.col(f"hi.{column}") == F.col(f"lo.{column}"), F.col(f"hi.{column}")).alias("mode"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of row values by stated column values, 0 where there are none."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def dummies(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.select(*df.columns, *(F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(f"{column}_{v}") for v in values))


def factorized(df: DataFrame, column: str) -> DataFrame:
    """df with code: numbers of the sorted distinct values from 0, -1 for null."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("__one", F.lit(1))
    codes = below(values, column, "__one").select(column, F.col("below").alias("code"))
    return df.join(codes, column, "left").withColumn("code", F.coalesce("code", F.lit(-1)))


def running(df: DataFrame, by: str, order: list[str], column: str, window: int = 3) -> DataFrame:
    """df with cum_sum, cum_max, cum_count, diff, pct_change, roll_mean and rank of a column within its key."""
    w = Window.partitionBy(by).orderBy(*order)
    c, back = F.col(column), w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({
        "cum_sum": F.sum(c).over(back), "cum_max": F.max(c).over(back), "cum_count": F.row_number().over(w) - 1, "diff": c - F.lag(c).over(w),
        "pct_change": F.try_divide(c, F.lag(c).over(w)) - 1, "roll_mean": F.avg(c).over(w.rowsBetween(-(window - 1), 0)), "rank": F.rank().over(Window.partitionBy(by).orderBy(c)),
    })


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, stop: str, width: int) -> DataFrame:
    """points with the ranges [start, stop) that hold them: an equi-join on cells of `width`, then the exact test.

    A range takes part in as many cells as it covers, a point in one; no cross join.
    """
    p = points.withColumn("__cell", F.floor(F.col(point) / width))
    r = ranges.where(F.col(stop) > F.col(start)).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width))))
    return p.join(r, "__cell").where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(stop))).drop("__cell")


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """A value within bounds; nulls stay."""
    c = F.when(c < low, F.lit(low)).otherwise(c) if low is not None else c
    return F.when(c > high, F.lit(high)).otherwise(c) if high is not None else c


def mask(c: Column, hidden: Column, other: Column | None = None) -> Column:
    """The value, or other (null) where hidden is true."""
    return F.when(F.coalesce(hidden, F.lit(False)), F.lit(None) if other is None else other).otherwise(c)


def replaced(c: Column, values: dict) -> Column:
    """A value's replacement; values without one, and nulls, stay."""
    out = c
    for old, new in values.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return out


def expanding(df: DataFrame, by: str, order: list[str], column: str) -> DataFrame:
    """df with cum_prod, cum_min and expanding_mean of a column within its key, nulls left out."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    c = F.col(column)
    return df.withColumns({"cum_prod": F.product(c).over(w), "cum_min": F.min(c).over(w), "expanding_mean": F.avg(c).over(w)})


def unstack(df: DataFrame, keys: list[str], level: str, column: str, values: list[str]) -> DataFrame:
    """A column for each stated value of a level; null where there is no row."""
    return df.groupBy(*keys).pivot(level, values).agg(F.first(column))


def stack(df: DataFrame, keys: list[str], columns: list[str], level: str, column: str) -> DataFrame:
    """A row for each key and column that holds a value."""
    return df.unpivot(keys, columns, level, column).where(F.col(column).isNotNull())


def seconds_of(c: Column) -> Column:
    """Seconds of a duration such as `-1 days 02:03:04.5` or `02:03`; null for anything else. The sign holds for all of it."""
    pattern = r"^\s*(-?)(?:(\d+)\s+days?\s*)?(?:(\d+):(\d\d)(?::(\d\d(?:\.\d+)?))?)?\s*$"
    part = lambda i: F.coalesce(F.regexp_extract(c, pattern, i).try_cast("double"), F.lit(0.0))
    total = part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5)
    fits = c.rlike(pattern) & c.rlike(r"\d")
    return F.when(fits, F.when(F.regexp_extract(c, pattern, 1) == "-", -total).otherwise(total))
