"""Value-free profiles: what a table's columns hold, in words and without any cell value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbeck.functions.text import phrase

from .ranks import percentiles

# ---- fixed values: the words of a profile ----
COLUMN_STEPS = ((2, "a single column"), (5, "a few columns"), (13, "about a dozen columns"), (31, "a couple of dozen columns"), (float("inf"), "dozens of columns"))
ROW_STEPS = ((10, "under ten rows"), (100, "fewer than a hundred rows"), (1000, "fewer than a thousand rows"), (float("inf"), "thousands of rows"))
DISTINCT_STEPS = ((3, "a couple of distinct values"), (6, "a few distinct values"), (13, "a handful of distinct values"), (51, "many distinct values"), (float("inf"), "a different value in most rows"))
PRESENCE = ("all values present", "no values present", "a few values missing", "some values missing", "most values missing")
SHAPES = ((0.25, "spread evenly across its range"), (0.5, "spread across its range, heaviest in one band"), (1.0, "almost all its values in one band"))
JUNK = r"^(.*[_ ])?(id|key|index|uuid|guid)$|^unnamed|^\W*$"
LEAST_ROWS, LEAST_DISTINCT, GROUP_DISTINCT, SHORT = 20, 3, (2, 60), 20
# ----------------------------------------------


def presence(missing: Column, total: Column) -> Column:
    words = F.when(missing == 0, PRESENCE[0]).when(missing >= total, PRESENCE[1]).when(missing * 100 < total, PRESENCE[2])
    return words.when(missing * 2 < total, PRESENCE[3]).otherwise(PRESENCE[4])


def kind(t: T.DataType) -> str:
    return "bool" if isinstance(t, T.BooleanType) else "datetime" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "numeric" if isinstance(t, T.NumericType) else "text"


def columns_profile(df: DataFrame) -> DataFrame:
    """(column, kind, total, missing, distinct, longest): one pass over the table for all columns."""
    aggs = [F.count("*").alias("total")]
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        aggs += [F.count(c).alias(f"n{i}"), F.count_distinct(c).alias(f"d{i}"), F.max(F.length(c.cast("string"))).alias(f"l{i}")]
    rows = F.array(*(F.struct(F.lit(f.name).alias("column"), F.lit(kind(f.dataType)).alias("kind"), F.col("total"), (F.col("total") - F.col(f"n{i}")).alias("missing"), F.col(f"d{i}").alias("distinct"), F.col(f"l{i}").alias("longest")) for i, f in enumerate(df.schema)))
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def decile_shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, widest, shape): the largest share of a column's values between two decile edges (zero edges dropped, equal ones one), in words.

    All columns at once: their deciles are ranks of as many groups. A column without values has no row.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns))
    v = df.select(F.explode(cells).alias("x")).select("x.*").where("v is not null")
    at = percentiles(v, ["column"], "v", {f"d{i}": i / 10 for i in range(11)})
    edges = at.select("column", F.array_distinct(F.filter(F.array(*(f"d{i}" for i in range(11))), lambda x: x != 0)).alias("edges"))
    band = F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("band")
    counts = v.join(F.broadcast(edges), "column").groupBy("column", band).agg(F.count("*").alias("n"))  # a row a column is sent
    shares = counts.groupBy("column").agg((F.max("n") / F.sum("n")).alias("widest"))
    words = F.when(F.col("widest") > SHAPES[1][0], SHAPES[2][1]).when(F.col("widest") < SHAPES[0][0], SHAPES[0][1]).otherwise(SHAPES[1][1])
    return shares.select("column", "widest", words.alias("shape"))


def decile_shape(df: DataFrame, column: str) -> DataFrame:
    return decile_shapes(df, [column])


def describe_table(df: DataFrame) -> DataFrame:
    """(column, profile): each column in words; numeric columns with their shape."""
    p = columns_profile(df)
    numeric = [f.name for f in df.schema if kind(f.dataType) == "numeric"]
    p = p.join(decile_shapes(df, numeric).select("column", "shape"), "column", "left") if numeric else p.withColumn("shape", F.lit(None).cast("string"))
    seen = presence(F.col("missing"), F.col("total"))
    spread = phrase(F.col("distinct"), DISTINCT_STEPS)
    name = F.when(F.col("distinct") == 1, "constant text").otherwise("text")
    several = lambda c: F.when(F.col("distinct") > 1, c)
    size = F.when(F.col("longest") <= SHORT, "short labels").otherwise("long labels")
    texts = F.concat_ws(", ", name, seen, several(spread), several(size))
    words = F.when(F.col("kind") == "numeric", F.concat_ws(", ", F.lit("numeric"), seen, "shape")).when(F.col("kind") != "text", F.concat_ws(", ", "kind", seen))
    return p.select("column", words.otherwise(texts).alias("profile"))


def within_budget(rows: DataFrame, group: str, order: str, text: str, chars: int) -> DataFrame:
    """The first rows of each group whose texts together stay within so many characters."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("__sum", F.sum(F.length(text)).over(w)).where(F.col("__sum") <= chars).drop("__sum")


def usable_columns(df: DataFrame) -> DataFrame:
    """(column, use): numeric columns with over 20 values and over 3 distinct ones, text ones with 2 to 60 and over half filled; identifiers left out."""
    p = columns_profile(df)
    n = F.col("total") - F.col("missing")
    measure = (F.col("kind") == "numeric") & (n > LEAST_ROWS) & (F.col("distinct") > LEAST_DISTINCT)
    group = (F.col("kind") == "text") & (n > LEAST_ROWS) & F.col("distinct").between(*GROUP_DISTINCT) & (n * 2 > F.col("total"))
    use = F.when(measure, "measure").when(group, "group")
    return p.where(~F.lower("column").rlike(JUNK)).select("column", use.alias("use")).where("use is not null")
