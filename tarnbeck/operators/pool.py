"""Pool building: one ordered funnel with a counted reason for every exit, tags, coverage of input files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.functions import text as T


def funnel(rows: DataFrame, exits: list[tuple[str, Column]], key: Column | None = None, position: str = "pos") -> DataFrame:
    """rows with exit_reason: the first exit, in order, that applies; then duplicates of the key, where the first position wins.

    Ties in position are broken by the row's hash. Kept rows have a null reason. Only rows that no exit takes are numbered.
    """
    reason = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in exits), F.lit(None).cast("string"))
    out = rows.withColumn("exit_reason", reason)
    if key is None:
        return out
    # the winner of each key is a partial minimum, so a key that fills a third of the rows loads no single task
    tie = F.xxhash64(*rows.columns)
    first = out.where("exit_reason is null").groupBy(key.alias("__key")).agg(F.min(F.struct(F.col(position), tie)).alias("__first"))
    marked = out.withColumn("__key", F.when(F.col("exit_reason").isNull(), key)).withColumn("__mine", F.struct(F.col(position), tie))
    joined = marked.join(first, "__key", "left")
    dup = F.col("exit_reason").isNull() & F.col("__first").isNotNull() & (F.col("__mine") != F.col("__first"))
    return joined.withColumn("exit_reason", F.when(dup, "duplicate").otherwise(F.col("exit_reason"))).select(*rows.columns, "exit_reason")


def exit_counts(marked: DataFrame) -> DataFrame:
    return marked.groupBy(F.coalesce("exit_reason", F.lit("kept")).alias("exit_reason")).agg(F.count("*").alias("n"))


def tagged(rows: DataFrame, question: str = "question", answer: str = "answer", mode: str = "reward_mode", files: str = "files") -> DataFrame:
    """rows with the derived tags; every input column is kept."""
    q = F.col(question)
    return rows.withColumns({
        "op_family": T.op_family(q),
        "answer_type": T.answer_type(F.col(mode)),
        "nondeterminism_reasons": T.nondeterminism_reasons(q),
        "ambiguity_reasons": T.ambiguity_reasons(q, F.col(answer), F.col(mode)),
        "n_files": F.coalesce(F.size(files), F.lit(0)),
    }).withColumns({"nondeterministic": F.size("nondeterminism_reasons") > 0, "ambiguous": F.size("ambiguity_reasons") > 0})


def ladder_grade(rows: DataFrame) -> DataFrame:
    return rows.where("not nondeterministic and not ambiguous and n_files > 0")


def input_bytes(rows: DataFrame, sizes: DataFrame, key: str = "id", files: str = "files") -> DataFrame:
    """(key, input_bytes): sum of the sizes of all files (name, size), null if any is missing or there are none."""
    each = rows.select(key, F.explode_outer(T.file_key(F.col(files))).alias("name"))
    known = sizes.groupBy(F.lower("name").alias("name")).agg(F.min("size").alias("size"))
    return each.join(known, "name", "left").groupBy(key).agg(F.when(F.count("*") == F.count("size"), F.sum("size")).alias("input_bytes"))


def coverage(rows: DataFrame, group: str, item: str, known: DataFrame) -> DataFrame:
    """(group, items, hit, complete): distinct items of each group and how many of them are known (item)."""
    each = rows.select(group, item).distinct().join(known.select(item).distinct().withColumn("__hit", F.lit(1)), item, "left")
    return each.groupBy(group).agg(F.count("*").alias("items"), F.count("__hit").alias("hit"), F.bool_and(F.col("__hit").isNotNull()).alias("complete"))


def first_by_rank(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by a total order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """old with the values of new that are not null."""
    return old.select(key, F.col(value).alias("__old")).join(new.select(key, F.col(value).alias("__new")), key, "full").select(key, F.coalesce("__new", "__old").alias(value))


def carried(published: DataFrame, new: DataFrame, key: str, position: str) -> DataFrame:
    """Published rows that new does not bring again, in published order."""
    return published.join(new.select(key), key, "left_anti").orderBy(position)
