"""Grading of predictions: numeric with tolerance, exact texts, booleans, lists, and equality of arithmetic expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tarnbeck.functions import symbols
from tarnbeck.functions import text as T


def first_number(c: Column) -> Column:
    return F.get(T.numbers_in(F.regexp_replace(T.text(c), r"[$,%]", "")), F.lit(0)).try_cast("double")


def folded(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(T.text(c)), r"\s+", " "))


def grade(answer: Column, prediction: Column, mode: Column, atol: Column, rtol: Column) -> Column:
    """1.0 or 0.0; a prediction without what the mode needs is 0."""
    gold, got = T.number(F.regexp_replace(T.text(answer), r"[$,%\s]", "")), first_number(prediction)
    near = F.coalesce(F.abs(got - gold) <= F.greatest(atol, rtol * F.abs(gold)), F.lit(False))
    same = folded(answer) == folded(prediction)
    parts = lambda c: F.array_sort(F.transform(F.split(folded(c), r"\s*[,;]\s*"), lambda x: F.trim(x)))
    ok = F.when(mode == "numeric", near).when(mode.isin("exact_short", "exact_bool"), same).when(mode == "flexible", same | near).when(mode.isin("list", "list_csv"), parts(answer) == parts(prediction)).otherwise(F.lit(False))
    return ok.cast("double")


def regraded(rows: DataFrame, answer: str, prediction: str, mode: Column, atol: Column, rtol: Column) -> DataFrame:
    """rows with strict and stripped rewards (without a leading ANSWER: mark) and flipped."""
    strict = grade(F.col(answer), F.col(prediction), mode, atol, rtol)
    stripped = grade(F.col(answer), T.strip_prefix(F.col(prediction)), mode, atol, rtol)
    return rows.withColumns({"strict": strict, "stripped": stripped}).withColumn("flipped", F.col("strict") != F.col("stripped"))


def shown(c: Column) -> Column:
    """A double as text that leads back to it and is read by a grader; not finite: empty."""
    whole = (F.abs(c) < 1e15) & (c == F.floor(c))
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), "").when(whole, F.concat(c.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))


def shape_bonus(prediction: Column) -> Column:
    return (F.trim(T.text(prediction)) != "").cast("double")


def rewards(answer: Column, prediction: Column, mode: Column, atol: Column, rtol: Column, weight: float = 0.1) -> Column:
    """struct<reward, shape, total> of a batch's rows: the grade, whether anything was answered, and both with the latter's weight."""
    r, s = grade(answer, prediction, mode, atol, rtol), shape_bonus(prediction)
    return F.struct(r.alias("reward"), s.alias("shape"), (r + F.lit(weight) * s).alias("total"))


@F.pandas_udf(BooleanType())
def same_expression(gold: pd.Series, got: pd.Series) -> pd.Series:
    """Whether two texts are the same arithmetic expression, names included."""
    return pd.Series([symbols.equal(x, y) for x, y in zip(gold, got, strict=True)], dtype=bool)
