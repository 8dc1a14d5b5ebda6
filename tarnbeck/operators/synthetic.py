"""Tasks made from a table: questions whose answers one plan of the algebra gives, and that no tie leaves open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import algebra, profile

# ---- fixed values: the questions ----
QUESTIONS = {
    "mean": "What is the mean of {c} across all rows?", "median": "What is the median of {c} across all rows?",
    "sum": "What is the total of {c} summed over all rows?", "max": "What is the largest value of {c} in the table?",
    "mode": "Which value of {c} appears most often in the table?", "grouped_mean": "Considering only the rows where {g} is {v}, what is the mean of {c}?",
}
LEAST_ROWS = 20
# -------------------------------------


def modal_group(df: DataFrame, group: str, number: str, least: int = LEAST_ROWS) -> str | None:
    """The most frequent value of a column among rows that have both, as text; None if it is not the only one or too rare."""
    both = df.where(F.col(f"`{group}`").isNotNull() & F.col(f"`{number}`").isNotNull())
    top = both.groupBy(F.col(f"`{group}`").cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(2).collect()
    if not top or top[0].n < least or (len(top) > 1 and top[1].n == top[0].n):
        return None
    return top[0].v


def specs(df: DataFrame) -> list[dict]:
    """What can be asked about a table: a list (one entry for each usable column and kind) of kind, columns, ops and question."""
    use = {r.column: r.use for r in profile.usable_columns(df).collect()}
    numbers, groups = [c for c in df.columns if use.get(c) == "measure"], [c for c in df.columns if use.get(c) == "group"]
    out = [{"kind": k, "columns": [c], "ops": [f"{k}({c})"], "question": QUESTIONS[k].format(c=c)} for c in numbers for k in ("mean", "median", "sum", "max")]
    out += [{"kind": "mode", "columns": [c], "ops": [f"value_counts({c})", "argmax"], "question": QUESTIONS["mode"].format(c=c)} for c in groups]
    for i, c in enumerate(numbers):
        if groups and (v := modal_group(df, groups[i % len(groups)], c)) is not None:
            g = groups[i % len(groups)]
            out.append({"kind": "grouped_mean", "columns": [g, c], "ops": [f"filter({g}=={v})", f"mean({c})"], "question": QUESTIONS["grouped_mean"].format(g=g, v=v, c=c)})
    return out


def tasks(df: DataFrame, table: str, stem: str) -> DataFrame:
    """(task_id, source_table, question, answer, reward_mode, ops, columns) of every question with one answer.

    A maximum that several rows share, a mode with a tie and a value that is no number are left out.
    """
    out = None
    for i, s in enumerate(specs(df)):
        value = algebra.unique_max(df, s["columns"][0]) if s["kind"] == "max" else algebra.run(df, s["ops"])
        row = value.select(
            F.lit(f"syn_{stem}_{i}_{s['kind']}").alias("task_id"), F.lit(table).alias("source_table"), F.lit(s["question"]).alias("question"), F.col("value").cast("string").alias("answer"),
            F.lit("exact_short" if s["kind"] == "mode" else "numeric").alias("reward_mode"), F.array(*map(F.lit, s["ops"])).alias("ops"), F.array(*map(F.lit, s["columns"])).alias("columns"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        return df.sparkSession.createDataFrame([], "task_id string, source_table string, question string, answer string, reward_mode string, ops array<string>, columns array<string>")
    return out.where("answer is not null and answer <> 'NaN'")


def headers(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Column names of each table."""
    return {name: [" ".join(c.split()) for c in df.columns] for name, df in tables.items()}


def column_names(tables: dict[str, DataFrame]) -> list[str]:
    """Distinct column names of all tables, sorted."""
    return sorted({c for df in tables.values() for c in df.columns})


def first_matching(df: DataFrame, column: str, wanted: str, order: str) -> DataFrame:
    """One row (value): the first cell, by order, whose text is the wanted one; null if none is."""
    c = F.col(f"`{column}`")
    return df.agg(F.min_by(c, F.when(F.trim(c.cast("string")) == wanted.strip(), F.col(order))).alias("value"))
