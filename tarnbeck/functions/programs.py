"""Facts about Python programs from their syntax trees, as Arrow UDFs: what SQL expressions cannot see."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import receivers

# ---- fixed values: suffixes of tables, calls that only show ----
TABLE_SUFFIXES = (".csv", ".tsv", ".parquet", ".json", ".jsonl", ".xlsx", ".xls", ".sqlite", ".db", ".txt")
SILENT_CALLS = ("print", "display")
# ---------------------------------------------------------------


def tree(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def methods(source: str | None) -> dict[str, int]:
    """How often a program calls each operation on data, by name in order; nothing for what is no program."""
    try:
        return receivers.counts(tree(source) or ast.Module([], []))
    except RecursionError:
        return {}


def facts(source: str | None, columns: int = 20, filters: int = 12) -> dict:
    """Files, columns and comparisons that the program's literals name, in order of first use."""
    files, names, tests = {}, {}, {}
    for node in ast.walk(tree(source) or ast.Module([], [])):
        if isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value.lower().endswith(TABLE_SUFFIXES):
            files.setdefault(node.value.rsplit("/", 1)[-1])
        elif isinstance(node, ast.Subscript):
            parts = node.slice.elts if isinstance(node.slice, (ast.List, ast.Tuple)) else [node.slice]
            for p in parts:
                if isinstance(p, ast.Constant) and isinstance(p.value, str):
                    names.setdefault(p.value)
        elif isinstance(node, ast.Compare) and len(node.ops) == 1:
            left, right = node.left, node.comparators[0]
            if isinstance(left, ast.Subscript) and isinstance(left.slice, ast.Constant) and isinstance(left.slice.value, str) and isinstance(right, ast.Constant):
                op = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}.get(type(node.ops[0]))
                if op:
                    tests.setdefault(f"{left.slice.value} {op} {right.value!r}")
    return {"files": list(files), "columns": list(names)[:columns], "filters": list(tests)[:filters]}


class _Quiet(ast.NodeTransformer):
    """Drops statements that only print, show or log, and docstrings."""

    def visit_Expr(self, node: ast.Expr):
        v = node.value
        if isinstance(v, ast.Constant) and isinstance(v.value, str):
            return None
        if isinstance(v, ast.Call):
            f = v.func
            if isinstance(f, ast.Name) and f.id in SILENT_CALLS:
                return None
            if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in ("logging", "logger", "log"):
                return None
        return self.generic_visit(node)

    def _filled(self, node):
        self.generic_visit(node)
        if not node.body:
            node.body = [ast.Pass()]
        return node

    visit_FunctionDef = visit_ClassDef = visit_If = visit_For = visit_While = visit_With = _filled


def quiet(source: str | None) -> str:
    t = tree(source)
    return source or "" if t is None else ast.unparse(ast.fix_missing_locations(_Quiet().visit(t)))


def redacted(source: str | None, answer: str | None) -> str:
    """The program with every string literal that holds the answer emptied."""
    t, want = tree(source), "".join((answer or "").lower().split())
    if t is None or len(want) < 3:
        return source or ""
    for node in ast.walk(t):
        if isinstance(node, ast.Constant) and isinstance(node.value, str) and want in "".join(node.value.lower().split()):
            node.value = ""
    return ast.unparse(t)


_NAMES = T.ArrayType(T.StringType())


@F.pandas_udf(_NAMES)
def method_names(source: pd.Series) -> pd.Series:
    return source.map(lambda s: list(methods(s)))


@F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def method_counts(source: pd.Series) -> pd.Series:
    return source.map(methods)


def method_hint(source: Column) -> Column:
    """The operations' names in one line."""
    return F.array_join(method_names(source), ", ")


@F.pandas_udf(T.StructType([T.StructField(n, _NAMES) for n in ("files", "columns", "filters")]))
def code_facts(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([facts(s) for s in source], columns=["files", "columns", "filters"])


@F.pandas_udf(T.StringType())
def strip_output(source: pd.Series) -> pd.Series:
    return source.map(quiet)


@F.pandas_udf(T.StringType())
def redact_literals(source: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([redacted(s, a) for s, a in zip(source, answer, strict=True)])


@F.pandas_udf(T.BooleanType())
def is_program(source: pd.Series) -> pd.Series:
    return source.map(lambda s: bool((s or "").strip()) and tree(s) is not None)
