"""What a program does to data: calls counted by what their receiver holds.

A program is interpreted abstractly: each name holds a set of kinds (frame, column, rows, text, path, ...), which assignments,
loops, arguments and returned values only ever add to, until nothing changes. Then calls are counted: a data operation counts
where its receiver may hold data, or where nothing is known about it; calls that run SQL count as `sql`. Paths, texts, files,
numbers, plain mappings and lists, and modules that do not work on data, count nothing.
"""

from __future__ import annotations

import ast
from collections import Counter, defaultdict

# ---- fixed values: calls that count as operations on data, and those that run SQL ----
FRAME_CALLS = (
    "groupby", "pivot", "pivot_table", "melt", "stack", "unstack", "merge", "join", "crosstab",
    "concat", "merge_asof", "set_index", "reset_index", "sort_values", "sort_index", "nlargest",
    "nsmallest", "drop", "dropna", "drop_duplicates", "fillna", "ffill", "bfill", "rename",
    "assign", "reindex", "set_axis", "query", "iloc", "at", "iat", "mask", "where",
    "replace", "clip", "astype", "to_numeric", "to_datetime", "to_timedelta", "select_dtypes",
    "get_dummies", "explode", "factorize", "map", "applymap", "pipe", "round", "interpolate",
    "truncate", "sample", "head", "tail",
    "mean", "median", "mode", "std", "var", "sem", "quantile", "sum", "prod", "min", "max",
    "count", "nunique", "value_counts", "unique", "agg", "aggregate", "apply", "transform",
    "cumsum", "cumprod", "cumcount", "cummax", "cummin", "diff", "pct_change", "rank", "abs",
    "skew", "kurt", "corr", "cov", "covariance", "corrwith", "rolling", "expanding", "ewm",
    "idxmax", "idxmin", "argsort", "dot", "describe", "size", "shape", "any", "all",
    "isna", "notna", "isin", "between", "duplicated",
    "to_numpy", "to_dict", "to_records", "to_csv", "to_list", "tolist", "itertuples",
    "iterrows", "values", "get", "items",
)
SQL_CALLS = ("execute", "executemany", "executescript", "fetchall", "fetchone", "fetchmany")
# --------------------------------------------------------------------------------------

Kinds = frozenset[str]
NONE: Kinds = frozenset()
DATA = frozenset(("frame", "column", "rows", "row", "cursor"))
DATA_MODULES = ("pandas", "numpy", "scipy", "statistics", "itertools", "polars")
#: What a function of a module gives, by the module's first name; "" for any function not listed.
MODULE_RESULTS = {
    "pandas": {"": "frame", "Series": "column", "to_datetime": "column", "to_numeric": "column", "to_timedelta": "column", "ExcelFile": "file"},
    "polars": {"": "frame"},
    "numpy": {"": "column", "mean": "number", "sum": "number", "median": "number"},
    "csv": {"reader": "rows", "DictReader": "rows"},
    "sqlite3": {"connect": "cursor"},
    "os": {"": "path", "listdir": "list", "getenv": "text"},
    "glob": {"": "list"},
    "pathlib": {"": "path"},
    "re": {"": "text", "findall": "list", "split": "list"},
    "json": {"": "mapping", "dumps": "text"},
    "collections": {"": "mapping", "deque": "list"},
}
BUILTIN_RESULTS = {
    "open": "file", "str": "text", "repr": "text", "input": "text", "format": "text", "chr": "text", "dict": "mapping", "len": "number", "int": "number", "float": "number",
    "range": "list", "ord": "number", "round": "number", "abs": "number", "bool": "number",
}
#: Builtins that give what they are given, in another order or container.
SAME = ("list", "tuple", "set", "sorted", "reversed", "filter", "iter", "frozenset")
#: What methods give: by the receiver's kind and the name, else by the kind alone.
METHOD_RESULTS = {
    "text": {"": "text", "split": "list", "rsplit": "list", "splitlines": "list", "partition": "list", "encode": "text", "count": "number", "find": "number"},
    "path": {"": "path", "read_text": "text", "read_bytes": "text", "open": "file", "exists": "number", "is_file": "number"},
    "file": {"": "text", "readlines": "list"},
    "cursor": {"": "cursor", "fetchall": "rows", "fetchmany": "rows", "fetchone": "row"},
    "frame": {"": "frame", "iterrows": "rows", "itertuples": "rows", "to_records": "rows", "to_dict": "mapping", "value_counts": "column", "to_numpy": "column", "size": "column", "items": "frame"},
    "column": {"": "column", "tolist": "list", "to_list": "list", "to_dict": "mapping", "mean": "number", "sum": "number", "median": "number", "nunique": "number", "std": "number", "count": "number"},
    "rows": {"": "rows", "index": "number", "count": "number"},
    "row": {"": "text", "items": "list", "keys": "list", "values": "list"},
    "list": {"": "list", "index": "number", "count": "number"},
}
ATTRIBUTES = {
    "frame": {"": "column", "loc": "frame", "iloc": "frame", "T": "frame", "shape": "list", "size": "number"},
    "column": {"": "column", "size": "number", "shape": "list"},
    "path": {"": "path", "name": "text", "stem": "text", "suffix": "text", "parts": "list"},
}
ELEMENTS = {"rows": "row", "cursor": "row", "frame": "text", "file": "text", "text": "text", "path": "path", "column": "number"}


class _Program(ast.NodeVisitor):
    """Kinds of a program's names: one pass of visits adds what it finds, `grown` tells whether it found anything new."""

    def __init__(self, tree: ast.AST):
        self.names: defaultdict[str, Kinds] = defaultdict(frozenset)
        self.functions = {n.name: n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
        self.grown = True
        while self.grown:
            self.grown = False
            self.visit(tree)

    def add(self, name: str, kinds: Kinds) -> None:
        if not kinds <= self.names[name]:
            self.names[name] |= kinds
            self.grown = True

    def bind(self, target: ast.AST, kinds: Kinds, parts: list[Kinds] | None = None) -> None:
        """parts: kinds of the elements, where the value is a tuple of known ones."""
        if isinstance(target, ast.Name):
            self.add(target.id, kinds)
        elif isinstance(target, ast.Starred):
            self.bind(target.value, kinds)
        elif isinstance(target, (ast.Tuple, ast.List)):
            for i, t in enumerate(target.elts):
                self.bind(t, parts[i] if parts and i < len(parts) else self.element(kinds))

    def element(self, kinds: Kinds) -> Kinds:
        return frozenset(ELEMENTS[k] for k in kinds if k in ELEMENTS)

    def iterated(self, target: ast.AST, it: ast.AST) -> None:
        call = it if isinstance(it, ast.Call) else None
        name = getattr(call.func, "attr", getattr(call.func, "id", "")) if call else ""
        if name == "enumerate" and call.args:
            self.bind(target, NONE, [frozenset(("number",)), self.element(self.kinds(call.args[0]))])
        elif name == "zip" and call.args:
            self.bind(target, NONE, [self.element(self.kinds(a)) for a in call.args])
        elif name == "iterrows":
            self.bind(target, NONE, [frozenset(("text",)), frozenset(("row",))])
        elif isinstance(target, ast.Tuple) and "frame" in self.kinds(it):
            # groups, or columns, with their names
            self.bind(target, NONE, [frozenset(("text",)), frozenset(("frame",))])
        else:
            self.bind(target, self.element(self.kinds(it)))

    # ---- statements ----

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add(a.asname or a.name.split(".")[0], frozenset((f"module {a.name if a.asname else a.name.split('.')[0]}",)))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.add(a.asname or a.name, frozenset((f"module {node.module or ''}.{a.name}",)))

    def visit_Assign(self, node: ast.Assign) -> None:
        parts = [self.kinds(e) for e in node.value.elts] if isinstance(node.value, (ast.Tuple, ast.List)) else None
        for t in node.targets:
            self.bind(t, self.kinds(node.value), parts)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if node.value is not None:
            self.bind(node.target, self.kinds(node.value))
        self.generic_visit(node)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        self.bind(node.target, self.kinds(node.value))
        self.generic_visit(node)

    def visit_NamedExpr(self, node: ast.NamedExpr) -> None:
        self.bind(node.target, self.kinds(node.value))
        self.generic_visit(node)

    def visit_For(self, node: ast.For) -> None:
        self.iterated(node.target, node.iter)
        self.generic_visit(node)

    def visit_comprehension(self, node: ast.comprehension) -> None:
        self.iterated(node.target, node.iter)
        self.generic_visit(node)

    def visit_withitem(self, node: ast.withitem) -> None:
        if node.optional_vars is not None:
            self.bind(node.optional_vars, self.kinds(node.context_expr))
        self.generic_visit(node)

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        for n in ast.walk(node):
            if isinstance(n, ast.Return) and n.value is not None:
                self.add(f"{node.name}()", self.kinds(n.value))
        self.generic_visit(node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node: ast.Call) -> None:
        f = self.functions.get(getattr(node.func, "id", ""))
        if f:
            for p, a in zip(f.args.posonlyargs + f.args.args, node.args, strict=False):
                self.add(p.arg, self.kinds(a))
            for k in node.keywords:
                if k.arg:
                    self.add(k.arg, self.kinds(k.value))
        self.generic_visit(node)

    # ---- expressions ----

    def kinds(self, node: ast.AST) -> Kinds:
        one = lambda k: frozenset((k,))
        if isinstance(node, ast.Constant):
            return one("text") if isinstance(node.value, (str, bytes)) else one("number") if isinstance(node.value, (int, float)) else NONE
        if isinstance(node, ast.JoinedStr):
            return one("text")
        if isinstance(node, ast.Name):
            return self.names[node.id] if node.id in self.names else NONE
        if isinstance(node, (ast.Dict, ast.DictComp)):
            return one("mapping")
        if isinstance(node, (ast.ListComp, ast.SetComp, ast.GeneratorExp)):
            return one("rows") if "row" in self.kinds(node.elt) else one("list")
        if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
            return one("list")
        if isinstance(node, ast.IfExp):
            return self.kinds(node.body) | self.kinds(node.orelse)
        if isinstance(node, ast.BoolOp):
            return frozenset().union(*map(self.kinds, node.values))
        if isinstance(node, (ast.UnaryOp, ast.Await, ast.NamedExpr, ast.Starred)):
            return self.kinds(getattr(node, "operand", None) or node.value)
        if isinstance(node, (ast.BinOp, ast.Compare)):
            sides = self.kinds(node.left) | (self.kinds(node.right) if isinstance(node, ast.BinOp) else frozenset().union(*map(self.kinds, node.comparators)))
            first = next((k for k in ("frame", "column") if k in sides), None)
            if first or isinstance(node, ast.Compare):
                return one(first or "number")
            if isinstance(node.op, ast.Div) and "path" in sides:
                return one("path")
            return one("text") if "text" in sides else sides
        if isinstance(node, ast.Subscript):
            return self.subscript(self.kinds(node.value), node.slice)
        if isinstance(node, ast.Attribute):
            return self.attribute(self.kinds(node.value), node.attr)
        if isinstance(node, ast.Call):
            return self.called(node)
        return NONE

    def subscript(self, held: Kinds, key: ast.AST) -> Kinds:
        out = set()
        for k in held:
            if k == "frame":
                out.add("column" if isinstance(key, ast.Constant) and isinstance(key.value, str) else "frame")
            elif k in ("column", "text"):
                out.add(k)
            elif k in ("rows", "cursor"):
                out.add(k if isinstance(key, ast.Slice) else "row")
            elif k == "row":
                out.add("text")
        return frozenset(out)

    def attribute(self, held: Kinds, name: str) -> Kinds:
        found = set()
        for k in held:
            if k.startswith("module "):
                found.add(f"{k}.{name}")
            elif k in ATTRIBUTES:
                found.add(ATTRIBUTES[k].get(name, ATTRIBUTES[k][""]))
        return frozenset(found)

    def called(self, node: ast.Call) -> Kinds:
        f = node.func
        if isinstance(f, ast.Name) and not any(k.startswith("module ") for k in self.kinds(f)):
            if f.id in SAME and node.args:
                return self.kinds(node.args[-1])
            if f.id in self.functions:
                return self.names[f"{f.id}()"]
            return frozenset((BUILTIN_RESULTS[f.id],)) if f.id in BUILTIN_RESULTS else NONE
        held = self.kinds(f.value) if isinstance(f, ast.Attribute) else self.kinds(f)
        name = f.attr if isinstance(f, ast.Attribute) else ""
        out = set()
        for k in held:
            if k.startswith("module "):
                path = k.removeprefix("module ").split(".")
                results = MODULE_RESULTS.get(path[0], {})
                out.add(results.get(name or path[-1], results.get("")))
            elif k in METHOD_RESULTS:
                out.add(METHOD_RESULTS[k].get(name, METHOD_RESULTS[k][""]))
        return frozenset(out - {None})


def counts(tree: ast.AST) -> dict[str, int]:
    """How often each data operation is called, by name; SQL calls together as `sql`."""
    program, out = _Program(tree), Counter()
    for node in ast.walk(tree):
        if not (isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute)):
            continue
        name, held = node.func.attr, program.kinds(node.func.value)
        on_data = not held or held & DATA or any(k.removeprefix("module ").split(".")[0] in DATA_MODULES for k in held if k.startswith("module "))
        if name in SQL_CALLS and (not held or "cursor" in held):
            out["sql"] += 1
        elif name in FRAME_CALLS and on_data:
            out[name] += 1
    return dict(sorted(out.items()))
