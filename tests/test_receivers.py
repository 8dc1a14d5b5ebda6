"""Operations counted by what their receiver holds."""

import ast

import pytest

from tarnbeck.functions import programs, receivers

CASES = [
    ("df.groupby('a').mean()", {"groupby": 1, "mean": 1}),
    ("import os\nP = os.path.join(os.path.dirname(os.path.abspath(__file__)), 'in.csv')\nprint(', '.join(labels))", {}),
    ("import pandas as pd\nmerged = pd.merge(left, right, on='id')", {"merge": 1}),
    # attributes are no calls
    ("import pandas as pd\ndf = pd.read_csv('t.csv')\nprint(df.shape, df.values, df.size)", {}),
    ("import sqlite3\ncon = sqlite3.connect('t.db')\ncur = con.execute(q)\nrows = cur.fetchall()\nprint(rows[0])", {"sql": 2}),
    # a plain dictionary and a list are no data, an unknown name is
    ("d = {}\nd.get(1)\nd.items()\nx = [1, 2]\nx.count(1)\nunknown.get(1)", {"get": 1}),
    ("sep = ', '\nline = sep.join(words)\nname = line.replace('a', 'b')", {}),
    ("from os.path import join, basename\nfrom pathlib import Path\np = Path('a') / 'b'\nq = p.parent.joinpath('c')\nq.name.replace('x', 'y')\nq.replace('z')", {}),
    ("import csv\nwith open('t.csv') as f:\n    rows = list(csv.DictReader(f))\nfor row in rows:\n    row.get('x').replace('a', 'b')", {"get": 1}),
    # what a function is given and returns
    ("import pandas as pd\ndef load(path):\n    return pd.read_csv(path.replace('a', 'b'))\ndef top(t, n):\n    return t.nlargest(n, 'x')\nprint(top(load('q.csv'), 3).head())", {"head": 1, "nlargest": 1}),
    # a name before it is assigned, and through a chain of names
    ("def f():\n    return c.max()\na = 'text'\nb = a\nc = b\nc.count('x')", {}),
    ("import pandas as pd\ndf = pd.read_csv('t')\nfor name, group in df.groupby('a'):\n    name.replace('x', '')\n    group.sum()\nfor i, row in df.iterrows():\n    row.get('a')", {"get": 1, "groupby": 1, "iterrows": 1, "sum": 1}),
    ("import pandas as pd\ns = pd.read_csv('t')['a']\ns[s > 2].astype(str).str.replace('x', 'y').value_counts().head().sum()", {"astype": 1, "head": 1, "replace": 1, "sum": 1, "value_counts": 1}),
    ("import numpy as np\nimport math\nnp.mean(x)\nmath.dist(a, b)\nf'{x}'.count('a')", {"mean": 1}),
    ("x = 'a' if y else df\nx.join(z)", {}),
    ("import pandas as pd\nx = 'a' if y else pd.DataFrame()\nx.join(z)", {"join": 1}),
    ("", {}),
]


@pytest.mark.parametrize("source,want", CASES)
def test_counts(source, want):
    assert receivers.counts(ast.parse(source)) == want


def test_hint(spark):
    rows = [(s, ", ".join(want)) for s, want in CASES] + [(None, ""), ("no ( program", ""), ("x" + ".mean()" * 5000, ""), ("-" * 100_000 + "1", "")]
    df = spark.createDataFrame(rows, "s string, want string")
    got = df.select("want", programs.method_hint(df.s).alias("hint"), programs.method_counts("s").alias("n")).collect()
    deep = [r for r in got if r.hint != r.want]
    assert deep == [] and got[0].n == CASES[0][1]
