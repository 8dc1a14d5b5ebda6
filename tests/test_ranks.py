"""Selection, ranks, rank tests and least squares against sorting in Python."""

import datetime
import math
import random
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnbeck.operators import frames, linear, ranks

NAN, INF = float("nan"), float("inf")


def by_sorting(rows, q):
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    at = lambda v: sorted(v, key=lambda x: (x != x, x))[round(q * (len(v) - 1))]
    return {g: at(v) for g, v in groups.items()}


DOUBLES = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2e-308, 1.7e308, -1.7e308, INF, -INF, NAN, 0.1, 0.1 + 1e-17, 1 - 1e-16, 2.0**52, 2.0**52 + 1, 3.0]


@pytest.mark.parametrize("kind,values", [
    ("double", DOUBLES),
    ("float", [0.5, -2.0, 2.0**100, INF, NAN]),
    ("long", [0, 1, -1, 2**63 - 1, -(2**63), 2**52, 2**52 + 1, 7]),
    ("int", list(range(-5, 6))),
    ("decimal(18,4)", [Decimal(x) / 100 for x in (-5, 0, 1, 99999999999)]),
    ("date", [datetime.date(1900, 1, 1), datetime.date(2024, 2, 29), datetime.date(2024, 3, 1)]),
    ("timestamp_ntz", [datetime.datetime(1969, 12, 31, 23, 59, 59, 999999), datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 1, 0, 0, 0, 1)]),
])
@pytest.mark.parametrize("finish", [0, 3])
def test_nearest_ranks(spark, kind, values, finish):
    rng = random.Random(finish)
    rows = [(rng.choice(["a", "a", "a", "b", None, "all null"]), rng.choice([*values, None])) for _ in range(200)]
    rows = [(g, None if g == "all null" else v) for g, v in rows] + [("one", values[0])]
    df = spark.createDataFrame(rows, f"g string, v {kind}")
    qs = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "high": 1.0}
    got = {r.g: r for r in ranks.nearest_ranks(df, ["g"], "v", qs, finish).collect()}
    same = lambda a, b: a == b or (a != a and b != b)
    for name, q in qs.items():
        want = by_sorting(rows, q)
        assert set(got) == set(want)
        assert all(same(got[g][name], want[g]) for g in want), name


def test_percentiles_and_no_groups(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.random(), 0.25, 1e9]) for _ in range(1001)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    qs = {"a": 0.1, "b": 0.333, "c": 0.5, "d": 1.0}
    (row,) = ranks.percentiles(df, [], "v", qs, finish=5).collect()
    assert [row[k] for k in qs] == pytest.approx(list(np.percentile(values, [100 * q for q in qs.values()])))
    assert ranks.percentiles(df.limit(0), [], "v", qs).collect() == []
    with pytest.raises(TypeError):
        ranks.percentiles(spark.createDataFrame([("x",)], "v string"), [], "v", qs)


def test_ten_million_distinct_values_in_one_group(spark):
    n = 10_000_000
    # 7,919,791 has no factor in common with n, so every value comes up once
    df = spark.range(n).select((F.col("id") * 7_919_791 % n / 8.0).alias("v"))
    (row,) = ranks.nearest_ranks(df, [], "v", {"p50": 0.5, "p99": 0.99}, finish=1000).collect()
    assert tuple(row) == (round(0.5 * (n - 1)) / 8, round(0.99 * (n - 1)) / 8)


def mid(values):
    return [sum(y < x for y in values) + (sum(y == x for y in values) + 1) / 2 for x in values]


def test_midranks_over_ranges(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.randrange(9), rng.randrange(500)]) for _ in range(400)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        counts = spark.createDataFrame([(v,) for v in values], "v long").groupBy("v").agg(F.count("*").alias("n"))
        got = {r.v: r.midrank for r in ranks.midranks(counts, "v").collect()}
        assert got == dict(zip(values, mid(values), strict=True))
        codes = frames.factorized(spark.createDataFrame([(v,) for v in [*values, None]], "v long"), "v").distinct().collect()
        assert {r.v: r.code for r in codes} == {None: -1} | {v: i for i, v in enumerate(sorted(set(values)))}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_rank_tests(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.randrange(12), rng.randrange(6)) for _ in range(150)] + [("a", None, 1), (None, 3, 3), ("d", None, None)]
    df = spark.createDataFrame(rows, "g string, x long, y long")
    a, b = ([x for g, x, _ in rows if g == k and x is not None] for k in "ab")
    u = sum((x > y) + (x == y) / 2 for x in a for y in b)
    ties = sum(c**3 - c for c in (sum(v == w for w in a + b) for v in set(a + b)))
    n = len(a) + len(b)
    z = (u - len(a) * len(b) / 2) / math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    (got,) = ranks.mann_whitney(df, "g", "x", "a", "b").collect()
    assert (got.n_a, got.n_b, got.u_a) == (len(a), len(b), u) and got.z == pytest.approx(z) and 0 < got.p <= 1
    groups = [[x for g, x, _ in rows if g == k and x is not None] for k in "abc"]
    flat = sum(groups, [])
    r = dict(zip(flat, mid(flat), strict=True))
    h = 12 / (len(flat) * (len(flat) + 1)) * sum(sum(r[x] for x in g) ** 2 / len(g) for g in groups) - 3 * (len(flat) + 1)
    h /= 1 - sum(c**3 - c for c in map(flat.count, set(flat))) / (len(flat) ** 3 - len(flat))
    (got,) = ranks.kruskal_wallis(df, "g", "x").collect()
    assert (got.n, got.n_groups) == (len(flat), 3) and got.h == pytest.approx(h)
    assert got.p == pytest.approx(math.exp(-got.h / 2))  # two degrees of freedom
    both = [(x, y) for _, x, y in rows if x is not None and y is not None]
    (got,) = ranks.spearman(df, "x", "y").collect()
    assert got.n == len(both) and got.rho == pytest.approx(np.corrcoef(mid([x for x, _ in both]), mid([y for _, y in both]))[0, 1])


def test_rank_tests_without_spread_or_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1)], "g string, x long")
    (got,) = ranks.mann_whitney(df, "g", "x", "a", "b").collect()
    assert (got.u_a, got.z, got.p) == (0.5, None, None)
    (got,) = ranks.kruskal_wallis(df, "g", "x").collect()
    assert (got.h, got.p) == (None, None)
    (got,) = ranks.spearman(df, "x", "x").collect()
    assert tuple(got) == (2, None)
    none = df.limit(0)
    assert ranks.mann_whitney(none, "g", "x", "a", "b").collect() == [] and ranks.kruskal_wallis(none, "g", "x").collect() == []
    assert [tuple(r) for r in ranks.spearman(none, "x", "x").collect()] == [(0, None)]


def test_chi_square_tail():
    # known values
    for x, k, p in ((3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (0.0, 3, 1.0), (200.0, 3, 4.2e-43), (1.0, 200, 1.0)):
        assert ranks._gamma_above(k / 2, x / 2) == pytest.approx(p, rel=0.02)


def test_least_squares(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in ("u", "v"):
        for _ in range(80):
            a, b = rng.normal(1e6, 3), rng.normal()
            rows.append((g, float(a), float(b), float(a - 2 * b), 4.0, float(3 * a - b + rng.normal())))
    df = spark.createDataFrame([*rows, ("u", None, 1.0, 1.0, 1.0, 1.0), ("u", float("inf"), 1.0, 1.0, 1.0, 1.0), ("w", 1.0, 1.0, 1.0, 1.0, 5.0)], "g string, a double, b double, dep double, flat double, y double")
    got = {r.g: r for r in linear.least_squares(df, "y", ["a", "b", "dep", "flat"], ["g"]).collect()}
    for g in ("u", "v"):
        x = np.array([[r[1] - 1e6, r[2], 1] for r in rows if r[0] == g])
        y = np.array([r[5] for r in rows if r[0] == g])
        b, rest, *_ = np.linalg.lstsq(x, y, rcond=None)
        r = got[g]
        assert r.n == 80 and r.coefficients[2:] == [None, None]
        assert r.coefficients[:2] == pytest.approx(b[:2], rel=1e-5) and r.residual == pytest.approx(rest[0], rel=1e-4)
        assert r.intercept == pytest.approx(b[2] - b[0] * 1e6, rel=1e-5)
    # one row: nothing varies
    assert (got["w"].coefficients, got["w"].intercept, got["w"].r2) == ([None] * 4, 5.0, None)
    assert linear.least_squares(df.limit(0), "y", ["a"]).collect() == []
