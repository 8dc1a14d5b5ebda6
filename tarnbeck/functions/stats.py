"""Statistics as Column expressions and small plans: intervals, exact tests, agreement, quantiles, bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.96


def wilson(successes: Column, total: Column, z: float = Z) -> Column:
    """struct<low, high>; (0, 0) without trials."""
    n, p = total.cast("double"), successes / total
    centre, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    at = lambda x: F.when(total > 0, x).otherwise(0.0)
    return F.struct(at(F.greatest(F.lit(0.0), centre - spread)).alias("low"), at(F.least(F.lit(1.0), centre + spread)).alias("high"))


def kappa(agree: Column, a: Column, b: Column) -> Column:
    """Cohen's kappa from the shares of agreement and of yes of both raters; 0 where chance explains all, and without pairs."""
    chance = a * b + (1 - a) * (1 - b)
    return F.when(agree.isNull() | (chance >= 1), 0.0).otherwise((agree - chance) / (1 - chance))


def sign_test(down: Column, up: Column) -> Column:
    """Exact two-sided p of discordant pairs, null if there are none.

    Every term of the binomial tail follows from its neighbour, from the middle of the distribution down, so the work grows
    with the pairs; nothing leaves the range 0 to 1, so large numbers of pairs lose no digits.
    """
    n, k, one = (down + up).cast("long"), F.least(down, up).cast("long"), F.lit(1).cast("long")
    # choose(n, n // 2) / 2**n: the share of the middle
    middle = F.aggregate(F.sequence(one, F.greatest(F.floor((n + 1) / 2), one)), F.lit(1.0), lambda a, j: a * (2 * j - 1) / (2 * j))
    start = F.struct(middle.alias("term"), F.lit(0.0).alias("total"))
    step = lambda a, i: F.struct((a["term"] * i / (n - i + 1)).alias("term"), (a["total"] + F.when(i <= k, a["term"]).otherwise(0.0)).alias("total"))
    tail = F.aggregate(F.sequence(F.floor(n / 2), F.lit(0).cast("long")), start, step, lambda a: a["total"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))


def nearest_rank(c: Column, q: float) -> Column:
    """Aggregate: the value at half-even round(q * (n - 1)) of the sorted values that are not null."""
    values = F.sort_array(F.collect_list(c))
    return F.get(values, F.bround(F.lit(q) * (F.size(values) - 1), 0).cast("int"))


def percentile_bootstrap(df: DataFrame, by: str, value: str, draws: int = 10_000, seed: int = 20260101) -> DataFrame:
    """(by, n, mean, low, high): percentile bootstrap of the mean of each group.

    Group means depend only on how often each value is drawn, so groups travel as (value, count) pairs and draws are
    multinomial over distinct values: memory does not grow with the rows of a group. No value: null; one: the point.
    """
    pairs = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    kind = dict(df.dtypes)[by]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        v, c = pdf["v"].to_numpy(), pdf["c"].to_numpy()
        n, mean = int(c.sum()), float((v * c).sum() / c.sum())
        if n == 1:
            low = high = mean
        else:
            rng = np.random.default_rng(seed)
            means = np.concatenate([rng.multinomial(n, c / n, size=min(500, draws - i)) @ v / n for i in range(0, draws, 500)])
            low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({by: [key[0]], "n": [n], "mean": [mean], "low": [float(low)], "high": [float(high)]})

    return pairs.groupBy(by).applyInPandas(run, f"`{by}` {kind}, n long, mean double, low double, high double")


def order_bootstrap(values: list[float], draws: int = 2000, seed: int = 0) -> tuple[float, float]:
    """Order statistics at int(0.025 n) and int(0.975 n) - 1 of resampled means; (nan, nan) without values."""
    import random

    if not values:
        return float("nan"), float("nan")
    rng = random.Random(seed)
    means = sorted(sum(rng.choices(values, k=len(values))) / len(values) for _ in range(draws))
    return means[int(0.025 * draws)], means[int(0.975 * draws) - 1]

