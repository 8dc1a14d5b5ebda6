"""Least squares as one mergeable aggregate: counts, means and covariances of a group are all that a fit needs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A column of which less than this share of its variance is left beside the columns before it adds nothing.
LEFT = 1e-10


def solved(s: np.ndarray, t: np.ndarray, left: float = LEFT) -> list[float | None]:
    """Coefficients b of s b = t for covariances s; None for columns that depend on those before them."""
    used: list[int] = []
    for j in range(len(s)):
        rest = s[j, j] - (s[j, used] @ np.linalg.solve(s[np.ix_(used, used)], s[used, j]) if used else 0.0)
        if s[j, j] > 0 and rest > left * s[j, j]:
            used.append(j)
    b: list[float | None] = [None] * len(s)
    if used:
        # scaled to correlations, so that units do not decide how well it is solved
        d = np.sqrt(s[used, used])
        for j, x in zip(used, np.linalg.solve(s[np.ix_(used, used)] / np.outer(d, d), t[used] / d) / d, strict=True):
            b[j] = float(x)
    return b


def least_squares(df: DataFrame, y: str, xs: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, n, intercept, coefficients array<double> in the order of xs, residual, r2) of y on xs for each group.

    Rows with a null or non-finite value are left out. A constant column, or one that depends on those before it, has a null
    coefficient, as if it were not there. residual is the sum of squares; r2 is null where y does not vary. Without a row
    nothing comes out, without by one row comes out at most.
    """
    by, names = by or [], [*xs, y]
    value = lambda c: F.col(c).cast("double")
    whole = None
    for c in names:
        ok = F.coalesce(~F.isnan(value(c)) & (F.abs(value(c)) < float("inf")), F.lit(False))
        whole = ok if whole is None else whole & ok
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    means = F.array(*(F.avg(value(c)) for c in names)).alias("means")
    moments = F.array(*(F.covar_pop(value(names[i]), value(names[j])) for i, j in pairs)).alias("moments")
    sums = df.where(whole).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), means, moments).where("n > 0")

    @F.pandas_udf("intercept double, coefficients array<double>, residual double, r2 double")
    def fit(n: pd.Series, means: pd.Series, moments: pd.Series) -> pd.DataFrame:
        out = []
        for rows, m, flat in zip(n, means, moments, strict=True):
            s = np.zeros((k, k))
            for (i, j), v in zip(pairs, flat, strict=True):
                s[i, j] = s[j, i] = v
            b = solved(s[:-1, :-1], s[:-1, -1])
            full = np.array([x or 0.0 for x in b])
            rest = max(0.0, float(s[-1, -1] - 2 * full @ s[:-1, -1] + full @ s[:-1, :-1] @ full))
            out.append((float(m[-1] - full @ m[:-1]), b, rows * rest, 1 - rest / s[-1, -1] if s[-1, -1] > 0 else None))
        return pd.DataFrame(out, columns=["intercept", "coefficients", "residual", "r2"])

    return sums.withColumn("fit", fit("n", "means", "moments")).select(*by, "n", "fit.*")
