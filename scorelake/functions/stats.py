"""Exact sign tests and the small statistics of reports."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series) -> pd.Series:
    """M1: chance of k or more of n fair coins, from whole numbers, so that it is exact to the last digit of a double."""
    import math

    def tail(k: int, n: int) -> float:
        if k <= 0:
            return 1.0
        if k > n:
            return 0.0
        term = total = math.comb(n, k)
        for i in range(k, n):
            term = term * (n - i) // (i + 1)
            total += term
        return total / (1 << n) if n < 1000 else math.exp(math.log(total) - n * math.log(2))

    return pd.Series([None if pd.isna(a) or pd.isna(b) else tail(int(a), int(b)) for a, b in zip(k, n, strict=True)])


@F.pandas_udf(T.DoubleType())
def sign_test(a: pd.Series, b: pd.Series) -> pd.Series:
    """M2: two-sided sign test of a against b one-sided cases: exact under 1100 of them, then normal; null without any."""
    import math
    from statistics import NormalDist

    def p(a: int, b: int) -> float | None:
        n, k = a + b, min(a, b)
        if n == 0:
            return None
        if n < 1100:
            return 2 * sum(math.comb(n, i) for i in range(k + 1)) / (1 << n)
        return 2 * (1 - NormalDist().cdf(abs(a - b) / math.sqrt(n)))

    return pd.Series([p(int(x), int(y)) for x, y in zip(a, b, strict=True)])


def log_tail(k: Column, n: Column) -> Column:
    """M1 without Python: natural logarithm of the tail for k >= 1, in one fold over its terms, each from the one before."""
    base = -n * math.log(2)
    first = F.aggregate(F.sequence(F.lit(1), k), base, lambda s, j: s + F.log((n - k + j) / j))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i) / (i + 1.0))
        return F.when(i >= n, s).otherwise(F.struct(term.alias("term"), (s["total"] + F.log1p(F.exp(term - s["total"]))).alias("total")))

    return F.when(k > n, F.lit(float("-inf"))).otherwise(F.aggregate(F.sequence(k, F.greatest(k, n)), F.struct(first.alias("term"), first.alias("total")), add, lambda s: s["total"]))


def scientific(p: Column) -> Column:
    """Two digits and an exponent."""
    return F.format_string("%.2e", p)
