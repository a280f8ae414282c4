"""Mash distance, its confidence bounds, and the distributions behind them."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-sided 95 % critical values of Student's t for 1 to 30 degrees of freedom; above, the normal value.
T_95 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228,
    2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
    2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
NORMAL_95 = 1.96


def jaccard_to_distance(jaccard: float, k: int) -> float:
    """Mash distance of a Jaccard similarity: 1 if nothing is shared, 0 if all is."""
    if jaccard <= 0:
        return 1.0
    return 0.0 if jaccard >= 1 else -math.log(2 * jaccard / (1 + jaccard)) / k


def distance_to_jaccard(distance: float, k: int) -> float:
    return 1 / (2 * math.exp(k * distance) - 1)


def binomial_survival(x: int, n: int, p: float) -> float:
    """P(X >= x) for X binomial over n trials."""
    if x <= 0:
        return 1.0
    if x > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    log_p, log_q, log_n = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    terms = (
        math.exp(log_n - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q)
        for i in range(x, n + 1)
    )
    return min(1.0, max(0.0, math.fsum(terms)))


def distance_lower_bound(distance: float, sketch: int, k: int, confidence: float) -> float:
    """The distance at the upper end of the Jaccard similarities that a sketch of this size makes likely."""
    if confidence <= 0:
        return distance
    tail = (1 - confidence) / 2
    jaccard = distance_to_jaccard(distance, k)
    x = max(1, math.ceil(sketch * jaccard))
    while x <= sketch and binomial_survival(x, sketch, jaccard) >= tail:
        x += 1
    return jaccard_to_distance(min(max(x - 1, 0), sketch) / sketch, k)


@lru_cache(maxsize=200_000)
def upper_identity(sketch: int, shared: int, k: int, confidence: float) -> float:
    """Percent identity at the lower bound of the distance of `shared` out of `sketch`."""
    if sketch <= 0 or shared <= 0:
        return 0.0
    distance = jaccard_to_distance(shared / sketch, k)
    return 100 * (1 - distance_lower_bound(distance, sketch, k, confidence))


def strict_minimum_shared(sketch: int, k: int, identity: float) -> int:
    """Shared minimizers of a pair at exactly this percent identity."""
    return math.ceil(sketch * distance_to_jaccard(1 - identity / 100, k))


@lru_cache(maxsize=200_000)
def relaxed_minimum_shared(sketch: int, k: int, identity: float, confidence: float) -> int:
    """The fewest shared minimizers whose upper identity still reaches the threshold; 1 without a threshold."""
    if identity <= 0:
        return 1
    least = strict_minimum_shared(sketch, k, identity)
    while least > 1 and upper_identity(sketch, least - 1, k, confidence) >= identity:
        least -= 1
    return max(1, least)


def normal_cdf(x: float) -> float:
    return (1 + math.erf(x / math.sqrt(2))) / 2


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300

    def safe(v: float) -> float:
        return v if abs(v) > tiny else tiny

    c, d = 1.0, 1 / safe(1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 201):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / safe(1 + step * d)
            c = safe(1 + step / c)
            value *= c * d
        if abs(c * d - 1) < 3e-14:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return min(1.0, max(0.0, x))
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(t: float, df: int) -> float:
    """Student's t; beyond 30 degrees of freedom the normal distribution."""
    if df > 30:
        return normal_cdf(t)
    tail = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def t_critical(df: int) -> float:
    return T_95[df - 1] if 1 <= df <= len(T_95) else NORMAL_95


def tail_support(n: int, median: float, mad: float, hits: int, cut: float, above: bool) -> float:
    """How likely `hits` or more of n identities beyond `cut` are, if identities scatter around their median like
    Student's t scaled by the MAD; NaN without scatter or with fewer than two identities."""
    if n < 2 or not mad > 0:
        return math.nan
    at = t_cdf((cut - median) / mad, n - 1)
    return binomial_survival(hits, n, 1 - at if above else at)


# Column forms -------------------------------------------------------------------------------------------------------


def mash_distance(jaccard: Column, k: int) -> Column:
    middle = -F.log(2 * jaccard / (1 + jaccard)) / F.lit(float(k))
    return F.when(jaccard <= 0, 1.0).when(jaccard >= 1, 0.0).when(jaccard.isNotNull(), middle)


def t_critical_column(df: Column) -> Column:
    table = F.array(*[F.lit(v) for v in T_95])
    inside = df.between(1, len(T_95))
    return F.when(inside, F.element_at(table, F.when(inside, df.cast("int")).otherwise(1))).otherwise(NORMAL_95)


def minimum_shared_column(sketch: Column, k: int, identity: float, confidence: float) -> Column:
    """`relaxed_minimum_shared` of a column of sketch sizes; each worker computes a size once."""

    @F.pandas_udf("int")
    def least(sizes: pd.Series) -> pd.Series:
        known = {int(s): relaxed_minimum_shared(int(s), k, identity, confidence) for s in sizes.unique()}
        return sizes.map(known).astype("int32")

    return least(sketch)


def upper_identity_column(sketch: Column, shared: Column, k: int, confidence: float) -> Column:
    """`upper_identity` of two columns: each different pair of a batch is looked up once."""

    @F.pandas_udf("double")
    def upper(sizes: pd.Series, hits: pd.Series) -> pd.Series:
        pairs = sizes.to_numpy(np.int64) << 32 | hits.to_numpy(np.int64)
        known, at = np.unique(pairs, return_inverse=True)
        values = np.array([upper_identity(int(p) >> 32, int(p) & 2**32 - 1, k, confidence) for p in known], float)
        return pd.Series(values[at] if len(at) else values)

    return upper(sketch, shared)
