"""Statistics as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def share(k: Column, n: Column) -> Column:
    return F.when(n > 0, k / n)


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson interval of k out of n; null without any."""
    p = k / n
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column, z: float = Z) -> tuple[Column, Column]:
    """The interval of p1 - p2 from two Wilson intervals."""
    (l1, u1), (l2, u2) = wilson(k1, n1, z), wilson(k2, n2, z)
    p1, p2 = share(k1, n1), share(k2, n2)
    low = (p1 - p2) - F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2))
    high = (p1 - p2) + F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))
    return low, high


def kappa(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Cohen's kappa of two yes/no ratings from counts: both yes, each yes, all; null where chance is certain."""
    agree = (n - a - b + 2 * both) / n
    chance = (a / n) * (b / n) + (1 - a / n) * (1 - b / n)
    return F.when((n > 0) & (chance < 1), (agree - chance) / (1 - chance))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; null where one of them is constant, or there are no pairs."""
    x, y = x.cast("double"), y.cast("double")
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def two_sided_p(z: float | None) -> float | None:
    return None if z is None else math.erfc(abs(z) / math.sqrt(2))


# Numerators and denominators of the rational approximations of erfc (W. J. Cody, 1969), by range.
ERF_SMALL = (
    (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1),
    (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03),
)
ERFC_MIDDLE = (
    (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
     1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8),
    (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03,
     4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03),
)
ERFC_LARGE = (
    (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2),
    (2.56852019228982242e00, 1.87295284992346047e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _ratio(t: Column, tables: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    """The approximations' common form: both polynomials by Horner's rule, the last numerator leading."""
    above, below = tables
    up, down = above[-1] * t, t
    for a, b in zip(above[:-2], below[:-1], strict=True):
        up, down = (up + a) * t, (down + b) * t
    return (up + above[-2]) / (down + below[-1])


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, in double precision, also far out in the tail. The argument, which
    the approximations read some forty times, is worked out once."""
    return F.get(F.transform(F.array(x.cast("double")), _erfc), F.lit(0))


def _erfc(x: Column) -> Column:
    small = 1 - x * _ratio(x * x, ERF_SMALL)
    middle = F.exp(-x * x) * _ratio(x, ERFC_MIDDLE)
    inverse = 1 / (x * x)
    large = F.exp(-x * x) / x * (1 / math.sqrt(math.pi) - inverse * _ratio(inverse, ERFC_LARGE))
    return F.when(x <= 0.46875, small).when(x <= 4, middle).otherwise(large)


def normal_tail(z: Column) -> Column:
    """Two-sided p of a standard normal."""
    return erfc(F.abs(z) / math.sqrt(2))


def benjamini_hochberg(df: DataFrame, p: str, family: str) -> DataFrame:
    """``q`` within each family, over rows that have a p; the others get none."""
    known = F.col(p).isNotNull()
    order = Window.partitionBy(family).orderBy(F.asc_nulls_last(p), *[c for c in df.columns if c not in (p, family)][:1])
    n = F.count(p).over(Window.partitionBy(family))
    ranked = df.withColumn("_rank", F.row_number().over(order)).withColumn("_raw", F.when(known, F.col(p) * n / F.col("_rank")))
    down = Window.partitionBy(family).orderBy("_rank").rowsBetween(0, Window.unboundedFollowing)
    return ranked.withColumn("q", F.when(known, F.least(F.lit(1.0), F.min("_raw").over(down)))).drop("_raw", "_rank")


def detectable(n1: Column, n2: Column, base: Column, power_z: float = 0.8416212, alpha_z: float = 1.959964) -> Column:
    """The least difference of rates that is found with 80 % power at 5 %, for arm sizes and a base rate."""
    return (power_z + alpha_z) * F.sqrt(base * (1 - base) * (1 / n1 + 1 / n2))
