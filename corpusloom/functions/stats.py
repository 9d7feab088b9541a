"""Column builders for the statistics of term use. Divisions by nothing give 0, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(count: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(count, total), F.lit(0.0))


def relative_frequency(count: Column, total: Column) -> Column:
    """count / (total + 1): a year without tokens has frequency 0."""
    return count / (total + 1)


def z_score(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Of two proportions x1 / n1 and x2 / n2; 0 where it isn't defined."""
    pooled = F.try_divide(x1 + x2, n1 + n2)
    sd = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return F.coalesce(F.try_divide(F.try_divide(x1, n1) - F.try_divide(x2, n2), sd), F.lit(0.0))


def signed_g2(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Dunning's log-likelihood of a term that occurs a of na times here and b of nb there; negative if rarer than expected
    here, 0 if either count is 0."""
    a, b, na, nb = (c.cast("double") for c in (a, b, na, nb))
    e1, e2 = na * (a + b) / (na + nb), nb * (a + b) / (na + nb)
    g2 = 2 * (a * F.ln(a / e1) + b * F.ln(b / e2))
    return F.when((a == 0) | (b == 0), 0.0).when(a < e1, -g2).otherwise(g2)


def smoothed_g2(c1: Column, c2: Column, t1: Column, t2: Column) -> Column:
    """Log-likelihood with 1 added to both counts; positive if the term rises from the first period to the second."""
    a, b = c1.cast("double") + 1, c2.cast("double") + 1
    e1, e2 = t1 * (a + b) / (t1 + t2), t2 * (a + b) / (t1 + t2)
    g2 = 2 * (a * F.ln(a / e1) + b * F.ln(b / e2))
    return F.when(a > e1, -g2).otherwise(g2)
