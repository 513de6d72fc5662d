"""Closed-form p-values as column expressions, evaluated on one-row-per-column results."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ks_p_value(statistic: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value: 100 terms of the alternating series.

    The series hasn't converged after 100 terms for a very small argument, where the true value is 1.
    """
    n1, n2 = n1.cast("double"), n2.cast("double")
    root = F.sqrt(n1 * n2 / (n1 + n2))
    arg = (root + 0.12 + 0.11 / root) * statistic
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * arg * arg))
    series = F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)
    return (F.when((n1 == 0) | (n2 == 0) | (statistic == 0) | (arg < 0.2), 1.0)
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))))


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series after shifting the argument up by 8."""
    shifted = z + 8.0
    lowered = sum((F.log(z + float(i)) for i in range(8)), F.lit(0.0))
    series = 1 / (12 * shifted) - 1 / (360 * F.pow(shifted, F.lit(3.0))) + 1 / (1260 * F.pow(shifted, F.lit(5.0)))
    return (shifted - 0.5) * F.log(shifted) - shifted + 0.5 * math.log(2 * math.pi) + series - lowered


def chi_square_p_value(statistic: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution; 1 for df = 0 or statistic = 0.

    Below the mean the lower incomplete gamma series converges fast; above it the upper-tail continued fraction
    does, and keeps tiny p-values exact. Both run a number of steps that grows with the root of df.
    """
    x, a = statistic.cast("double") / 2, df.cast("double") / 2
    steps = F.sequence(F.lit(1), (200 + 20 * F.sqrt(a)).cast("int"))
    log_scale = a * F.log(x) - x - log_gamma(a)

    lower = F.aggregate(
        steps,
        F.struct((1 / a).alias("term"), (1 / a).alias("total")),
        lambda s, n: F.struct((s["term"] * x / (a + n)).alias("term"),
                              (s["total"] + s["term"] * x / (a + n)).alias("total")))["total"]

    tiny = F.lit(1e-300)
    b0 = x + 1 - a

    def step(s: Column, n: Column) -> Column:  # modified Lentz evaluation
        an = -n * (n - a)
        b = b0 + 2.0 * n
        d = an * s["d"] + b
        d = 1 / F.when(F.abs(d) < tiny, tiny).otherwise(d)
        c = b + an / s["c"]
        c = F.when(F.abs(c) < tiny, tiny).otherwise(c)
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    start = F.struct((F.lit(1.0) / tiny).alias("c"), (1 / b0).alias("d"), (1 / b0).alias("h"))
    upper = F.aggregate(steps, start, step)["h"]

    return (F.when((df <= 0) | (statistic <= 0), 1.0)
            .when(x < a + 1, 1 - F.exp(log_scale) * lower)
            .otherwise(F.exp(log_scale) * upper))
