"""The regularised incomplete gamma function and the chi-square tail, in SQL functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ITERATIONS = 300


def half_integer_log_gamma(two_s: Column, most: int = 255) -> Column:
    """ln Gamma(two_s / 2) for whole two_s from 1, from a table by recurrence."""
    table = [math.lgamma(k / 2) for k in range(1, most + 1)]
    return F.get(F.array(*[F.lit(x) for x in table]), two_s.cast("int") - 1)


def gamma_p(s: Column, x: Column, log_gamma: Column) -> Column:
    """P(s, x): a series below s + 1, a continued fraction above; s is a half integer."""
    steps = F.sequence(F.lit(1), F.lit(ITERATIONS))
    scale = F.exp(s * F.ln(x) - x - log_gamma)
    series = F.aggregate(
        steps,
        F.struct((1 / s).alias("t"), (1 / s).alias("sum")),
        lambda a, k: F.struct((a["t"] * x / (s + k)).alias("t"), (a["sum"] + a["t"] * x / (s + k)).alias("sum")),
        lambda a: a["sum"],
    )
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def lentz(a: Column, k: Column) -> Column:
        an = -k * (k - s)
        b = x + 1 - s + 2 * k
        d = 1 / safe(an * a["d"] + b)
        c = safe(b + an / a["c"])
        return F.struct(c.alias("c"), d.alias("d"), (a["h"] * d * c).alias("h"))

    first = 1 / safe(x + 1 - s)
    fraction = F.aggregate(steps, F.struct(F.lit(1 / tiny).alias("c"), first.alias("d"), first.alias("h")), lentz, lambda a: a["h"])
    return F.when(x <= 0, 0.0).when(x < s + 1, series * scale).otherwise(1 - fraction * scale)


def chi_square_tail(chi2: Column, df: Column) -> Column:
    """Chance of a greater value; 0 without degrees of freedom.  Both arguments are computed once."""
    half = F.struct((df / 2).alias("s"), (chi2 / 2).alias("x"), half_integer_log_gamma(df).alias("log"))

    def tail(t: Column) -> Column:
        p = 1 - gamma_p(t["s"], t["x"], t["log"])
        return F.when(t["s"] <= 0, 0.0).when(t["x"] <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))

    return F.get(F.transform(F.array(half), tail), F.lit(0))


def chi_square_tails(chi2: np.ndarray, df: np.ndarray) -> np.ndarray:
    """chi_square_tail of arrays, for statistics that are already in numpy; df goes up to 255."""
    s, x = df / 2, chi2 / 2
    out = np.where(x <= 0, 1.0, 0.0)
    for below in (True, False):
        mine = (df > 0) & (x > 0) & ((x < s + 1) == below)
        if mine.any():
            a, b = s[mine], x[mine]
            scale = np.exp(a * np.log(b) - b - _LOG_GAMMA[df[mine]])
            out[mine] = np.clip(1 - _series(a, b) * scale if below else _fraction(a, b) * scale, 0, 1)
    return np.where(df <= 0, 0.0, out)


_LOG_GAMMA = np.array([0.0, *(math.lgamma(k / 2) for k in range(1, 256))])


def _series(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    term = 1 / s
    total = term.copy()
    for k in range(1, ITERATIONS):
        term *= x / (s + k)
        total += term
        if (term < total * 1e-17).all():
            break
    return total


def _fraction(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction from its end: ITERATIONS levels are past convergence from s + 1 on."""
    below = np.zeros_like(x)
    for k in range(ITERATIONS, 0, -1):
        below = k * (k - s) / (x + 2 * k + 1 - s - below)
    return 1 / (x + 1 - s - below)
