"""Upper tails of the F and chi-square distributions."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A fraction has settled when a convergent differs from the one before by so little; most terms.
SETTLED, MOST_TERMS = 1e-16, 20_000


def continued_fraction(terms: Iterable[tuple[float, float]]) -> float:
    """a1 / (b1 + a2 / (b2 + ...)) from the terms (a, b), by the recurrence of the convergents' numerators and denominators.

    Both are scaled by the denominator after every term, so that neither overflows.
    """
    tops, bottoms, value = (1.0, 0.0), (0.0, 1.0), math.nan
    for a, b in itertools.islice(terms, MOST_TERMS):
        top, bottom = b * tops[1] + a * tops[0], b * bottoms[1] + a * bottoms[0]
        if bottom == 0.0:
            tops, bottoms = (tops[1], top), (bottoms[1], bottom)
            continue
        tops, bottoms = (tops[1] / bottom, top / bottom), (bottoms[1] / bottom, 1.0)
        last, value = value, tops[1]
        if abs(value - last) <= SETTLED * abs(value):
            break
    return value


def _beta_terms(a: float, b: float, x: float) -> Iterator[tuple[float, float]]:
    """The fraction of B_x(a, b) a / (x^a (1 - x)^b)."""
    yield 1.0, 1.0
    for k in itertools.count():
        yield -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)), 1.0
        yield (k + 1) * (b - k - 1) * x / ((a + 2 * k + 1) * (a + 2 * k + 2)), 1.0


def _gamma_terms(a: float, x: float) -> Iterator[tuple[float, float]]:
    """The fraction of Gamma(a, x) e^x / x^a."""
    yield 1.0, x + 1 - a
    for k in itertools.count(1):
        yield k * (a - k), x + 2 * k + 1 - a


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function I_x(a, b)."""
    if not 0.0 < x < 1.0:
        return float(x >= 1.0)
    scale = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
    if x * (a + b + 2.0) < a + 1.0:  # where the fraction settles soon; else that of the other tail does
        return scale / a * continued_fraction(_beta_terms(a, b, x))
    return 1.0 - scale / b * continued_fraction(_beta_terms(b, a, 1.0 - x))


def gamma_upper(a: float, x: float) -> float:
    """The regularized upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x >= a + 1.0:
        return scale * continued_fraction(_gamma_terms(a, x))
    powers = itertools.accumulate(itertools.count(1), lambda term, k: term * x / (a + k), initial=1.0 / a)
    return 1.0 - scale * math.fsum(itertools.takewhile(lambda term: term > SETTLED / a, powers))


def sf_f(stat: float, d1: float, d2: float) -> float:
    """P(F > stat)."""
    return math.nan if math.isnan(stat) else 1.0 if stat <= 0.0 else beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * stat))


def sf_chi2(stat: float, dof: float) -> float:
    """P(chi-square > stat)."""
    return math.nan if math.isnan(stat) else 1.0 if stat <= 0.0 else gamma_upper(dof / 2.0, stat / 2.0)


def wald_pvalue(beta: np.ndarray, cov: np.ndarray, use_f: bool, df_resid: float = math.inf) -> float:
    """The p-value that a block of coefficients is 0."""
    stat = float(beta @ np.linalg.solve(cov, beta))
    if not math.isfinite(stat) or stat < 0:
        return math.nan
    return sf_f(stat / len(beta), len(beta), df_resid) if use_f else sf_chi2(stat, len(beta))


def f_tail(stat: Column, d1: int, d2: Column) -> Column:
    """P(F > stat) as a column: in closed form for an even d1, else by the incomplete beta function on Arrow batches."""
    if d1 == 2:
        return F.when(stat <= 0, 1.0).otherwise(F.pow(1 + 2 * stat / d2, -d2 / 2))
    if d1 % 2 == 0:
        # I_x(d2 / 2, k) with whole k is x ** a times a finite sum.
        x, a = d2 / (d2 + d1 * stat), d2 / 2
        total, term = F.lit(1.0), F.lit(1.0)
        for j in range(1, d1 // 2):
            term = term * (a + j - 1) / j * (1 - x)
            total = total + term
        return F.when(stat <= 0, 1.0).otherwise(F.pow(x, a) * total)

    def run(stats: pa.Array, dofs: pa.Array) -> pa.Array:
        return pa.array([None if s is None or d is None else sf_f(s, d1, d) for s, d in zip(stats.to_pylist(), dofs.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(stat.cast("double"), d2.cast("double"))
