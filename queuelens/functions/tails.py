"""Upper tails of the chi-square and normal distributions.

Degrees of freedom are whole numbers here, so the chi-square tail is a finite
sum.  It is accumulated in logarithms: a sum over thousands of degrees of
freedom neither overflows nor loses its head to an underflowing exp(-x/2).
A frame holding any number of tests gets its p-values in one projection.

Arguments are column names or SQL expressions; one parsed expression is far
cheaper to build than dozens of nested Column calls.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chebyshev fit of ln(erfc(z) * (1 + z/2)) + z*z in t = 1/(1 + z/2)
# (published; relative error below 1.2e-7 for every z >= 0), constant term first.
ERFC_COEFFICIENTS = (
    -1.26551223,
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
)


def _erfc(z: str) -> str:
    t = f"(1D / (1D + 0.5D * ({z})))"
    *rest, poly = [f"{c!r}D" for c in ERFC_COEFFICIENTS]
    for coefficient in reversed(rest):
        poly = f"({poly} * {t} + {coefficient})"
    return f"{t} * exp({poly} - ({z}) * ({z}))"


def erfc(z: str) -> Column:
    """Complementary error function for ``z >= 0``."""
    return F.expr(_erfc(z))


def normal_two_sided(z: str) -> Column:
    """P(|Z| > |z|) for a standard normal Z."""
    return F.expr(_erfc(f"abs({z}) / sqrt(2D)"))


def _sum_of_exp(first_log: str, h: str, terms: str, offset: float) -> str:
    """exp(L1) + exp(L2) + ... with L(i) = L(i-1) + ln h - ln(i - offset), ``terms`` of them."""
    next_log = f"acc.log + ln({h}) - ln(i - {offset}D)"
    # sequence(2, 1) would count down, hence the guard
    indices = f"if({terms} >= 2, sequence(2, cast({terms} AS int)), cast(array() AS array<int>))"
    total = (
        f"aggregate({indices},"
        f" named_struct('log', {first_log}, 'total', exp({first_log})),"
        f" (acc, i) -> named_struct('log', {next_log}, 'total', acc.total + exp({next_log})),"
        f" acc -> acc.total)"
    )
    return f"if({terms} >= 1, {total}, 0D)"


def chi2_tail(x: str, dof: str) -> Column:
    """P(X > x) for a chi-square variable with whole ``dof``; NULL unless ``dof >= 1``."""
    h = f"(cast({x} AS double) / 2D)"
    half = f"floor(({dof}) / 2)"
    # even: e^-h * sum_{i=0}^{dof/2-1} h^i / i!   (term i of the sum is number i+1)
    even = _sum_of_exp(f"-{h}", h, half, 1.0)
    # odd: erfc(sqrt h) + e^-h * sum_{i=1}^{(dof-1)/2} h^(i-1/2) / Gamma(i+1/2)
    first_odd = f"-{h} + {math.log(2.0)!r}D + 0.5D * (ln({h}) - {math.log(math.pi)!r}D)"
    odd = f"{_erfc(f'sqrt({h})')} + {_sum_of_exp(first_odd, h, half, 0.5)}"
    return F.expr(
        f"CASE WHEN ({x}) IS NULL OR ({dof}) < 1 THEN NULL"
        f" WHEN ({x}) <= 0 THEN 1D"
        f" ELSE least(1D, if(({dof}) % 2 = 0, {even}, {odd})) END"
    )
