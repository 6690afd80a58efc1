"""Incomplete gamma and beta functions of large shapes against their expansions and against sums."""

import math

import numpy as np
import pytest

from millrace.functions import special


@pytest.mark.parametrize("a", [1e3, 1e6, 1e7, 1e8, 1e9])
def test_gamma_of_large_shapes(a):
    got = special._gamma_inc([a, a, a, a], [a, a + 40 * math.sqrt(a), a - 40 * math.sqrt(a) if a > 2000 else 1.0, 2 * a])
    # P(a, a) = 1/2 + 1 / (3 sqrt(2 pi a)) + 1 / (540 a sqrt(2 pi a)) + ...
    r = math.sqrt(2 * math.pi * a)
    assert got[0] == pytest.approx(0.5 + 1 / (3 * r) + 1 / (540 * a * r), abs=1e-11 + 0.01 / a**2.5)
    assert got[1] == pytest.approx(1.0, abs=1e-12) and got[2] == pytest.approx(0.0, abs=1e-12) and got[3] == 1.0


def test_gamma_on_both_sides_of_the_change():
    """Just above the shape at which the integral begins it is as the series and the fraction are."""
    a = np.full(41, special.BY_INTEGRAL + 3)
    x = a + np.linspace(-6, 6, 41) * np.sqrt(a)
    large = special._gamma_inc(a, x)
    before, special.BY_INTEGRAL = special.BY_INTEGRAL, 1e9
    try:
        plain = special._gamma_inc(a, x)
    finally:
        special.BY_INTEGRAL = before
    assert np.abs(large - plain).max() < 1e-11


def test_poisson_sums_are_gamma_tails():
    """The chance of at most n events at mean m is 1 - P(n + 1, m)."""
    m, n = 5000.0, np.array([4800, 4950, 5000, 5100])
    sums = [math.fsum(math.exp(k * math.log(m) - m - math.lgamma(k + 1)) for k in range(int(v) + 1)) for v in n]
    assert np.allclose(1 - special._gamma_inc(n + 1.0, np.full(4, m)), sums, atol=1e-9)


def test_beta_of_large_shapes():
    for a, b in ((2000, 3000), (1e6, 2e6), (1e9, 1e9)):
        assert special._beta_share(a, b, a / (a + b)) == pytest.approx(0.5 + (b - a) / (3 * math.sqrt(2 * math.pi * a * b * (a + b))), abs=1e-11 + 1 / (a + b) ** 1.5)
    # a sum of binomial chances
    n, k, p = 6000, 2500, 0.41
    tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))
    assert special._beta_share(k, n - k + 1, p) == pytest.approx(tail, abs=1e-9)


def test_edges():
    got = special._gamma_inc([2.0, 2.0, 2.0, 1e7, 2.0], [0.0, float("inf"), float("nan"), 0.0, 2.0])
    assert got[0] == 0 and got[1] == 1 and math.isnan(got[2]) and got[3] == 0 and got[4] == pytest.approx(1 - 3 * math.exp(-2))
