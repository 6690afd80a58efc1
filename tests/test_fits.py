import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import stats


def test_curve_of_two_parameters(spark):
    rows = spark.range(200).select((F.col("id") / 40).alias("x")).withColumn("y", 3 * F.exp(-0.7 * F.col("x")))
    (a, b), error = stats.fit_curve(rows, "x", "y", lambda x, p: p[0] * F.exp(-p[1] * x), [1.0, 0.1])
    assert (a, b) == (pytest.approx(3, abs=1e-6), pytest.approx(0.7, abs=1e-6)) and error < 1e-9
    odd = rows.union(spark.createDataFrame([(None, 5.0), (1.0, None)], "x double, y double"))
    assert stats.fit_curve(odd, "x", "y", lambda x, p: p[0] * F.exp(-p[1] * x), [1.0, 0.1])[0] == pytest.approx([a, b], abs=1e-6)
    with pytest.raises(ValueError, match="no rows"):
        stats.fit_curve(rows.limit(0), "x", "y", lambda x, p: p[0] * x, [1.0])


def test_noise_leaves_the_least_squares(spark):
    rng = random.Random(4)
    data = [(x := rng.random() * 6, 2 + 0.5 * x + rng.gauss(0, 0.3)) for _ in range(400)]
    mx, my = (sum(v) / len(data) for v in zip(*data, strict=True))
    slope = sum((x - mx) * (y - my) for x, y in data) / sum((x - mx) ** 2 for x, _ in data)
    (a, b), error = stats.fit_curve(spark.createDataFrame(data, "x double, y double"), "x", "y", lambda x, p: p[0] + p[1] * x, [0.0, 0.0])
    assert (a, b) == (pytest.approx(my - slope * mx, abs=1e-6), pytest.approx(slope, abs=1e-6))
    assert error == pytest.approx(sum((y - my + slope * mx - slope * x) ** 2 for x, y in data), rel=1e-8)


def test_distributions(spark):
    rng = random.Random(9)
    vals = spark.createDataFrame([(rng.gauss(5, 2),) for _ in range(3000)] + [(None,)], "v double")

    def normal(x, p):
        return 0.5 * (1 + math.erf((x - p[0]) / (abs(p[1]) * math.sqrt(2)))) if p[1] else 0.0

    (mu, sigma), chi2 = stats.fit_distribution(vals, "v", normal, [3.0, 1.0])
    assert mu == pytest.approx(5, abs=0.2) and abs(sigma) == pytest.approx(2, abs=0.15) and chi2 < 45
    dense = lambda x, p: F.exp(-(x - p[0]) * (x - p[0]) / (2 * p[1] * p[1])) / (abs(p[1]) * math.sqrt(2 * math.pi))
    (mu, sigma), _ = stats.fit_density(vals, "v", dense, [4.0, 1.0], -3.0, 13.0, 0.5)
    assert mu == pytest.approx(5, abs=0.25) and abs(sigma) == pytest.approx(2, abs=0.25)
    with pytest.raises(ValueError, match="no values"):
        stats.fit_distribution(vals.limit(0), "v", normal, [0.0, 1.0])


def test_low_point():
    at, low = stats._least(lambda p: (1 - p[0]) ** 2 + 20 * (p[1] - p[0] ** 2) ** 2, [-1.0, 2.0])
    assert at == pytest.approx([1, 1], abs=1e-3) and low < 1e-6
