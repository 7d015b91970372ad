"""Exact quantiles against numpy, by counting and by narrowing."""

import random

import numpy as np
import pytest

from datagauge.operators import quantiles

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


def data(kind, n=3000):
    rng = random.Random(5)
    return {
        "distinct": [rng.gauss(0, 1e6) for _ in range(n)],
        "heavy": [rng.choice([0.0, 1.0]) if rng.random() < 0.9 else 0.4 + rng.random() / 10 for _ in range(n)],
        "tail": [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(n)],
        "one": [7.5] * n,
        "single": [3.0],
        "infinite": [float("inf"), float("-inf"), *map(float, range(40))],
    }[kind]


@pytest.mark.parametrize("most", [4, quantiles.MOST])
@pytest.mark.parametrize("kind", ["distinct", "heavy", "tail", "one", "single", "infinite"])
def test_against_numpy(spark, kind, most):
    values = data(kind)
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "`a.b` double").repartition(3)
    probs = PROBS if kind != "infinite" else (0.1, 0.5)
    got = quantiles.quantiles(rows, ["a.b"], probs, most)["a.b"]
    assert np.allclose(got, np.quantile(values, probs), rtol=1e-12, atol=0)


def test_empty_null_and_nan(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, float("nan")), (None, 2.0)], "a double, b double")
    for most in (1, quantiles.MOST):
        found = quantiles.quantiles(rows, ["a", "b"], (0.0, 0.5, 1.0), most)
        assert found["a"] == [None] * 3 and found["b"][:2] == [1.0, 2.0] and found["b"][2] != found["b"][2]
    assert quantiles.quantiles(rows.limit(0), ["b"], (0.5,)) == {"b": [None]}


def test_profile_and_outliers_narrowing(spark):
    rows = spark.createDataFrame([(i, float(i) if i < 99 else 1e6) for i in range(100)], "id long, x double")
    assert [r.id for r in quantiles.outliers(rows, "id", "x", most=3).collect()] == [99]
    assert quantiles.outliers(rows.where("id > 96"), "id", "x").count() == 0 and quantiles.outliers(rows.limit(0), "id", "x").count() == 0
    one = quantiles.profile(rows, ["x"], most=3).collect()[0]
    assert (one.n, one.least, one.most, one.q1, one.median, one.q3) == (100, 0.0, 1e6, 24.75, 49.5, 74.25)
