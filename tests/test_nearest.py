"""Nearest join against brute force."""

import random

import pytest

from geoq.operators.nearest import nearest


def _brute(a, b, most):
    out = set()
    for i, x, y in a:
        d = [((x - x2) ** 2 + (y - y2) ** 2, j) for j, x2, y2 in b]
        if d and (most is None or min(d)[0] <= most * most):
            out |= {(i, j, v) for v, j in d if v == min(d)[0]}
    return out


@pytest.mark.parametrize("most", [None, 15.0, 0.0])
def test_nearest_equals_brute_force(spark, most):
    r = random.Random(8)
    a = [(k, float(r.randrange(-300, 300)), float(r.randrange(-300, 300))) for k in range(400)] + [(900, 5000.0, 0.0)]
    b = [(k, float(r.randrange(100)), float(r.randrange(100))) for k in range(150)] + [(1000 + k, 7.0, 7.0) for k in range(30)]
    b += [(2000, 250.0, -250.0), (2001, -250.0, 250.0)]
    left = spark.createDataFrame(a + [(901, None, 1.0)], "id long, x double, y double").repartition(4)
    right = spark.createDataFrame(b + [(2002, float("nan"), 1.0)], "id long, x double, y double").repartition(3)
    got = [tuple(x) for x in nearest(left, right, most).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(a, b, most)


def test_nearest_of_one_place_and_of_nothing(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "id long, x double, y double")
    one = spark.createDataFrame([(5, 3.0, 4.0), (6, 3.0, 4.0)], "id long, x double, y double")
    assert {tuple(x) for x in nearest(left, one).collect()} == {(1, 5, 25.0), (1, 6, 25.0), (2, 5, 0.0), (2, 6, 0.0)}
    line = spark.createDataFrame([(5, 0.0, float(k)) for k in range(9)], "id long, x double, y double")
    assert {(x.left_id, x.dist_sq) for x in nearest(left, line).collect()} == {(1, 0.0), (2, 9.0)}
    for x in (nearest(left, one.limit(0)), nearest(left.limit(0), one)):
        assert x.columns == ["left_id", "right_id", "dist_sq"] and x.count() == 0
