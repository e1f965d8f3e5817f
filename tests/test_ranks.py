"""Exact ranks by refinement against a sort."""

import random

import numpy as np
from pyspark.sql import functions as F

from geoq.operators import aggregates as AG


def _values():
    r = random.Random(2)
    v = [r.gauss(0, 1) for _ in range(20000)] + [1e12, -1e12, 1e-300, 0.0, -0.0] + [3.25] * 9000 + [1.0 + k * 2.0 ** -52 for k in range(50)]
    r.shuffle(v)
    return v


def test_values_at_ranks_equal_a_sort(spark):
    v = _values()
    df = spark.createDataFrame([(x,) for x in v] + [(None,), (float("nan"),)], "x double").repartition(5)
    s = sorted(v)
    ranks = [0, 1, 17, len(s) // 2, len(s) // 3, len(s) - 1, s.index(3.25), s.index(3.25) + 8999]
    got = AG.values_at_ranks(df, "x", [*ranks, len(s), -1])
    assert {r: got[r] for r in ranks} == {r: s[r] for r in ranks} and got[len(s)] is None and got[-1] is None
    ids = spark.range(10 ** 15, 10 ** 15 + 30000)
    assert AG.values_at_ranks(ids, "id", [0, 12345, 29999]) == {0: 10 ** 15, 12345: 10 ** 15 + 12345, 29999: 10 ** 15 + 29999}


def test_quantiles_and_empties(spark):
    v = _values()
    q = AG.exact_quantiles(spark.createDataFrame([(x,) for x in v], "x double"), "x", [0.0, 0.25, 0.5, 0.9, 1.0]).first()
    for name, share in (("q0", 0), ("q25", .25), ("q50", .5), ("q90", .9), ("q100", 1)):
        assert abs(q[name] - np.quantile(v, share)) <= 1e-9 * max(1, abs(q[name]))
    none = spark.createDataFrame([(None,)], "x double")
    assert AG.exact_quantiles(none, "x", [0.5]).first()["q50"] is None and AG.values_at_ranks(none, "x", [0]) == {0: None}


def test_smallest_rows_break_ties(spark):
    r = random.Random(4)
    rows = [(k, float(r.randrange(5))) for k in range(12000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, x double")
    for k in (0, 1, 5000, 11999, 12000, 20000):
        assert {x.id for x in AG.smallest_rows(df, "x", "id", k).collect()} == {i for i, _ in sorted(rows, key=lambda t: (t[1], t[0]))[:k]}


def test_no_sort_of_the_whole_table(spark):
    """The plan of the cut is a filter over the scan."""
    df = spark.range(10000).select("id", (F.col("id") % 97).cast("double").alias("x"))
    plan = AG.smallest_rows(df, "x", "id", 9000)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
