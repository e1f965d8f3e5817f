"""Statistics of the street graph cover every order."""

import pytest

import __spark_entry__ as E


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("streets"))
    spark.range(1, 11).selectExpr("id AS c_custkey", "'BUILDING' AS c_mktsegment").write.parquet(f"{d}/customer.parquet")
    spark.range(1, 41).selectExpr("id AS o_orderkey", "1 + id % 10 AS o_custkey", "'5-LOW' AS o_orderpriority") \
        .write.parquet(f"{d}/orders.parquet")
    edges = [(1 + k % 10, ((1 + k % 10) * 7 + k % 3) % 10, 1 + k * 17 % 97) for k in range(1, 41)]
    return d, edges


def test_every_order_is_a_street(spark, small):
    d, edges = small
    q = E.queries()
    s = q["edge_length_stats"](spark, d).first()
    assert (s.n, s.total) == (40, sum(x for _, _, x in edges))
    assert {tuple(r) for r in q["undirected_edges"](spark, d).collect()} == {(min(u, v), max(u, v)) for u, v, _ in edges}
    degrees = [sum((u == c) + (v == c) for u, v, _ in edges) for c in range(1, 11)]
    assert {tuple(r) for r in q["degree_distribution"](spark, d).collect()} == {(x, degrees.count(x)) for x in degrees}
    st = q["network_stats"](spark, d).first()
    assert (st.n, st.m) == (10, sum(v > 0 for _, v, _ in edges))
