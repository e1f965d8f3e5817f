"""Components, path pairs, graph build and grid DBSCAN against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from geoq.operators import network as NW
from geoq.operators.cluster import dbscan


def _components(nodes, edges):
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    label = {}
    for n in sorted(set(nodes)):
        if n in label:
            continue
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = n
                todo += near[x]
    return label


@pytest.mark.parametrize("shape", ["hub", "chain", "random", "none"])
def test_components(spark, shape):
    r = random.Random(3)
    n = 400
    edges = {"hub": [(k, 399) for k in range(300)] + [(k, k) for k in range(5)],
             "chain": [(k, k + 1) for k in r.sample(range(n - 1), n - 1) if k % 100],
             "random": [(r.randrange(n), r.randrange(n)) for _ in range(260)], "none": []}[shape]
    e = spark.createDataFrame([(u, v) for u, v in edges], "u long, v long")
    nodes = spark.createDataFrame([(k,) for k in range(n)], "id long")
    got = {x.id: x.component for x in NW.connected_components(nodes, e).collect()}
    assert got == _components(range(n), edges)


def test_lookup_divides_a_hot_key(spark):
    """No partition of the join holds all rows of a key that all rows have."""
    rows = spark.range(64000).select(F.col("id").alias("v"), F.lit(7).cast("long").alias("u"))
    table = spark.createDataFrame([(7, 1), (8, 2)], "u long, m long")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        out = NW.looked_up(rows, "u", table)
        assert out.where("m = 1").count() == 64000 and sorted(out.columns) == ["m", "u", "v"]
        sizes = [x["count"] for x in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) <= 64000 // 16 * 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_rounds_leave_no_superseded_tables(spark):
    import os

    from geoq.session import checkpoint_dir
    folder = checkpoint_dir(spark).replace("file:", "")
    before = set(os.listdir(folder))
    e = spark.createDataFrame([(k, k + 1) for k in range(200)], "u long, v long")
    out = NW.connected_components(spark.range(201).select("id"), e)
    assert out.select("component").distinct().count() == 1
    left = [x for x in set(os.listdir(folder)) - before if x.startswith("geoq-")]
    assert len(left) <= 1


def _best_path(edges, src, dst):
    """Least (length, edges), then the smallest predecessors from the end."""
    arcs = {}
    for u, v, w in edges:
        if u != v:
            for a, b in ((u, v), (v, u)):
                arcs[a, b] = min(w, arcs.get((a, b), w))
    best = {src: (0, 0)}
    for _ in range(len(edges) + 1):
        for (a, b), w in arcs.items():
            if a in best and (best[a][0] + w, best[a][1] + 1) < best.get(b, (1e18, 0)):
                best[b] = (best[a][0] + w, best[a][1] + 1)
    if dst not in best:
        return None
    path = [dst]
    while path[0] != src:
        b = path[0]
        path.insert(0, min(a for (a, x), w in arcs.items() if x == b and a in best and (best[a][0] + w, best[a][1] + 1) == best[b]))
    return best[dst] + (path,)


@pytest.mark.parametrize("delta", [None, 3.0])
def test_path_pairs(spark, delta):
    r = random.Random(9)
    edges = [(r.randrange(40), r.randrange(40), r.randint(0, 9)) for _ in range(60)] + [(k, k + 1, 1) for k in range(50, 80)]
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(12)] + [(50, 80), (50, 50), (0, 55), (99, 98), (50, 80)]
    e = spark.createDataFrame(edges, "u long, v long, length long")
    got = {(x.src, x.dst): x for x in NW.shortest_path_pairs(e, spark.createDataFrame(pairs, "src long, dst long"), delta=delta).collect()}
    assert set(got) == set(pairs)
    for (s, d), x in got.items():
        expected = _best_path(edges, s, d)
        if expected is None:
            assert (x.dist, x.path) == (None, None)
        else:
            assert (x.dist, x.hops, list(x.path)) == expected, (s, d)


def test_path_pairs_of_empty_tables(spark):
    none = spark.createDataFrame([], "u long, v long, length long")
    pairs = spark.createDataFrame([(1, 2), (3, 3)], "src long, dst long")
    got = {(x.src, x.dst): x.dist for x in NW.shortest_path_pairs(none, pairs).collect()}
    assert got == {(1, 2): None, (3, 3): 0}
    assert NW.shortest_path_pairs(none, pairs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        NW.shortest_path_pairs(spark.createDataFrame([(1, 2, -1)], "u long, v long, length long"), pairs)


def test_graph_build_cuts_at_unknown_nodes_and_keeps_the_largest_part(spark):
    nodes = spark.createDataFrame([(k, float(k), 0.0) for k in range(12) if k != 3], "id long, x double, y double")
    ways = spark.createDataFrame([(1, [0, 1, 2, 3, 4, 5, 6, 7]), (2, [10, 11]), (3, [3])], "id long, nd array<long>") \
        .withColumn("tags", F.create_map(F.lit("highway"), F.lit("x")))
    every = {(x.u, x.v): x.length for x in NW.build_graph(ways, nodes, ["x"]).collect()}
    assert every == {(0, 2): 2.0, (2, 0): 2.0, (4, 7): 3.0, (7, 4): 3.0, (10, 11): 1.0, (11, 10): 1.0}
    largest = {(x.u, x.v) for x in NW.build_graph(ways, nodes, ["x"], retain_all=False).collect()}
    assert largest == {(0, 2), (2, 0)}  # two nodes each: the part with the smallest node


def _dbscan(points, eps, min_pts):
    near = {a: [b for b, (x2, y2) in points.items() if (x - x2) ** 2 + (y - y2) ** 2 <= eps * eps] for a, (x, y) in points.items()}
    core = {a for a, bs in near.items() if len(bs) >= min_pts}
    label = _components(core, [(a, b) for a in core for b in near[a] if b in core])
    out = {a: (label[a], True) for a in core}
    for a, bs in near.items():
        if a not in core:
            out[a] = (min((label[b] for b in bs if b in core), default=-1), False)
    return out


def test_dbscan_equals_brute_force(spark):
    r = random.Random(6)
    points = {}
    for k in range(5):  # dense spots close to each other, some just out of reach
        cx, cy = 100 + 14.2 * k, 50 + (k % 2) * 3
        for _ in range(120):
            points[len(points)] = (cx + r.gauss(0, 1.5), cy + r.gauss(0, 1.5))
    for _ in range(250):
        points[len(points)] = (float(r.randrange(0, 300)), float(r.randrange(0, 120)))
    for _ in range(60):  # one place, many times
        points[len(points)] = (290.0, 5.0)
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in points.items()] + [(9000, None, 1.0), (9001, float("nan"), 2.0)],
                               "id long, x double, y double")
    for eps, min_pts in ((4.0, 5), (10.0, 12), (10.0, 1)):
        got = {x.id: (x.label, x.is_core) for x in dbscan(df, eps, min_pts).collect()}
        assert got.pop(9000) == (-1, False) and got.pop(9001) == (-1, False)
        assert got == _dbscan(points, eps, min_pts), (eps, min_pts)


def test_dbscan_refines_dense_cells(spark):
    """Two dense cells whose boxes do not decide: linked and not linked."""
    r = random.Random(1)
    for gap, clusters in ((9.99, 1), (10.01, 2)):
        left = [(-r.random() * 3, r.random() * 3) for _ in range(200)] + [(0.0, 1.5)]
        right = [(gap + r.random() * 3, r.random() * 3) for _ in range(200)] + [(gap, 1.5)]
        rows = [(k, x, y) for k, (x, y) in enumerate(left + right)]
        out = dbscan(spark.createDataFrame(rows, "id long, x double, y double"), 10.0, 50)
        expected = _dbscan({k: (x, y) for k, x, y in rows}, 10.0, 50)
        got = {x.id: (x.label, x.is_core) for x in out.collect()}
        assert got == expected and len({v[0] for v in got.values()}) == clusters


def test_dbscan_of_nothing(spark):
    assert dbscan(spark.createDataFrame([], "id long, x double, y double"), 1.0, 3).count() == 0
