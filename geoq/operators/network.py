"""Street-network operators (L-series) on edge-list DataFrames.

A graph is two DataFrames: ``nodes(id, ...)`` and ``edges(u, v, length,
...)``.  Iterative algorithms run as rounds of joins + aggregations on the
driver-side loop, each round's state cut from its lineage with a reliable
checkpoint (``spark.checkpoint.dir``), convergence detected by counting
changed rows -- no adjacency list is ever collected.

Lookups by node (``looked_up``) go through proxies: a node that very many
edges name is divided, so no task gets all of its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoq.session import cut_lineage, drop_stored, stored

#: Parts that the rows of one key are divided into when something is looked up for it.
PROXIES = 64

# Highway classes of the 'drive' network of the derived street data.
DRIVE = ["1-URGENT", "2-HIGH"]


def _shuffled(table: DataFrame) -> DataFrame:
    """A side of a join that is not to be gathered on the driver and sent to
    every executor: over the rounds of a loop such broadcasts add up."""
    return table.hint("merge")


def looked_up(rows: DataFrame, keys, table: DataFrame) -> DataFrame:
    """``rows`` joined with ``table``, whose ``keys`` are unique.  Every key is
    divided into proxies by a hash of the row; the table is asked once for each
    proxy that occurs, and rows meet their own proxy.  A key with a third of
    all rows is the work of ``PROXIES`` tasks, not of one."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = rows.withColumn("_proxy", F.pmod(F.xxhash64(*rows.columns), F.lit(PROXIES)).cast("int"))
    found = rows.select(*keys, "_proxy").distinct().join(_shuffled(table), keys)
    return rows.join(_shuffled(found), [*keys, "_proxy"]).drop("_proxy")


def build_graph(ways: DataFrame, nodes: DataFrame, highways=None, oneway=None, retain_all: bool = True) -> DataFrame:
    """L1: ways -> directed edges split at intersections.

    A way is cut at its end nodes and at every node shared by two or more
    way positions; the node sequence between two cuts becomes one edge
    whose length is the sum of its segment lengths.  At a node that ``nodes``
    does not hold the way is cut too, and the segments to it go.  Ways whose
    ``oneway`` predicate is false also get the reversed edge.  ``key`` numbers
    parallel edges (u, v) as in a MultiDiGraph.  ``retain_all=False`` keeps
    only the largest weakly connected part (most nodes; of equals the one with
    the smallest node).  Returns (u, v, key, way_id, length)."""
    w = ways
    if highways is not None:
        w = w.where(F.try_element_at("tags", F.lit("highway")).isin(list(highways)))
    ow = oneway if oneway is not None else F.lit(False)
    w = w.select(F.col("id").alias("way_id"), ow.alias("oneway"), "nd")
    refs = w.select("way_id", "oneway", F.posexplode("nd").alias("pos", "node"))
    use = refs.groupBy("node").agg(F.count(F.lit(1)).alias("uses"))
    xy = nodes.select(F.col("id").alias("node"), "x", "y")
    ww = Window.partitionBy("way_id").orderBy("pos")
    r = (looked_up(refs, "node", use.join(_shuffled(xy), "node", "left"))
         .withColumn("here", F.col("x").isNotNull())
         .withColumn("cut", (F.col("uses") >= 2) | ~F.coalesce(F.lag("here").over(ww), F.lit(False))
                     | ~F.coalesce(F.lead("here").over(ww), F.lit(False)))
         .withColumn("e", F.sum(F.col("cut").cast("int")).over(ww.rowsBetween(Window.unboundedPreceding, 0)) - 1)
         .select("way_id", "oneway", "pos", "node", "x", "y", "e", F.lead("node").over(ww).alias("nxt"),
                 F.lead("x").over(ww).alias("x2"), F.lead("y").over(ww).alias("y2"))
         .where("x is not null and x2 is not null"))
    seg = r.withColumn("len", F.sqrt((F.col("x2") - F.col("x")) * (F.col("x2") - F.col("x"))
                                     + (F.col("y2") - F.col("y")) * (F.col("y2") - F.col("y"))))
    e = seg.groupBy("way_id", "e", "oneway").agg(F.min_by("node", "pos").alias("u"), F.max_by("nxt", "pos").alias("v"),
                                                 F.sum("len").alias("length"))
    if not retain_all:
        e = stored(e)
        ids = e.select(F.col("u").alias("id")).unionByName(e.select(F.col("v").alias("id"))).distinct()
        parts = connected_components(ids, e)
        largest = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
        inside = looked_up(parts, "component", largest.select("component")).select(F.col("id").alias("u"))
        e = e.join(_shuffled(inside), "u", "left_semi")
    both = e.unionByName(e.where(~F.col("oneway")).select(
        "way_id", "e", "oneway", F.col("v").alias("u"), F.col("u").alias("v"), "length"))
    k = F.row_number().over(Window.partitionBy("u", "v").orderBy("way_id", "e", F.col("oneway").desc())) - 1
    return both.withColumn("key", k.cast("bigint")).select("u", "v", "key", "way_id", "length")


def graph_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """L2: nodes table of a graph (nodes used by an edge) with coordinates."""
    ids = edges.select(F.col("u").alias("id")).unionByName(edges.select(F.col("v").alias("id"))).distinct()
    return nodes.join(ids, "id", "left_semi")


def undirected(edges: DataFrame) -> DataFrame:
    """L3: to_undirected(): one row per node pair."""
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _star(pairs: DataFrame) -> DataFrame:
    """Every (u, v) with the least of u and all v of its u.  The proxies of a
    node that occur are found along with its least neighbour."""
    dealt = pairs.withColumn("_proxy", F.pmod(F.xxhash64("v"), F.lit(PROXIES)).cast("int"))
    least = dealt.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("_proxy").alias("_proxies")) \
        .select("u", F.least("u", "m").alias("m"), F.explode("_proxies").alias("_proxy"))
    return dealt.join(_shuffled(least), ["u", "_proxy"]).drop("_proxy")


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """L4: component label = smallest node id of the component.

    Alternating large and small stars: a large star hangs a node's greater
    neighbours on its least one, a small star its smaller neighbours and
    itself.  Both keep the components; in the end every node hangs on the
    smallest of its component, after a number of rounds that grows with the
    logarithm of the component's size.  The least neighbour is an aggregate
    with partial sums, and handing it out goes through proxies, so neither a
    hub nor the final centre is one task's work.  A round's edges are written,
    and the round before is deleted.  Returns (id, component)."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # one shuffle, read twice
        small = _star(large)
        hung = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = stored(hung.distinct(), replaces=[e], n=F.count(F.lit(1)), a=F.bit_xor(F.xxhash64("u", "v")),
                   b=F.sum(F.xxhash64("v", "u") % 1000003))
        now = e.measured
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    return nodes.select("id").join(_shuffled(e.select(F.col("u").alias("id"), F.col("v").alias("component"))), "id", "left") \
        .select("id", F.coalesce("component", "id").alias("component"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree (in + out) per node, isolated nodes 0."""
    ends = edges.select(F.col("u").alias("id")).unionByName(edges.select(F.col("v").alias("id")))
    d = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint")
                                                           .alias("degree"))


def degree_distribution(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def network_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Basic statistics of an undirected street graph with node
    coordinates: n, m, k_avg, edge length total/avg, streets per node,
    intersection count (nodes with more than one street), circuity."""
    deg = degrees(nodes, edges)
    xy = nodes.select("id", "x", "y")
    straight = (edges.join(xy.select(F.col("id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), "u")
                .join(xy.select(F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), "v")
                .agg(F.count(F.lit(1)).alias("m"), F.sum("length").alias("total"),
                     F.sum(F.sqrt((F.col("vx") - F.col("ux")) * (F.col("vx") - F.col("ux"))
                                  + (F.col("vy") - F.col("uy")) * (F.col("vy") - F.col("uy")))).alias("straight")))
    nd = deg.agg(F.count(F.lit(1)).alias("n"), F.avg("degree").alias("spn"),
                 F.count(F.when(F.col("degree") > 1, 1)).alias("ic"))
    from geoq.operators.aggregates import join_scalars
    s = join_scalars(nd, straight)
    return s.select(F.col("n").cast("bigint").alias("n"), F.col("m").cast("bigint").alias("m"),
                    F.round(2.0 * F.col("m") / F.col("n"), 6).alias("k_avg"),
                    F.round(F.col("total").cast("double"), 6).alias("edge_length_total"),
                    F.round(F.col("total") / F.col("m"), 6).alias("edge_length_avg"),
                    F.round("spn", 6).alias("streets_per_node_avg"), F.col("ic").cast("bigint").alias("intersection_count"),
                    F.round(F.col("total") / F.col("straight"), 6).alias("circuity_avg"))


def _arcs(edges: DataFrame, directed: bool) -> DataFrame:
    e = edges.select("u", "v", "length")
    if not directed:
        e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "length"))
    return e.groupBy("u", "v").agg(F.min("length").alias("length"))   # parallel edges: keep the shortest


def shortest_paths(edges: DataFrame, sources: DataFrame, directed: bool = False, with_path: bool = True,
                   max_rounds: int = 100000) -> DataFrame:
    """Shortest paths by length from many sources to all they reach.
    Each round follows the rows that the round before has bettered and keeps
    the least (dist, path) per source and node, in one job; of equal distances
    the smaller node path is taken.  Without ``with_path`` no path is carried.
    ``sources``: DataFrame with column ``src``.  Returns (src, node, dist, path
    array<node>).  For given destinations use ``shortest_path_pairs``."""
    arcs = stored(_arcs(edges, directed))
    arcs_from = arcs.select(F.col("u").alias("node"), F.col("v").alias("to"), "length")
    best = ["dist", "path", "open"] if with_path else ["dist", "open"]
    state = sources.select("src", F.col("src").alias("node"), F.lit(0).cast(arcs.schema["length"].dataType).alias("dist"),
                           F.array("src").alias("path"), F.lit(1).alias("open")).select("src", "node", *best)
    state = stored(state.distinct())
    for _ in range(max_rounds):
        front = state.where("open = 1").join(_shuffled(arcs_from), "node")
        further = front.select("src", F.col("to").alias("node"), (F.col("dist") + F.col("length")).alias("dist"),
                               *([F.concat("path", F.array("to")).alias("path")] if with_path else []), F.lit(1).alias("open"))
        every = state.withColumn("open", F.lit(0)).unionByName(further)
        least = every.groupBy("src", "node").agg(F.min(F.struct(*best)).alias("s")).select("src", "node", "s.*")
        state = stored(least, replaces=[state], open=F.sum("open"))
        if not state.measured["open"]:
            return state.drop("open")
    raise RuntimeError(f"paths are not complete after {max_rounds} rounds")


def _least(rows: DataFrame) -> DataFrame:
    """One row per (src, node): the least (dist, hops, pred); a row that is
    already done goes before an equal one that is not."""
    return rows.groupBy("src", "node").agg(F.min(F.struct("dist", "hops", "pred", "open")).alias("s")).select("src", "node", "s.*")


def shortest_path_pairs(edges: DataFrame, pairs: DataFrame, directed: bool = False, delta: float | None = None,
                        max_rounds: int = 100000) -> DataFrame:
    """One shortest path for each (src, dst) of ``pairs``.

    Delta-stepping for all sources at once.  The state has one row per source
    and node reached (dist, hops, predecessor), no paths.  Open rows of the
    bucket with the least distances are relaxed along arcs of up to ``delta``
    until none is left in the bucket, then along its longer arcs, once.  When
    all destinations of a source have been reached, the farthest of them bounds
    it: nothing beyond is followed.  Paths are read back at the end, for the
    pairs alone: sets of nodes on paths and jumps to predecessors both double
    per round, so a path of n edges takes log n joins.

    Of equal distances the path with fewer edges is taken, then the one whose
    predecessors are smaller, from the end.  ``delta`` (default: eight mean
    arcs) changes the rounds, not the result.  Negative lengths raise.  Returns
    (src, dst, dist, hops, path array<node>); a pair without a path has nulls."""
    arcs = stored(_arcs(edges, directed).where("u <> v"))
    st = arcs.agg(F.avg("length"), F.max("length"), F.min("length")).first()
    if st[2] is not None and st[2] < 0:
        raise ValueError("negative lengths")
    delta = delta or 8 * float(st[0] or 1) or 1.0
    kind, node_type = arcs.schema["length"].dataType, arcs.schema["u"].dataType
    arcs_from = arcs.select(F.col("u").alias("node"), F.col("v").alias("to"), "length")
    pairs = stored(pairs.select("src", "dst").distinct())
    state = stored(pairs.select("src").distinct().select(
        "src", F.col("src").cast(node_type).alias("node"), F.lit(0).cast(kind).alias("dist"), F.lit(0).alias("hops"),
        F.lit(None).cast(node_type).alias("pred"), F.lit(1).alias("open")))
    limit, bucket = None, None
    rounds = 0

    def bounds():
        """Distance beyond which a source need not look: known once all its
        destinations are reached."""
        at = state.select("src", F.col("node").alias("dst"), "dist")
        return pairs.join(_shuffled(at), ["src", "dst"], "left").groupBy("src").agg(
            F.when(F.count("dist") == F.count(F.lit(1)), F.max("dist")).alias("bound"))

    def relaxed(rows, which):
        """State after ``rows`` have been followed along some arcs."""
        found = looked_up_many(rows, arcs_from.where(which)).select(
            "src", F.col("to").alias("node"), (F.col("dist") + F.col("length")).cast(kind).alias("dist"), (F.col("hops") + 1).alias("hops"),
            F.col("node").alias("pred"), F.lit(1).alias("open"))
        return looked_up(found, "src", bound).where("bound is null or dist <= bound").drop("bound")

    short, long = F.col("length") <= delta, F.col("length") > delta
    any_long = st[1] is not None and st[1] > delta
    while True:
        bound = stored(bounds())
        waiting = looked_up(state.where("open = 1"), "src", bound).where("bound is null or dist <= bound")
        nearest = waiting.agg(F.min("dist")).first()[0]
        if nearest is None:
            break
        limit = (int(nearest / delta) + 1) * delta
        bucket = []
        while True:
            rounds += 1
            if rounds > max_rounds:
                raise RuntimeError(f"paths are not complete after {max_rounds} rounds")
            inside = (F.col("open") == 1) & (F.col("dist") < limit)
            front = state.where(inside)
            closed = state.withColumn("open", F.when(inside, 0).otherwise(F.col("open")))
            new = stored(_least(closed.unionByName(relaxed(front, short))), nearest=F.min(F.when(F.col("open") == 1, F.col("dist"))))
            if any_long:
                bucket.append(stored(front.select("src", "node")))
            drop_stored(state)
            state = new
            nearest = state.measured["nearest"]
            if nearest is None or nearest >= limit:
                break
        if any_long:
            seen = bucket[0]
            for more in bucket[1:]:
                seen = seen.unionByName(more)
            front = state.join(_shuffled(seen.distinct()), ["src", "node"], "left_semi")
            state = stored(_least(state.unionByName(relaxed(front, long))), replaces=[state])
            for old in bucket:
                drop_stored(old)
        drop_stored(bound)
    return _paths_back(state, pairs)


def looked_up_many(rows: DataFrame, arcs: DataFrame) -> DataFrame:
    """Open rows with the arcs of their node (any number).  A node that very
    many arcs leave is divided by its arcs, the rows meet every part of it."""
    part = F.pmod(F.xxhash64("to"), F.lit(PROXIES)).cast("int")
    dealt = arcs.withColumn("_part", part)
    parts = dealt.groupBy("node").agg(F.collect_set("_part").alias("_parts"))
    return (rows.join(_shuffled(parts), "node").withColumn("_part", F.explode("_parts")).drop("_parts")
            .join(_shuffled(dealt), ["node", "_part"]).drop("_part"))


def _paths_back(state: DataFrame, pairs: DataFrame) -> DataFrame:
    ends = stored(pairs.join(_shuffled(state.select("src", F.col("node").alias("dst"), "dist", "hops")), ["src", "dst"], "left"))
    longest = ends.agg(F.max("hops")).first()[0] or 0
    on = ends.where("hops is not null").select("src", "dst", F.col("dst").alias("node"))
    jump = stored(state.where("pred is not null").select("src", "node", F.col("pred").alias("back")))
    steps = 1
    while steps <= longest:
        back = on.join(_shuffled(jump), ["src", "node"]).select("src", "dst", F.col("back").alias("node"))
        on = stored(on.unionByName(back).distinct())
        steps *= 2
        if steps <= longest:
            further = jump.select("src", F.col("node").alias("back"), F.col("back").alias("further"))
            jump = stored(jump.join(_shuffled(further), ["src", "back"]).select("src", "node", F.col("further").alias("back")), replaces=[jump])
    path = (on.join(_shuffled(state.select("src", "node", F.col("hops").alias("at"))), ["src", "node"])
            .groupBy("src", "dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda s: s["node"]).alias("path")))
    return ends.join(_shuffled(path), ["src", "dst"], "left").select("src", "dst", "dist", "hops", "path")


def route_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """A route (node path) -> its edge rows, tagged with the route
    number; between two nodes the shortest parallel edge (then smallest
    key) is used.  ``paths``: (route, path array<node>)."""
    steps = paths.select("route", F.posexplode("path").alias("seq", "u"))
    w = Window.partitionBy("route").orderBy("seq")
    steps = steps.withColumn("v", F.lead("u").over(w)).where(F.col("v").isNotNull())
    best = edges.groupBy("u", "v").agg(F.min(F.struct("length", "key")).alias("b"))
    return steps.join(_shuffled(best), ["u", "v"]).select("route", "seq", "u", "v", F.col("b.key").alias("key"),
                                               F.col("b.length").alias("length"))


def _banned_sp(arcs: DataFrame, starts: DataFrame, banned_arcs: DataFrame, banned_nodes: DataFrame,
               max_rounds: int = 100000) -> DataFrame:
    """Batched shortest paths where every search (``sid``) has its own
    banned arcs (sid, u, v) and banned nodes (sid, node), applied as anti
    joins.  ``starts``: (sid, src).  Returns (sid, node, dist, path)."""
    dist = cut_lineage(starts.select("sid", F.col("src").alias("node"),
                                     F.lit(0).cast(arcs.schema["length"].dataType).alias("dist"),
                                     F.array(F.col("src")).alias("path")))
    frontier = dist
    for it in range(max_rounds):
        cand = (frontier.join(_shuffled(arcs.withColumnRenamed("u", "node")), "node")
                .join(_shuffled(banned_arcs.withColumnRenamed("u", "node")), ["sid", "node", "v"], "left_anti")
                .join(_shuffled(banned_nodes.withColumnRenamed("node", "v")), ["sid", "v"], "left_anti")
                .select("sid", F.col("v").alias("node"), (F.col("dist") + F.col("length")).alias("dist"),
                        F.concat("path", F.array("v")).alias("path")))
        best = cand.groupBy("sid", "node").agg(F.min(F.struct("dist", "path")).alias("b"))
        old = dist.select("sid", "node", F.struct("dist", "path").alias("o"))
        imp = cut_lineage(best.join(_shuffled(old), ["sid", "node"], "left").where(F.col("o").isNull() | (F.col("b") < F.col("o")))
                          .select("sid", "node", "b.dist", "b.path"))
        if imp.count() == 0:
            break
        dist = dist.join(_shuffled(imp.select("sid", "node")), ["sid", "node"], "left_anti").unionByName(imp)
        if it % 4 == 3:
            dist = cut_lineage(dist)
        frontier = imp
    else:
        raise RuntimeError(f"paths are not complete after {max_rounds} rounds")
    return dist


def k_shortest_paths(edges: DataFrame, pairs: DataFrame, k: int = 10, directed: bool = False) -> DataFrame:
    """K shortest simple paths per (src, dst) pair, Yen's algorithm.

    Rounds are sequential in k; within a round the spur searches of every
    pair and every spur node run as one batched search.  Ties in cost are
    broken by the smaller node path.  Returns (src, dst, rank, cost, path)."""
    arcs = cut_lineage(_arcs(edges, directed))
    pairs = pairs.select("src", "dst").distinct()
    first = shortest_paths(edges, pairs.select("src").distinct(), directed)
    A = cut_lineage(first.join(_shuffled(pairs.withColumnRenamed("dst", "node")), ["src", "node"])
                    .select("src", F.col("node").alias("dst"), F.lit(0).alias("rank"),
                            F.col("dist").alias("cost"), "path"))
    B = None
    for r in range(1, k):
        last = A.where(F.col("rank") == r - 1)
        # spur node i of the last path: root = path[0..i]
        spurs = (last.select("src", "dst", "path", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "spur"))
                 .withColumn("root", F.slice("path", 1, F.col("i") + 1))
                 .withColumn("sid", F.concat_ws(":", "src", "dst", "i")))
        spurs = cut_lineage(spurs)
        # arcs leaving the spur along any known path sharing the root
        ban_arcs = (spurs.join(_shuffled(A.select("src", "dst", F.col("path").alias("p"))), ["src", "dst"])
                    .where((F.size("p") > F.col("i") + 1) & (F.slice("p", 1, F.col("i") + 1) == F.col("root")))
                    .select("sid", F.try_element_at("p", F.col("i") + 1).alias("u"), F.try_element_at("p", F.col("i") + 2).alias("v")))
        ban_nodes = spurs.select("sid", F.explode_outer(F.slice("root", 1, F.col("i"))).alias("node")) \
            .where(F.col("node").isNotNull())
        sp = _banned_sp(arcs, spurs.select("sid", F.col("spur").alias("src")), ban_arcs, ban_nodes)
        found = (sp.join(_shuffled(spurs.select("sid", F.col("src").alias("psrc"), F.col("dst").alias("node"), "i", "root")), ["sid", "node"])
                 .select(F.col("psrc").alias("src"), F.col("node").alias("dst"), "i", "root",
                         F.col("dist").alias("spur_cost"), F.col("path").alias("spur_path")))
        # cost of the root: sum of the arcs along it
        steps = found.select("src", "dst", "i", "root", F.posexplode(F.slice("root", 1, F.size("root"))).alias("j", "a")) \
            .withColumn("b", F.try_element_at("root", F.col("j") + 2)).where(F.col("b").isNotNull())
        rc = (steps.join(_shuffled(arcs.withColumnRenamed("u", "a").withColumnRenamed("v", "b")), ["a", "b"])
              .groupBy("src", "dst", "i").agg(F.sum("length").alias("root_cost")))
        cand = (found.join(_shuffled(rc), ["src", "dst", "i"], "left")
                .select("src", "dst", (F.coalesce("root_cost", F.lit(0)) + F.col("spur_cost")).alias("cost"),
                        F.concat(F.slice("root", 1, F.size("root") - 1), "spur_path").alias("path")))
        B = cand if B is None else B.unionByName(cand)
        B = cut_lineage(B.distinct().join(_shuffled(A.select("src", "dst", "path")), ["src", "dst", "path"], "left_anti"))
        best = B.groupBy("src", "dst").agg(F.min(F.struct("cost", "path")).alias("b")) \
            .select("src", "dst", F.lit(r).alias("rank"), "b.cost", "b.path")
        best = cut_lineage(best)
        if best.count() == 0:
            break
        A = cut_lineage(A.unionByName(best))
        B = B.join(_shuffled(best.select("src", "dst", "path")), ["src", "dst", "path"], "left_anti")
    return A
