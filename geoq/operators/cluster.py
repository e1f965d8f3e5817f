"""Density clustering (M1) on a grid: DBSCAN without a table of neighbour pairs.

Cells have the side eps / sqrt(2), so any two points of a cell are neighbours:

* A cell with ``min_pts`` points holds core points only.  Every other cell has
  fewer, so all the points that have to count their neighbours are few per
  cell, and the counting is linear in the points.
* The core points of a cell are one node.  Two cells up to two apart are linked
  if any of their core points are neighbours: by the cells' boxes when these
  decide it, by the points when both have few, else by the boxes of 4 x 4
  sub-cells of the undecided ones, and so on.
* Components of the nodes are the clusters; the points that are not core look
  for core points in the cells about them.

A cell with very many points is dealt out in chunks wherever points of others
are compared with it; where its points look up the cell's own row, the side
with one row per cell is the small one (broadcast or split by AQE).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoq.operators.network import connected_components
from geoq.session import stored

#: Points of a cell that one task compares with others; points of a box that are compared one by one.
CHUNK, FEW = 4096, 32

_AROUND = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]


def _cells_around(offsets) -> Column:
    return F.explode(F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx, dy in offsets]))


def _meeting(probes: DataFrame, points: DataFrame, cells: DataFrame, offsets, eps: float) -> DataFrame:
    """(id of the probe, columns of the point beginning with p_) for every point
    within eps in the probe's cells around.  ``cells``: (cx, cy, n) of points."""
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("int")
    asked = (probes.select(F.col("id"), F.col("x"), F.col("y"), _cells_around(offsets).alias("c")).select("id", "x", "y", "c.*")
             .join(cells.select("cx", "cy", chunks.alias("chunks")), ["cx", "cy"])
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks"))
    dealt = points.withColumn("chunk", F.pmod(F.xxhash64("p_id"), chunks).cast("int")).drop("n")
    dx, dy = F.col("x") - F.col("p_x"), F.col("y") - F.col("p_y")
    return asked.join(dealt, ["cx", "cy", "chunk"]).where(dx * dx + dy * dy <= eps * eps)


def _gap(lo1, hi1, lo2, hi2) -> Column:
    return F.greatest(F.col(lo2) - F.col(hi1), F.col(lo1) - F.col(hi2), F.lit(0.0))


def _span(lo1, hi1, lo2, hi2) -> Column:
    return F.greatest(F.col(hi2) - F.col(lo1), F.col(hi1) - F.col(lo2))


def _boxes(points: DataFrame, keys, tag: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{tag}n"), *[
        f(c).alias(f"{tag}{n}") for n, f, c in (("x0", F.min, "x"), ("x1", F.max, "x"), ("y0", F.min, "y"), ("y1", F.max, "y"))])


def _linked_cells(core: DataFrame, side: float, eps: float) -> DataFrame:
    """(u, v): nodes of cells that hold neighbouring core points.  ``core``:
    (node, cx, cy, x, y)."""
    near, far = eps * eps, eps * eps
    dmin = (lambda a, b: a * a + b * b)(_gap("ax0", "ax1", "bx0", "bx1"), _gap("ay0", "ay1", "by0", "by1"))
    dmax = (lambda a, b: a * a + b * b)(_span("ax0", "ax1", "bx0", "bx1"), _span("ay0", "ay1", "by0", "by1"))

    def judged(pairs):
        return pairs.where(dmin <= near).withColumn("sure", dmax <= far)

    cells = _boxes(core, ["node", "cx", "cy"], "a")
    half = [o for o in _AROUND if o > (0, 0)]
    other = cells.select(*[F.col(c).alias("b" + c[1:] if c.startswith("a") else c) for c in cells.columns]).withColumnRenamed("node", "v")
    pairs = stored(judged(cells.withColumnRenamed("node", "u").withColumn("c", _cells_around(half)).drop("cx", "cy")
                          .select("*", "c.cx", "c.cy").drop("c").join(other, ["cx", "cy"])).select(
        "u", "v", F.lit("").alias("a_box"), F.lit("").alias("b_box"), "an", "bn", "sure"))
    links, level, old = [], 0, None
    boxed = core.select(F.col("node"), "x", "y", F.lit("").alias("box"))
    while True:
        sure = pairs.where("sure").select("u", "v")
        open_pairs = pairs.where("not sure").join(sure, ["u", "v"], "left_anti")
        few = (F.col("an") <= FEW) & (F.col("bn") <= FEW)
        a = boxed.select(F.col("node").alias("u"), F.col("box").alias("a_box"), F.col("x").alias("x"), F.col("y").alias("y"))
        b = boxed.select(F.col("node").alias("v"), F.col("box").alias("b_box"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
        met = open_pairs.where(few).select("u", "v", "a_box", "b_box").join(a, ["u", "a_box"]).join(b, ["v", "b_box"]) \
            .where(dx * dx + dy * dy <= eps * eps).select("u", "v")
        links.append(stored(sure.unionByName(met).distinct()))
        wide = open_pairs.where(~few)
        if wide.isEmpty():
            break
        level += 1
        fine = side / 4.0 ** level
        child = boxed.join(wide.select(F.col("u").alias("node"), F.col("a_box").alias("box"))
                           .union(wide.select("v", "b_box")).distinct(), ["node", "box"], "left_semi")
        child = child.select("node", F.col("box").alias("parent"), F.concat_ws("/", "box", F.floor(F.col("x") / fine), F.floor(F.col("y") / fine)).alias("box"), "x", "y")
        boxes = _boxes(child, ["node", "parent", "box"], "a")
        b_boxes = boxes.select(F.col("node").alias("v"), F.col("parent").alias("b_parent"), F.col("box").alias("b_box"),
                               *[F.col(f"a{c}").alias(f"b{c}") for c in ("n", "x0", "x1", "y0", "y1")])
        a_boxes = boxes.withColumnRenamed("node", "u").withColumnRenamed("parent", "a_parent").withColumnRenamed("box", "a_box")
        met = links[-1]
        cut = wide.join(met, ["u", "v"], "left_anti").select("u", "v", F.col("a_box").alias("a_parent"), F.col("b_box").alias("b_parent"))
        pairs = stored(judged(cut.join(a_boxes, ["u", "a_parent"]).join(b_boxes, ["v", "b_parent"]))
                       .select("u", "v", "a_box", "b_box", "an", "bn", "sure"))
        boxed = child.select("node", "x", "y", "box")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.distinct()


def dbscan(points: DataFrame, eps: float, min_pts: int, key="id", xy=("x", "y")) -> DataFrame:
    """DBSCAN(eps, min_samples): core points have at least ``min_pts`` points
    within ``eps`` (a point counts itself), clusters are the connected
    components of neighbouring core points (label = smallest core id), a
    border point takes the smallest label among its core neighbours, the rest
    is noise (label -1), as are points without coordinates.  Returns (key,
    label, is_core)."""
    side = eps / 2.0 ** 0.5 * (1 - 1e-12)  # rounding must not make a cell wider than eps across
    x, y = F.col(xy[0]).cast("double"), F.col(xy[1]).cast("double")
    every = points.select(F.col(key).alias("id"), x.alias("x"), y.alias("y"))
    pts = every.where("x is not null and y is not null and not isnan(x) and not isnan(y)") \
        .withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    cells = pts.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    pts = stored(pts.join(cells, ["cx", "cy"]))
    cells = pts.select("cx", "cy", "n").distinct()

    # points of cells with fewer than min_pts count what lies in the cells around
    thin = pts.where(F.col("n") < min_pts)
    as_points = pts.select("cx", "cy", "n", F.col("id").alias("p_id"), F.col("x").alias("p_x"), F.col("y").alias("p_y"))
    around = [o for o in _AROUND if o != (0, 0)]
    seen = _meeting(thin, as_points, cells, around, eps).groupBy("id").agg(F.count(F.lit(1)).alias("seen"))
    thin = thin.join(seen, "id", "left").withColumn("is_core", F.col("n") + F.coalesce("seen", F.lit(0)) >= min_pts).drop("seen")
    known = stored(thin.unionByName(pts.where(F.col("n") >= min_pts).withColumn("is_core", F.lit(True))).drop("n"))

    core = known.where("is_core").drop("is_core")
    nodes = stored(core.groupBy("cx", "cy").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")))
    core = stored(core.join(nodes, ["cx", "cy"]))
    links = _linked_cells(core.select("node", "cx", "cy", "x", "y"), side, eps)
    clusters = connected_components(nodes.select(F.col("node").alias("id")), links)
    labels = stored(nodes.join(clusters.select(F.col("id").alias("node"), F.col("component").alias("label")), "node"))

    edge_points = known.where("not is_core")
    as_points = core.select("cx", "cy", "n", F.col("id").alias("p_id"), F.col("x").alias("p_x"), F.col("y").alias("p_y"), "node")
    met = _meeting(edge_points, as_points, labels.select("cx", "cy", "n"), _AROUND, eps).select("id", "node").distinct()
    border = met.join(labels.select("node", "label"), "node").groupBy("id").agg(F.min("label").alias("label"))
    found = core.select("id", "node").join(labels.select("node", "label"), "node").select("id", "label", F.lit(True).alias("is_core")) \
        .unionByName(border.withColumn("is_core", F.lit(False)))
    return (every.select("id").join(found, "id", "left")
            .select(F.col("id").alias(key), F.coalesce("label", F.lit(-1)).cast("bigint").alias("label"),
                    F.coalesce("is_core", F.lit(False)).alias("is_core")))
