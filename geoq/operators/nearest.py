"""Nearest join of two point layers (C8) by growing neighbourhoods.

A point looks at the 3 x 3 cells around it on a grid whose cells hold about two
points of the other side.  What it finds within one cell's side is nearest for
certain, as nothing closer can lie outside; the points that found nothing so
close look again on a grid of twice the side, and so on.  Few are left after
each round, so the pairs looked at are linear in the points, and no pair
within the greatest distance is made that a closer one rules out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoq.session import drop_stored, stored

#: Points of the other side a cell is meant to hold; points of a cell that one task compares.
PER_CELL, CHUNK = 2, 4096


def nearest(left: DataFrame, right: DataFrame, max_distance: float | None = None, *, key: str = "id", right_key: str = "id",
            xy=("x", "y"), right_xy=("x", "y")) -> DataFrame:
    """``(left_id, right_id, dist_sq)``: for every point of ``left`` the nearest
    of ``right``, all of them if several are equally near, within
    ``max_distance`` if given.  Points without coordinates, and left points
    with nothing in reach, are left out; ``key`` is unique in ``left``."""
    def points(df, k, c):
        x, y = F.col(c[0]).cast("double"), F.col(c[1]).cast("double")
        return df.select(F.col(k).alias("id"), x.alias("x"), y.alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")

    a, b = points(left, key, xy), points(right, right_key, right_xy)
    box = [f(c).alias(n) for n, f, c in (("x0", F.min, "x"), ("x1", F.max, "x"), ("y0", F.min, "y"), ("y1", F.max, "y"))]
    sa, sb = a.agg(*box).first(), b.agg(F.count(F.lit(1)).alias("n"), *box).first()
    names = [F.col("id").alias("left_id"), F.col("r_id").alias("right_id"), "dist_sq"]
    if sa["x0"] is None or not sb["n"]:
        return a.join(b.select(F.col("id").alias("r_id")), F.lit(False)).select("id", "r_id", F.lit(0.0).alias("dist_sq")).select(*names)
    width, height = sb["x1"] - sb["x0"], sb["y1"] - sb["y0"]
    reach = 2 * (max(sa["x1"], sb["x1"]) - min(sa["x0"], sb["x0"]) + max(sa["y1"], sb["y1"]) - min(sa["y0"], sb["y0"])) or 1.0
    if max_distance is not None:
        reach = min(reach, float(max_distance))
    side = (PER_CELL * width * height / sb["n"]) ** 0.5 or PER_CELL * max(width, height) / sb["n"] or reach
    found = None
    asking = a
    while True:
        side = min(side, reach)
        grid = side * (1 + 1e-9) or 1.0  # rounding must not put a point at the side's distance two cells off

        def cell(c):
            return F.floor(F.col(c) / F.lit(grid))
        cells = b.select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
        sizes = cells.groupBy("cx", "cy").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.lit(1)).cast("int").alias("chunks"))
        around = F.explode(F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        asked = (asking.withColumn("c", around).select("id", "x", "y", "c.*").join(sizes, ["cx", "cy"])
                 .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks"))
        held = cells.join(sizes, ["cx", "cy"]).select("cx", "cy", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"),
                                                      F.col("id").alias("r_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))
        dx, dy = F.col("x") - F.col("rx"), F.col("y") - F.col("ry")
        met = asked.join(held, ["cx", "cy", "chunk"]).select("id", "r_id", (dx * dx + dy * dy).alias("dist_sq")) \
            .where(F.col("dist_sq") <= side * side)
        best = met.withColumn("rk", F.rank().over(Window.partitionBy("id").orderBy("dist_sq"))).where("rk = 1").select("id", "r_id", "dist_sq")
        if side >= reach:
            return (best if found is None else found.unionByName(best)).select(*names)
        best = stored(best)
        found = best if found is None else found.unionByName(best)
        last, asking = asking, stored(asking.join(best.select("id"), "id", "left_anti"), n=F.count(F.lit(1)))
        drop_stored(last)
        if not asking.measured["n"]:
            return found.select(*names)
        side *= 2
