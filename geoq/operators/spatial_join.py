"""Spatial joins as grid-cell equi-joins.

Every geometry is given the cells of a square grid that its bounding box
(grown by the join distance on the left side) covers; the join is an
ordinary equi-join on ``(level, cx, cy)`` -- shuffled on the cell key like
any other Spark join, no nested loops, no broadcast of data whose size is
not bounded -- followed by a bounding-box check and the exact predicate.

*Reference-point de-duplication*: a pair whose boxes overlap in several
cells is emitted only in the cell holding the corner
``(max(minx1, minx2), max(miny1, miny2))`` of the two boxes, so no
``distinct`` (and no second shuffle) is needed.

*Multi-level grid*: a geometry whose box would cover more than
``max_span`` cells per axis is moved to a coarser level (cell size doubled
per level), so one huge polygon never explodes into millions of rows.  A
pair is matched at the coarser of the two levels: rows at their own level
meet rows of the other side exploded at that same (coarser) level.

Hot cells (one cell holding a third of a side) are split by AQE's skew
join, which this library turns on; ``salt`` additionally spreads the
probe side of every cell over N sub-keys and replicates the build side N
times for inputs known to be dense.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoq.functions import geometry as G
from geoq.session import stored

#: One in so many right rows is met first where one match is enough.
FIRST_SHARE = 16

PREDICATES = ("intersects", "within", "contains", "dwithin", "bbox_intersects")


class _Side:
    def __init__(self, df: DataFrame, geom, tag: str):
        self.tag = tag
        self.is_point = isinstance(geom, (tuple, list))
        self.df = df
        self.geom = geom

    def prepared(self, keep) -> DataFrame:
        t = self.tag
        if self.is_point:
            x, y = self.geom
            return self.df.select(F.struct(*keep).alias(f"{t}_k"), F.col(x).cast("double").alias(f"{t}_x"),
                                  F.col(y).cast("double").alias(f"{t}_y"))
        g = F.col(self.geom)
        # a stored bbox column (GeoParquet covering bbox / fixture column) is
        # reused instead of recomputing it from the vertices
        has_bbox = "bbox" in self.df.columns and self.geom != "bbox"
        b = F.col("bbox") if has_bbox else G.bbox(g)
        return (self.df.select(F.struct(*keep).alias(f"{t}_k"), g.alias(f"{t}_g"), b.alias(f"{t}_b"))
                .withColumn(f"{t}_s", G.part_segments(F.col(f"{t}_g")))
                .withColumn(f"{t}_n", F.size(F.col(f"{t}_g").parts))
                .withColumn(f"{t}_p", G.is_polygonal(F.col(f"{t}_g"))))

    # bbox columns of the prepared frame
    def box(self, d=0.0):
        t = self.tag
        if self.is_point:
            x, y = F.col(f"{t}_x"), F.col(f"{t}_y")
            return x - d, y - d, x + d, y + d
        b = F.col(f"{t}_b")
        return b.minx - d, b.miny - d, b.maxx + d, b.maxy + d


#: Exponent of a box without extent.
_NO_EXTENT = -2000


def _exponent(ext: Column) -> Column:
    """Size class of an extent: about the least ``e`` with ``ext <= 2**e``.
    The set of classes is always read from the rows through this expression,
    so its rounding cannot part a row from the levels the other side uses."""
    return F.when(ext > 0, F.ceil(F.log2(ext))).otherwise(F.lit(_NO_EXTENT)).cast("int")


def _exponent_of(ext: float) -> int:
    return math.ceil(math.log2(ext)) if ext > 0 else _NO_EXTENT


def _level(exponent: Column, base: int) -> Column:
    """Grid level of a size class: 0 up to the class ``base``, then one level
    (a doubled cell) per class, without an upper limit."""
    return F.greatest(exponent - F.lit(base), F.lit(0))


def _cells(minx, miny, maxx, maxy, size, lvl) -> Column:
    cs = F.lit(size) * F.pow(F.lit(2.0), lvl)
    xs = F.sequence(F.floor(minx / cs), F.floor(maxx / cs))
    ys = F.sequence(F.floor(miny / cs), F.floor(maxy / cs))
    return F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(
        lvl.alias("lvl"), cx.alias("cx"), cy.alias("cy")))))


def extent_classes(prepared: DataFrame, side, d: float) -> dict[int, int]:
    """Number of rows per size class of one side's boxes: one aggregation over
    the bounding boxes of the current input (some tens of numbers)."""
    x0, y0, x1, y1 = side.box(d)
    e = _exponent(F.greatest(x1 - x0, y1 - y0))
    return {r["e"]: r["n"] for r in prepared.select(e.alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n")).collect()}


def _median_size(classes: dict[int, int]) -> float:
    left = sum(classes.values()) / 2
    for e in sorted(classes):
        left -= classes[e]
        if left <= 0:
            return 0.0 if e == _NO_EXTENT else 2.0 ** e
    return 0.0


def _predicate(pred: str, L: _Side, R: _Side, d: float) -> Column:
    lt, rt = L.tag, R.tag
    if pred == "bbox_intersects":
        lx0, ly0, lx1, ly1 = L.box(d)
        rx0, ry0, rx1, ry1 = R.box()
        return (lx0 <= rx1) & (rx0 <= lx1) & (ly0 <= ry1) & (ry0 <= ly1)
    if L.is_point and R.is_point:
        d2 = G.point_dist_sq(F.col(f"{lt}_x"), F.col(f"{lt}_y"), F.col(f"{rt}_x"), F.col(f"{rt}_y"))
        if pred == "dwithin":
            return d2 <= d * d
        return d2 == 0
    if L.is_point != R.is_point:
        P, E = (L, R) if L.is_point else (R, L)
        px, py = F.col(f"{P.tag}_x"), F.col(f"{P.tag}_y")
        poly, segs, nparts = F.col(f"{E.tag}_p"), F.col(f"{E.tag}_s"), F.col(f"{E.tag}_n")
        onb = G.on_boundary_segs(px, py, segs)
        ins = poly & G.inside_segs(px, py, segs, nparts)
        point_in = (pred == "within" and L.is_point) or (pred == "contains" and R.is_point)
        if point_in:
            return poly & ins & ~onb
        if pred == "intersects":
            return onb | ins
        if pred == "dwithin":
            return G.near_segs(px, py, segs, d) | ins
    if pred == "intersects" and not L.is_point and not R.is_point:
        return G.intersects_segs(F.col(f"{lt}_g"), F.col(f"{lt}_s"), F.col(f"{lt}_b"), F.col(f"{rt}_g"), F.col(f"{rt}_s"))
    lg = G.point(F.col(f"{lt}_x"), F.col(f"{lt}_y")) if L.is_point else F.col(f"{lt}_g")
    rg = G.point(F.col(f"{rt}_x"), F.col(f"{rt}_y")) if R.is_point else F.col(f"{rt}_g")
    if pred == "dwithin":
        return G.dwithin(lg, rg, d)
    if pred == "intersects":
        return G.intersects(lg, rg)
    if pred == "within":
        return G.within(lg, rg)
    if pred == "contains":
        return G.within(rg, lg)
    raise ValueError(pred)


def candidate_pairs(left: DataFrame, right: DataFrame, predicate: str = "intersects", *,
                    distance: float = 0.0, left_geom="geometry", right_geom="geometry",
                    left_cols=None, right_cols=None, cell_size: float | None = None,
                    max_span: int = 16, salt: int = 1) -> DataFrame:
    """Matched pairs as ``struct l, struct r`` (the kept columns of each side).

    Grid levels come from the size classes of the rows as they are now, so no
    pair is lost whatever ``cell_size`` is; a side of points needs no
    statistics, its boxes all have the join distance's size."""
    if predicate not in PREDICATES:
        raise ValueError(f"unknown predicate {predicate!r}")
    d = float(distance)
    L, R = _Side(left, left_geom, "l"), _Side(right, right_geom, "r")
    lkeep = [F.col(c) for c in (left_cols or left.columns)]
    rkeep = [F.col(c) for c in (right_cols or right.columns)]
    lp, rp = L.prepared(lkeep), R.prepared(rkeep)
    if L.is_point and R.is_point and d == 0.0:
        same = (F.col("l_x") == F.col("r_x")) & (F.col("l_y") == F.col("r_y"))
        return lp.join(rp, same).select(F.col("l_k").alias("l"), F.col("r_k").alias("r"))
    l_classes = {_exponent_of(2.0 * d): 1} if L.is_point else extent_classes(lp, L, d)
    r_classes = {_NO_EXTENT: 1} if R.is_point else extent_classes(rp, R, 0.0)
    if cell_size is None:
        # the typical size of the side with extent, twice the distance at least
        typical = _median_size(l_classes if R.is_point else r_classes)
        cell_size = max(2.0 * d, typical) if typical or d else 1.0
    s = float(cell_size)
    base = _exponent_of(s * max_span)

    def levels(classes):
        return sorted({max(e - base, 0) for e in classes}) or [0]
    l_levels, r_levels = levels(l_classes), levels(r_classes)

    lx0, ly0, lx1, ly1 = L.box(d)
    rx0, ry0, rx1, ry1 = R.box()

    def level_column(side, box, classes):
        if side.is_point:
            return F.lit(levels(classes)[0])
        return _level(_exponent(F.greatest(box[2] - box[0], box[3] - box[1])), base)
    lp = lp.withColumn("l_lvl", level_column(L, (lx0, ly0, lx1, ly1), l_classes))
    rp = rp.withColumn("r_lvl", level_column(R, (rx0, ry0, rx1, ry1), r_classes))

    def own(df, tag, box):
        lvl = F.col(f"{tag}_lvl")
        # explode_outer: a plain explode makes Catalyst infer a not-null /
        # non-empty filter that it pushes below the projection, recomputing
        # the geometry; a NULL cell simply never matches the equi-join
        return df.withColumn("c", F.explode_outer(_cells(*box, s, lvl)))

    def up(df, tag, box, levels, strict):
        lvl = F.col(f"{tag}_lvl")
        lv = F.array(*[F.lit(int(v)) for v in levels])
        keep = F.filter(lv, lambda v: (v > lvl) if strict else (v >= lvl))
        return df.withColumn("c", F.explode_outer(F.flatten(F.transform(keep, lambda v: _cells(*box, s, v)))))

    lbox, rbox = (lx0, ly0, lx1, ly1), (rx0, ry0, rx1, ry1)
    branches = [(own(lp, "l", lbox), up(rp, "r", rbox, l_levels, strict=False))]
    if max(r_levels) > min(l_levels):
        branches.append((up(lp, "l", lbox, r_levels, strict=True), own(rp, "r", rbox)))

    cond = _predicate(predicate, L, R, d)
    out = None
    for lside, rside in branches:
        if salt > 1:
            # by hash, so that a repeated task deals its rows out alike
            lside = lside.withColumn("salt", F.pmod(F.xxhash64("l_k"), F.lit(salt)).cast("int"))
            rside = rside.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
            keys = ["c", "salt"]
        else:
            keys = ["c"]
        j = lside.join(rside, keys)
        cs = F.lit(s) * F.pow(F.lit(2.0), F.col("c.lvl"))
        refx, refy = F.greatest(lx0, rx0), F.greatest(ly0, ry0)
        j = j.where((lx0 <= rx1) & (rx0 <= lx1) & (ly0 <= ry1) & (ry0 <= ly1)
                    & (F.floor(refx / cs) == F.col("c.cx")) & (F.floor(refy / cs) == F.col("c.cy"))
                    & cond)
        j = j.select(F.col("l_k").alias("l"), F.col("r_k").alias("r"))
        out = j if out is None else out.unionByName(j)
    return out


def sjoin(left: DataFrame, right: DataFrame, predicate: str = "intersects", how: str = "inner", *,
          distance: float = 0.0, left_geom="geometry", right_geom="geometry", left_key=None,
          right_cols=None, cell_size: float | None = None, max_span: int = 16, salt: int = 1,
          rsuffix: str = "_right") -> DataFrame:
    """Spatial join.

    how: ``inner`` | ``left`` | ``semi`` | ``anti``.  ``left``/``semi``/``anti``
    need ``left_key`` (unique column(s) of ``left``): the candidate pipeline
    then carries only the key, and the result is a plain key join back.
    ``left_geom``/``right_geom`` are a geometry column name or an ``(x, y)``
    pair of point columns (faster, no geometry struct).
    """
    if how == "inner":
        rcols = right_cols or right.columns
        pairs = candidate_pairs(left, right, predicate, distance=distance, left_geom=left_geom,
                                right_geom=right_geom, right_cols=rcols, cell_size=cell_size,
                                max_span=max_span, salt=salt)
        lnames = set(left.columns)
        rsel = [F.col(f"r.{c}").alias(c + rsuffix if c in lnames else c) for c in rcols]
        return pairs.select("l.*", *rsel)
    keys = [left_key] if isinstance(left_key, str) else list(left_key or [])
    if not keys:
        raise ValueError("how=%r needs left_key" % how)
    lg = list(left_geom) if isinstance(left_geom, (tuple, list)) else [left_geom]
    rcols = right_cols or ([] if how in ("semi", "anti") else right.columns)
    rg = list(right_geom) if isinstance(right_geom, (tuple, list)) else [right_geom]

    def matches(l, r):
        return candidate_pairs(l, r, predicate, distance=distance, left_geom=left_geom, right_geom=right_geom, left_cols=keys,
                               right_cols=rcols or rg, cell_size=cell_size, max_span=max_span, salt=salt)

    def keys_of(pairs):
        return pairs.select(*[F.col(f"l.{k}").alias(k) for k in keys])
    small = left.select(*dict.fromkeys(keys + lg))
    if how in ("semi", "anti") and predicate == "dwithin":
        # one match is enough: rows that have one in a share of the right side
        # are not compared with the rest of it, which may hold very many more
        share = F.pmod(F.xxhash64(*rg), F.lit(FIRST_SHARE)) == 0
        first = stored(keys_of(matches(small, right.where(share))).distinct())
        matched_keys = first.unionByName(keys_of(matches(small.join(first, keys, "left_anti"), right.where(~share))))
    else:
        pairs = matches(small, right)
        matched_keys = keys_of(pairs)
    if how == "semi":
        return left.join(matched_keys, keys, "left_semi")
    if how == "anti":
        return left.join(matched_keys, keys, "left_anti")
    if how == "left":
        lnames = set(left.columns)
        rsel = [F.col(f"r.{c}").alias(c + rsuffix if c in lnames else c) for c in rcols]
        m = pairs.select(*[F.col(f"l.{k}").alias(k) for k in keys], *rsel)
        return left.join(m, keys, "left")
    raise ValueError(how)

