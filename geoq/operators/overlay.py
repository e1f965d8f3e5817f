"""Polygon overlay areas (D9, UC4.3): a sweep over square tiles.

Every ring is taken with its inside on the left, so the coverage at a point is
a sum of signed crossings to its left, one sum per role; a rule over the sums
(union, difference, ...) says which area counts.

* Edges are clipped to the tiles they pass.  Equal edges are added up first, so
  repeated polygons and shared borders cost nothing.
* The coverage on a tile's left border changes only where an edge crosses that
  border.  What holds at its lower end is carried in: a prefix sum, along the
  row of tiles, of the edges that cross the row's lower line.  A tile thus knows
  all that lies to its left from one number a role and its own crossings.
* Runs of tiles without an edge between two others have one coverage and are
  added as a whole; tiles with edges are swept on their own, all in parallel.
* Tiles that hold many edges are cut again, by the same step, with the coverage
  on their left border as input.

Rows are linear in the edges: tile sides are no shorter than the mean edge.
Whether an edge passes a tile's corner on the left or right is decided by one
sign for both lines through the corner, so that rounding cannot make prefix
sums and border crossings disagree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoq.functions import geometry as G
from geoq.session import cut_lineage

#: Mean edges a tile is meant to hold; pieces above which a tile is cut again,
#: into CUT x CUT, at most DEPTH times; slabs that are swept at once.
PER_TILE, DENSE, CUT, DEPTH, STRIP = 8, 192, 8, 10, 64

_EDGE, _STEP, _CROSS = 0, 1, 2
_COLUMNS = ["pr", "pc", "r", "c", "role", "kind", "ax", "ay", "bx", "by", "lo", "hi", "w"]
_SQL = ("pr bigint, pc bigint, r bigint, c bigint, role int, kind int, ax double, ay double, bx double, by double, "
        "lo double, hi double, w double")
_ARROW = pa.schema([(n, pa.int64()) for n in _COLUMNS[:4]] + [("role", pa.int32()), ("kind", pa.int32())]
                   + [(n, pa.float64()) for n in _COLUMNS[6:]])


def polygon_edges(df: DataFrame, role: int = 0, geom: str = "geometry") -> DataFrame:
    """Ring edges of polygonal rows: (role, ax, ay, bx, by, w).  ``w`` is 1
    where the edge as given has the polygon's inside on its left (a shell
    against the clock, a hole with it), else -1; equal edges are added up."""
    g = F.col(geom)
    edges = F.flatten(F.transform(g.parts, lambda p: F.flatten(F.transform(p, lambda r, ri: F.transform(
        F.array(F.signum(G.ring_twice_area(r)) * F.when(ri == 0, 1.0).otherwise(-1.0)), lambda turn: F.transform(
            G._idx(r), lambda i: F.struct(r[i].x.alias("ax"), r[i].y.alias("ay"), r[i + 1].x.alias("bx"),
                                         r[i + 1].y.alias("by"), turn.alias("w"))))[0]))))
    e = df.where(G.is_polygonal(g)).select(F.inline_outer(edges))
    back = F.struct("bx", "by") < F.struct("ax", "ay")

    def end(a, b):
        return F.when(back, F.col(b)).otherwise(F.col(a)).alias(a)
    e = e.select(end("ax", "bx"), end("ay", "by"), end("bx", "ax"), end("by", "ay"), F.when(back, -F.col("w")).otherwise(F.col("w")).alias("w"))
    return (e.groupBy("ax", "ay", "bx", "by").agg(F.sum("w").alias("w")).where("w <> 0 and (ax <> bx or ay <> by)")
            .select(F.lit(role).alias("role"), "ax", "ay", "bx", "by", "w"))


class Grid:
    """Tiles of side ``s`` from (x0, y0); a region is ``nx`` by ``ny`` of them."""

    def __init__(self, x0: float, y0: float, s: float, nx: int, ny: int):
        self.x0, self.y0, self.s, self.nx, self.ny = x0, y0, s, nx, ny

    def finer(self) -> "Grid":
        return Grid(self.x0, self.y0, self.s / CUT, CUT, CUT)

    def x(self, c):
        return self.x0 + c * self.s

    def y(self, r):
        return self.y0 + r * self.s

    def _cell(self, v, at):
        """Tile whose open lower and closed upper line hold v."""
        k = np.ceil((v - at(0)) / self.s).astype(np.int64) - 1
        k -= at(k) >= v
        return k + (at(k + 1) < v)

    def col(self, x):
        return self._cell(x, self.x)

    def row(self, y):
        return self._cell(y, self.y)


class _Edges:
    """Edges as arrays, with the one predicate about tile corners."""

    def __init__(self, ax, ay, bx, by, grid: Grid):
        self.ax, self.ay, self.bx, self.by, self.g = ax, ay, bx, by, grid
        self.dx, self.dy = bx - ax, by - ay

    def take(self, i) -> "_Edges":
        return _Edges(self.ax[i], self.ay[i], self.bx[i], self.by[i], self.g)

    def _right_of_corner(self, c, r):
        """The corner, moved a little up and much less right, lies on the
        edge's left (sign > 0)."""
        o = self.dx * (self.g.y(r) - self.ay) - self.dy * (self.g.x(c) - self.ax)
        return np.where(o != 0, o, np.where(self.dx != 0, self.dx, -self.dy)) > 0

    def crossing_of_column(self, c):
        """(height, row) at which each edge crosses the line left of column c."""
        def above(r):
            return self._right_of_corner(c, r) != (self.dx > 0)
        y = self.ay + (self.g.x(c) - self.ax) * (self.dy / self.dx)
        r = np.floor((y - self.g.y0) / self.g.s).astype(np.int64)
        r -= ~above(r)
        r += above(r + 1)
        return np.clip(y, self.g.y(r), self.g.y(r + 1)), r

    def crossing_of_row(self, r):
        """Column in which each edge crosses the line below row r."""
        def right(c):
            return self._right_of_corner(c, r) == (self.dy > 0)
        x = self.ax + (self.g.y(r) - self.ay) * (self.dx / self.dy)
        c = np.floor((x - self.g.x0) / self.g.s).astype(np.int64)
        c -= ~right(c)
        return c + right(c + 1)


def _ranges(first, last):
    """Index of the row and value, for every value of first..last per row."""
    n = np.maximum(last - first + 1, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def split_edges(t: dict, grid: Grid) -> list[dict]:
    """Edges and steps of regions, cut to the regions' tiles: pieces, steps of
    the coverage on tiles' left borders, and crossings of tiles' lower lines."""
    out = []

    def put(i, kind, r, c, lo, hi, w):
        nan = np.full(len(i), np.nan)
        out.append({"pr": t["pr"][i], "pc": t["pc"][i], "r": r, "c": c, "role": t["role"][i], "kind": np.full(len(i), kind, np.int32),
                    **({k: t[k][i] for k in ("ax", "ay", "bx", "by")} if kind != _CROSS else {k: nan for k in ("ax", "ay", "bx", "by")}),
                    "lo": lo if lo is not None else nan, "hi": hi if hi is not None else nan, "w": w})

    e = np.flatnonzero(t["kind"] == _EDGE)
    c_first, r_first = t["pc"] * grid.nx, t["pr"] * grid.ny
    c_last, r_last = c_first + grid.nx - 1, r_first + grid.ny - 1
    edges = _Edges(t["ax"], t["ay"], t["bx"], t["by"], grid)
    all_e = edges.take(e)
    ca, cb, ra, rb = grid.col(all_e.ax), grid.col(all_e.bx), grid.row(all_e.ay), grid.row(all_e.by)
    cmin, cmax = np.minimum(ca, cb), np.maximum(ca, cb)

    # lines left of columns that an edge crosses: steps
    k, c = _ranges(np.maximum(cmin + 1, c_first[e] + 1), np.minimum(cmax, c_last[e]))
    i = e[k]
    y, r = edges.take(i).crossing_of_column(c)
    ok = (r >= r_first[i]) & (r <= r_last[i])
    put(i[ok], _STEP, r[ok], c[ok], y[ok], None, (t["w"][i] * np.sign(edges.dx[i]))[ok])

    # lines below rows that an edge crosses
    k, r = _ranges(np.maximum(np.minimum(ra, rb) + 1, r_first[e]), np.minimum(np.maximum(ra, rb), r_last[e]))
    i = e[k]
    c = edges.take(i).crossing_of_row(r)
    ok = (c >= c_first[i]) & (c <= c_last[i])
    put(i[ok], _CROSS, r[ok], c[ok], None, None, (-t["w"][i] * np.sign(edges.dy[i]))[ok])

    # pieces: per column the heights and rows of its two lines, then per row;
    # level ones have no height, but count when the tile is cut again
    k, c = _ranges(np.maximum(cmin, c_first[e]), np.minimum(cmax, c_last[e]))
    i = e[k]
    part = edges.take(i)
    ends = []
    for line, crossed, a_first in ((c, c > cmin[k], ca[k] <= cb[k]), (c + 1, c < cmax[k], ca[k] > cb[k])):
        y, row = np.where(a_first, part.ay, part.by), np.where(a_first, ra[k], rb[k])
        at = np.flatnonzero(crossed)
        y[at], row[at] = part.take(at).crossing_of_column(line[at])
        ends.append((y, row))
    (y1, r1), (y2, r2) = ends
    lo, hi = np.minimum(y1, y2), np.maximum(y1, y2)
    k, r = _ranges(np.maximum(np.minimum(r1, r2), r_first[i]), np.minimum(np.maximum(r1, r2), r_last[i]))
    lo, hi = np.maximum(lo[k], grid.y(r)), np.minimum(hi[k], grid.y(r + 1))
    put(i[k], _EDGE, r, c[k], lo, hi, t["w"][i[k]])

    # steps on the region's own left border; without an edge: from its lower end
    s = np.flatnonzero(t["kind"] == _STEP)
    by_edge = ~np.isnan(t["ax"][s])
    height, row = t["lo"][s].copy(), r_first[s] - 1
    if by_edge.any():
        height[by_edge], row[by_edge] = edges.take(s[by_edge]).crossing_of_column(c_first[s[by_edge]])
    put(s[by_edge], _STEP, row[by_edge], c_first[s[by_edge]], height[by_edge], None, t["w"][s[by_edge]])
    k, r = _ranges(row + 1, r_last[s])
    put(s[k], _CROSS, r, c_first[s[k]] - 1, None, None, t["w"][s[k]])
    return out


def _split(rows: DataFrame, grid: Grid) -> DataFrame:
    def split(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                some = batch.slice(first, 4096)
                t = {n: some.column(n).to_numpy(zero_copy_only=False) for n in some.schema.names}
                for part in split_edges(t, grid):
                    if len(part["r"]):
                        yield pa.RecordBatch.from_arrays([pa.array(part[n], f.type) for n, f in zip(_COLUMNS, _ARROW)], schema=_ARROW)
    return rows.mapInArrow(split, _SQL)


def sweep_tile(t: dict, x0: float, x1: float, y0: float, y1: float, rule, roles) -> float:
    """Area of one tile where the rule holds: slabs between all heights at
    which pieces begin, end, cross each other or the left border changes."""
    e, s = (t["kind"] == _EDGE) & (t["hi"] > t["lo"]), t["kind"] == _STEP
    lo, hi, role = t["lo"][e], t["hi"][e], t["role"][e]
    w = -t["w"][e] * np.sign(t["by"][e] - t["ay"][e])  # change of coverage, left to right
    slope = (t["bx"][e] - t["ax"][e]) / (t["by"][e] - t["ay"][e])
    ax, ay = t["ax"][e], t["ay"][e]

    def at(i, y):
        return np.clip(ax[i] + (y - ay[i]) * slope[i], x0, x1)
    cuts = [lo, hi, t["lo"][s], np.array([y0, y1])]
    if len(lo) > 1:
        i, j = np.triu_indices(len(lo), 1)
        low, high = np.maximum(lo[i], lo[j]), np.minimum(hi[i], hi[j])
        ok = low < high
        i, j, low, high = i[ok], j[ok], low[ok], high[ok]
        d0, d1 = at(i, low) - at(j, low), at(i, high) - at(j, high)
        ok = d0 * d1 < 0
        cuts.append(low[ok] + (high - low)[ok] * d0[ok] / (d0 - d1)[ok])
    cuts = np.unique(np.clip(np.concatenate(cuts), y0, y1))
    height, middle = np.diff(cuts), (cuts[1:] + cuts[:-1]) / 2
    step_y, step_w, step_role = t["lo"][s], t["w"][s], t["role"][s]
    area = 0.0
    for first in range(0, len(middle), STRIP):
        ym, h = middle[first:first + STRIP], height[first:first + STRIP]
        here = np.flatnonzero((lo < ym[-1]) & (hi > ym[0]))
        on = (lo[here, None] < ym) & (hi[here, None] > ym)
        xs = np.where(on, np.clip(ax[here, None] + (ym - ay[here, None]) * slope[here, None], x0, x1), np.inf)
        order = np.argsort(xs, axis=0, kind="stable")
        xs = np.minimum(np.take_along_axis(xs, order, 0), x1)
        counts = {}
        for k, name in enumerate(roles):
            left = ((step_y[:, None] < ym) * np.where(step_role == k, step_w, 0.0)[:, None]).sum(0)
            own = np.take_along_axis(np.where(on & (role[here] == k)[:, None], w[here, None], 0.0), order, 0)
            counts[name] = np.rint(np.concatenate([left[None], left + np.cumsum(own, 0)]))
        edge = np.full((1, len(ym)), x0), np.full((1, len(ym)), x1)
        widths = np.diff(np.concatenate([edge[0], xs, edge[1]]), axis=0)
        area += float((np.where(rule(counts), widths, 0.0) * h).sum())
    return area


def _swept(rows: DataFrame, grid: Grid, rule, roles) -> DataFrame:
    def swept(batches):
        held = None
        total = 0.0

        def tiles(t, final):
            """Sweeps all tiles but the last, which may go on."""
            nonlocal total, held
            starts = np.flatnonzero(np.concatenate(([True], (t["r"][1:] != t["r"][:-1]) | (t["c"][1:] != t["c"][:-1]))))
            ends = np.append(starts[1:], len(t["r"]))
            for a, b in zip(starts[:len(starts) if final else -1], ends):
                c, r = int(t["c"][a]), int(t["r"][a])
                total += sweep_tile({n: v[a:b] for n, v in t.items()}, grid.x(c), grid.x(c + 1), grid.y(r), grid.y(r + 1), rule, roles)
            held = None if final else {n: v[starts[-1]:] for n, v in t.items()}

        for batch in batches:
            t = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            if held:
                t = {n: np.concatenate([held[n], t[n]]) for n in t}
            if len(t["r"]):
                tiles(t, False)
        if held:
            tiles(held, True)
        yield pa.RecordBatch.from_pydict({"area": pa.array([total])})
    return rows.repartition("r", "c").sortWithinPartitions("r", "c").mapInArrow(swept, "area double")


def coverage_area(edges: DataFrame, rule, roles=("P",), tile: float | None = None) -> DataFrame:
    """Area where ``rule(counts)`` holds; ``counts`` maps each role's name to
    the number of its polygons over a place.  ``edges`` as of
    ``polygon_edges``, whose role is the place of the name in ``roles``.
    One row ``area``; NULL without edges."""
    spark = edges.sparkSession
    edges = cut_lineage(edges)
    st = edges.agg(F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"),
                   F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1"),
                   F.count(F.lit(1)).alias("n"), F.avg(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("mean")).first()
    if not st["n"]:
        return spark.range(1).select(F.lit(None).cast("double").alias("area"))
    width, height = st["x1"] - st["x0"], st["y1"] - st["y0"]
    s = tile or max((PER_TILE * width * height / st["n"]) ** 0.5, st["mean"], 1e-12 * max(abs(v) for v in (st["x0"], st["x1"], st["y0"], st["y1"])))
    # lines between round numbers, where vertices seldom lie
    grid = Grid(st["x0"] - 0.381966 * s, st["y0"] - 0.618034 * s, s, int(width / s) + 3, int(height / s) + 3)
    rows = edges.select(F.lit(0).cast("bigint").alias("pr"), F.lit(0).cast("bigint").alias("pc"), F.lit(0).cast("bigint").alias("r"),
                        F.lit(0).cast("bigint").alias("c"), F.col("role").cast("int").alias("role"), F.lit(_EDGE).alias("kind"), "ax", "ay", "bx", "by",
                        F.least("ay", "by").alias("lo"), F.greatest("ay", "by").alias("hi"), F.col("w").cast("double").alias("w"))
    areas = None
    for depth in range(DEPTH + 1):
        parts = cut_lineage(_split(rows, grid))
        sums = [F.sum(F.when((F.col("kind") == _CROSS) & (F.col("role") == k), F.col("w")).otherwise(0.0)).alias(f"w{k}") for k in range(len(roles))]
        tiles = parts.groupBy("pr", "pc", "r", "c").agg(F.count(F.when(F.col("kind") != _CROSS, 1)).alias("n"), *sums)
        row = Window.partitionBy("pr", "pc", "r").orderBy("c")
        upto = row.rowsBetween(Window.unboundedPreceding, 0)
        tiles = tiles.select("*", F.lead("c").over(row).alias("next"), *[F.sum(f"w{k}").over(upto).alias(f"after{k}") for k in range(len(roles))])
        after = {name: F.round(F.col(f"after{k}")) for k, name in enumerate(roles)}
        before = {name: F.round(F.col(f"after{k}") - F.col(f"w{k}")) for k, name in enumerate(roles)}
        first = F.col("pc") * grid.nx
        run = F.coalesce(F.col("next"), first + grid.nx) - F.col("c") - 1
        whole = F.when(rule(after), run).otherwise(0) + F.when((F.col("n") == 0) & (F.col("c") >= first) & rule(before), 1).otherwise(0)
        empty = tiles.select((whole * (grid.s * grid.s)).cast("double").alias("area"))
        corners = [tiles.where(F.col("n") > 0).select(
            "pr", "pc", "r", "c", F.lit(k).alias("role"), F.lit(_STEP).alias("kind"), *[F.lit(float("nan")).alias(n) for n in ("ax", "ay", "bx", "by")],
            (F.lit(grid.y0) + F.col("r") * grid.s).alias("lo"), F.lit(float("nan")).alias("hi"), before[name].alias("w")).where("w <> 0")
            for k, name in enumerate(roles)]
        here = parts.where(F.col("kind") != _CROSS)
        for more in corners:
            here = here.unionByName(more)
        dense = tiles.where(F.col("n") > DENSE).select("pr", "pc", "r", "c")
        if depth == DEPTH or dense.isEmpty():
            swept = _swept(here, grid, rule, roles)
            areas = empty.unionByName(swept) if areas is None else areas.unionByName(empty).unionByName(swept)
            break
        keys = ["pr", "pc", "r", "c"]
        swept = empty.unionByName(_swept(here.join(dense, keys, "left_anti"), grid, rule, roles))
        areas = swept if areas is None else areas.unionByName(swept)
        rows = here.join(dense, keys, "left_semi").withColumn("pr", F.col("r")).withColumn("pc", F.col("c")).select(*_COLUMNS)
        grid = grid.finer()
    return areas.agg(F.sum("area").alias("area"))


def union_area(df: DataFrame, key: str = "id", geom: str = "geometry", tile: float | None = None) -> DataFrame:
    """Area of the union of polygons (ST_Union_Agg + ST_Area)."""
    return coverage_area(polygon_edges(df, 0, geom), lambda n: n["P"] > 0, ("P",), tile)


def difference_area(boundary: DataFrame, others: DataFrame, key: str = "id", geom: str = "geometry",
                    tile: float | None = None) -> DataFrame:
    """UC4.3: area of ``boundary - union(others)`` (ST_Difference + ST_Area).
    ``others`` beyond the boundary's extent (one row) are left out first."""
    b = G.bbox(F.col(geom))
    e = boundary.select(b.alias("b")).agg(*[f(f"b.{n}").alias(n) for f, n in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"))]).first()
    if e["minx"] is None:
        return coverage_area(polygon_edges(boundary, 0, geom), lambda n: n["B"] > 0, ("B",), tile)
    near = others.select(geom, b.alias("_b")).where(
        (F.col("_b.minx") <= e["maxx"]) & (F.col("_b.maxx") >= e["minx"]) & (F.col("_b.miny") <= e["maxy"]) & (F.col("_b.maxy") >= e["miny"]))
    edges = polygon_edges(boundary, 0, geom).unionByName(polygon_edges(near, 1, geom))
    return coverage_area(edges, lambda n: (n["B"] > 0) & (n["P"] == 0), ("B", "P"), tile)
