"""Buffer geometry and buffer areas (H12, UC3.2).

Round joins follow the usual offset-curve discretisation: a corner that
turns by angle t on the outer side is filled with a fan of
``n = max(1, int(t / (pi / 2 / quad_segs) + 0.5))`` equal segments.

* A point's buffer is a constant; that of a *convex* polygon has a closed
  form -- area + r * perimeter + sum of fan areas -- evaluated in Catalyst.
* Other geometries go through ``buffer_area_udf``: an Arrow (pandas) UDF that
  builds the pieces (polygon, edge rectangles, corner fans, end caps) and
  measures their union with a vectorised slab sweep, one geometry per row.
Repeated vertices are dropped first; an empty or null geometry has no area.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoq.functions import geometry as G


def _fan_area(theta: Column, r: float, q: int) -> Column:
    quantum = math.pi / 2.0 / q
    n = F.greatest(F.floor(theta / quantum + 0.5), F.lit(1)).cast("double")
    return n * 0.5 * r * r * F.sin(theta / n)


def _without_repeats(ring) -> Column:
    return F.transform(F.array(ring), lambda r: F.filter(
        r, lambda v, i: (i == 0) | (F.get(r, i - 1).x != v.x) | (F.get(r, i - 1).y != v.y)))[0]


@G.bind(0)
def _ring_turns(ring) -> Column:
    """Exterior turning angle at every vertex of a closed ring (signed)."""
    n = F.size(ring) - 1  # closed: last == first

    def at(i):
        a = ring[(i + n - 1) % n]
        b = ring[i]
        c = ring[(i + 1) % n]
        e1x, e1y = b.x - a.x, b.y - a.y
        e2x, e2y = c.x - b.x, c.y - b.y
        return F.atan2(e1x * e2y - e1y * e2x, e1x * e2x + e1y * e2y)
    return F.transform(F.sequence(F.lit(0), n - 1), at)


@G.bind(0)
def is_convex(g) -> Column:
    """Single-part polygon without holes whose turns all have one sign and
    make one full turn (a star turns one way too, but twice)."""
    g = G._c(g)

    def convex(ring):
        def of(turns):
            total = F.abs(F.aggregate(turns, F.lit(0.0), lambda a, t: a + t))
            return (F.forall(turns, lambda t: t >= 0) | F.forall(turns, lambda t: t <= 0)) & (total < 3 * math.pi)
        return (F.size(ring) >= 4) & F.transform(F.array(_ring_turns(ring)), of)[0]
    one = (g.gtype == "POLYGON") & (F.size(g.parts) == 1) & (F.size(F.get(g.parts, F.lit(0))) == 1)
    return F.coalesce(F.when(one, F.transform(F.array(_without_repeats(g.parts[0][0])), convex)[0]), F.lit(False))


@G.bind(0)
def buffer_area_convex(g, r: float, quad_segs: int = 8) -> Column:
    """Exact area of the discretised buffer of a convex polygon."""
    g = G._c(g)
    fans = F.aggregate(F.transform(_ring_turns(_without_repeats(g.parts[0][0])), lambda t: _fan_area(F.abs(t), r, quad_segs)),
                       F.lit(0.0), lambda a, b: a + b)
    return G.area(g) + F.lit(r) * G.perimeter(g) + fans


def point_buffer_area(r: float, quad_segs: int = 8) -> float:
    return 2.0 * quad_segs * r * r * math.sin(math.pi / (2.0 * quad_segs))


# ---------------------------------------------------------------- general kernel (numpy)

def _vertices_of(ring, closed: bool) -> np.ndarray:
    """Without repeated vertices; a ring ends where it starts."""
    pts = np.asarray(ring, dtype=float).reshape(-1, 2)
    if len(pts):
        pts = pts[np.r_[True, (pts[1:] != pts[:-1]).any(axis=1)]]
    if closed and len(pts) > 1 and (pts[0] != pts[-1]).any():
        pts = np.vstack([pts, pts[:1]])
    return pts


def _fan(centre, r: float, start: float, angle: float, n: int) -> np.ndarray:
    """Segments of the fan of ``n`` equal triangles around ``centre``."""
    arc = centre + r * np.column_stack([np.cos(start + angle * np.arange(n + 1) / n), np.sin(start + angle * np.arange(n + 1) / n)])
    ring = np.vstack([centre, arc, centre])
    return np.column_stack([ring[:-1], ring[1:]])


def _pieces(rings, r, q, closed=True):
    """Segments (x0, y0, x1, y1, piece) of the polygon (of closed rings), its
    edges' rectangles, the fans at its corners, and caps where a line ends."""
    quantum = math.pi / 2.0 / q
    rings = [p for p in (_vertices_of(ring, closed) for ring in rings) if len(p)]
    body = [np.column_stack([p[:-1], p[1:]]) for p in rings if closed and len(p) > 1]
    pieces = [np.vstack(body)] if body else []
    for pts in rings:
        if len(pts) == 1:  # a point, or a line without length
            pieces.append(_fan(pts[0], r, 0.0, 2 * math.pi, 4 * q))
            continue
        edges = np.diff(pts, axis=0)
        unit = edges / np.hypot(edges[:, 0], edges[:, 1])[:, None]
        normal = np.column_stack([-unit[:, 1], unit[:, 0]])
        for a, b, n in zip(pts[:-1], pts[1:], normal * r):
            quad = np.array([a + n, b + n, b - n, a - n, a + n])
            pieces.append(np.column_stack([quad[:-1], quad[1:]]))
        m = len(edges)
        for i in range(0 if closed else 1, m):  # corners, each after edge i - 1
            e, f = unit[i - 1], unit[i]
            turn = math.atan2(e[0] * f[1] - e[1] * f[0], e @ f)
            if turn:
                # the gap is on the outer side; normals turn with the edges
                n = normal[i - 1] * (-1.0 if turn > 0 else 1.0)
                pieces.append(_fan(pts[i], r, math.atan2(n[1], n[0]), turn, max(1, int(abs(turn) / quantum + 0.5))))
        if not closed:
            first, last = normal[0], -normal[-1]
            pieces.append(_fan(pts[0], r, math.atan2(first[1], first[0]), math.pi, 2 * q))
            pieces.append(_fan(pts[-1], r, math.atan2(last[1], last[0]), math.pi, 2 * q))
    return np.vstack([np.column_stack([p, np.full(len(p), k)]) for k, p in enumerate(pieces)]) if pieces else np.zeros((0, 5))


def _crossing_ordinates(x0, y0, x1, y1, at_once=2_000_000):
    """Ordinates of proper crossings of segments, which are sorted by their
    lower ends so that only those that overlap in y are paired, in blocks."""
    low, high = np.minimum(y0, y1), np.maximum(y0, y1)
    order = np.argsort(low)
    x0, y0, x1, y1, low, high = (v[order] for v in (x0, y0, x1, y1, low, high))
    dx, dy, out = x1 - x0, y1 - y0, []
    many = np.searchsorted(low, high, "right") - np.arange(len(low)) - 1  # that start below each one's upper end
    at = 0
    while at < len(low):
        stop = at + max(1, int(np.searchsorted(np.cumsum(many[at:]), at_once, "right")))
        n = many[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        den = dx[i] * dy[j] - dy[i] * dx[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((x0[j] - x0[i]) * dy[j] - (y0[j] - y0[i]) * dx[j]) / den
            u = ((x0[j] - x0[i]) * dy[i] - (y0[j] - y0[i]) * dx[i]) / den
        ok = (den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        out.append((y0[i] + t * dy[i])[ok])
        at = stop
    return np.concatenate(out) if out else np.zeros(0)


def _union_area(S):
    """Area of the union of closed pieces given as segments (even-odd per piece)."""
    S = S[S[:, 1] != S[:, 3]]
    if len(S) == 0:
        return 0.0
    x0, y0, x1, y1, pc = S.T
    dx, dy = x1 - x0, y1 - y0
    br = np.unique(np.concatenate([y0, y1, _crossing_ordinates(x0, y0, x1, y1)]))
    lo, hi = br[:-1], br[1:]
    ym = (lo + hi) / 2.0
    # each segment's ends are among the slab limits: its slabs are a range
    first_slab = np.searchsorted(lo, np.minimum(y0, y1))
    slabs = np.searchsorted(hi, np.maximum(y0, y1)) + 1 - first_slab
    gi = np.repeat(np.arange(len(y0)), slabs)
    si = first_slab[gi] + np.arange(len(gi)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    xm = x0[gi] + (ym[si] - y0[gi]) * dx[gi] / dy[gi]
    piece = pc[gi]
    # rank within (slab, piece) by x -> enter/exit
    o = np.lexsort((xm, piece, si))
    si, xm, piece = si[o], xm[o], piece[o]
    grp_start = np.r_[True, (si[1:] != si[:-1]) | (piece[1:] != piece[:-1])]
    idx = np.arange(len(si))
    first = np.maximum.accumulate(np.where(grp_start, idx, 0))
    d = np.where((idx - first) % 2 == 0, 1, -1)
    o2 = np.lexsort((xm, si))
    si, xm, d = si[o2], xm[o2], d[o2]
    cs = np.cumsum(d)
    slab_start = np.r_[True, si[1:] != si[:-1]]
    base = np.maximum.accumulate(np.where(slab_start, idx, 0))
    before = np.where(base > 0, cs[base - 1], 0)
    cnt = cs - before
    same = np.r_[si[1:] == si[:-1], False]
    nxt = np.r_[xm[1:], 0.0]
    w = np.where(same & (cnt > 0), nxt - xm, 0.0)
    return float(np.sum(w * (hi - lo)[si]))


def buffer_area_of_rings(rings_per_part, r: float, q: int = 8, closed: bool = True) -> float:
    """Union area of the buffers of all parts (list of list of rings, or of
    lines and points where not ``closed``)."""
    allsegs = [s for s in (_pieces(p, r, q, closed) for p in rings_per_part if len(p)) if len(s)]
    if not allsegs:
        return 0.0
    offs, S = 0, []
    for s in allsegs:
        s = s.copy()
        s[:, 4] += offs
        offs = s[:, 4].max() + 1
        S.append(s)
    return _union_area(np.vstack(S))


def _unflatten(xs, ys, rsize, rpart):
    parts, off = {}, 0
    for n, p in zip(rsize, rpart):
        parts.setdefault(int(p), []).append(np.column_stack([xs[off:off + n], ys[off:off + n]]))
        off += n
    return [parts[k] for k in sorted(parts)]


def buffer_area_udf(r: float, quad_segs: int = 8):
    @F.pandas_udf(T.DoubleType())
    def _area(gtype: pd.Series, xs: pd.Series, ys: pd.Series, rsize: pd.Series, rpart: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or a is None else
                          buffer_area_of_rings(_unflatten(a, b, c, d), r, quad_segs, t in ("POLYGON", "MULTIPOLYGON"))
                          for t, a, b, c, d in zip(gtype, xs, ys, rsize, rpart)], dtype="float64")
    return _area


def with_buffer_area(df: DataFrame, geom: str, r: float, quad_segs: int = 8, name: str = "buffer_area") -> DataFrame:
    """Adds the buffer area column: points and convex polygons in Catalyst,
    the rest through the Arrow UDF (the row sets are split, not branched, so
    the UDF only sees the rows that need it).  A null geometry has a null
    area."""
    kind = (F.when(F.col(geom).isNull(), "null").when(F.col(geom).gtype == "POINT", "point")
            .when(is_convex(geom), "convex").otherwise("other"))
    cols, kind_col = df.columns, "_buffer_kind"
    kinds = df.withColumn(kind_col, kind)
    none = kinds.where(F.col(kind_col) == "null").select(*cols, F.lit(None).cast("double").alias(name))
    points = kinds.where(F.col(kind_col) == "point").select(*cols, F.lit(point_buffer_area(r, quad_segs)).alias(name))
    fast = kinds.where(F.col(kind_col) == "convex").select(*cols, buffer_area_convex(geom, r, quad_segs).alias(name))
    flat = kinds.where(F.col(kind_col) == "other").select(*cols, G.to_flat(geom).alias("_f")).select(
        *cols, "_f.gtype", "_f.xs", "_f.ys", "_f.rsize", "_f.rpart")
    slow = flat.select(*cols, buffer_area_udf(r, quad_segs)("gtype", "xs", "ys", "rsize", "rpart").alias(name))
    return fast.unionByName(points).unionByName(none).unionByName(slow)


# ---------------------------------------------------------------- simplification

def _dp(pts: np.ndarray, tol: float) -> np.ndarray:
    """Douglas-Peucker on one line/ring (end points kept), iterative."""
    n = len(pts)
    if n <= 2:
        return pts
    keep = np.zeros(n, dtype=bool)
    keep[0] = keep[-1] = True
    stack = [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        if b <= a + 1:
            continue
        p, q = pts[a], pts[b]
        seg = q - p
        ll = float(seg @ seg)
        mid = pts[a + 1:b]
        if ll == 0:
            d = np.hypot(*(mid - p).T)
        else:
            d = np.abs(seg[0] * (mid[:, 1] - p[1]) - seg[1] * (mid[:, 0] - p[0])) / math.sqrt(ll)
        k = int(np.argmax(d))
        if d[k] > tol:
            keep[a + 1 + k] = True
            stack.append((a, a + 1 + k))
            stack.append((a + 1 + k, b))
    return pts[keep]


def simplify_udf(tol: float):
    @F.pandas_udf(T.StructType([T.StructField("xs", T.ArrayType(T.DoubleType())),
                                T.StructField("ys", T.ArrayType(T.DoubleType())),
                                T.StructField("rsize", T.ArrayType(T.IntegerType()))]))
    def _simp(xs: pd.Series, ys: pd.Series, rsize: pd.Series) -> pd.DataFrame:
        ox, oy, osz = [], [], []
        for a, b, sizes in zip(xs, ys, rsize):
            off, rx, ry, rs = 0, [], [], []
            for n in sizes:
                r = _dp(np.column_stack([a[off:off + n], b[off:off + n]]), tol)
                rx.extend(r[:, 0].tolist())
                ry.extend(r[:, 1].tolist())
                rs.append(len(r))
                off += n
            ox.append(rx), oy.append(ry), osz.append(rs)
        return pd.DataFrame({"xs": ox, "ys": oy, "rsize": osz})
    return _simp


def with_simplified(df: DataFrame, geom: str, tol: float, out: str = "simplified") -> DataFrame:
    """ST_Simplify (Douglas-Peucker per ring/line, end points kept) as a
    new column; the Arrow UDF sees flat coordinate arrays only."""
    cols = df.columns
    flat = df.select(*cols, G.to_flat(geom).alias("_f"))
    s = flat.select(*cols, "_f", simplify_udf(tol)("_f.xs", "_f.ys", "_f.rsize").alias("_s"))
    rs = F.col("_s.rsize")
    offs = F.transform(rs, lambda n, i: F.aggregate(F.slice(rs, 1, i), F.lit(0), lambda a, b: a + b))
    f2 = F.struct(F.col("_f.gtype").alias("gtype"), F.col("_s.xs").alias("xs"), F.col("_s.ys").alias("ys"),
                  offs.alias("roff"), F.col("_s.rsize").alias("rsize"), F.col("_f.rpart").alias("rpart"))
    return s.select(*cols, f2.alias("_f2")).select(*cols, G.from_flat(F.col("_f2")).alias(out))
