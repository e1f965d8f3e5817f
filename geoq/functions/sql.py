"""SQL-callable names (N1): ``register(spark)`` defines temporary SQL
functions whose bodies are SQL expressions over the geometry struct, so
``spark.sql("SELECT ST_Area(geometry) ...")`` is planned by Catalyst like
any built-in expression (no Python UDF).  Joins and aggregates
(``ST_Union_Agg``, spatial joins, raster ops) are DataFrame operators."""

from __future__ import annotations

import re

from geoq.functions import crs

GEOM = ("STRUCT<gtype: STRING, srid: INT, parts: ARRAY<ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>>")

_SEGS = ("flatten(transform(flatten({g}.parts), r -> CASE WHEN size(r) = 1 THEN array(named_struct('a', r[0], 'b', r[0])) "
         "ELSE transform(sequence(0, size(r) - 2), i -> named_struct('a', r[i], 'b', r[i + 1])) END))")
_PX, _PY = "{a}.parts[0][0][0].x", "{a}.parts[0][0][0].y"
_RAY = ("(((s.a.y > {py}) <> (s.b.y > {py})) AND CASE WHEN s.b.y > s.a.y "
        "THEN ({px} - s.a.x) * (s.b.y - s.a.y) < ({py} - s.a.y) * (s.b.x - s.a.x) "
        "ELSE ({px} - s.a.x) * (s.b.y - s.a.y) > ({py} - s.a.y) * (s.b.x - s.a.x) END)")
_ON = ("((s.b.x - s.a.x) * ({py} - s.a.y) - (s.b.y - s.a.y) * ({px} - s.a.x) = 0 AND {px} BETWEEN least(s.a.x, s.b.x) "
       "AND greatest(s.a.x, s.b.x) AND {py} BETWEEN least(s.a.y, s.b.y) AND greatest(s.a.y, s.b.y))")
_D2 = ("CASE WHEN (s.b.x - s.a.x) * (s.b.x - s.a.x) + (s.b.y - s.a.y) * (s.b.y - s.a.y) = 0 "
       "OR ({px} - s.a.x) * (s.b.x - s.a.x) + ({py} - s.a.y) * (s.b.y - s.a.y) <= 0 "
       "THEN ({px} - s.a.x) * ({px} - s.a.x) + ({py} - s.a.y) * ({py} - s.a.y) "
       "WHEN ({px} - s.a.x) * (s.b.x - s.a.x) + ({py} - s.a.y) * (s.b.y - s.a.y) "
       ">= (s.b.x - s.a.x) * (s.b.x - s.a.x) + (s.b.y - s.a.y) * (s.b.y - s.a.y) "
       "THEN ({px} - s.b.x) * ({px} - s.b.x) + ({py} - s.b.y) * ({py} - s.b.y) "
       "ELSE pow((s.b.x - s.a.x) * ({py} - s.a.y) - (s.b.y - s.a.y) * ({px} - s.a.x), 2) "
       "/ ((s.b.x - s.a.x) * (s.b.x - s.a.x) + (s.b.y - s.a.y) * (s.b.y - s.a.y)) END")


_POLYGONAL = "{g}.gtype IN ('POLYGON', 'MULTIPOLYGON')"


def _named(template: str, seg: str, px: str, py: str) -> str:
    """A template over the segment ``s`` and a point, for another segment name."""
    return re.sub(r"\bs\.", f"{seg}.", template).format(px=px, py=py)


def _on(seg: str, p: str) -> str:
    return _named(_ON, seg, f"{p}.x", f"{p}.y")


def _proper(s: str, t: str) -> str:
    """Segments that cross at a point inside both."""
    def side(a, b, p):
        return f"signum(({b}.x - {a}.x) * ({p}.y - {a}.y) - ({b}.y - {a}.y) * ({p}.x - {a}.x))"

    def split(u, v):
        return f"{side(u + '.a', u + '.b', v + '.a')} * {side(u + '.a', u + '.b', v + '.b')} < 0"
    return f"({split(s, t)} AND {split(t, s)})"


_HIT = f"({_proper('s', 't')} OR {_on('s', 't.a')} OR {_on('s', 't.b')} OR {_on('t', 's.a')} OR {_on('t', 's.b')})"


def _inside(px: str, py: str, g: str, n: str = "e") -> str:
    """Point in polygonal ``g``, even-odd per part (boundary not decided);
    ``n`` keeps the names of nested lambdas apart."""
    segs = (f"flatten(transform({n}p, {n}r -> transform(sequence(0, size({n}r) - 2), "
            f"{n}i -> named_struct('a', {n}r[{n}i], 'b', {n}r[{n}i + 1]))))")
    return (f"({_POLYGONAL.format(g=g)} AND exists({g}.parts, {n}p -> "
            f"size(filter({segs}, {n}s -> {_named(_RAY, n + 's', px, py)})) % 2 = 1))")


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


# a part of either geometry that begins inside the other: parts that meet no edge lie wholly in or out
_PART_INSIDE = (f"(exists(a.parts, q -> {_inside('q[0][0].x', 'q[0][0].y', 'b')}) "
                f"OR exists(b.parts, q -> {_inside('q[0][0].x', 'q[0][0].y', 'a')}))")
_SA, _SB = _SEGS.format(g="a"), _SEGS.format(g="b")
_D2_SEGS = "least(" + ", ".join(_named(_D2, seg, f"{p}.x", f"{p}.y") for seg, p in (("t", "s.a"), ("t", "s.b"), ("s", "t.a"), ("s", "t.b"))) + ")"
_NEAREST2 = _bound(_SB, "tb", f"array_min(flatten(transform({_SA}, s -> transform(tb, t -> CASE WHEN {_HIT} THEN 0D ELSE {_D2_SEGS} END))))")

# every vertex of a in b or on its edge, one not on an edge; no crossing; and of each segment of a the
# middle of every piece between vertices of b that lie on it, as an edge can leave through a vertex
_MIDDLE = ("CASE WHEN dl = 0 THEN true ELSE forall(transform(array(array_sort(array_distinct(concat(array(0D, 1D), transform(filter("
           "vb, w -> " + _on("s", "w") + "), w -> ((w.x - s.a.x) * (s.b.x - s.a.x) + (w.y - s.a.y) * (s.b.y - s.a.y)) / dl))))), "
           "ts -> transform(sequence(0, size(ts) - 2), k -> (ts[k] + ts[k + 1]) / 2D))[0], m -> IN_B OR ON_B) END")
_MX, _MY = "(s.a.x + (s.b.x - s.a.x) * m)", "(s.a.y + (s.b.y - s.a.y) * m)"
_MIDDLE = _MIDDLE.replace("IN_B", _inside(_MX, _MY, "b")).replace("ON_B", f"exists(tb, t -> {_named(_ON, 't', _MX, _MY)})")
_DL = "((s.b.x - s.a.x) * (s.b.x - s.a.x) + (s.b.y - s.a.y) * (s.b.y - s.a.y))"
_WITHIN = (f"({_POLYGONAL.format(g='b')} AND " + _bound(_SB, "tb", _bound("flatten(flatten(a.parts))", "va", _bound(
    "flatten(flatten(b.parts))", "vb",
    f"forall(va, v -> {_inside('v.x', 'v.y', 'b')} OR exists(tb, t -> {_on('t', 'v')})) "
    f"AND exists(va, v -> NOT exists(tb, t -> {_on('t', 'v')})) "
    f"AND NOT exists({_SA}, s -> exists(tb, t -> {_proper('s', 't')})) "
    f"AND forall({_SA}, s -> {_bound(_DL, 'dl', _MIDDLE)})"))) + ")")


def _num(v):
    return f"CASE WHEN {v} = floor({v}) AND abs({v}) < 1e15 THEN CAST(CAST({v} AS BIGINT) AS STRING) ELSE CAST({v} AS STRING) END"


def _mapped(steps) -> str:
    """Every vertex ``v`` of ``g`` with new coordinates, step by step."""
    ring = "r"
    for x, y in steps:
        ring = f"transform({ring}, v -> named_struct('x', {x}, 'y', {y}))"
    return f"named_struct('gtype', g.gtype, 'srid', to_srid, 'parts', transform(g.parts, p -> transform(p, r -> {ring})))"


def _transform() -> str:
    """Between the CRSs of ``crs``, whose formulas are rendered as SQL.  The
    zone of a UTM target stays an expression, so that all zones are one."""
    zone, lon, lat = crs._S("(to_srid % 100)"), crs._S("v.x"), crs._S("v.y")
    forward = {"to_srid = 3857": crs.sql_xy("v.x", "v.y", 3857), "to_srid = 3301": crs.sql_xy("v.x", "v.y", 3301)}
    utm = {}
    for first, north in ((32600, True), (32700, False)):
        utm[f"to_srid BETWEEN {first + 1} AND {first + 60}"] = [[c.s for c in step(lon, lat)] for step in crs.utm_steps(crs.SQL, zone, north)]
    back = [c.s for c in crs.webmerc_inv(crs.SQL, lon, lat)]
    cases = " ".join(f"WHEN from_srid = 4326 AND {when} THEN {_mapped(xy)}" for when, xy in [*((w, [xy]) for w, xy in forward.items()), *utm.items()])
    return (f"CASE WHEN from_srid = to_srid THEN {_mapped([('v.x', 'v.y')])} "
            f"WHEN from_srid = 3857 AND to_srid = 4326 THEN {_mapped([back])} {cases} "
            "ELSE raise_error(concat('unsupported transform from ', from_srid, ' to ', to_srid)) END")


_RING_TXT = "concat('(', array_join(transform({r}, v -> concat(" + _num("v.x") + ", ' ', " + _num("v.y") + ")), ', '), ')')"

FUNCTIONS = {
    "ST_Point": ("x DOUBLE, y DOUBLE", GEOM,
                 "named_struct('gtype', 'POINT', 'srid', 0, 'parts', array(array(array(named_struct('x', x, 'y', y)))))"),
    "ST_MakeEnvelope": ("x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE", GEOM,
                        "named_struct('gtype', 'POLYGON', 'srid', 0, 'parts', array(array(array("
                        "named_struct('x', x0, 'y', y0), named_struct('x', x1, 'y', y0), named_struct('x', x1, 'y', y1), "
                        "named_struct('x', x0, 'y', y1), named_struct('x', x0, 'y', y0)))))"),
    "ST_X": (f"g {GEOM}", "DOUBLE", "g.parts[0][0][0].x"),
    "ST_Y": (f"g {GEOM}", "DOUBLE", "g.parts[0][0][0].y"),
    "ST_GeometryType": (f"g {GEOM}", "STRING", "g.gtype"),
    "ST_NPoints": (f"g {GEOM}", "INT", "size(flatten(flatten(g.parts)))"),
    "ST_XMin": (f"g {GEOM}", "DOUBLE", "array_min(transform(flatten(flatten(g.parts)), v -> v.x))"),
    "ST_YMin": (f"g {GEOM}", "DOUBLE", "array_min(transform(flatten(flatten(g.parts)), v -> v.y))"),
    "ST_XMax": (f"g {GEOM}", "DOUBLE", "array_max(transform(flatten(flatten(g.parts)), v -> v.x))"),
    "ST_YMax": (f"g {GEOM}", "DOUBLE", "array_max(transform(flatten(flatten(g.parts)), v -> v.y))"),
    "ST_Area": (f"g {GEOM}", "DOUBLE",
                "CASE WHEN g.gtype IN ('POLYGON', 'MULTIPOLYGON') THEN aggregate(g.parts, 0D, (acc, p) -> acc + "
                "aggregate(transform(p, (r, k) -> CASE WHEN k = 0 THEN 1D ELSE -1D END * abs(aggregate("
                "sequence(0, size(r) - 2), 0D, (a, i) -> a + (r[i].x - r[0].x) * (r[i + 1].y - r[0].y) "
                "- (r[i + 1].x - r[0].x) * (r[i].y - r[0].y)))), 0D, "
                "(a, b) -> a + b)) / 2 ELSE 0D END"),
    "ST_Length": (f"g {GEOM}", "DOUBLE",
                  "CASE WHEN g.gtype IN ('LINESTRING', 'MULTILINESTRING') THEN aggregate(" + _SEGS.format(g="g")
                  + ", 0D, (acc, s) -> acc + sqrt((s.b.x - s.a.x) * (s.b.x - s.a.x) + (s.b.y - s.a.y) * (s.b.y - s.a.y))) "
                  "ELSE 0D END"),
    "ST_Perimeter": (f"g {GEOM}", "DOUBLE",
                     "CASE WHEN g.gtype IN ('POLYGON', 'MULTIPOLYGON') THEN aggregate(" + _SEGS.format(g="g")
                     + ", 0D, (acc, s) -> acc + sqrt((s.b.x - s.a.x) * (s.b.x - s.a.x) + (s.b.y - s.a.y) * (s.b.y - s.a.y)))"
                     " ELSE 0D END"),
    # any geometry against any other
    "ST_Within": (f"a {GEOM}, b {GEOM}", "BOOLEAN", _WITHIN),
    "ST_Intersects": (f"a {GEOM}, b {GEOM}", "BOOLEAN",
                      f"({_PART_INSIDE} OR " + _bound(_SB, "tb", f"exists({_SA}, s -> exists(tb, t -> {_HIT}))") + ")"),
    "ST_Contains": (f"a {GEOM}, b {GEOM}", "BOOLEAN", f"transform(array(named_struct('a', b, 'b', a)), o -> "
                    + re.sub(r"\b([ab])\.(gtype|parts)\b", r"o.\1.\2", _WITHIN) + ")[0]"),
    # (geometry, from, to): EPSG codes 4326, 3857, 3301, 326zz and 327zz
    "ST_Transform": (f"g {GEOM}, from_srid INT, to_srid INT", GEOM, _transform()),
    "ST_Distance": (f"a {GEOM}, b {GEOM}", "DOUBLE", f"CASE WHEN {_PART_INSIDE} THEN 0D ELSE sqrt({_NEAREST2}) END"),
    "ST_DWithin": (f"a {GEOM}, b {GEOM}, d DOUBLE", "BOOLEAN", f"({_PART_INSIDE} OR {_NEAREST2} <= d * d)"),
    "ST_Envelope": (f"g {GEOM}", GEOM, _bound(
        "named_struct('x0', array_min(transform(flatten(flatten(g.parts)), v -> v.x)), 'x1', array_max(transform(flatten(flatten(g.parts)), v -> v.x)), "
        "'y0', array_min(transform(flatten(flatten(g.parts)), v -> v.y)), 'y1', array_max(transform(flatten(flatten(g.parts)), v -> v.y)))", "e",
        "named_struct('gtype', 'POLYGON', 'srid', g.srid, 'parts', array(array(array(named_struct('x', e.x0, 'y', e.y0), "
        "named_struct('x', e.x1, 'y', e.y0), named_struct('x', e.x1, 'y', e.y1), named_struct('x', e.x0, 'y', e.y1), named_struct('x', e.x0, 'y', e.y0)))))")),
    "ST_AsText": (f"g {GEOM}", "STRING",
                  "concat(g.gtype, ' ', CASE g.gtype WHEN 'POINT' THEN concat('(', " + _num("g.parts[0][0][0].x")
                  + ", ' ', " + _num("g.parts[0][0][0].y") + ", ')') WHEN 'LINESTRING' THEN "
                  + _RING_TXT.format(r="g.parts[0][0]") + " WHEN 'POLYGON' THEN concat('(', array_join(transform("
                  "g.parts[0], r -> " + _RING_TXT.format(r="r") + "), ', '), ')') END)"),
}


# ST_SRID / ST_SetSRID are Spark 4.1 built-ins (for Spark's own GEOMETRY
# type) and cannot be replaced by temporary functions: use ``g.srid`` and
# ``geometry.set_srid`` on the struct.


def register(spark) -> list:
    """Create the temporary SQL functions in the current session."""
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return sorted(FUNCTIONS)
