"""Reference SQL for every registered query, runnable by DuckDB (no spatial
extension) on the driver tables: each geometric step is spelled out as
arithmetic over vertex / segment tables, so the check is independent of
the Spark implementation."""

from __future__ import annotations

# ---------------------------------------------------------------- fixture CTEs

PTS_CUSTOMER = ("pts AS (SELECT c_custkey AS id, ((c_custkey*7919)%100003)*1e0 AS x, "
                "((c_custkey*104729)%100019)*1e0 AS y, c_mktsegment AS kind FROM customer)")
PTS_SUPPLIER = ("sup AS (SELECT s_suppkey AS id, ((s_suppkey*15485863)%100003)*1e0 AS x, "
                "((s_suppkey*32452843)%100019)*1e0 AS y FROM supplier)")
PTS_PART = ("prt AS (SELECT p_partkey AS id, ((p_partkey*27644437)%100003)*1e0 AS x, "
            "((p_partkey*86028121)%100019)*1e0 AS y FROM part)")
POLY_V = """pv AS (SELECT CAST(n_nationkey AS BIGINT) AS id, v.ring AS ring, v.seq AS seq,
       CAST((n_nationkey%5)*20000 + v.ox + CASE WHEN n_nationkey=24 THEN 500000 ELSE 0 END AS DOUBLE) AS x,
       CAST(((n_nationkey-n_nationkey%5)/5)*20000 + v.oy AS DOUBLE) AS y
FROM nation CROSS JOIN (VALUES (0,0,0,0),(0,1,22000,0),(0,2,22000,9000),(0,3,9000,12000),(0,4,18000,21000),(0,5,0,18000),(0,6,0,0),
                               (1,0,2000,2000),(1,1,2000,5000),(1,2,5000,5000),(1,3,5000,2000),(1,4,2000,2000)) AS v(ring,seq,ox,oy)
WHERE v.ring=0 OR n_nationkey%5=2)"""
POLY_SEG = ("pseg AS (SELECT a.id, a.ring, a.seq, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM pv a "
            "JOIN pv b ON a.id=b.id AND a.ring=b.ring AND b.seq=a.seq+1)")
POLY_BB = "pbb AS (SELECT id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM pv GROUP BY id)"
LINE_V = """lv AS (SELECT o_orderkey AS id, v.seq AS seq, o_orderpriority AS highway, o_custkey AS cust,
       CAST((o_orderkey*7919)%100003 + CASE WHEN v.seq>=1 THEN o_orderkey%7*40+20 ELSE 0 END + CASE WHEN v.seq>=2 THEN o_orderkey%3*50-50 ELSE 0 END AS DOUBLE) AS x,
       CAST((o_orderkey*104729)%100019 + CASE WHEN v.seq>=1 THEN o_orderkey%5*30-60 ELSE 0 END + CASE WHEN v.seq>=2 THEN 40+o_orderkey%11*10 ELSE 0 END AS DOUBLE) AS y
FROM orders CROSS JOIN (VALUES (0),(1),(2)) AS v(seq))"""
LINE_SEG = ("lseg AS (SELECT a.id, a.seq, a.highway, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM lv a "
            "JOIN lv b ON a.id=b.id AND b.seq=a.seq+1)")
LINE_BB = "lbb AS (SELECT id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM lv GROUP BY id)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# point (c.x, c.y) vs segment s(ax, ay, bx, by): ray crossing / on-segment
RAY = ("(((s.ay > {py}) <> (s.by > {py})) AND (CASE WHEN s.by > s.ay "
       "THEN ({px} - s.ax)*(s.by - s.ay) < ({py} - s.ay)*(s.bx - s.ax) "
       "ELSE ({px} - s.ax)*(s.by - s.ay) > ({py} - s.ay)*(s.bx - s.ax) END))")
ONSEG = ("((s.bx - s.ax)*({py} - s.ay) - (s.by - s.ay)*({px} - s.ax) = 0 AND {px} BETWEEN least(s.ax,s.bx) "
         "AND greatest(s.ax,s.bx) AND {py} BETWEEN least(s.ay,s.by) AND greatest(s.ay,s.by))")


def ray(px, py):
    return RAY.format(px=px, py=py)


def onseg(px, py):
    return ONSEG.format(px=px, py=py)


def pt_seg_within(px, py, d2):
    """|p - s|^2 <= d2 without division (same formula as the Spark side)."""
    dx, dy = "(s.bx - s.ax)", "(s.by - s.ay)"
    ll = f"({dx}*{dx} + {dy}*{dy})"
    t = f"(({px} - s.ax)*{dx} + ({py} - s.ay)*{dy})"
    da = f"(({px} - s.ax)*({px} - s.ax) + ({py} - s.ay)*({py} - s.ay))"
    db = f"(({px} - s.bx)*({px} - s.bx) + ({py} - s.by)*({py} - s.by))"
    cr = f"({dx}*({py} - s.ay) - {dy}*({px} - s.ax))"
    return (f"(CASE WHEN {ll} = 0 OR {t} <= 0 THEN {da} <= {d2} WHEN {t} >= {ll} THEN {db} <= {d2} "
            f"ELSE {cr}*{cr} <= {d2}*{ll} END)")


# point-in-polygon status per (point, polygon) candidate: crossing count + boundary flag
def pip_status(points_cte: str, where_poly: str = "TRUE") -> str:
    return f"""pip AS (
  SELECT c.pid, c.gid,
         SUM(CASE WHEN {ray('c.x', 'c.y')} THEN 1 ELSE 0 END) AS nx,
         MAX(CASE WHEN {onseg('c.x', 'c.y')} THEN 1 ELSE 0 END) AS onb
  FROM (SELECT p.id AS pid, g.id AS gid, p.x, p.y FROM {points_cte} p JOIN pbb g
        ON p.x BETWEEN g.minx AND g.maxx AND p.y BETWEEN g.miny AND g.maxy WHERE {where_poly}) c
  JOIN pseg s ON s.id = c.gid
  GROUP BY c.pid, c.gid)"""


ORACLE: dict[str, str] = {}

ORACLE["points_per_polygon"] = with_(PTS_CUSTOMER, POLY_V, POLY_SEG, POLY_BB, pip_status("pts", "g.id <> 3")) + """
SELECT g.id AS neighborhood_id, CAST(count(pip.pid) AS BIGINT) AS restaurant_count
FROM (SELECT DISTINCT id FROM pv WHERE id <> 3) g
LEFT JOIN pip ON pip.gid = g.id AND pip.nx % 2 = 1 AND pip.onb = 0
GROUP BY g.id"""


def seg_intersects(a: str, s: str) -> str:
    """Segments {a}(ax,ay,bx,by) and {s} intersect (boundary inclusive), by
    orientation signs and collinear on-segment tests."""
    def cr(p, q, rx, ry):
        return f"sign(({p}.bx - {p}.ax)*({ry} - {p}.ay) - ({p}.by - {p}.ay)*({rx} - {p}.ax))"

    def on(p, rx, ry):
        return (f"(({p}.bx - {p}.ax)*({ry} - {p}.ay) - ({p}.by - {p}.ay)*({rx} - {p}.ax) = 0 AND {rx} BETWEEN "
                f"least({p}.ax,{p}.bx) AND greatest({p}.ax,{p}.bx) AND {ry} BETWEEN least({p}.ay,{p}.by) AND "
                f"greatest({p}.ay,{p}.by))")
    o1, o2 = cr(a, s, f"{s}.ax", f"{s}.ay"), cr(a, s, f"{s}.bx", f"{s}.by")
    o3, o4 = cr(s, a, f"{a}.ax", f"{a}.ay"), cr(s, a, f"{a}.bx", f"{a}.by")
    return (f"(({o1})*({o2}) < 0 AND ({o3})*({o4}) < 0 OR {on(a, f'{s}.ax', f'{s}.ay')} OR "
            f"{on(a, f'{s}.bx', f'{s}.by')} OR {on(s, f'{a}.ax', f'{a}.ay')} OR {on(s, f'{a}.bx', f'{a}.by')})")


def pt_seg_d2(px, py):
    dx, dy = "(s.bx - s.ax)", "(s.by - s.ay)"
    ll = f"({dx}*{dx} + {dy}*{dy})"
    t = f"(({px} - s.ax)*{dx} + ({py} - s.ay)*{dy})"
    da = f"(({px} - s.ax)*({px} - s.ax) + ({py} - s.ay)*({py} - s.ay))"
    db = f"(({px} - s.bx)*({px} - s.bx) + ({py} - s.by)*({py} - s.by))"
    cr = f"({dx}*({py} - s.ay) - {dy}*({px} - s.ax))"
    return f"(CASE WHEN {ll} = 0 OR {t} <= 0 THEN {da} WHEN {t} >= {ll} THEN {db} ELSE {cr}*{cr}/{ll} END)"


def seg_near(px, py, d):
    """bbox prefilter of a point against segment s grown by d."""
    return (f"{px} BETWEEN least(s.ax,s.bx)-{d} AND greatest(s.ax,s.bx)+{d} AND "
            f"{py} BETWEEN least(s.ay,s.by)-{d} AND greatest(s.ay,s.by)+{d}")


PIP_C = with_(PTS_CUSTOMER, POLY_V, POLY_SEG, POLY_BB, pip_status("pts", "g.id <> 3"))
WITHIN = "(SELECT pid, gid FROM pip WHERE nx % 2 = 1 AND onb = 0)"

ORACLE["pip_inner_join"] = PIP_C + f"SELECT pid AS point_id, gid AS polygon_id FROM {WITHIN}"
ORACLE["pip_left_join"] = PIP_C + f"SELECT p.id AS point_id, w.gid AS polygon_id FROM pts p LEFT JOIN {WITHIN} w ON w.pid = p.id"
ORACLE["pip_anti_join"] = PIP_C + f"SELECT id AS point_id FROM pts WHERE id NOT IN (SELECT pid FROM {WITHIN})"

D2_CS = "((p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y))"
ORACLE["distance_join"] = with_(PTS_CUSTOMER, PTS_SUPPLIER) + f"""
SELECT p.id AS cust_id, s.id AS supp_id, round(sqrt({D2_CS}), 3) AS dist
FROM pts p JOIN sup s ON {D2_CS} <= 2500e0*2500e0"""
ORACLE["distance_anti_join"] = with_(PTS_CUSTOMER, PTS_SUPPLIER) + f"""
SELECT p.id AS cust_id, p.x, p.y FROM pts p WHERE NOT EXISTS (SELECT 1 FROM sup s WHERE {D2_CS} <= 2500e0*2500e0)"""
ORACLE["streets_trees_near_hospitals"] = with_(PTS_SUPPLIER, PTS_PART, LINE_V, LINE_SEG) + f""",
near AS (SELECT DISTINCT s.id FROM lseg s JOIN sup h ON {seg_near('h.x', 'h.y', 1000)}
         WHERE {pt_seg_within('h.x', 'h.y', '1000e0*1000e0')}),
trees AS (SELECT DISTINCT t.id FROM prt t JOIN (SELECT * FROM lseg WHERE id IN (SELECT id FROM near)) s
          ON {seg_near('t.x', 't.y', 200)} WHERE {pt_seg_within('t.x', 't.y', '200e0*200e0')})
SELECT (SELECT CAST(count(*) AS BIGINT) FROM trees) AS total_tree_count,
       (SELECT round(sum(sqrt((s.bx-s.ax)*(s.bx-s.ax)+(s.by-s.ay)*(s.by-s.ay))), 3) FROM lseg s
        WHERE s.id IN (SELECT id FROM near))
       AS total_street_length_m"""
ORACLE["nearest_within"] = with_(PTS_CUSTOMER, PTS_SUPPLIER) + f"""
SELECT cust_id, supp_id, dist_sq FROM (
  SELECT p.id AS cust_id, s.id AS supp_id, {D2_CS} AS dist_sq,
         rank() OVER (PARTITION BY p.id ORDER BY {D2_CS}) AS rk
  FROM pts p JOIN sup s ON {D2_CS} <= 5000e0*5000e0) WHERE rk = 1"""
ORACLE["nearest_any_distance"] = with_(PTS_PART, PTS_SUPPLIER) + """, d AS (SELECT p.id AS part_id, s.id AS supp_id,
  (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) AS dist_sq FROM prt p, sup s)
SELECT part_id, supp_id, dist_sq FROM (SELECT *, rank() OVER (PARTITION BY part_id ORDER BY dist_sq) AS rk FROM d) WHERE rk = 1"""
ORACLE["distinct_nodes_near_edges"] = with_(PTS_PART, LINE_V, LINE_SEG) + f"""
SELECT CAST(count(DISTINCT t.id) AS BIGINT) AS n_nodes FROM prt t JOIN lseg s ON {seg_near('t.x', 't.y', 100)}
WHERE {pt_seg_within('t.x', 't.y', '100e0*100e0')}"""

LINE_POLY_HITS = f""",
lvp AS (SELECT l.id AS lid, g.id AS gid, l.seq, l.x, l.y FROM lv l JOIN pbb g
        ON l.x BETWEEN g.minx AND g.maxx AND l.y BETWEEN g.miny AND g.maxy WHERE g.id <> 3),
vin AS (SELECT c.lid, c.gid, c.seq, SUM(CASE WHEN {ray('c.x', 'c.y')} THEN 1 ELSE 0 END) AS nx,
               MAX(CASE WHEN {onseg('c.x', 'c.y')} THEN 1 ELSE 0 END) AS onb
        FROM lvp c JOIN pseg s ON s.id = c.gid GROUP BY c.lid, c.gid, c.seq),
hits AS (SELECT lid, gid FROM vin WHERE nx % 2 = 1 OR onb = 1
         UNION
         SELECT a.id AS lid, s.id AS gid FROM lseg a JOIN pseg s
           ON least(a.ax,a.bx) <= greatest(s.ax,s.bx) AND least(s.ax,s.bx) <= greatest(a.ax,a.bx)
          AND least(a.ay,a.by) <= greatest(s.ay,s.by) AND least(s.ay,s.by) <= greatest(a.ay,a.by)
         WHERE s.id <> 3 AND {seg_intersects('a', 's')})
"""
LP = with_(POLY_V, POLY_SEG, POLY_BB, LINE_V, LINE_SEG) + LINE_POLY_HITS
ORACLE["intersects_join"] = LP + "SELECT lid AS line_id, gid AS polygon_id FROM hits"
ORACLE["lines_per_polygon"] = LP + """SELECT g.id AS polygon_id, CAST(count(h.lid) AS BIGINT) AS n_lines
FROM (SELECT DISTINCT id FROM pv WHERE id <> 3) g LEFT JOIN hits h ON h.gid = g.id GROUP BY g.id"""
ORACLE["filter_intersects_polygon"] = LP + "SELECT lid AS line_id FROM hits WHERE gid = 12"
ORACLE["bbox_join"] = with_(POLY_V, POLY_BB, LINE_V, LINE_BB) + """
SELECT l.id AS line_id, g.id AS polygon_id FROM lbb l JOIN pbb g
  ON l.minx <= g.maxx AND g.minx <= l.maxx AND l.miny <= g.maxy AND g.miny <= l.maxy WHERE g.id <> 3"""
ORACLE["proximity_by_batch"] = with_(PTS_PART, LINE_V, LINE_SEG) + f"""
SELECT CAST(floor(lid / 1000) AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS pairs FROM (
  SELECT DISTINCT t.id AS tid, s.id AS lid FROM prt t JOIN lseg s ON {seg_near('t.x', 't.y', 50)}
  WHERE {pt_seg_within('t.x', 't.y', '50e0*50e0')}) GROUP BY 1"""
ORACLE["filter_within_box"] = with_(LINE_V) + """
SELECT id AS line_id FROM lv GROUP BY id
HAVING bool_and(x BETWEEN 20000 AND 60000 AND y BETWEEN 20000 AND 60000)
   AND bool_or(x > 20000 AND x < 60000 AND y > 20000 AND y < 60000)"""
ORACLE["filter_bbox"] = with_(LINE_V, LINE_BB) + """
SELECT id AS line_id FROM lbb WHERE minx <= 60000 AND maxx >= 20000 AND miny <= 60000 AND maxy >= 20000"""
ORACLE["filter_within_distance"] = with_(PTS_CUSTOMER) + """
SELECT id AS point_id FROM pts WHERE (x-50000)*(x-50000)+(y-50000)*(y-50000) <= 1e8"""

RING_TA = ("(SELECT s.id, s.ring, sum(s.ax*s.by - s.bx*s.ay) AS ta, "
           "sum(sqrt((s.bx-s.ax)*(s.bx-s.ax)+(s.by-s.ay)*(s.by-s.ay))) AS len, "
           "sum((s.ax+s.bx)*(s.ax*s.by - s.bx*s.ay)) AS mx, sum((s.ay+s.by)*(s.ax*s.by - s.bx*s.ay)) AS my "
           "FROM pseg s GROUP BY s.id, s.ring)")
ORACLE["polygon_measures"] = with_(POLY_V, POLY_SEG, POLY_BB) + f"""
, rs AS {RING_TA},
agg AS (SELECT id, sum(CASE WHEN ring = 0 THEN abs(ta) ELSE -abs(ta) END) AS ta2, sum(len) AS len,
               sum(CASE WHEN ring = 0 THEN sign(ta) ELSE -sign(ta) END * mx) AS mx,
               sum(CASE WHEN ring = 0 THEN sign(ta) ELSE -sign(ta) END * my) AS my,
               CAST(count(*) AS BIGINT) AS num_rings
        FROM rs GROUP BY id)
SELECT a.id, 'POLYGON' AS gtype, a.ta2 / 2.0 AS area, round(a.len, 6) AS perimeter, 0.0 AS length,
       round(a.len, 6) AS boundary_length, round(a.mx / (a.ta2 * 3.0), 6) AS cx, round(a.my / (a.ta2 * 3.0), 6) AS cy,
       b.minx, b.miny, b.maxx, b.maxy, (SELECT CAST(count(*) AS BIGINT) FROM pv WHERE pv.id = a.id) AS num_points,
       a.num_rings
FROM agg a JOIN pbb b ON a.id = b.id WHERE a.id <> 3"""
ORACLE["line_measures"] = with_(LINE_V, LINE_SEG, LINE_BB) + """
, ls AS (SELECT s.id, sum(sqrt((s.bx-s.ax)*(s.bx-s.ax)+(s.by-s.ay)*(s.by-s.ay))) AS len,
                sum((s.ax+s.bx)/2.0*sqrt((s.bx-s.ax)*(s.bx-s.ax)+(s.by-s.ay)*(s.by-s.ay))) AS mx,
                sum((s.ay+s.by)/2.0*sqrt((s.bx-s.ax)*(s.bx-s.ax)+(s.by-s.ay)*(s.by-s.ay))) AS my
         FROM lseg s GROUP BY s.id)
SELECT l.id, round(l.len, 6) AS length, 0.0 AS area, round(l.mx / l.len, 6) AS cx, round(l.my / l.len, 6) AS cy,
       b.minx, b.miny, b.maxx, b.maxy, v.x AS x0, v.y AS y0, CAST(3 AS BIGINT) AS num_points
FROM ls l JOIN lbb b ON l.id = b.id JOIN lv v ON v.id = l.id AND v.seq = 0"""
ORACLE["point_polygon_distance"] = with_(PTS_CUSTOMER, POLY_V, POLY_SEG, POLY_BB) + f"""
, c AS (SELECT p.id AS pid, g.id AS gid, p.x, p.y FROM pts p JOIN pbb g
        ON p.x BETWEEN g.minx - 5000 AND g.maxx + 5000 AND p.y BETWEEN g.miny - 5000 AND g.maxy + 5000 WHERE g.id <> 3),
st AS (SELECT c.pid, c.gid, SUM(CASE WHEN {ray('c.x', 'c.y')} THEN 1 ELSE 0 END) AS nx,
              MAX(CASE WHEN {onseg('c.x', 'c.y')} THEN 1 ELSE 0 END) AS onb,
              MIN({pt_seg_d2('c.x', 'c.y')}) AS d2,
              MAX(CASE WHEN {pt_seg_within('c.x', 'c.y', '5000e0*5000e0')} THEN 1 ELSE 0 END) AS near
       FROM c JOIN pseg s ON s.id = c.gid GROUP BY c.pid, c.gid)
SELECT pid AS point_id, gid AS polygon_id,
       CASE WHEN nx % 2 = 1 OR onb = 1 THEN 0.0 ELSE round(sqrt(d2), 3) END AS dist
FROM st WHERE nx % 2 = 1 OR onb = 1 OR near = 1"""


# ---------------------------------------------------------------- relational batch

def num_txt(v):
    return (f"(CASE WHEN {v} = floor({v}) AND abs({v}) < 1e15 THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) "
            f"ELSE CAST({v} AS VARCHAR) END)")


LLEN = with_(LINE_V, LINE_SEG, LINE_BB) + """, ll AS (
  SELECT s.id, s.highway, sum(sqrt((s.bx-s.ax)*(s.bx-s.ax)+(s.by-s.ay)*(s.by-s.ay))) AS length
  FROM lseg s GROUP BY s.id, s.highway)
"""
POLY_AREA = f""", rs AS {RING_TA},
parea AS (SELECT id, sum(CASE WHEN ring = 0 THEN abs(ta) ELSE -abs(ta) END) / 2.0 AS area, sum(len) AS perimeter
          FROM rs GROUP BY id)
"""

ORACLE["parquet_scan"] = with_(PTS_CUSTOMER) + "SELECT id, x, y, kind FROM pts"
ORACLE["filter_by_attribute"] = with_(LINE_V) + \
    "SELECT DISTINCT id AS line_id, cust FROM lv WHERE highway = '1-URGENT'"
ORACLE["modulo_filter"] = with_(PTS_CUSTOMER) + "SELECT id AS point_id FROM pts WHERE (x + y) % 2 = 0"
ORACLE["null_filter"] = PIP_C + f"""SELECT CASE WHEN w.gid IS NULL THEN 'outside' ELSE 'inside' END AS status,
CAST(count(*) AS BIGINT) AS n FROM pts p LEFT JOIN {WITHIN} w ON w.pid = p.id GROUP BY 1"""
ORACLE["geometry_type_filter"] = """SELECT CAST(n_nationkey AS BIGINT) AS id,
CASE WHEN n_nationkey = 3 THEN 'POINT' ELSE 'POLYGON' END AS gtype, n_nationkey <> 3 AS is_polygonal FROM nation"""
ORACLE["column_ops"] = with_(PTS_CUSTOMER) + f"""SELECT id AS point_id, x AS easting, y AS northing,
'POINT (' || {num_txt('x')} || ' ' || {num_txt('y')} || ')' AS geometry FROM pts"""
ORACLE["case_when"] = LLEN + """SELECT COALESCE(CASE WHEN length > 300 THEN 'long' WHEN length > 150 THEN 'medium'
ELSE 'short' END, 'unknown') AS length_class, CAST(count(*) AS BIGINT) AS n FROM ll GROUP BY 1"""
ORACLE["unit_conversion"] = with_(POLY_V, POLY_SEG) + POLY_AREA + """SELECT id, area / 1e6 AS area_km2,
area / 1e4 AS area_ha, round(perimeter / 1e3, 6) AS perimeter_km FROM parea WHERE id <> 3"""
ORACLE["row_count"] = """SELECT (SELECT CAST(count(*) AS BIGINT) FROM orders) AS n_lines,
(SELECT CAST(count(*) AS BIGINT) FROM customer) AS n_points,
(SELECT CAST(count(*) AS BIGINT) FROM nation WHERE n_nationkey <> 3) AS n_polygons"""
ORACLE["total_length"] = LLEN + "SELECT round(sum(length), 2) AS total_length FROM ll"
ORACLE["length_stats"] = LLEN + """SELECT round(avg(length), 6) AS avg_length, round(max(length), 6) AS max_length,
round(min(length), 6) AS min_length FROM ll"""
ORACLE["conditional_avg"] = LLEN + \
    "SELECT round(avg(CASE WHEN length > 100 THEN length END), 6) AS avg_length_over_100 FROM ll"
ORACLE["distinct_highways"] = "SELECT DISTINCT o_orderpriority AS highway FROM orders"
ORACLE["count_distinct"] = """SELECT CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n_highway,
CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_cust FROM orders"""
ORACLE["highway_summary"] = LLEN + """SELECT highway, CAST(count(*) AS BIGINT) AS n, round(sum(length), 2) AS total_length
FROM ll GROUP BY highway ORDER BY n DESC, highway LIMIT 20"""
ORACLE["duplicate_geometries"] = with_(PTS_PART) + f"""SELECT wkt, CAST(count(*) AS BIGINT) AS cnt FROM (
  SELECT 'POINT (' || {num_txt('p.x')} || ' ' || {num_txt('p.y')} || ')' AS wkt
  FROM lineitem l JOIN prt p ON p.id = l.l_partkey) GROUP BY wkt HAVING count(*) > 1
ORDER BY cnt DESC, wkt LIMIT 5"""
ORACLE["collect_points"] = with_(PTS_CUSTOMER) + """SELECT kind, 'MULTIPOINT' AS gtype,
CAST(count(*) AS BIGINT) AS num_points, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy
FROM pts GROUP BY kind"""
ORACLE["extent_total"] = with_(LINE_V) + "SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM lv"
ORACLE["extent_by_highway"] = with_(LINE_V) + """SELECT highway, min(x) AS minx, min(y) AS miny, max(x) AS maxx,
max(y) AS maxy FROM lv GROUP BY highway"""
ORACLE["length_quantiles"] = LLEN + """SELECT round(quantile_cont(length, 0.25), 6) AS q25,
round(quantile_cont(length, 0.5), 6) AS q50, round(quantile_cont(length, 0.75), 6) AS q75 FROM ll"""
ORACLE["quartile_totals"] = LLEN + """, q AS (SELECT quantile_cont(length, 0.25) AS q1, quantile_cont(length, 0.5) AS q2,
  quantile_cont(length, 0.75) AS q3 FROM ll),
lab AS (SELECT * FROM (VALUES ('Q1 (Shortest)'), ('Q2'), ('Q3'), ('Q4 (Longest)')) AS t(quartile)),
tot AS (SELECT CASE WHEN length <= q1 THEN 'Q1 (Shortest)' WHEN length <= q2 THEN 'Q2' WHEN length <= q3 THEN 'Q3'
  ELSE 'Q4 (Longest)' END AS quartile, sum(length) AS total_length FROM ll, q GROUP BY 1)
SELECT lab.quartile, round(tot.total_length, 2) AS total_length FROM lab LEFT JOIN tot USING (quartile)"""
ORACLE["shortest90_extent"] = LLEN + """, r AS (SELECT id, row_number() OVER (ORDER BY length, id) AS rk FROM ll)
SELECT min(b.minx) AS minx, min(b.miny) AS miny, max(b.maxx) AS maxx, max(b.maxy) AS maxy
FROM r JOIN lbb b ON b.id = r.id WHERE r.rk <= CAST(floor((SELECT count(*) FROM ll) * 0.9) AS BIGINT)"""
_CV = [("length", "length"), ("minx", "minx"), ("miny", "miny")]
ORACLE["correlation_matrix"] = LLEN + ", cv AS (SELECT ll.length, b.minx, b.miny FROM ll JOIN lbb b ON b.id = ll.id)\n" + \
    "\nUNION ALL\n".join(
        (f"SELECT '{a}' AS var1, '{b}' AS var2, 1.0 AS corr" if a == b else
         f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS corr FROM cv")
        for a, _ in _CV for b, _ in _CV)
ORACLE["length_histogram"] = LLEN + """, mm AS (SELECT min(length) AS lo, max(length) AS hi FROM ll),
cnt AS (SELECT CAST(least(floor((length - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM ll, mm GROUP BY 1)
SELECT b.bin, round(lo + b.bin * (hi - lo) / 50, 6) AS bin_lo, round(lo + (b.bin + 1) * (hi - lo) / 50, 6) AS bin_hi,
CAST(coalesce(cnt.n, 0) AS BIGINT) AS count FROM (SELECT range AS bin FROM range(50)) b CROSS JOIN mm
LEFT JOIN cnt ON cnt.bin = b.bin"""
ORACLE["kind_percent"] = with_(PTS_CUSTOMER) + """SELECT kind, CAST(count(*) AS BIGINT) AS n,
round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM pts GROUP BY kind"""
ORACLE["row_ids"] = with_(PTS_CUSTOMER) + "SELECT id, row_number() OVER (ORDER BY x, y, id) AS row_id FROM pts"
ORACLE["knn_1000"] = with_(PTS_CUSTOMER, PTS_PART) + """, t AS (SELECT x, y FROM pts ORDER BY id LIMIT 1)
SELECT p.id, (p.x - t.x)*(p.x - t.x) + (p.y - t.y)*(p.y - t.y) AS dist_sq FROM prt p, t
ORDER BY dist_sq, p.id LIMIT 1000"""
ORACLE["sorted_points"] = with_(PTS_SUPPLIER) + "SELECT id, x, y FROM sup ORDER BY x, id"
ORACLE["concat_points"] = with_(PTS_CUSTOMER, PTS_SUPPLIER) + """SELECT id, x, y, 'customer' AS source FROM pts
UNION ALL SELECT id, x, y, 'supplier' AS source FROM sup"""
ORACLE["by_city"] = LLEN + """SELECT r.r_name AS city, CAST(count(*) AS BIGINT) AS n_lines, round(sum(ll.length), 2) AS total_length
FROM ll JOIN orders o ON o.o_orderkey = ll.id JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name"""
ORACLE["normalize_names"] = """SELECT CAST(n_nationkey AS BIGINT) AS id,
replace(lower(trim(split_part(n_name, ',', 1))), ' ', '_') AS table_suffix FROM nation"""
ORACLE["format_numbers"] = with_(POLY_V, POLY_SEG) + POLY_AREA + """SELECT id, format('{:,.2f}', area) AS area_txt,
CAST(trunc(area) AS BIGINT) AS area_int, round(perimeter, 3) AS perimeter FROM parea WHERE id <> 3"""
ORACLE["wkt_round_trip"] = with_(POLY_V) + f""", rt AS (SELECT id, ring,
  '(' || string_agg({num_txt('x')} || ' ' || {num_txt('y')}, ', ' ORDER BY seq) || ')' AS txt, count(*) AS n
  FROM pv GROUP BY id, ring),
pw AS (SELECT id, 'POLYGON (' || string_agg(txt, ', ' ORDER BY ring) || ')' AS wkt, sum(n) AS n FROM rt GROUP BY id)
""" + POLY_AREA.replace("FROM pseg s", "FROM pseg s") + """SELECT pw.id, pw.wkt, parea.area, CAST(pw.n AS BIGINT) AS num_points
FROM pw JOIN parea ON parea.id = pw.id WHERE pw.id <> 3"""
ORACLE["wkt_round_trip"] = ORACLE["wkt_round_trip"].replace("WITH " + POLY_V, "WITH " + POLY_V + ",\n" + POLY_SEG, 1)
ORACLE["line_wkt"] = LLEN + f""", lw AS (SELECT id, 'LINESTRING (' || string_agg({num_txt('x')} || ' ' || {num_txt('y')}, ', '
  ORDER BY seq) || ')' AS wkt FROM lv GROUP BY id)
SELECT lw.id AS line_id, lw.wkt, round(ll.length, 6) AS length FROM lw JOIN ll ON ll.id = lw.id"""


# ---------------------------------------------------------------- OSM batch

WAY_PTS = """wnd AS (SELECT l_orderkey AS way_id, l_partkey AS node_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos
  FROM lineitem),
wpt AS (SELECT w.way_id, w.pos, p.x, p.y FROM wnd w JOIN prt p ON p.id = w.node_id),
wseg AS (SELECT way_id, pos, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx,
                coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny
         FROM wpt WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
wgeo AS (SELECT way_id, count(*) AS n, sum(x*ny - nx*y) AS ta,
                (min_by(x, pos) = max_by(x, pos) AND min_by(y, pos) = max_by(y, pos)) AS closed
         FROM wseg GROUP BY way_id HAVING count(*) >= 4)"""
WAYS = """ways AS (SELECT o_orderkey AS way_id, o_orderpriority AS highway, o_orderstatus AS status,
  o_orderpriority = '1-URGENT' AS building, o_custkey FROM orders)"""
RELS = """rel AS (SELECT c_custkey AS rel_id FROM customer WHERE c_mktsegment = 'BUILDING'),
mem AS (SELECT o_custkey AS rel_id, o_orderkey AS way_id, CASE WHEN o_orderstatus = 'F' THEN 'outer' ELSE 'inner' END AS role
        FROM orders WHERE o_custkey IN (SELECT rel_id FROM rel)),
rg AS (SELECT m.rel_id, count(*) FILTER (WHERE m.role = 'outer') AS n_outer,
              count(*) FILTER (WHERE m.role <> 'outer') AS n_inner,
              sum(abs(g.ta)) FILTER (WHERE m.role = 'outer') AS outer_a2,
              coalesce(sum(abs(g.ta)) FILTER (WHERE m.role <> 'outer'), 0) AS inner_a2
       FROM mem m JOIN wgeo g ON g.way_id = m.way_id GROUP BY m.rel_id HAVING count(*) FILTER (WHERE m.role = 'outer') >= 1)"""
BLD = """bld AS (
  SELECT 'r' || CAST(rel_id AS VARCHAR) AS feature_id, CASE WHEN n_outer = 1 THEN 'POLYGON' ELSE 'MULTIPOLYGON' END AS gtype,
         CASE WHEN n_outer = 1 THEN (outer_a2 - inner_a2) / 2.0 ELSE outer_a2 / 2.0 END AS area FROM rg
  UNION ALL
  SELECT 'w' || CAST(g.way_id AS VARCHAR), 'POLYGON', abs(g.ta) / 2.0 FROM wgeo g JOIN ways w ON w.way_id = g.way_id
  WHERE w.building AND g.way_id NOT IN (SELECT way_id FROM mem))"""
OSM_BASE = with_(PTS_PART, WAY_PTS, WAYS, RELS, BLD)

ORACLE["osm_required_ids"] = with_(WAYS, RELS) + """, wid AS (SELECT way_id AS id FROM ways WHERE building
  UNION SELECT way_id FROM mem)
SELECT 'way' AS kind, id FROM wid
UNION ALL SELECT DISTINCT 'node', l_partkey FROM lineitem WHERE l_orderkey IN (SELECT id FROM wid)"""
ORACLE["osm_way_geometries"] = with_(PTS_PART, WAY_PTS) + """SELECT way_id, CAST(n + CASE WHEN closed THEN 0 ELSE 1 END AS BIGINT)
AS num_points, abs(ta) / 2.0 AS area FROM wgeo"""
ORACLE["osm_relation_geometries"] = with_(PTS_PART, WAY_PTS, RELS) + """SELECT rel_id,
CASE WHEN n_outer = 1 THEN 'POLYGON' ELSE 'MULTIPOLYGON' END AS gtype,
CAST(CASE WHEN n_outer = 1 THEN 1 ELSE n_outer END AS BIGINT) AS n_parts,
CAST(CASE WHEN n_outer = 1 THEN 1 + n_inner ELSE n_outer END AS BIGINT) AS n_rings,
CASE WHEN n_outer = 1 THEN (outer_a2 - inner_a2) / 2.0 ELSE outer_a2 / 2.0 END AS area FROM rg"""
ORACLE["osm_buildings"] = OSM_BASE + "SELECT feature_id, gtype, area FROM bld"
ORACLE["top10_area"] = OSM_BASE + "SELECT feature_id, area AS area_sqm FROM bld ORDER BY area DESC, feature_id LIMIT 10"
ORACLE["osm_drop_metadata_tags"] = """SELECT o_orderkey AS way_id,
CASE WHEN o_orderpriority = '1-URGENT' THEN 'building,highway,status' ELSE 'highway,status' END AS keys FROM orders"""
ORACLE["osm_tags_to_columns"] = """SELECT o_orderkey AS way_id, o_orderpriority AS highway, o_orderstatus AS status,
CASE WHEN o_orderpriority = '1-URGENT' THEN 'yes' END AS building FROM orders"""
ORACLE["tags_filter"] = """SELECT o_orderkey AS way_id FROM orders
WHERE o_orderpriority IN ('2-HIGH', '3-MEDIUM') OR o_orderpriority = '1-URGENT'"""
ORACLE["tags_filter_all"] = """SELECT o_orderkey AS way_id FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW')"""
ORACLE["map_lookup"] = "SELECT o_orderkey AS way_id FROM orders WHERE o_orderpriority = '5-LOW'"
ORACLE["list_to_string"] = """SELECT o.o_orderkey AS way_id, coalesce(string_agg(CAST(w.node_id AS VARCHAR), ',' ORDER BY w.pos), '') AS refs
FROM orders o LEFT JOIN (SELECT l_orderkey AS way_id, l_partkey AS node_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos
  FROM lineitem) w ON w.way_id = o.o_orderkey GROUP BY o.o_orderkey"""
ORACLE["map_list_functions"] = """SELECT o.o_orderkey AS way_id,
CAST(CASE WHEN o.o_orderpriority = '1-URGENT' THEN 5 ELSE 4 END AS BIGINT) AS n_tags, o.o_orderstatus AS status,
CAST(count(w.node_id) AS BIGINT) AS n_refs, min_by(w.node_id, w.pos) AS first_ref, max(w.node_id) AS max_ref
FROM orders o LEFT JOIN (SELECT l_orderkey AS way_id, l_partkey AS node_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos
  FROM lineitem) w ON w.way_id = o.o_orderkey GROUP BY o.o_orderkey, o.o_orderpriority, o.o_orderstatus"""

# nodes inside-or-on polygon 12
P12_NODES = f"""p12n AS (SELECT c.pid AS id FROM (
    SELECT p.id AS pid, p.x, p.y FROM prt p JOIN pbb g ON g.id = 12
      AND p.x BETWEEN g.minx AND g.maxx AND p.y BETWEEN g.miny AND g.maxy) c
  JOIN pseg s ON s.id = 12 GROUP BY c.pid
  HAVING SUM(CASE WHEN {ray('c.x', 'c.y')} THEN 1 ELSE 0 END) % 2 = 1
      OR MAX(CASE WHEN {onseg('c.x', 'c.y')} THEN 1 ELSE 0 END) = 1)"""
ORACLE["osm_regional_extract"] = with_(PTS_PART, POLY_V, POLY_SEG, POLY_BB, P12_NODES) + """,
sel_ways AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_partkey IN (SELECT id FROM p12n)),
sel_nodes AS (SELECT l_partkey AS id FROM lineitem WHERE l_orderkey IN (SELECT id FROM sel_ways) UNION SELECT id FROM p12n)
SELECT 'node' AS kind, id FROM sel_nodes
UNION ALL SELECT 'way', id FROM sel_ways
UNION ALL SELECT DISTINCT 'relation', o_custkey FROM orders WHERE o_orderkey IN (SELECT id FROM sel_ways)"""

# building rings (closed) for the polygon-polygon intersection test
BRINGS = """brv AS (
  SELECT 'r' || CAST(m.rel_id AS VARCHAR) AS fid,
         CASE WHEN r.n_outer = 1 THEN 0 ELSE m.way_id END AS part, m.way_id AS ring, p.pos, p.x, p.y
  FROM mem m JOIN rg r ON r.rel_id = m.rel_id JOIN wgeo g ON g.way_id = m.way_id JOIN wpt p ON p.way_id = m.way_id
  WHERE r.n_outer = 1 OR m.role = 'outer'
  UNION ALL
  SELECT 'w' || CAST(g.way_id AS VARCHAR), 0, g.way_id, p.pos, p.x, p.y
  FROM wgeo g JOIN ways w ON w.way_id = g.way_id JOIN wpt p ON p.way_id = g.way_id
  WHERE w.building AND g.way_id NOT IN (SELECT way_id FROM mem)),
brs AS (SELECT fid, part, ring, x AS ax, y AS ay,
               coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by
        FROM brv WINDOW w AS (PARTITION BY fid, ring ORDER BY pos))"""
ORACLE["osm_extract_in_boundary"] = with_(PTS_PART, WAY_PTS, WAYS, RELS, POLY_V, POLY_SEG, POLY_BB, BRINGS) + f""",
hit_v AS (SELECT c.fid FROM (SELECT DISTINCT fid, x, y FROM brv) c JOIN pseg s ON s.id = 12
          GROUP BY c.fid, c.x, c.y
          HAVING SUM(CASE WHEN {ray('c.x', 'c.y')} THEN 1 ELSE 0 END) % 2 = 1
              OR MAX(CASE WHEN {onseg('c.x', 'c.y')} THEN 1 ELSE 0 END) = 1),
hit_p AS (SELECT s.fid FROM (SELECT x, y FROM pv WHERE id = 12) c JOIN brs s ON TRUE
          GROUP BY s.fid, s.part, c.x, c.y
          HAVING SUM(CASE WHEN {ray('c.x', 'c.y')} THEN 1 ELSE 0 END) % 2 = 1
              OR MAX(CASE WHEN {onseg('c.x', 'c.y')} THEN 1 ELSE 0 END) = 1),
hit_s AS (SELECT a.fid FROM brs a JOIN pseg s ON s.id = 12 WHERE {seg_intersects('a', 's')})
SELECT DISTINCT fid AS feature_id FROM (SELECT fid FROM hit_v UNION ALL SELECT fid FROM hit_p UNION ALL SELECT fid FROM hit_s)"""


# ---------------------------------------------------------------- raster batch

PX = """px AS (SELECT CAST((o_orderkey - o_orderkey % 100) / 100 AS BIGINT) AS row, CAST(o_orderkey % 100 AS BIGINT) AS col,
  CAST((o_orderkey * 31) % 50 AS DOUBLE) AS value FROM orders),
hdr AS (SELECT CAST(max(o_orderkey) // 100 + 1 AS BIGINT) AS height FROM orders)"""
PXC = """pxc AS (SELECT row, col, value, 0.0 + (col + 0.5) * 1000.0 AS x, 100000.0 + (row + 0.5) * (-1000.0) AS y FROM px)"""
ZONE = f"""zp AS (SELECT c.gid, c.row, c.col, c.value FROM (
    SELECT g.id AS gid, p.row, p.col, p.value, p.x, p.y FROM pxc p JOIN pbb g
      ON p.x BETWEEN g.minx AND g.maxx AND p.y BETWEEN g.miny AND g.maxy WHERE g.id <> 3) c
  JOIN pseg s ON s.id = c.gid GROUP BY c.gid, c.row, c.col, c.value
  HAVING SUM(CASE WHEN {ray('c.x', 'c.y')} THEN 1 ELSE 0 END) % 2 = 1
      OR MAX(CASE WHEN {onseg('c.x', 'c.y')} THEN 1 ELSE 0 END) = 1)"""
RZ = with_(PX, PXC, POLY_V, POLY_SEG, POLY_BB, ZONE)

ORACLE["raster_tiles_summary"] = with_(PX) + """SELECT 1 AS band, CAST(floor(row / 32) AS BIGINT) AS tile_row,
CAST(floor(col / 32) AS BIGINT) AS tile_col, CAST(count(*) FILTER (WHERE value <> 0) AS BIGINT) AS n_valid,
coalesce(sum(value) FILTER (WHERE value <> 0), 0.0) AS sum_valid FROM px GROUP BY 2, 3"""
ORACLE["raster_pixels_roundtrip"] = with_(PX) + "SELECT row, col, value FROM px"
ORACLE["raster_mosaic"] = with_(PX) + """, b AS (SELECT CAST((o_orderkey - o_orderkey % 100) / 100 + 3 AS BIGINT) AS row,
  CAST(o_orderkey % 100 + 50 AS BIGINT) AS col, CAST((o_orderkey * 17) % 50 AS DOUBLE) AS value FROM orders)
SELECT row, col, value FROM b UNION ALL
SELECT row, col, value FROM px WHERE (row, col) NOT IN (SELECT (row, col) FROM b)"""
ORACLE["raster_info"] = with_(PX) + """SELECT CAST(100 AS BIGINT) AS width, height, CAST(1 AS BIGINT) AS bands,
CAST(ceil(height / 32.0) * 4 AS BIGINT) AS n_tiles, 0.0 AS minx, 100000.0 - height * 1000.0 AS miny,
100000.0 AS maxx, 100000.0 AS maxy, 1000000.0 AS pixel_area, 1000000.0 * 100 * height / 1e6 AS area_km2 FROM hdr"""
ORACLE["band_read"] = with_(PX) + "SELECT CAST(count(*) AS BIGINT) AS n_pixels, sum(value) AS sum_value FROM px"
ORACLE["raster_window"] = with_(PX) + """SELECT row - 20 AS row, col - 10 AS col, value, 10000.0 AS ulx, 80000.0 AS uly
FROM px WHERE row >= 20 AND row < 60 AND col >= 10 AND col < 40"""
ORACLE["nodata_mask"] = with_(PX) + """SELECT CAST(count(*) FILTER (WHERE value <> 0) AS BIGINT) AS n_valid,
round(avg(value) FILTER (WHERE value <> 0), 6) AS mean_valid FROM px"""


def _resampled(rows: str, cols: int, more: str = "") -> str:
    """Every cell against the pixels under it, weighted by the shared area."""
    return with_(PX) + f""", cells AS (SELECT r, c FROM (SELECT unnest(range({rows})) AS r FROM hdr), (SELECT unnest(range({cols})) AS c)),
shared AS (SELECT r, c, value, height,
    (least((row + 1) * ({rows}), (r + 1) * height) - greatest(row * ({rows}), r * height))
    * (least((col + 1) * {cols}, (c + 1) * 100) - greatest(col * {cols}, c * 100)) AS w
  FROM cells, hdr, px WHERE row * ({rows}) < (r + 1) * height AND (row + 1) * ({rows}) > r * height
    AND col * {cols} < (c + 1) * 100 AND (col + 1) * {cols} > c * 100)
SELECT CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col,
  round(sum(value * w) FILTER (WHERE value <> 0) / sum(w) FILTER (WHERE value <> 0), 6) AS value{more}
FROM shared GROUP BY r, c"""


ORACLE["resample_average"] = _resampled("height // 5", 10)
ORACLE["resample_50x50"] = _resampled("50", 50, ", 2000.0 AS px, round(any_value(-1000.0 * height / 50), 6) AS py")
ORACLE["class_counts"] = with_(PX) + """SELECT value AS class, CAST(count(*) AS BIGINT) AS n,
round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM px WHERE value <> 0 GROUP BY value"""
ORACLE["pixel_histogram"] = with_(PX) + """, cnt AS (SELECT CAST(least(floor((value - 0) / 50.0 * 50), 49) AS BIGINT) AS bin,
  count(*) AS n FROM px WHERE value BETWEEN 0 AND 50 GROUP BY 1)
SELECT b.bin, round(b.bin * 1.0, 6) AS bin_lo, round(b.bin + 1.0, 6) AS bin_hi, CAST(coalesce(cnt.n, 0) AS BIGINT) AS count
FROM (SELECT range AS bin FROM range(50)) b LEFT JOIN cnt ON cnt.bin = b.bin"""
ORACLE["class_mask"] = with_(PX) + """SELECT CAST(count(*) FILTER (WHERE value BETWEEN 1 AND 11) AS BIGINT) AS n_in_mask,
CAST(count(*) FILTER (WHERE NOT value BETWEEN 1 AND 11) AS BIGINT) AS n_outside FROM px"""
ORACLE["class_area_ha"] = with_(PX) + """SELECT value AS class, count(*) * 1000000.0 / 1e4 AS area_ha FROM px
WHERE value <> 0 GROUP BY value"""
ORACLE["raster_clip"] = RZ + "SELECT row, col, value FROM zp WHERE gid = 12"
ORACLE["raster_clip_sum"] = RZ + """SELECT sum(value) FILTER (WHERE value <> 0) AS total,
CAST(count(*) FILTER (WHERE value <> 0) AS BIGINT) AS n_pixels FROM zp WHERE gid = 12"""
ORACLE["zonal_stats_sum"] = RZ + """SELECT g.id, sum(z.value) FILTER (WHERE z.value > 0 AND z.value < 1e10) AS sum,
CAST(count(z.value) FILTER (WHERE z.value > 0 AND z.value < 1e10) AS BIGINT) AS count
FROM (SELECT DISTINCT id FROM pv WHERE id <> 3) g LEFT JOIN zp z ON z.gid = g.id GROUP BY g.id"""
ORACLE["zonal_mean"] = RZ + """SELECT g.id, round(avg(z.value) FILTER (WHERE z.value <> 0), 6) AS mean,
min(z.value) FILTER (WHERE z.value <> 0) AS min, max(z.value) FILTER (WHERE z.value <> 0) AS max
FROM (SELECT DISTINCT id FROM pv WHERE id <> 3) g LEFT JOIN zp z ON z.gid = g.id GROUP BY g.id"""
ORACLE["region_total"] = RZ + """SELECT sum(s) AS total, CAST(count(*) AS BIGINT) AS n_zones FROM (
  SELECT gid, sum(value) FILTER (WHERE value > 0 AND value < 1e10) AS s FROM zp GROUP BY gid)"""


# ---------------------------------------------------------------- network batch

GE = """ge AS (SELECT o_orderkey AS edge_id, o_custkey AS u, (o_custkey * 7 + o_orderkey % 3) % (SELECT count(*) FROM customer) AS v,
  1 + (o_orderkey * 17) % 97 AS length FROM orders WHERE o_orderkey % 20 = 0)"""
# every order is a street
STREETS = GE.replace(" WHERE o_orderkey % 20 = 0", "")
OSM_GRAPH = """wnd AS (SELECT l.l_orderkey AS way_id, l.l_partkey AS node,
  row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) - 1 AS pos,
  o.o_orderstatus = 'F' AS oneway
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH')),
uses AS (SELECT node, count(*) AS uses FROM wnd GROUP BY node),
r1 AS (SELECT w.*, u.uses, max(w.pos) OVER (PARTITION BY w.way_id) AS last,
  lead(w.node) OVER (PARTITION BY w.way_id ORDER BY w.pos) AS nxt FROM wnd w JOIN uses u ON u.node = w.node),
r2 AS (SELECT *, sum(CASE WHEN pos = 0 OR pos = last OR uses >= 2 THEN 1 ELSE 0 END)
  OVER (PARTITION BY way_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS e FROM r1),
gseg AS (SELECT r2.*, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len
  FROM r2 JOIN prt a ON a.id = r2.node JOIN prt b ON b.id = r2.nxt WHERE r2.nxt IS NOT NULL),
ge1 AS (SELECT way_id, e, oneway, min_by(node, pos) AS u, max_by(nxt, pos) AS v, sum(len) AS length
  FROM gseg GROUP BY way_id, e, oneway),
gboth AS (SELECT * FROM ge1 UNION ALL SELECT way_id, e, oneway, v AS u, u AS v, length FROM ge1 WHERE NOT oneway)"""

ORACLE["graph_build"] = with_(PTS_PART, OSM_GRAPH) + """SELECT u, v,
CAST(row_number() OVER (PARTITION BY u, v ORDER BY way_id, e, oneway DESC) - 1 AS BIGINT) AS key, way_id,
round(length, 6) AS length FROM gboth"""
ORACLE["graph_build_largest"] = "WITH RECURSIVE" + with_(PTS_PART, OSM_GRAPH.replace(
    "uses AS (", "known AS (SELECT id FROM prt WHERE id % 50 <> 7),\nuses AS (").replace(
    "r1 AS (SELECT w.*, u.uses, max(w.pos) OVER (PARTITION BY w.way_id) AS last,\n", "r1 AS (SELECT w.*, u.uses,\n").replace(
    "r2 AS (SELECT *, sum(CASE WHEN pos = 0 OR pos = last OR uses >= 2 THEN 1 ELSE 0 END)",
    """r1k AS (SELECT *, node IN (SELECT id FROM known) AS here, coalesce(nxt IN (SELECT id FROM known), FALSE) AS there,
  coalesce(lag(node) OVER (PARTITION BY way_id ORDER BY pos) IN (SELECT id FROM known), FALSE) AS behind FROM r1),
r2 AS (SELECT *, sum(CASE WHEN NOT behind OR NOT there OR uses >= 2 THEN 1 ELSE 0 END)""").replace(
    "ROWS UNBOUNDED PRECEDING) - 1 AS e FROM r1)", "ROWS UNBOUNDED PRECEDING) - 1 AS e FROM r1k)").replace(
    "WHERE r2.nxt IS NOT NULL)", "WHERE r2.here AND r2.there)"))[4:] + """,
und AS (SELECT u, v FROM ge1 UNION SELECT v, u FROM ge1),
lab(node, label) USING KEY (node) AS (
  SELECT u, u FROM und
  UNION
  (SELECT und.v, min(lab.label) FROM lab JOIN und ON und.u = lab.node
   WHERE NOT EXISTS (SELECT 1 FROM recurring.lab x WHERE x.node = und.v AND x.label <= lab.label) GROUP BY und.v)),
big AS (SELECT label FROM lab GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT u, v, CAST(row_number() OVER (PARTITION BY u, v ORDER BY way_id, e, oneway DESC) - 1 AS BIGINT) AS key, way_id,
  round(length, 6) AS length FROM gboth WHERE u IN (SELECT node FROM lab WHERE label = (SELECT label FROM big))"""
ORACLE["graph_nodes"] = with_(PTS_PART, OSM_GRAPH) + """SELECT p.id, p.x, p.y FROM prt p
WHERE p.id IN (SELECT u FROM ge1 UNION SELECT v FROM ge1)"""
ORACLE["undirected_edges"] = with_(STREETS) + "SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM ge"
CC = "WITH RECURSIVE " + GE + """,
und AS (SELECT u, v FROM ge UNION SELECT v, u FROM ge),
r(node, label) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT und.v, r.label FROM r JOIN und ON und.u = r.node),
cc AS (SELECT node AS node_id, min(label) AS component FROM r GROUP BY node)
"""
ORACLE["connected_components"] = CC + "SELECT node_id, component FROM cc"
ORACLE["component_count"] = CC + "SELECT CAST(count(DISTINCT component) AS BIGINT) AS n_components FROM cc"
DEG = with_(STREETS) + """, deg AS (SELECT c.c_custkey AS id, CAST(coalesce(d.n, 0) AS BIGINT) AS degree FROM customer c
  LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT u AS id FROM ge UNION ALL SELECT v FROM ge) GROUP BY id) d ON d.id = c.c_custkey)
"""
ORACLE["degree_distribution"] = DEG + "SELECT degree, CAST(count(*) AS BIGINT) AS n_nodes FROM deg GROUP BY degree"
ORACLE["edge_length_stats"] = with_(STREETS) + """SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length) AS BIGINT) AS total,
round(avg(length), 6) AS mean, min(length) AS min, max(length) AS max FROM ge"""
ORACLE["network_stats"] = (DEG.replace("WITH ", "WITH " + PTS_CUSTOMER + ",\n", 1) + """, st AS (
  SELECT count(*) AS m, CAST(sum(length) AS DOUBLE) AS total,
         sum(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))) AS straight
  FROM ge JOIN pts a ON a.id = ge.u JOIN pts b ON b.id = ge.v)
SELECT CAST((SELECT count(*) FROM deg) AS BIGINT) AS n, CAST(m AS BIGINT) AS m,
  round(2.0 * m / (SELECT count(*) FROM deg), 6) AS k_avg, round(total, 6) AS edge_length_total,
  round(total / m, 6) AS edge_length_avg, round((SELECT avg(degree) FROM deg), 6) AS streets_per_node_avg,
  CAST((SELECT count(*) FROM deg WHERE degree > 1) AS BIGINT) AS intersection_count,
  round(total / straight, 6) AS circuity_avg FROM st""")
SP = "WITH RECURSIVE " + GE + """,
arcs AS (SELECT u, v, min(length) AS length FROM (SELECT u, v, length FROM ge UNION ALL SELECT v, u, length FROM ge) GROUP BY u, v),
d(src, node, dist) USING KEY (src, node) AS (
  SELECT c_custkey, c_custkey, CAST(0 AS BIGINT) FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION
  (SELECT d.src, a.v, min(d.dist + a.length) FROM d JOIN arcs a ON a.u = d.node
   WHERE NOT EXISTS (SELECT 1 FROM recurring.d rr WHERE rr.src = d.src AND rr.node = a.v AND rr.dist <= d.dist + a.length)
   GROUP BY d.src, a.v))
"""
ORACLE["shortest_paths"] = SP + "SELECT src AS source, node AS target, CAST(dist AS BIGINT) AS dist FROM d"
# least (distance, node path) per source and node; the farthest node of each source
ROUTES = "WITH RECURSIVE " + GE + """,
arcs AS MATERIALIZED (SELECT u, v, min(length) AS length FROM (SELECT u, v, length FROM ge UNION ALL SELECT v, u, length FROM ge)
  GROUP BY u, v),
d(src, node, s) USING KEY (src, node) AS (
  SELECT c_custkey, c_custkey, {'dist': CAST(0 AS BIGINT), 'path': [c_custkey]} FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION
  (SELECT c.src, c.v, min(c.s2) FROM (
     SELECT d.src, a.v, {'dist': d.s.dist + a.length, 'path': list_append(d.s.path, a.v)} AS s2 FROM d JOIN arcs a ON a.u = d.node) c
   WHERE NOT EXISTS (SELECT 1 FROM recurring.d rr WHERE rr.src = c.src AND rr.node = c.v AND rr.s <= c.s2) GROUP BY c.src, c.v)),
far AS MATERIALIZED (SELECT src, node, s.path AS path, s.dist AS dist
  FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s.dist DESC, node) AS rk FROM d) WHERE rk = 1)"""
ORACLE["route_edges"] = ROUTES + """,
steps AS (SELECT src AS route, unnest(range(len(path) - 1)) AS seq, path FROM far),
two AS (SELECT u, v, length, edge_id AS key FROM ge UNION ALL SELECT v, u, length, edge_id FROM ge)
SELECT route, CAST(seq AS INTEGER) AS seq, path[seq + 1] AS u, path[seq + 2] AS v,
  (SELECT arg_min(key, (length, key)) FROM two WHERE two.u = path[seq + 1] AND two.v = path[seq + 2]) AS key,
  (SELECT min(length) FROM two WHERE two.u = path[seq + 1] AND two.v = path[seq + 2]) AS length
FROM steps"""
# every simple path, counted off
ORACLE["k_shortest_paths"] = ROUTES + """,
walk(src, node, cost, path) AS (
  SELECT src, src, CAST(0 AS BIGINT), [src] FROM far WHERE dist > 0
  UNION ALL
  SELECT w.src, a.v, w.cost + a.length, list_append(w.path, a.v) FROM walk w JOIN arcs a ON a.u = w.node WHERE NOT list_contains(w.path, a.v)),
found AS (SELECT w.src, w.node AS dst, w.cost, w.path, row_number() OVER (PARTITION BY w.src ORDER BY w.cost, w.path) - 1 AS rank
  FROM walk w JOIN far f ON f.src = w.src AND f.node = w.node)
SELECT src, dst, CAST(rank AS INTEGER) AS rank, cost, CAST(len(path) AS INTEGER) AS n_nodes FROM found WHERE rank < 10"""
# distance and number of edges in one number; predecessors from the end
ORACLE["shortest_path_pairs"] = "WITH RECURSIVE " + GE + """,
arcs AS MATERIALIZED (SELECT u, v, min(length) * 1000000 + 1 AS cost FROM (SELECT u, v, length FROM ge UNION ALL SELECT v, u, length FROM ge)
  WHERE u <> v GROUP BY u, v),
pairs AS MATERIALIZED (SELECT DISTINCT a.u AS src, c.v AS dst FROM ge a JOIN ge b ON b.u = a.v JOIN ge c ON c.u = b.v
  UNION SELECT c_custkey, c_custkey + 1 FROM customer WHERE c_custkey % 50 = 0),
d(src, node, cost) USING KEY (src, node) AS (
  SELECT DISTINCT src, src, CAST(0 AS BIGINT) FROM pairs
  UNION
  (SELECT d.src, a.v, min(d.cost + a.cost) FROM d JOIN arcs a ON a.u = d.node
   WHERE NOT EXISTS (SELECT 1 FROM recurring.d rr WHERE rr.src = d.src AND rr.node = a.v AND rr.cost <= d.cost + a.cost)
   GROUP BY d.src, a.v)),
back AS MATERIALIZED (SELECT n.src, n.node, min(p.node) AS pred FROM d n JOIN arcs a ON a.v = n.node
  JOIN d p ON p.src = n.src AND p.node = a.u AND p.cost + a.cost = n.cost GROUP BY n.src, n.node),
walk(src, dst, node, path) AS (
  SELECT src, dst, dst, CAST(dst AS VARCHAR) FROM pairs
  UNION ALL
  SELECT w.src, w.dst, b.pred, b.pred || '-' || w.path FROM walk w JOIN back b ON b.src = w.src AND b.node = w.node WHERE w.node <> w.src)
SELECT p.src, p.dst, CAST(d.cost // 1000000 AS BIGINT) AS dist, CAST(d.cost % 1000000 AS BIGINT) AS n_edges, w.path
FROM pairs p LEFT JOIN d ON d.src = p.src AND d.node = p.dst LEFT JOIN walk w ON w.src = p.src AND w.dst = p.dst AND w.node = p.src"""
ORACLE["dbscan"] = "WITH RECURSIVE " + PTS_PART + """,
pr AS (SELECT a.id AS a, b.id AS b FROM prt a JOIN prt b
  ON b.x BETWEEN a.x - 2500 AND a.x + 2500 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2500e0 * 2500e0),
core AS (SELECT a AS id FROM pr GROUP BY a HAVING count(*) >= 5),
ce AS (SELECT a, b FROM pr WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core) AND a <> b),
r(node, label) AS (SELECT id, id FROM core UNION SELECT ce.b, r.label FROM r JOIN ce ON ce.a = r.node),
comp AS (SELECT node AS id, min(label) AS component FROM r GROUP BY node),
border AS (SELECT p.a AS id, min(c.component) AS component FROM pr p JOIN comp c ON c.id = p.b
  WHERE p.a NOT IN (SELECT id FROM core) GROUP BY p.a),
lab AS (SELECT p.id, CAST(coalesce(c.component, b.component, -1) AS BIGINT) AS label, p.id IN (SELECT id FROM core) AS is_core
  FROM prt p LEFT JOIN comp c ON c.id = p.id LEFT JOIN border b ON b.id = p.id)
"""
ORACLE["dbscan_summary"] = ORACLE["dbscan"] + """SELECT CAST(count(DISTINCT label) FILTER (WHERE label >= 0) AS BIGINT) AS n_clusters,
CAST(count(*) FILTER (WHERE label < 0) AS BIGINT) AS n_noise FROM lab"""
ORACLE["dbscan"] += "SELECT id, label, is_core FROM lab"


def _project_graph_sql():
    from geoq.functions.crs import sql_xy
    x, y = sql_xy("lon", "lat", 32632)
    return ("""WITH ll AS (SELECT c_custkey AS id, 6e0+((c_custkey*7919)%10007)*6e0/10007e0 AS lon,
  44e0+((c_custkey*104729)%10009)*2e0/10009e0 AS lat FROM customer)
SELECT id, round(""" + x + ", 3) AS x, round(" + y + """, 3) AS y,
  CAST(floor((avg(lon) OVER () + 180) / 6) + 1 AS INTEGER) AS zone FROM ll""")


ORACLE["project_graph"] = _project_graph_sql()


def utm32_ctes(points: str) -> str:
    """``utm(<columns of points>, e, n)`` from a CTE with lon, lat: Krueger's
    series to n^4 over the conformal latitude (below 1e-7 m from more terms),
    step by step and not by the library's formulas."""
    return f"""k0 AS (SELECT n, 6378137e0/(1+n)*(1+n*n/4+n*n*n*n/64) AS ra, n/2-2*n*n/3+5*n*n*n/16+41*n*n*n*n/180 AS c1,
  13*n*n/48-3*n*n*n/5+557*n*n*n*n/1440 AS c2, 61*n*n*n/240-103*n*n*n*n/140 AS c3, 49561*n*n*n*n/161280 AS c4, 2*sqrt(n)/(1+n) AS ee
  FROM (SELECT (1e0/298.257223563e0)/(2-1e0/298.257223563e0) AS n)),
conf AS (SELECT p.*, k0.*, sinh(atanh(sin(radians(lat))) - ee*atanh(ee*sin(radians(lat)))) AS tt, radians(lon-9) AS dl FROM {points} p, k0),
tm AS (SELECT *, atan(tt/cos(dl)) AS xi, asinh(sin(dl)/sqrt(tt*tt+cos(dl)*cos(dl))) AS et FROM conf),
utm AS (SELECT * EXCLUDE (n, ra, c1, c2, c3, c4, ee, tt, dl, xi, et),
  500000+0.9996e0*ra*(et+c1*cos(2*xi)*sinh(2*et)+c2*cos(4*xi)*sinh(4*et)+c3*cos(6*xi)*sinh(6*et)+c4*cos(8*xi)*sinh(8*et)) AS e,
  0.9996e0*ra*(xi+c1*sin(2*xi)*cosh(2*et)+c2*sin(4*xi)*cosh(4*et)+c3*sin(6*xi)*cosh(6*et)+c4*sin(8*xi)*cosh(8*et)) AS nn FROM tm)"""


_LONLAT = "9e0+x/80000e0 AS lon, 45e0+y/110000e0 AS lat"
ORACLE["top10_area_utm"] = with_(
    f"""fp AS (SELECT o_orderkey AS id, v.seq AS seq, {_LONLAT} FROM (SELECT o_orderkey, seq,
  ((o_orderkey*7919)%100003)*1e0 + CASE WHEN seq IN (1,2) THEN 20+(o_orderkey*13)%180 ELSE 0 END AS x,
  ((o_orderkey*104729)%100019)*1e0 + CASE WHEN seq IN (2,3) THEN 20+(o_orderkey*29)%140 ELSE 0 END AS y
  FROM orders CROSS JOIN (VALUES (0),(1),(2),(3)) AS s(seq)) v)""", utm32_ctes("fp"),
    """diag AS (SELECT id, max(e) FILTER (WHERE seq=2)-max(e) FILTER (WHERE seq=0) AS ax, max(nn) FILTER (WHERE seq=2)-max(nn) FILTER (WHERE seq=0) AS ay,
  max(e) FILTER (WHERE seq=3)-max(e) FILTER (WHERE seq=1) AS bx, max(nn) FILTER (WHERE seq=3)-max(nn) FILTER (WHERE seq=1) AS b2 FROM utm GROUP BY id)""",
    "ar AS (SELECT id, abs(ax*b2-ay*bx)/2 AS area FROM diag)") + """SELECT id AS feature_id, round(area, 2) AS area_sqm
FROM ar ORDER BY area DESC, id LIMIT 10"""
ORACLE["distance_anti_utm"] = with_(
    PTS_CUSTOMER, PTS_SUPPLIER, f"ll AS (SELECT id, 0 AS side, {_LONLAT} FROM pts UNION ALL SELECT id, 1, {_LONLAT} FROM sup)",
    utm32_ctes("ll")) + """SELECT c.id AS cust_id, round(c.e, 3) AS x, round(c.nn, 3) AS y FROM utm c WHERE c.side = 0 AND NOT EXISTS (
SELECT 1 FROM utm s WHERE s.side = 1 AND (c.e-s.e)*(c.e-s.e)+(c.nn-s.nn)*(c.nn-s.nn) <= 2500e0*2500e0)"""
ORACLE["transform_length_sql"] = with_(
    LINE_V, f"ll AS (SELECT id, seq, highway, {_LONLAT} FROM lv)", utm32_ctes("ll")) + """SELECT a.highway,
count(DISTINCT a.id) AS n, round(sum(sqrt((b.e-a.e)*(b.e-a.e)+(b.nn-a.nn)*(b.nn-a.nn))), 2) AS length_m
FROM utm a JOIN utm b ON a.id=b.id AND b.seq=a.seq+1 GROUP BY a.highway"""


# ---------------------------------------------------------------- overlay batch

FOOT_V = """fp AS (SELECT o_orderkey AS id, o_orderpriority AS kind,
  CAST((o_orderkey*7919)%100003 AS DOUBLE) AS x0, CAST((o_orderkey*104729)%100019 AS DOUBLE) AS y0,
  CAST(20 + (o_orderkey*13)%180 AS DOUBLE) AS w, CAST(20 + (o_orderkey*29)%140 AS DOUBLE) AS h FROM orders)"""


def slab_sweep(segs_cte: str, rule: str, out: str) -> str:
    """Global slab sweep over ``osg(poly, role, ax, ay, bx, by)`` (non-horizontal
    edges): cuts at vertex ordinates and proper crossings."""
    return f""", {segs_cte},
cx AS (SELECT l.ay + ((r.ax - l.ax) * (r.by - r.ay) - (r.ay - l.ay) * (r.bx - r.ax))
                   / ((l.bx - l.ax) * (r.by - r.ay) - (l.by - l.ay) * (r.bx - r.ax)) * (l.by - l.ay) AS y
       FROM osg l JOIN osg r ON l.k < r.k
        AND least(l.ax, l.bx) <= greatest(r.ax, r.bx) AND least(r.ax, r.bx) <= greatest(l.ax, l.bx)
        AND least(l.ay, l.by) <= greatest(r.ay, r.by) AND least(r.ay, r.by) <= greatest(l.ay, l.by)
       WHERE sign((l.bx - l.ax) * (r.ay - l.ay) - (l.by - l.ay) * (r.ax - l.ax))
           * sign((l.bx - l.ax) * (r.by - l.ay) - (l.by - l.ay) * (r.bx - l.ax)) < 0
         AND sign((r.bx - r.ax) * (l.ay - r.ay) - (r.by - r.ay) * (l.ax - r.ax))
           * sign((r.bx - r.ax) * (l.by - r.ay) - (r.by - r.ay) * (l.bx - r.ax)) < 0),
brk AS (SELECT DISTINCT y FROM (SELECT o.ay AS y FROM osg o UNION ALL SELECT o.by FROM osg o UNION ALL SELECT y FROM cx)),
slab AS (SELECT * FROM (SELECT y AS y0, lead(y) OVER (ORDER BY y) AS y1 FROM brk) WHERE y1 IS NOT NULL),
ss AS (SELECT sl.y0, sl.y1, s.poly, s.role,
              s.ax + ((sl.y0 + sl.y1) / 2.0 - s.ay) * (s.bx - s.ax) / (s.by - s.ay) AS xm
       FROM slab sl JOIN osg s ON sl.y0 >= least(s.ay, s.by) AND sl.y1 <= greatest(s.ay, s.by)),
st AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY y0, poly ORDER BY xm) % 2 = 1 THEN 1 ELSE -1 END AS d FROM ss),
cum AS (SELECT *, sum(CASE WHEN role = 'B' THEN d ELSE 0 END) OVER w AS nb,
               sum(CASE WHEN role = 'P' THEN d ELSE 0 END) OVER w AS np,
               lead(xm) OVER w2 AS nx
        FROM st WINDOW w AS (PARTITION BY y0 ORDER BY xm, poly ROWS UNBOUNDED PRECEDING),
                       w2 AS (PARTITION BY y0 ORDER BY xm, poly))
SELECT round(sum(CASE WHEN {rule} AND nx IS NOT NULL THEN (nx - xm) * (y1 - y0) ELSE 0 END), 3) AS {out} FROM cum"""


PARK_SEGS = """osg AS (SELECT 'P:' || CAST(q.id AS VARCHAR) AS poly, 'P' AS role, row_number() OVER () AS k, q.ax, q.ay, q.bx, q.by FROM (
  SELECT id, x0 AS ax, y0 AS ay, x0 AS bx, y0 + h AS by FROM fp WHERE kind = '3-MEDIUM'
  UNION ALL SELECT id, x0 + w, y0, x0 + w, y0 + h FROM fp WHERE kind = '3-MEDIUM') q)"""
ORACLE["union_area_parks"] = with_(FOOT_V).rstrip("\n") + slab_sweep(PARK_SEGS, "np > 0", "union_area")
NAT_SEGS = """osg AS (SELECT 'P:' || CAST(s.id AS VARCHAR) AS poly, 'P' AS role, row_number() OVER () AS k, s.ax, s.ay, s.bx, s.by
  FROM pseg s WHERE s.id <> 3 AND s.ay <> s.by)"""
ORACLE["union_area_polygons"] = with_(POLY_V, POLY_SEG).rstrip("\n") + slab_sweep(NAT_SEGS, "np > 0", "union_area")
NONPARK_SEGS = """osg AS (SELECT q.poly, q.role, row_number() OVER () AS k, q.ax, q.ay, q.bx, q.by FROM (
  SELECT 'B:0' AS poly, 'B' AS role, s.ax, s.ay, s.bx, s.by FROM pseg s WHERE s.id = 12 AND s.ay <> s.by
  UNION ALL
  SELECT 'P:' || CAST(f.id AS VARCHAR), 'P', e.ax, e.ay, e.bx, e.by FROM fp f, pbb b,
    LATERAL (SELECT f.x0 AS ax, f.y0 AS ay, f.x0 AS bx, f.y0 + f.h AS by
             UNION ALL SELECT f.x0 + f.w, f.y0, f.x0 + f.w, f.y0 + f.h) e
  WHERE f.kind = '3-MEDIUM' AND b.id = 12 AND f.x0 <= b.maxx AND f.x0 + f.w >= b.minx
    AND f.y0 <= b.maxy AND f.y0 + f.h >= b.miny) q)"""
ORACLE["non_park_area"] = with_(FOOT_V, POLY_V, POLY_SEG, POLY_BB).rstrip("\n") + slab_sweep(
    NONPARK_SEGS, "nb > 0 AND np = 0", "non_park_area_sqm")


ORACLE["total_buffered_area"] = with_(FOOT_V) + """SELECT round(sum(w * h + 10.0 * (2 * (w + h))
  + 4 * (8 * 0.5 * 10.0 * 10.0 * sin(pi() / 2 / 8))), 3) AS total_buffered_area FROM fp"""
ORACLE["point_buffers"] = with_(PTS_CUSTOMER) + """SELECT round(count(*) * 32 * 0.5 * 100.0 * 100.0 * sin(2 * pi() / 32), 3)
  AS total_area, CAST(count(*) * 33 AS BIGINT) AS n_vertices FROM pts"""
ORACLE["wkb_round_trip"] = with_(POLY_V, POLY_SEG) + POLY_AREA + """, np AS (SELECT id, count(*) AS n, count(DISTINCT ring) AS nr
  FROM pv GROUP BY id)
SELECT a.id, CAST(1 + 4 + 4 + 4 * np.nr + 16 * np.n AS BIGINT) AS wkb_bytes, a.area, CAST(np.n AS BIGINT) AS num_points
FROM parea a JOIN np ON np.id = a.id WHERE a.id <> 3"""
ORACLE["bound_param_filter"] = with_(PTS_CUSTOMER) + """SELECT id AS point_id FROM pts
WHERE (x - 30000.0) * (x - 30000.0) + (y - 70000.0) * (y - 70000.0) <= 15000.0 * 15000.0"""
ORACLE["boundary_lookup"] = PIP_C + "SELECT DISTINCT pid AS point_id FROM pip WHERE gid = 12 AND nx % 2 = 1 AND onb = 0"
ORACLE["extract_many"] = PIP_C + f""", ft AS (
  SELECT id, 'restaurants' AS feature_type FROM pts WHERE kind = 'BUILDING'
  UNION ALL SELECT id, 'shops' FROM pts WHERE kind IN ('AUTOMOBILE', 'MACHINERY')
  UNION ALL SELECT id, 'homes' FROM pts WHERE kind = 'HOUSEHOLD'
  UNION ALL SELECT id, 'all_features' FROM pts)
SELECT n.n_name AS city, ft.feature_type, CAST(count(*) AS BIGINT) AS n_features
FROM {WITHIN} w JOIN ft ON ft.id = w.pid JOIN nation n ON n.n_nationkey = w.gid GROUP BY 1, 2"""


ORACLE["sql_functions"] = with_(POLY_V, POLY_SEG, POLY_BB) + POLY_AREA + f""", pin AS (
  SELECT c.id, MAX(CASE WHEN {onseg('c.px', 'c.py')} THEN 1 ELSE 0 END) AS onb,
         SUM(CASE WHEN {ray('c.px', 'c.py')} THEN 1 ELSE 0 END) AS nx
  FROM (SELECT id, minx + 1000 AS px, miny + 1000 AS py FROM pbb) c JOIN pseg s ON s.id = c.id GROUP BY c.id)
SELECT a.id, 'POLYGON' AS gtype, a.area, round(a.perimeter, 6) AS perimeter, 0.0 AS length,
  CAST((SELECT count(*) FROM pv WHERE pv.id = a.id) AS BIGINT) AS num_points, b.minx, b.maxy,
  (pin.nx % 2 = 1 AND pin.onb = 0) AS corner_inside,
  'POLYGON ((' || {num_txt('b.minx')} || ' ' || {num_txt('b.miny')} || ', ' || {num_txt('b.maxx')} || ' ' || {num_txt('b.miny')}
  || ', ' || {num_txt('b.maxx')} || ' ' || {num_txt('b.maxy')} || ', ' || {num_txt('b.minx')} || ' ' || {num_txt('b.maxy')}
  || ', ' || {num_txt('b.minx')} || ' ' || {num_txt('b.miny')} || '))' AS envelope
FROM parea a JOIN pbb b ON b.id = a.id JOIN pin ON pin.id = a.id WHERE a.id <> 3"""
ORACLE["sql_point_functions"] = with_(PTS_CUSTOMER) + """, d AS (SELECT id, x, y,
  x BETWEEN 40000 AND 60000 AND y BETWEEN 40000 AND 60000 AS inside,
  greatest(40000 - x, 0, x - 60000) AS dx, greatest(40000 - y, 0, y - 60000) AS dy FROM pts)
SELECT id AS point_id, CASE WHEN inside THEN 0.0 ELSE round(sqrt(dx * dx + dy * dy), 3) END AS dist, inside
FROM d WHERE dx * dx + dy * dy <= 3000e0 * 3000e0"""


ORACLE["candidate_join_back"] = with_(PTS_PART, LINE_V, LINE_SEG) + f"""
SELECT s.highway, CAST(count(DISTINCT t.id) AS BIGINT) AS n_nodes FROM prt t JOIN lseg s ON {seg_near('t.x', 't.y', 10)}
WHERE {pt_seg_within('t.x', 't.y', '10e0*10e0')} GROUP BY s.highway"""
