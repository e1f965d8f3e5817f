"""Coordinate transforms as column math.

Each projection is written once against a tiny math namespace and can be
rendered either as Spark ``Column`` expressions (``SPARK``) or as SQL text
(``SQL``), so an oracle query can evaluate the identical sequence of
floating-point operations.  Supported: EPSG:4326 <-> EPSG:3857 (Web
Mercator), EPSG:4326 -> UTM zones (EPSG:326zz / 327zz, Krueger n-series to
n^6), EPSG:4326 -> EPSG:3301 (Lambert conformal conic 2SP, GRS80) and
EPSG:4326 -> ESRI:54009 (Mollweide, fixed Newton steps).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoid and projection parameters (public EPSG definitions).
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
UTM_K0, UTM_FE, UTM_FN_SOUTH = 0.9996, 500000.0, 10000000.0
EST_LAT1, EST_LAT2, EST_LAT0, EST_LON0 = 58.0, 59.0 + 20.0 / 60.0, 57.51755393055556, 24.0
EST_FE, EST_FN = 500000.0, 6375000.0
MOLL_NEWTON_STEPS = 12


def _lit_sql(v: float) -> str:
    return format(float(v), ".17e")


class _S:
    """SQL text with arithmetic operators."""

    def __init__(self, s):
        self.s = s if isinstance(s, str) else _lit_sql(s)

    def _b(self, o, op, rev=False):
        o = o if isinstance(o, _S) else _S(o)
        a, b = (o, self) if rev else (self, o)
        return _S(f"({a.s} {op} {b.s})")

    def __add__(self, o): return self._b(o, "+")
    def __radd__(self, o): return self._b(o, "+", True)
    def __sub__(self, o): return self._b(o, "-")
    def __rsub__(self, o): return self._b(o, "-", True)
    def __mul__(self, o): return self._b(o, "*")
    def __rmul__(self, o): return self._b(o, "*", True)
    def __truediv__(self, o): return self._b(o, "/")
    def __rtruediv__(self, o): return self._b(o, "/", True)
    def __neg__(self): return _S(f"(-{self.s})")


class _SqlMath:
    def lit(self, v): return _S(v)

    def newton_fold(self, phi, target, steps):
        step = ("t - (2.0 * t + sin(2.0 * t) - {tg}) / (2.0 + 2.0 * cos(2.0 * t) + 1e-300)").format(tg=target.s)
        return _S(f"list_reduce(range({steps}), lambda t, i: {step}, {phi.s})")
    def __getattr__(self, name):
        fn = {"log": "ln"}.get(name, name)
        return lambda *a: _S(f"{fn}(" + ", ".join((x if isinstance(x, _S) else _S(x)).s for x in a) + ")")


class _SparkMath:
    _names = {"sign": "signum"}

    def lit(self, v): return F.lit(float(v))

    def newton_fold(self, phi, target, steps):
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), phi, lambda t, i: t - (
            2.0 * t + F.sin(2.0 * t) - target) / (2.0 + 2.0 * F.cos(2.0 * t) + 1e-300))

    def __getattr__(self, name):
        return getattr(F, self._names.get(name, name))


SQL, SPARK = _SqlMath(), _SparkMath()
D2R = math.pi / 180.0


# ---------------------------------------------------------------- formulas

def webmerc(m, lon, lat):
    x = WGS84_A * (lon * D2R)
    y = WGS84_A * m.log(m.tan(math.pi / 4 + (lat * D2R) / 2.0))
    return x, y


def webmerc_inv(m, x, y):
    lon = x / WGS84_A / D2R
    lat = (2.0 * m.atan(m.exp(y / WGS84_A)) - math.pi / 2) / D2R
    return lon, lat


def _kruger_alpha(f):
    n = f / (2 - f)
    n2, n3, n4, n5, n6 = n ** 2, n ** 3, n ** 4, n ** 5, n ** 6
    A = 1 / (1 + n) * (1 + n2 / 4 + n4 / 64 + n6 / 256)
    alpha = [
        n / 2 - 2 * n2 / 3 + 5 * n3 / 16 + 41 * n4 / 180 - 127 * n5 / 288 + 7891 * n6 / 37800,
        13 * n2 / 48 - 3 * n3 / 5 + 557 * n4 / 1440 + 281 * n5 / 630 - 1983433 * n6 / 1935360,
        61 * n3 / 240 - 103 * n4 / 140 + 15061 * n5 / 26880 + 167603 * n6 / 181440,
        49561 * n4 / 161280 - 179 * n5 / 168 + 6601661 * n6 / 7257600,
        34729 * n5 / 80640 - 3418889 * n6 / 1995840,
        212378941 * n6 / 319334400,
    ]
    return A, alpha


def _conformal(m, lon, lat, zone: int):
    """Tangent of the conformal latitude, and the angle from the zone's meridian."""
    e = math.sqrt(WGS84_F * (2 - WGS84_F))
    lon0 = (zone - 1) * 6 - 180 + 3
    phi = lat * D2R
    dl = (lon - lon0) * D2R
    sp = m.sin(phi)
    return m.sinh(m.atanh(sp) - e * m.atanh(e * sp)), dl


def _gauss_schreiber(m, t, dl):
    return m.atan2(t, m.cos(dl)), m.atanh(m.sin(dl) / m.sqrt(1.0 + t * t))


def _kruger(m, xi_p, eta_p, north: bool):
    A, alpha = _kruger_alpha(WGS84_F)
    xi, eta = xi_p, eta_p
    for j, a in enumerate(alpha, start=1):
        xi = xi + a * m.sin(2.0 * j * xi_p) * m.cosh(2.0 * j * eta_p)
        eta = eta + a * m.cos(2.0 * j * xi_p) * m.sinh(2.0 * j * eta_p)
    k = UTM_K0 * WGS84_A * A
    x = UTM_FE + k * eta
    y = k * xi if north else UTM_FN_SOUTH + k * xi
    return x, y


def utm(m, lon, lat, zone: int, north: bool = True):
    """Transverse Mercator by Krueger's series (Karney 2011), UTM scaling."""
    return _kruger(m, *_gauss_schreiber(m, *_conformal(m, lon, lat, zone)), north)


def utm_steps(m, zone: int, north: bool = True):
    """``utm`` as three maps of pairs: inside a lambda nothing is shared, and
    the series names its two arguments a dozen times each."""
    return [lambda a, b: _conformal(m, a, b, zone), lambda a, b: _gauss_schreiber(m, a, b), lambda a, b: _kruger(m, a, b, north)]


def lcc_3301(m, lon, lat):
    """Lambert conformal conic 2SP on GRS80 (Estonian grid)."""
    a, f = GRS80_A, GRS80_F
    e = math.sqrt(f * (2 - f))

    def t_of(phi_deg):
        p = phi_deg * D2R
        return math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)

    def m_of(phi_deg):
        p = phi_deg * D2R
        return math.cos(p) / math.sqrt(1 - e * e * math.sin(p) ** 2)
    m1, m2 = m_of(EST_LAT1), m_of(EST_LAT2)
    t1, t2, t0 = t_of(EST_LAT1), t_of(EST_LAT2), t_of(EST_LAT0)
    n = (math.log(m1) - math.log(m2)) / (math.log(t1) - math.log(t2))
    Fc = m1 / (n * t1 ** n)
    r0 = a * Fc * t0 ** n
    phi = lat * D2R
    sp = m.sin(phi)
    # t = tan(pi/4 - phi/2) / ((1 - e sin)/(1 + e sin))^(e/2), written with exp/log
    t = m.tan(math.pi / 4 - phi / 2.0) / m.exp((e / 2) * m.log((1.0 - e * sp) / (1.0 + e * sp)))
    r = (a * Fc) * m.exp(n * m.log(t))
    theta = n * ((lon - EST_LON0) * D2R)
    return EST_FE + r * m.sin(theta), EST_FN + r0 - r * m.cos(theta)


def mollweide(m, lon, lat, steps: int = MOLL_NEWTON_STEPS):
    """World Mollweide on the sphere of radius a; theta from a fixed number
    of Newton steps on 2t + sin 2t = pi sin(phi), run as a fold so the
    expression stays linear in size."""
    R = WGS84_A
    phi = lat * D2R
    target = math.pi * m.sin(phi)
    th = m.newton_fold(phi, target, steps)
    x = (2 * math.sqrt(2) / math.pi) * R * ((lon * D2R) * m.cos(th))
    y = math.sqrt(2) * R * m.sin(th)
    return x, y


# ---------------------------------------------------------------- column API

def lonlat_to_utm(lon: Column, lat: Column, zone: int, north: bool = True):
    return utm(SPARK, lon, lat, zone, north)


def lonlat_to_webmerc(lon: Column, lat: Column):
    return webmerc(SPARK, lon, lat)


def utm_zone_of(df, lon_col: str = "lon") -> int:
    """Auto-UTM as in project_graph: zone of the mean longitude (one
    number reaches the driver)."""
    mean_lon = df.agg(F.avg(lon_col)).first()[0]
    return int(math.floor((mean_lon + 180) / 6)) + 1


def _forward(srid_to: int):
    if srid_to == 3857:
        return webmerc
    if srid_to == 3301:
        return lcc_3301
    if srid_to == 54009:
        return mollweide
    if 32601 <= srid_to <= 32660:
        return lambda m, lon, lat: utm(m, lon, lat, srid_to - 32600, True)
    if 32701 <= srid_to <= 32760:
        return lambda m, lon, lat: utm(m, lon, lat, srid_to - 32700, False)
    raise ValueError(f"unsupported target CRS {srid_to}")


def transform_xy(x: Column, y: Column, srid_from: int, srid_to: int):
    if srid_from == srid_to:
        return x, y
    if srid_from == 3857:
        x, y = webmerc_inv(SPARK, x, y)
        srid_from = 4326
        if srid_to == 4326:
            return x, y
    if srid_from != 4326:
        raise ValueError(f"unsupported source CRS {srid_from}")
    return _forward(srid_to)(SPARK, x, y)


def transform(g, srid_from: int, srid_to: int) -> Column:
    """ST_Transform / to_crs on a geometry column (every vertex)."""
    from geoq.functions import geometry as G
    g = F.col(g) if isinstance(g, str) else g
    if srid_from == 4326 and (32601 <= srid_to <= 32660 or 32701 <= srid_to <= 32760):
        return G.set_srid(G.map_pairs(g, utm_steps(SPARK, srid_to % 100, srid_to < 32700)), F.lit(srid_to))

    def fx(vx, vy):
        return transform_xy(vx, vy, srid_from, srid_to)[0]

    def fy(vx, vy):
        return transform_xy(vx, vy, srid_from, srid_to)[1]
    return G.set_srid(G.map_coords(g, fx, fy), F.lit(srid_to))


def sql_xy(lon_sql: str, lat_sql: str, srid_to: int):
    """The same transform as SQL text (for oracles / SQL users)."""
    x, y = _forward(srid_to)(SQL, _S(lon_sql), _S(lat_sql))
    return x.s, y.s
