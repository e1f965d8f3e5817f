"""WKB exchange format (H2): Arrow (pandas) UDFs over flat coordinate
arrays (see ``geometry.to_flat``); either byte order on input,
little-endian on output."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoq.functions import geometry as G

_CODES = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6}
_NAMES = {v: k for k, v in _CODES.items()}
_SUB = {"MULTIPOINT": "POINT", "MULTILINESTRING": "LINESTRING", "MULTIPOLYGON": "POLYGON"}


def encode_flat(gtype, xs, ys, rsize, rpart) -> bytes:
    xy = np.column_stack([np.asarray(xs, "<f8"), np.asarray(ys, "<f8")])
    offs = np.concatenate([[0], np.cumsum(rsize)]).astype(int)
    rings = [xy[offs[i]:offs[i + 1]] for i in range(len(rsize))]
    parts = {}
    for r, p in zip(rings, rpart):
        parts.setdefault(int(p), []).append(r)
    plist = [parts[k] for k in sorted(parts)]

    def one(t, prings):
        out = bytearray(struct.pack("<BI", 1, _CODES[t]))
        if t == "POINT":
            out += (prings[0][0] if len(prings) and len(prings[0]) else np.full(2, np.nan)).astype("<f8").tobytes()
        elif t == "LINESTRING":
            out += struct.pack("<I", len(prings[0])) + prings[0].tobytes()
        else:
            out += struct.pack("<I", len(prings))
            for r in prings:
                out += struct.pack("<I", len(r)) + r.tobytes()
        return out
    if gtype in _SUB:
        out = bytearray(struct.pack("<BII", 1, _CODES[gtype], len(plist)))
        for p in plist:
            out += one(_SUB[gtype], p)
        return bytes(out)
    return bytes(one(gtype, plist[0] if plist else []))


def decode_flat(buf: bytes):
    """-> (gtype, xs, ys, roff, rsize, rpart)."""
    xs, ys, rsize, rpart = [], [], [], []

    def rd(off, part_of):
        e = "<" if buf[off] == 1 else ">"
        code = struct.unpack_from(e + "I", buf, off + 1)[0] % 1000
        off += 5
        name = _NAMES[code]

        def ring(off, p):
            n = struct.unpack_from(e + "I", buf, off)[0]
            a = np.frombuffer(buf, dtype=e + "f8", count=2 * n, offset=off + 4).reshape(-1, 2)
            xs.extend(a[:, 0].tolist())
            ys.extend(a[:, 1].tolist())
            rsize.append(n)
            rpart.append(p)
            return off + 4 + 16 * n
        if name == "POINT":
            x, y = struct.unpack_from(e + "dd", buf, off)
            xs.append(x), ys.append(y), rsize.append(1), rpart.append(part_of)
            return name, off + 16
        if name == "LINESTRING":
            return name, ring(off, part_of)
        if name == "POLYGON":
            nr = struct.unpack_from(e + "I", buf, off)[0]
            off += 4
            for _ in range(nr):
                off = ring(off, part_of)
            return name, off
        n = struct.unpack_from(e + "I", buf, off)[0]
        off += 4
        for k in range(n):
            _, off = rd(off, k)
        return name, off
    name, _ = rd(0, 0)
    roff = np.concatenate([[0], np.cumsum(rsize)[:-1]]).astype(int).tolist() if rsize else []
    return name, xs, ys, roff, rsize, rpart


def _encode(gtype, xs, ys, rsize, rpart) -> bytes:
    """``encode_flat``, straight for a line or a polygon of one ring."""
    if len(rsize) != 1 or gtype not in ("LINESTRING", "POLYGON"):
        return encode_flat(gtype, xs, ys, rsize, rpart)
    xy = np.empty((len(xs), 2), "<f8")
    xy[:, 0], xy[:, 1] = xs, ys
    head = struct.pack("<BII", 1, 2, len(xs)) if gtype == "LINESTRING" else struct.pack("<BIII", 1, 3, 1, len(xs))
    return head + xy.tobytes()


def _decode(buf: bytes):
    """``decode_flat``, straight for a line or a polygon of one ring."""
    kind = buf[:9]
    at = 9 if kind[:5] == b"\x01\x02\0\0\0" else 13 if kind == b"\x01\x03\0\0\0\x01\0\0\0" else 0
    if not at:
        return decode_flat(buf)
    n = struct.unpack_from("<I", buf, at - 4)[0]
    xy = np.frombuffer(buf, "<f8", 2 * n, at)
    return "LINESTRING" if at == 9 else "POLYGON", xy[::2].copy(), xy[1::2].copy(), [0], [n], [0]


@F.pandas_udf(T.BinaryType())
def _as_wkb(gtype: pd.Series, xs: pd.Series, ys: pd.Series, rsize: pd.Series, rpart: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _encode(t, a, b, c, d)
                      for t, a, b, c, d in zip(gtype, xs, ys, rsize, rpart)], dtype=object)


#: The same, below which Spark pushes no filter.
_as_wkb_pinned = F.pandas_udf(_as_wkb.func, T.BinaryType()).asNondeterministic()


def with_wkb(df, geom: str = "geometry", out: str = "wkb", pinned: bool = False):
    """ST_AsWKB / ST_AsBinary as a new column (flat arrays are projected
    first, the Arrow UDF then sees plain columns).  ``pinned`` keeps later
    filters above the encoding: needed where the same plan decodes the WKB
    again and filters on the geometry, which Spark can't evaluate below two
    UDFs in a row."""
    cols = df.columns
    flat = df.select(*cols, G.to_flat(geom).alias("_f")).select(*cols, "_f.gtype", "_f.xs", "_f.ys", "_f.rsize",
                                                                 "_f.rpart")
    encode = _as_wkb_pinned if pinned else _as_wkb
    return flat.select(*cols, encode("gtype", "xs", "ys", "rsize", "rpart").alias(out))


_FLAT = T.StructType([T.StructField("gtype", T.StringType()), T.StructField("xs", T.ArrayType(T.DoubleType())),
                      T.StructField("ys", T.ArrayType(T.DoubleType())), T.StructField("roff", T.ArrayType(T.IntegerType())),
                      T.StructField("rsize", T.ArrayType(T.IntegerType())),
                      T.StructField("rpart", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_FLAT)
def _from_wkb(b: pd.Series) -> pd.DataFrame:
    rows = [_decode(bytes(x)) if x is not None else (None, None, None, None, None, None) for x in b]
    return pd.DataFrame(rows, columns=["gtype", "xs", "ys", "roff", "rsize", "rpart"])


def with_geom_from_wkb(df, wkb: str = "wkb", out: str = "geometry", srid=0):
    """ST_GeomFromWKB (either byte order) as a new column: the UDF output
    is materialised as a column before the struct is rebuilt in Catalyst
    (Python UDFs cannot sit inside higher-order functions)."""
    cols = df.columns
    f = df.select(*cols, _from_wkb(F.col(wkb)).alias("_f"))
    return f.select(*cols, G.from_flat(F.col("_f"), srid).alias(out))
