"""Vector sources and sinks.

GeoParquet is written as a WKB ``binary`` column plus pushable bbox
columns; the file-level ``geo`` key cannot be set through Spark's Parquet
writer, so the same JSON document is written next to the data as
``_geo.json``, through Hadoop's file API like the data.  GeoJSON is written
one feature per line; both that form (splittable) and FeatureCollection files
are read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoq.functions import geometry as G
from geoq.sources import store
from geoq.functions.wkb import with_geom_from_wkb, with_wkb


#: Bits per axis of a place on the curve along which layers are stored.
CURVE_BITS = 16


def curve_place(x, y, extent) -> "F.Column":
    """Place of a point on the Z-order curve over ``extent`` (x0, y0, x1, y1):
    the bits of its column and row in a grid of 2^16 by 2^16, interleaved.
    Points outside take the border's place, nulls none."""
    x0, y0, x1, y1 = (float(v) for v in extent)
    top = (1 << CURVE_BITS) - 1

    def cell(v, lo, hi):
        share = (v - F.lit(lo)) / F.lit(hi - lo if hi > lo else 1.0)
        return F.greatest(F.least(F.floor(share * top), F.lit(top)), F.lit(0))

    def spread(v):
        for step in (8, 4, 2, 1):
            mask = sum(((1 << step) - 1) << (2 * step * k) for k in range(CURVE_BITS // step))
            v = v.bitwiseOR(F.shiftleft(v, step)).bitwiseAND(F.lit(mask))
        return v
    return spread(cell(x, x0, x1)).bitwiseOR(F.shiftleft(spread(cell(y, y0, y1)), 1))


def along_curve(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by the curve place of their ``bbox``'s
    middle, so that a file and a row group hold what lies close together.  One
    pass for the extent (one row), one shuffle."""
    e = df.agg(F.min("bbox.minx").alias("a"), F.min("bbox.miny").alias("b"), F.max("bbox.maxx").alias("c"), F.max("bbox.maxy").alias("d")).first()
    if e["a"] is None:
        return df
    place = curve_place((F.col("bbox.minx") + F.col("bbox.maxx")) / 2, (F.col("bbox.miny") + F.col("bbox.maxy")) / 2, tuple(e))
    keyed = df.withColumn("_place", place)
    ranged = keyed.repartitionByRange(partitions, "_place") if partitions else keyed.repartitionByRange("_place")
    return ranged.sortWithinPartitions("_place").drop("_place")


def write_geoparquet(df: DataFrame, path: str, geom: str = "geometry", srid: int = 4326, mode: str = "overwrite",
                     partition_by=None, ordered: bool = False, partitions: int | None = None) -> None:
    """WKB geometry + bbox columns; CRS in ``_geo.json``.  ``ordered``
    lays the rows out along a space-filling curve, so that the readers' filters
    on the bbox columns leave most row groups unread."""
    b = G.bbox(F.col(geom))
    boxed = df.withColumn("bbox", b)
    out = with_wkb(along_curve(boxed, partitions) if ordered else boxed, geom, "_wkb").drop(geom).withColumnRenamed("_wkb", geom)
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    covering = {"xmin": "minx", "ymin": "miny", "xmax": "maxx", "ymax": "maxy"}
    meta = {"version": "1.1.0", "primary_column": geom,
            "columns": {geom: {"encoding": "WKB", "crs": f"EPSG:{srid}", "covering": {"bbox": {
                k: ["bbox", c] for k, c in covering.items()}}}}}
    store.write_text(df.sparkSession, f"{path}/_geo.json", json.dumps(meta))


def meets_box(box, bbox: str = "bbox"):
    """Filter of stored bbox columns against (x0, y0, x1, y1): four
    comparisons that reach the Parquet reader."""
    x0, y0, x1, y1 = (float(v) for v in box)
    b = F.col(bbox)
    return (b.minx <= x1) & (b.maxx >= x0) & (b.miny <= y1) & (b.maxy >= y0)


def read_geoparquet(spark: SparkSession, path: str, geom: str = "geometry", srid: int | None = None, box=None) -> DataFrame:
    """A2: GeoParquet (WKB column) -> geometry struct; CRS from ``_geo.json``
    or else from the ``geo`` key of a file's footer, 0 without either.  With
    ``box`` only rows whose stored bbox meets it are read and decoded."""
    df = spark.read.parquet(path)
    if box is not None:
        df = df.where(meets_box(box))
    if srid is None:
        meta = store.read_text(spark, f"{path}/_geo.json") or next(
            (m for m in (store.parquet_footer_value(spark, f, "geo") for f in df.inputFiles()[:1]) if m), None)
        srid = _srid_of(json.loads(meta)["columns"][geom].get("crs")) if meta else 0
    return with_geom_from_wkb(df, geom, "_g", srid).drop(geom).withColumnRenamed("_g", geom)


def _srid_of(crs) -> int:
    """EPSG code of a CRS given as text (``EPSG:n``) or as PROJJSON; a layer
    without a CRS is in lon/lat by the format's definition."""
    if crs is None:
        return 4326
    code = (crs.get("id") or {}).get("code") if isinstance(crs, dict) else str(crs).split(":")[-1]
    return int(code) if str(code).isdigit() else 0


_GJ_FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()),
                                            T.StructField("coordinates", T.StringType())]))])


def read_geojson(spark: SparkSession, path: str, srid: int = 4326, lines: bool = False) -> DataFrame:
    """A4: GeoJSON -> (properties map, geometry).  ``lines``: newline-delimited
    features (as ``write_geojson`` writes them), read in parallel; else files
    that hold one FeatureCollection each.  The form is the caller's to say: a
    file of the other form raises when it is read.  Coordinates are parsed from
    their JSON text by nesting depth of the geometry type."""
    if lines:
        features = spark.read.schema(_GJ_FEATURE).json(path)
        wrong, said = ~F.coalesce(F.col("type") == "Feature", F.lit(False)), "a line that is no GeoJSON feature: lines=False?"
    else:
        collections = spark.read.option("multiLine", True).schema(T.StructType([
            T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(_GJ_FEATURE))])).json(path)
        none = F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("map<string,string>").alias("properties"),
                        F.lit(None).cast(_GJ_FEATURE["geometry"].dataType).alias("geometry"))
        # a file without a list of features becomes one row that raises
        features = collections.select("type", F.coalesce("features", F.array(none)).alias("features"),
                                      F.col("features").isNull().alias("wrong")).select("wrong", F.inline("features"))
        wrong, said = F.col("wrong"), "a file that is no FeatureCollection: lines=True?"
    features = features.withColumn("geometry", F.when(wrong, F.raise_error(F.lit(said)).cast(_GJ_FEATURE["geometry"].dataType)).otherwise(F.col("geometry")))
    f = features.select("properties", "geometry.type", "geometry.coordinates")
    t = F.upper(F.col("type"))
    depth = (F.when(t == "POINT", 2).when(t.isin("LINESTRING", "MULTIPOINT"), 2)
             .when(t.isin("POLYGON", "MULTILINESTRING"), 1).otherwise(0))
    wrapped = F.concat(F.repeat(F.lit("["), depth), F.col("coordinates"), F.repeat(F.lit("]"), depth))
    wrapped = F.when(t == "POINT", F.concat(F.lit("[[["), F.col("coordinates"), F.lit("]]]"))).otherwise(wrapped)
    arr = F.from_json(wrapped, "array<array<array<array<double>>>>")
    parts = F.transform(arr, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: G.xy(v[0], v[1]))))
    parts = (F.when(t == "MULTILINESTRING", F.transform(parts[0], lambda r: F.array(r)))
             .when(t == "MULTIPOINT", F.transform(parts[0][0], lambda v: F.array(F.array(v))))
             .otherwise(parts))
    return f.select(F.col("properties"), G.make_geometry(t, parts, srid).alias("geometry"))


def _coords_json(g):
    def ring(r):
        return F.concat(F.lit("["), F.array_join(F.transform(r, lambda v: F.concat(
            F.lit("["), v.x.cast("string"), F.lit(","), v.y.cast("string"), F.lit("]"))), ","), F.lit("]"))

    def poly(p):
        return F.concat(F.lit("["), F.array_join(F.transform(p, ring), ","), F.lit("]"))
    t, parts = g.gtype, g.parts
    return (F.when(t == "POINT", F.concat(F.lit("["), parts[0][0][0].x.cast("string"), F.lit(","),
                                          parts[0][0][0].y.cast("string"), F.lit("]")))
            .when(t == "LINESTRING", ring(parts[0][0]))
            .when(t == "POLYGON", poly(parts[0]))
            .when(t == "MULTIPOINT", ring(F.transform(parts, lambda p: p[0][0])))
            .when(t == "MULTILINESTRING", F.concat(F.lit("["), F.array_join(F.transform(parts, lambda p: ring(p[0])), ","),
                                                    F.lit("]")))
            .otherwise(F.concat(F.lit("["), F.array_join(F.transform(parts, poly), ","), F.lit("]"))))


_GJ_TYPES = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint",
             "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}


def write_geojson(df: DataFrame, path: str, geom: str = "geometry", mode: str = "overwrite") -> None:
    """A5: one GeoJSON feature per line (newline-delimited GeoJSON)."""
    g = F.col(geom)
    gt = F.create_map(*[x for k, v in _GJ_TYPES.items() for x in (F.lit(k), F.lit(v))])[g.gtype]
    props = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != geom]))
    line = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":{"type":"'), gt,
                    F.lit('","coordinates":'), _coords_json(g), F.lit("}}"))
    df.select(line.alias("value")).write.mode(mode).text(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite", empty_first: bool = False) -> None:
    """CTAS / empty-schema CTAS then append (``WHERE FALSE`` + INSERT)."""
    if empty_first:
        df.limit(0).write.mode("overwrite").saveAsTable(name)
        df.write.insertInto(name)
    else:
        df.write.mode(mode).saveAsTable(name)


def load_layer(spark: SparkSession, source: str, table: str, form: str = "geoparquet", *, srid: int | None = None,
               wkt_col: str = "geometry_wkt", lines: bool = False) -> DataFrame:
    """A layer's file into a table, replacing it.  ``form``: geoparquet,
    geojson, or csv with a WKT column.  Returns the table."""
    if form == "geoparquet":
        df = read_geoparquet(spark, source, srid=srid)
    elif form == "geojson":
        df = read_geojson(spark, source, 4326 if srid is None else srid, lines)
    elif form == "csv":
        df = spark.read.option("header", True).option("inferSchema", True).csv(source)
        df = df.withColumn("geometry", G.geom_from_wkt(F.col(wkt_col), srid or 0)).drop(wkt_col)
    else:
        raise ValueError(f"unknown form {form!r}")
    df.write.mode("overwrite").saveAsTable(table)
    return spark.table(table)


def load_table(df: DataFrame, name: str, order_cols, id_col: str = "id", cell_col: str | None = None,
               geom: str | None = None) -> None:
    """Replace a table, adding a surrogate id (distributed row id) and
    laying rows out by a cell column or, with ``geom``, along a space-filling
    curve with stored bbox columns, in place of a GiST index; ``df.write.jdbc``
    is the same call for an external DB."""
    from geoq.operators.aggregates import with_row_id
    out = with_row_id(df, order_cols, id_col)
    if geom:
        out = along_curve(out.withColumn("bbox", G.bbox(F.col(geom))))
    elif cell_col:
        out = out.repartitionByRange(cell_col).sortWithinPartitions(cell_col)
    out.write.mode("overwrite").saveAsTable(name)


def append_csv_log(df: DataFrame, path: str) -> None:
    """Append result rows to a CSV log (header in every part file)."""
    df.write.mode("append").option("header", True).csv(path)


def describe_layer(df: DataFrame, geom: str = "geometry", n: int = 5):
    """Columns, first rows and CRS of a layer."""
    srids = df.select(G.srid(F.col(geom)).alias("s")).distinct().collect()
    return {"columns": df.columns, "head": df.limit(n).collect(), "srid": [r.s for r in srids]}
