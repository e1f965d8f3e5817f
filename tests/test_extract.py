"""Batch extraction: skips what is there, rebuilds what is missing."""

import os
import shutil

from pyspark.sql import functions as F

from geoq.functions import geometry as G
from geoq.operators.extract import extract_many, extracted

TASKS = [("shops", {"kind": ["shop"]}), ("all", None), ("none", {"kind": ["nowhere"]})]


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs
            if "=" in d and f.endswith(".parquet")}


def test_second_run_writes_nothing_and_a_removed_partition_comes_back(spark, tmp_path):
    feats = spark.range(200).select("id", (F.col("id") % 20).cast("double").alias("x"), F.lit(5.0).alias("y"),
                                    F.create_map(F.lit("kind"), F.when(F.col("id") % 2 == 0, "shop").otherwise("bar")).alias("tags"))
    cities = spark.createDataFrame([("New A/B", 0.5), ("B=1", 9.5), ("Far", 500.0)], "city string, x0 double") \
        .select("city", G.box(F.col("x0"), F.lit(0.0), F.col("x0") + 5, F.lit(9.0)).alias("geometry"))
    path = str(tmp_path / "out")
    first = {(r.city, r.feature_type): r.n_features for r in extract_many(feats, cities, TASKS, path).collect()}
    inside = {"New A/B": .5, "B=1": 9.5, "Far": 500.0}
    assert first == {(c, t): sum(x0 < i % 20 < x0 + 5 and (t == "all" or t == "shops" and i % 2 == 0) for i in range(200))
                     for c, x0 in inside.items() for t in ("shops", "all", "none")}
    rows = {tuple(r) for r in extracted(spark, path, feats.schema).select("id", "city", "feature_type").collect()}
    expected = {(i, c, t) for c, x0 in (("New A/B", .5), ("B=1", 9.5)) for i in range(200) if x0 < i % 20 < x0 + 5
                for t in (("shops", "all") if i % 2 == 0 else ("all",))}
    assert rows == expected
    before = _files(path)
    assert extract_many(feats, cities, TASKS, path).count() == 0 and _files(path) == before
    gone = next(d for d, _, _ in os.walk(path) if d.endswith("feature_type=shops"))
    shutil.rmtree(gone)
    again = extract_many(feats, cities, TASKS, path).collect()
    assert len(again) == 1 and again[0].feature_type == "shops"
    after = _files(path)
    assert {f: t for f, t in after.items() if not f.startswith(gone)} == {f: t for f, t in before.items() if not f.startswith(gone)}
    assert {tuple(r) for r in extracted(spark, path, feats.schema).select("id", "city", "feature_type").collect()} == expected
