import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from geoq.session import get_spark
    s = get_spark(master="local[*]", shuffle_partitions=8, app_name="geoq-tests")
    yield s


def jts_area(spark, wkt: str) -> float:
    """Independent kernel for tests only (JTS ships with this Spark build)."""
    jvm = spark.sparkContext._jvm
    return jvm.org.locationtech.jts.io.WKTReader().read(wkt).getArea()


def jts(spark):
    return spark.sparkContext._jvm.org.locationtech.jts
