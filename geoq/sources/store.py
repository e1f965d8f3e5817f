"""Small header files beside the data, through Hadoop's file API: they lie in
whatever store the tables lie in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(conf), conf


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs, _ = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text; None where there is no such file."""
    p, fs, _ = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def parquet_footer_value(spark: SparkSession, file: str, key: str) -> str | None:
    """A key of a Parquet file's own metadata (one footer is read)."""
    p, _, conf = _path(spark, file)
    jvm = spark.sparkContext._jvm
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
        jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(p, conf))
    try:
        return reader.getFileMetaData().getKeyValueMetaData().get(key)
    finally:
        reader.close()
