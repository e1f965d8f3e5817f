"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Observation, SparkSession

# Settings this library expects on any cluster: AQE re-plans joins and
# coalesces/splits partitions at runtime, skew join splits hot cell keys.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # geometry rows are CPU-heavy for their size: do not let AQE fold a
    # small-in-bytes shuffle into one task (no effect once partitions are
    # large, as on a cluster)
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
    # call sites of Column functions: four more JVM calls for each; large
    # expressions are built by the thousand
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "geoq") -> SparkSession:
    """Local/test session. On a cluster, build the session as usual and call
    :func:`configure` on it instead."""
    master = master or os.environ.get("GEOQ_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("GEOQ_DRIVER_MEMORY", "16g"))
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8)))
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Makes sure of a checkpoint folder; the caller's settings stay as they
    are (``get_spark`` sets this library's defaults on its own sessions)."""
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster in
    ``spark.checkpoint.dir``; only when it is unset (tests, local runs) a
    scratch folder is created and registered."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        d = tempfile.mkdtemp(prefix="geoq-ckpt-", dir=os.environ.get("GEOQ_SCRATCH", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss) into the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, replaces=(), **measures):
    """``df`` written below the shared checkpoint folder and read again: cuts
    the lineage in one job and survives the loss of executors.  Tables in
    ``replaces`` that came from here are superseded and deleted, once the new
    one stands; no plan that is still to run may read them.  ``measures``
    (aggregates by name) are taken while writing, into ``.measured``."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/geoq-{uuid.uuid4().hex}"
    seen = Observation() if measures else None
    observed = df.observe(seen, *[m.alias(n) for n, m in measures.items()]) if measures else df
    observed.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path, out.measured = path, seen.get if measures else {}
    for old in replaces:
        drop_stored(old)
    return out


def drop_stored(df) -> None:
    path = getattr(df, "stored_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)
