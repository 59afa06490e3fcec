"""Session defaults for local runs; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lectern", cpus: int | None = None, **conf: str) -> SparkSession:
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
    } | conf
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out anew for long work on small rows, in a few parts for each core: a small file is one part else, and adaptive execution would join small parts again."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def mounted(spark: SparkSession, path: str) -> str | None:
    """The whole path of a place on the file system that all machines mount (``file:``), which tasks may open by themselves; None for other places."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names; it goes when the JVM ends.

    Only where that is unset and all runs on this machine (tests) a folder of our own is named.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()
