"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cpus: int | str = "*", app: str = "bazaarlens", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only a local session that
    leaves it unset falls back to the machine's own temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="bazaarlens-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh folder of ``work_dir`` and read back: computed once, however often
    it is used."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def present(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    where, files = _hadoop(spark, path)
    return files.exists(where)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is absent."""
    where, files = _hadoop(spark, path)
    return [e.getPath().getName() for e in files.listStatus(where)] if files.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the job's own."""
    where, files = _hadoop(spark, path)
    files.delete(where, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Put a file or folder of the job's own in the place of ``target`` without reading it."""
    where, files = _hadoop(spark, source)
    to = _hadoop(spark, target)[0]
    files.mkdirs(to.getParent())
    files.delete(to, True)
    if not files.rename(where, to):
        raise OSError(f"cannot move {source} to {target}")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is finished: it does so when the driver collects its
    garbage, which may come late where the driver has little to do."""
    gc.collect()
    spark._jvm.System.gc()
