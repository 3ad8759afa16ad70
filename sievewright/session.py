"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sievewright", cpus: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SIEVEWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and Spark runs locally.

    A machine-local folder on a cluster would lose what executors write, so there the setting has to be made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="sievewright-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop's objects."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the session's file systems close, or earlier by ``remove_tables``."""
    path = f"{shared_dir(spark)}/sievewright/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    target, store = hadoop_path(spark, path)
    store.deleteOnExit(target)
    return path


def remove_tables(spark: SparkSession) -> bool:
    """Delete all intermediate tables of this application, once the results that read them are written."""
    target, store = hadoop_path(spark, f"{shared_dir(spark)}/sievewright/{spark.sparkContext.applicationId}")
    return bool(store.delete(target, True))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of df with a table written to the shared folder; it survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
