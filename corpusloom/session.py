"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corpusloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only a local session (tests, a laptop) makes one of its own where that is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster must name its shared folder in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_durable(df: DataFrame) -> None:
    """Delete the files of a ``durable`` table that nothing reads any more, and not only when the driver happens to collect its garbage."""
    spark = df.sparkSession
    at = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if at.isDefined():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
