"""Session helpers. Nothing here is needed on a cluster that brings its own session."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; sizes on a cluster come from its own configuration."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vocalith")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "vocalith-checkpoint"))


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver does; on machines without it, ship it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy per row: rows of a few large files over at least as many tasks as a shuffle has. A table that has as many splits already is left as it is."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def drop_shuffles(df: DataFrame) -> None:
    """Lets Spark remove shuffle files that nothing refers to any more, which it otherwise does only when the driver's memory fills."""
    gc.collect()
    jvm = getattr(df.sparkSession, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as they are now, written to the shared checkpoint folder: what is costly to make is made once and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
