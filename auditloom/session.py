"""What operators need from the session: tables by name, checkpoints in the shared folder."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table `name` of `directory`."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is named a session on one machine gets a temporary one, a cluster an error.

    What is written there goes with the session if spark.cleaner.referenceTracking.cleanCheckpoints is true.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="auditloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder, so that it survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def unsized(df: DataFrame) -> DataFrame:
    """A kept table without Spark's guess of its size, which is a product at each join: over rounds its digits double each time."""
    plan = df._jdf.queryExecution()
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(plan.toRdd(), df._jdf.schema(), False), df.sparkSession)


def released(spark: SparkSession) -> None:
    """Frees the disk of shuffles and checkpoints that nothing refers to: Spark does so only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """A scan, dealt out over the cores where its files give fewer partitions than these; large inputs stay as they are.

    For narrow passes that are dear per row. Not for plans with shuffles, which know their partitions only when they run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
