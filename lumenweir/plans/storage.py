"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """From spark.checkpoint.dir; where that is unset, a new temporary folder for a local session, and an error on a cluster,
    whose executors don't see the driver's folders."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lumenweir-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: lost executors can't take them, and later plans start there."""
    path = f"{shared_dir(df.sparkSession)}/lumenweir/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all that was stored; no DataFrame that reads it may be in use any more."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lumenweir")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def spread(table: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores, which is a small one, dealt out to all cores; others as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
