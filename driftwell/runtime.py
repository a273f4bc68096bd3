"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a folder of our own in local mode alone, as in tests: driver and executors are one process
    there. On a cluster it is an error, since each machine would write to a folder that the others can't read.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="driftwell-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


#: Scratch tables of this driver process lie in one folder, so that they can be cleared together.
RUN = uuid.uuid4().hex


def scratch(spark: SparkSession, name: str = "") -> str:
    """A new path among this run's scratch tables."""
    return f"{shared_folder(spark)}/driftwell/{RUN}/{name}{'-' if name else ''}{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables that this run has written. DataFrames that still read from them can't be used any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/driftwell/{RUN}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read back: cuts the lineage of loops and survives lost executors; columns stay prunable."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
