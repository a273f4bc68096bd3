"""Event feeds as streams: files as they come, counted by time windows, or folded into a keyed store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..runtime import shared_folder


def read(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """Parquet files of a folder, each once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(stream: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window; rows later than ``late`` behind the newest are dropped, and so is the state of closed windows."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def unique(stream: DataFrame, key: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def drain(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Run over what is there now and stop; progress and results are in the shared folder, so a rerun goes on from there."""
    folder = f"{shared_folder(stream.sparkSession)}/streams/{name}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    query = writer.format("parquet").option("path", f"{folder}/rows").start()
    query.awaitTermination()
    return query


def fold(stream: DataFrame, name: str, merge) -> StreamingQuery:
    """Hand each micro-batch to ``merge(rows, batch_id)``, which must take a batch that comes again."""
    folder = f"{shared_folder(stream.sparkSession)}/streams/{name}"
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
