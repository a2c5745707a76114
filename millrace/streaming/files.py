"""Streams of files: what has been added since the last run, windowed counts, log tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def added(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    """Files of a folder as a stream; its checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Handle all there is in micro-batches, then stop; a later run takes up what came since."""
    q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()


def window_counts(df: DataFrame, time: str, key: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts by window and key; rows later than ``late`` behind the newest are left out."""
    d = df.withWatermark(time, late) if late else df
    return d.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def counts_by_batch(df: DataFrame, key: str, out: str, checkpoint: str) -> None:
    """Partial counts of each micro-batch, appended: totals are their sums."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.count("*").alias("n")).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tail(path: str, offset: int) -> tuple[int, list[str]]:
    """Whole lines of a log from a byte offset on, and the offset after them."""
    with open(path, "rb") as f:
        f.seek(offset)
        data = f.read()
    end = data.rfind(b"\n") + 1
    return offset + end, data[:end].decode("utf-8", "replace").splitlines()
