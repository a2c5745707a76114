"""Sinks: labelled folders, pair files, key-value maps, chunks and whole files."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def labelled(df: DataFrame, path: str, label: str = "label") -> None:
    """A Parquet folder by label; Spark's committer makes it appear as a whole or not at all."""
    df.write.partitionBy(label).parquet(path)


def pair_line(k: Column, v: Column) -> Column:
    """'length key length value', lengths in bytes."""
    k, v = k.cast("string"), v.cast("string")
    return F.concat(F.octet_length(k).cast("string"), F.lit(" "), k, F.lit(" "), F.octet_length(v).cast("string"), F.lit(" "), v)


def plain(df: DataFrame, path: str) -> None:
    df.select(pair_line(F.col("k"), F.col("v")).alias("value")).write.text(path)


def key_value_map(df: DataFrame, unique: bool = False) -> DataFrame:
    """key to sorted values: k, values."""
    return df.groupBy("k").agg(F.sort_array(F.collect_set("v") if unique else F.collect_list("v")).alias("values"))


def chunks(df: DataFrame, path: str, chunk_bytes: int = 64 << 20, record_bytes: int = 1 << 20, column: str = "value") -> None:
    """Record-aligned files of about chunk_bytes; a record over record_bytes is an error."""
    size = F.octet_length(F.col(column))
    checked = df.withColumn(column, F.when(size > record_bytes, F.raise_error(F.lit("a record is larger than a chunk may hold")).cast("string")).otherwise(F.col(column)))
    mean = df.agg(F.avg(size)).first()[0] or 1
    checked.write.option("maxRecordsPerFile", max(1, int(chunk_bytes / max(1.0, mean)))).parquet(path)


def push(spark: SparkSession, paths: list[str], out: str) -> None:
    """Whole files as rows (name, data)."""
    spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("data")).write.parquet(out)


def tar_members(path: str, include: str = "", exclude: str | None = None) -> Iterator[tuple[str, bytes]]:
    """Files of an archive by parts of their names."""
    with tarfile.open(path) as t:
        for m in t:
            if m.isfile() and include in m.name and not (exclude and exclude in m.name):
                yield m.name, t.extractfile(m).read()


def each_partition(df: DataFrame, write) -> None:
    """write(rows) once a partition, for stores that have a client of their own."""
    df.foreachPartition(write)


def save_as(df: DataFrame, catalog, job: str, path: str) -> str:
    """A job's results as a dataset under its own tag."""
    df.write.parquet(path)
    tag = f"results:{job}"
    catalog.tag(tag, [[path]])
    return tag
