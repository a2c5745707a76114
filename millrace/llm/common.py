"""Shared plumbing of the training-data operators.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``, which every executor reaches; a session without that
setting (tests, notebooks) gets a folder of its own. Written tables are how the
operators cut lineage: they survive the loss of any executor.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow rows per batch: bounds a Python worker's memory where texts are long.
BATCH_ROWS = 256
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
U = np.uint64


def prepare(spark: SparkSession) -> None:
    """Session settings that the Python stages rely on; they bound memory, not results."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where it is unset, a temporary one, which is then set.

    Only a session whose executors run in this machine's driver may have one of its own: on a
    cluster each executor would write to its own disk, so there the setting is asked for."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        found = tempfile.mkdtemp(prefix="millrace-shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/millrace/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: a replicated cut of the lineage."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bitmap(spots: DataFrame, log2: int) -> np.ndarray:
    """2^log2 bits, those of the only column of ``spots`` set: they come to the driver as 64-bit words,
    ORed together by the executors, so as no more than 2^(log2 - 6) rows whatever the input."""
    spot = F.col(spots.columns[0]).cast("bigint")
    words = spots.groupBy(F.shiftright(spot, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({spots.columns[0]} & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (log2 - 6), U)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U)
    return out


def bitmap_log2(rows: int) -> int:
    """Bits for about one in 16 to be set, from 2^20 to 2^28 (32 MB); a fuller bitmap only lets more rows through to the join."""
    return min(28, max(20, (16 * rows - 1).bit_length()))


def marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at.astype(np.int64)
    return (bits[at >> 6] >> (at & 63).astype(U)) & U(1) == 1


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one of our own folders through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


class WordHashes(dict):
    """Memo of 64-bit word hashes; emptied when it is full, which only costs time."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U, len(words))


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, U), np.full(size, b, U)))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def words_by_line(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all lower-cased (A-Z) words of the texts, in order, the line of each, counted over
    all texts, and each text's first line. No word becomes an object: a word's hash is a difference
    of running sums of its bytes times powers, moved to the word's start, mixed with its length."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    a = np.frombuffer(b"\n".join(raw).translate(LOWER), np.uint8)
    lines = np.cumsum([0, *[r.count(b"\n") + 1 for r in raw[:-1]]]) if raw else np.zeros(0, np.int64)
    if not len(a):
        return np.empty(0, U), np.empty(0, np.int64), lines
    start, h = hash_words(a, _SPACES)
    return h, np.cumsum(a == 10)[start], lines


#: Bytes hashed at a time; longer runs are cut between words, which changes no hash.
_PIECE = 1 << 20


def hash_words(a: np.ndarray, spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of these bytes, which those of the table ``spaces`` part."""
    space = np.concatenate(([True], spaces[a], [True]))
    start, end = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    h = np.empty(len(start), U)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + _PIECE, "right")))
        piece = a[base : end[j - 1]]
        up, down = _power_tables(len(piece))
        total = np.concatenate((np.zeros(1, U), np.cumsum((piece.astype(U) + U(1)) * up[: len(piece)], dtype=U)))
        h[i:j] = (total[end[i:j] - base] - total[start[i:j] - base]) * down[start[i:j] - base]
        i = j
    return start, mix(h ^ ((end - start).astype(U) * U(_BASE)))


_MIX = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalizer that spreads 64-bit values evenly."""
    x = x ^ U((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of every run of k word hashes, in order; shorter inputs give one run of all words."""
    if not len(words):
        return np.empty(0, U)
    k = min(k, len(words))
    n = len(words) - k + 1
    r = np.full(n, U(k), U)
    for j in range(k):
        r = (r ^ words[j : j + n]) * _MIX[j % 5]
        r ^= r >> U(29)
    return mix(r)


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of other than ASCII white space, as UTF-8.

    ``bytes.split()`` splits on exactly 0x20 and 0x09-0x0D, and no byte of a
    multi-byte character is one of these."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def ordered_offsets(df: DataFrame, order: list[Column], value: str, out: str, tag: str) -> DataFrame:
    """Exclusive running sum of a column in a global order, without one big window.

    The columns of the order ascend, nulls first. Range partitions are written once (so every later pass sees the same cut),
    their sums are added up over the partitions, of which there are at most
    ``spark.sql.shuffle.partitions``, and a window inside each partition does
    the rest. Ties in the order take any order among themselves, fixed by the
    written table. Empty input gives an empty result.
    """
    spark = df.sparkSession
    keys = [f"__k{i}" for i in range(len(order))]
    ranged = df.select("*", *[c.alias(k) for k, c in zip(keys, order, strict=True)]).repartitionByRange(parts(spark), *[F.col(k) for k in keys])
    ranged = materialize(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__tie", F.monotonically_increasing_id()), tag)
    from pyspark.sql import Window as W

    sums = ranged.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = sums.select("__part", (F.sum("__sum").over(W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))).alias("__before"))
    inside = W.partitionBy("__part").orderBy(*keys, "__tie").rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.join(F.broadcast(before), "__part")  # at most one row for each shuffle partition
        .withColumn(out, F.coalesce(F.col("__before"), F.lit(0)) + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("__part", "__tie", "__before", *keys)
    )


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def rows_of(batches: Iterator, *names: str) -> Iterator[tuple[list, ...]]:
    """Arrow batches as tuples of Python lists."""
    for b in batches:
        yield tuple(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)
