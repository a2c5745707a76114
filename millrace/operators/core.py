"""Dataflow operators on DataFrames: map, partition, group, aggregate, join, sort, unite.

Native forms are Column expressions that Catalyst sees; ``map_python`` and
``reduce_python`` carry opaque user functions over Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import scalars as S

#: A side of a lookup join is broadcast up to this many rows; beyond, both sides are shuffled.
LOOKUP_ROWS = 50_000


# -- map ------------------------------------------------------------------------------------


def flat_map(df: DataFrame, items: Column, *keep: str, name: str = "k") -> DataFrame:
    """A row for each item of an array expression; rows without items vanish."""
    return df.select(*keep, F.explode(items).alias(name))


def map_python(df: DataFrame, fn: Callable[..., Iterator[tuple]], schema: str, params: Any = None, init: Callable | None = None) -> DataFrame:
    """fn(row, params) yields output tuples; init(rows, params) may consume rows first, once a partition."""
    import pandas as pd

    names = [f.name for f in _struct(schema).fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for f in frames for r in f.itertuples(index=False))
        if init:
            init(rows, params)
        held: list[tuple] = []
        for r in rows:
            held.extend(fn(r, params))
            if len(held) >= 10_000:
                yield pd.DataFrame(held, columns=names)
                held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    return df.mapInPandas(run, schema)


def grep(df: DataFrame, pattern: str, column: str = "value") -> DataFrame:
    """Rows whose text matches from its start on."""
    return df.where(F.col(column).rlike(f"^(?:{pattern})"))


def skip_headers(df: DataFrame, file: str, position: str, lines: int = 1) -> DataFrame:
    """Without each file's first rows, by a given position in the file."""
    return df.where(F.col(position) >= lines)


def nearest(df: DataFrame, centres: list[list[float]], vector: str = "x") -> Column:
    """Index of the nearest centre (the first of equals); centres are the job's parameters."""
    costs = F.array(*[F.struct(S.squared_distance(F.col(vector), F.array(*[F.lit(float(v)) for v in c])).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centres)])
    return F.array_min(costs)["c"]


# -- partition and group ----------------------------------------------------------------------


def to_labels(df: DataFrame, label: Column, n: int) -> DataFrame:
    """Rows with a label column, each label in the partition of its number."""
    return df.withColumn("label", label.cast("int")).repartitionById(n, "label")


def consecutive(df: DataFrame, key: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Runs of equal keys in an order: key, run, n. Nothing but neighbours is compared; order has to be
    unique in each part (``within``: columns whose parts are handled apart, in parallel)."""
    w = W.partitionBy(*(within or [F.lit(0)])).orderBy(*order)
    new = (~F.lag(key).over(w).eqNullSafe(F.col(key)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    marked = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*(within or []), "run", key).agg(F.count("*").alias("n"))


def split_by(df: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and those that don't (or can't be told)."""
    return df.where(test), df.where(~F.coalesce(test, F.lit(False)))


def group_all(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One group of all rows; of none, no group and so no row."""
    return df.agg(F.count("*").alias("__n"), *aggregates).where("__n > 0").drop("__n")


def reduce_python(df: DataFrame, by: list[str], fn: Callable[..., Iterator[tuple]], schema: str, sort: list[str] | None = None, params: Any = None) -> DataFrame:
    """fn(key, rows, params) over each group's rows, read as a stream and sorted first if asked for.

    Groups are streamed: rows arrive sorted by group, so no group is held in
    memory as a whole, whatever its size."""
    import itertools

    import pandas as pd

    names = [f.name for f in _struct(schema).fields]
    at = [df.columns.index(c) for c in by]
    placed = df.repartition(*[F.col(c) for c in by]).sortWithinPartitions(*by, *(sort or []))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for f in frames for r in f.itertuples(index=False))
        held: list[tuple] = []
        for key, group in itertools.groupby(rows, lambda r: tuple(r[k] for k in at)):
            for out in fn(key if len(key) > 1 else key[0], group, params):
                held.append(out)
                if len(held) >= 10_000:
                    yield pd.DataFrame(held, columns=names)
                    held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    return placed.mapInPandas(run, schema)


# -- aggregate --------------------------------------------------------------------------------


def sum_by_key(df: DataFrame, key: str | list[str], value: str | Column, name: str = "v") -> DataFrame:
    """Sum combiner and sum reduce in one: partial sums before the shuffle, final ones after it."""
    return df.groupBy(*([key] if isinstance(key, str) else key)).agg(F.sum(value).alias(name))


def two_level_count(df: DataFrame, key: str, label: Column) -> DataFrame:
    """Counts by (partition, label, key), then by key."""
    first = df.withColumn("label", label).groupBy(F.spark_partition_id().alias("node"), "label", key).agg(F.count("*").alias("n"))
    return first.groupBy(key).agg(F.sum("n").alias("n"))


def distinct_in_record(items: Column) -> Column:
    return F.size(F.array_distinct(items)).cast("bigint")


def mean_vectors(df: DataFrame, by: str, vector: str = "x", digits: int | None = None) -> DataFrame:
    """Element-wise mean by key: by, dim, mean."""
    long = df.select(by, F.posexplode(vector).alias("dim", "value"))
    mean = F.avg(F.col("value").cast("double"))
    return long.groupBy(by, "dim").agg((F.round(mean, digits) if digits is not None else mean).alias("mean"))


# -- join -------------------------------------------------------------------------------------


def union_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The tutorial's join: unite, group, keep keys with more than one payload cell: key, cells (sorted)."""
    cells = lambda d: d.select(key, F.array(*[F.col(c).cast("string") for c in d.columns if c != key]).alias("c"))
    both = cells(a).unionByName(cells(b)).groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("c"))).alias("cells"))
    return both.where(F.size("cells") > 1)


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Broadcasts the small side only where its size, looked up first, is within LOOKUP_ROWS."""
    if small.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS:
        small = F.broadcast(small)
    return big.join(small, on, how)


# -- sort and set -----------------------------------------------------------------------------


def sort_in_labels(df: DataFrame, label: Column, n: int, *keys: str) -> DataFrame:
    """Order inside each label, none between labels: what a reduce task with sorting sees."""
    return to_labels(df, label, n).sortWithinPartitions("label", *keys)


def merge_sorted(inputs: list[DataFrame], *keys: str) -> DataFrame:
    """Inputs as one, in the order of their keys."""
    return union_all(inputs).orderBy(*keys)


def union_all(inputs: list[DataFrame]) -> DataFrame:
    out = inputs[0]
    for d in inputs[1:]:
        out = out.unionByName(d)
    return out


def shuffled(df: DataFrame, seed: int | None = None) -> DataFrame:
    return df.orderBy(F.rand(seed))


def _struct(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)
