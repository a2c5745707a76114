"""Classic jobs: map, combiner, partition and reduce, turned into a pipeline of DataFrame steps.

Functions may be Python callables or the native marks below, which become
Column expressions, so that a sum runs as a partial and a final aggregate in the
JVM. Without ``partitions`` a job writes one unlabelled output; with it, the
default label is the key's md5 modulo their number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import core as O


@dataclass(frozen=True)
class Native:
    """A DataFrame form of a map, combiner or reduce: rows (k, v) in and out."""

    name: str
    apply: Callable[[DataFrame], DataFrame]


nop_map = Native("nop_map", lambda d: d)
nop_reduce = Native("nop_reduce", lambda d: d)
sum_combiner = Native("sum_combiner", lambda d: d)  # the aggregate's partial step does it
sum_reduce = Native("sum_reduce", lambda d: d.groupBy("k").agg(F.sum("v").alias("v")))


def noop(*_: Any) -> None:
    """Does nothing."""


def steps(has_map: bool, has_reduce: bool, shuffle: bool, reducers: int) -> list[tuple[str, str]]:
    """(stage, grouping) of a classic job."""
    last = [("reduce", "group_all")] if reducers == 1 else [("reduce", "group_label"), *([("reduce_shuffle", "group_node")] if shuffle else [])]
    return [*([("map", "split"), ("map_shuffle", "group_node")] if has_map else []), *(last if has_reduce else [])]


@dataclass
class ClassicJob:
    """map(row, params) yields (k, v); reduce(records, params) yields (k, v), or reduce(records, out, params) adds to out."""

    map: Callable | Native | None = None
    reduce: Callable | Native | None = None
    combiner: Callable | Native | None = None
    partition: Callable[[Column, int], Column] | None = None
    partitions: int | None = 1
    sort: bool = False
    map_init: Callable | None = None
    reduce_init: Callable | None = None
    params: Any = None
    map_schema: str = "k string, v string"
    reduce_schema: str = "k string, v string"

    def resolved(self, **run: Any) -> ClassicJob:
        """Arguments of a run come before the job's attributes, those before the defaults."""
        from dataclasses import replace

        return replace(self, **run)

    def plan(self) -> list[tuple[str, str]]:
        return steps(self.map is not None, self.reduce is not None, False, self.partitions or 1)

    def run(self, df: DataFrame) -> dict[str, DataFrame]:
        """Results by stage: 'map' and 'reduce', where the job has them."""
        out: dict[str, DataFrame] = {}
        if self.map is not None:
            if isinstance(self.map, Native):
                df = self.map.apply(df)
            else:
                df = O.map_python(df, self.map, self.map_schema, self.params, self.map_init)
            if self.combiner is not None and not isinstance(self.combiner, Native):
                df = _combined(df, self.combiner, self.map_schema, self.params)
            out["map"] = df
        if self.partitions:
            label = (self.partition or S.key_hash_label)(F.col("k"), self.partitions)
            df = df.withColumn("label", label.cast("int") % self.partitions if self.partition is None else label.cast("int"))
            if self.map is not None:
                out["map"] = df
        if self.reduce is None:
            return out
        if isinstance(self.reduce, Native):
            df = self.reduce.apply(df.drop("label"))
        else:
            labelled = df if "label" in df.columns else df.withColumn("label", F.lit(0))
            labelled = labelled.select("label", "k", "v")
            import inspect

            two = len(inspect.signature(self.reduce).parameters) < 3
            fn, init, params = self.reduce, self.reduce_init, self.params

            def reduce(label, rows, _):
                records = ((r[1], r[2]) for r in rows)
                if init:
                    init(records, params)
                if two:
                    yield from fn(records, params)
                else:
                    got: list[tuple] = []
                    fn(records, type("Out", (), {"add": staticmethod(lambda k, v: got.append((k, v)))}), params)
                    yield from got

            df = O.reduce_python(labelled, ["label"], reduce, self.reduce_schema, ["k"] if self.sort else None)
        out["reduce"] = df
        return out

    def result(self, df: DataFrame) -> DataFrame:
        return list(self.run(df).values())[-1]


def _combined(df: DataFrame, combiner: Callable, schema: str, params: Any) -> DataFrame:
    """combiner(key, value, buffer, done, params): called by record, then once with done; what it gives back is written."""
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buffer: dict = {}
        for f in frames:
            rows = [x for r in f.itertuples(index=False) for x in (combiner(r[0], r[1], buffer, False, params) or ())]
            if rows:
                yield pd.DataFrame(rows, columns=["k", "v"])
        rows = list(combiner(None, None, buffer, True, params) or ())
        if rows:
            yield pd.DataFrame(rows, columns=["k", "v"])

    return df.mapInPandas(run, schema)
