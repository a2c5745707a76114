"""What a user function may ask of the task that it runs in: its place, and side results by key."""

from __future__ import annotations

import socket
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans import jobs
from millrace.sources import scratch

#: Side results that tasks may read come to them as one broadcast, so they are checked to be few.
MOST_SIDE_BYTES = 64 << 20


@dataclass
class Task:
    """get and put of side results; this_partition, this_stage, this_attempt, this_host and this_name."""

    this_name: str
    this_partition: int
    this_stage: int
    this_attempt: int
    known: dict[str, bytes]
    written: list[tuple[str, bytes]] = field(default_factory=list)

    @property
    def this_host(self) -> str:
        return socket.gethostname()

    def get(self, key: str) -> bytes | None:
        """A side result as it was when the job began; None where there is none."""
        return self.known.get(key)

    def put(self, key: str, value: bytes) -> None:
        if not jobs.SIDE_NAME.match(key):
            raise ValueError(f"a side result can't be called {key!r}")
        self.written.append((key, bytes(value)))


def with_tasks(df: DataFrame, fn: Callable[[Iterator[tuple], Task], Iterator[tuple]], schema: str, name: str = "", side: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """fn(rows, task) once a partition: its rows, and (key, value) of what tasks put.

    Both are read back from one table in the shared folder, so that a task that runs twice counts once."""
    import pandas as pd

    spark = df.sparkSession
    known: dict[str, bytes] = {}
    if side is not None:
        last = jobs.last_written(side)
        if (last.agg(F.sum(F.octet_length("value") + F.octet_length("key"))).first()[0] or 0) > MOST_SIDE_BYTES:
            raise ValueError("side results are too large to give to every task: join them as a table")
        known = {r["key"]: bytes(r["value"]) for r in last.collect()}
    shared = spark.sparkContext.broadcast(known)
    names = spark.createDataFrame([], schema).columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        t = TaskContext.get()
        task = Task(name, t.partitionId(), t.stageId(), t.attemptNumber(), shared.value)
        rows = (tuple(r) for f in frames for r in f.itertuples(index=False, name=None))
        held: list[tuple] = []
        for r in fn(rows, task):
            held.append((*r, None, None))
            if len(held) >= 10_000:
                yield pd.DataFrame(held, columns=[*names, "side_key", "side_value"], dtype=object)
                held = []
        held += [(*[None] * len(names), k, v) for k, v in task.written]
        if held:
            yield pd.DataFrame(held, columns=[*names, "side_key", "side_value"], dtype=object)

    path = scratch.folder(spark, "tasks")
    df.mapInPandas(run, f"{schema}, side_key string, side_value binary").write.parquet(path)
    out = spark.read.parquet(path)
    return out.where("side_key is null").select(*names), out.where("side_key is not null").select(F.col("side_key").alias("key"), F.col("side_value").alias("value"))
