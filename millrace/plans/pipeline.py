"""Linear pipelines of stages over key-value records (k, v) with a label.

A stage is a function over its group's records. The grouping says which records
share a task: ``split`` (a partition of the input each), ``group_label`` (a label),
``group_node_label`` (a label within a partition, as Spark has no node key),
``group_node`` (a partition), ``group_all`` (everything). ``combine`` makes a
group's records one call; ``sort`` orders them by key before it. A group is read as
a stream. Groupings of nothing run nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPINGS = ("split", "group_label", "group_node_label", "group_node", "group_all")
ALIASES = {"group_label_node": "group_node_label"}


class Output:
    """What a stage's function writes to: ``add(key, value, label=0)``."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, key: Any, value: Any, label: int = 0) -> None:
        if not isinstance(label, int):
            raise TypeError("a label is an integer")
        self.rows.append((key, value, label))


@dataclass
class Stage:
    """process(out, state, label, records, params), with init(params) -> state before and done(out, state, params) after.

    Without ``combine``, process is called for each of the group's inputs, that
    is partition by partition; with it, once a label. input_hook(state, labels)
    may reorder the labels of a group that has several.
    """

    name: str
    process: Callable | None = None
    schema: str = "k string, v string"
    init: Callable | None = None
    done: Callable | None = None
    input_hook: Callable | None = None
    combine: bool = False
    sort: bool = False
    native: Callable[[DataFrame], DataFrame] | None = None  # a DataFrame form, in place of process
    params: Any = None


def check(pipeline: list[tuple]) -> list[tuple[str, Stage]]:
    """(grouping, stage) pairs with known groupings and different names; a third element, which asks for
    overlapping stages, is accepted and has no effect."""
    out = []
    for element in pipeline:
        grouping, stage = element[0], element[1]
        grouping = ALIASES.get(grouping, grouping)
        if len(element) not in (2, 3) or grouping not in GROUPINGS:
            raise ValueError(f"no such grouping: {grouping}")
        if stage.name in {s.name for _, s in out}:
            raise ValueError(f"two stages are called {stage.name}")
        out.append((grouping, stage))
    return out


def _place(df: DataFrame, grouping: str) -> DataFrame:
    if grouping == "group_label":
        return df.repartition("label")
    return df.coalesce(1) if grouping == "group_all" else df


def run_stage(df: DataFrame, grouping: str, stage: Stage) -> DataFrame:
    """df (label, k, v) through one stage; gives label, k, v."""
    if "label" not in df.columns:
        df = df.withColumn("label", F.lit(0))
    df = df.select(F.col("label").cast("int").alias("label"), *[c for c in df.columns if c != "label"])
    if stage.native:
        out = stage.native(df)
        return out if "label" in out.columns else out.withColumn("label", F.lit(0))
    placed = _place(df, grouping)
    by_label = stage.combine or grouping in ("group_label", "group_node_label")
    if by_label:
        keys = ["label", *(["k"] if stage.combine and stage.sort else [])]
        placed = placed.sortWithinPartitions(*keys)
    elif stage.sort and stage.combine:
        placed = placed.sortWithinPartitions("k")
    import pandas as pd
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"{stage.schema}, label int")
    names = [f.name for f in schema.fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for f in frames for r in f.itertuples(index=False))
        first = next(rows, None)
        if first is None:
            return
        rows = itertools.chain([first], rows)
        out = Output()
        # one task a label where the grouping says so, else one a partition
        whole = grouping in ("group_label", "group_node_label")
        groups = ((k, g) for k, g in itertools.groupby(rows, lambda r: r[0])) if by_label or whole else [(int(first[0]), rows)]
        state = None if whole else (stage.init(stage.params) if stage.init else None)
        if stage.input_hook and not whole and by_label:
            held = {k: list(g) for k, g in groups}  # a hook needs the labels of the whole group at hand
            groups = [(k, held[k]) for k in stage.input_hook(state, list(held))]
        for label, group in groups:
            if whole:
                state = stage.init(stage.params) if stage.init else None
            if stage.process:
                stage.process(out, state, int(label), ((r[1], r[2]) if len(r) > 2 else r[1] for r in group), stage.params)
            if whole and stage.done:
                stage.done(out, state, stage.params)
            if len(out.rows) >= 10_000:
                yield pd.DataFrame(out.rows, columns=names)
                out.rows = []
        if not whole and stage.done:
            stage.done(out, state, stage.params)
        if out.rows:
            yield pd.DataFrame(out.rows, columns=names)

    return placed.mapInPandas(run, schema)


def run(df: DataFrame, pipeline: list[tuple]) -> dict[str, DataFrame]:
    """Every stage's result by name, in order; the last is the job's."""
    out: dict[str, DataFrame] = {}
    for grouping, stage in check(pipeline):
        df = run_stage(df, grouping, stage)
        out[stage.name] = df
    return out


def groups(outputs: DataFrame, grouping: str) -> DataFrame:
    """The groups that a grouping makes of task outputs (task_id, out_id, label, size, host): label, host, inputs, size."""
    grouping = ALIASES.get(grouping, grouping)
    if grouping not in GROUPINGS:
        raise ValueError(f"no such grouping: {grouping}")
    none = F.lit(None).cast("string")
    if grouping == "split":
        return outputs.select("label", "host", F.lit(1).cast("bigint").alias("inputs"), "size")
    label = F.col("label") if grouping in ("group_label", "group_node_label") else F.lit(0)
    host = F.col("host") if grouping in ("group_node", "group_node_label") else none
    return outputs.groupBy(label.cast("int").alias("label"), host.alias("host")).agg(F.count("*").alias("inputs"), F.sum("size").alias("size"))


def new_and_grown(before: DataFrame, after: DataFrame) -> DataFrame:
    """Groups of a later grouping that are new, or have more inputs than before: label, host, what, inputs."""
    j = after.alias("b").join(before.alias("a"), (F.col("a.label") == F.col("b.label")) & F.col("a.host").eqNullSafe(F.col("b.host")), "left")
    return j.where(F.col("a.inputs").isNull() | (F.col("b.inputs") > F.col("a.inputs"))).select("b.label", "b.host", F.when(F.col("a.inputs").isNull(), "new").otherwise("grown").alias("what"), "b.inputs")
