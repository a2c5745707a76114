"""Worked workloads: PageRank, naive Bayes, k-means, tours, pi, boolean queries over an inverted map."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import pyfuncs as P
from millrace.functions import scalars as S
from millrace.operators import core as O
from millrace.sources import scratch


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int, damping: float = 0.85, digits: int | None = None, cut_every: int = 4) -> DataFrame:
    """nodes (node), edges (src, dst, w): score = 1 - d + d * sum of incoming score * w, from 1.

    Edges to unknown nodes count for nothing. Edges are worked out once, and lineage is
    cut every few rounds, by tables in the shared folder."""
    if rounds > 1:
        path = scratch.folder(nodes.sparkSession, "edges")
        edges.select("src", "dst", "w").write.parquet(path)
        edges = nodes.sparkSession.read.parquet(path)
    ranks = nodes.select("node", F.lit(1.0).alias("score"))
    for k in range(rounds):
        sent = edges.join(ranks, edges.src == ranks.node).groupBy("dst").agg(F.sum(F.col("score") * F.col("w")).alias("s"))
        score = F.lit(1 - damping) + F.lit(damping) * F.coalesce("s", F.lit(0.0))
        ranks = nodes.select("node").join(sent, F.col("node") == F.col("dst"), "left").select("node", score.alias("score"))
        if (k + 1) % cut_every == 0 and k + 1 < rounds:
            path = scratch.folder(nodes.sparkSession, "ranks")
            ranks.write.parquet(path)
            ranks = nodes.sparkSession.read.parquet(path)
    return ranks.select("node", F.round("score", digits).alias("score")) if digits is not None else ranks


def bayes_train(rows: DataFrame) -> DataFrame:
    """rows (cls, feature): cls, feature, n, cls_n, features: counts for smoothed likelihoods."""
    by = rows.groupBy("cls", "feature").agg(F.count("*").alias("n"))
    total = by.groupBy("cls").agg(F.sum("n").alias("cls_n"))
    kinds = rows.agg(F.countDistinct("feature").alias("features"))
    return by.join(total, "cls").join(F.broadcast(kinds))  # one row


def bayes_predict(rows: DataFrame, train: DataFrame, digits: int = 9) -> DataFrame:
    """rows (id, feature): id, cls, score with add-one smoothing; unseen pairs count as 0 of their class."""
    classes = train.select("cls", "cls_n", "features").distinct()
    return (
        rows.join(F.broadcast(classes))  # a row a class
        .join(train.select("cls", "feature", "n"), ["cls", "feature"], "left")
        .groupBy("id", "cls")
        .agg(F.round(F.sum(F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("cls_n") + F.col("features")))), digits).alias("score"))
    )


def random_centres(points: DataFrame, k: int, key: str, vector: str = "x") -> list[list[float]]:
    """The first pass of k-means: every point falls into one of k clusters by the hash of its key; their means.

    A cluster that no point falls into is left out."""
    centres: dict[int, dict[int, float]] = {}
    for r in O.mean_vectors(points.withColumn("c", S.key_hash_label(key, k)), "c", vector).collect():  # k vectors
        centres.setdefault(r["c"], {})[r["dim"]] = r["mean"]
    return [[m for _, m in sorted(c.items())] for _, c in sorted(centres.items())]


def kmeans(points: DataFrame, centres: list[list[float]], rounds: int, vector: str = "x") -> tuple[list[list[float]], DataFrame]:
    """Lloyd's rounds: the centres (k vectors) are all that comes to the driver."""
    for _ in range(rounds):
        means = O.mean_vectors(points.withColumn("c", O.nearest(points, centres, vector)), "c", vector).collect()
        for r in means:
            centres[r["c"]][r["dim"]] = r["mean"]
    return centres, points.withColumn("c", O.nearest(points, centres, vector))


def shortest_tour(spark: SparkSession, graph: list[list[float]], start: int, slices: int = 64) -> DataFrame:
    """The cheapest closed tour by trying all: numbers of permutations are spread, each slice keeps its least."""
    import pandas as pd

    others = [n for n in range(len(graph)) if n != start]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                best = min((P.tour_cost(graph, [start, *P.tour(int(i), others)]), [start, *P.tour(int(i), others)]) for i in f["id"])
                yield pd.DataFrame([best], columns=["cost", "path"])

    tried = spark.range(0, factorial(len(others)), 1, slices).mapInPandas(run, "cost double, path array<int>")
    return tried.agg(F.min(F.struct("cost", "path")).alias("b")).select("b.cost", "b.path")


def estimate_pi(spark: SparkSession, points: int, seed: int = 1) -> DataFrame:
    inside = (F.pow(F.rand(seed), 2) + F.pow(F.rand(seed + 1), 2)) <= 1
    return spark.range(points).select(inside.cast("double").alias("inside")).agg((4 * F.avg("inside")).alias("pi"))


# -- boolean queries -----------------------------------------------------------------------------


def parse_query(text: str) -> list[list[tuple[str, bool]]]:
    """A conjunction of alternatives: 'a | b & ~c' is (a or b) and not c. Single keys and | are the documented
    part; & and ~ are additions of this library."""
    clauses = []
    for clause in text.split("&"):
        some = []
        for x in clause.split("|"):
            m = re.fullmatch(r"\s*(~?)\s*(\S+)\s*", x)
            if not m:
                raise ValueError(f"not a query: {text!r}")
            some.append((m[2], not m[1]))
        clauses.append(some)
    return clauses


def query_map(index: DataFrame, text: str) -> DataFrame:
    """index (k, values): the values, each once, that every clause allows."""
    clauses = parse_query(text)
    keys = sorted({k for c in clauses for k, _ in c})
    pairs = index.where(F.col("k").isin(keys) if all(p for c in clauses for _, p in c) else F.lit(True)).select("k", F.explode("values").alias("v"))
    has = {k: F.max((F.col("k") == k).cast("int")) == 1 for k in keys}

    def holds(clause: list[tuple[str, bool]]) -> Column:
        out = F.lit(False)
        for k, positive in clause:
            out = out | (has[k] if positive else ~has[k])
        return out

    test = F.lit(True)
    for c in clauses:
        test = test & holds(c)
    return pairs.groupBy("v").agg(test.alias("ok")).where("ok").select("v")
