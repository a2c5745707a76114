"""Mixing sources to target weights by capped water-filling.

Sources share the size of all of them by weight; none may exceed ``cap`` times
its own size. Those whose share would are clamped there, and what they leave is
shared by weight among the rest, round by round until none is above. A source
that takes r words takes every document r // S times (S its size), and of one
more, fractional, repetition the documents that come first in a seeded order, as
long as whole ones fit; the next takes the words that are left.

Where that order's cut falls is found in two steps: sizes are summed by 2^14
ranges of the order, and only the range that holds the cut is ranked row by row;
so no source, however large, is sorted as a whole.

Defined cases: a null or word-less text has size 0 and takes 0; a null source is
a source of its own, the last in code point order; rows equal in doc_id and size
rank alike, and those at the cut share the words left evenly, rounded down; a
null doc_id ranks like any other value; a mix of no words takes none; other
columns are kept by ``mix`` and ignored by ``plan``, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS, CAP, SEED, RANGES_LOG2 = (1, 2, 3), 3, "mix-1", 14


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def rank_of(doc_id: Column, size: Column, seed: str = SEED) -> Column:
    """A row's place in the seeded order: 60 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string"))), 1, 15), 16, 10).cast("bigint")


def fill(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """sources (source, weight, source_size) with target: one aggregate a round, no row leaves the cluster."""
    state = sources.withColumn("full", F.col("source_size") == 0)
    total = state.agg(F.sum("source_size")).first()[0] or 0
    while True:
        row = state.agg(F.sum(F.when(F.col("full"), F.col("source_size") * cap).otherwise(0)).alias("c"), F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).alias("w")).first()
        level = (total - (row["c"] or 0)) / row["w"] if row["w"] else 0.0
        target = F.when(F.col("full"), F.col("source_size").cast("double") * cap).otherwise(F.col("weight") * F.lit(float(level)))
        over = ~F.col("full") & (F.col("weight") * F.lit(float(level)) > F.col("source_size") * cap)
        if not state.filter(over).limit(1).count():
            return state.select("source", "weight", "source_size", target.alias("target"))
        state = C.materialize(state.withColumn("full", F.col("full") | over), "mix-fill")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """Per row (doc_id, source, size, rank), and per source its size, target, whole repetitions and
    cut: rows ranked below it take one more repetition, those at it cut_words words more."""
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size"))
    sized = C.materialize(sized.withColumn("rank", rank_of(F.col("doc_id"), F.col("size"), seed)), "mix-sizes")
    ranged = F.shiftright("rank", 60 - RANGES_LOG2)
    ranges = C.materialize(sized.groupBy("source", ranged.alias("range")).agg(F.sum("size").alias("words")), "mix-ranges")
    sources = ranges.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("one", F.lit(1))
    numbered = C.ordered_offsets(sources, [F.col("source").isNull(), F.col("source")], "one", "place", "mix-order")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    filled = fill(C.materialize(numbered.select("source", "source_size", weight.alias("weight")), "mix-sources"), cap)
    goal = F.round("target").cast("bigint")
    empty = F.col("source_size") == 0
    filled = filled.withColumn("whole", F.when(empty, 0).otherwise(F.expr("cast(round(target) as bigint) div source_size"))).withColumn("rest", F.when(empty, 0).otherwise(goal % F.col("source_size")))
    filled = C.materialize(filled, "mix-targets")
    # the range that holds the cut: the words before it are at most the rest, those up to its end more
    before = ranges.withColumn("before", F.sum("words").over(W.partitionBy("source").orderBy("range")) - F.col("words"))  # at most 2^14 rows a source
    cut = before.alias("r").join(filled.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).filter("before <= rest and rest < before + words").select("s.source", F.col("r.range").alias("range"), F.col("before"), "rest")
    there = sized.withColumn("range", ranged).alias("d").join(cut.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.range") == F.col("c.range")))
    ranks = there.groupBy("c.source", "rank", "before", "rest").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    ranks = ranks.withColumn("at", F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy("rank")) - F.col("words"))  # one range of one source
    found = ranks.filter("at <= rest and rest < at + words").select("source", F.col("rank").alias("cut"), F.expr("(rest - at) div rows").alias("cut_words"))
    out = filled.alias("s").join(found.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")), "left")
    return sized, C.materialize(out.select("s.source", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1).cast("bigint")).alias("cut"), F.coalesce("cut_words", F.lit(0).cast("bigint")).alias("cut_words")), "mix-plan")


def _extra(rank: Column, size: Column) -> Column:
    return F.when(rank < F.col("cut"), size).when(rank == F.col("cut"), F.least(F.col("cut_words"), size)).otherwise(F.lit(0).cast("bigint"))


def _with_plan(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """rows (with __s, __salt) beside their source's plan; a source may hold most rows, so its key is split."""
    salts = 32
    many = planned.select(*[F.col(c).alias(f"__{c}") for c in planned.columns]).withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(F.col("__rank"), F.lit(salts)).cast("int")).join(many, F.col("__s").eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__at")))


def taken(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    sized, planned = plan(docs, **how)
    rows = _with_plan(sized.select("doc_id", "size", F.col("source").alias("__s"), F.col("rank").alias("__rank")), planned)
    rows = rows.withColumn("cut", F.col("__cut")).withColumn("cut_words", F.col("__cut_words"))
    return rows.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__whole") * F.col("size") + _extra(F.col("__rank"), F.col("size"))).alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of the mix: docs' columns, each row as often as it is taken, and where the cut falls
    inside a row its first words once more."""
    sized, planned = plan(docs, **how)
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    held = held.withColumn("__size", size_of(F.col("__row.text").cast("string"))).withColumn("__rank", rank_of(F.col("__row.doc_id").cast("bigint"), F.col("__size"), how.get("seed", SEED))).withColumn("__s", F.col("__row.source").cast("string"))
    # the plan of a mix is one row a source; it is broadcast only where that is surely small
    small = planned.limit(4097).count() <= 4096
    if small:
        plan_ = planned.select(*[F.col(c).alias(f"__{c}") for c in planned.columns])
        rows = held.join(F.broadcast(plan_), F.col("__s").eqNullSafe(F.col("__source")))
    else:
        rows = _with_plan(held, planned)
    rows = rows.withColumn("cut", F.col("__cut")).withColumn("cut_words", F.col("__cut_words")).withColumn("__more", _extra(F.col("__rank"), F.col("__size")))
    whole = F.col("__whole") + F.when((F.col("__more") == F.col("__size")) & (F.col("__size") > 0), 1).otherwise(0)
    part = F.when((F.col("__more") > 0) & (F.col("__more") < F.col("__size")), F.col("__more")).otherwise(0)
    # one entry for each copy: 0 for the whole text, else the number of its words
    copies = F.concat(F.array_repeat(F.lit(0).cast("bigint"), whole.cast("int")), F.when(part > 0, F.array(part.cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select("__row", F.explode(copies).alias("__words"))
    partial = F.pandas_udf(_first_words, "string")
    text = F.when(F.col("__words") == 0, F.col("__row.text")).otherwise(partial(F.when(F.col("__words") > 0, F.col("__row.text")), "__words"))
    return rows.select(*[(text if c == "text" else F.col(f"__row.`{c}`")).alias(c) for c in names])


def _first_words(texts, counts):
    import re

    import pandas as pd

    word = re.compile("[^\x20\x09-\x0d]+")
    out = []
    for text, n in zip(texts, counts, strict=True):
        end = None
        if text is not None and n:
            for k, m in enumerate(word.finditer(text), 1):
                if k == n:
                    end = m.end()
                    break
        out.append(None if end is None else text[:end])
    return pd.Series(out, dtype="object")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
h AS (SELECT *, CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(size AS VARCHAR)), 1, 15) AS BIGINT) AS rank FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM h GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, (SELECT CAST(sum(source_size) AS BIGINT) FROM s) AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS place, sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) - 3 * source_size AS capped, sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) - weight AS gone, (SELECT sum(weight) FROM w) AS all_weight FROM w),
l AS (SELECT *, CAST(total - capped AS DOUBLE) / CAST(all_weight - gone AS DOUBLE) AS level FROM o),
k AS (SELECT coalesce(min(place), 0) AS first_open FROM l WHERE weight * level <= 3 * source_size AND source_size > 0),
v AS (SELECT level AS the_level, first_open FROM k JOIN l ON place = first_open),
t AS (SELECT source, source_size, CASE WHEN place < coalesce(first_open, 1000000000) THEN 3 * CAST(source_size AS DOUBLE) ELSE weight * the_level END AS target FROM l LEFT JOIN v ON TRUE),
g AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(round(target) AS BIGINT) // source_size END AS whole, CASE WHEN source_size = 0 THEN 0 ELSE CAST(round(target) AS BIGINT) % source_size END AS rest FROM t),
r AS (SELECT source, rank, sum(size) AS words, count(*) AS n FROM h GROUP BY source, rank),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY rank) - words AS before FROM r)
SELECT h.doc_id, h.size, g.source_size, g.target, CAST(g.whole * h.size + CASE WHEN c.before + c.words <= g.rest THEN h.size WHEN c.before <= g.rest THEN least(h.size, (g.rest - c.before) // c.n) ELSE 0 END AS BIGINT) AS taken
FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source JOIN c ON c.source IS NOT DISTINCT FROM h.source AND c.rank = h.rank
"""
