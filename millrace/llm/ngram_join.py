"""N-gram Jaccard self-join by universe partition and pigeonhole.

A document is the set of its 5-word shingles, as 64-bit hashes. Documents of
equal sets form a class; what follows works on one representative of each.

Sizes fall into bands of ratio 1.5. A band's scheme cuts the universe of hashes
into m equal ranges ("segments"), m being above the most elements in which a
linked pair of that band can differ (H), so two linked sets agree on at least
m - H segments. Every set indexes its segments, each as a hash of the elements
in it, and probes only as many segments as its own H asks for, plus one: the
cheapest by the counts of their keys over the corpus. In bands of small sets the
index also holds each segment's one-deletion neighbourhood, and an allocation
may let a segment differ in one element, which counts for two, where that is
cheaper than probing a frequent key. Sets probe their own band's scheme and those
below that hold sizes they can be linked with (one from 67 percent on, two for some sizes below). Pairs that share a key are compared by fingerprints of finer cells, of which
no more can differ than elements; what passes is verified exactly on full sets.

Key counts come from a table of 2^20 counters, which is all that is broadcast
but for bitmaps of at most 2^28 bits. Hot keys and roots are join keys that Spark shuffles for
the join itself, so that adaptive execution splits their partitions on either side; what meets a
component's or a class's single row is salted besides. No pair within the thresholds is ever skipped:
counts only choose which segments are probed.

Defined cases: null and empty texts, and those of white space only, have an
empty set: 0 shingles, no link, a component of their own. Repeated rows are
linked like other equal documents and each gets its row. A null doc_id takes part; a
component's id is its smallest doc_id, null where all are null. Other columns
are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SLOTS_LOG2, DELETIONS_UP_TO, SALTS = 20, 40, 16


class Bands:
    """Size bands and their schemes for a threshold of p percent."""

    def __init__(self, p: int):
        if not 50 <= p <= 100:
            raise ValueError("the threshold must be 50 to 100 percent")
        self.p = p
        self.ends = [max(8, self.exact_below() - 1)]
        while self.ends[-1] < 1 << 40:
            self.ends.append(max(self.ends[-1] + 1, self.ends[-1] * 3 // 2))

    def differ(self, a: int, b: int) -> int:
        """Most elements in which linked sets of these sizes differ."""
        return (100 - self.p) * (a + b) // (100 + self.p)

    def exact_below(self) -> int:
        """Smaller sets link with equal ones only."""
        n = 1
        while self.p < 100 and self.differ(n, n * 100 // self.p) == 0:
            n += 1
        return n if self.p < 100 else 1 << 40

    def band(self, n: int) -> int:
        return bisect_left(self.ends, n)

    def probed(self, n: int) -> list[int]:
        """A set's own band and those below with sizes that it can be linked with, descending."""
        own = self.band(n)
        return [own, *[b for b in range(own - 1, -1, -1) if self.ends[b] * 100 >= self.p * n and self.ends[b] >= self.exact_below()]]

    def segments(self, band: int) -> int:
        u = self.ends[band]
        h = self.differ(u, u * 100 // self.p)
        return h + 1 + max(1, h // 16)

    def cells(self, elements: np.ndarray, band: int) -> bytes:
        """A byte for each of four times as many cells of the universe as elements may differ."""
        u = self.ends[band]
        return (segment_keys(elements, band + (1 << 20), 4 * (self.differ(u, u * 100 // self.p) + 1))[0] >> C.U(56)).astype(np.uint8).tobytes()

    def need(self, band: int, n: int) -> int:
        return self.differ(min(n, self.ends[band]), n) + 1


def segment_keys(elements: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of m segments of sorted elements; each element's key with it left out, and its segment."""
    bounds = np.asarray([(k << 64) // m for k in range(1, m)], C.U)
    at = np.concatenate(([0], np.searchsorted(elements, bounds), [len(elements)]))
    mixed = C.mix(elements, 5)
    total = np.concatenate((np.zeros(1, C.U), np.cumsum(mixed, dtype=C.U)))
    sums = total[at[1:]] - total[at[:-1]]
    salt = C.mix(np.arange(m, dtype=C.U) + C.U(band << 32), 9)
    segment = np.repeat(np.arange(m), np.diff(at))
    return C.mix(sums ^ salt), C.mix((sums[segment] - mixed) ^ salt[segment]), segment


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_SETS = "uid bigint, doc_id bigint, h bigint, n_shingles bigint, set_key binary, schemes array<struct<band:int,keys:array<bigint>,deleted:array<bigint>,segment:array<int>>>"


def _sets(p: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        bands, hashes, seen = Bands(p), C.WordHashes(), set()
        small = bands.exact_below()
        t = pa.list_(pa.struct([("band", pa.int32()), ("keys", pa.list_(pa.int64())), ("deleted", pa.list_(pa.int64())), ("segment", pa.list_(pa.int32()))]))
        for doc_ids, hs, texts in C.rows_of(batches, "doc_id", "h", "text"):
            out = []
            for doc_id, h, text in zip(doc_ids, hs, texts, strict=True):
                s = np.unique(C.shingle_hashes(hashes(C.ascii_words(text)), k))
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                schemes = None
                if len(s) >= small and key not in seen:
                    seen.add(key)
                    schemes = []
                    for band in bands.probed(len(s)):
                        keys, deleted, segment = segment_keys(s, band, bands.segments(band))
                        few = len(s) <= DELETIONS_UP_TO
                        schemes.append({"band": band, "keys": _long(keys), "deleted": _long(deleted) if few else [], "segment": segment if few else []})
                out.append((uid, doc_id, h, len(s), key, schemes))
                uid += 1
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), t], strict=True)], names=["uid", "doc_id", "h", "n_shingles", "set_key", "schemes"])

    return run


def allocate(keys: np.ndarray, deleted: np.ndarray, segment: np.ndarray, need: int, cost) -> tuple[np.ndarray, np.ndarray]:
    """Segments to probe as they are, and those also to probe with one element left out.

    Units are bought cheapest first until there are ``need``: the first unit of
    a segment is its key; the second, where deletions are at hand, its
    neighbourhood."""
    first = cost(keys)
    order = np.argsort(first, kind="stable")
    chosen = order[:need]
    if not len(deleted):
        return chosen, np.empty(0, int)
    second = np.bincount(segment, weights=cost(deleted), minlength=len(keys)) + first
    chosen, extra = chosen.tolist(), []
    while len(chosen) > 1:  # a neighbourhood in place of the dearest key
        free = [i for i in chosen[:-1] if i not in extra]
        if not free:
            break
        best = min(free, key=lambda i: second[i])
        if second[best] >= first[chosen[-1]]:
            break
        extra.append(best)
        chosen.pop()
    return np.asarray(chosen, int), np.asarray(extra, int)


def _rows(p: int, counts_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, counts = Bands(p), counts_b.value

        def cost(x: np.ndarray) -> np.ndarray:
            return counts[(x.view(C.U) >> C.U(64 - SLOTS_LOG2)).astype(np.int64)]

        for uids, sizes, all_schemes in C.rows_of(batches, "uid", "n_shingles", "schemes"):
            parts = []
            for uid, n, schemes in zip(uids, sizes, all_schemes, strict=True):
                own = bands.band(n)
                for s in schemes:
                    keys, deleted, segment = np.asarray(s["keys"], np.int64), np.asarray(s["deleted"], np.int64), np.asarray(s["segment"], np.int64)
                    chosen, extra = allocate(keys, deleted, segment, bands.need(s["band"], n), cost)
                    probe = np.zeros(len(keys), bool)
                    probe[chosen] = True
                    near = np.isin(segment, extra) if len(deleted) else np.zeros(0, bool)
                    index = s["band"] == own
                    if not index:
                        keys, probe, deleted, near = keys[probe], probe[probe], deleted[near], near[near]
                    parts.append((np.concatenate((keys, deleted)), np.concatenate((probe, near)), index, uid, n))
            if parts:
                lens = [len(x[0]) for x in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[0] for x in parts])), pa.array(np.concatenate([x[1] for x in parts])), pa.array(np.repeat([x[2] for x in parts], lens)), pa.array(np.repeat(np.asarray([x[3] for x in parts], np.int64), lens)), pa.array(np.repeat(np.asarray([x[4] for x in parts], np.int64), lens))],
                    names=["key", "probe", "indexed", "uid", "n"],
                )

    return run


def connected(edges: DataFrame, tag: str) -> DataFrame:
    """(node, root): the smallest node that edges (a, b) reach, for every node that has an edge.

    Labels spread to neighbours and then jump to their label's label, so rounds
    grow with the logarithm of a component's diameter. Each round is written."""
    both = C.materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{tag}-edges")
    labels = C.materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"), f"{tag}-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("seen"))
        spread = labels.join(near, labels.node == near.a).select("node", "root", F.least("root", "seen").alias("low"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("far"))
        after = C.materialize(spread.join(jump, F.col("low") == F.col("at")).select("node", F.least("low", "far").alias("root"), (F.least("low", "far") < F.col("root")).alias("moved")), f"{tag}-labels")
        labels = after.select("node", "root")
        if not after.filter("moved").limit(1).count():
            return labels


def _key() -> F.Column:
    """Order of rows: by doc_id, null last, then by the text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("h"))


def links(docs: DataFrame, percent: int = 90, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents' classes, the classes, and the linked pairs of classes.

    docs has doc_id and text. Returns (uid, doc_id, h: the text's hash, n_shingles,
    set_key), (set_key, rep, members, low_id, low: the least (doc_id, h)) and (a, b)
    with a and b reps, each pair once.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    staged = C.materialize(docs.withColumn("h", F.xxhash64("text")).mapInArrow(_sets(percent, k), _SETS), "ngram-sets")
    members = staged.select("uid", "doc_id", "h", "n_shingles", "set_key")
    classes = C.materialize(members.filter("set_key is not null").groupBy("set_key").agg(F.min("uid").alias("rep"), F.count("*").alias("members"), F.min("doc_id").alias("low_id"), F.min(_key()).alias("low")), "ngram-classes")
    lone = staged.filter("schemes is not null").select("uid", "n_shingles", "set_key", "schemes").repartition(C.parts(spark), "set_key").dropDuplicates(["set_key"])
    ready = C.materialize(lone.join(classes.select("set_key", "rep"), "set_key").select(F.col("rep").alias("uid"), "n_shingles", "schemes"), "ngram-keys")

    own = ready.select(F.explode(F.expr("concat(flatten(schemes.keys), flatten(schemes.deleted))")).alias("key"))
    slot = F.shiftrightunsigned("key", 64 - SLOTS_LOG2)
    counts = np.ones(1 << SLOTS_LOG2, np.float64)
    often = own.groupBy(slot.alias("slot")).count().toArrow()  # at most 2^20 rows, whatever the input
    counts[often.column("slot").to_numpy()] = often.column("count").to_numpy()
    shared = spark.sparkContext.broadcast(counts)
    rows = ready.mapInArrow(_rows(percent, shared), "key bigint, probe boolean, indexed boolean, uid bigint, n bigint")
    p, q = rows.filter("probe").alias("p"), rows.filter("indexed").alias("q")
    near = p.join(q, (F.col("p.key") == F.col("q.key")) & ((F.col("q.n") < F.col("p.n")) | (F.col("q.n") == F.col("p.n")) & (F.col("q.uid") < F.col("p.uid"))) & (F.col("q.n") * 100 >= F.col("p.n") * percent))
    pairs = C.materialize(near.select(F.col("p.uid").alias("a"), F.col("q.uid").alias("b")).distinct(), "ngram-pairs")
    return members, classes, C.materialize(_verified(docs, classes, pairs, percent, k), "ngram-links")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs whose full sets meet the threshold."""
    spark = docs.sparkSession
    wanted = C.materialize(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct().join(classes, "rep").select("rep", "set_key", "low_id"), "ngram-wanted")
    size = C.bitmap_log2(wanted.count())
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << size)).cast("int")
    shared = spark.sparkContext.broadcast(C.bitmap(wanted.select(F.col("low_id").alias("doc_id")).select(spot.alias("spot")), size))  # it only spares work: other rows fall to the join

    bands = Bands(percent)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = C.WordHashes()
        for b in batches:
            b = b.filter(pa.array(C.marked(shared.value, b.column(2).to_numpy(zero_copy_only=False))))
            rows = []
            for (texts,) in C.rows_of([b], "text"):
                for text in texts:
                    s = np.unique(C.shingle_hashes(hashes(C.ascii_words(text)), k))
                    if len(s):
                        rows.append((hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), bands.band(len(s)), [bands.cells(s, band) for band in bands.probed(len(s))], s.tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.binary()], strict=True)], names=["set_key", "n", "band", "cells", "elements"])

    # every member of a class has its set: those of the smallest doc_id supply it
    sets = docs.withColumn("spot", spot).mapInArrow(full, "set_key binary, n bigint, band int, cells array<binary>, elements binary").repartition(C.parts(spark), "set_key").dropDuplicates(["set_key"])
    sets = C.materialize(wanted.select("rep", "set_key").join(sets, "set_key").select("rep", "n", "band", "cells", "elements"), "ngram-elements")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of which no more cells differ than linked sets' elements may: what fails this isn't linked."""
        for a_ids, b_ids, n, m, p, q, cells, other in C.rows_of(batches, "a", "b", "n", "m", "p", "q", "cells", "other"):
            keep = []
            for i in range(len(a_ids)):
                mine = cells[i][p[i] - q[i]]  # those of the smaller set's band
                if np.count_nonzero(np.frombuffer(mine, np.uint8) != np.frombuffer(other[i], np.uint8)) <= bands.differ(n[i], m[i]):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a_ids[i] for i in keep], pa.int64()), pa.array([b_ids[i] for i in keep], pa.int64())], names=["a", "b"])

    one, two = sets.select(F.col("rep").alias("a"), "n", F.col("band").alias("p"), "cells"), sets.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("band").alias("q"), F.col("cells")[0].alias("other"))
    left = C.materialize(pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "p", "q", "cells", "other").mapInArrow(near, "a bigint, b bigint"), "ngram-near")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a_ids, b_ids, xs, ys in C.rows_of(batches, "a", "b", "x", "y"):
            keep = []
            for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
                x, y = np.frombuffer(x, C.U), np.frombuffer(y, C.U)
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a_ids[i] for i in keep], pa.int64()), pa.array([b_ids[i] for i in keep], pa.int64())], names=["a", "b"])

    x, y = sets.select(F.col("rep").alias("a"), F.col("elements").alias("x")), sets.select(F.col("rep").alias("b"), F.col("elements").alias("y"))
    ends = left.select("a").union(left.select("b")).distinct()
    return left.join(x.join(ends, "a", "left_semi"), "a").join(y.join(ends.withColumnRenamed("a", "b"), "b", "left_semi"), "b").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def _by_root(classes: DataFrame, told: DataFrame) -> DataFrame:
    """classes beside their component's only row: a component may hold most classes, so its key is split."""
    many = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return classes.withColumn("salt", F.pmod(F.hash("rep"), F.lit(SALTS))).join(many, ["root", "salt"])


def components(docs: DataFrame, percent: int = 90, k: int = 5) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, n_similar (other rows linked directly), component_id."""
    members, classes, linked = links(docs, percent, k)
    roots = connected(linked, "ngram")
    ends = linked.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(linked.select("b", "a"))
    others = ends.join(classes.select(F.col("rep").alias("other"), "members"), "other").groupBy("rep").agg(F.sum("members").alias("outside"))
    linked_classes = classes.join(roots.withColumnRenamed("node", "rep"), "rep").join(others, "rep")
    lows = linked_classes.groupBy("root").agg(F.min("low_id").alias("component_id"))
    alone = classes.filter("members > 1").join(roots.withColumnRenamed("node", "rep"), "rep", "left_anti").select("set_key", (F.col("members") - 1).alias("similar"), F.col("low_id").alias("component_id"))
    told = alone.union(_by_root(linked_classes, lows).select("set_key", (F.col("members") - 1 + F.col("outside")).alias("similar"), "component_id"))
    # a class may hold a third of all rows: its key is split
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = members.withColumn("salt", F.pmod(F.hash("uid"), F.lit(SALTS))).join(told, ["set_key", "salt"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("similar", F.lit(0).cast("bigint")).alias("n_similar"), F.when(F.col("similar").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 90, k: int = 5) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id (then text hash); all columns stay.

    Rows with an empty set all stay. Only rows that a bitmap marks as
    possibly concerned are shuffled; the join decides about them.
    """
    spark = docs.sparkSession
    members, classes, linked = links(docs, percent, k)
    roots = connected(linked, "ngram")
    linked_classes = classes.join(roots.withColumnRenamed("node", "rep"), "rep")
    best = linked_classes.groupBy("root").agg(F.min("low").alias("best"))
    alone = classes.filter("members > 1").join(roots.withColumnRenamed("node", "rep"), "rep", "left_anti").select("set_key", F.col("low").alias("best"))
    told = alone.union(_by_root(linked_classes, best).select("set_key", "best")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = members.groupBy("doc_id", "h", "set_key").agg(F.count("*").alias("rows")).withColumn("salt", F.pmod(F.hash("doc_id", "h"), F.lit(SALTS))).join(told, ["set_key", "salt"])
    stays = F.col("best") == _key()
    acts = C.materialize(rows.filter(~stays | (F.col("rows") > 1)).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), stays.alias("__stays")), "ngram-acts")
    size = C.bitmap_log2(acts.count())
    spot = F.pmod(F.xxhash64("__id", "__h"), F.lit(1 << size)).cast("int")
    shared = spark.sparkContext.broadcast(C.bitmap(acts.select(spot.alias("spot")), size))

    @F.pandas_udf("boolean")
    def marked(spots):
        import pandas as pd

        return pd.Series(C.marked(shared.value, spots.to_numpy()))

    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    held = held.withColumn("__id", F.col("__row.doc_id").cast("bigint")).withColumn("__h", F.xxhash64(F.col("__row.text").cast("string"))).withColumn("__marked", marked(spot))
    acts = acts.select(F.col("__id").alias("__i"), F.col("__h").alias("__g"), "__stays")
    some = held.filter("__marked").join(acts, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__g")), "left")
    out = held.filter("not __marked").select("__row").union(some.filter("__stays is null").select("__row")).union(some.filter("__stays").dropDuplicates(["__id", "__h"]).select("__row"))
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in names])
