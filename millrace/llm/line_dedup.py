"""Line deduplication by an exact set-similarity join.

A line is the set of its distinct words (A-Z lower-cased). A line is removed if
an earlier one, by (doc_id, text hash, line number), has a Jaccard similarity of
at least ``percent``; whether that one is removed itself doesn't matter, so the
outcome needs no order of work. Lines of equal sets form a class, whose first line
stands for it: the others are removed anyway, and the first is removed where
the join links its class with one that begins earlier.

The join orders a set's words by rarity and keeps prefixes: two sets can only be
linked if they share a word among their n - ceil(t n) + 1 rarest. Rarity comes from
2^20 hashed counters over all lines (with the word's hash after it, any order is
exact as long as it is the same for all sets); a word whose counter is 1 is in no
other line and is left out. Length and position filters follow,
and one of parities (64 cells of the universe, twice for hubs, each with the parity of its elements:
no more cells than elements can differ), then the exact similarity on full sets.

What is asked of a line is only whether an earlier one is near, so lines that follow a
common template aren't compared with each other. Words whose counter is above
HUB_ABOVE first meet HUBS hubs alone: of each size, the earliest lines in as many hashed
parts of those with that word near enough to the front of their prefix. Lines that the most
alike of these shows to be removed are decided, and from then on only serve as the earlier side.
The rest is compared with all earlier lines, so nothing is lost.

Defined cases: lines end at a line feed; a line without words is kept and matches
nothing; null and empty texts have no lines; rows equal in doc_id and text are
one document and get the same result; a null doc_id comes first in the order;
``dedup`` keeps other columns, whatever their names, and leaves out a removed
line with one line feed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PERCENT, SLOTS_LOG2, HUB_ABOVE, HUBS, SEEN, FEW = 90, 20, 256, 64, 1_000_000, 100_000
#: Added to the place of a decided line's words: it looks for no other, as nothing follows a word so far behind.
_DONE = 1 << 30


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> C.U(64 - SLOTS_LOG2)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SLOTS_LOG2, np.int64)
    for (texts,) in C.rows_of(batches, "text"):
        total += np.bincount(_slots(C.words_by_line(texts)[0]), minlength=1 << SLOTS_LOG2)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["slot", "n"])


def _sorted_by(line: np.ndarray, low: np.ndarray, exact: tuple[np.ndarray, ...]) -> np.ndarray:
    """Order by line (ascending already) and then by the arrays of ``exact``, last one first, of which ``low``
    holds 40 bits that sort alike. One sort of 64-bit keys does, unless two of them tie by these bits only."""
    if len(line) and line[-1] < 1 << 24:
        key = (line.astype(C.U) << C.U(40)) | low
        order = np.argsort(key, kind="stable")
        key = key[order]
        tied = np.flatnonzero(key[1:] == key[:-1])
        if not len(tied) or all((x[order[tied]] == x[order[tied + 1]]).all() for x in exact):
            return order
    return np.lexsort((*exact, line))


class LineSets:
    """The sets of all lines with words of some texts: elements line by line, ascending."""

    def __init__(self, texts: list[str | None]):
        h, line, first_lines = C.words_by_line(texts)
        order = _sorted_by(line, h >> C.U(24), (h,))
        h, line = h[order], line[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.elements, line = h[new], line[new]
        self.starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
        lines = line[self.starts]
        self.sizes = np.diff(np.append(self.starts, len(line)))
        self.text = np.searchsorted(first_lines, lines, "right") - 1
        self.number = lines - first_lines[self.text] if len(lines) else lines

        def total(ufunc, x: np.ndarray) -> np.ndarray:
            return ufunc.reduceat(x, self.starts).view(np.int64) if len(lines) else np.zeros(0, np.int64)

        e = self.elements  # evenly spread 64-bit hashes
        # a set's key: two sums of its elements' hashes, 128 bits together
        self.keys = [total(np.add, e), total(np.add, (e ^ (e >> C.U(29))) * (e >> C.U(32) | C.U(1)))]
        # parities of 64 cells: sets that differ in d elements differ in at most d of them
        self.parities, self.others = (total(np.bitwise_xor, C.U(1) << (e >> C.U(k) & C.U(63))) for k in (0, 6))


_LINES = "uid bigint, doc_id bigint, h bigint, line int, n int, k1 bigint, k2 bigint, parities bigint, others bigint, prefix array<bigint>, places array<int>, crowded array<boolean>"


def _lines(percent: int, counts_b):
    """A row for each line with words, and one for each document (line -1, n: all its lines).

    Of equal sets in a task the first alone gets its prefix: the class's least uid is among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        counts = counts_b.value
        ranks = np.empty(len(counts), C.U)
        ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=C.U)
        seen: set[tuple[int, int]] = set()
        for b in batches:
            texts = b.column(2).to_pylist()
            s = LineSets(texts)
            n, count = s.sizes, len(s.sizes)
            if len(seen) > SEEN:
                seen.clear()  # the next of a set gets a prefix once more
            fresh = np.zeros(count, bool)
            for k, key in enumerate(zip(s.keys[0].tolist(), s.keys[1].tolist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    fresh[k] = True
            # sets that can be linked with a larger or a smaller one have a prefix
            open_ = fresh & ((100 * n // percent > n) | (n * percent <= 100 * (n - 1)))
            use = np.repeat(open_, n)
            of, e = np.repeat(np.arange(count), n)[use], s.elements[use]
            slots = _slots(e)
            rank = ranks[slots]
            order = _sorted_by(of, (rank << C.U(20)) | ((e >> C.U(24)) & C.U(0xFFFFF)), (e, rank))
            held = np.where(open_, n, 0)
            at = np.arange(len(of)) - np.repeat(np.cumsum(held) - held, held)
            often = counts[slots[order]]
            keep = (at < (n - (percent * n + 99) // 100 + 1)[of]) & (often > 1)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(of[keep], minlength=count)))).astype(np.int32)
            offsets = pa.array(np.append(offsets, np.full(len(texts), offsets[-1], np.int32)))
            row = pa.array(np.append(s.text, np.arange(len(texts))))
            docs = lambda x, t, fill: pa.concat_arrays([pa.array(x).cast(t), fill if isinstance(fill, pa.Array) else pa.nulls(len(texts), t)])  # noqa: B023, E731
            n_lines = pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    docs(uid + np.arange(count), pa.int64(), None), b.column(0).take(row), b.column(1).take(row), docs(s.number, pa.int32(), pa.array([-1] * len(texts), pa.int32())), docs(n, pa.int32(), n_lines),
                    docs(s.keys[0], pa.int64(), None), docs(s.keys[1], pa.int64(), None), docs(s.parities, pa.int64(), None), docs(s.others, pa.int64(), None),
                    pa.ListArray.from_arrays(offsets, pa.array(e[order][keep].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(at[keep].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(often[keep] > HUB_ABOVE)),
                ],
                names=["uid", "doc_id", "h", "line", "n", "k1", "k2", "parities", "others", "prefix", "places", "crowded"],
            )
            uid += count

    return run


def _apart(x: str, y: str, name: str) -> F.Column:
    return F.bit_count(F.col(f"{x}.{name}").bitwiseXOR(F.col(f"{y}.{name}")))


def _near(x: str, y: str, percent: int, *parities: str) -> F.Column:
    """The filters on two heads of one word: sizes, parities, and what follows the word in either."""
    # least overlap of a linked pair: t / (1 + t) of both sizes; what follows the shared word must suffice for it
    need = F.expr(f"cast(ceil({percent} * cast({x}.n + {y}.n as bigint) / {100 + percent}) as bigint)")
    out = (F.col(f"{y}.n") * 100 >= F.col(f"{x}.n") * percent) & (F.col(f"{x}.n") * 100 >= F.col(f"{y}.n") * percent) & (F.least(F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at").bitwiseAND(F.lit(_DONE - 1))) >= need)
    for p in parities:
        out &= _apart(x, y, p) <= F.col(f"{x}.n") + F.col(f"{y}.n") - 2 * need
    return out


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The removed lines (doc_id, h, line), some more than once; the linked pairs that decide so (a: a line that
    stands for its class, b: one of an earlier class, by uid); and all rows (doc_id, h, n_lines)."""
    spark = docs.sparkSession
    C.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text")).select("doc_id", "h", "text")
    counts = np.zeros(1 << SLOTS_LOG2, np.int64)
    told = docs.select("text").mapInArrow(_counts, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most 2^20 rows
    counts[told.column("slot").to_numpy()] = told.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(counts)
    rows = C.materialize(docs.mapInArrow(_lines(percent, shared), _LINES), "lines")
    lines = rows.filter("line >= 0")
    place = F.struct("doc_id", "h", "line")
    # a class is stood for by the line of its least uid; first is where it begins
    classes = C.materialize(lines.groupBy("k1", "k2").agg(F.min("uid").alias("rep"), F.min(place).alias("first"), F.count("*").alias("members")), "line-classes")
    firsts = classes.select("rep", "first")
    # d orders by doc_id, nulls first: it only says which of two lines is worth looking at
    order = classes.select(F.col("rep").alias("uid"), F.coalesce("first.doc_id", F.lit(-(1 << 63))).alias("d"))
    sets = C.materialize(lines.filter("size(prefix) > 0").select("uid", "n", "parities", "others", "prefix", "places", "crowded").join(order, "uid"), "line-prefixes")

    def heads(some: DataFrame, *more: str) -> DataFrame:
        return some.select("uid", "d", "n", "parities", *more, F.explode(F.arrays_zip("prefix", "places", "crowded")).alias("p")).select("uid", "d", "n", "parities", *more, F.col("p.prefix").alias("token"), F.col("p.places").alias("at"), F.col("p.crowded").alias("crowded"))

    def decide(pairs: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
        """Of candidate pairs (a, b), the linked ones whose b begins earlier, and the lines a that they decide."""
        pairs = C.materialize(pairs, f"line-pairs-{tag}")
        links = _verified(docs, lines, pairs, percent)
        ahead = links.join(firsts.select(F.col("rep").alias("a"), F.col("first").alias("mine")), "a").join(firsts.select(F.col("rep").alias("b"), F.col("first").alias("other")), "b").filter("other < mine")
        links = C.materialize(ahead.select("a", "b"), f"line-links-{tag}")
        return links, links.select(F.col("a").alias("uid")).distinct()

    crowded = heads(sets.filter("exists(crowded, c -> c)"), "others").filter("crowded")
    # so near the front that lines of the same size with the word as near the front pass the filter of places
    front = F.col("n") - F.col("at") >= F.expr(f"ceil({2 * percent} * cast(n as bigint) / {100 + percent})")
    part = F.pmod(F.xxhash64("uid"), F.lit(HUBS)).alias("part")
    hubs = crowded.filter(front).groupBy("token", "n", part).agg(F.min(F.struct("d", "uid", "parities", "others", "at")).alias("hub")).select("token", "n", "hub.*")
    y, x = hubs.alias("y"), crowded.alias("x")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.d") >= F.col("y.d")) & (F.col("x.uid") != F.col("y.uid")) & _near("x", "y", percent, "parities", "others"))
    nearest = met.groupBy(F.col("x.uid").alias("a")).agg(F.min(F.struct(_apart("x", "y", "parities") + _apart("x", "y", "others"), F.col("y.d"), F.col("y.uid").alias("b"))).alias("hub"))
    by_hub, decided = decide(nearest.select("a", "hub.b"), "hubs")
    done = decided.withColumn("done", F.lit(_DONE))
    if decided.limit(FEW + 1).count() <= FEW:
        done = F.broadcast(done)  # spares a shuffle of all prefixes
    all_heads = heads(sets.join(done, "uid", "left").withColumn("done", F.coalesce("done", F.lit(0))), "done").withColumn("at", F.col("at") + F.col("done")).drop("crowded", "done")
    x, y = all_heads.alias("x"), all_heads.alias("y")
    near = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.d") >= F.col("y.d")) & (F.col("x.uid") != F.col("y.uid")) & _near("x", "y", percent, "parities"))
    by_any, others = decide(near.select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")).distinct(), "rest")
    # removed: in classes of several lines all but the first, and first lines that a similar class precedes
    several = classes.filter("members > 1").select("k1", "k2", "first")  # a class of very many lines: AQE splits its side of the join
    copies = lines.select("k1", "k2", place.alias("at")).join(several, ["k1", "k2"]).filter("at != first").select("at.*")
    preceded = firsts.join(decided.union(others).select(F.col("uid").alias("rep")), "rep", "left_semi").select("first.*")
    return copies.union(preceded), by_hub.union(by_any), rows.filter("line < 0").select("doc_id", "h", F.col("n").cast("bigint").alias("n_lines"))


def _verified(docs: DataFrame, lines: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets meet the threshold; only the lines concerned are read again."""
    spark = docs.sparkSession
    wanted = C.materialize(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct().join(lines.select("uid", "doc_id", "h", "k1", "k2"), "uid"), "line-wanted")
    size = C.bitmap_log2(wanted.count())
    # marks by hash: they only spare work, what they let through falls to the join
    of_doc, of_set = F.pmod(F.xxhash64("doc_id", "h"), F.lit(1 << size)).cast("int"), F.col("k1").bitwiseAND(F.lit((1 << size) - 1)).cast("int")
    by_doc, by_set = (spark.sparkContext.broadcast(C.bitmap(wanted.select(spot.alias("spot")), size)) for spot in (of_doc, of_set))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(C.marked(by_doc.value, b.column(1).to_numpy(zero_copy_only=False))))
            s = LineSets(b.column(0).to_pylist())
            use = np.flatnonzero(C.marked(by_set.value, s.keys[0] & ((1 << size) - 1)))
            ends = s.starts + s.sizes
            rows = [s.elements[s.starts[k] : ends[k]].tobytes() for k in use.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(s.keys[0][use]), pa.array(s.keys[1][use]), pa.array(rows, pa.binary())], names=["k1", "k2", "elements"])

    found = docs.select("text", of_doc.alias("spot")).mapInArrow(full, "k1 bigint, k2 bigint, elements binary").repartition(C.parts(spark), "k1", "k2").dropDuplicates(["k1", "k2"])
    sets = C.materialize(wanted.select("uid", "k1", "k2").join(found, ["k1", "k2"]).select("uid", "elements"), "line-elements")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a_ids, b_ids, xs, ys in C.rows_of(batches, "a", "b", "s", "t"):
            keep = []
            for i, (s, t) in enumerate(zip(xs, ys, strict=True)):
                n, m = len(s) // 8, len(t) // 8
                both = n + m - len(np.union1d(np.frombuffer(s, C.U), np.frombuffer(t, C.U)))
                if 100 * both >= percent * (n + m - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a_ids[i] for i in keep], pa.int64()), pa.array([b_ids[i] for i in keep], pa.int64())], names=["a", "b"])

    one, two = sets.select(F.col("uid").alias("a"), F.col("elements").alias("s")), sets.select(F.col("uid").alias("b"), F.col("elements").alias("t"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "s", "t").mapInArrow(check, "a bigint, b bigint")


def report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_lines (all), n_removed, removed_lines (their numbers from 0, ascending)."""
    removed, _, rows = removed_lines(docs, percent)
    gone = removed.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("line")).alias("removed_lines"))
    out = rows.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.h") == F.col("g.h")), "left")
    return out.select("d.doc_id", "n_lines", F.coalesce(F.size("removed_lines"), F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"))


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with the removed lines cut out of their texts; all rows and columns stay."""
    gone = removed_lines(docs, percent)[0].groupBy("doc_id", "h").agg(F.collect_set("line").alias("__gone"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    held = held.withColumn("__id", F.col("__row.doc_id").cast("bigint")).withColumn("__h", F.xxhash64(F.col("__row.text").cast("string")))
    both = held.join(gone, F.col("__id").eqNullSafe(gone["doc_id"]) & (F.col("__h") == gone["h"]), "left")
    text = F.when(F.col("__gone").isNull(), F.col("__row.text")).otherwise(F.array_join(F.filter(F.split("__row.text", "\n"), lambda _, i: ~F.array_contains("__gone", i)), "\n"))
    return both.select(*[(text if c == "text" else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
