"""Benchmark decontamination by an FM-index for every training shard.

A shard is a run of whole documents of one task (up to SHARD_CHARS of text, or
one longer document). Its words are 64-bit hashes, and those that some benchmark item
may hold, as a bitmap of all the benchmark's words says, become symbols; any
other word becomes a separator, and runs of words shorter than the shortest window
are left out, as no window can occur there. Over the rest stand a suffix array,
the Burrows-Wheeler transform as a wavelet matrix with ranks, and every eighth
suffix position. Windows are searched backward, many at once; occurrences are
located by stepping to a sampled position, and a document's hit words are merged
into spans.

The benchmark is the query set. It is read once and cut into blocks of about BLOCK_WORDS words,
each of which is one broadcast. A shard is indexed once and searched block by block,
and where there are several, a worker lets go of one before it takes the next.

Defined cases: null, empty and word-less texts have 0 words and no hit; an item
without words has no window; an item with a null id counts under the empty
string; repeated rows and repeated items each count (items by distinct id);
other columns are ignored by ``contamination`` and kept by ``decontaminate``,
whatever their names; an empty table gives an empty result, an empty benchmark
no hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, SAMPLE, SHARD_CHARS, BLOCK_WORDS = 10, 8, 16_000_000, 500_000
_NOT_WORD = bytes(set(range(128)) - set(b"0123456789abcdefghijklmnopqrstuvwxyz") - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_TABLE = bytes(0x20 if b in _NOT_WORD else C.LOWER[b] for b in range(256))
_WORD = re.compile("[^\x00-/:-`{-\x7f]+")  # on lower-cased text


def words_of(text: str | None) -> list[bytes]:
    """Words of the lower-cased (A-Z) text: runs of other than ASCII control, space and punctuation characters."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Prefix doubling: sort by rank pairs of doubling reach."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        k *= 2
        if k >= n:
            return order


class WaveletMatrix:
    """Symbols below 2^levels with rank by level."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        cur = symbols
        for b in range(levels - 1, -1, -1):
            bit = (cur >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(len(cur) - int(self.ones[-1][-1]))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        lo, hi = np.zeros_like(at), at
        for k in range(self.levels):
            one, z = self.ones[k], self.zeros[k]
            bit = (symbol >> (self.levels - 1 - k)) & 1 == 1
            a, b = one[lo], one[hi]
            lo, hi = np.where(bit, z + a, lo - a), np.where(bit, z + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k in range(self.levels):
            one, z = self.ones[k], self.zeros[k]
            bit = one[at + 1] - one[at]
            out = out * 2 + bit
            at = np.where(bit == 1, z + one[at], at - one[at])
        return out


class FMIndex:
    """Over symbols from 1 up; a 0 ends the text."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        s = np.concatenate((text, [0])).astype(np.int64)
        sa = suffix_array(s)
        self.n = len(s)
        bwt = s[sa - 1]
        self.tree = WaveletMatrix(bwt, max(1, int(n_symbols).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=n_symbols + 1))))
        marked = sa % SAMPLE == 0
        self.marked, self.marks = marked, np.concatenate(([0], np.cumsum(marked)))
        self.samples = sa[marked]

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of all windows (rows padded on the left), backward from their last symbols."""
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        for j in range(windows.shape[1]):
            live = np.flatnonzero((lengths > j) & (lo < hi))
            if not len(live):
                break
            c = windows[live, windows.shape[1] - 1 - j]
            lo[live], hi[live] = self.first[c] + self.tree.rank(c, lo[live]), self.first[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by stepping back to sampled ones."""
        out, steps, rows = np.full(len(rows), -1, np.int64), 0, rows.copy()
        todo = np.arange(len(rows))
        while len(todo):
            at = rows[todo]
            hit = self.marked[at]
            out[todo[hit]] = self.samples[self.marks[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            c = self.tree.access(at)
            rows[todo] = self.first[c] + self.tree.rank(c, at)
            steps += 1
        return out


_APART = np.isin(np.arange(256), [0x20])


def all_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of the words of each text, in order."""
    raw = [t.encode("utf-8", "surrogatepass").translate(_TABLE) if t else b"" for t in texts]
    start, h = C.hash_words(np.frombuffer(b" ".join(raw), np.uint8), _APART)
    bounds = np.searchsorted(start, np.cumsum([0, *[len(r) + 1 for r in raw]])).tolist()
    return [h[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def hashes_of(text: str | None) -> np.ndarray:
    return all_hashes([text])[0]


class Block:
    """Windows of some items, as word hashes (rows padded on the left), and whose they are."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            ids = hashes_of(text)
            for i in range(max(1, len(ids) - window + 1)) if len(ids) else ():
                owners.setdefault(ids[i : i + window].tobytes(), set()).add(item)
        self.owners = list(owners.values())
        self.lengths = np.asarray([len(w) // 8 for w in owners], np.int64)
        self.windows = np.zeros((len(owners), window), C.U)
        for k, w in enumerate(owners):
            self.windows[k, window - len(w) // 8 :] = np.frombuffer(w, C.U)


class Shard:
    """An FM-index over some documents' words."""

    def __init__(self, docs: list[np.ndarray], known: np.ndarray, log2: int, shortest: int):
        self.starts = np.cumsum([0, *map(len, docs)])
        words = np.concatenate([*docs, np.zeros(0, C.U)])
        self.index = None
        use = C.marked(known, words >> C.U(64 - log2)).view(np.int8)
        # runs end at documents' ends: edges are where use begins or stops, document by document
        cut = np.zeros(len(words) + 1, bool)
        cut[self.starts] = True
        begin = np.flatnonzero((use == 1) & (cut[:-1] | (np.concatenate(([0], use[:-1])) == 0)))
        end = np.flatnonzero((use == 1) & (cut[1:] | (np.concatenate((use[1:], [0])) == 0))) + 1
        long = end - begin >= shortest
        begin, end = begin[long], end[long]
        if not shortest or not len(begin):
            return
        lens = end - begin + 1  # with the separator that follows
        offsets = np.cumsum(lens) - lens
        self.source = np.repeat(begin - offsets, lens) + np.arange(int(lens.sum()))
        last = np.zeros(len(self.source), bool)
        last[offsets + lens - 1] = True
        self.vocabulary, ids = np.unique(words[self.source[~last]], return_inverse=True)
        text = np.ones(len(self.source), np.int64)  # 1 separates
        text[~last] = ids + 2
        self.index = FMIndex(text, len(self.vocabulary) + 1)

    def search(self, block: Block, spans: list[list[tuple[int, int]]], items: list[set[str]]) -> None:
        """Add the occurrences of a block's windows to the documents' spans and items."""
        if self.index is None or not len(block.owners):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, block.windows), len(self.vocabulary) - 1)
        padding = np.arange(block.windows.shape[1]) < (block.windows.shape[1] - block.lengths)[:, None]
        whole = np.flatnonzero(((self.vocabulary[at] == block.windows) | padding).all(1))
        if not len(whole):
            return
        lo, hi = self.index.search(at[whole] + 2, block.lengths[whole])
        found = np.flatnonzero(hi > lo)
        if not len(found):
            return
        counts = hi[found] - lo[found]
        which = np.repeat(whole[found], counts)
        rows = np.repeat(lo[found] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        place = self.source[self.index.locate(rows)]
        doc = np.searchsorted(self.starts, place, "right") - 1
        for d, a, w in zip(doc.tolist(), (place - self.starts[doc]).tolist(), which.tolist(), strict=True):
            spans[d].append((a, a + int(block.lengths[w])))
            items[d] |= block.owners[w]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Benchmark:
    """Broadcasts: a bitmap of all words' hashes (log2 bits of them), and blocks of windows of about BLOCK_WORDS words."""

    def __init__(self, known, log2: int, shortest: int, blocks: list):
        self.known, self.log2, self.shortest, self.blocks = known, log2, shortest, blocks

    def __iter__(self) -> Iterator[Block]:
        for b in self.blocks:
            yield b.value
            if len(self.blocks) > 1:
                vars(b).pop("_value", None)  # what a worker has read of a broadcast; it is read again when asked for


def prepared(benchmark: DataFrame, window: int) -> Benchmark:
    """The benchmark's blocks, one at a time through the driver, from one pass over its items."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in C.rows_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in all_hashes(texts)], pa.int64())], names=["n"])

    told = items.select("text").mapInArrow(sizes, "n bigint").agg(F.sum("n").alias("words"), F.min(F.expr(f"case when n > 0 then least(n, {window}) end")).alias("shortest")).first()
    words, log2 = told["words"] or 0, C.bitmap_log2(told["words"] or 0)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in C.rows_of(batches, "text"):
            h = np.unique(np.concatenate([*all_hashes(texts), np.zeros(0, C.U)]) >> C.U(64 - log2))
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int32))], names=["spot"])

    known = C.bitmap(items.select("text").mapInArrow(spots, "spot int"), log2)
    n = max(1, -(-words // BLOCK_WORDS))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    if n > 1:
        numbered = numbered.repartitionByRange(min(n, C.parts(spark)), "block").sortWithinPartitions("block")
    blocks, held, now = [], [], None
    for r in numbered.toLocalIterator():
        if r["block"] != now and held:
            blocks.append(spark.sparkContext.broadcast(Block(held, window)))
            held = []
        now = r["block"]
        held.append((r["item"], r["text"]))
    if held:
        blocks.append(spark.sparkContext.broadcast(Block(held, window)))
    return Benchmark(spark.sparkContext.broadcast(known), log2, told["shortest"] or 0, blocks)


def _shards(batches: Iterator[pa.RecordBatch], bench: Benchmark):
    """(batches, their documents' numbers of words, merged spans and items), shard by shard."""
    held: list[pa.RecordBatch] = []
    docs: list[np.ndarray] = []
    size = 0

    def flush():
        shard = Shard(docs, bench.known.value, bench.log2, bench.shortest)
        spans: list[list[tuple[int, int]]] = [[] for _ in docs]
        items: list[set[str]] = [set() for _ in docs]
        for block in bench if shard.index is not None else ():
            shard.search(block, spans, items)
        return held, [len(d) for d in docs], [merged(s) for s in spans], items

    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        held.append(batch)
        docs += all_hashes(texts)
        size += sum(len(t) for t in texts if t)
        if size >= SHARD_CHARS:
            yield flush()
            held, docs, size = [], [], 0
    if held:
        yield flush()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (word ranges)."""
    C.prepare(docs.sparkSession)
    bench = prepared(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, words, spans, items in _shards(batches, bench):
            ids = [x for b in held for x in b.column(b.schema.get_field_index("doc_id")).to_pylist()]
            hit = [sum(b - a for a, b in s) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items], pa.string()), pa.array([h > 0 for h in hit], pa.bool_()),
                    pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<first:int,end:int>>")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters of these word ranges."""
    low = text.translate({c: c + 32 for c in range(65, 91)})
    at = [m.span() for m in _WORD.finditer(low)]
    out, begin = [], 0
    for a, b in spans:
        out.append(text[begin : at[a][0]])
        begin = at[b - 1][1]
    return "".join([*out, text[begin:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, with every benchmark passage cut out of its text; all columns and rows stay."""
    C.prepare(docs.sparkSession)
    bench = prepared(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, _, spans, _ in _shards(batches, bench):
            k = 0
            for b in held:
                mine, at = spans[k : k + b.num_rows], b.schema.get_field_index("text")
                k += b.num_rows
                if any(mine):
                    texts = [cut_spans(t, s) if s else t for t, s in zip(b.column(at).to_pylist(), mine, strict=True)]
                    b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
                yield b

    return docs.mapInArrow(run, docs.schema)
