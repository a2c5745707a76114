"""Token ids in a content-addressed store of binary chunks.

A rolling hash over the last 16 ids cuts each document's id stream where the
content says so, so documents that share passages share chunks. The store at
``path`` holds four Parquet folders:

* ``parts/kind=chunk``: every distinct chunk once (hash, ids as little-endian
  integers of 16 bits where the vocabulary allows, else 32);
* ``parts/kind=doc``: what the encoding pass said of each document, until the
  recipes are built;
* ``recipes``: in ascending doc_id order, each document's id, first position in
  the stream of all ids, chunk hashes, chunk lengths and Merkle root;
* ``manifest``: one row for each recipe shard with its range and counts, the root of a
  Merkle tree over its documents in order (a leaf binds doc_id, start, n_tokens
  and the document's root), and the root of a tree over all shards' rows.

Reading back checks every chunk against its hash, and every document's root and
length against its recipe; a mismatch raises. ``check_manifest`` works out all
rows again. ``proof`` and ``proven`` show that a leaf is below a root.

Defined cases: a null text is encoded as an empty one (only the end id); a null
doc_id comes first in the order; equal doc_ids keep all their rows, in a fixed
but unspecified order among themselves; other columns are ignored, whatever
their names; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .encoder import Encoder

END_ID = 2
WINDOW, LEAST, MEAN, MOST = 16, 256, 1024, 8192
_PARTS = "kind string, key binary, doc_id bigint, ord bigint, n_ids bigint, payload binary, lens array<int>"
_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for each Python worker: its memo outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(hashes: list[bytes]) -> bytes:
    """Root of a binary tree whose odd last node moves up; of no leaves, the hash of nothing."""
    level = hashes or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return digest(b"root" + level[0])


class Tree:
    """The same root from leaves as they come, with one hash held for each level."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level = 0
        while self.peaks and self.peaks[-1][0] == level:
            leaf, level = digest(self.peaks.pop()[1] + leaf), level + 1
        self.peaks.append((level, leaf))

    def root(self) -> bytes:
        low = self.peaks[-1][1] if self.peaks else digest(b"")
        for _, high in reversed(self.peaks[:-1]):
            low = digest(high + low)
        return digest(b"root" + low)


def proof(hashes: list[bytes], i: int) -> list[tuple[bool, bytes]]:
    """What leaf i needs to get to the root: at each level, whether its neighbour stands before it, and the neighbour."""
    level, out = hashes, []
    while len(level) > 1:
        if i ^ 1 < len(level):
            out.append((i & 1 == 1, level[i ^ 1]))
        level = [digest(b"".join(level[j : j + 2])) if j + 1 < len(level) else level[j] for j in range(0, len(level), 2)]
        i >>= 1
    return out


def proven(leaf: bytes, path: list[tuple[bool, bytes]], root: bytes) -> bool:
    for before, other in path:
        leaf = digest(other + leaf if before else leaf + other)
    return digest(b"root" + leaf) == root


def leaf_of(doc_id: int | None, start: int, n_tokens: int, root: bytes) -> bytes:
    return digest(b"null" + struct.pack("<qq", start, n_tokens) + root if doc_id is None else struct.pack("<qqq", doc_id, start, n_tokens) + root)


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of content-defined chunks: LEAST to MOST ids each, but for a document's last."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    h = C.mix(ids.astype(C.U), 77)
    p = 0x9E3779B97F4A7C15
    step = 1
    while step < WINDOW:  # windows of 2, 4, 8, 16 ids
        h[step:] = h[step:] + h[:-step] * C.U(pow(p, step, 1 << 64))
        step *= 2
    wanted = np.flatnonzero((h >> C.U(40)) % C.U(MEAN) == 0) + 1
    out, begin = [], 0
    for w in [*wanted.tolist(), n]:
        while w - begin > MOST:
            begin += MOST
            out.append(begin)
        if w - begin >= LEAST or w == n and w > begin:
            out.append(w)
            begin = w
    return out


def _encode(path: str, end_id: int, wide: bool):
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        enc, seen, count = encoder_of(path), set(), (context.partitionId() if context else 0) << 40
        tail = np.asarray([end_id], "<u4").tobytes()
        names = [x.split()[0] for x in _PARTS.split(", ")]
        types = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
        for doc_ids, texts in C.rows_of(batches, "doc_id", "text"):
            rows: list[tuple] = []
            for doc_id, text in zip(doc_ids, texts, strict=True):
                ids = np.frombuffer(enc.encode(text or "") + tail, "<u4")
                raw, cuts = ids.astype(kind).tobytes(), cut_points(ids)
                hashes, lens, begin, width = [], [], 0, int(kind[2])
                for c in cuts:
                    chunk = raw[begin * width : c * width]
                    key = digest(chunk)
                    if key not in seen:  # once a task at most; the shuffle leaves one of all tasks'
                        seen.add(key)
                        rows.append(("chunk", key, None, None, c - begin, chunk, None))
                    hashes.append(key)
                    lens.append(c - begin)
                    begin = c
                rows.append(("doc", digest(b"%d" % count), doc_id, count, len(ids), b"".join([merkle(hashes), *hashes]), lens))
                count += 1
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode docs (doc_id, text) into a store at path.

    The only wide data that is shuffled are chunks that are new to their task.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    wide = encoder_of(tokenizer).size > 1 << 16 or end_id >= 1 << 16
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(tokenizer, end_id, wide), _PARTS)
    one = rows.repartition(C.parts(spark), "key").dropDuplicates(["kind", "key", "doc_id", "ord"])
    one.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/parts")
    said = spark.read.schema(_PARTS).parquet(f"{path}/parts").filter("kind = 'doc'")
    ordered = C.ordered_offsets(said.select("doc_id", F.col("n_ids").alias("n_tokens"), F.substring("payload", 1, 16).alias("root"), F.expr("substring(payload, 17)").alias("hashes"), "lens"), [F.col("doc_id")], "n_tokens", "start", "token-order")
    recipes = ordered.repartitionByRange(C.parts(spark), F.col("start")).sortWithinPartitions("start", "n_tokens").withColumn("shard", F.spark_partition_id())
    recipes.select("shard", "doc_id", "start", "n_tokens", "root", "hashes", "lens").write.parquet(f"{path}/recipes")
    shards = _shards(read_recipes(spark, path)).toArrow()  # a row for each of at most as many shards as there are shuffle partitions
    spark.createDataFrame(shards.append_column("store_root", pa.array([_store_root(shards)] * len(shards), pa.binary())), f"{_SHARD}, store_root binary").coalesce(1).write.parquet(f"{path}/manifest")


_SHARD = "shard int, start bigint, n_docs bigint, n_tokens bigint, first_doc bigint, last_doc bigint, shard_root binary"


def _shards(recipes: DataFrame) -> DataFrame:
    """Each shard's range, counts and root, over its documents in the order of their starts.

    Only a few numbers and one hash a document are shuffled, and a shard's rows are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: int | None = None
        rows: list[tuple] = []
        tree, first, docs, tokens, low, high = Tree(), 0, 0, 0, None, None

        def close() -> None:
            if open_ is not None:
                rows.append((open_, first, docs, tokens, low, high, tree.root()))

        for shards, ids, starts, counts, roots in C.rows_of(batches, "shard", "doc_id", "start", "n_tokens", "root"):
            for s, i, at, n, root in zip(shards, ids, starts, counts, roots, strict=True):
                if s != open_:
                    close()
                    open_, tree, first, docs, tokens, low, high = s, Tree(), at, 0, 0, None, None
                tree.add(leaf_of(i, at, n, root))
                docs, tokens = docs + 1, tokens + n
                if i is not None:
                    low, high = i if low is None else min(low, i), i if high is None else max(high, i)
        close()
        t = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(list(zip(*rows, strict=True)) or [[]] * 7, t, strict=True)], names=[x.split()[0] for x in _SHARD.split(", ")])

    return recipes.select("shard", "doc_id", "start", "n_tokens", "root").repartition("shard").sortWithinPartitions("shard", "start").mapInArrow(run, _SHARD)


def _store_root(shards: pa.Table) -> bytes:
    rows = sorted((tuple(r.values()) for r in shards.select([x.split()[0] for x in _SHARD.split(", ")]).to_pylist()), key=lambda r: r[0])
    return merkle([digest(repr(r).encode()) for r in rows])


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard int, doc_id bigint, start bigint, n_tokens bigint, root binary, hashes binary, lens array<int>").parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The distinct chunks (key, n_ids, payload)."""
    return spark.read.schema(_PARTS).parquet(f"{path}/parts").filter("kind = 'chunk'").select("key", "n_ids", "payload")


def check_manifest(spark: SparkSession, path: str) -> int:
    """Number of shards whose row, worked out again from the recipes, differs from the manifest's; all, if the store's root does."""
    said = spark.read.schema(f"{_SHARD}, store_root binary").parquet(f"{path}/manifest").toArrow()
    now = _shards(read_recipes(spark, path)).toArrow()
    names = [x.split()[0] for x in _SHARD.split(", ")]
    was, is_ = ({r["shard"]: r for r in t.select(names).to_pylist()} for t in (said, now))
    wrong = sum(was.get(k) != is_.get(k) for k in was.keys() | is_.keys())
    return wrong or (len(said) if any(r != _store_root(now) for r in said.column("store_root").to_pylist()) else 0)


def _zero_tables(most: int = 48) -> np.ndarray:
    """tables[k][j][b]: what 2^k zero bytes make of a crc whose byte j is b."""

    def times(rows: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= rows[i]
            v >>= 1
            i += 1
        return out

    rows = [0xEDB88320, *[1 << i for i in range(31)]]  # one zero bit
    for _ in range(3):
        rows = [times(rows, r) for r in rows]
    tables = []
    for _ in range(most):
        tables.append([[times(rows, b << (8 * j)) for b in range(256)] for j in range(4)])
        rows = [times(rows, r) for r in rows]
    return np.asarray(tables, np.uint32)


_zeros: np.ndarray | None = None


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """crc32 of A followed by B is crc_shift(crc32(A), len(B)) ^ crc32(B)."""
    global _zeros
    if _zeros is None:
        _zeros = _zero_tables()
    crc, n = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for k in range(int(n.max()).bit_length() if len(n) else 0):
        t = _zeros[k]
        moved = t[0][crc & 255] ^ t[1][(crc >> 8) & 255] ^ t[2][(crc >> 16) & 255] ^ t[3][crc >> 24]
        crc = np.where((n >> k) & 1 == 1, moved, crc)
    return crc


def _chunk_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, counts, payloads in C.rows_of(batches, "key", "n_ids", "payload"):
        crcs = []
        for key, n, raw in zip(keys, counts, payloads, strict=True):
            if digest(raw) != key or len(raw) not in (2 * n, 4 * n):
                raise ValueError(f"chunk {key.hex()} is damaged")
            crcs.append(zlib.crc32(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["key", "found", "crc"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A recipe's chunks with the ids that follow each in its document."""
    for starts, counts, roots, all_hashes, all_lens in C.rows_of(batches, "start", "n_tokens", "root", "hashes", "lens"):
        out: list[tuple] = []
        for at, n, root, hashes, lens in zip(starts, counts, roots, all_hashes, all_lens, strict=True):
            keys = [hashes[i : i + 16] for i in range(0, len(hashes), 16)]
            if merkle(keys) != root or sum(lens) != n:
                raise ValueError(f"the recipe at {at} is damaged")
            left = n
            for j, (key, m) in enumerate(zip(keys, lens, strict=True)):
                left -= m
                out.append((at, j, key, m, left))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()], strict=True)], names=["start", "j", "key", "m", "left"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Each chunk is read, checked and reduced to the crc of its ids where it lies;
    a document's crc is the exclusive-or of its chunks' crcs, each moved by the
    bytes that follow, so no id is shuffled. A start is unique to a document (each
    has its end id at least), which makes it the key.
    """
    C.prepare(spark)
    chunks = read_chunks(spark, path).mapInArrow(_chunk_digests, "key binary, found bigint, crc bigint")
    recipes = read_recipes(spark, path)
    entries = recipes.select("start", "n_tokens", "root", "hashes", "lens").mapInArrow(_entries, "start bigint, j int, key binary, m bigint, left bigint")

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if pa.compute.any(pa.compute.is_null(b.column(2))).as_py() or not b.column(2).equals(b.column(3)):
                raise ValueError("a recipe names a chunk that the store lacks")
            crc = crc_shift(b.column(4).to_numpy(zero_copy_only=False), 4 * b.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(crc.astype(np.int64))], names=["start", "m", "crc"])

    # a chunk that many documents share is one row on the right: its hot key is split
    # in four here, and further by AQE, as the join shuffles for itself
    salts = 4
    left = entries.withColumn("salt", F.pmod(F.hash("start"), F.lit(salts)))
    right = chunks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = left.join(right, ["key", "salt"], "left").select("start", "left", "m", "found", "crc").mapInArrow(shifted, "start bigint, m bigint, crc bigint")
    sums = joined.groupBy("start").agg(F.sum("m").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return recipes.select("doc_id", "start").join(sums, "start").select("doc_id", "start", "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild every document's ids (doc_id, start, ids array<int>) in full, by recipe."""
    C.prepare(spark)
    recipes = read_recipes(spark, path)
    entries = recipes.select("start", "n_tokens", "root", "hashes", "lens").mapInArrow(_entries, "start bigint, j int, key binary, m bigint, left bigint")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts, payloads in C.rows_of(batches, "key", "n_ids", "payload"):
            if any(digest(p) != k for k, p in zip(keys, payloads, strict=True)):
                raise ValueError("a chunk is damaged")
            got = [np.frombuffer(p, "<u2" if len(p) == 2 * n else "<u4").astype(np.int32) for n, p in zip(counts, payloads, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(got, pa.list_(pa.int32()))], names=["key", "ids"])

    chunks = read_chunks(spark, path).mapInArrow(ids, "key binary, ids array<int>")
    rebuilt = entries.join(chunks, "key").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("j", "ids"))).alias("got")).select("start", F.flatten("got.ids").alias("ids"))
    return recipes.select("doc_id", "start").join(rebuilt, "start").select("doc_id", "start", "ids")
