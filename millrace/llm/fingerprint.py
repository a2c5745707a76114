"""Threshold-scaled document sketches: every shingle hash below a fixed fraction of the hash range.

A sketch keeps the hashes of 3-word shingles (A-Z lower-cased) below
``FRACTION`` of 2^64. As all sketches sample the same part of the hash range they
compare at any sizes: |A and B| / |A| estimates containment of A in B however
unequal the documents are. Of so few hashes as a short text has, none may be below the
fraction; sets of at most EXACT hashes are therefore kept whole, and marked so. Two
whole sets compare exactly, a whole one and a sampled one by what is below the fraction.

Sketches merge: that of two sets' union is the union of theirs, cut to the fraction
unless all of it is whole and no larger than EXACT.

A fingerprint is "x" for a whole set or "s" for a sampled one, and the kept hashes in ascending
order, as big-endian 64-bit numbers in base64; that of a text without words is an empty string.

Defined cases of ``edit_report``: null text counts as empty; the successor of a
row is the next in (doc_id, text hash) order, nulls first, repeated rows in any
order among themselves (their texts are equal); after the last comes the first,
so a single row follows itself; two texts without words are alike (1.0), one without
and another are not (0.0), and neither are a whole and a sampled set with nothing below the
fraction; a set that shows nothing to be asked for is contained in any; other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE, FRACTION, EXACT = 3, 1 / 4, 32
_LIMIT = C.U(int(FRACTION * (1 << 64)))


class Sketch:
    """Ascending distinct hashes: all of a set's (whole), or those below the fraction."""

    __slots__ = ("hashes", "whole")

    def __init__(self, hashes: np.ndarray, whole: bool):
        self.hashes, self.whole = hashes, whole

    def low(self) -> np.ndarray:
        return self.hashes[: np.searchsorted(self.hashes, _LIMIT)] if self.whole else self.hashes

    def __eq__(self, other) -> bool:
        return self.whole == other.whole and np.array_equal(self.hashes, other.hashes)


def sketch_of(hashes: np.ndarray) -> Sketch:
    """Of a set's distinct hashes, ascending."""
    whole = len(hashes) <= EXACT
    return Sketch(hashes if whole else hashes[: np.searchsorted(hashes, _LIMIT)], whole)


def sketch(words: list[bytes], hashes: C.WordHashes) -> Sketch:
    h = C.shingle_hashes(hashes(words), SHINGLE)
    if len(h) <= EXACT:
        return sketch_of(np.unique(h))
    kept = np.unique(h[h < _LIMIT])
    # repeats may leave fewer distinct hashes than a sampled set has
    if len(kept) <= EXACT:
        every = np.unique(h)
        if len(every) <= EXACT:
            return Sketch(every, True)
    return Sketch(kept, False)


def encode(s: Sketch) -> str:
    return ("x" if s.whole else "s") + base64.b64encode(s.hashes.astype(">u8").tobytes()).decode() if len(s.hashes) or not s.whole else ""


def decode(fingerprint: str) -> Sketch:
    return Sketch(np.frombuffer(base64.b64decode(fingerprint[1:]), ">u8").astype(C.U), fingerprint[:1] != "s")


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of the union of the two sets."""
    if a.whole and b.whole:
        return sketch_of(np.union1d(a.hashes, b.hashes))
    return Sketch(np.union1d(a.low(), b.low()), False)


def _comparable(a: Sketch, b: Sketch) -> tuple[np.ndarray, np.ndarray]:
    return (a.hashes, b.hashes) if a.whole == b.whole else (a.low(), b.low())


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(a) + len(b) - len(np.union1d(a, b))


def likeness(a: Sketch, b: Sketch) -> float:
    """Jaccard similarity: exact for two whole sets, else estimated."""
    x, y = _comparable(a, b)
    if not len(x) and not len(y):
        return float(a.whole == b.whole)
    both = shared(x, y)
    return both / (len(x) + len(y) - both)


def containment(a: Sketch, b: Sketch) -> float:
    """Part of a's shingles that b has, for documents of any sizes: estimated unless both are whole."""
    x, y = _comparable(a, b)
    return 1.0 if not len(x) else shared(x, y) / len(x)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint."""
    C.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = C.WordHashes()
        for ids, texts in C.rows_of(batches, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([encode(sketch(C.ascii_words(t), hashes)) for t in texts], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """text with its last quarter (floor) of code points replaced by the first as many of the next."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _buckets(keys: DataFrame, n: int) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Bounds that cut the order of (doc_id, h) into about n even ranges, from a bounded sample
    (balance only), and the first key of each range that has rows: at most n of either."""
    total = keys.count()
    sample = keys.sample(min(1.0, 100 * n / max(1, total)), 7).limit(400 * n).toPandas()
    some = sorted(_number(sample["doc_id"], sample["h"]))
    bounds = sorted({some[k * len(some) // n] for k in range(1, n)}) if some else []
    first = keys.withColumn("bucket", _bucket_udf(bounds)("doc_id", "h")).groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("head"))
    return bounds, {r["bucket"]: (r["head"]["doc_id"], r["head"]["h"]) for r in first.collect()}


def _number(ids: pd.Series, h: pd.Series) -> list[int]:
    """One integer in the order of (doc_id, h), nulls first."""
    missing = ids.isna().tolist()
    return [(0 if m else (int(i) + (1 << 63) + 1) << 64) + int(x) + (1 << 63) for i, m, x in zip(ids.astype("Int64").fillna(0).tolist(), missing, h.tolist(), strict=True)]


def _bucket_udf(bounds: list[int]):
    from bisect import bisect_right

    @F.pandas_udf("int")
    def bucket(doc_id: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, x) for x in _number(doc_id, h)], dtype="int32")

    return bucket


def edit_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts move once, to the range of the order that they fall in; of each range
    only its first row goes to the range before as well.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    n = C.parts(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), C.text_or_empty().cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    bounds, heads = _buckets(docs.select("doc_id", "h"), n)
    used = sorted(heads)
    before = {heads[b]: used[k - 1] for k, b in enumerate(used)}  # a range's head also ends the range before; the first one's the last

    @F.pandas_udf("array<int>")
    def places(doc_id: pd.Series, h: pd.Series) -> pd.Series:
        """The row's range, then, for a head, minus one less that of the range before."""
        from bisect import bisect_right

        numbers = _number(doc_id, h)
        keys = [(None if pd.isna(i) else int(i), int(x)) for i, x in zip(doc_id, h, strict=True)]
        return pd.Series([[bisect_right(bounds, x), *([-1 - before[k]] if k in before else [])] for x, k in zip(numbers, keys, strict=True)])

    placed = docs.withColumn("place", F.explode(places("doc_id", "h")))
    placed = placed.withColumn("tail", F.col("place") < 0).withColumn("bucket", F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")))
    ranged = placed.select("doc_id", "text", "h", "tail", "bucket").repartitionById(n, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = C.WordHashes()
        held = None  # the row whose successor comes next
        for ids, texts, tails, buckets in C.rows_of(batches, "doc_id", "text", "tail", "bucket"):
            rows = []
            for i, text, tail, bucket in zip(ids, texts, tails, buckets, strict=True):
                mine = None if tail and held is None else sketch(C.ascii_words(text), hashes)
                if held is not None and held[3] == bucket:
                    last, was, s, _ = held
                    new = edited(was, text)
                    s2 = s if new == was else sketch(C.ascii_words(new), hashes)
                    rows.append((last, len(was), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encode(s), encode(s2), likeness(s, s2), likeness(s, mine)))
                held = None if tail else (i, text, mine, bucket)
            t = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, t, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ranged.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
