"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding undoes disguises: compatibility forms, look-alike letters of other
scripts, digits and signs that stand for letters, characters of no width; what
is then no letter or digit parts words. Lexicon entries are beginnings of words
(3 to 12 characters), learned from labelled rows: chosen greedily so that each adds
toxic rows which too few of the others cover and is rare in clean ones, and weighted
by smoothed log-odds. Exception phrases are pairs of neighbouring words around an
entry that only clean rows hold; a match inside one doesn't count. The sum of the
matched weights, as such and by the text's length, goes through a logistic
function fitted to the same rows.

Rows whose crc32(doc_id as text) mod 5 is 0 are never learned from. At most
TRAIN_ROWS labelled rows of either class are used: those of the least hash. That
bounds the lexicon and the phrases too: an entry has LEAST_GAIN of these rows, a phrase two.

A word is a run of letters and digits, and entries match at its beginning; in scripts that put no
spaces between words an entry is found where such a run begins.

Defined cases: null and empty texts match nothing and get the score of a text
without matches; a label that is null is no label; a null doc_id is scored and,
having no remainder, not held out; repeated rows each get their row; without
labels, or with those of one class, the lexicon is empty and the score is the
smoothed share of toxic labels (predicted 0 unless that is over one half); other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

TRAIN_ROWS, FOLDS, SHORTEST, LONGEST, LEAST_GAIN, COVERS = 4000, 5, 3, 12, 3, 4
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_LOOKALIKE = dict(zip("авсԁеёһіјӏкмнорԛгѕтυυѵԝхуαβγεηικνορτυωχ" + "ı" + "ɑɡ", "abcdeehijlkmhopqrstuuvwxyabyenikvoptuwx" + "i" + "ag", strict=True))
_DIGITS = dict(zip("013457@", "oieasta", strict=True))
_FAR = re.compile("[^\x00-ɏ]")


class _Fold(dict):
    """Translation table, filled as characters turn up."""

    def __missing__(self, c: int) -> str | None:
        ch = chr(c)
        kind = unicodedata.category(ch)
        to = _LOOKALIKE.get(ch) or _DIGITS.get(ch) or (None if kind == "Cf" else ch if kind[0] in "LNM" else " ")
        self[c] = to
        return to


_fold = _Fold()


def fold(text: str) -> str:
    """Words of the text with their disguises undone, parted by white space."""
    if _FAR.search(text):
        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(_fold)


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = 0.0
    coefs: tuple[float, ...] = (0.0, 0.0, 0.0)
    _automaton: object = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for e, w in self.weights.items():
                a.add_word(f" {e}", (len(e) + 1, w))
            for e in self.exceptions:
                a.add_word(f" {e} ", (len(e) + 2, None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def matches(self, folded: str) -> list[tuple[int, float]]:
        """(position, weight) by word: its longest entry, unless an exception phrase covers it. folded: words between single spaces."""
        a = self.automaton()
        if not len(a):
            return []
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (n, w) in a.iter(folded):
            begin = end - n + 1
            if w is None:
                excused.append((begin, end))
            else:
                best[begin] = w  # longer entries end later
        if not excused:
            return list(best.items())
        # phrases are found by their ends: what covers a position is the one that reaches farthest of those that begin before it
        excused.sort()
        begins, reach = [x for x, _ in excused], list(accumulate((y for _, y in excused), max))
        return [(p, w) for p, w in best.items() if not ((k := bisect_right(begins, p)) and reach[k - 1] > p)]

    def features(self, text: str | None) -> tuple[float, float, float]:
        words = fold(text or "").split()
        total = sum(w for _, w in self.matches(f" {' '.join(words)} ")) if words else 0.0
        return (1.0 if total > 0 else 0.0, math.log1p(max(0.0, total)), math.log1p(100 * max(0.0, total) / (len(words) or 1)))

    def score(self, text: str | None) -> float:
        z = self.bias + sum(c * x for c, x in zip(self.coefs, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def beginnings(text: str | None) -> set[str]:
    out: set[str] = set()
    for w in set(fold(text or "").split()):
        out.update(w[:k] for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


def _cover(rows: dict[str, set[int]], clean: dict[str, int], n_toxic: int, n_clean: int, least: int) -> dict[str, float]:
    """Entries, greedily by the toxic rows that they add, and their weights."""

    def weight(f: str) -> float:
        return math.log((len(rows[f]) + 0.5) / (n_toxic + 1)) - math.log((clean.get(f, 0) + 0.5) / (n_clean + 1))

    import heapq

    # every row is to hold COVERS entries, as a single one may be what another text lacks; beginnings of one
    # another count as one entry, and one that only adds to covered rows needs more of them
    seen: Counter[int] = Counter()
    out: dict[str, float] = {}
    more = max(least + 2, n_toxic // 100)

    def gain(f: str) -> int:
        fresh = sum(not seen[i] for i in rows[f])
        if fresh >= least or any(f.startswith(e) or e.startswith(f) for e in out):
            return fresh
        also = sum(seen[i] < COVERS for i in rows[f])
        return also if also >= more else 0

    key = lambda f, n: (-(n * weight(f) ** 2), -len(f), f)
    heap = [(*key(f, len(r)), len(r)) for f, r in rows.items()]
    heapq.heapify(heap)
    while heap:
        _, _, f, before = heapq.heappop(heap)
        now = gain(f)
        if now < least:
            continue
        if now < before:
            heapq.heappush(heap, (*key(f, now), now))
            continue
        out[f] = weight(f)
        seen.update(rows[f])
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column is the intercept."""
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[0.05] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge + 1e-9 * np.eye(len(b)), x.T @ (y - p) - ridge @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from labelled rows that aren't held out, at most ``rows`` of either class."""
    spark = docs.sparkSession
    C.prepare(spark)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    some = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for t in (0, 1)]
    chosen = some[0].union(some[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # 2 * rows ids at most
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = C.materialize(texts.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "toxicity-sample")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1) if n_toxic + n_clean else 0.25
        return Model(bias=math.log(share / (1 - share)))
    spread = sample.repartition(C.parts(spark))
    least = max(LEAST_GAIN, n_toxic // 1000)

    def count(wanted):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c: Counter[str] = Counter()
            for (some_texts,) in C.rows_of(batches, "text"):
                for t in some_texts:
                    c.update(beginnings(t) & wanted.value if wanted else beginnings(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["entry", "n"])

        return run

    def counted(toxic: int, wanted=None) -> DataFrame:
        return spread.filter(F.col("toxic") == toxic).select("text").mapInArrow(count(wanted), "entry string, n bigint").groupBy("entry").agg(F.sum("n").alias("n"))

    # the sample bounds what comes here: beginnings that several of its rows share
    often = {r["entry"]: r["n"] for r in counted(1).filter(F.col("n") >= least).toLocalIterator()}
    clean = {r["entry"]: r["n"] for r in counted(0, spark.sparkContext.broadcast(set(often))).toLocalIterator()}
    fit = {f for f, k in often.items() if clean.get(f, 0) * 8 * n_toxic <= k * n_clean and clean.get(f, 0) <= k}
    some_fit = spark.sparkContext.broadcast(fit)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (some_texts,) in C.rows_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(beginnings(t) & some_fit.value) for t in some_texts], pa.list_(pa.string()))], names=["entries"])

    rows_of_entry: dict[str, set[int]] = defaultdict(set)
    for k, r in enumerate(spread.filter("toxic = 1").select("text").mapInArrow(hold, "entries array<string>").toLocalIterator()):
        for f in r["entries"]:
            rows_of_entry[f].add(k)
    model = Model(weights=_cover(rows_of_entry, clean, n_toxic, n_clean, least))
    model.exceptions = _phrases(spread, model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some_texts, marks in C.rows_of(batches, "text", "toxic"):
            x = np.asarray([model.features(t) for t in some_texts]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2]), pa.array(marks, pa.int32())], names=["a", "b", "c", "toxic"])

    m = spread.mapInArrow(measure, "a double, b double, c double, toxic int").toPandas()
    # a sum is the same in any order of rows, but for rounding; sorting makes reruns equal to the bit
    m = m.sort_values(["a", "b", "c", "toxic"])
    b = _logistic(np.column_stack([np.ones(len(m)), m[["a", "b", "c"]].to_numpy()]), m["toxic"].to_numpy(float))
    model.bias, model.coefs = float(b[0]), tuple(float(v) for v in b[1:])
    return model


def _phrases(sample: DataFrame, model: Model) -> list[str]:
    """Pairs of neighbouring words with an entry in them that several clean rows and no toxic one hold."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[tuple[str, int]] = Counter()
        for texts, marks in C.rows_of(batches, "text", "toxic"):
            for text, mark in zip(texts, marks, strict=True):
                words = fold(text or "").split()
                line = f" {' '.join(words)} "
                hits = {line.count(" ", 0, p + 1) - 1 for p, _ in model.matches(line)} if words else set()
                c.update({(" ".join(words[k : k + 2]), mark) for h in hits for k in (h - 1, h) if 0 <= k < len(words) - 1})
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.int32()), pa.array(list(c.values()), pa.int64())], names=["phrase", "toxic", "n"])

    found = sample.mapInArrow(find, "phrase string, toxic int, n bigint").groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"))
    return [r["phrase"] for r in found.filter("clean >= 2 and bad = 0").orderBy("phrase").collect()]


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    C.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, out, texts in C.rows_of(batches, "doc_id", "held_out", "text"):
            s = [model.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows predicted toxic; all columns stay."""
    C.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([model.score(t) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
