"""Token counts of sections, from one encoding of each whole document.

A document is encoded once; each token keeps the span of characters that its
bytes lie in. An interval join of token spans with the document's sections (here
its lines, each with the line feed that ends it; ``cut`` may give other ones, or fields with
gaps between them) counts tokens by section. A token that meets several goes by an explicit rule:

* ``start``: to the first section that it meets (the default),
* ``end``: to the last one,
* ``most``: to the section with most of its characters, the earliest of equals.

A token that meets none is in n_tokens alone.

Defined cases: a null or empty text has no tokens and no sections; a text that
ends in a line feed has no empty last section; repeated rows each get their row;
a null doc_id stays null; other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .encoder import _BYTES

_MOST = 0x180


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_MOST) if unicodedata.category(chr(c))[0] == kind)


_L, _N, _S = _class("L"), _class("N"), "\t-\r \x85\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile("[^\x00-ſ]|<\\|")


class SpanEncoder(dict):
    """Byte-level BPE whose memo holds, by piece, each token's span as two 32-bit integers."""

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most, self.old = Tokenizer.from_file(path), most, {}
        self.tokenize = self.tok.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            raw = piece.encode()
            tokens = [len(t.value) for t in self.tokenize(raw.decode("latin1").translate(_BYTES))]
            if len(raw) == len(piece):
                of = range(len(raw))
            else:
                of = [k for k, ch in enumerate(piece) for _ in range(len(ch.encode()))]
            out, at = [], 0
            for n in tokens:
                out += [of[at], of[at + n - 1] + 1]
                at += n
            found = struct.pack(f"<{len(out)}i", *out)
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found

    def spans(self, text: str) -> np.ndarray:
        """Start and end of each token, in code points."""
        if _OTHER.search(text):
            return np.asarray(self.tok.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        pieces = _PIECE.findall(text)
        if not pieces:
            return np.zeros((0, 2), np.int64)
        got = list(map(self.__getitem__, pieces))
        spans = np.frombuffer(b"".join(got), "<i4").reshape(-1, 2).astype(np.int64)
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.fromiter(map(len, got), np.int64, len(got)) >> 3
        return spans + np.repeat(np.cumsum(lens) - lens, counts)[:, None]


def lines(text: str) -> list[int]:
    """First positions of a text's lines."""
    starts = [0] if text else []
    at = text.find("\n")
    while at >= 0 and at + 1 < len(text):
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def allocate(spans: np.ndarray, sections: list, rule: str) -> tuple[np.ndarray, int]:
    """Tokens by section, and how many meet several. Sections, ascending and apart from each other, are (start, end)
    pairs, or starts of sections that end where the next begins."""
    if not sections:
        return np.zeros(0, np.int64), 0
    if isinstance(sections[0], tuple):
        begin, ends = np.asarray(sections, np.int64).T
    else:
        begin = np.asarray(sections, np.int64)
        ends = np.append(begin[1:], np.iinfo(np.int64).max)
    first, last = np.searchsorted(ends, spans[:, 0], "right"), np.searchsorted(begin, np.maximum(spans[:, 1], spans[:, 0] + 1), "left") - 1
    inside = first <= last
    spans, first, last = spans[inside], first[inside], last[inside]
    crossing = int((first != last).sum())
    to = last if rule == "end" else first.copy()
    if rule == "most":
        for i in np.flatnonzero(first != last).tolist():
            part = [min(ends[s], spans[i, 1]) - max(begin[s], spans[i, 0]) for s in range(first[i], last[i] + 1)]
            to[i] = first[i] + int(np.argmax(part))
    return np.bincount(to, minlength=len(begin)), crossing


_encoders: dict[str, SpanEncoder] = {}


def attribute(docs: DataFrame, tokenizer: str, rule: str = "start", cut: Callable[[str], list] = lines) -> DataFrame:
    """Per document: doc_id, n_tokens, n_sections, n_crossing, section_tokens (by section, in order)."""
    if rule not in ("start", "end", "most"):
        raise ValueError(f"no such rule: {rule}")
    C.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = SpanEncoder(tokenizer)
        enc = _encoders[tokenizer]
        for ids, texts in C.rows_of(batches, "doc_id", "text"):
            n, sections, crossing, counts = [], [], [], []
            for text in texts:
                spans, starts = enc.spans(text or ""), cut(text or "")
                c, x = allocate(spans, starts, rule)
                n.append(len(spans))
                sections.append(len(starts))
                crossing.append(x)
                counts.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sections, pa.int64()), pa.array(crossing, pa.int64()), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return some.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_sections bigint, n_crossing bigint, section_tokens array<bigint>")
