"""Secret scan with multipart credential linking.

Three base kinds stand alone: assignments to a password-like name, access
identifiers and long hexadecimal strings. Weak parts mean nothing by themselves:
a 40-character key body, a short assigned value, an endpoint. They are joined by
interval: parts belong to one scope where less than SCOPE code points part them,
and a weak key body or short value is reported only where its scope holds an
access identifier or an endpoint with a user, an endpoint only beside a reported
secret of its scope. All of it takes time in proportion to a text, but for sorting spans.

Defined cases: a null text is scanned as an empty one; empty texts have no
spans, and their base digest is that of the empty string; long texts are scanned
whole; repeated rows each get their row; a null doc_id stays null; other columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SCOPE = 200
KINDS = ("assign", "access", "hex", "keybody", "short", "endpoint")
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_HEX_BYTES = re.compile(rb"[0-9a-f]{16,}")
_BODY = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])")
_URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+", re.ASCII)
_ADDRESS = re.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}:\d{2,5}\b", re.ASCII)
_DOTTED = re.compile(r"[a-z0-9-]++(?:\.[a-z0-9-]++)*+")
_HOST = re.compile(r"\.amazonaws\.com\b", re.ASCII)
_WORDLIKE = re.compile(r"\w", re.ASCII)

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans of the three base kinds by start, then kind as listed."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.translate(C.LOWER)
    out: list[Span] = []
    if any(n in low for n in _NAMES):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if _HEX_BYTES.search(raw):
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def endpoints(text: str) -> list[Span]:
    """Urls, addresses with a port, and names below amazonaws.com; of overlapping ones the first to start, and of those the longest."""
    found: list[tuple[int, int]] = []
    if "://" in text:
        found += [m.span() for m in _URL.finditer(text)]
    if ":" in text and "." in text:
        found += [m.span() for m in _ADDRESS.finditer(text)]
    if ".amazonaws.com" in text:
        for m in _DOTTED.finditer(text):  # every dotted run once
            begin, end = m.span()
            if begin and _WORDLIKE.match(text[begin - 1]):  # the name would begin inside a word
                begin = next((k + 1 for k in range(begin, end) if text[k] in ".-" and k + 1 < end), end)
            last = max((h.end() for h in _HOST.finditer(text, begin, end) if h.start() > begin and not (h.end() < len(text) and _WORDLIKE.match(text[h.end()]))), default=0)
            if last:
                found.append((begin, last))
    out: list[Span] = []
    for begin, end in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or begin >= out[-1][1]:
            out.append((begin, end, "endpoint"))
    return out


class Covered:
    """The union of spans: does it meet another span?"""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for a, b, _ in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def __call__(self, span: Span) -> bool:
        k = bisect_right(self.ends, span[0])
        return k < len(self.starts) and self.starts[k] < span[1]


class Near:
    """Interval join against spans: is any within SCOPE of another span?"""

    def __init__(self, spans: list[Span]):
        self.starts = sorted(s[0] for s in spans)
        self.ends = sorted(s[1] for s in spans)

    def __call__(self, span: Span) -> bool:
        # spans that start before the far edge, less those that end before the near edge
        return bisect_left(self.starts, span[1] + SCOPE) - bisect_right(self.ends, span[0] - SCOPE) > 0


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts whose scope completes them."""
    access = [s for s in base if s[2] == "access"]
    ends = endpoints(text)
    if not access and not ends:
        return []
    covered = Covered([s for s in base if s[2] != "access"])
    body = [(m.start(), m.end(), "keybody") for m in _BODY.finditer(text) if re.search("[0-9+/]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0])]
    low = text.encode("utf-8", "surrogatepass").translate(C.LOWER)
    short = [(m.start(), m.end(), "short") for m in _ASSIGN.finditer(text) if 4 <= len(m[2]) < 12 and re.search(r"\d", m[2])] if any(n in low for n in _NAMES) else []
    by_access, by_user, by_end = Near(access), Near([e for e in ends if "@" in text[e[0] : e[1]]]), Near(ends)
    weak = [s for s in body if (by_access(s) or by_user(s)) and not covered(s)] + [s for s in short if by_access(s) or by_end(s)]
    secret = Near([s for s in weak + base if s[2] not in ("endpoint", "access", "hex")])
    return weak + [e for e in ends if secret(e)]


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    C.prepare(docs.sparkSession)

    def told(spans: list[Span]) -> str:
        return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in C.rows_of(batches, "doc_id", "text"):
            rows = []
            for i, text in zip(ids, texts, strict=True):
                base = base_spans(text or "")
                kinds = [s[2] for s in base]
                more = linked_spans(text or "", base)
                every = sorted({*base, *more}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                rows.append((i, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(told(base).encode()).hexdigest(), told(every), len(every) - len(base)))
            t = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, t, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_linked bigint")
