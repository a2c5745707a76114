"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between the edges of block-level
elements. Each block has features of its ancestors (tags, words of class, id and
role attributes) and of its text (length, links, punctuation, place). A
two-state chain, trained on the labelled pages of ``training_pages`` (built here,
in many layouts), is decoded by Viterbi; what it calls main is the text.

Character references are decoded and white space inside a block becomes one
space; blocks are joined in page order by a line feed. Comments, scripts, styles,
drawings (svg) and what else ``_RAW`` names hold no text; math and noscript are
part of the text around them, without the source note of a formula; xmp is text as
it stands. Nothing else is cut off or capped.

Defined cases: a null or empty page, and one without text, gives an empty text;
unclosed and crossing tags close with an enclosing element or the page; the page's last
tag is dropped where the page breaks off inside of it, while an earlier < that no > follows is
text; a quote that never closes doesn't hide the end of its tag; repeated rows each get their row;
null ids and urls stay null; other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_RAW = ("script", "style", "textarea", "title", "template", "iframe", "canvas", "object")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br label noscript".split()) | frozenset(
    "math annotation maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
#: Tags at which HTML leaves an svg whose end tag is missing (or a foreignObject with HTML in it).
_LEAVES_SVG = "address article aside b big blockquote body br center code dd details div dl dt em embed fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html i img li main menu nav ol p pre ruby s section small span strike strong sub sup table td th tr tt u ul var".split()
_MARK = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME_OF = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Up to the end of a tag: a quoted value may hold >. Nothing is tried twice.
_TAG_END = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_SVG_END = re.compile(rf"</svg(?:[\s/][^>]*)?>|(?=</?(?:{'|'.join(_LEAVES_SVG)})[\s/>])", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I) for name in (*_RAW, "xmp")}
#: Tags that reach the page's end in a quoted value; after so many, quotes aren't heeded any more.
_PATIENCE = 8
#: A block's features look at so many of its nearest ancestors.
_NEAR = 64
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+|\d+")
_SPACE = re.compile(r"\s+")
#: A start tag that ends open elements of these names.
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_BLOCK_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul figure details".split())


_SECTIONS = frozenset("article main nav aside footer header form section".split())
_ASIDE = frozenset("nav aside footer header form".split())


class Block:
    __slots__ = ("path", "text", "link")

    def __init__(self, path: tuple, text: str, link: int):
        self.path, self.text, self.link = path, text, link


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """The page as (kind, name or text, attributes): kinds are text, plain (text as it stands), open, close
    and xmp. One pass: what has been looked through in vain isn't looked through again."""
    at, last, tries, no_cdata = 0, page.rfind(">"), 0, False
    while True:
        m = _MARK.search(page, at)
        i = m.start() if m else len(page)
        if i > at:
            yield "text", page[at:i], ""
        if m is None:
            return
        kind = page[i + 1]
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            if end < 0:
                return
            at = end + 3
            continue
        if page.startswith("<![CDATA[", i) and not no_cdata:
            end = page.find("]]>", i + 9)
            if end >= 0:
                yield "plain", page[i + 9 : end], ""
                at = end + 3
                continue
            no_cdata = True
        if i > last:  # no tag ends any more: what looks like the start of one is text, but for the page's last
            if not kind.isalpha() or page.find("<", i + 1) < 0:
                return
            yield "text", "<", ""
            at = i + 1
            continue
        named = _NAME_OF.match(page, i)
        if named is None:  # a declaration, or what isn't the end of anything
            at = page.find(">", i) + 1
            continue
        end = None
        if tries < _PATIENCE:
            end = _TAG_END.match(page, named.end())
            tries += end is None
        end = end.end() if end else page.find(">", named.end()) + 1
        name, attrs, at = named[1].lower(), page[named.end() : end - 1], end
        if kind == "/":
            yield "close", name, ""
        elif name == "svg":
            if not attrs.endswith("/"):
                close = _SVG_END.search(page, at) if at <= last else None
                if close is None:
                    return
                at = close.end()
        elif name in _RAW_END:
            close = _RAW_END[name].search(page, at) if at <= last else None
            if name == "xmp":
                yield "xmp", page[at : close.start() if close else len(page)], ""
            if close is None:
                return
            at = close.end()
        else:
            yield "open", name, attrs


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks in page order; a path is (tag, words of its attributes) from the root down, inline elements left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    where: dict[str, list[int]] = {}  # places of open elements in the stack, by tag
    solid: list[int] = []  # places of those that aren't inline
    path: list[tuple[str, tuple[str, ...]]] = []  # these themselves
    held: list[str] = []
    linked = [0, 0]  # open links, characters in links

    def push(tag: str, names: tuple[str, ...]) -> None:
        where.setdefault(tag, []).append(len(stack))
        if tag not in _INLINE:
            solid.append(len(stack))
            path.append((tag, names))
        stack.append((tag, names))

    def close_from(k: int) -> None:
        while len(stack) > k:
            tag, _ = stack.pop()
            where[tag].pop()
            if tag not in _INLINE:
                solid.pop()
                path.pop()

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                out.append(Block(tuple(path[-_NEAR:]), text, min(len(text), linked[1])))
            held.clear()
        linked[1] = 0

    def say(s: str) -> None:
        if s and not (stack and stack[-1][0] == "annotation" and where.get("math")):
            held.append(s)
            if linked[0]:
                linked[1] += len(s)

    for kind, tag, attrs in tokens(page or ""):
        if kind == "text":
            say(tag)
            continue
        if kind == "plain":
            say(html.escape(tag, quote=False))
            continue
        if kind == "xmp":
            flush()
            push("xmp", ())
            say(html.escape(tag, quote=False))
            flush()
            close_from(len(stack) - 1)
            continue
        if tag not in _INLINE:
            flush()
        elif tag == "br":
            held.append(" ")
        if kind == "close":
            if tag == "a":
                linked[0] = 0
            k = where[tag][-1] if where.get(tag) else -1
            # an inline element's end doesn't reach out of the block around it
            if k >= 0 and not (tag in _INLINE and solid and k < solid[-1]):
                close_from(k)
        elif tag not in _VOID:
            ends = _ENDS.get(tag) or ({"p"} if tag in _BLOCK_ENDS_P else None)
            if ends and solid and stack[solid[-1]][0] in ends:
                linked[0] = 0
                close_from(solid[-1])
            if tag == "a":
                linked[0] = 1
            names = tuple(w for a in _ATTR.finditer(attrs) for w in _NAME.findall((a[2] or a[3] or a[4] or "").lower())) if "=" in attrs else ()
            if not attrs.endswith("/") or tag not in _INLINE:
                push(tag, names)
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    n = len(blocks)
    out = []
    for k, b in enumerate(blocks):
        f = ["bias"]
        seen: set[str] = set()
        for depth, (tag, names) in enumerate(reversed(b.path)):
            if tag not in ("html", "body"):
                seen.add(f"in={tag}")
                if depth == 0:
                    seen.add(f"own={tag}")
                if depth == 1:
                    seen.add(f"up={tag}")
            seen.update(f"name={w}" for w in names)
        near = next((tag for tag, _ in reversed(b.path) if tag in _SECTIONS), "none")
        seen.add(f"near={near}")
        if not any(tag in _ASIDE for tag, _ in b.path):
            seen.add("inner" if near in ("article", "main") else "plain")
            if not any(names for _, names in b.path):
                seen.add(f"bare={near}")
        f += seen
        t = b.text
        size = len(t)
        f.append(f"len={min(8, size.bit_length())}")
        f.append(f"links={(4 * b.link) // (size or 1)}")
        f.append("stop" if t[-1] in ".!?…\"”" else "open")
        f.append(f"marks={min(3, t.count(',') + t.count('. '))}")
        if "©" in t or "®" in t:
            f.append("copyright")
        if sum(map(str.isdigit, t)) * 4 > size:
            f.append("digits")
        if k == 0:
            f.append("first")
        if k == n - 1:
            f.append("last")
        out.append(f)
    return out


# -- labelled pages -----------------------------------------------------------------------

_SYLLABLES = "an ar be co da de el en er es fa ga in ka la le lo ma mi na ne on or pa ra re ri sa se ta te ti to un va we xo yu zi".split()


def training_pages(count: int = 900, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages in random layouts, each with the label of every leaf block (1: main text)."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))

    def sentence(low: int = 3, high: int = 25) -> str:
        w = [word() for _ in range(r.randint(low, high))]
        return (" ".join(x + ("," if r.random() < 0.08 else "") for x in w)).capitalize() + r.choice("...?!")

    def prose() -> str:
        t = " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 5, 9, 20])))
        k = r.random()
        if k < 0.15:
            t = sentence(1, 3)
        elif k < 0.25:
            t = t.rstrip(".?!…")
        elif k < 0.31:
            t = r.choice([" | ", " - ", " / "]).join(word() for _ in range(r.randint(3, 60)))
        elif k < 0.36:
            t = " ".join(x + r.choice(["***", "%%%", "&amp;&amp;", "!!", "#"]) for x in t.split())
        elif k < 0.39:
            t = r.choice([f"© 20{r.randint(10, 26)} {phrase()}. All rights reserved.", f"Licensed under the {phrase()} License, Version {r.randint(1, 9)}.0.", f"Copyright (c) 20{r.randint(10, 26)} {phrase()}", f"{word()}@{word()}.com, +{r.randint(10**9, 10**11)}", f"{word()} = {r.getrandbits(128):x}"])
        elif k < 0.42:
            t = " ".join([word()] * r.randint(5, 80))
        elif k < 0.44:
            t = phrase()
        if r.random() < 0.2:
            k = t.find(" ", len(t) // 3)
            t = f"{t[:k]} <a href='/x'>{word()}</a>{t[k:]}" if k > 0 else t
        if r.random() < 0.15:
            t = r.choice(["<b>", "<em>", "<b>"]) + t + r.choice(["<br>", "</b>", "</em>"])
        return t

    def phrase() -> str:
        return " ".join(word() for _ in range(r.randint(1, 4))).capitalize()

    def some(low: int, high: int, make) -> list:
        return [make() for _ in range(r.randint(low, high))]

    def wrap(tag: str, names: str, body: list[tuple[str, int | None]]) -> list[tuple[str, int | None]]:
        a = f' {r.choice(["class", "class", "id"])}="{names}"' if names else ""
        return [(f"<{tag}{a}>", None), *body, (f"</{tag}>", None)]

    def para(label: int, text: str, tag: str = "p") -> list[tuple[str, int | None]]:
        return [(f"<{tag}>", None), (text, label), (f"</{tag}>" if r.random() < 0.92 or tag != "p" else "", None)]

    def links() -> list:
        body = []
        for _ in range(r.randint(2, 9)):
            body += wrap("li", "", [(f'<a href="/{word()}">{phrase()}</a>', 0)])
        return wrap("ul", r.choice(["", "menu", "links", "nav-list"]), body)

    def boxed(names: list[str], tags: list[str], low: int = 1, high: int = 3) -> list:
        kind = r.random()
        if kind < 0.4:
            body = [(r.choice([sentence(), prose(), phrase()]), 0)]
        elif kind < 0.7:
            body = sum((para(0, r.choice([sentence(), prose(), phrase()])) for _ in range(r.randint(low, high))), [])
        else:
            body = para(0, phrase(), r.choice(["h2", "h3", "h4", "p"])) + r.choice([links, lambda: para(0, prose())])()
        return wrap(r.choice(tags), r.choice(names), body)

    ad = lambda: boxed(["ad", "ads", "advert", "ad-box", "advertisement", "sponsored", "promo", "banner-ad", "ad slot"], ["div", "aside", "section", "ins"])
    notice = lambda: boxed(["notice", "cookie-notice", "cookie", "cookies", "consent", "gdpr", "banner", "alert", "warning", "popup", "modal", "paywall", "subscribe", "message notice"], ["div", "section", "aside", "p"])
    side = lambda: boxed(["", "sidebar", "side", "widget", "related", "related-posts", "recommended", "more", "tags", "share", "social", "popular", "trending"], ["aside"]) if r.random() < 0.5 else boxed(["sidebar", "side", "widget", "related", "related-posts", "share", "social", "recommended", "breadcrumb", "breadcrumbs", "toc", "author-bio", "popular", "trending"], ["div", "section", "aside"])
    form = lambda: wrap("form", r.choice(["", "search", "newsletter", "login", "signup", "contact"]), sum((r.choice([lambda: para(0, phrase(), "label"), lambda: para(0, sentence()), lambda: para(0, phrase(), "button")])() for _ in range(r.randint(1, 4))), [("<div>", None)]) + [("</div>", None)])
    menu = lambda: wrap(r.choice(["nav", "nav", "div"]), r.choice(["nav", "menu", "navbar", "navigation", "main-menu", "topnav"]), links()) if r.random() < 0.5 else wrap("nav", "", links())

    def header() -> list:
        body = para(0, phrase(), r.choice(["h1", "h2", "p", "div", "span"])) + (menu() if r.random() < 0.5 else []) + (para(0, sentence()) if r.random() < 0.4 else [])
        return wrap("header", r.choice(["", "site-header", "header", "top"]), body) if r.random() < 0.6 else wrap("div", r.choice(["header", "masthead", "top-bar", "site-header", "topbar"]), body)

    def footer() -> list:
        body = [(r.choice([f"&copy; {word()}.example.com &middot; {sentence()}", f"{phrase()} | {phrase()}", sentence(), f"© 20{r.randint(10, 26)} {phrase()}"]), 0)]
        if r.random() < 0.5:
            body = para(0, body[0][0])
        if r.random() < 0.3:
            body += links()
        return wrap("footer", r.choice(["", "", "site-footer", "footer"]), body) if r.random() < 0.7 else wrap("div", r.choice(["footer", "site-footer", "bottom", "copyright", "colophon"]), body)

    def comments() -> list:
        body = para(0, phrase(), r.choice(["h2", "h3", "h4"])) if r.random() < 0.7 else []
        for _ in range(r.randint(1, 6)):
            one = (para(0, phrase(), r.choice(["span", "div", "b", "cite"])) if r.random() < 0.5 else []) + sum((para(0, prose()) for _ in range(r.randint(1, 2))), [])
            body += wrap(r.choice(["div", "li", "article", "section"]), r.choice(["comment", "comment", "reply", "comment-body", "review", "user-comment"]), one)
        return wrap(r.choice(["section", "div", "ol", "ul", "aside"]), r.choice(["comments", "comment-list", "discussion", "responses", "replies", "reviews", "reader-comments"]), body)

    def main() -> list:
        body = para(1, r.choice([sentence(2, 12), phrase()]), "h1") if r.random() < 0.85 else []
        if body and r.random() < 0.15:
            body = wrap("header", r.choice(["", "", "post-header", "entry-header"]), body + (para(0, f"By {phrase()}") if r.random() < 0.5 else []))
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 15, 25])):
            k = r.random()
            if k < 0.8:
                body += para(1, prose())
            elif k < 0.87:
                body += para(1, phrase(), r.choice(["h2", "h3"]))
            elif k < 0.9:
                body += wrap(r.choice(["ul", "ol"]), "", sum((para(1, sentence(), "li") for _ in range(r.randint(1, 4))), []))
            elif k < 0.93:
                body += para(1, prose(), r.choice(["blockquote", "div", "pre", "td"]))
            elif k < 0.985:
                body += r.choice([ad, notice, side, form])()
            else:
                body += para(1, phrase(), "figcaption")
        if r.random() < 0.1:
            body += comments()
        if r.random() < 0.15:
            body = wrap("section", "", body)
        kind = r.random()
        if kind < 0.16:
            return body  # nothing around it
        if kind < 0.55:
            return wrap("article", r.choice(["", "", "", "post", "story", "entry"]), body)
        if kind < 0.7:
            return wrap("main", r.choice(["", "main", "content"]), body if r.random() < 0.6 else wrap("article", "", body))
        return wrap("div", r.choice(["content", "post", "entry", "entry-content", "article", "article-body", "story", "main", "main-content", "post-body", "text"]), body)

    pages = []
    for _ in range(count):
        parts: list[tuple[str, int | None]] = [(f"<!DOCTYPE html><html lang='en'><head><title>{phrase()}</title><style>p{{}}</style></head><body>", None)]
        before = [header, menu, notice, ad, side, form]
        after = [footer, comments, side, ad, form, notice, menu]
        for make in before:
            if r.random() < (0.6 if make in (header, menu) else 0.25):
                parts += make()
        if r.random() < 0.3:
            parts += wrap("div", r.choice(["wrapper", "container", "page", "row"]), main() + (side() if r.random() < 0.4 else []))
        else:
            parts += main()
        r.shuffle(after)
        for make in after:
            if r.random() < (0.7 if make is footer else 0.35 if make is comments else 0.2):
                parts += make()
        parts.append(("</body></html>", None))
        # a mark in front of each text says its label, and is taken out again
        marked = "".join(s if label is None else f"{s[: s.index('>') + 1] if s.startswith('<') else ''}\x01{label}{s[s.index('>') + 1 :] if s.startswith('<') else s}" for s, label in parts)
        labels = [int(b.text[b.text.index("\x01") + 1]) if "\x01" in b.text else 0 for b in leaf_blocks(marked)]
        pages.append((re.sub("\x01[01]", "", marked), labels))
    return pages


# -- the chain ----------------------------------------------------------------------------


class Crf:
    """Two states; weights of (feature, state), of transitions and of the first state."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, 2))
        self.trans = np.zeros((2, 2))
        self.start = np.zeros(2)
        self.table: dict[str, float] = {}

    def fit(self, pages: list[tuple[str, list[int]]], rounds: int = 200, rate: float = 0.1, ridge: float = 2e-3) -> Crf:
        """Maximum likelihood by Adam, over all pages at once (padded to the longest)."""
        data = []
        for page, labels in pages:
            f = features(leaf_blocks(page))
            if f and len(f) == len(labels):
                data.append((f, labels))
        for f, _ in data:
            for names in f:
                for x in names:
                    self.index.setdefault(x, len(self.index))
        n, most, m = len(data), max(len(y) for _, y in data), len(self.index)
        rows, cols = [], []
        y, mask = np.zeros((n, most), int), np.zeros((n, most), bool)
        for i, (f, labels) in enumerate(data):
            y[i, : len(labels)], mask[i, : len(labels)] = labels, True
            for k, names in enumerate(f):
                rows += [i * most + k] * len(names)
                cols += [self.index[x] for x in names]
        rows, cols = np.asarray(rows), np.asarray(cols)
        p = {"w": np.zeros((m, 2)), "t": np.zeros((2, 2)), "s": np.zeros(2)}
        m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
        hot = np.eye(2)[y] * mask[..., None]
        pairs = (mask[:, 1:])[..., None, None] * np.eye(2)[y[:, :-1]][..., :, None] * np.eye(2)[y[:, 1:]][..., None, :]
        lse = lambda a, axis: np.log(np.exp(a - a.max(axis, keepdims=True)).sum(axis)) + a.max(axis)
        for step in range(1, rounds + 1):
            e = np.stack([np.bincount(rows, p["w"][cols, s], n * most) for s in (0, 1)], 1).reshape(n, most, 2)
            alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
            alpha[:, 0] = p["s"] + e[:, 0]
            for k in range(1, most):
                a = lse(alpha[:, k - 1, :, None] + p["t"], 1) + e[:, k]
                alpha[:, k] = np.where(mask[:, k, None], a, alpha[:, k - 1])
            for k in range(most - 2, -1, -1):
                b = lse(p["t"] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
                beta[:, k] = np.where(mask[:, k + 1, None], b, 0.0)
            z = lse(alpha[:, -1], 1)
            at = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
            two = np.exp(alpha[:, :-1, :, None] + p["t"] + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            diff = (hot - at).reshape(-1, 2)
            g = {"w": np.stack([np.bincount(cols, diff[rows, s], m) for s in (0, 1)], 1) / n, "t": (pairs - two).sum((0, 1)) / n, "s": (hot[:, 0] - at[:, 0]).mean(0)}
            for k, v in p.items():
                d = g[k] - ridge * v
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * d, 0.99 * m2[k] + 0.01 * d * d
                v += rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        self.w, self.trans, self.start = p["w"], p["t"], p["s"]
        self.table = {x: float(self.w[i, 1] - self.w[i, 0]) for x, i in self.index.items()}
        return self

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The best states by Viterbi; only the states' difference in score matters to a block."""
        if not feats:
            return []
        t = self.trans.tolist()
        get = self.table.get
        back: list[tuple[int, int]] = []
        a, b = float(self.start[0]), float(self.start[1]) + sum(get(x, 0.0) for x in feats[0])
        for names in feats[1:]:
            d = sum(get(x, 0.0) for x in names)
            a0, b0, a1, b1 = a + t[0][0], b + t[1][0], a + t[0][1], b + t[1][1]
            back.append((int(b0 > a0), int(b1 > a1)))
            a, b = max(a0, b0), max(a1, b1) + d
        state = int(b > a)
        out = [state]
        for x in reversed(back):
            state = x[state]
            out.append(state)
        return out[::-1]


_WEIGHTS = "html_crf_weights.json"
_trained: Crf | None = None


def fitted() -> Crf:
    """The model fitted to the labelled pages: what the stored weights are made of."""
    return Crf().fit(training_pages())


def save(crf: Crf, path: str) -> None:
    import json

    said = {"start": crf.start.tolist(), "trans": crf.trans.tolist(), "table": dict(sorted(crf.table.items()))}
    with open(path, "w") as f:
        json.dump(said, f, indent=0)


def trained() -> Crf:
    """The fitted weights as stored beside this module; a test fits them again."""
    global _trained
    if _trained is None:
        import json
        import pkgutil

        said = json.loads(pkgutil.get_data(__package__, _WEIGHTS))
        _trained = Crf()
        _trained.start, _trained.trans, _trained.table = np.asarray(said["start"]), np.asarray(said["trans"]), said["table"]
    return _trained


def main_text(page: str | None, crf: Crf) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, s in zip(blocks, crf.decode(features(blocks)), strict=True) if s)


def extract(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    C.prepare(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(crf or trained())  # one weight for each feature of the training pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, htmls in C.rows_of(batches, "page_id", "url", "html"):
            texts = [main_text(h, model.value) for h in htmls]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    some = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return some.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
