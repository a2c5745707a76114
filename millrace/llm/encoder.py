"""Memoised encoding with the public word-level BPE: equal to the library's ids, several times as fast.

The tokenizer lower-cases, drops white space and never merges across its
pre-tokens, none of which holds white space, so the ids of a text are those of
its words one after the other. Texts of Latin letters up to U+017F (NFC leaves
them as they are) are split here and looked up; every other text, and any that
holds a special token's opening, goes to the library as a whole.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata

import numpy as np

#: A lower-cased word with other characters, or an opening of special tokens, is left to the library.
_OTHER = re.compile("[^\x00-\u017f]|<\\|")
#: str.split parts words at these, the library doesn't.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


class _Unknown(Exception):
    """A word whose text the library has to encode as a whole."""



def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_class('L')}{_class('N')}]+")


def _byte_letters() -> dict[int, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b if b in plain else 256 + sum(x not in plain for x in range(b)) for b in range(256)}


_BYTES = _byte_letters()


class _Memo(dict):
    """Ids by word, in two generations: a full one becomes the old one, so words in use stay.

    What is missing is worked out on the spot: a word's pieces are words too."""

    def __init__(self, tokenize, most: int):
        super().__init__()
        self.tokenize, self.most, self.old = tokenize, most, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            if _OTHER.search(word):
                raise _Unknown
            pieces = _PIECE.findall(word)
            if len(pieces) == 1:
                ids = [x.id for x in self.tokenize(word.encode().decode("latin1").translate(_BYTES))]
                found = struct.pack(f"<{len(ids)}I", *ids)
            else:
                found = b"".join([self[p] for p in pieces])
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


class Encoder:
    """path: a tokenizers file of the kind above. encode() gives little-endian uint32 ids as bytes."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.memo = _Memo(self.tok.model.tokenize, most)
        self.size = max(self.tok.get_vocab().values()) + 1

    def _library(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        try:
            if not any(c in text for c in _SEPARATORS):
                return b"".join(map(self.memo.__getitem__, text.lower().split()))
        except _Unknown:
            pass
        return self._library(text)
