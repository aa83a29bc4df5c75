"""Fast, exact encoding with a ``tokenizers`` vocabulary whose split never crosses white space.

The library is called for each word once; the ids of a text are those of its words in order. Two ways to the words:

* A text in ASCII or Latin letters (no code point over U+024F) is lower-cased and cut at blanks; a word that is new is cut by the
  vocabulary's own pattern, and the library's model is called for each new match.
* Any other text is cut at ASCII blanks; normalisation, added tokens and the pattern never reach across a blank.

``fits`` says whether a vocabulary has the normaliser and pattern that this relies on; ``WordEncoder`` falls back to
encoding whole texts otherwise.
"""
from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata

import numpy as np
from tokenizers import Tokenizer

_TOP = 0x250
#: Letters under U+0250 and what they are in lower case: that of some lies above.
_LETTER = "".join(map(re.escape, sorted({x for c in range(_TOP) for x in chr(c) + chr(c).lower() if unicodedata.category(x)[0] == "L"})))
_NUMBER = "".join(re.escape(chr(c)) for c in range(_TOP) if unicodedata.category(chr(c))[0] == "N")
_BLANK = "".join(re.escape(chr(c)) for c in (*range(9, 14), 32, 0x85, 0xA0))
#: The vocabulary's pattern for code points under U+0250 in lower case.
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")
#: Anything outside this goes the general way: higher code points, the first characters of added tokens, C0 controls.
_PLAIN = re.compile(r"[\t\n\r -;=-~\xa0-ɏ]*", re.ASCII)
#: The character that stands for a byte from 128 on, by the library's byte level; ASCII without blanks stands for itself.
_BYTES = {b: 0x100 + n for n, b in enumerate([*range(33), *range(127, 161), 173])} | {b: b for b in (*range(161, 173), *range(174, 256))}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def fits(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    norm = [n["type"] for n in (d.get("normalizer") or {}).get("normalizers", [])]
    pre = (d.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    model = d.get("model") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback"))
    level = len(pre) == 2 and pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex", True)
    return norm == ["NFC", "Replace", "Lowercase"] and pre[0].get("pattern") == {"Regex": PATTERN} and d.get("post_processor") is None and plain and level


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; what it has learnt serves the worker's later tasks too."""
    return WordEncoder(path)


class WordEncoder:
    """``memo``: words remembered at most in each of two generations."""

    def __init__(self, path: str, memo: int = 400_000):
        self.tok, self.memo, self.known, self.older, self.fits = Tokenizer.from_file(path), memo, {}, {}, fits(path)
        self.model = self.tok.model

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def _piece(self, piece: str) -> bytes:
        """The ids of one match of the pattern in a text of the first kind, by the library's model itself."""
        raw = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(_BYTES)
        ids = [t.id for t in self.model.tokenize(raw)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words, single: bool) -> None:
        known, older = self.known, self.older

        def found(word, make):
            ids = known.get(word)
            if ids is None:
                ids = older.get(word)
                known[word] = ids = make(word) if ids is None else ids
            return ids

        def cut(word):
            pieces = _CUT.findall(word)
            return self._piece(word) if len(pieces) == 1 else b"".join([found(p, self._piece) for p in pieces])

        make = cut if single else lambda w: self._ids(w.decode("utf-8", "replace")).tobytes()
        for w in set(words).difference(known):
            found(w, make)

    def __call__(self, text: str) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit integers."""
        if not self.fits:
            return self._ids(text).tobytes()
        single = bool(_PLAIN.fullmatch(text)) and unicodedata.is_normalized("NFC", text)
        words = text.lower().split() if single else text.encode("utf-8", "replace").split()
        if len(self.known) > self.memo:
            self.known, self.older = {}, self.known
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            self._learn(words, single)
            return b"".join([known[w] for w in words])
