"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one last token: the encoding of the prefix ends with it. ``Prefixes``
stores that token for every prefix. A token t that ends prefix i is the last one iff the pair (last token of the prefix
before t, t) is one that BPE leaves alone; so appending bytes needs only lookups, and an edit re-computes prefixes from
the edit on until the stored tokens agree again.

Vocabularies are rank files (base64 token, rank). The split pattern cuts the text first; each cut is encoded by itself.
"""
from __future__ import annotations

import base64
import functools
import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The pattern of the public rank files, and its twin for code points under U+0250.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CLASS = {k: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
_CLASS["S"] = "".join(re.escape(chr(c)) for c in (*range(9, 14), 32, 0x85, 0xA0))
LATIN = re.compile(r"[\t\n\r -~\xa0-\u024f]*")
LATIN_CUT = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+".format(**_CLASS))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixBPE:
    """Encoder and decoder for one vocabulary. ``memo`` bounds the remembered cuts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 400_000):
        self.ranks, self.split, self.memo = ranks, regex.compile(pattern), memo
        self.latin = LATIN_CUT if pattern == PATTERN else None
        self.longest = max(map(len, ranks), default=0)
        self.token = {i: b for b, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.sizes: dict[str, int] = {}

    def cuts(self, text: str) -> list[str]:
        """The matches of the pattern. A text in Latin letters takes the standard library's faster matcher, whose classes
        list the same code points; only the known pattern has such a twin."""
        if self.latin and LATIN.fullmatch(text):
            return self.latin.findall(text)
        return self.split.findall(text)

    def merged(self, data: bytes) -> list[int]:
        """BPE by its definition: join the adjacent pair of lowest rank, leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens, side by side, as they are. left < 0: right stands alone."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            if left < 0:
                found = self.merged(self.token[right]) == [right]
            else:
                found = self.merged(self.token[left] + self.token[right]) == [left, right]
            self.pairs[left, right] = found
        return found

    def last_tokens(self, data: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of every prefix; ``known`` holds those of a prefix already done (an exact append)."""
        last = [-1, *(known or [])]
        rank, pair, longest = self.ranks.get, self.pairs.get, self.longest
        for end in range(len(last), len(data) + 1):
            for start in range(max(0, end - longest), end):
                t = rank(data[start:end])
                if t is not None:
                    ok = pair((last[start], t))
                    if ok or ok is None and self.compatible(last[start], t):
                        last.append(t)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last[1:]

    def walk(self, last: list[int]) -> list[int]:
        """The encoding, read from the end of the table of last tokens."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.token[last[end - 1]])
        return out[::-1]

    def encode_cut(self, cut: str) -> bytes:
        """Ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        data = cut.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.walk(self.last_tokens(data))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > self.memo:  # the words of the last texts stay
            self.known, self.older = {}, known
            known = self.known
        cuts = self.cuts(text)
        try:
            parts = [known[c] for c in cuts]
        except KeyError:
            for c in set(cuts):
                if c not in known:
                    known[c] = self.older.get(c) or self.encode_cut(c)
            parts = [known[c] for c in cuts]
        return np.frombuffer(b"".join(parts), "<u4")

    def counts(self, cuts: list[str]) -> list[int]:
        """Tokens of each cut."""
        sizes = self.sizes
        if len(sizes) > 2 * self.memo:
            sizes.clear()
        try:
            return [sizes[c] for c in cuts]
        except KeyError:
            for c in set(cuts):
                if c not in sizes:
                    sizes[c] = len(self.encode_cut(c)) // 4
            return [sizes[c] for c in cuts]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))

    def reencode(self, old: bytes, last: list[int], at: int, removed: int, added: bytes) -> tuple[bytes, list[int]]:
        """After replacing ``removed`` bytes at ``at``: the new bytes and their table of last tokens.

        Prefixes before the edit keep their tokens. Behind it, once as many consecutive prefixes as the longest token
        agree with the old table, all that follow agree, for a last token depends on nothing further back.
        """
        new = old[:at] + added + old[at + removed :]
        shift = len(added) - removed
        table, run = list(last[:at]), 0
        for end in range(at + 1, len(new) + 1):
            self._grow(new, table, end)
            j = end - 1 - shift
            same = end - len(added) - at > 0 and 0 <= j < len(last) and last[j] == table[-1]
            run = run + 1 if same else 0
            if run >= self.longest:
                return new, table + last[j + 1 :]
        return new, table

    def _grow(self, data: bytes, last: list[int], end: int) -> None:
        for start in range(max(0, end - self.longest), end):
            t = self.ranks.get(data[start:end])
            if t is not None and self.compatible(last[start - 1] if start else -1, t):
                last.append(t)
                return
        raise ValueError("the vocabulary lacks a byte")


@functools.lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> PrefixBPE:
    """The encoder of this Python worker; what it has learnt serves the worker's later tasks too."""
    return PrefixBPE(read_ranks(ranks_path), pattern)


def encode_table(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids (array, unless keep_ids is false), ids_sha256, decoded_sha256 of the decoded ids.

    Null texts are empty: no ids. Rows that repeat an id are encoded each by itself; extra columns are ignored, whatever their
    names; an empty table gives an empty table. One pass without a shuffle; a text, however long, is held by its task only. The
    rank file is read where the tasks run (the path is a parameter of the deployment).
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches):
        bpe = encoder(ranks_path, pattern)
        for pdf in batches:
            rows = []
            for text in pdf["_text"]:
                ids = bpe.encode(text)
                row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest())
                rows.append((*row, ids.astype(np.int64)) if keep_ids else row)
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)
            out.insert(0, "_id", pdf["_id"].to_numpy())
            yield out

    out = source.mapInPandas(run, f"_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids)
    return out.withColumnRenamed("_id", id_col)


def decode_table(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the text of its ids (null ids: empty)."""
    id_type = encoded.schema[id_col].dataType.simpleString()
    source = encoded.select(F.col(id_col).alias("_id"), F.coalesce(F.col(ids_col).cast("array<long>"), F.array().cast("array<long>")).alias("_ids"))

    def run(batches):
        bpe = encoder(ranks_path, pattern)
        for pdf in batches:
            yield pd.DataFrame({"_id": pdf["_id"], "text": [bpe.decode(np.asarray(i)).decode("utf-8", "replace") for i in pdf["_ids"]]})

    return source.mapInPandas(run, f"_id {id_type}, text string").withColumnRenamed("_id", id_col)
