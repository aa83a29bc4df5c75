"""Token counts that follow edits.

A document's text is cut by a split pattern into pre-tokens; a sum tree over leaves of them holds characters and tokens. An
edit (start, end, replacement in characters) descends the tree to the pre-tokens it touches, re-cuts from the one before
them outwards, re-encodes the new cuts and updates the sums on the paths above the leaves that changed.

Boundary context: a cut depends on no character before its start and on at most two behind its end, so cutting starts one
pre-token before the one that holds the last character before the edit, and stops where a new cut begins behind the edit at
a place where an old one began: from there both texts are cut alike. The stretch looked at grows until that happens.

Leaves change in place; the tree is built anew only when a leaf has grown to four times its size, so once in several hundred
inserted pre-tokens.

Nulls: a null text is empty, a null edit list is no edit, a null replacement is a deletion, a null start is the start and a
null end is the start (an insertion). Offsets are clamped to the text as it is at that moment. Edits apply in array order.
Rows that repeat an id are counted each by itself; extra columns are ignored, whatever their names; an empty table gives an
empty table. A long text is held by its task only, in memory proportional to its length.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PrefixBPE, encoder

LEAF = 128


class SegmentTree:
    """Pre-tokens in leaves of LEAF (in time 0 to 4*LEAF), above them a binary tree of sums of characters and tokens."""

    def __init__(self, cuts: list[str], counts: list[int]):
        self.builds = 0
        self._build(cuts, counts)

    def _build(self, cuts: list[str], counts: list[int]) -> None:
        self.builds += 1
        self.leaves = [[cuts[i : i + LEAF], counts[i : i + LEAF]] for i in range(0, len(cuts), LEAF)] or [[[], []]]
        self.size = size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.c, self.t = [0] * (2 * size), [0] * (2 * size)
        for i, (some, n) in enumerate(self.leaves):
            self.c[size + i], self.t[size + i] = sum(map(len, some)), sum(n)
        for i in range(size - 1, 0, -1):
            self.c[i], self.t[i] = self.c[2 * i] + self.c[2 * i + 1], self.t[2 * i] + self.t[2 * i + 1]

    @property
    def chars(self) -> int:
        return self.c[1]

    @property
    def tokens(self) -> int:
        return self.t[1]

    def locate(self, char: int) -> tuple[int, int]:
        """The leaf that holds the character (the last one with text at the end) and the characters before the leaf."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if char >= before + self.c[node] and self.c[node + 1] > 0:
                before += self.c[node]
                node += 1
        return node - self.size, before

    def find(self, char: int) -> tuple[int, int, int]:
        """Leaf, place in the leaf and start of the pre-token that holds the character; at the end of the text that of the last."""
        leaf, at = self.locate(char)
        cuts = self.leaves[leaf][0]
        for k, cut in enumerate(cuts):
            if char < at + len(cut) or k == len(cuts) - 1:
                return leaf, k, at
            at += len(cut)
        return leaf, 0, at

    def after(self, leaf: int, k: int, n: int) -> list[str]:
        """Up to n pre-tokens from place k of a leaf on."""
        found: list[str] = []
        while leaf < len(self.leaves) and len(found) < n:
            found += self.leaves[leaf][0][k : k + n - len(found)]
            leaf, k = leaf + 1, 0
        return found

    def replace(self, leaf: int, k: int, removed: int, cuts: list[str], counts: list[int]) -> None:
        """Put ``cuts`` in the place of ``removed`` pre-tokens from place k of a leaf on; the leaves between are patched."""
        first = self.leaves[leaf]
        here = min(removed, len(first[0]) - k)
        first[0][k : k + here], first[1][k : k + here] = cuts, counts
        self._patch(leaf)
        removed, at = removed - here, leaf + 1
        while removed:
            some, n = self.leaves[at]
            here = min(removed, len(some))
            del some[:here], n[:here]
            self._patch(at)
            removed, at = removed - here, at + 1
        if len(first[0]) > 4 * LEAF:
            self._build([c for some, _ in self.leaves for c in some], [n for _, ns in self.leaves for n in ns])

    def _patch(self, leaf: int) -> None:
        node = self.size + leaf
        self.c[node], self.t[node] = sum(map(len, self.leaves[leaf][0])), sum(self.leaves[leaf][1])
        while node > 1:
            node //= 2
            self.c[node], self.t[node] = self.c[2 * node] + self.c[2 * node + 1], self.t[2 * node] + self.t[2 * node + 1]


class EditableCount:
    """One document under edits. ``reencoded`` counts the pre-tokens that edits made anew, ``recut`` the characters cut anew."""

    def __init__(self, bpe: PrefixBPE, text: str):
        self.bpe, self.reencoded, self.recut = bpe, 0, 0
        cuts = bpe.cuts(text)
        self.tree = SegmentTree(cuts, bpe.counts(cuts))

    @property
    def tokens(self) -> int:
        return self.tree.tokens

    def text(self) -> str:
        return "".join("".join(c) for c, _ in self.tree.leaves)

    def edit(self, start: int, end: int, added: str) -> None:
        tree = self.tree
        start = min(max(0, start), tree.chars)
        end = min(max(start, end), tree.chars)
        leaf, k, at = tree.find(max(0, start - 1))
        if at:  # one pre-token of boundary context
            leaf, k, at = tree.find(at - 1)
        ahead = 8
        while True:
            old = tree.after(leaf, k, ahead)
            stretch = "".join(old)
            whole = at + len(stretch) == tree.chars
            if end - at <= len(stretch):
                new = stretch[: start - at] + added + stretch[end - at :]
                found = self._meet(old, self.bpe.cuts(new), start - at + len(added), len(added) - (end - start), len(new), whole)
                self.recut += len(new)
                if found:
                    break
            ahead *= 4
        removed, cuts = found
        self.reencoded += len(cuts)
        tree.replace(leaf, k, removed, cuts, self.bpe.counts(cuts))

    @staticmethod
    def _meet(old: list[str], new: list[str], behind: int, shift: int, size: int, whole: bool) -> tuple[int, list[str]] | None:
        """How many old cuts give way to which new ones: up to the first place behind the edit where both begin a cut. Cuts that
        end in the last two characters of a stretch that isn't the whole rest may not count."""
        begins, at = {}, shift
        for i, cut in enumerate(old):
            begins[at] = i
            at += len(cut)
        if whole:
            begins[at] = len(old)
        at, last = 0, size if whole else size - 2
        for n, cut in enumerate((*new, "")):
            if at > last:
                return None
            if at >= behind and at in begins:
                return begins[at], new[:n]
            at += len(cut)
        return None


def attach_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with ``edits``: each document's (start, end, added) in order of ``seq``, from edits(id, seq, start, end, added).
    A document's edits depend on each other, so they are one array; documents are spread by id."""
    item = F.struct("seq", "start", "end", "added")
    lists = edits.groupBy(F.col(id_col).alias("_eid")).agg(F.array_sort(F.collect_list(item)).alias("_e"))
    joined = docs.join(lists, docs[id_col] == lists["_eid"], "left").drop("_eid")
    return joined.withColumn("edits", F.transform("_e", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["added"].alias("added")))).drop("_e")


def counts_under_edits(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Per row: id, n_tokens_before, n_tokens_after, n_cuts, n_reencoded (pre-tokens that the edits made anew)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.transform(edits_col, lambda e: F.coalesce(e["start"].cast("long"), F.lit(0).cast("long"))).alias("_start"),
        F.transform(edits_col, lambda e: F.coalesce(e["end"].cast("long"), e["start"].cast("long"), F.lit(0).cast("long"))).alias("_end"),
        F.transform(edits_col, lambda e: F.coalesce(e["added"], F.lit(""))).alias("_added"))

    def run(batches):
        bpe = encoder(ranks_path, pattern)
        for pdf in batches:
            rows = []
            for text, starts, ends, added in zip(pdf["_text"], pdf["_start"], pdf["_end"], pdf["_added"], strict=True):
                doc = EditableCount(bpe, text)
                before = doc.tokens
                for s, e, a in zip(*(() if x is None else x for x in (starts, ends, added)), strict=True):
                    doc.edit(int(s), int(e), a)
                rows.append((before, doc.tokens, sum(len(c) for c, _ in doc.tree.leaves), doc.reencoded))
            out = pd.DataFrame(rows, columns=["n_tokens_before", "n_tokens_after", "n_cuts", "n_reencoded"])
            out.insert(0, "_id", pdf["_id"].to_numpy())
            yield out

    out = source.mapInPandas(run, f"_id {id_type}, n_tokens_before long, n_tokens_after long, n_cuts long, n_reencoded long")
    return out.withColumnRenamed("_id", id_col)
