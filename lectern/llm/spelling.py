"""Spelling variants: pairs of words one edit apart, by composing finite-state machines.

1. Words and their numbers of occurrences come from all texts, combined before they shuffle.
2. The machine "vocabulary acceptor, one-edit transducer, vocabulary acceptor" starts in pairs of equal states: until the edit
   both sides read the same letters, after it they do so again. Its runs are partitioned by the states from which and to which
   the edit may happen: the shorter word's length n, and an edit in its first half (so that the second half is common) or in
   the second (so that the first half is). A word of length L is in the partitions of n = L and n = L - 1, so each pair
   lies in exactly one, which has few words besides those alike.
3. In a partition the words, without what is common to all, become a minimised acceptor. Only its states with two ways on can
   hold the edit; from each of them the composed machine is walked to its final states, once for all prefixes that lead there.
   Cost follows the states and the pairs found, not the square of the words.
4. A partition of more than CROWD words is split by the place of the edit: then all but two letters are common, and its size
   is bounded by the alphabet.

Each pair comes out once, at the first place where the words differ. The form of a word is its near word of largest number
(ties: smallest in code-point order), if that number is TIMES the word's or more; forms lead to a root by pointer doubling,
whose rounds are the logarithm of the longest chain; a chain multiplies numbers by TIMES, so it is short.

Odd rows. Null texts have no words; a null id counts as an empty one. Repeated rows count as often as they occur. Words of any
length are taken whole. A word with no near word has itself as root. An empty table gives an empty table. Further columns are
ignored, whatever their names.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, maybe_broadcast, measured

MIN_LENGTH, MIN_COUNT, TIMES, NOISE = 7, 2, 10, 31
#: Words that a partition may hold before it is split by the place of the edit.
CROWD = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """word, n: the runs of Latin letters of all texts, each misspelt where ``noise`` divides the checksum of id and run (0: none).

    Shorter runs than ``min_length`` can't become words, so they aren't taken apart.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{min_length},}}"), F.lit(0))).alias("run"))
    word: Column = F.col("run")
    if noise:
        h = F.crc32(F.concat(F.col("_id"), F.lit(":"), F.col("run")).cast("binary"))
        at = (h % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(h % noise == 0, cut).otherwise(word)
    return (
        runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_count))


# --- machines --------------------------------------------------------------------------------------------------------

class Acceptor:
    """The minimal acyclic acceptor of sorted distinct words: ``states`` are (final, {letter: state}), and ``forks`` gives for each
    state that has two ways on (an end counts as one) the prefixes that lead to it."""

    def __init__(self, words: list[str]):
        self.states: list[tuple[bool, dict[str, int]]] = []
        self.forks: dict[int, list[str]] = defaultdict(list)
        self._known: dict[tuple, int] = {}
        open_ = [[False, []]]
        last = ""
        for word in words:
            shared = 0
            while shared < len(last) and last[shared] == word[shared]:
                shared += 1
            self._close(open_, last, shared)
            open_.extend([False, []] for _ in range(len(word) - shared))
            open_[-1][0] = True
            last = word
        self._close(open_, last, 0)
        self._state(open_[0], "")

    def _state(self, node: list, prefix: str) -> int:
        final, ways = node
        key = (final, tuple(ways))
        at = self._known.get(key)
        if at is None:
            at = self._known[key] = len(self.states)
            self.states.append((final, dict(ways)))
        if len(ways) + final > 1:
            self.forks[at].append(prefix)
        return at

    def _close(self, open_: list, last: str, depth: int) -> None:
        while len(open_) - 1 > depth:
            node = open_.pop()
            at = self._state(node, last[: len(open_)] if len(node[1]) + node[0] > 1 else "")
            open_[-1][1].append((last[len(open_) - 1], at))

    def common(self, a: int, b: int) -> Iterator[str]:
        """What both states accept."""
        path: list[str] = []
        todo = [(0, "", a, b)]
        while todo:
            depth, letter, a, b = todo.pop()
            del path[depth:]
            path.append(letter)
            (end_a, ways_a), (end_b, ways_b) = self.states[a], self.states[b]
            if end_a and end_b:
                yield "".join(path)
            todo.extend((depth + 1, c, to, ways_b[c]) for c, to in ways_a.items() if c in ways_b)

    def edits(self, at: int) -> list[tuple[str, str]]:
        """The ends of the runs whose edit happens in a state: a replaced letter (once, the smaller letter left), or a letter that
        only the right side has."""
        final, ways = self.states[at]
        out = []
        for c, a in ways.items():
            end_a, ways_a = self.states[a]
            if final and end_a:
                out.append(("", c))
            for d, b in ways.items():
                if c < d:
                    out.extend((c + rest, d + rest) for rest in self.common(a, b))
                if c != d and d in ways_a:
                    out.extend((d + rest, c + d + rest) for rest in self.common(b, ways_a[d]))
        return out


def pairs_of(words: list[str], places: int, length: int) -> Iterator[tuple[str, str]]:
    """Pairs of sorted distinct words with one edit among the first ``places`` letters, the left one of ``length``."""
    machine = Acceptor(words)
    for at, prefixes in machine.forks.items():
        prefixes = [p for p in prefixes if len(p) < places]
        if not prefixes:
            continue
        for left, right in machine.edits(at):
            for p in prefixes:
                if len(p) + len(left) == length:
                    yield p + left, p + right


def _enumerate(batches):
    for pdf in batches:
        rows = []
        for n, low, high, start, end, found in pdf[["_n", "_low", "_high", "_start", "_end", "_words"]].itertuples(index=False):
            counts = {w["_middle"]: w["n"] for w in found}
            for a, b in pairs_of(sorted(counts), high - low, n - len(start) - len(end)):
                rows.append((start + a + end, counts[a], start + b + end, counts[b]))
        yield pd.DataFrame(rows, columns=["word", "n", "near", "near_n"])


def _keyed(words: DataFrame, ranges: Column) -> DataFrame:
    """A row for each word and range (n, low, high) of places of the edit: what precedes and follows is the key, the rest stays."""
    at = words.select("word", "n", F.explode(ranges).alias("_r")).select("word", "n", "_r.*")
    size, after = F.length("word"), F.greatest(F.lit(0), F.col("_n") - F.col("_high"))
    return at.select(
        "_n", "_low", "_high", F.substring("word", F.lit(1), F.col("_low")).alias("_start"),
        F.substring("word", size - after + 1, after).alias("_end"),
        F.struct(F.substring("word", F.col("_low") + 1, size - after - F.col("_low")).alias("_middle"), "n").alias("_w"))


KEY = ["_n", "_low", "_high", "_start", "_end"]


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """word, n, near, near_n: each pair of ``words(word, n)`` one edit apart, once; ``word`` is the shorter one."""
    place = lambda n, low, high: F.struct(n.alias("_n"), low.alias("_low"), high.alias("_high"))
    size = F.length("word")
    halves = lambda n: F.array(place(n, F.lit(0), F.floor(n / 2).cast("int")), place(n, F.floor(n / 2).cast("int"), n + 1))
    keyed = _keyed(words, F.concat(halves(size), halves(size - 1)))
    sizes, seen = measured(keyed.groupBy(KEY).agg(F.count("*").alias("_size")).where("_size > 1"), "partitions", crowded=F.count_if(F.col("_size") > crowd))
    if seen["crowded"]:
        crowded = sizes.where(F.col("_size") > crowd).select(*[F.col(k).alias(f"_c{k}") for k in KEY])
        same = lambda: [F.col(k) == F.col(f"_c{k}") for k in KEY]
        keys = maybe_broadcast(crowded, seen["crowded"])
        held = keyed.join(keys, same(), "left_semi")
        rest = keyed.join(keys, same(), "left_anti")
        whole = held.select("_n", "_low", "_high", F.concat("_start", "_w._middle", "_end").alias("word"), "_w.n")
        places = F.transform(F.sequence("_low", F.col("_high") - 1), lambda i: place(F.col("_n"), i, i + 1))
        keyed = rest.unionByName(_keyed(whole.withColumn("_places", places), F.col("_places")))
    found = keyed.groupBy(KEY).agg(F.collect_list("_w").alias("_words")).where(F.size("_words") > 1)
    return found.mapInPandas(_enumerate, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of ``forms(word, form)``: forms followed to the last, by pointer doubling."""
    links, seen = measured(forms.select("word", F.col("form").alias("root")), "forms")
    left = seen["rows"]
    while left:
        ahead = links.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        further = links.join(maybe_broadcast(ahead, seen["rows"]), F.col("root") == F.col("_at"), "left")
        links, found = measured(further.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots", moved=F.count_if("_moved"))
        links, left = links.drop("_moved"), found["moved"]
    return links


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
             noise: int = NOISE, times: int = TIMES, crowd: int = CROWD) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of the vocabulary."""
    words = durable(vocabulary(docs, id_col, text_col, min_length, min_count, noise), "vocabulary")
    pairs = durable(near_pairs(words, crowd), "near-words")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    strong = -F.col("best.minus") >= F.col("n") * times
    known = durable(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"),
        F.when(strong, -F.col("best.minus")).alias("form_n")), "forms")
    ends = roots(known.where("form is not null").select("word", "form"))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
