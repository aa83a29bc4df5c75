"""Best-fit sequence packing by patterns fitted with non-negative least squares.

Only the histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus) is planned on the driver:

1. Lengths are rounded up to ``BINS`` bins; patterns of at most three bins that nearly fill a sequence are enumerated.
2. Non-negative least squares fits how often each pattern repeats, so that together they use up the histogram; counts are
   rounded down and never exceed what is there.
3. Slots take exact lengths, longest first. As bins are rounded up, the larger slots leave some room: the smallest slot takes
   the longest length there is from its bin upwards that still fits. All slots of a fitted pattern stay together.
4. What is left over is packed best-fit decreasing into the remaining room of the fitted sequences and then into new ones, in
   runs of equal sequences instead of single documents.

The result is a list of runs (lengths, repeats). A piece finds its place from its rank among the pieces of its length;
ranks come from salted counts, so a length that a third of the pieces share is spread over tasks.
"""
from __future__ import annotations

import itertools
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable
from .wordtok import encoder

CAPACITY, BINS = 4096, 128


def patterns(bins: int, waste: int = 1) -> np.ndarray:
    """All multisets of one to three bin sizes (1..bins) whose sum is within ``waste`` of ``bins``; one row for each pattern."""
    found = []
    for total in range(bins - waste, bins + 1):
        found.append((total, 0, 0))
        found += [(a, total - a, 0) for a in range((total + 1) // 2, total)]
        found += [(a, b, total - a - b) for a in range(1, total) for b in range(1, a + 1) if 1 <= total - a - b <= b]
    return np.array(found)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """min ||ax - b||, x >= 0, by an active set of columns; each round adds the column that helps most."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    dot = lambda u, v: np.einsum("ij,ik->jk" if v.ndim == 2 else "ij,i->j", u, v)  # noqa: E731  small; threads of a BLAS would only wait
    tol = 1e-9 * max(1.0, float(np.abs(dot(a, b)).max(initial=0)))
    for _ in range(rounds):
        used = a[:, active]
        gain = dot(a, b - dot(used.T, x[active]))
        gain[active] = -np.inf
        if not len(gain) or gain.max() <= tol:
            break
        active[int(gain.argmax())] = True
        while True:
            cols = np.flatnonzero(active)
            part = a[:, cols]
            fit = np.linalg.solve(dot(part, part) + 1e-9 * np.eye(len(cols)), dot(part, b))
            if (fit > 0).all():
                x[:] = 0
                x[cols] = fit
                break
            low = fit <= 0
            step = float(np.min(x[cols[low]] / np.maximum(x[cols[low]] - fit[low], 1e-300)))
            x[cols] += step * (fit - x[cols])
            drop = cols[low & (x[cols] <= 1e-9 * max(1.0, x.max()))]
            drop = drop if len(drop) else cols[low][:1]
            active[drop] = False
            x[drop] = 0
    return x


class Stock:
    """Lengths that are still to be packed."""

    def __init__(self, hist: dict[int, int]):
        self.left, self.lengths = dict(hist), sorted(hist)

    def between(self, low: int, high: int) -> int:
        return sum(self.left[x] for x in self.lengths[bisect_left(self.lengths, low) : bisect_right(self.lengths, high)])

    def draw(self, low: int, high: int, count: int) -> tuple[list[tuple[int, int]], int]:
        """Up to ``count`` of the lengths from low to high, longest first, as (length, how many), and how many were missing."""
        out = []
        for at in range(bisect_right(self.lengths, high) - 1, bisect_left(self.lengths, low) - 1, -1):
            if not count:
                break
            k = min(self.left[self.lengths[at]], count)
            if k:
                out.append((self.lengths[at], k))
                self.left[self.lengths[at]] -= k
                count -= k
        return out, count


def fitted(hist: dict[int, int], capacity: int, bins: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Runs from the fitted patterns, and the lengths that they leave."""
    width = -(-capacity // bins)
    bins = capacity // width
    have = np.zeros(bins + 2, int)
    for length, n in hist.items():
        have[min(-(-length // width), bins + 1)] += n
    shapes = patterns(bins)
    a = np.zeros((bins, len(shapes)))
    for k in range(3):
        np.add.at(a, (shapes[:, k] - 1, np.arange(len(shapes))), shapes[:, k] > 0)
    x = nnls(a, have[1 : bins + 1].astype(float))
    stock, runs = Stock(hist), []
    for p in np.argsort(-x, kind="stable"):
        *larger, small = parts = sorted((int(q) for q in shapes[p] if q), reverse=True)
        in_bin = {q: stock.between((q - 1) * width + 1, q * width) // parts.count(q) for q in parts}
        times = min(int(x[p] + 0.5), *in_bin.values())
        if times <= 0:
            continue
        slots = [stock.draw((q - 1) * width + 1, q * width, times)[0] for q in larger]
        for lengths, n in _zip_runs(slots) if slots else [((), times)]:
            last, missing = stock.draw((small - 1) * width + 1, capacity - sum(lengths), n)
            runs += [((*lengths, ln), k) for ln, k in last]
            if missing and lengths:
                runs.append((lengths, missing))
    return runs, {ln: n for ln, n in stock.left.items() if n}


def _zip_runs(slots: list[list[tuple[int, int]]]) -> list[tuple[tuple[int, ...], int]]:
    """Slots' (length, count) lists of one total -> runs of equal sequences."""
    ends = sorted(set(itertools.chain.from_iterable(itertools.accumulate(n for _, n in s) for s in slots)))
    cuts = [(np.cumsum([n for _, n in s]), [ln for ln, _ in s]) for s in slots]
    out, at = [], 0
    for end in ends:
        out.append((tuple(ls[int(np.searchsorted(c, at, side="right"))] for c, ls in cuts), int(end - at)))
        at = end
    return out


def best_fit(runs: list[tuple[tuple[int, ...], int]], left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of the left lengths into the room of the runs, then into new sequences."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    count = np.zeros(capacity + 1, bool)
    for lengths, n in runs:
        s = capacity - sum(lengths)
        room.setdefault(s, []).append((lengths, n))
        count[s] = True

    def put(lengths, n):
        s = capacity - sum(lengths)
        room.setdefault(s, []).append((lengths, n))
        count[s] = True

    for ln in sorted(left, reverse=True):
        n = left[ln]
        while n:
            s = ln + int(count[ln:].argmax())
            if not count[s]:
                s, k = capacity, 1 << 62
                lengths = ()
            else:
                lengths, k = room[s].pop()
                if not room[s]:
                    count[s] = False
            times = min(s // ln, n)
            use = min(k, n // times)
            put(lengths + (ln,) * times, use)
            n -= use * times
            if k - use and k < 1 << 62:
                put(lengths, k - use)
    return [r for part in room.values() for r in part]


def plan(hist: dict[int, int], capacity: int = CAPACITY, bins: int = BINS) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths, repeats) that hold every length of the histogram as often as it occurs."""
    if not hist:
        return []
    return best_fit(*fitted(hist, capacity, min(bins, capacity)), capacity)


def places(runs: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """{length: (first rank, first sequence, offset) of each stretch of ranks}."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for lengths, n in runs:
        at = 0
        for ln in lengths:
            r = ranks.get(ln, 0)
            found.setdefault(ln, []).append((r, base, at))
            ranks[ln] = r + n
            at += ln
        base += n
    return {ln: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for ln, v in found.items()}


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces: id, piece, start, length, ids_crc32. Every text gets ``end_id``; only those over ``capacity`` are cut."""
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches):
        encode, end = encoder(tokenizer_path), np.uint32(end_id).tobytes()
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["_id"], pdf["_text"], strict=True):
                ids = encode(text) + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    rows.append((i, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32"])
            if pdf["_id"].isna().any():
                out["_id"] = out["_id"].astype("Int64")
            yield out

    return source.mapInPandas(run, f"_id {id_type}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("_id", id_col)


#: Pieces of one length that one task ranks at most, about.
RANKED = 100_000


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", length_col: str = "length") -> DataFrame:
    """``pieces`` (durable, lengths from 1 to capacity) with sequence_id and offset: each sequence is filled from offset 0
    without gaps and never over capacity. An empty table gives an empty table."""
    hist = {int(r[0]): int(r[1]) for r in pieces.groupBy(length_col).agg(F.count("*")).collect()}  # at most capacity rows
    table = places(plan(hist, capacity))
    shared = pieces.sparkSession.sparkContext.broadcast(table)  # bounded by the histogram's runs
    salts = max(1, -(-max(hist.values(), default=1) // RANKED))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)).cast("int"))
    sums = salted.groupBy(length_col, "_salt").agg(F.count("*").alias("_n"))
    before = sums.select(
        F.col(length_col).alias("_l"), F.col("_salt").alias("_s"),
        (F.sum("_n").over(Window.partitionBy(length_col).orderBy("_salt")) - F.col("_n")).alias("_base"))
    in_salt = Window.partitionBy(length_col, "_salt").orderBy(id_col, "piece")
    ranked = salted.withColumn("_r", F.row_number().over(in_salt) - 1)
    ranked = ranked.join(before, (F.col(length_col) == F.col("_l")) & (F.col("_salt") == F.col("_s")))
    ranked = ranked.withColumn("_r", F.col("_r") + F.col("_base")).drop("_salt", "_l", "_s", "_base")
    kind = "sequence_id long, offset long"

    @F.pandas_udf(kind)
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        ln, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(ln), np.int64), np.zeros(len(ln), np.int64)
        for one in np.unique(ln):
            at = np.flatnonzero(ln == one)
            first, base, offset = shared.value[int(one)]
            k = np.searchsorted(first, r[at], side="right") - 1
            seq[at], off[at] = base[k] + r[at] - first[k], offset[k]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("_p", place(F.col(length_col), F.col("_r"))).select(
        *pieces.columns, F.col("_p.sequence_id").alias("sequence_id"), F.col("_p.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: id, piece, start, length, ids_crc32, sequence_id, offset. Null texts are empty, so they are
    one piece that holds the end id; repeated rows are packed as often as they occur, ties in length are placed by id; an empty
    table gives an empty table. A long text is cut into pieces of ``capacity``. Extra columns are ignored, whatever their names."""
    return pack(durable(pieces_of(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces"), capacity, id_col)
