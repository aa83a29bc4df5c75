"""Removal of passages that repeat across documents, by suffix arrays over the places where documents part.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. On whole texts, and
exact but for one thing: segments are equal if the 64-bit hash of their anchor, the 64-bit hash of all their bytes, their
length and the anchor's place are; bytes are not compared again where both hashes meet.

1. Anchors. Of the 24-byte grams of every window of ``length`` bytes the one of the smallest hash is the window's anchor, so
   equal windows have equal anchors at equal places. Windows in a row with one anchor form a segment.
2. Anchor exchange. Senders (parts of input partitions) send their distinct anchor hashes, Golomb coded, to owners, and learn
   by bitmap which also occur elsewhere. Only shared anchors go on (about a fifth of them), so most text never moves as rows.
3. Equal segments are combined to their smallest document before and after the shuffle; any later document loses all windows
   of the segment. Where an anchor has one segment only, that is all.
4. Where texts part, an anchor has several segments. Those of an anchor are laid side by side at the anchor; stretches on
   which all agree shrink to one symbol; a suffix array (linear grouping, ``suffix_array``) over a task's segments brings
   equal windows together, and each window learns the smallest document of its stretch of the array.
   An anchor with over ``wide`` segments is spread by window instead: its windows are aggregated by content.
5. Per document the removed windows are united and cut out.

Documents with the text of a smaller id are settled by their hash before all this. The input must be a table (or durable): the
senders of the two scans have to hold the same rows; a checksum of ids guards that.

Null texts are empty. Rows with a null id lose nothing and remove nothing. Rows that repeat an id do not remove each other's text.
An empty table gives an empty table; extra columns pass if named in ``extra``, whatever their names; a long text is one row of
its task, and memory there is proportional to it.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, give_back, lean, maybe_broadcast, measured, partitions, passing
from .exact_dedup import _answer, golomb_encode
from .suffix_array import suffix_array

LENGTH, GRAM, WIDE, SPLIT = 50, 24, 2000, 4
#: Bytes of text for each owner of anchor hashes: about 16 bytes have an anchor, so an owner holds some 4 million hashes.
OWNED = 1 << 26
_P = 0x9E3779B97F4A7C15
P = np.uint64(_P)
BYTE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def squeezed(col: str):
    """Texts as compressed UTF-8: what shuffles is half as large."""
    @F.pandas_udf("binary")
    def squeeze(texts: pd.Series) -> pd.Series:
        pack = zstd.ZstdCompressor(level=1)
        return pd.Series([pack.compress(t.encode("utf-8", "replace")) for t in texts], dtype=object)

    return squeeze(col)


class Powers:
    """Powers of the multiplier and of its inverse, for hashes of any stretch of a text."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            inverse = pow(_P, -1, 1 << 64)
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(n, _P, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([one, np.full(n, inverse, np.uint64)]), dtype=np.uint64)
        return self.up, self.down


def slide(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    n = 1
    while 2 * n <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return np.minimum(values[: len(values) - (width - n)], values[width - n :]) if n < width else values


def anchors(data: np.ndarray, length: int, powers: Powers, gram: int = GRAM, only_keys: bool = False):
    """Of one text: anchor hash, segment hash, first window, windows, place of the anchor behind the first window; or the anchor
    hashes alone."""
    n = len(data)
    if n < length:
        none = np.zeros(0, np.uint64)
        return none if only_keys else (none, none, *(np.zeros(0, np.int64),) * 3)
    v = BYTE[data]
    up, down = powers.upto(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * up[:n], dtype=np.uint64)])
    g = (total[gram:] - total[: n + 1 - gram]) * down[: n + 1 - gram]
    g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    half = np.uint64(32)  # 32 bits of the hash, then the place: of equal hashes the leftmost, in every text alike
    keyed = (g >> half << half) | np.arange(len(g), dtype=np.uint64)
    at = (slide(keyed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    if only_keys:
        return g[at[first]]
    windows = np.diff(np.append(first, len(at)))
    h = (total[first + windows - 1 + length] - total[first]) * down[first]
    h = (h ^ (h >> np.uint64(31)) ^ (windows.astype(np.uint64) << np.uint64(7)) ^ (at[first] - first).astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
    return g[at[first]], h ^ (h >> np.uint64(29)), first, windows, at[first] - first


# --- exchange of anchors ---------------------------------------------------------------------------------------------

def _bounds(owners: int) -> np.ndarray:
    width = (1 << 64) // owners + 1
    return np.array([min(i * width, (1 << 64) - 1) for i in range(1, owners)], np.uint64)


def _sent(length: int, owners: int, bits: int):
    """``bits`` of each anchor hash are sent: enough for the text at hand; a chance hit only sends a segment on in vain."""
    width = (1 << 64) // owners + 1
    low = np.uint64(64 - bits)

    def run(batches):
        powers, kept, guard = Powers(), {}, {}
        for pdf in batches:
            for sender, i, text in zip(pdf["_sender"], pdf["_id"], pdf["_text"], strict=True):
                raw = text.encode("utf-8", "replace")
                kept.setdefault(sender, []).append(np.unique(anchors(np.frombuffer(raw, np.uint8), length, powers, only_keys=True)))
                guard[sender] = (guard.get(sender, 0) + (int(i) * _P + len(raw))) % (1 << 63)
        rows = []
        for sender, parts in kept.items():
            own = np.unique(np.concatenate(parts) >> low << low)
            rows.append((sender, -1, np.uint64(guard[sender]).tobytes()))
            for owner, part in enumerate(np.split(own, np.searchsorted(own, _bounds(owners)))):
                if len(part):
                    rows.append((sender, owner, golomb_encode((part >> low) - np.uint64((owner * width) >> int(low)), max(1, bits + 1 - owners.bit_length()))))
        yield pd.DataFrame(rows, columns=["_sender", "_owner", "_blob"])

    return lean(run)


def _shared_segments(length: int, owners: int, bits: int):
    """Cogrouped by sender: its documents and its bitmaps -> segments at shared anchors."""
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = ["_id", "_h", "_key", "_seg", "_place"]
        low = np.uint64(64 - bits)
        if docs.empty:
            return pd.DataFrame(columns=names)
        powers, per, guard, unpack = Powers(), [], 0, zstd.ZstdDecompressor()
        texts = [unpack.decompress(z) for z in docs["_z"]]
        for i, raw in zip(docs["_id"], texts, strict=True):
            per.append(anchors(np.frombuffer(raw, np.uint8), length, powers))
            guard = (guard + int(i) * _P + len(raw)) % (1 << 63)
        known = answers.loc[answers["_owner"] == -1, "_bitmap"]
        if [np.uint64(guard).tobytes()] != [bytes(b) for b in known]:
            raise RuntimeError("the two scans saw different rows; pass a table, or durable(docs)")
        own, counts = np.unique(np.concatenate([np.unique(a[0] >> low << low) for a in per]), return_counts=True)
        shared = counts > 1
        owner_of = np.searchsorted(_bounds(owners), own, side="right")
        for owner, bitmap in zip(answers["_owner"], answers["_bitmap"], strict=True):
            if owner >= 0:
                at = np.flatnonzero(owner_of == owner)
                shared[at] |= np.unpackbits(np.frombuffer(bitmap, np.uint8))[: len(at)].astype(bool)
        own = own[shared]
        out = []
        for i, h, (key, seg, first, windows, rel) in zip(docs["_id"], docs["_h"], per, strict=True):
            if len(own) and len(key):
                at = np.searchsorted(own, key >> low << low)
                at[at == len(own)] = 0
                hit = np.flatnonzero(own[at] == key >> low << low)
                if len(hit):
                    place = (first[hit] << 16) | (windows[hit] << 8) | rel[hit]
                    out.append(pd.DataFrame({"_id": i, "_h": h, "_key": key[hit].view(np.int64), "_seg": seg[hit].view(np.int64), "_place": place}))
        found = pd.concat(out) if out else pd.DataFrame(columns=names)
        del out
        give_back()
        return found

    return run


# --- contested anchors -----------------------------------------------------------------------------------------------

def contested_masks(bucket: np.ndarray, low: np.ndarray, rel: np.ndarray, windows: np.ndarray, raw: list[bytes], length: int) -> np.ndarray:
    """For each segment (rows sorted by bucket): bits of its windows that a document smaller than its own also has."""
    n, before = len(bucket), int(rel.max())
    width = before + max(len(b) - r for b, r in zip(raw, rel, strict=True))
    cells = np.full((n, width), -1, np.int16)
    for i, b in enumerate(raw):
        cells[i, before - rel[i] : before - rel[i] + len(b)] = np.frombuffer(b, np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    number = np.cumsum(np.concatenate([[0], (bucket[1:] != bucket[:-1]).astype(np.int64)]))
    # Cells of a column with one value form a class, named by its first row; a class of one can't be part of a repeat, and
    # neither can a stretch shorter than a window. Columns split alike by their neighbour before make one symbol with it.
    there = cells >= 0
    code = ((number[:, None] * width + np.arange(width)[None, :]) * 257 + cells)[there]
    _, first, inverse, counts = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    label, live = np.full((n, width), -1, np.int64), np.zeros((n, width + 2), bool)
    label[there] = np.nonzero(there)[0][first][inverse]
    live[:, 1:-1][there] = counts[inverse] > 1
    turns = np.flatnonzero(np.diff(live.ravel().astype(np.int8)))
    opened, closed = turns[0::2] + 1, turns[1::2] + 1
    for a, b in zip(opened[closed - opened < length], closed[closed - opened < length], strict=True):
        live.ravel()[a:b] = False
    ends = np.zeros(n * (width + 2), np.int64)
    long_ = closed - opened >= length
    ends[opened[long_]] = closed[long_]
    ends = np.maximum.accumulate(ends).reshape(n, width + 2)[:, 1:-1] - (np.arange(n) * (width + 2))[:, None] - 1  # column where a live stretch ends
    live = live[:, 1:-1]
    alike = np.zeros((len(starts), width), bool)
    alike[:, 1:] = np.minimum.reduceat((label[:, 1:] == label[:, :-1]).astype(np.int8), starts).astype(bool)
    begins = live.copy()
    begins[:, 1:] &= ~(alike[number][:, 1:] & live[:, :-1])
    opens = live.copy()
    opens[:, 1:] &= ~live[:, :-1]
    row, col = np.nonzero(begins)
    if not len(row):
        return np.zeros(n, np.int64)
    run = np.cumsum(opens[row, col]) - 1
    last = np.append(run[1:] != run[:-1], True)
    weight = np.where(last, ends[row, col], np.append(col[1:], 0)) - col
    _, symbol = np.unique((number[row] * width + col) * (n + 1) + label[row, col], return_inverse=True)
    # one text: the symbols of each stretch, then a separator (0)
    at = np.arange(len(row)) + run
    size = len(row) + int(run[-1]) + 1
    text, weights = np.zeros(size, np.int64), np.zeros(size, np.int64)
    text[at], weights[at] = symbol + 1, weight
    order = np.array(suffix_array(text.tolist()), np.int64)
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    # columns shared with the neighbour before in the array
    common, near = np.zeros(size, np.int64), np.arange(1, size)
    a, b = order[:-1].copy(), order[1:].copy()
    while len(near):
        same = (a < size) & (b < size)
        same[same] = (text[a[same]] == text[b[same]]) & (text[a[same]] > 0)
        near, a, b = near[same], a[same], b[same]
        common[near] += weights[a]
        a, b = a + 1, b + 1
    owner = np.full(size, -1, np.int64)
    owner[at] = row
    low_at = np.where(owner[order] >= 0, low[np.maximum(owner[order], 0)], np.iinfo(np.int64).max)
    # every window: its symbol, and how far behind the symbol's start it lies
    wrow = np.repeat(np.arange(n), windows)
    wno = np.arange(len(wrow)) - np.repeat(np.cumsum(windows) - windows, windows)
    wcol = before - rel[wrow] + wno
    fits = live[wrow, wcol] & (wcol + length <= ends[wrow, wcol])
    wrow, wno, wcol = wrow[fits], wno[fits], wcol[fits]
    symbol_of = np.cumsum(begins.ravel()).reshape(n, width)[wrow, wcol] - 1
    behind, place = wcol - col[symbol_of], rank[at[symbol_of]]
    mask = np.zeros(n, np.int64)
    for t in np.unique(behind):
        sel = behind == t
        classes = np.flatnonzero(common < t + length)
        least = np.minimum.reduceat(low_at, classes)
        found = least[np.searchsorted(classes, place[sel], side="right") - 1] < low[wrow[sel]]
        np.bitwise_or.at(mask, wrow[sel][found], np.int64(1) << wno[sel][found])
    return mask


def _solve(length: int, rows: int = 4000):
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["_key"].to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.repeat(np.diff(np.append(edge, len(key))) > 1, np.diff(np.append(edge, len(key))))
        mask = np.zeros(len(pdf), np.int64)
        hard = pdf[many]
        if len(hard):
            mask[many] = contested_masks(
                hard["_key"].to_numpy(), hard["_low"].to_numpy(), hard["_rel"].to_numpy(), hard["_windows"].to_numpy(), list(hard["_bytes"]), length)
        out = pdf[["_key", "_seg", "_low", "_high"]].copy()
        out["_mask"] = mask
        return out[(mask != 0) | (out["_high"] > out["_low"])]

    def run(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held) >= rows:  # whole anchors only; the last one may go on
                key = held["_key"].to_numpy()
                cut = int(np.searchsorted(key, key[min(len(key), rows + WIDE) - 1], side="left"))
                if not cut:
                    break
                yield settle(held.iloc[:cut].reset_index(drop=True))
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield settle(held)

    return lean(run)


def _wide_masks(segments: DataFrame, length: int) -> DataFrame:
    """Masks of the segments of anchors that have very many: every window is grouped by its bytes."""
    w = segments.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_windows") - 1)))
    w = w.withColumn("_w", F.substring("_bytes", F.col("_o") + 1, F.lit(length)))
    least = w.groupBy("_w").agg(F.min("_low").alias("_least"), F.max("_low").alias("_most")).where("_least < _most").select("_w", "_least")
    hits = w.join(least.hint("merge"), "_w").where("_least < _low")  # sized as before the explode, either side might be broadcast
    bits = hits.groupBy("_key", "_seg").agg(F.bit_or(F.expr("shiftleft(1L, _o)")).alias("_mask"))
    return segments.join(bits, ["_key", "_seg"], "left").select("_key", "_seg", "_low", "_high", F.coalesce("_mask", F.lit(0).cast("long")).alias("_mask")).where(
        "_mask <> 0 or _high > _low")


# --- whole operator --------------------------------------------------------------------------------------------------

def _with_bytes(rows: DataFrame, texts: DataFrame, length: int, repeats: bool) -> DataFrame:
    """rows(_key, _seg, _low, _high, _place, _c) with _rel, _windows and _bytes, from the texts of the documents _low."""
    wanted, seen = measured(rows.groupBy("_low").agg(F.collect_list(F.struct("_key", "_seg", "_high", "_place", "_c")).alias("_rows")), "places")
    joined = texts.join(maybe_broadcast(wanted.select("_low"), seen["rows"]), F.col("_id") == F.col("_low"), "left_semi").select("_id", squeezed("_text").alias("_z"))
    joined = joined.join(wanted, F.col("_id") == F.col("_low"))

    def run(batches):
        unpack, powers = zstd.ZstdDecompressor(), Powers()
        for pdf in batches:
            out = []
            for low, z, rows in zip(pdf["_low"], pdf["_z"], pdf["_rows"], strict=True):
                raw = unpack.decompress(z)
                key, seg, first, windows, rel = anchors(np.frombuffer(raw, np.uint8), length, powers)
                here = {(k, s, f) for k, s, f in zip(key.view(np.int64).tolist(), seg.view(np.int64).tolist(), first.tolist(), strict=True)}
                for r in rows:
                    first, n = r["_place"] >> 16, (r["_place"] >> 8) & 255
                    if (r["_key"], r["_seg"], first) in here:  # another text under the same id has other segments
                        out.append((r["_key"], r["_seg"], low, r["_high"], r["_place"] & 255, n, raw[first : first + n + length - 1], r["_c"]))
            yield pd.DataFrame(out, columns=["_key", "_seg", "_low", "_high", "_rel", "_windows", "_bytes", "_c"])

    out = joined.mapInPandas(lean(run), "_key long, _seg long, _low long, _high long, _rel int, _windows int, _bytes binary, _c long")
    return out.dropDuplicates(["_key", "_seg"]) if repeats else out


def _with_removals(docs: DataFrame, id_col: str, text_col: str, length: int, extra: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """base(_id, _text, _h, extras), copies(_cid, _ch) that lose everything, cuts(_did, _dh, _w: array of (_first, _mask)) and
    how many documents have cuts. Each step's tables go once the next one's are written."""
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(extra)])
    # Where an id repeats, rows are told apart by a hash of the text too.
    repeats = base.where("_id is not null").groupBy("_id").agg(F.count("*").alias("_c")).where("_c > 1").limit(1).count() > 0
    base = base.withColumn("_h", F.xxhash64("_text") if repeats else F.lit(0).cast("long"))
    with passing(spark, "copies", "cuts"):
        copies, n_copies, total = _copies(base, length)
        segments, live = _segments_found(base, copies, n_copies, total, length)
        settled = _settled(segments, live, length, repeats)
        all_ = F.expr("shiftleft(1L, _windows) - 1")
        cuts = (
            segments.select("_id", "_h", "_key", "_seg", (F.shiftright("_place", 16)).cast("int").alias("_first"), F.expr("cast(shiftright(_place, 8) & 255 as int)").alias("_windows"))
            .join(settled.drop("_high"), ["_key", "_seg"])
            .withColumn("_mask", F.when(F.col("_id") > F.col("_low"), all_).otherwise(F.col("_mask"))).where("_mask <> 0")
            .groupBy(F.col("_id").alias("_did"), F.col("_h").alias("_dh")).agg(F.collect_list(F.struct("_first", "_mask")).alias("_w"))
        )
        cuts, seen = measured(cuts, "cuts")
    return base, maybe_broadcast(copies, n_copies), cuts, seen["rows"]


def _copies(base: DataFrame, length: int) -> tuple[DataFrame, int, int]:
    """copies(_cid, _ch) of a smaller document's text, their number, and the bytes of all texts: one scan of the texts for their
    hashes and sizes."""
    octets = F.octet_length("_text").cast("long")
    hashed = base.where("_id is not null").select("_id", "_h", F.unhex(F.sha2("_text", 256)).alias("_sha"), octets.alias("_n")).where(f"_n >= {length}")
    with passing(base.sparkSession, "copies"):
        hashed, size = measured(hashed, "text-hashes", bytes=F.sum("_n"))
        least = hashed.groupBy("_sha").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high")).where("_low < _high")
        least, seen = measured(least, "copied-texts")
        hot = maybe_broadcast(least, seen["rows"])
        copies, seen = measured(hashed.join(hot, "_sha").where("_id > _low").select(F.col("_id").alias("_cid"), F.col("_h").alias("_ch")).distinct(), "copies")
    return copies, seen["rows"], size["bytes"] or 1


def _segments_found(base: DataFrame, copies: DataFrame, n_copies: int, total: int, length: int) -> tuple[DataFrame, DataFrame]:
    """segments(_id, _h, _key, _seg, _place) at the anchors that occur more than once, and the texts that were looked at."""
    sender = F.spark_partition_id() * SPLIT + F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(SPLIT)).cast("int")
    live = base.where("_id is not null").withColumn("_sender", sender).where(F.octet_length("_text") >= length)
    is_copy = (F.col("_id") == F.col("_cid")) & (F.col("_h") == F.col("_ch"))
    few = n_copies <= BROADCAST_ROWS
    if few:  # copies leave before the exchange; a join that shuffles would tear the senders apart, so else they leave behind it
        live = live.join(F.broadcast(copies), is_copy, "left_anti")
    owners = max(2, 2 * partitions(base.sparkSession), -(-total // OWNED))
    bits = min(64, int(total).bit_length() + 12)
    with passing(base.sparkSession, "segments"):
        sent = durable(live.select("_sender", "_id", "_text").mapInPandas(_sent(length, owners, bits), "_sender int, _owner int, _blob binary"), "anchors")
        answers = sent.where("_owner >= 0").groupBy("_owner").applyInPandas(_answer, "_sender int, _owner int, _bitmap binary")
        answers = answers.unionByName(sent.where("_owner < 0").withColumnRenamed("_blob", "_bitmap"))
        moved = live.select("_sender", "_id", "_h", squeezed("_text").alias("_z"))
        found = moved.groupBy("_sender").cogroup(answers.groupBy("_sender")).applyInPandas(
            _shared_segments(length, owners, bits), "_id long, _h long, _key long, _seg long, _place long")
        segments = durable(found if few else found.join(copies, is_copy, "left_anti"), "segments")
    return segments, live


def _settled(segments: DataFrame, live: DataFrame, length: int, repeats: bool) -> DataFrame:
    """settled(_key, _seg, _low, _high, _mask): of the distinct segments those of which a document loses something."""
    spark = segments.sparkSession
    with passing(spark, "settled"):
        unique = durable(segments.groupBy("_key", "_seg").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high"), F.min_by("_place", "_id").alias("_place")), "unique-segments")
        several, seen = measured(unique.groupBy("_key").agg(F.count("*").alias("_c")).where("_c > 1"), "contested-anchors")
        # One segment: nothing to compare. Several: their bytes are cut from the text of their smallest document.
        plain = unique.join(maybe_broadcast(several.select("_key"), seen["rows"]), "_key", "left_anti").where("_high > _low").select("_key", "_seg", "_low", "_high", F.lit(0).cast("long").alias("_mask"))
        with passing(spark, "contested"):
            contested, seen = measured(_with_bytes(unique.join(maybe_broadcast(several, seen["rows"]), "_key"), live.select("_id", "_text"), length, repeats), "contested", widest=F.max("_c"))
        narrow = contested.where(f"_c <= {WIDE}").drop("_c")
        settled = narrow.repartition(partitions(spark), "_key").sortWithinPartitions("_key").mapInPandas(
            _solve(length), "_key long, _seg long, _low long, _high long, _mask long").unionByName(plain)
        if (seen["widest"] or 0) > WIDE:
            settled = settled.unionByName(_wide_masks(contested.where(f"_c > {WIDE}").drop("_c"), length))
        return durable(settled, "settled")


def covered(size: int, firsts, masks, length: int) -> np.ndarray:
    """Which bytes the removed windows cover."""
    firsts, masks = np.asarray(firsts, np.int64), np.asarray(masks, np.int64)
    delta = np.zeros(size + 1, np.int64)
    for o in range(64):
        at = firsts[(masks >> o) & 1 == 1] + o
        if len(at):
            np.add.at(delta, at, 1)
            np.add.at(delta, at + length, -1)
    return np.cumsum(delta[:-1]) > 0


def cut_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False,
                extra: list[str] | None = None) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, the columns named in ``extra``, and if asked for kept: the remaining
    bytes as text, without those of a character that was cut through."""
    extra = extra or []
    base, gone, cuts, n_cuts = _with_removals(docs, id_col, text_col, length, extra)
    keys = maybe_broadcast(cuts.select("_did", "_dh").withColumn("_cut", F.lit(True)), n_cuts)
    marked = base.join(gone.withColumn("_copy", F.lit(True)), (F.col("_id") == F.col("_cid")) & (F.col("_h") == F.col("_ch")), "left")
    marked = marked.join(keys, (F.col("_id") == F.col("_did")) & (F.col("_h") == F.col("_dh")), "left")

    def cut(batches):
        unpack = zstd.ZstdDecompressor()
        for part in (batch.slice(i, 200) for batch in batches for i in range(0, batch.num_rows, 200)):
            n_removed, n_spans, sums, texts = [], [], [], []
            for z, f, m in zip(*(part.column(c) for c in ("_z", "_f", "_m")), strict=True):
                data = np.frombuffer(unpack.decompress(z.as_py()), np.uint8)
                hit = covered(len(data), f.values.to_numpy(), m.values.to_numpy(), length)
                kept = data[~hit].tobytes()
                n_removed.append(int(hit.sum()))
                n_spans.append(int((hit[1:] & ~hit[:-1]).sum() + hit[0]))
                sums.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "ignore") if keep_text else None)
            made = [pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *made], names=[*rest, "n_removed", "n_spans", "kept_sha256", "kept"])

    rest = ["_id", "_n", *[f"_x{i}" for i in range(len(extra))]]
    size, none = F.octet_length("_text").cast("long"), F.lit(0).cast("long")
    copied = marked.where("_copy").withColumn("_r", F.struct(
        size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit("").alias("kept")))
    whole = marked.where("_copy is null and _cut is null").withColumn("_r", F.struct(
        none.alias("n_removed"), none.alias("n_spans"), F.sha2("_text", 256).alias("kept_sha256"), F.col("_text").alias("kept")))
    left = marked.where("_copy is null and _cut").withColumn("_n", size).withColumn("_z", squeezed("_text")).drop("_did", "_dh", "_text")
    left = left.join(cuts, (F.col("_id") == F.col("_did")) & (F.col("_h") == F.col("_dh")))
    left = left.select(*rest, "_z", F.col("_w._first").alias("_f"), F.col("_w._mask").alias("_m"))
    kinds = ", ".join(f"{c} {left.schema[c].dataType.simpleString()}" for c in rest)
    left = left.mapInArrow(lean(cut), f"{kinds}, n_removed long, n_spans long, kept_sha256 string, kept string")
    left = left.withColumn("_r", F.struct("n_removed", "n_spans", "kept_sha256", "kept"))
    columns = lambda n: [F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), n.alias("n_bytes"), "_r.n_removed", "_r.n_spans", "_r.kept_sha256",
                         *([F.col("_r.kept").alias("kept")] if keep_text else []), *[F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)]]
    return copied.select(*columns(size)).unionByName(whole.select(*columns(size))).unionByName(left.select(*columns(F.col("_n"))))
