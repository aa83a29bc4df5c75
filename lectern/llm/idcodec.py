"""Token ids in a compact binary form: an adaptive context-mixing range coder over independent, checksummed blocks.

Model, fresh for every block: the last id seen after the previous two ids (order 2) and after the previous id (order 1) are
predictions, each with a confidence of 0 to 3. A first decision says which holds: order 2, order 1, or neither; its distribution
mixes the counts of both confidence contexts. Where neither holds, an id known to the block has a share of the rest by its
adaptive order-0 frequency, and new ids are coded uniformly over the vocabulary.

A block holds at most BLOCK ids, in lanes of at most STEPS that follow one another in the text. One numpy step codes one id of every
lane by the same model, which learns after the first steps and then after every EPOCH of them from all lanes at once. The range
coder is the asymmetric one (rANS): a lane's state is 64 bits, 32 leave it at a time, and the decision and the id within its
share are one interval. Any block is decoded by itself; its header has counts, the documents' parts, and the CRC-32 of ids and
payload.

Block layout (little-endian): b"LCB2", u32 ids, u32 parts, u32 vocabulary, u32 crc of ids, u32 payload bytes, u32 crc of
payload; per part i64 document id, u8 null flag, u64 ordinal in its file, u64 part number, u8 last flag, u32 ids; payload: the
lanes' states (i64), then the words (u32) that left them, in the order in which they are read.
"""
from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable
from .wordtok import encoder

#: Ids of a block, steps of a lane, and steps between two updates of the model, at most.
BLOCK, STEPS, EPOCH = 1 << 21, 512, 16
#: Bits of a whole interval: those of the decision, and those of an id within its share.
DECIDE, ORDER0 = 12, 16
WHOLE = DECIDE + ORDER0
LOW = (1 << WHOLE) - 1
#: Known ids with an interval of their own; further ones are coded as new.
KNOWN = 1 << (ORDER0 - 1)
SLOTS = 1 << 17
HEAD, PART = struct.Struct("<4sIIIIII"), struct.Struct("<qBQQBI")


def of(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at]; "clip" only because it is the fast way of numpy."""
    return values.take(at, mode="clip")


class Model:
    """What the ids so far tell of the next one; all lanes of a block share it."""

    def __init__(self, vocabulary: int):
        if vocabulary > 1 << WHOLE:
            raise ValueError(f"vocabularies have at most {1 << WHOLE} ids")
        self.vocabulary, self.bits = vocabulary, max(1, (vocabulary - 1).bit_length())
        # An entry is the id seen last and its confidence; the id "vocabulary" stands for none.
        self.p1, self.p2 = np.full(vocabulary + 1, vocabulary << 2), np.full(SLOTS, vocabulary << 2)
        self.count, self.fresh = np.zeros(vocabulary, np.int64), 1.0
        self.mix2, self.mix1 = np.ones((4, 3), np.int64), np.ones((4, 3), np.int64)
        self._tables()

    def _tables(self) -> None:
        """Intervals until the next update."""
        mixed = (self.mix2[:, None] + self.mix1[None]).reshape(16, 3)
        share = 1 + mixed * ((1 << DECIDE) - 3) // mixed.sum(axis=1, keepdims=True)
        share[:, 2] = (1 << DECIDE) - share[:, 0] - share[:, 1]
        self.share, self.under = share.ravel(), (np.cumsum(share, axis=1) - share).ravel()
        known = np.flatnonzero(self.count)
        if len(known) > KNOWN:
            known = np.sort(known[np.argsort(-self.count[known], kind="stable")[:KNOWN]])
        n, whole = len(known), 1 << ORDER0
        new = min(max(int(whole * self.fresh), 16), whole >> 2) if n else whole
        counts = self.count[known]
        ends = np.cumsum(counts)
        start = np.arange(n) + (ends - counts) * (whole - n - new) // max(1, int(ends[-1]) if n else 1)
        self.start = np.append(start, whole - new)
        self.size = np.diff(np.append(self.start, whole))
        self.at = np.repeat(np.arange(n + 1), self.size)
        self.ids, self.new = np.append(known, 0), n
        self.rank = np.full(self.vocabulary, n)
        self.rank[known] = np.arange(n)

    def look(self, a: np.ndarray, b: np.ndarray):
        """Places and entries of order 2 and order 1 after the ids a, b, and their joint confidence."""
        at = (a * 40503 + b * 2971) & (SLOTS - 1)
        e2, e1 = of(self.p2, at), of(self.p1, b)
        return at, e2, e1, (e2 & 3) << 2 | e1 & 3

    def learn(self, at, e2, e1, m, b, cur, symbol, escaped: int) -> None:
        """The ids of some steps, all lanes of a step side by side; of equal contexts the last counts."""
        for p, where, e in ((self.p2, at, e2), (self.p1, b, e1)):
            p[where] = np.where(e >> 2 == cur, e + ((e & 3) < 3), cur << 2 | 1)
        seen = np.bincount(m * 3 + symbol, minlength=48).reshape(4, 4, 3)
        self.mix2, self.mix1 = (self.mix2 >> 1) + seen.sum(axis=1), (self.mix1 >> 1) + seen.sum(axis=0)
        self.mix2[:, 2] += 1  # never all zero
        self.count += np.bincount(cur[symbol == 2], minlength=self.vocabulary)
        self.fresh = escaped / len(cur)
        self._tables()


def _symbols(e2, e1, cur) -> np.ndarray:
    """0: order 2 says so, 1: order 1 does, 2: neither."""
    wrong = e2 >> 2 != cur
    return wrong + (wrong & (e1 >> 2 != cur)).astype(np.int64)


def _shape(n: int) -> tuple[int, int]:
    """Steps and lanes of a block of n ids; a lane's ids follow one another in the text."""
    lanes = max(1, -(-n // STEPS))
    return -(-n // lanes), lanes


def _epochs(steps: int):
    """Steps between updates: the first ones double."""
    t, size = 0, 1
    while t < steps:
        yield t, min(t + size, steps)
        t, size = t + size, min(2 * size, EPOCH)


def _encode(ids: np.ndarray, vocabulary: int) -> bytes:
    steps, lanes = _shape(len(ids))
    if not len(ids):
        return b""
    grid = np.zeros(steps * lanes, np.int64)
    grid[: len(ids)] = ids
    grid = np.vstack([np.full((2, lanes), vocabulary), grid.reshape(lanes, steps).T])
    model, coded = Model(vocabulary), []
    for t, end in _epochs(steps):
        a, b, cur = (np.ascontiguousarray(grid[t + i : end + i]).ravel() for i in range(3))
        at, e2, e1, m = model.look(a, b)
        symbol = _symbols(e2, e1, cur)
        other, k, rank = symbol == 2, m * 3 + symbol, of(model.rank, cur)
        share = of(model.share, k)
        low = (of(model.under, k) << ORDER0) + share * of(model.start, rank) * other
        size = share * np.where(other, of(model.size, rank), 1 << ORDER0)
        escaped = np.flatnonzero(other & (rank == model.new))
        coded.append((low.reshape(-1, lanes), size.reshape(-1, lanes), np.split(escaped % lanes, np.searchsorted(escaped, np.arange(1, end - t) * lanes))))
        model.learn(at, e2, e1, m, b, cur, symbol, len(escaped))
    x, words, spare = np.full(lanes, 1 << 31, np.int64), [], WHOLE - model.bits

    def put(x, low, size):
        over = np.flatnonzero(x >= size << (63 - WHOLE))
        if len(over):
            words.append(x[over].astype(np.uint32))
            x[over] >>= 32
        return x + (x.view(np.uint64) // size.view(np.uint64)).view(np.int64) * ((1 << WHOLE) - size) + low

    t = steps
    for low, size, escapes in reversed(coded):
        for i in range(len(low) - 1, -1, -1):
            t -= 1
            if len(new := escapes[i]):
                x[new] = put(x[new], grid[t + 2, new].astype(np.int64) << spare, np.full(len(new), 1 << spare, np.int64))
            x = put(x, low[i], size[i])
    return x.astype("<i8").tobytes() + b"".join(w.astype("<u4").tobytes() for w in reversed(words))


def _decode(payload: bytes, n: int, vocabulary: int) -> np.ndarray:
    steps, lanes = _shape(n)
    if not n:
        return np.zeros(0, "<u4")
    x = np.frombuffer(payload, "<i8", lanes).astype(np.int64)
    words, pos = np.frombuffer(payload, "<u4", offset=8 * lanes).astype(np.int64), 0
    grid = np.full((steps + 2, lanes), vocabulary)
    model = Model(vocabulary)
    spare = WHOLE - model.bits

    def fill(x):
        nonlocal pos
        short = np.flatnonzero(x < 1 << 31)
        if k := len(short):
            x[short] = x[short] << 32 | words[pos : pos + k]
            pos += k
        return x

    for t, end in _epochs(steps):
        share, under = model.share.reshape(16, 3), model.under.reshape(16, 3)
        rest, before = np.ascontiguousarray(share[:, 2]), under[:, 2] << ORDER0
        hits = np.ascontiguousarray(share[:, :2]) << ORDER0, np.ascontiguousarray(under[:, :2]) << ORDER0
        escaped = 0
        for s in range(t, end):
            _, e2, e1, m = model.look(grid[s], grid[s + 1])
            low = x & LOW
            inner, part = low - of(before, m), of(rest, m)
            hit = np.flatnonzero(inner < 0)
            rank = of(model.at, (inner / part).astype(np.int64))
            cur, size, inner = of(model.ids, rank), part * of(model.size, rank), inner - part * of(model.start, rank)
            if len(hit):
                h = m[hit]
                one = (low[hit] >= hits[1][h, 1]).astype(np.int64)
                cur[hit] = np.where(one, e1[hit], e2[hit]) >> 2
                size[hit], inner[hit] = hits[0][h, one], low[hit] - hits[1][h, one]
                rank[hit] = -1
            x = fill(size * (x >> WHOLE) + inner)
            new = np.flatnonzero(rank == model.new)
            if len(new):
                own = x[new]
                cur[new] = (own & LOW) >> spare
                x[new] = fill(((own >> WHOLE) << spare) + (own & (1 << spare) - 1))
                escaped += len(new)
            grid[s + 2] = cur
        a, b, cur = (grid[t + i : end + i].ravel() for i in range(3))
        at, e2, e1, m = model.look(a, b)
        model.learn(at, e2, e1, m, b, cur, _symbols(e2, e1, cur), escaped)
    return grid[2:].T.ravel()[:n].astype("<u4")


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """Payloads of blocks of ids below ``vocabulary``."""
    return [_encode(b, vocabulary) for b in blocks]


def decode_blocks(payloads: list[bytes], sizes: list[int], vocabulary: int) -> list[np.ndarray]:
    return [_decode(p, n, vocabulary) for p, n in zip(payloads, sizes, strict=True)]


# --- file format -----------------------------------------------------------------------------------------------------

def write_block(ids: np.ndarray, parts: list[tuple], payload: bytes, vocabulary: int) -> bytes:
    """parts: (doc id or None, ordinal, part number, last, ids) of each document piece in the block."""
    head = HEAD.pack(b"LCB2", len(ids), len(parts), vocabulary, zlib.crc32(ids.astype("<u4").tobytes()), len(payload), zlib.crc32(payload))
    return head + b"".join(PART.pack(i or 0, i is None, o, k, last, n) for i, o, k, last, n in parts) + payload


def read_blocks(blocks: list[bytes]) -> list[tuple[np.ndarray, list[tuple]]]:
    """(ids, parts) of each block; a wrong checksum raises ValueError."""
    heads, parts, payloads = [], [], []
    for b in blocks:
        magic, n, k, vocabulary, crc, size, payload_crc = HEAD.unpack_from(b)
        at = HEAD.size + k * PART.size
        payload = b[at : at + size]
        if magic != b"LCB2" or len(payload) != size or zlib.crc32(payload) != payload_crc:
            raise ValueError("damaged block")
        heads.append((n, vocabulary, crc))
        parts.append([(None if null else i, o, p, bool(last), m) for i, null, o, p, last, m in PART.iter_unpack(b[HEAD.size : at])])
        payloads.append(payload)
    out: list = [None] * len(blocks)
    for vocabulary in {h[1] for h in heads}:
        own = [i for i, h in enumerate(heads) if h[1] == vocabulary]
        for i, ids in zip(own, decode_blocks([payloads[i] for i in own], [heads[i][0] for i in own], vocabulary), strict=True):
            if zlib.crc32(ids.tobytes()) != heads[i][2]:
                raise ValueError("damaged block")
            out[i] = (ids, parts[i])
    return out


def crc32_combine(a: int, b: int, size_b: int) -> int:
    """CRC-32 of two byte strings one after the other, from theirs and the length of the second."""
    def times(m, v):
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    matrix = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    size = size_b * 8
    while size:
        if size & 1:
            a = times(matrix, a)
        matrix = [times(matrix, row) for row in matrix]
        size >>= 1
    return a ^ b


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
              block: int = BLOCK) -> None:
    """Encode all texts (null: empty), append ``end_id``, and write blocks in ascending id order (null ids first) to a
    Parquet table at ``path``: part (range of ids), block_no, start (ids before it in its part), n_ids, block.

    Rows that repeat an id are documents of their own, side by side in order of their text; a long text runs over as many blocks
    as it needs; extra columns are ignored, whatever their names; an empty table gives an empty one."""
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    ranged = source.repartitionByRange(F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "_text")

    def run(batches):
        encode, end = encoder(tokenizer_path), np.uint32(end_id).tobytes()
        vocabulary = max(encode.tok.get_vocab_size(with_added_tokens=True), end_id + 1)
        ids, parts, held, number, start, ordinal, part = [], [], 0, 0, 0, 0, 0

        def flush():
            nonlocal ids, parts, held, number, start
            x = np.concatenate(ids)
            row = part, number, start, len(x), write_block(x, parts, encode_blocks([x], vocabulary)[0], vocabulary)
            ids, parts, held, number, start = [], [], 0, number + 1, start + len(x)
            return pd.DataFrame([row], columns=["part", "block_no", "start", "n_ids", "block"])

        for pdf in batches:
            part = int(pdf["_part"].iloc[0]) if len(pdf) else part
            null = pdf["_id"].isna()
            for i, none, text in zip(pdf["_id"].fillna(0).astype("int64"), null, pdf["_text"], strict=True):
                x = np.frombuffer(encode(text) + end, "<u4")
                at = k = 0
                while at < len(x):
                    n = min(len(x) - at, block - held)
                    ids.append(x[at : at + n])
                    parts.append((None if none else i, ordinal, k, at + n == len(x), n))
                    at, held, k = at + n, held + n, k + 1
                    if held == block:
                        yield flush()
                ordinal += 1
        if held:
            yield flush()

    ranged.withColumn("_part", F.spark_partition_id()).mapInPandas(run, "part int, block_no long, start long, n_ids long, block binary").write.parquet(path)


def read_ids(spark, path: str, keep_ids: bool = False) -> DataFrame:
    """Per document of the table at ``path``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids
    (binary, little-endian unsigned 32-bit) if asked for. Documents cut by block ends are joined again."""
    blocks = spark.read.schema("part int, block_no long, start long, n_ids long, block binary").parquet(path)
    # One row for each range partition of the writer, so it may be broadcast whatever the number of ids.
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))

    def run(batches):
        for pdf in batches:
            for part, start, block in zip(pdf["part"], pdf["start"], pdf["block"], strict=True):
                rows = []
                ids, parts = read_blocks([block])[0]
                for i, ordinal, k, last, n in parts:
                    raw = ids[:n].tobytes()
                    rows.append((part, ordinal, i, k, k == 0 and last, start, n, zlib.crc32(raw), raw if keep_ids else None))
                    ids, start = ids[n:], start + n
                out = pd.DataFrame(rows, columns=["part", "ordinal", "doc_id", "k", "whole", "start", "n_tokens", "ids_crc32", "ids"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    pieces = blocks.select("part", "start", "block").mapInPandas(
        run, "part int, ordinal long, doc_id long, k long, whole boolean, start long, n_tokens long, ids_crc32 long, ids binary")
    return _whole(durable(pieces, "id-parts"), before, keep_ids)


def _whole(pieces: DataFrame, before: DataFrame, keep_ids: bool) -> DataFrame:
    @F.pandas_udf("long")
    def combined(parts: pd.Series) -> pd.Series:
        out = []
        for ps in parts:
            crc = 0
            for p in ps:
                crc = crc32_combine(crc, p["ids_crc32"], 4 * p["n_tokens"])
            out.append(crc)
        return pd.Series(out)

    item = ["k", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids
    cut = pieces.where("not whole").groupBy("part", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct(*item))).alias("_p"))
    cut = cut.select(
        "part", "doc_id", "start", F.aggregate("_p", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"]).alias("n_tokens"),
        combined("_p").alias("ids_crc32"), *([F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")] if keep_ids else []))
    out = pieces.where("whole").select(cut.columns).unionByName(cut).join(F.broadcast(before), "part")
    return out.select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))
