"""Codes of vectors: a product quantiser in whole numbers, with matrix products that are exact.

Each component x becomes floor(scale * x). A vector is cut into equal consecutive parts, each part position has its codebook,
and Lloyd rounds move the entries: assign every part to the nearest entry (squared Euclidean distance, ties to the lower
index), then replace each entry by the componentwise floor of its parts' mean; unused entries stay.

Distances are |x|^2 - 2xc + |c|^2, and xc is a matrix product in floating point made exact: whole numbers are split into limbs
so short that every partial sum of a product of limbs stays under 2**53; the products are recombined by shifts in int64 (in
Python's integers where components are so large that a distance might leave int64), and the first smallest column wins.

A round is one pass: tasks sum their parts by entry, the sums meet in one aggregation, and parts * entries * width numbers reach
the driver. Rows are spread as the input is.

Odd rows. A vector that is null, or holds a null or a component that is not finite, is left out. A vector of fewer components
than the longest is filled up with zeros, as is the last part where the components don't divide evenly. Fewer rows than entries
give as many entries as rows. Repeated rows and ids count as often as they occur; the first entries are taken by id (a null id
last), then by components. An error beyond 2**63 - 1 is stated as that. An empty table gives an empty table. Further columns
are ignored, whatever their names.
"""
from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_totals, durable, measured

PARTS, ENTRIES, SCALE, ROUNDS = 8, 16, 4096, 6
TOP = (1 << 63) - 1


# --- exact products --------------------------------------------------------------------------------------------------

def magnitude(x: np.ndarray) -> int:
    """Bits of the largest absolute value."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0))).bit_length()


def limb_bits(width: int) -> int:
    """The longest limbs for which a sum of ``width`` products stays below 2**53."""
    return (52 - max(width, 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int, size: int) -> list[np.ndarray]:
    """Integers as float64 limbs, lowest first: all but the last are of ``bits`` bits, the last keeps the sign. ``size``: bits of
    the largest magnitude."""
    out = []
    while size > bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x, size = x >> bits, size - bits
    return [*out, x.astype(np.float64)]


def exact_product(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T for integer matrices, exact. The result is int64 where it surely fits, else of Python's integers."""
    width = x.shape[1]
    size_x, size_c = magnitude(x), magnitude(c)
    bits, wide = limb_bits(width), size_x + size_c + width.bit_length() > 62
    out = np.zeros((len(x), len(c)), dtype=object if wide else np.int64)
    right = limbs(c, bits, size_c)
    for i, a in enumerate(limbs(x, bits, size_x)):
        for j, b in enumerate(right):
            product = (a @ b.T).astype(np.int64)
            out += (product.astype(object) if wide else product) << (bits * (i + j))
    return out


def squares(x: np.ndarray) -> np.ndarray:
    x = x.astype(object) if 2 * magnitude(x) + x.shape[1].bit_length() > 62 else x
    return (x * x).sum(axis=1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first nearest row of c, and the squared distance."""
    kind = object if 2 * max(magnitude(x), magnitude(c)) + 2 + x.shape[1].bit_length() > 62 else np.int64
    far = squares(x).astype(kind)[:, None] - 2 * exact_product(x, c).astype(kind) + squares(c).astype(kind)[None, :]
    at = np.argmin(far, axis=1)
    return at.astype(np.int64), far[np.arange(len(x)), at]


# --- rows ------------------------------------------------------------------------------------------------------------

def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; short rows are filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _sums(codebooks: np.ndarray, width: int):
    """Task: sums of the components of the parts of each entry, and their number, as decimal strings."""
    parts, entries, k = codebooks.shape

    def run(batches):
        sums, counts = np.zeros((parts, entries, k), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), width)
            big = magnitude(x) + len(x).bit_length() > 62
            for p in range(parts):
                own = x[:, p * k : (p + 1) * k]
                at, _ = nearest(own, codebooks[p])
                counts[p] += np.bincount(at, minlength=entries)
                order = np.argsort(at, kind="stable")
                used, starts = np.unique(at[order], return_index=True)
                if len(used):
                    sums[p, used] += np.add.reduceat(own[order].astype(object) if big else own[order], starts, axis=0).astype(object)
        rows = [(p, e, int(counts[p, e]), [str(v) for v in sums[p, e]]) for p in range(parts) for e in range(entries) if counts[p, e]]
        names = ["part", "entry", "n", "sums"]
        types = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=types)

    return run


def learn(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width / parts) of ``rows(_id, _ints)``, a durable table."""
    first = rows.orderBy(F.col("_id").asc_nulls_last(), "_ints").limit(entries).select("_ints").collect()
    k = width // parts
    start = np.zeros((len(first), width), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r["_ints"])] = r["_ints"]
    codebooks = np.ascontiguousarray(start.reshape(len(first), parts, k).transpose(1, 0, 2))
    ints = rows.select("_ints")
    for _ in range(rounds if first else 0):
        found = ints.mapInArrow(_sums(codebooks, width), "part int, entry int, n long, sums array<string>")
        totals = (
            found.select("part", "entry", "n", F.posexplode("sums").alias("at", "v"))
            .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")))
        moved = codebooks.copy()
        for r in totals.collect():  # bounded: parts * entries * width / parts
            moved[r["part"], r["entry"], r["at"]] = int(r["v"]) // r["n"]
        codebooks = moved
    return codebooks


def _codes(codebooks: np.ndarray, width: int):
    parts, _, k = codebooks.shape

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(2), width)
            at, error = np.zeros((len(x), parts), np.uint8 if codebooks.shape[1] <= 256 else np.uint16), 0
            for p in range(parts):
                at[:, p], far = nearest(x[:, p * k : (p + 1) * k], codebooks[p])
                error = error + far.astype(object)
            digits = 2 * at.itemsize
            code = ["".join(f"{v:0{digits}x}" for v in row) for row in at.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array([min(int(v), TOP) for v in error] if len(x) else [], pa.int64())],
                names=["_id", "_label", "code", "error"])

    return run


def fingerprint(codebooks: np.ndarray) -> str:
    """sha256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, scale: int = SCALE, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(codes, codebooks). codes: ``id_col``, ``label_col``, code (an entry's number for each part, in hexadecimal digits), error,
    label_error (the error summed over the rows of a label, nulls together)."""
    kept = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vec_col).alias("_v")).where(
        F.col("_v").isNotNull() & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    ints = kept.select("_id", "_label", F.transform("_v", lambda x: F.floor(x.cast("double") * scale)).cast("array<long>").alias("_ints"))
    rows, seen = measured(ints, "vector-ints", width=F.max(F.size("_ints")))
    width = max(1, -(-(seen["width"] or 0) // parts)) * parts
    codebooks = learn(rows, width, parts, entries, rounds)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("_id", "_label")}
    codes = durable(
        rows.select("_id", "_label", "_ints").mapInArrow(_codes(codebooks, width), f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long")
        if len(codebooks[0]) else rows.select("_id", "_label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), "vector-codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    out = attach_totals(codes, "_label", F.least(total, F.lit(Decimal(TOP))).cast("long").alias("label_error"))
    return out.select(F.col("_id").alias(id_col), F.col("_label").alias(label_col), "code", "error", "label_error"), codebooks
