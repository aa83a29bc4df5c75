"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Every input partition ("sender") fingerprints its rows and sends each owner of a hash range the sorted, distinct
   fingerprints of that range, Golomb-Rice coded (about two bits above the entropy of the gaps).
2. An owner decodes what it received and answers each sender with a bitmap: which of its fingerprints another sender has too.
3. Only rows whose fingerprint is repeated (suspects) shuffle; they are grouped by their whole text, so equality is that
   of bytes. Copies are pre-aggregated before the shuffle, therefore a hot text is one row per task.

Nulls count as empty text. Of equal texts the row with the largest id stays; rows with a null id order first. When
several rows share text and largest id, one of them is kept. Extra columns pass untouched in ``keep_one``, whatever their
names. An empty table gives an empty table. A long text is a grouping key like any other.

A sender's group is one input partition, an owner's about OWNED fingerprints.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import durable, maybe_broadcast, measured, partitions, passing

HASH_BITS = 64
#: Fingerprints that one owner holds, about.
OWNED = 4_000_000


# --- Golomb-Rice coding of sorted distinct 64-bit integers -----------------------------------------------------------

def rice_parameter(n: int, span_bits: int) -> int:
    """Bits of the remainder for n values spread evenly over 2**span_bits."""
    return max(0, span_bits - max(n, 1).bit_length())


def golomb_encode(values: np.ndarray, span_bits: int = HASH_BITS) -> bytes:
    """Code sorted distinct uint64 values: 4 bytes count, 1 byte k, unary quotients, then k-bit remainders of the gaps."""
    n = len(values)
    k = min(rice_parameter(n, span_bits), 63)
    head = np.uint32(n).tobytes() + bytes([k])
    if not n:
        return head
    gaps = np.diff(values, prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]), dtype=np.uint8)
    unary[ends - 1] = 1
    bits = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
    unary_bytes = np.packbits(unary).tobytes()
    return head + np.uint32(len(unary_bytes)).tobytes() + unary_bytes + np.packbits(bits.ravel()).tobytes()


def golomb_decode(blob: bytes) -> np.ndarray:
    n, k = int(np.frombuffer(blob, np.uint32, 1)[0]), blob[4]
    if not n:
        return np.zeros(0, np.uint64)
    size = int(np.frombuffer(blob, np.uint32, 1, 5)[0])
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, 9)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=9 + size))[: n * k].reshape(n, k)
        for i in range(k):
            gaps |= bits[:, i].astype(np.uint64) << np.uint64(i)
    return np.cumsum(gaps, dtype=np.uint64)


# --- exchange --------------------------------------------------------------------------------------------------------

def _send(owners: int):
    width = (1 << HASH_BITS) // owners + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sender = int(pdf["_sender"].iloc[0])
        own = np.unique(pdf["_fp"].to_numpy(np.int64).view(np.uint64))
        cuts = np.searchsorted(own, np.array([min(i * width, (1 << HASH_BITS) - 1) for i in range(1, owners)], np.uint64))
        rows = []
        for owner, part in enumerate(np.split(own, cuts)):
            if len(part):
                base = np.uint64(owner * width)
                rows.append((sender, owner, golomb_encode(part - base, max(1, HASH_BITS - owners.bit_length() + 1))))
        return pd.DataFrame(rows, columns=["_sender", "_owner", "_blob"])

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """One owner: a bitmap for each sender, set where a fingerprint came from another sender too."""
    parts = [golomb_decode(b) for b in pdf["_blob"]]
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    repeated = values[counts > 1]
    bitmaps = [np.packbits(np.isin(p, repeated, assume_unique=True)).tobytes() for p in parts]
    return pd.DataFrame({"_sender": pdf["_sender"], "_owner": pdf["_owner"], "_bitmap": bitmaps})


def _receive(owners: int):
    width = (1 << HASH_BITS) // owners + 1

    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"_fp": np.zeros(0, np.int64)})
        own, counts = np.unique(rows["_fp"].to_numpy(np.int64).view(np.uint64), return_counts=True)
        suspect = counts > 1
        owner_of = np.searchsorted(np.array([min(i * width, (1 << HASH_BITS) - 1) for i in range(1, owners)], np.uint64), own, side="right")
        for owner, bitmap in zip(answers["_owner"], answers["_bitmap"], strict=True):
            at = np.flatnonzero(owner_of == owner)
            suspect[at] |= np.unpackbits(np.frombuffer(bitmap, np.uint8))[: len(at)].astype(bool)
        return pd.DataFrame({"_fp": own[suspect].view(np.int64)})

    return run


def repeated_fingerprints(prints: DataFrame, owners: int) -> DataFrame:
    """Distinct fingerprints ``_fp`` that occur more than once in ``prints(_sender, _fp)``."""
    sent = prints.select("_sender", "_fp").groupBy("_sender").applyInPandas(_send(owners), "_sender int, _owner int, _blob binary")
    answers = sent.groupBy("_owner").applyInPandas(_answer, "_sender int, _owner int, _bitmap binary")
    return (
        prints.select("_sender", "_fp").groupBy("_sender").cogroup(answers.groupBy("_sender"))
        .applyInPandas(_receive(owners), "_fp long").distinct()
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256 (of the text as UTF-8, null as empty)."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.withColumn("_fp", F.xxhash64("_text"))
    prints, seen = measured(
        base.select(
            "_id", "_fp", F.unhex(F.sha2("_text", 256)).alias("_sha"),
            F.spark_partition_id().alias("_sender"), F.monotonically_increasing_id().alias("_row"),
        ),
        "fingerprints",
    )
    owners = owners or max(partitions(spark), -(-seen["rows"] // OWNED))
    suspects, seen = measured(repeated_fingerprints(prints, owners), "suspects")
    # Bytes decide: the text itself is the grouping key, combined on the map side before anything is shuffled.
    grouped = lambda df: df.groupBy("_fp", "_text").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    if seen["rows"] <= common.BROADCAST_ROWS:
        groups = grouped(base.join(F.broadcast(suspects), "_fp", "left_semi"))
    else:  # the suspects would have to be shuffled against texts, so these are combined first
        groups = grouped(base).join(suspects, "_fp", "left_semi")
    groups = groups.select("_fp", F.unhex(F.sha2("_text", 256)).alias("_sha"), "keep_id", "group_size")
    hot = F.count_if(F.col("group_size") >= HOT_ROWS)
    groups, seen = measured(groups, "copies", hot=hot)
    out = _join_groups(prints, groups, seen["hot"] or 0)
    # Rows that repeat an id within one group: only the first of them is kept.
    best = F.col("keep_id").eqNullSafe(F.col("_id"))
    tied = (
        out.where(best & (F.col("group_size") > 1)).groupBy("_sha").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1").select(F.col("_sha").alias("_tsha"), "_first")
    )
    tied, seen = measured(tied, "tied")
    if not seen["rows"]:
        out = out.withColumn("_first", F.col("_row"))
    else:
        out = out.join(maybe_broadcast(tied, seen["rows"]), F.col("_sha") == F.col("_tsha"), "left")
    return out.select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        (best & (F.col("_first").isNull() | (F.col("_first") == F.col("_row")))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"), F.col("_row"),
    )


#: Groups with at least this many rows have a third way: their rows are dealt by number, with the group's row copied to each part.
HOT_ROWS, SPREAD = 1000, 64


def _join_groups(prints: DataFrame, groups: DataFrame, n_hot: int) -> DataFrame:
    """prints with keep_id and group_size. The rows of a hot group would land in one task of a shuffle join, so hashes of hot
    groups are dealt over SPREAD parts, whatever the number of such groups; the others have fewer than HOT_ROWS rows each."""
    id_type = prints.schema["_id"].dataType
    known = groups.select("_sha", F.col("keep_id").cast(id_type).alias("keep_id"), "group_size")
    if n_hot:
        hot = known.where(F.col("group_size") >= HOT_ROWS)
        parts = hot.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        known = known.where(F.col("group_size") < HOT_ROWS).withColumn("_part", F.lit(-1)).unionByName(parts)
        marks = hot.select(F.col("_sha").alias("_mark"))
        dealt = prints.join(maybe_broadcast(marks, n_hot), F.col("_sha") == F.col("_mark"), "left")
        part = F.when(F.col("_mark").isNull(), -1).otherwise(F.pmod(F.xxhash64("_row"), F.lit(SPREAD))).cast("int")
        found = dealt.withColumn("_part", part).drop("_mark").join(known, ["_sha", "_part"], "left").drop("_part")
    else:
        found = prints.join(known, "_sha", "left")
    return found.select(
        "_id", "_sha", "_row", F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1).cast("long")).alias("group_size"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, without further copies of a text."""
    with passing(docs.sparkSession, "dropped"):
        status = exact_groups(docs, id_col, text_col).groupBy(F.col(id_col).alias("_kid"), F.unhex("text_sha256").alias("_ksha")).agg(
            F.max("kept").alias("_any"), F.count("*").alias("_n"))
        odd, seen = measured(status.where("not _any or _n > 1"), "dropped", twice=F.count_if("_any"))
    keyed = docs.withColumn("_sha", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    match = lambda keys: keyed[id_col].eqNullSafe(keys["_kid"]) & (keyed["_sha"] == keys["_ksha"])
    keys = maybe_broadcast(odd, seen["rows"])
    clean = keyed.join(keys, match(keys), "left_anti")
    if seen["twice"]:  # one id twice with one text
        twice = odd.where("_any")
        clean = clean.unionByName(keyed.join(twice, match(twice), "left_semi").dropDuplicates([id_col, "_sha"]))
    return clean.drop("_sha")
