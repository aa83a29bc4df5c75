"""Near-duplicate detection: MinHash with tensored banding, verified on whole shingle sets.

A document's set holds its distinct ``words``-word shingles (words are runs of non-blank bytes after A-Z is lower-cased),
each hashed to 64 bits; a shorter text is one shingle; no words give the empty set, which links with nothing.

* Sketch: two collections of ``m`` small keys, each of ``rows`` minimum hashes. A table key joins key i of the first with
  key j of the second, so 2*m*rows minimum hashes give m*m tables of 2*rows rows each (instead of 2*m*m*rows hashes).
  A pair of similarity s meets with probability (1 - (1 - s**rows)**m)**2: 0.9994 at 0.8 with the defaults, 0.99993 at 0.85.
* Documents with equal sets are one class from the start (hash aggregation), so exact copies never pair up.
* In a table bucket every class is compared with the bucket's smallest id only (a star), then with the class that has the
  fewest shingles of its own (a second star). What both left apart is compared across the components that meet in a bucket, unless their sizes, less the shingles that only one of them has,
  or a parity map of 1024 bits, rule it out (both are exact bounds). Classes that are already in one component need no comparison; so a group of n near copies costs about n
  checks, not n*n.
* Every link is confirmed by the exact sizes of intersection and union. No bucket is capped.

A link of similarity s is missed with probability 1 - (1 - (1 - s**rows)**m)**2, so 0.0006 at 0.8 and 0.00007 at 0.85.

Nulls are empty texts, rows with a null id are left out of linking (component null, kept), extra columns are ignored whatever
their names, an empty table gives an empty table. Rows that repeat an id are one node of the graph: a link of any of their
texts is a link of the id, and all of them are kept or none. A long text is sketched in blocks.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, lean, maybe_broadcast, measured, passing, slices
from .components import connected_components, joined_components

MASK = (1 << 64) - 1
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
M, ROWS = 8, 2


class Shingler:
    """Hashes texts to arrays of distinct 64-bit shingles; keeps a bounded memo of word hashes."""

    def __init__(self, words: int, memo: int = 150_000):
        self.words, self.memo, self.seen = words, memo, {}
        self.mult = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(words)], np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not parts:
            return np.zeros(0, np.uint64)
        if len(parts) < self.words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed=len(parts))], np.uint64)
        seen = self.seen
        try:
            h = [seen[p] for p in parts]
        except KeyError:
            if len(seen) > self.memo:
                seen.clear()
            for p in set(parts):
                if p not in seen:
                    seen[p] = xxhash.xxh64_intdigest(p)
            h = [seen[p] for p in parts]
        h = np.array(h, np.uint64)
        n = len(h) - self.words + 1
        out = np.zeros(n, np.uint64)
        for i in range(self.words):
            x = h[i : i + n] * self.mult[i]
            out = (out ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def sketch(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum hashes of one set; in blocks, so that memory does not grow with the text."""
    low = np.full(len(a), MASK, np.uint64)
    for i in range(0, len(shingles), 4096):
        x = shingles[None, i : i + 4096] * a[:, None] + b[:, None]
        np.minimum(low, (x ^ (x >> np.uint64(31))).min(axis=1), out=low)
    return low


def _hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def small_keys(low: np.ndarray, m: int, rows: int) -> np.ndarray:
    """The two collections of m small collisions each, as a (2, m) array."""
    small = np.zeros((2, m), np.uint64)
    low = low.reshape(2, m, rows)
    for r in range(rows):
        small = (small ^ low[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        small ^= small >> np.uint64(32)
    return small.view(np.int64)


def table_keys(classes: DataFrame) -> DataFrame:
    """The tensor: every class once in each of its m*m tables."""
    half = classes.select("_rep", "_n", "_right", F.posexplode("_left").alias("_i", "_a"))
    return half.select("_rep", "_n", "_i", "_a", F.posexplode("_right").alias("_j", "_b")).select(
        "_rep", "_n", F.xxhash64("_i", "_a", "_j", "_b").alias("_key"))


def _sketches(words: int, m: int, rows: int):
    def run(batches):
        shingler, (a, b) = Shingler(words), _hash_family(2 * m * rows, 17)
        for pdf in batches:
            out = []
            for i, text in zip(pdf["_id"], pdf["_text"], strict=True):
                s = shingler(text)
                left, right = small_keys(sketch(s, a, b), m, rows) if len(s) else (None, None)
                out.append((i, len(s), xxhash.xxh128_digest(s.tobytes()) if len(s) else None, left, right))
            yield pd.DataFrame(out, columns=["_id", "n_shingles", "_set", "_left", "_right"])

    return lean(run)


#: Words of 64 bits in the parity map.
WORDS = 16


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each of 64 * WORDS classes of shingles, whether the set has an odd number of them. Two sets differ in at least as
    many shingles as their maps differ in bits."""
    odd = np.bincount((shingles >> np.uint64(7)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _apart(a: str, b: str):
    """Bits in which two parity maps differ: a bound below the size of the sets' difference."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(WORDS)), F.lit(0))


def _sets(words: int):
    def run(batches):
        shingler = Shingler(words)
        for pdf in (part for batch in batches for part in slices(batch)):
            sets = [shingler(t) for t in pdf["_text"]]
            yield pd.DataFrame({"_id": pdf["_id"], "_shingles": [s.view(np.int64) for s in sets], "_parity": [parity(s) for s in sets]})

    return lean(run)


def verify_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(x, y) whose sets reach the similarity. ``pairs`` is durable, and so is ``sets``: _id, _n, _shingles.

    The side y is a bucket's smallest id and may be hot: its set is copied to as many salts as it has thousands of partners.
    """
    # Only hot ids are marked, so that no task has to hold all pairs of one before they are dealt out.
    fan = pairs.groupBy("y").agg(F.count("*").alias("_c")).select("y", F.ceil(F.col("_c") / 1000).cast("int").alias("_fan"))
    fan, seen = measured(fan, "partners", hot=F.count_if(F.col("_fan") > 1))
    hot, wide = maybe_broadcast(fan.where("_fan > 1"), seen["hot"] or 0), F.coalesce("_fan", F.lit(1))
    left = sets.select(F.col("_id").alias("x"), F.col("_shingles").alias("_a"))
    right = (
        sets.select(F.col("_id").alias("y"), F.col("_shingles").alias("_b")).join(fan, "y")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_fan") - 1)))
    )
    dealt = pairs.join(hot, "y", "left").withColumn("_salt", F.pmod(F.xxhash64("x"), wide).cast("int")).drop("_fan")
    both = dealt.join(left, "x").join(right.drop("_fan").hint("merge"), ["y", "_salt"])
    common = F.size(F.array_intersect("_a", "_b"))
    both = both.select("x", "y", common.cast("long").alias("_i"), (F.size("_a") + F.size("_b")).cast("long").alias("_s"))
    return both.where(F.col("_i") * 100 >= percent * (F.col("_s") - F.col("_i"))).select("x", "y")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, m: int = M, rows: int = ROWS,
) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links), kept (id = component_id), n_links
    (confirmed links of its class found on the way; all classes of a component are connected by such links)."""
    with passing(docs.sparkSession, *RESULT):
        return _near_duplicates(docs, id_col, text_col, words, percent, m, rows)


#: The tables that the result is made of; sets, buckets and pairs go when it is known.
RESULT = ("sketches", "classes", "links", "star-links", "pair-links", "labels", "edges", "numbered", "by-row", "of-ids")


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, m: int, rows: int) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if not base.where("_id is not null").groupBy("_id").count().where("count > 1").isEmpty():
        return _of_repeated_ids(base, docs.schema[id_col].dataType, id_col, words, percent, m, rows)
    sketched = durable(base.mapInPandas(_sketches(words, m, rows), "_id long, n_shingles long, _set binary, _left array<long>, _right array<long>"), "sketches")
    full = sketched.where("_id is not null and n_shingles > 0")
    # One class for each distinct set; its representative is the smallest id.
    classes = durable(
        full.groupBy("_set").agg(F.min_by(F.struct("_id", "n_shingles", "_left", "_right"), "_id").alias("_r"))
        .select("_set", F.col("_r._id").alias("_rep"), F.col("_r.n_shingles").alias("_n"), F.col("_r._left").alias("_left"), F.col("_r._right").alias("_right")),
        "classes",
    )
    # The joins by bucket have a merge hint: Spark sizes what is exploded, or written once for each table, far too low, and would
    # send all of it through the driver.
    cells = table_keys(classes)
    least = cells.groupBy("_key").agg(F.min("_rep").alias("_low"), F.max("_rep").alias("_top")).where("_low < _top").select("_key", "_low")
    met = durable(cells.join(least.hint("merge"), "_key").select("_key", "_rep", "_n", "_low"), "buckets")
    candidates = met.select(F.col("_rep").alias("_c")).distinct()
    candidates, seen = measured(candidates, "candidates")
    keys = maybe_broadcast(candidates, seen["rows"])
    sets = durable(
        base.join(keys, F.col("_id") == F.col("_c"), "left_semi").mapInPandas(_sets(words), "_id long, _shingles array<long>, _parity array<long>")
        .dropDuplicates(["_id"]),
        "sets",
    )
    star = durable(met.where("_rep > _low").select(F.col("_rep").alias("x"), F.col("_low").alias("y")).distinct(), "star")
    links = durable(verify_pairs(star, sets, percent), "links")
    labels = connected_components(links)
    # Classes that share a bucket but not a component: compare across components, once per pair.
    placed = met.join(labels.withColumnRenamed("node", "_rep"), "_rep", "left").withColumn("component", F.coalesce("component", "_rep"))
    mixed = placed.groupBy("_key").agg(F.min("component").alias("_p"), F.max("component").alias("_q")).where("_p < _q").select("_key")
    open_ = durable(placed.join(mixed.hint("merge"), "_key").select("_key", "_rep", "_n", "component"), "open-buckets")
    # Shingles that no other class there has can't be common: they bound every intersection, and most pairs fall by that.
    listed = sets.join(open_.select(F.col("_rep").alias("_id")).distinct(), "_id").select("_id", F.explode("_shingles").alias("_x"))
    lone = listed.groupBy("_x").agg(F.count("*").alias("_c"), F.min("_id").alias("_rep")).where("_c = 1").groupBy("_rep").agg(F.count("*").alias("_u"))
    able = open_.join(lone, "_rep", "left").withColumn("_most", F.col("_n") - F.coalesce("_u", F.lit(0))).where(F.col("_most") * 100 >= percent * F.col("_n"))
    able = durable(able.join(sets.select(F.col("_id").alias("_rep"), "_parity"), "_rep"), "able")
    near = lambda a, b, n: _apart(a, b) * (100 + percent) <= (100 - percent) * n  # noqa: E731  as |x - y| + |y - x| has to be
    # A second star: the center of a bucket is the class with the fewest shingles of its own, the likely origin of the others.
    middle = able.groupBy("_key").agg(F.min_by(F.struct("_rep", "_n", "_most", "component", "_parity"), F.struct(F.col("_n") - F.col("_most"), F.col("_rep"))).alias("_m"))
    bound = F.least("_most", "_m._most")
    second = able.join(middle.hint("merge"), "_key").where("component <> _m.component").where(near("_parity", "_m._parity", F.col("_n") + F.col("_m._n"))).where(bound * 100 >= percent * (F.col("_n") + F.col("_m._n") - bound)).select(
        F.col("_rep").alias("x"), F.col("_m._rep").alias("y")).distinct()
    second = durable(second.join(star, ["x", "y"], "left_anti"), "second-star")
    found, seen = measured(verify_pairs(second, sets, percent), "star-links")
    if seen["rows"]:
        links, labels = links.unionByName(found), joined_components(labels, found)
    able = able.drop("component").join(labels.withColumnRenamed("node", "_rep"), "_rep", "left").withColumn("component", F.coalesce("component", "_rep"))
    mixed = able.groupBy("_key").agg(F.min("component").alias("_p"), F.max("component").alias("_q")).where("_p < _q").select("_key")
    able = durable(able.join(mixed.hint("merge"), "_key", "left_semi"), "still-open")
    a = able.select("_key", F.col("_rep").alias("x"), F.col("_n").alias("nx"), F.col("component").alias("cx"), F.col("_most").alias("mx"), F.col("_parity").alias("px"))
    b = able.select("_key", F.col("_rep").alias("y"), F.col("_n").alias("ny"), F.col("component").alias("cy"), F.col("_most").alias("my"), F.col("_parity").alias("py"))
    most = F.least("mx", "my", "nx", "ny")
    pairs = (
        a.join(b.hint("merge"), "_key").where("x > y and cx <> cy").where(near("px", "py", F.col("nx") + F.col("ny")))
        .where(most * 100 >= percent * (F.col("nx") + F.col("ny") - most)).select("x", "y").distinct()
    )
    tried = star.unionByName(second.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")))
    pairs, seen = measured(pairs.join(tried, ["x", "y"], "left_anti"), "pairs")
    if seen["rows"]:
        found = durable(verify_pairs(pairs, sets, percent), "pair-links")
        links, labels = links.unionByName(found), joined_components(labels, found)
    degree = links.select(F.explode(F.array("x", "y")).alias("_rep")).groupBy("_rep").agg(F.count("*").alias("n_links"))
    of_class = (
        classes.select("_set", "_rep").join(labels.withColumnRenamed("node", "_rep"), "_rep", "left").join(degree, "_rep", "left")
        .select("_set", F.coalesce("component", "_rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
    out = sketched.select("_id", "n_shingles", "_set").join(of_class, "_set", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(id_col), "n_shingles", own.alias("component_id"),
        F.coalesce(own == F.col("_id"), F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _of_repeated_ids(base: DataFrame, id_type, id_col: str, words: int, percent: int, m: int, rows: int) -> DataFrame:
    """near_duplicates where ids repeat: rows are told apart by a number of their own, and those of one id are one node."""
    base = durable(base.withColumn("_row", F.when(F.col("_id").isNotNull(), F.monotonically_increasing_id())), "numbered")
    found = near_duplicates(base, "_row", "_text", words, percent, m, rows)
    found = durable(found.join(base.select("_row", "_id"), "_row", "left"), "by-row")
    ends = found.where("_id is not null and n_shingles > 0").select("_id", F.col("component_id").alias("y")).distinct()
    same = ends.groupBy("_id").agg(F.min("y").alias("x"), F.count("*").alias("_n")).where("_n > 1").select("_id", "x")
    labels = durable(connected_components(ends.join(same, "_id").select("x", "y")), "of-ids")
    whole = found.where("_id is not null and n_shingles > 0").join(labels.select(F.col("node").alias("component_id"), "component"), "component_id", "left")
    whole = whole.withColumn("component_id", F.coalesce("component", "component_id")).drop("component")
    least = whole.groupBy("component_id").agg(F.min("_id").alias("_least"))
    whole = whole.join(least, "component_id").withColumn("component_id", F.col("_least"))
    full = F.col("_id").isNotNull() & (F.col("n_shingles") > 0)
    rest = found.where(~full).withColumn("component_id", F.col("_id"))
    out = whole.drop("_least").unionByName(rest)
    return out.select(
        F.col("_id").cast(id_type).alias(id_col), "n_shingles", "component_id",
        F.coalesce(F.col("component_id") == F.col("_id"), F.lit(True)).alias("kept"), "n_links")


def keep_one_of_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each near-duplicate group (that of the smallest id)."""
    with passing(docs.sparkSession, "near-dropped"):
        found = near_duplicates(docs, id_col, text_col, **how)
        gone, seen = measured(found.where("not kept").select(F.col(id_col).cast("long").alias("_gone")).distinct(), "near-dropped")
    keys = maybe_broadcast(gone, seen["rows"])
    return docs.join(keys, docs[id_col].cast("long") == keys["_gone"], "left_anti")
