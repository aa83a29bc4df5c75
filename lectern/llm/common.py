"""Helpers that the corpus operators share: durable intermediate tables, reading, hashing."""
from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
        folder = tempfile.mkdtemp(prefix="spark-lectern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows that a Python task holds at a time while a table is made: texts are long, so fewer than Spark's 10,000.
BATCH = 1000


@contextlib.contextmanager
def while_writing(spark: SparkSession, rows: int = BATCH):
    """Arrow batches of at most ``rows`` rows for what runs inside, and its shuffle files go as soon as it is done, not when the driver
    happens to collect its garbage; the session's own settings come back afterwards."""
    size, clean = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = {size: spark.conf.get(size), clean: spark.conf.get(clean, "false")}
    spark.conf.set(size, str(min(rows, int(before[size])) if int(before[size]) > 0 else rows))
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def give_back() -> None:
    """Free memory of a Python task goes back to the system: workers live on for the next stage, and what they once held would
    stand beside what that needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(task):
    """A task over batches that gives its memory back at its end."""
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def slices(pdf, rows: int = BATCH):
    """A batch in parts, so that what is made of it is never there at once."""
    for i in range(0, len(pdf), rows):
        yield pdf.iloc[i : i + rows]


#: Names and folders of the tables made since the innermost ``passing`` began.
_MADE: contextvars.ContextVar[list[tuple[str, str]] | None] = contextvars.ContextVar("made", default=None)


@contextlib.contextmanager
def passing(spark: SparkSession, *keep: str):
    """Tables that ``durable`` makes inside go at the end, but for those of the names in ``keep``: whatever is made of the others has
    to be written by then. What is kept belongs to the ``passing`` around this one, if there is any."""
    made: list[tuple[str, str]] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        around, hadoop = _MADE.get(), spark._jvm.org.apache.hadoop.fs
        for name, path in made:
            if name not in keep:
                where = hadoop.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            elif around is not None:
                around.append((name, path))


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts lineage, survives lost executors and fixes the row contents, so that later passes see the same rows.
    """
    path = f"{shared_folder(df.sparkSession)}/lectern-{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append((name, path))
    with while_writing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict]:
    """``durable(df)`` with its number of ``rows`` and further aggregates of it, taken while it is written, without a job of
    their own."""
    seen = Observation()
    kept = durable(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in sums.items()]), name)
    return kept, seen.get


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key table of at most so many rows and bytes may be broadcast; its rows are known first.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 << 20
#: Bytes that a value takes, about: numbers by their type, texts and hashes as the longest hash there is.
_WIDTHS = {"boolean": 1, "int": 4, "bigint": 8, "double": 8}


def row_bytes(keys: DataFrame) -> int:
    return 16 + sum(_WIDTHS.get(f.dataType.simpleString(), 64) for f in keys.schema)


def maybe_broadcast(keys: DataFrame, rows: int | None = None) -> DataFrame:
    """``keys`` (durable, narrow) with a broadcast hint if it is small; otherwise Spark shuffles both sides. ``rows``: their
    number where it is known, else they are counted."""
    limit = min(BROADCAST_ROWS, BROADCAST_BYTES // row_bytes(keys))
    return F.broadcast(keys) if (keys.limit(limit + 1).count() if rows is None else rows) <= limit else keys


#: Keys with at least this many rows have their rows dealt over SPREAD parts, with the key's totals copied to each part.
HOT_ROWS, SPREAD = 1000, 64


def attach_totals(rows: DataFrame, key: str, *totals: Column) -> DataFrame:
    """``rows`` (durable, so that its rows keep their numbers) with aggregates over the rows of an equal ``key``, nulls together.

    Aggregates combine before they shuffle and are joined back: by broadcast while the keys are few, else by a join in which
    the rows of a hot key are dealt over several tasks.
    """
    names = ["_akey", "_rows"]
    found = rows.groupBy(F.col(key).alias(names[0])).agg(F.count("*").alias(names[1]), *totals)
    found, seen = measured(found, "totals", hot=F.count_if(F.col(names[1]) >= HOT_ROWS))
    if seen["rows"] <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found), F.col(key).eqNullSafe(F.col(names[0])), "left").drop(*names)
    hot = found.where(F.col(names[1]) >= HOT_ROWS)
    parts = hot.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    known = found.where(F.col(names[1]) < HOT_ROWS).withColumn("_part", F.lit(-1)).unionByName(parts)
    marks = hot.select(F.col(names[0]).alias("_mark"), F.lit(True).alias("_hot"))
    dealt = rows.join(maybe_broadcast(marks, seen["hot"] or 0), F.col(key).eqNullSafe(F.col("_mark")), "left")
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SPREAD))).otherwise(-1).cast("int")
    dealt = dealt.withColumn("_at", part).drop("_mark", "_hot")
    return dealt.join(known, F.col(key).eqNullSafe(F.col(names[0])) & (F.col("_at") == F.col("_part")), "left").drop("_at", "_part", *names)
