"""Tables that streams keep up to date by key."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made up only where none is set and Spark runs in one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
    import tempfile

    return tempfile.mkdtemp(prefix="spark-lectern-")


class KeyedTable:
    """Rows with one row for each key, in Parquet files of buckets by the key's hash.

    ``upsert`` reads and writes the buckets its rows are in and no others: each touched bucket gets a new version, and readers take
    the newest version of every bucket. The version is the stream's batch number, so a batch that is run again after a failure
    replaces what it wrote before. What a batch writes follows the buckets it touches; take so many that a bucket is some ten MB.
    """

    def __init__(self, spark: SparkSession, schema: str, keys: list[str], path: str | None = None, buckets: int = 32):
        self.spark, self.schema, self.keys, self.buckets = spark, schema, keys, buckets
        self.path = path or f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
        self.versions: list[int] = []

    def _files(self, below: int | None = None) -> DataFrame:
        """All versions, newest and old, or those before ``below``."""
        known = [v for v in self.versions if below is None or v < below]
        full = f"{self.schema}, bucket int, version long"
        if not known:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", self.path).parquet(*[f"{self.path}/version={v}" for v in known])

    def _newest(self, below: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        files = self._files(below)
        if buckets is not None:
            files = files.where(F.col("bucket").isin(buckets))
        last = {r["bucket"]: r["v"] for r in files.groupBy("bucket").agg(F.max("version").alias("v")).collect()}  # one row a bucket
        if not last:
            return files.drop("bucket", "version")
        version = F.create_map(*[F.lit(x) for kv in last.items() for x in kv])
        return files.where(F.col("version") == version[F.col("bucket")]).drop("bucket", "version")

    def read(self) -> DataFrame:
        return self._newest()

    def before(self, version: int) -> DataFrame:
        """What the table held before ``version`` was written, also where that is written again."""
        return self._newest(version)

    def upsert(self, rows: DataFrame, version: int, order: Column | None = None) -> None:
        """Put ``rows`` in place of those with their keys; with ``order`` the row of the largest value stays, old or new."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows.select(*names).write.mode("overwrite").parquet(f"{self.path}/incoming")  # looked at three times, made once
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/incoming")
        touched = [r["b"] for r in rows.select(bucket.alias("b")).distinct().collect()]  # bounded by the buckets
        if not touched:
            return
        old = self._newest(version, touched).select(*names)
        if order is None:
            merged = old.join(rows.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(rows)
        else:
            merged = old.unionByName(rows).groupBy(*self.keys).agg(F.max_by(F.struct(*names), order).alias("_r")).select("_r.*")
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={version}")
        if version not in self.versions:
            self.versions.append(version)

    def attach(self) -> KeyedTable:
        """Know again the versions that lie in the folder, after a restart."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        where = hadoop.Path(self.path)
        store = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []
        self.versions = sorted(int(n.split("=")[1]) for n in found if n.startswith("version="))
        return self
