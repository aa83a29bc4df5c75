"""Streams that are drained into files: whole results, which no table in the driver's memory holds."""
import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.operators.state import apply_highlight_log
from lectern.plans.state_queries import highlight_log
from lectern.streaming import jobs as J
from lectern.streaming.tables import KeyedTable


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_drain_writes_files(spark, sf, mode):
    events, batch = J.event_stream(spark, sf), spark.read.parquet(f"{sf}/events.parquet")
    if mode == "append":
        done, want = J.drain(events.select("event_id"), mode), batch.select("event_id")
    else:
        done, want = J.drain(J.progress_counts(events), mode).select("event_type", "items"), J.progress_counts(batch).select("event_type", "items")
    folder = spark.conf.get("spark.checkpoint.dir")
    assert done.inputFiles() and all(folder in f for f in done.inputFiles())
    assert sorted(done.collect()) == sorted(want.collect())


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_drain_of_nothing(spark, sf, mode):
    events = J.event_stream(spark, sf).where("event_id < 0")
    done = J.drain(events if mode == "append" else events.groupBy("user_id").agg(F.count("*").alias("n")), mode)
    assert done.count() == 0


def test_positions_are_saved_once_a_quiet_period(spark, tmp_path):
    """Two bursts of one reader and one of another give three rows; the table keeps the newest of each reader."""
    at = lambda minute, ms: dt.datetime(2024, 5, 1, 10, minute) + dt.timedelta(milliseconds=ms)
    moves = [(1, 7, k, 1.2, at(0, 100 * k), k) for k in range(5)] + [(1, 7, 10 + k, 1.0, at(1, 700 * k), 100 + k) for k in range(4)] + [(2, 7, 3, 0.8, at(2, 0), 200)]
    schema = "user_id long, doc long, k long, speed_raw double, ts timestamp, event_id long"
    batch = spark.createDataFrame(moves, schema)
    settled = sorted((r.user_id, r.position, r.speed) for r in J.settled_positions(batch).collect())
    assert settled == [(1, 4, 1.25), (1, 13, 1.0), (2, 3, 0.75)]
    for part in range(3):  # each file is a batch; the last one only moves the watermark on
        rows = [m for m in moves if m[4].minute == part] + ([(9, 9, 0, 1.0, at(59, 0), 999)] if part == 2 else [])
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/moves")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/moves")
    table = J.positions_table(spark, f"{tmp_path}/table")
    reached = J.finished(J.save_positions(stream, table, f"{tmp_path}/state", late="1 second"))
    saved = {r.user_id: r.position for r in table.read().collect()}
    assert saved == {1: 13, 2: 3}  # the reader whose burst isn't over is held back
    J.flush_positions(spark.read.schema(schema).parquet(f"{tmp_path}/moves"), table, reached)
    assert {r.user_id: r.position for r in table.read().collect()} == {1: 13, 2: 3, 9: 0}


def test_a_batch_writes_its_buckets(spark, tmp_path):
    """What a batch writes follows the buckets it touches; a version that is written again replaces itself; a restart finds all."""
    table = KeyedTable(spark, "k long, v string", ["k"], f"{tmp_path}/t", buckets=64)
    size = lambda v: sum(f.stat().st_size for f in (tmp_path / "t" / f"version={v}").rglob("*.parquet"))
    table.upsert(spark.range(20_000).selectExpr("id as k", "sha2(string(id), 256) as v"), 0)
    for _ in range(2):
        table.upsert(spark.createDataFrame([(5, "new"), (30_000, "more")], "k long, v string"), 1)
    assert size(1) < size(0) / 20
    table.upsert(spark.createDataFrame([], "k long, v string"), 2)
    for known in (table, KeyedTable(spark, "k long, v string", ["k"], f"{tmp_path}/t", buckets=64).attach()):
        got = {r.k: r.v for r in known.read().collect()}
        assert len(got) == 20_001 and got[5] == "new" and got[30_000] == "more" and got[6] == hashlib.sha256(b"6").hexdigest()
    table.upsert(spark.createDataFrame([(5, "a"), (7, "zzz")], "k long, v string"), 3, F.col("v"))
    got = {r.k: r.v for r in table.read().where("k in (5, 7)").collect()}
    assert got == {5: "new", 7: "zzz"}  # the larger one stays


def test_rows_are_made_once(spark, tmp_path):
    """However often the table looks at a batch, the stream's state is gone through once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    table = KeyedTable(spark, "k long, v string", ["k"], f"{tmp_path}/t")
    for version in range(2):
        table.upsert(spark.range(100).selectExpr("id as k", "'x' as v").mapInPandas(count, "k long, v string"), version)
    assert seen.value == 200 and table.read().count() == 100


def test_highlights_in_any_order_of_batches(spark, sf, tmp_path):
    """A log cut into batches in mixed order gives what the whole log gives: events wait until the watermark passes them."""
    log = highlight_log(spark, sf)
    want = sorted(map(tuple, apply_highlight_log(log).collect()))
    ranked = log.withColumn("day", F.dayofmonth("ts")).withColumn("part", F.expr("case when day % 5 = 0 then day + 1 when day % 5 = 1 then day - 1 else day end"))
    for part in [r.part for r in ranked.select("part").distinct().orderBy("part").collect()]:
        ranked.where(F.col("part") == part).drop("day", "part").orderBy(F.rand(part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 5).parquet(f"{tmp_path}/log")
    table, checkpoint = J.highlights_table(spark, f"{tmp_path}/table"), f"{tmp_path}/state"
    J.save_highlights(stream, table, checkpoint, late="4 days").awaitTermination()
    assert len(table.versions) > 2 and J.waiting_events(spark, checkpoint).count() > 0
    got = sorted(map(tuple, J.flush_highlights(table, checkpoint).select("user_id", "doc", "para", "id", "start", "end", "colour").collect()))
    assert got == want and want


def test_registered_highlights(spark, sf):
    from lectern.plans.stream_queries import str3

    want = sorted(map(tuple, apply_highlight_log(highlight_log(spark, sf)).collect()))
    assert sorted(map(tuple, str3(spark, sf).select("user_id", "doc", "para", "id", "start", "end", "colour").collect())) == want


def test_dedup_forgets_behind_its_watermark(spark, tmp_path):
    """Within the bound a key comes once; beyond it the key is let through again, as stated."""
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    for k, d in ((1, 0), (1, 5), (2, 100), (2, 200), (1, 300)):
        spark.createDataFrame([(k, day(d))], "k long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sorted((r.k, r.ts) for r in J.drain(J.dedup(stream, ["k"]), "append").collect())
    assert got == [(1, day(0)), (1, day(300)), (2, day(100))]
