"""Streaming jobs. Each is a function from a streaming DataFrame to one, the same as on a batch where the semantics allow it;
``drain`` runs a job over the files that are there and returns what it wrote."""
from __future__ import annotations

import uuid
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lectern.functions.text import nearest_speed
from lectern.operators.state import EVENT, apply_highlight_log, latest_positions, play_highlight_log
from lectern.streaming.tables import KeyedTable, shared_folder


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The rows of a table's files as a stream; event time as TIMESTAMP."""
    path = f"{sf_dir}/{name}.parquet"
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    one_file = any(f.endswith(f"/{name}.parquet") for f in batch.inputFiles()[:1])  # a stream reads folders
    stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if one_file else reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in batch.columns else stream


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run to the end of the available files into Parquet files in the folder of ``spark.checkpoint.dir`` and return those.
    In append mode the file sink collects all batches; in complete mode each batch is a version and the newest counts; in update
    mode all versions are there, with their number as ``batch``."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/drained-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{at}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")
    newest = None

    def write(batch: DataFrame, number: int) -> None:
        nonlocal newest
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
        newest = number

    writer.foreachBatch(write).start().awaitTermination()
    if mode == "update" and newest is not None:
        return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{at}/out")
    return spark.createDataFrame([], stream.schema) if newest is None else spark.read.schema(stream.schema).parquet(f"{at}/out/batch={newest}")


def finished(run: StreamingQuery) -> int | None:
    """Wait for the end of what is there; the watermark reached, in milliseconds (null without one)."""
    run.awaitTermination()
    marks = [p["eventTime"].get("watermark") for p in run.recentProgress]
    known = [pd.Timestamp(m) for m in marks if m]
    return int(max(known).timestamp() * 1000) if known else None


POSITION = "user_id long, doc long, position long, speed double, ts timestamp, event_id long"


def settled_positions(moves: DataFrame, quiet: str = "800 milliseconds", late: str = "1 day") -> DataFrame:
    """moves(user_id, doc, k, speed_raw, ts, event_id) -> the last position of each burst, once no move has come for ``quiet``: the
    bursts are session windows, so on a stream one row comes out for each, however many moves it had. Moves that come later than
    ``late`` behind the newest are passed over, as they would be older than what is saved."""
    rows = moves.withWatermark("ts", late) if moves.isStreaming else moves
    burst = rows.groupBy("user_id", "doc", F.session_window("ts", quiet).alias("_w")).agg(F.max_by(F.struct("k", "speed_raw", "ts", "event_id"), F.struct("ts", "event_id")).alias("_l"))
    return burst.select("user_id", "doc", F.col("_l.k").cast("long").alias("position"), nearest_speed("_l.speed_raw").alias("speed"), "_l.ts", "_l.event_id")


def positions_table(spark: SparkSession, path: str | None = None) -> KeyedTable:
    return KeyedTable(spark, POSITION, ["user_id", "doc"], path)


def save_positions(moves: DataFrame, table: KeyedTable, checkpoint: str, quiet: str = "800 milliseconds", late: str = "1 day") -> StreamingQuery:
    """Start keeping the positions of settled bursts: each batch replaces the rows of its keys, unless newer ones are there."""
    def write(batch: DataFrame, number: int) -> None:
        table.upsert(batch, number, F.struct("ts", "event_id"))

    settled = settled_positions(moves, quiet, late)
    return settled.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush_positions(moves: DataFrame, table: KeyedTable, watermark: int | None, quiet_ms: int = 800) -> None:
    """On closing: what the stream holds back behind its watermark is saved from the moves themselves."""
    tail = moves if watermark is None else moves.where(F.unix_millis(F.col("ts").cast("timestamp")) >= watermark - quiet_ms)
    table.upsert(settled_positions(tail), max(table.versions, default=-1) + 1, F.struct("ts", "event_id"))


def positions(events: DataFrame) -> DataFrame:
    """Latest position of each reader and document; update or complete mode."""
    return latest_positions(events)


def toggles(events: DataFrame) -> DataFrame:
    """Whether each item was toggled an odd number of times; update or complete mode."""
    return events.groupBy("user_id", "doc", "k").agg((F.count("*") % 2 == 1).alias("on"))


def save_toggles(events: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Start keeping toggles: a batch brings the items it touched, and only their buckets are written."""
    def write(batch: DataFrame, number: int) -> None:
        table.upsert(batch, number)

    return toggles(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_stale(results: DataFrame, generations: DataFrame, late: str = "1 day") -> DataFrame:
    """Results of the current generation only: a stream against a static table of generations(user_id, generation)."""
    return results.withWatermark("ts", late).join(generations, ["user_id", "generation"], "left_semi" if not results.isStreaming else "inner")


def dedup(results: DataFrame, keys: list[str], late: str = "40 days") -> DataFrame:
    """Each key once within the watermark: a key that comes again more than ``late`` later is let through again, as its state is gone
    by then. On a batch each key comes out once."""
    return results.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if results.isStreaming else results.dropDuplicates(keys)


def listening_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, events) of episodes with no pause of ``gap``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    s = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def progress_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, event_type, items) by tumbling or sliding windows."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("items")).select(F.col("w.start").alias("start"), "event_type", "items")


MARKED = "user_id long, doc long, para long, next long, items array<struct<id: long, start: long, end: long, colour: string>>"


def released_events(log: DataFrame, late: str = "1 day") -> DataFrame:
    """log(user_id, doc, para, ts, seq, op, start, end, colour, target), a stream -> its events, each once the watermark has passed it,
    whichever batch it came in; append mode. An event is a group of its own in the state until then. Events that come later than
    ``late`` behind the newest are passed over."""
    return log.withWatermark("ts", late).groupBy("user_id", "doc", "para", "ts", "seq", *EVENT).agg(F.count("*").alias("_n")).drop("_n")


def highlights_table(spark: SparkSession, path: str | None = None) -> KeyedTable:
    return KeyedTable(spark, MARKED, ["user_id", "doc", "para"], path)


#: Events that wait are kept by this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def save_highlights(log: DataFrame, table: KeyedTable, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Start keeping highlights: each batch plays the events it releases, in the order of their numbers, on what the table holds of
    their paragraphs and replaces those rows. Numbers follow times."""
    def write(batch: DataFrame, number: int) -> None:
        table.upsert(play_highlight_log(batch.persist(), table.before(number)), number)  # persisted: the state is gone through once
        batch.unpersist()

    conf, key = log.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, STORE)
    try:
        return released_events(log, late).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, before)


def waiting_events(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The log's events that wait for the watermark, read from the state of a stopped stream."""
    kept = spark.read.format("statestore").option("path", checkpoint).load()
    return kept.select(*[F.col(f"key.{c}").alias(c) for c in ("user_id", "doc", "para", "seq", *EVENT)])


def flush_highlights(table: KeyedTable, checkpoint: str) -> DataFrame:
    """On closing: all highlights, those of the table with the waiting events played on top."""
    kept, late = table.read(), waiting_events(table.spark, checkpoint)
    still = kept.join(late.select("user_id", "doc", "para").distinct(), ["user_id", "doc", "para"], "left_anti")
    flat = still.select("user_id", "doc", "para", F.inline("items"))
    return flat.unionByName(apply_highlight_log(late, kept))


def incremental_extract(pages: DataFrame, extract, path: str, checkpoint: str):
    """Start extracting new pages; finished ones stay on disk and a restart goes on behind them."""
    return extract(pages).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
