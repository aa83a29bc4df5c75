"""Queries of the streaming jobs, run to the end of the events table."""
import uuid

from pyspark.sql import functions as F

from lectern.sources import fixtures as S
from lectern.sources import web as W
from lectern.streaming import jobs as J
from lectern.streaming.tables import KeyedTable, shared_folder

from . import state_queries
from .registry import ORACLE, query, table


def stream(spark, sf):
    return S.reading_events(spark, sf, J.event_stream(spark, sf))


def _checkpoint(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("str1_stream_positions", ORACLE["sta2_latest_positions"])
def str1(spark, sf):
    moves = lambda e: e.where("action = 'position'").select("user_id", "doc", "k", "speed_raw", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    kept = J.positions_table(spark)
    reached = J.finished(J.save_positions(moves(stream(spark, sf)), kept, _checkpoint(spark)))
    J.flush_positions(moves(S.reading_events(spark, sf)), kept, reached)
    return kept.read().select("user_id", "doc", "position", "speed", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("str2_stream_toggles", ORACLE["sta7_toggle_state"])
def str2(spark, sf):
    kept = KeyedTable(spark, "user_id long, doc long, k long, on boolean", ["user_id", "doc", "k"])
    J.save_toggles(stream(spark, sf).where("action = 'toggle'").withColumn("k", F.expr("k % 10")), kept, _checkpoint(spark)).awaitTermination()
    return kept.read().where("on").groupBy("user_id", "doc").agg(F.sort_array(F.collect_list("k")).alias("items"))


@query("str3_stream_highlights")
def str3(spark, sf):
    kept, checkpoint = J.highlights_table(spark), _checkpoint(spark)
    J.save_highlights(state_queries.highlight_log(spark, sf, J.event_stream(spark, sf)), kept, checkpoint).awaitTermination()
    return J.flush_highlights(kept, checkpoint)


@query("str4_drop_stale", f"WITH {S.READING} SELECT event_id, user_id, k % 3 AS generation FROM reading WHERE action = 'toggle' AND k % 3 = user_id % 3")
def str4(spark, sf):
    results = stream(spark, sf).where("action = 'toggle'").select("event_id", "ts", "user_id", F.expr("k % 3").alias("generation"))
    current = table(spark, sf, "events").select("user_id", F.expr("user_id % 3").alias("generation")).distinct()
    return J.drain(J.drop_stale(results, current), "append").drop("ts").select("event_id", "user_id", "generation")


@query("str5_stream_dedup", f"WITH {S.READING} SELECT DISTINCT user_id, doc, k % 10 AS k FROM reading WHERE action = 'toggle'")
def str5(spark, sf):
    rows = stream(spark, sf).where("action = 'toggle'").withColumn("k", F.expr("k % 10"))
    return J.drain(J.dedup(rows, ["user_id", "doc", "k"]), "append").select("user_id", "doc", "k")


@query("str6_listening_sessions", """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events FROM s GROUP BY user_id, n""")
def str6(spark, sf):
    done = J.drain(J.listening_sessions(J.event_stream(spark, sf)), "complete")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("str7_progress_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS items FROM events GROUP BY ALL")
def str7(spark, sf):
    done = J.drain(J.progress_counts(J.event_stream(spark, sf)), "complete")
    return done.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str7_sliding_counts", """SELECT w AS start, event_type, count(*) AS items FROM (SELECT event_type, unnest([date_trunc('hour', ts) - (date_part('hour', ts) % 6) * INTERVAL 1 HOUR - i * INTERVAL 6 HOUR FOR i IN range(4)]) AS w FROM events) GROUP BY ALL""")
def str7b(spark, sf):
    done = J.drain(J.progress_counts(J.event_stream(spark, sf), "1 day", "6 hours"), "complete")
    return done.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str8_incremental_extract", "SELECT page_id, length(url) AS n_url FROM pages")
def str8(spark, sf):
    at = f"{shared_folder(spark)}/extract-{uuid.uuid4().hex}"
    run = J.incremental_extract(J.event_stream(spark, sf, "pages"), lambda p: p.select("page_id", "url", W.page_title("html", "url").alias("title")), f"{at}/out", f"{at}/state")
    run.awaitTermination()
    return spark.read.parquet(f"{at}/out").select("page_id", F.length("url").alias("n_url"))
