"""Queries of work-lists and cache accounting."""
import uuid

from pyspark.sql import functions as F

from lectern.operators import hooks as H
from lectern.operators import worklist as W
from lectern.streaming.tables import shared_folder

from .registry import query, table

BASE = """
paras AS (SELECT conv_id AS reader, turn AS para, text FROM conversations),
speed_rows AS (SELECT DISTINCT conv_id AS reader, unnest([1.0, 0.75 + conv_id % 6 * 0.25, CASE WHEN conv_id % 2 = 0 THEN 1.5 ELSE 9.0 END]::DOUBLE[]) AS speed FROM conversations),
speeds AS (SELECT DISTINCT reader, speed FROM speed_rows WHERE speed IN (0.75, 1.0, 1.25, 1.5, 1.75, 2.0)),
focus AS (SELECT reader, reader * 3 % 8 AS position, 1.0::DOUBLE AS active FROM (SELECT DISTINCT reader FROM paras)),
done AS (SELECT reader, para, speed FROM paras JOIN speeds USING (reader) WHERE (reader + para) % 5 = 0),
plan0 AS (SELECT p.reader, p.para, s.speed, least(position, n - 1) AS cur, active FROM paras p JOIN speeds s USING (reader) JOIN focus f USING (reader) JOIN (SELECT reader, count(*) AS n FROM paras GROUP BY reader) USING (reader)),
plan AS (SELECT reader, para, speed, CAST(row_number() OVER (PARTITION BY reader ORDER BY CASE WHEN para < cur THEN 4 WHEN para < cur + 3 THEN 0 ELSE 2 END + CASE WHEN speed = active THEN 0 ELSE 1 END, para, speed) AS BIGINT) AS rank
  FROM plan0 ANTI JOIN done USING (reader, para, speed))"""


def inputs(spark, sf):
    c = table(spark, sf, "conversations")
    paras = c.select(F.col("conv_id").alias("reader"), F.col("turn").alias("para"), "text")
    readers = paras.select("reader").distinct()
    chosen = readers.select("reader", F.explode(F.expr("array(cast(0.75 + reader % 6 * 0.25 as double), cast(if(reader % 2 = 0, 1.5, 9.0) as double))")).alias("speed"))
    focus = readers.select("reader", F.expr("reader * 3 % 8").alias("position"), F.lit(1.0).alias("active"))
    speeds = W.enabled_speeds(chosen, focus.select("reader", F.col("active").alias("speed")))
    done = paras.join(speeds, "reader").where("(reader + para) % 5 = 0").select("reader", "para", "speed")
    return paras, speeds, focus, done


@query("wrk1_enabled_speeds", f"WITH {BASE} SELECT reader, speed FROM speeds")
def wrk1(spark, sf):
    return inputs(spark, sf)[1]


@query("wrk2_synthesis_worklist", f"WITH {BASE} SELECT reader, para, speed, rank FROM plan")
def wrk2(spark, sf):
    return W.synthesis_worklist(*inputs(spark, sf))


@query("wrk3_urgent_first", f"""WITH {BASE}, q AS (SELECT reader, para, speed, reader * 10 + para + CAST(speed * 4 AS BIGINT) AS asked FROM paras JOIN speeds USING (reader) WHERE (reader + para) % 7 = 0),
failed AS (SELECT reader, para, speed FROM paras JOIN speeds USING (reader) WHERE (reader * 3 + para) % 4 = 1),
a AS (SELECT reader, para, speed, max(asked) AS asked, NULL::BIGINT AS p FROM q ANTI JOIN done USING (reader, para, speed) GROUP BY reader, para, speed),
u AS (SELECT * FROM a UNION ALL SELECT reader, para, speed, NULL, rank FROM plan ANTI JOIN failed USING (reader, para, speed) ANTI JOIN a USING (reader, para, speed))
SELECT reader, para, speed, asked IS NOT NULL AS urgent, CAST(row_number() OVER (PARTITION BY reader ORDER BY asked DESC NULLS LAST, p NULLS FIRST, para, speed) AS BIGINT) AS rank FROM u""")
def wrk3(spark, sf):
    paras, speeds, focus, done = inputs(spark, sf)
    jobs = paras.join(speeds, "reader").select("reader", "para", "speed")
    asked = jobs.where("(reader + para) % 7 = 0").withColumn("asked", F.expr("reader * 10 + para + cast(speed * 4 as bigint)"))
    return W.urgent_first(W.synthesis_worklist(paras, speeds, focus, done), asked, jobs.where("(reader * 3 + para) % 4 = 1"), done)


@query("wrk4_coverage", f"""WITH {BASE} SELECT p.reader, count(d.reader) AS done, count(*) AS total FROM paras p JOIN speeds s ON p.reader = s.reader LEFT JOIN done d ON d.reader = p.reader AND d.para = p.para AND d.speed = s.speed GROUP BY p.reader""")
def wrk4(spark, sf):
    paras, speeds, _, done = inputs(spark, sf)
    return W.coverage(paras, speeds, done)


def assets(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("lang").alias("owner"), "source", F.concat_ws("/", "lang", "source", F.expr("cast(doc_id % 10 as string)")).alias("chapter"), F.col("n_chars").alias("bytes"), F.expr("doc_id * 37 % 1009").alias("last_used"))


@query("wrk5_cache_sizes", "SELECT source AS chapter, CAST(sum(n_chars) AS BIGINT) AS bytes, max(doc_id * 37 % 1009) AS last_used FROM documents GROUP BY ROLLUP (source)")
def wrk5(spark, sf):
    return W.cache_sizes(assets(spark, sf).withColumn("chapter", F.col("source")))


def sizes(spark, sf):
    return assets(spark, sf).groupBy("owner", "chapter").agg(F.sum("bytes").alias("bytes"), F.max("last_used").alias("last_used"))


_SIZED = "sized AS (SELECT lang AS owner, lang || '/' || source || '/' || (doc_id % 10) AS chapter, CAST(sum(n_chars) AS BIGINT) AS bytes, max(doc_id * 37 % 1009) AS last_used FROM documents GROUP BY 1, 2)"


@query("wrk6_evict_lru", f"""WITH {_SIZED}, t AS (SELECT *, sum(bytes) OVER (PARTITION BY owner) AS total FROM sized),
b AS (SELECT *, sum(bytes) OVER (PARTITION BY owner ORDER BY last_used, chapter ROWS UNBOUNDED PRECEDING) - bytes AS before FROM t WHERE chapter <> 'en/src1/1')
SELECT owner, chapter, bytes FROM b WHERE total - before > 60000""")
def wrk6(spark, sf):
    return W.evict_lru(sizes(spark, sf), 60000, "en/src1/1")


@query("wrk7_emergency_evict", f"WITH {_SIZED} SELECT owner, count(*) AS chapters, CAST(sum(bytes) AS BIGINT) AS bytes FROM sized WHERE chapter <> 'en/src1/1' GROUP BY owner")
def wrk7(spark, sf):
    return W.emergency_evict(sizes(spark, sf), "en/src1/1")


@query("wrk8_pending_pages", """SELECT conv_id AS doc, turn AS page FROM conversations c JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) USING (conv_id)
WHERE NOT (conv_id % 3 = 0 AND conv_id % 4 <> 1 AND n % 5 <> 0 AND turn % 2 = 0)""")
def wrk8(spark, sf):
    c = table(spark, sf, "conversations")
    n = c.groupBy("conv_id").agg(F.count("*").alias("n_pages"))
    pages = c.join(n, "conv_id").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.lit("s1").alias("signature"), "n_pages")
    runs = n.where("conv_id % 3 = 0").select(F.col("conv_id").alias("doc"), F.expr("if(conv_id % 4 = 1, 's0', 's1')").alias("signature"), F.expr("if(n_pages % 5 = 0, n_pages - 1, n_pages)").alias("n_pages"))
    return W.pending_pages(pages, runs, pages.where("page % 2 = 0").select("doc", "page"))


@query("wrk9_failed_pages", """WITH e AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page,
  CASE WHEN event_type IN ('click', 'view') THEN 'fail' WHEN event_type = 'signup' THEN 'saved' ELSE 'ok' END AS status FROM events),
w AS (SELECT *, sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING) AS run FROM e WHERE status <> 'saved'),
s AS (SELECT *, sum(CASE WHEN status = 'fail' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, run ORDER BY page ROWS UNBOUNDED PRECEDING) AS streak FROM w),
a AS (SELECT doc, min(page) AS aborted_at FROM s WHERE streak >= 3 GROUP BY doc)
SELECT e.doc, coalesce(list(page ORDER BY page) FILTER (status = 'fail' AND (aborted_at IS NULL OR page < aborted_at)), []) AS failed,
  count(*) FILTER (status = 'saved' AND (aborted_at IS NULL OR page < aborted_at)) AS reused, any_value(aborted_at) AS aborted_at FROM e LEFT JOIN a ON e.doc = a.doc GROUP BY e.doc""")
def wrk9(spark, sf):
    return W.failed_pages(table(spark, sf, "events").select(
        F.col("user_id").alias("doc"), F.expr("cast(row_number() over (partition by user_id order by event_id) as bigint)").alias("page"),
        F.expr("case when event_type in ('click', 'view') then 'fail' when event_type = 'signup' then 'saved' else 'ok' end").alias("status")))


@query("wrk10_run_progress", """SELECT event_id, event_id % 20 + 1 AS page, event_id % 23 + 1 AS pages, CASE WHEN event_id % 2 = 0 THEN 'layout' ELSE 'ocr' END AS stage, (event_id % 8) / 8.0::DOUBLE AS frac,
  CAST(greatest(0, least(100, floor(100 * ((event_id % 20) + (CASE WHEN event_id % 2 = 0 THEN 20 * ((event_id % 8) / 8.0::DOUBLE) ELSE 20 + 50 * ((event_id % 8) / 8.0::DOUBLE) END) / 70) / (event_id % 23 + 1)))) AS BIGINT) AS percent FROM events""")
def wrk10(spark, sf):
    return W.run_progress(table(spark, sf, "events").select("event_id", F.expr("event_id % 20 + 1").alias("page"), F.expr("event_id % 23 + 1").alias("pages"),
                                                            F.expr("if(event_id % 2 = 0, 'layout', 'ocr')").alias("stage"), F.expr("cast(event_id % 8 / 8.0D as double)").alias("frac")))


@query("wrk11_reuse_audio", """SELECT conv_id, turn, substr(sha1(text), 1, 16) AS hash, EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id % 3 = 0 AND a.turn = c.turn AND substr(sha1(a.text), 1, 16) = substr(sha1(c.text), 1, 16)) AS reused FROM conversations c""")
def wrk11(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.substring(F.sha1("text"), 1, 16).alias("hash"))
    return W.reuse_audio(c, c.where("conv_id % 3 = 0"), ["hash", "turn"])


def _worn_engine(page):
    """A recogniser that fails on some pages, and on all behind the fifth of every fourth document."""
    if page["page"] % 7 == 3 or page["doc"] % 4 == 0 and page["page"] >= 5:
        raise ValueError("unreadable")
    return f"read {page['text']}"


_PAGES = "p AS (SELECT conv_id AS doc, turn AS page, text, turn % 7 = 3 OR conv_id % 4 = 0 AND turn >= 5 AS bad FROM conversations)"
_STOPS = """r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING) AS run FROM p),
s AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY doc, run ORDER BY page ROWS UNBOUNDED PRECEDING) AS streak FROM r), a AS (SELECT doc, min(page) AS aborted_at FROM s WHERE streak >= 3 GROUP BY doc)"""


def _pages(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text", F.lit("s1").alias("signature"))
    return c.join(c.groupBy("doc").agg(F.count("*").alias("n_pages")), "doc")


def _kept(spark):
    def keep(rows):
        path = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    return keep


def _first_run(spark, sf):
    pages = _pages(spark, sf)
    none = pages.select("doc", "signature", "n_pages").limit(0)
    return pages, H.recognition_run(pages, _worn_engine, none, pages.select("doc", "page", "text").limit(0), _kept(spark), block=4)


@query("wrk12_recognition_run", f"""WITH {_PAGES}, {_STOPS} SELECT p.doc, page, CASE WHEN bad THEN 'fail' ELSE 'ok' END AS status, CASE WHEN NOT bad THEN 'read ' || text END AS text, CASE WHEN bad THEN 'ValueError: unreadable' END AS error
FROM p LEFT JOIN a USING (doc) WHERE aborted_at IS NULL OR page < aborted_at""")
def wrk12(spark, sf):
    return _first_run(spark, sf)[1][0]


@query("wrk12_resumed_run", f"""WITH {_PAGES}, {_STOPS} SELECT p.doc, page, CASE WHEN NOT bad AND (aborted_at IS NULL OR page < aborted_at) THEN 'saved' ELSE 'ok' END AS status, 'read ' || text AS text FROM p LEFT JOIN a USING (doc)""")
def wrk12b(spark, sf):
    """A second run with an engine that reads all goes on where the first one stopped."""
    pages, (results, _) = _first_run(spark, sf)
    runs = pages.select("doc", "signature", "n_pages").distinct()
    again, _ = H.recognition_run(pages, lambda page: f"read {page['text']}", runs, results.where("status = 'ok'"), _kept(spark), block=4)
    return again.select("doc", "page", "status", "text")


@query("wrk13_synthesis_run", """WITH c AS (SELECT DISTINCT substr(sha1(text), 1, 16) AS hash, turn, text FROM conversations), a AS (SELECT DISTINCT substr(sha1(text), 1, 16) AS hash, turn FROM conversations WHERE conv_id % 3 = 0)
SELECT hash, turn, CASE WHEN a.hash IS NOT NULL THEN 'reused' WHEN length(text) % 11 = 0 THEN 'fail' ELSE 'made' END AS status,
  CASE WHEN a.hash IS NOT NULL THEN 1 WHEN length(text) % 11 > 0 THEN length(text) END AS size FROM c LEFT JOIN a USING (hash, turn)""")
def wrk13(spark, sf):
    def speak(request):
        if len(request["text"]) % 11 == 0:
            raise RuntimeError("no voice")
        return b"." * len(request["text"])

    c = table(spark, sf, "conversations").select("conv_id", "turn", F.substring(F.sha1("text"), 1, 16).alias("hash"), "text")
    assets = c.where("conv_id % 3 = 0").select("hash", "turn", F.lit(b"x").alias("audio"))
    done = H.synthesise_paragraphs(c, speak, assets, ["hash", "turn"])
    return done.select("hash", "turn", "status", F.octet_length("audio").cast("long").alias("size"))
