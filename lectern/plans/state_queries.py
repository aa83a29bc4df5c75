"""Queries of reading state."""
from pyspark.sql import functions as F

from lectern.operators import state as A
from lectern.sources import fixtures as S

from .registry import query, table

R = S.READING
LIB = R + """,
library AS (SELECT user_id, doc, max(ts) AS opened, CASE WHEN doc % 2 = 0 THEN 'file' ELSE 'task' END AS kind FROM reading WHERE action = 'open' AND event_id % 3 <> 0 GROUP BY user_id, doc)"""


def library(spark, sf):
    return S.reading_events(spark, sf).where("action = 'open' and event_id % 3 <> 0").groupBy("user_id", "doc").agg(F.max("ts").alias("opened")).withColumn(
        "kind", F.expr("case when doc % 2 = 0 then 'file' else 'task' end"))


@query("sta1_register_documents", """
WITH o AS (SELECT doc_id, source AS title, lang AS kind, sha1(text) AS text_hash, doc_id AS opened, doc_id % 50 AS position, [doc_id % 5, 7] AS bookmarks FROM documents WHERE doc_id % 3 <> 0),
n AS (SELECT doc_id, source || '!' AS title, lang AS kind, sha1(CASE WHEN doc_id % 4 = 0 THEN text || '.' ELSE text END) AS text_hash, doc_id + 5 AS opened FROM documents WHERE doc_id % 2 = 0)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.title, o.title) AS title, coalesce(n.kind, o.kind) AS kind, coalesce(n.text_hash, o.text_hash) AS text_hash, greatest(o.opened, n.opened) AS opened,
  CAST(CASE WHEN coalesce(o.text_hash = n.text_hash, false) OR n.doc_id IS NULL THEN o.position ELSE 0 END AS BIGINT) AS position,
  CASE WHEN coalesce(o.text_hash = n.text_hash, false) OR n.doc_id IS NULL THEN o.bookmarks ELSE []::BIGINT[] END AS bookmarks FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def sta1(spark, sf):
    d = table(spark, sf, "documents")
    old = d.where("doc_id % 3 <> 0").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("kind"), F.sha1("text").alias("text_hash"), F.col("doc_id").alias("opened"),
                                            F.expr("doc_id % 50").alias("position"), F.expr("array(doc_id % 5, 7L)").alias("bookmarks"))
    new = d.where("doc_id % 2 = 0").select("doc_id", F.concat("source", F.lit("!")).alias("title"), F.col("lang").alias("kind"),
                                           F.sha1(F.expr("case when doc_id % 4 = 0 then concat(text, '.') else text end")).alias("text_hash"), (F.col("doc_id") + 5).alias("opened"))
    return A.register_documents(old, new)


@query("sta2_latest_positions", f"""WITH {R}, m AS (SELECT user_id, doc, arg_max(struct_pack(k := k, s := speed_raw, ts := ts), (ts, event_id)) AS l FROM reading WHERE action = 'position' GROUP BY user_id, doc)
SELECT user_id, doc, l.k AS position, list_min(list_transform([0.75, 1.0, 1.25, 1.5, 1.75, 2.0]::DOUBLE[], lambda s: {{'d': abs(s - l.s), 's': s}})).s AS speed, l.ts AS ts FROM m""")
def sta2(spark, sf):
    return A.latest_positions(S.reading_events(spark, sf).where("action = 'position'"))


@query("sta3_touch", f"""WITH {LIB}, o AS (SELECT user_id, doc, max(ts) AS t FROM reading WHERE action = 'open' GROUP BY user_id, doc)
SELECT l.user_id, l.doc, kind, greatest(opened, t) AS opened FROM library l LEFT JOIN o ON l.user_id = o.user_id AND l.doc = o.doc""")
def sta3(spark, sf):
    return A.touch(library(spark, sf), S.reading_events(spark, sf).where("action = 'open'"))


@query("sta4_list_library", f"""WITH {LIB} SELECT user_id, doc, opened, 'Document ' || doc || ' · ' || strftime(opened, '%Y-%m-%d') AS label FROM library WHERE kind = 'file' ORDER BY opened DESC, user_id, doc LIMIT 14""")
def sta4(spark, sf):
    return A.list_library(library(spark, sf), "file")


@query("sta5_prune_library", f"""WITH {LIB} SELECT user_id, doc, opened, kind FROM library QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY opened DESC NULLS LAST, doc) <= 2""")
def sta5(spark, sf):
    return A.prune_library(library(spark, sf), 2)


@query("sta6_remove_documents", f"""WITH {LIB} SELECT * FROM library ANTI JOIN (SELECT DISTINCT user_id, doc FROM reading WHERE action = 'fail') f USING (user_id, doc)""")
def sta6(spark, sf):
    return A.remove_documents(library(spark, sf), S.reading_events(spark, sf).where("action = 'fail'").select("user_id", "doc"), ["user_id", "doc"])


@query("sta7_toggle_state", f"""WITH {R}, o AS (SELECT user_id, doc, k % 10 AS k FROM reading WHERE action = 'toggle' GROUP BY user_id, doc, k % 10 HAVING count(*) % 2 = 1)
SELECT user_id, doc, list(k ORDER BY k) AS items FROM o GROUP BY user_id, doc""")
def sta7(spark, sf):
    return A.toggle_state(S.reading_events(spark, sf).where("action = 'toggle'").withColumn("k", F.expr("k % 10")), ["user_id", "doc"])


@query("sta8_ignore_state", f"""WITH {R}, r AS (SELECT doc, max((ts, event_id)) AS last FROM reading WHERE action = 'fail' AND k % 20 = 3 GROUP BY doc)
SELECT DISTINCT g.doc, k FROM reading g LEFT JOIN r ON g.doc = r.doc WHERE action = 'toggle' AND (last IS NULL OR (ts, event_id) > last)""")
def sta8(spark, sf):
    e = S.reading_events(spark, sf)
    return A.ignore_state(e.where("action = 'toggle'"), e.where("action = 'fail' and k % 20 = 3"))


_SIZES = "sizes AS (SELECT doc, CAST(20 + doc * 15 AS BIGINT) AS n FROM (SELECT DISTINCT doc FROM reading))"


@query("sta9_valid_flags", f"WITH {R}, {_SIZES} SELECT event_id, r.doc, k FROM reading r JOIN sizes s ON r.doc = s.doc WHERE action = 'toggle' AND k >= 0 AND k < n")
def sta9(spark, sf):
    e = S.reading_events(spark, sf)
    return A.valid_flags(e.where("action = 'toggle'").select("event_id", "doc", "k"), e.select("doc").distinct().withColumn("n", F.expr("20 + doc * 15")))


ADDS = R + """,
adds AS (SELECT user_id, doc, k % 5 AS para, event_id AS seq, least(c_start, c_end) AS start, least(greatest(c_start, c_end), 80) AS "end", CASE WHEN event_id % 3 = 0 THEN 'yellow' ELSE 'pink' END AS colour
  FROM reading WHERE action = 'highlight'),
okay AS (SELECT * FROM adds WHERE start >= 0 AND "end" > start),
pts AS (SELECT DISTINCT user_id, doc, para, unnest([start, "end"]) AS p FROM okay),
bits AS (SELECT * FROM (SELECT *, lead(p) OVER (PARTITION BY user_id, doc, para ORDER BY p) AS q FROM pts) WHERE q IS NOT NULL),
tops AS (SELECT b.user_id, b.doc, b.para, p, q, max(seq) AS seq, arg_max(colour, seq) AS colour FROM bits b JOIN okay a ON a.user_id = b.user_id AND a.doc = b.doc AND a.para = b.para AND a.start <= p AND a."end" >= q GROUP BY ALL),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, doc, para ORDER BY p) AS run FROM (SELECT *, CASE WHEN lag(seq) OVER o = seq AND lag(q) OVER o = p THEN 0 ELSE 1 END AS fresh FROM tops
  WINDOW o AS (PARTITION BY user_id, doc, para ORDER BY p))),
shown AS (SELECT user_id, doc, para, min(p) AS start, max(q) AS "end", first(colour) AS colour, first(seq) AS seq FROM runs GROUP BY user_id, doc, para, run)"""


def adds(spark, sf):
    return S.reading_events(spark, sf).where("action = 'highlight'").select(
        "user_id", "doc", F.expr("k % 5").alias("para"), F.col("event_id").alias("seq"), F.col("c_start").alias("start"), F.col("c_end").alias("end"),
        F.expr("case when event_id % 3 = 0 then 'yellow' else 'pink' end").alias("colour"), F.lit(80).cast("long").alias("text_length"))


PARA = ["user_id", "doc", "para"]


@query("sta10_overlay_highlights", f'WITH {ADDS} SELECT user_id, doc, para, start, "end", colour, seq FROM shown')
def sta10(spark, sf):
    return A.overlay_highlights(adds(spark, sf), PARA)


def highlight_log(spark, sf, events=None):
    e = S.reading_events(spark, sf, events).where("action in ('highlight', 'fail')")
    op = F.expr("case when action = 'highlight' then 'add' when k % 4 = 0 then 'clear' when k % 2 = 0 then 'remove' else 'recolour' end")
    return e.select("user_id", "doc", F.expr("k % 5").alias("para"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), op.alias("op"), F.col("c_start").alias("start"),
                    F.expr("least(c_end, 80L)").alias("end"), F.expr("case when event_id % 3 = 0 then 'yellow' else 'pink' end").alias("colour"), F.expr("k % 6").alias("target"))


@query("sta11_apply_highlight_log")
def sta11(spark, sf):
    return A.apply_highlight_log(highlight_log(spark, sf))


@query("sta12_highlights_at", f"""WITH {ADDS}, p AS (SELECT event_id, user_id, doc, k % 5 AS para, c_start AS "char" FROM reading)
SELECT p.*, s.start, s.colour FROM p LEFT JOIN shown s ON p.user_id = s.user_id AND p.doc = s.doc AND p.para = s.para AND s.start <= "char" AND "char" < s."end" """)
def sta12(spark, sf):
    probes = S.reading_events(spark, sf).select("event_id", "user_id", "doc", F.expr("k % 5").alias("para"), F.col("c_start").alias("char"))
    return A.highlights_at(probes, A.overlay_highlights(adds(spark, sf), PARA), PARA)


@query("sta12_highlight_counts", f"""WITH {ADDS} SELECT user_id, doc, count(*) AS highlights, count(DISTINCT para) AS paragraphs FROM shown GROUP BY user_id, doc""")
def sta12b(spark, sf):
    return A.overlay_highlights(adds(spark, sf), PARA).groupBy("user_id", "doc").agg(F.count("*").alias("highlights"), F.count_distinct("para").alias("paragraphs"))


@query("sta13_guard_by_text_hash", f"""WITH {R} SELECT event_id, doc, c_start AS start, c_end AS "end" FROM reading WHERE action = 'highlight' AND event_id % 7 <> 0 AND c_start >= 0 AND c_end > c_start""")
def sta13(spark, sf):
    e = S.reading_events(spark, sf)
    marks = e.where("action = 'highlight'").select("event_id", "doc", F.col("c_start").alias("start"), F.col("c_end").alias("end"),
                                                   F.sha1(F.expr("concat('text ', doc, if(event_id % 7 = 0, ' old', ''))")).alias("text_hash"))
    docs = e.select("doc").distinct().withColumn("text_hash", F.sha1(F.expr("concat('text ', doc)")))
    return A.guard_by_text_hash(marks, docs).drop("text_hash")


@query("sta14_import_legacy_flags", f"""WITH {R}, f AS (SELECT DISTINCT doc, k AS para FROM reading WHERE action = 'toggle'), h AS (SELECT DISTINCT doc, k AS para FROM reading WHERE action = 'highlight' AND event_id % 10 = 0)
SELECT doc, para, 0 AS start, CAST(para % 7 * 10 AS BIGINT) AS "end", 'yellow' AS colour FROM f WHERE para < 90 AND para % 7 > 0 AND (doc, para) NOT IN (SELECT (doc, para) FROM h)""")
def sta14(spark, sf):
    e = S.reading_events(spark, sf)
    lengths = e.select("doc").distinct().select("doc", F.explode(F.expr("sequence(0L, 89L)")).alias("para")).withColumn("length", F.expr("para % 7 * 10"))
    return A.import_legacy_flags(e.where("action = 'toggle'").select("doc", F.col("k").alias("para")), lengths,
                                 e.where("action = 'highlight' and event_id % 10 = 0").select("doc", F.col("k").alias("para")))


_DEFAULTS = ", ".join(f"('{k}', '{v}')" for k, v in A.DEFAULTS.items())


@query("sta15_flatten_settings", f"""
WITH s AS (SELECT event_id AS user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
v AS (SELECT user_id, k, CASE WHEN k % 3 = 0 THEN k / 40.0::DOUBLE WHEN k % 3 = 1 THEN k / 50.0::DOUBLE END AS speed, CASE WHEN k % 5 = 0 THEN 17 WHEN k % 5 = 1 THEN k END AS font FROM s)
SELECT user_id, key, CASE key
  WHEN 'playback.speed' THEN CASE WHEN speed IS NULL THEN '1.0' ELSE CAST(list_min(list_transform([0.75, 1.0, 1.25, 1.5, 1.75, 2.0]::DOUBLE[], lambda x: {{'d': abs(x - speed), 's': x}})).s AS VARCHAR) END
  WHEN 'playback.volume' THEN CASE WHEN k % 4 > 0 THEN CAST(least(100, k * 3) AS VARCHAR) ELSE '100' END
  WHEN 'reader.font_size' THEN CASE WHEN font IS NULL OR font = 17 THEN '18' ELSE CAST(greatest(12, least(28, font)) AS VARCHAR) END
  WHEN 'theme' THEN CASE WHEN k % 6 = 0 THEN 'light' ELSE 'dark' END WHEN 'voice' THEN CASE WHEN k % 7 = 0 THEN 'zf_001' WHEN k % 7 = 1 THEN 'own' ELSE 'af_heart' END
  WHEN 'device' THEN CASE WHEN k % 2 = 0 THEN 'GPU' ELSE 'CPU' END WHEN 'pdf.tables' THEN CASE WHEN k % 2 = 0 THEN 'false' ELSE 'true' END
  WHEN 'precache_speeds' THEN CASE WHEN k % 5 = 2 THEN '[1.0,1.25]' ELSE '[1.0]' END ELSE "default" END AS value
FROM v CROSS JOIN (VALUES {_DEFAULTS}) d(key, "default")""")
def sta15(spark, sf):
    v = table(spark, sf, "events").select(F.col("event_id").alias("user_id"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"))
    on = lambda rule, x: F.when(F.expr(rule), x)
    d = lambda x: F.expr(f"cast(k / {x} as double)")
    playback = F.struct(on("k % 3 = 0", d("40.0D")).alias("speed"), on("k % 4 > 0", F.col("k") * 3).alias("volume"))
    pdf = F.struct(on("k % 2 = 0", F.lit(False)).otherwise(F.lit(True)).alias("tables"), F.lit(1).alias("unknown"))
    whole = F.struct(
        playback.alias("playback"), pdf.alias("pdf"), on("k % 6 = 0", "light").when(F.expr("k % 6 = 1"), "pink").alias("theme"),
        on("k % 7 = 0", "zf_xiaobei").when(F.expr("k % 7 = 1"), "own").alias("voice"), on("k % 2 = 0", "GPU").otherwise("TPU").alias("device"),
        on("k % 5 = 2", F.array(F.lit("1.25"), F.lit("1.0"), F.lit("9"), F.lit("x"))).alias("precache_speeds"), on("k % 3 = 1", d("50.0D")).alias("speed"),
        on("k % 5 = 0", F.lit(17)).when(F.expr("k % 5 = 1"), F.col("k").cast("int")).alias("font_size"), F.lit("me").alias("user_name"))
    return A.flatten_settings(v.select("user_id", F.to_json(whole).alias("json")))


@query("sta16_clean_speeds", """WITH s AS (SELECT event_id AS user_id, unnest([event_id % 9 * 0.25, 1.25, 1.25, event_id % 7 * 0.25, 7.0]::DOUBLE[]) AS v FROM events)
SELECT user_id, list(DISTINCT v ORDER BY v) AS speeds FROM s WHERE v IN (0.75, 1.0, 1.25, 1.5, 1.75, 2.0) GROUP BY user_id""")
def sta16(spark, sf):
    return A.clean_speeds(table(spark, sf, "events").select(F.col("event_id").alias("user_id"), F.expr(
        "array(cast(event_id % 9 * 0.25 as string), '1.25', '1.25', cast(event_id % 7 * 0.25 as string), '7.0', 'junk')").alias("speeds")))


#: Ids of all kinds with what they mean: presets of every language, renamed ones, unknown ones, packs with and without a language.
_VOICES = (
    ("af_heart", "af_heart", "Heart · US female", "en-us", "US", "female"), ("am_puck", "am_puck", "Puck · US male", "en-us", "US", "male"),
    ("bm_george", "bm_george", "George · UK male", "en-gb", "UK", "male"), ("bf_isabella", "bf_isabella", "Isabella · UK female", "en-gb", "UK", "female"),
    ("ef_dora", "ef_dora", "Dora · ES female", "es", "ES", "female"), ("ff_siwis", "ff_siwis", "Siwis · FR female", "fr-fr", "FR", "female"),
    ("im_nicola", "im_nicola", "Nicola · IT male", "it", "IT", "male"), ("pf_dora", "pf_dora", "Dora · PT female", "pt", "PT", "female"),
    ("jm_kumo", "jm_kumo", "Kumo · JP male", "ja", "JP", "male"), ("zf_004", "zf_004", "004 · ZH female", "zh", "ZH", "female"),
    ("zf_xiaobei", "zf_001", "001 · ZH female", "zh", "ZH", "female"), ("zm_yunxi", "zm_009", "009 · ZH male", "zh", "ZH", "male"),
    ("zf_nope", "zf_nope", "Nope · ZH female", "en-us", "ZH", "female"), ("hf_x", "hf_x", "X ·  female", "en-us", "", "female"),
    ("xx_odd_one2b", "xx_odd_one2b", "Odd_One2B ·  male", "en-us", "", "male"), ("plain", "plain", "Plain · PT male", "en-us", "PT", "male"),
    ("pack:mine", "pack:mine", "mine (voice pack)", "pt", None, None), ("pack:lost", "pack:lost", "lost (voice pack)", "en-us", None, None),
    ("pack:bare", "pack:bare", "bare (voice pack)", "en-us", None, None))
_QUOTED = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in (i, *v)) + ")" for i, v in enumerate(_VOICES))


@query("sta17_resolve_voices", f"""SELECT event_id AS request_id, voice, label, language, region, gender
FROM events JOIN (VALUES {_QUOTED}) v(i, asked, voice, label, language, region, gender) ON event_id % {len(_VOICES)} = i""")
def sta17(spark, sf):
    voices = F.array(*[F.lit(v[0]) for v in _VOICES])
    requests = table(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.element_at(voices, F.expr(f"cast(event_id % {len(_VOICES)} + 1 as int)")).alias("voice"))
    packs = spark.createDataFrame([("mine", "pt"), ("bare", None)], "name string, lang string")
    return A.resolve_voices(requests, packs)


@query("sta18_blend_recipes", """WITH v AS (SELECT vec_id, vec_id % 40 AS a, vec_id % 7 AS b FROM embeddings), p AS (SELECT vec_id AS recipe_id, 'af_heart' AS voice, a::DOUBLE AS w FROM v WHERE a > 0
  UNION ALL SELECT vec_id, 'bm_' || (b % 3), b::DOUBLE FROM v WHERE b > 0)
SELECT recipe_id, voice, w / sum(w) OVER (PARTITION BY recipe_id) AS weight FROM p""")
def sta18(spark, sf):
    return A.blend_recipes(table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("recipe_id"), F.expr("concat('af_heart:', vec_id % 40, ', bm_', vec_id % 7 % 3, ':', vec_id % 7, ',bad voice:3,af_x:y')").alias("recipe")))


@query("sta18_valid_packs", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
def sta18b(spark, sf):
    packs = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("style"))
    return A.valid_packs(packs, 64).select("vec_id")
