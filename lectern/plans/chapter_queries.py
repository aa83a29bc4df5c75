"""Queries of chapters and exports."""
import uuid

from pyspark.sql import functions as F

from lectern.operators import chapters as C
from lectern.operators import timeline as T
from lectern.sources import fixtures as S
from lectern.sources import sinks as K
from lectern.sources import web as W
from lectern.streaming.tables import shared_folder

from .registry import ORACLE, query, table

_NAMES = ["Genesis", "Exodus 3", "Part II: The Sea", "Prologue", "Ruth", "Mark", "第三章", "John"]
_LIST = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
MARKED = S.BOOKS + f""",
marked AS (SELECT book_id, para, CASE WHEN para % 41 <> 7 THEN text WHEN length(split_part(book_id, '.', 1)) = 4 THEN {_LIST}[CAST((para // 41) % 8 + 1 AS INT)] ELSE 'Ruth' END AS text FROM books)"""


def marked(spark, sf):
    """The books with more kinds of headings; in half of them a single scripture name occurs."""
    name = F.try_element_at(F.array(*[F.lit(n) for n in _NAMES]), F.expr("cast((para div 41) % 8 + 1 as int)"))
    return S.books(spark, sf).withColumn("text", F.when(F.col("para") % 41 != 7, F.col("text")).when(F.length(F.substring_index("book_id", ".", 1)) == 4, name).otherwise("Ruth"))


_SCRIPTURE = ", ".join(f"'{n}'" for n in C.SCRIPTURE)
_NUMBERS = ", ".join(f"'{n}'" for n in C.NUMBER_WORDS)
MARKS = MARKED + rf""",
scripture AS (SELECT n AS name, lower(n) AS low FROM (SELECT unnest([{_SCRIPTURE}]) AS n)),
normal AS (SELECT book_id, para, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM marked WHERE length(text) <= 90),
lowered AS (SELECT *, regexp_replace(lower(t), '[:.]+$', '') AS low FROM normal WHERE t <> ''),
split_low AS (SELECT *, regexp_extract(low, '^(.+?)\s+(\d{{1,3}})$', 1) AS base, regexp_extract(low, '^(.+?)\s+(\d{{1,3}})$', 2) AS num, string_split(lower(t), ' ') AS w FROM lowered),
opened AS (SELECT *, w[1] AS kw, regexp_extract(coalesce(w[2], ''), '^[a-z0-9_]+') AS no, regexp_extract(w[1], '^[a-z]+') AS name1 FROM split_low),
shaped AS (SELECT *, kw IN ('chapter', 'part', 'book', 'section', 'psalm', 'canto', 'act', 'volume') AND (try_cast(no AS INT) BETWEEN 0 AND 9999 AND length(no) <= 4 OR (no <> '' AND length(no) <= 7 AND translate(no, 'ivxlcdm', '') = '')
    OR no IN ({_NUMBERS})) AND length(ltrim(substr(t, length(kw) + length(no) + 2), ' .:-–—')) <= 70 AS numbered,
  name1 IN ('prologue', 'epilogue', 'prelude', 'interlude', 'preface', 'foreword', 'introduction', 'appendix') AND length(t) - length(name1) <= 50 AND len(string_split_regex(t, '[.!?]')) = 1
    OR starts_with(t, '第') AND regexp_matches(substr(replace(t, ' ', ''), 2), '^[0-9〇零一二三四五六七八九十百千两]+[章节回卷部篇]') AS named FROM opened),
all_marks AS (SELECT book_id, para, CASE WHEN a.name IS NOT NULL THEN 'book' WHEN b.name IS NOT NULL THEN 'chapter' WHEN numbered AND kw IN ('part', 'book', 'volume', 'canto') THEN 'book' ELSE 'chapter' END AS kind,
  CASE WHEN a.name IS NOT NULL THEN a.name WHEN b.name IS NOT NULL THEN b.name || ' ' || num ELSE t END AS title, coalesce(a.name, b.name) AS book, coalesce(a.name, b.name) IS NOT NULL AS scripture
  FROM shaped s LEFT JOIN scripture a ON s.low = a.low LEFT JOIN scripture b ON s.base = b.low WHERE a.name IS NOT NULL OR b.name IS NOT NULL OR numbered OR named),
trusted AS (SELECT * FROM all_marks WHERE NOT scripture OR book_id IN (SELECT book_id FROM all_marks WHERE scripture GROUP BY book_id HAVING count(DISTINCT book) >= 5)),
sizes AS (SELECT book_id, count(*) AS n FROM marked GROUP BY book_id)"""
SECTIONS = MARKS + """,
m1 AS (SELECT t.*, coalesce(kind = 'book' AND lead(kind) OVER o = 'chapter' AND lead(para) OVER o = para + 1, false) AS merges,
  last_value(CASE WHEN kind = 'book' THEN title ELSE book END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY para ROWS UNBOUNDED PRECEDING) AS running
  FROM trusted t WINDOW o AS (PARTITION BY book_id ORDER BY para)),
m2 AS (SELECT *, CASE WHEN lag(merges) OVER o THEN lag(para) OVER o ELSE para END AS start FROM m1 WINDOW o AS (PARTITION BY book_id ORDER BY para)),
starts AS (SELECT book_id, start, CASE WHEN kind = 'chapter' AND running IS NOT NULL AND book IS NULL AND running <> title THEN running || ' — ' || title ELSE title END AS title FROM m2 WHERE NOT merges),
starts2 AS (SELECT * FROM starts UNION ALL SELECT book_id, 0, 'Beginning' FROM starts GROUP BY book_id HAVING min(start) > 0),
found AS (SELECT * FROM (SELECT s.book_id, title, start, coalesce(lead(start) OVER (PARTITION BY s.book_id ORDER BY start), n) AS "end", n FROM starts2 s JOIN sizes USING (book_id)) WHERE "end" > start),
long_found AS (SELECT book_id, title, start, "end" FROM found WHERE n >= 300 AND book_id IN (SELECT book_id FROM found GROUP BY book_id HAVING count(*) >= 2)),
cut AS (SELECT *, CAST(ceil(("end" - start) / 250.0) AS BIGINT) AS parts FROM long_found),
cut2 AS (SELECT *, CAST(ceil(("end" - start) / parts) AS BIGINT) AS size, unnest(range(parts)) AS j FROM cut),
fixed AS (SELECT book_id, n, CAST(ceil(n / 250.0) AS BIGINT) AS parts, CAST(ceil(n / ceil(n / 250.0)) AS BIGINT) AS size FROM sizes WHERE n >= 300 AND book_id NOT IN (SELECT book_id FROM long_found)),
fixed2 AS (SELECT *, unnest(range(parts)) AS j FROM fixed),
sections0 AS (SELECT book_id, '' AS title, 0 AS start, n AS "end" FROM sizes WHERE n < 300
  UNION ALL SELECT book_id, CASE WHEN parts = 1 THEN title ELSE title || ' (part ' || (j + 1) || '/' || parts || ')' END, start + j * size, least("end", start + (j + 1) * size) FROM cut2
  UNION ALL SELECT book_id, 'Part ' || (j + 1) || ' · paragraphs ' || (j * size + 1) || '–' || least(n, (j + 1) * size), j * size, least(n, (j + 1) * size) FROM fixed2),
sections AS (SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY start) - 1 AS BIGINT) AS section_no, title, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM sections0)"""


@query("sec1_classify_headings", f"WITH {MARKS} SELECT book_id, para, kind, title, book, scripture FROM all_marks")
def sec1(spark, sf):
    return C.classify_headings(marked(spark, sf))


@query("sec2_trusted_marks", f"WITH {MARKS} SELECT book_id, para, kind, title, book, scripture FROM trusted")
def sec2(spark, sf):
    return C.trusted_marks(C.classify_headings(marked(spark, sf)))


@query("sec3_sections_from_marks", f'WITH {SECTIONS} SELECT book_id, title, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM found')
def sec3(spark, sf):
    paras = marked(spark, sf)
    return C.sections_from_marks(C.trusted_marks(C.classify_headings(paras)), C.book_sizes(paras))


@query("sec4_enforce_max", f"""WITH {S.BOOKS}, n AS (SELECT book_id, count(*) AS n FROM books GROUP BY book_id), p AS (SELECT *, CAST(ceil(n / 40.0) AS BIGINT) AS parts FROM n),
q AS (SELECT *, CAST(ceil(n / parts) AS BIGINT) AS size, unnest(range(parts)) AS j FROM p)
SELECT book_id, CASE WHEN parts = 1 THEN book_id ELSE book_id || ' (part ' || (j + 1) || '/' || parts || ')' END AS title, CAST(j * size AS BIGINT) AS start, CAST(least(n, (j + 1) * size) AS BIGINT) AS "end" FROM q""")
def sec4(spark, sf):
    whole = C.book_sizes(S.books(spark, sf)).select("book_id", F.col("book_id").alias("title"), F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    return C.enforce_max(whole, 40)


@query("sec5_fixed_parts", f"""WITH {S.BOOKS}, p AS (SELECT book_id, count(*) AS n, CAST(ceil(count(*) / 250.0) AS BIGINT) AS parts FROM books GROUP BY book_id),
q AS (SELECT *, CAST(ceil(n / parts) AS BIGINT) AS size, unnest(range(parts)) AS j FROM p)
SELECT book_id, 'Part ' || (j + 1) || ' · paragraphs ' || (j * size + 1) || '–' || least(n, (j + 1) * size) AS title, CAST(j * size AS BIGINT) AS start, CAST(least(n, (j + 1) * size) AS BIGINT) AS "end" FROM q""")
def sec5(spark, sf):
    return C.fixed_parts(C.book_sizes(S.books(spark, sf)))


@query("sec6_split_sections", f'WITH {SECTIONS} SELECT book_id, section_no, title, start, "end" FROM sections')
def sec6(spark, sf):
    return C.split_sections(marked(spark, sf))


def positions(spark, sf):
    """A reading position of every event, in the books by turns."""
    return table(spark, sf, "events").select("event_id", F.expr("concat('src', event_id % 20, '.', event_id div 10000)").alias("book_id"), F.expr("event_id * 7 % 700 - 5").alias("position"))


_POS = "pos AS (SELECT event_id, 'src' || (event_id % 20) || '.' || (event_id // 10000) AS book_id, event_id * 7 % 700 - 5 AS position FROM events)"
_LOCATED = """located AS (SELECT p.*, section_no, title, g - start AS local FROM (SELECT p.*, greatest(0, least(position, n - 1)) AS g FROM pos p JOIN sizes USING (book_id)) p
  JOIN sections s ON p.book_id = s.book_id AND g >= start AND g < "end")"""


@query("sec7_locate", f"WITH {SECTIONS}, {_POS}, {_LOCATED} SELECT event_id, book_id, position, section_no, title, CAST(local AS BIGINT) AS local FROM located")
def sec7(spark, sf):
    return C.locate(positions(spark, sf), C.split_sections(marked(spark, sf)))


@query("sec8_describe_marks", f"""WITH {SECTIONS}, {_POS}, {_LOCATED}, d AS (SELECT DISTINCT book_id, position, title, local FROM located)
SELECT d.book_id, d.position, title, CAST(local + 1 AS BIGINT) AS number, text FROM d JOIN marked m ON d.book_id = m.book_id AND d.position = m.para""")
def sec8(spark, sf):
    paras = marked(spark, sf)
    return C.describe_marks(positions(spark, sf).select("book_id", "position").distinct(), C.split_sections(paras), paras)


def unread(spark, sf):
    return S.books(spark, sf).where("para % 5 in (1, 2)").select("book_id", "para")


@query("sec9_next_playable", f"""WITH {S.BOOKS}, {_POS}, p AS (SELECT DISTINCT book_id, position FROM pos), g AS (SELECT book_id, para FROM books WHERE para % 5 NOT IN (1, 2))
SELECT p.book_id, p.position, CAST(min(para) AS BIGINT) AS target FROM p LEFT JOIN g ON p.book_id = g.book_id AND para >= position GROUP BY p.book_id, p.position""")
def sec9(spark, sf):
    return C.next_playable(S.books(spark, sf), positions(spark, sf).select("book_id", "position").distinct(), unread(spark, sf))


@query("sec9_previous_playable", f"""WITH {S.BOOKS}, {_POS}, p AS (SELECT DISTINCT book_id, position FROM pos), g AS (SELECT book_id, para FROM books WHERE para % 5 NOT IN (1, 2))
SELECT p.book_id, p.position, CAST(max(para) AS BIGINT) AS target FROM p LEFT JOIN g ON p.book_id = g.book_id AND para <= position GROUP BY p.book_id, p.position""")
def sec9b(spark, sf):
    return C.next_playable(S.books(spark, sf), positions(spark, sf).select("book_id", "position").distinct(), unread(spark, sf), -1)


def ignored(paras):
    return paras.where("para % 9 = 4").select("book_id", "para")


@query("snk1_export_text", f"WITH {S.BOOKS} SELECT book_id, string_agg(text, chr(10) || chr(10) ORDER BY para) || chr(10) AS body FROM books WHERE para % 9 <> 4 GROUP BY book_id")
def snk1(spark, sf):
    paras = S.books(spark, sf)
    return K.export_text(paras, ignored(paras))


@query("snk1_export_markdown", f"WITH {S.BOOKS} SELECT book_id, '# Book ' || book_id || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY para) || chr(10) AS body FROM books WHERE para % 9 <> 4 GROUP BY book_id")
def snk1b(spark, sf):
    paras = S.books(spark, sf)
    return K.export_text(paras, ignored(paras), paras.select("book_id", F.concat(F.lit("Book "), "book_id").alias("title")).distinct())


@query("snk2_export_json", f"""WITH {SECTIONS}, p AS (SELECT book_id, string_agg('{{"index":' || para || ',"text":' || to_json(text) || ',"bookmarked":' || (para % 4 = 0) || ',"highlighted":' || (para % 6 = 0) || '}}', ',' ORDER BY para) AS ps
  FROM marked WHERE para % 9 <> 4 GROUP BY book_id),
s AS (SELECT book_id, string_agg('{{"title":' || to_json(title) || ',"start":' || start || ',"end":' || "end" || '}}', ',' ORDER BY start) AS ss FROM sections GROUP BY book_id HAVING count(*) > 1)
SELECT book_id, '{{"title":"' || book_id || '","paragraphs":[' || ps || ']' || CASE WHEN ss IS NULL THEN '' ELSE ',"sections":[' || ss || ']' END || '}}' AS json FROM p LEFT JOIN s USING (book_id)""")
def snk2(spark, sf):
    paras = marked(spark, sf)
    flag = lambda k: paras.where(f"para % {k} = 0").select("book_id", "para")
    return K.export_json(paras, ignored(paras), flag(4), flag(6), C.split_sections(paras))


def _folder(spark):
    return f"{shared_folder(spark)}/books-{uuid.uuid4().hex}"


@query("src1_read_text_corpus", f"WITH {S.BOOKS} SELECT book_id AS title, 'file' AS kind, string_agg(text, chr(10) || chr(10) ORDER BY para) || chr(10) AS text FROM books WHERE para % 9 <> 4 GROUP BY book_id")
def src1(spark, sf):
    """All books as text files, and those read back."""
    paras, at = S.books(spark, sf), _folder(spark)
    K.write_texts(paras, ignored(paras), at)
    return W.read_text_corpus(spark, at, folder="book_id").select("title", "kind", "text")


@query("snk1_markdown_files", ORACLE["snk1_export_markdown"])
def snk1c(spark, sf):
    paras, at = S.books(spark, sf), _folder(spark)
    K.write_texts(paras, ignored(paras), at, paras.select("book_id", F.concat(F.lit("Book "), "book_id").alias("title")).distinct())
    return W.read_text_corpus(spark, at, folder="book_id").select(F.col("title").alias("book_id"), F.col("text").alias("body"))


@query("snk2_json_files", ORACLE["snk2_export_json"])
def snk2b(spark, sf):
    """All books as JSON files of a line for each paragraph, and those read back; strings hold no line ends."""
    paras, at = marked(spark, sf), _folder(spark)
    flag = lambda k: paras.where(f"para % {k} = 0").select("book_id", "para")
    K.write_json(paras, ignored(paras), flag(4), flag(6), C.split_sections(paras), at)
    return W.read_text_corpus(spark, at, folder="book_id").select(F.col("title").alias("book_id"), F.replace("text", F.lit("\n"), F.lit("")).alias("json"))


@query("snk3_export_chapters", f"""WITH {SECTIONS}
SELECT m.book_id, printf('%04d - ', section_no + 1) || substr(trim(regexp_replace(regexp_replace(CASE WHEN title = '' THEN 'Document' ELSE title END, '[\\\\/:*?"<>|]+', ' ', 'g'), '\\s+', ' ', 'g')), 1, 70) || '.txt' AS file_name,
  string_agg(text, chr(10) || chr(10) ORDER BY para) || chr(10) AS body FROM marked m JOIN sections s ON m.book_id = s.book_id AND para >= start AND para < "end" WHERE para % 5 NOT IN (1, 2) GROUP BY m.book_id, section_no, title""")
def snk3(spark, sf):
    paras = marked(spark, sf)
    return K.export_chapters(paras, C.split_sections(paras), unread(spark, sf))


@query("snk4_pending_chapters", f"""WITH {SECTIONS} SELECT DISTINCT s.book_id, section_no FROM sections s JOIN marked m ON m.book_id = s.book_id AND para >= start AND para < "end"
WHERE para % 5 NOT IN (1, 2) AND NOT (section_no % 3 = 0 AND section_no % 2 = 0)""")
def snk4(spark, sf):
    paras = marked(spark, sf)
    sections = C.split_sections(paras)
    files = sections.where("section_no % 3 = 0").select("book_id", "section_no", F.expr("case when section_no % 2 = 0 then 100 else 0 end").alias("bytes"))
    return K.pending_chapters(paras, sections, unread(spark, sf), files)


@query("snk5_paragraph_manifest", f"""WITH {S.BOOKS}, r AS (SELECT book_id, para, text, row_number() OVER (PARTITION BY book_id ORDER BY para) AS file_no FROM books WHERE para % 5 NOT IN (1, 2))
SELECT book_id, CAST(file_no AS BIGINT) AS file_no, '{{"file_no":' || file_no || ',"paragraph":' || para || ',"text":' || to_json(text) || ',"speed":"1.25x","voice":"af_heart"}}' AS entry FROM r""")
def snk5(spark, sf):
    return K.paragraph_manifest(S.books(spark, sf), unread(spark, sf), 1.25, "af_heart")


@query("snk6_content_store", """SELECT DISTINCT substr(sha1(text), 1, 16) AS name, text FROM documents WHERE substr(sha1(text), 1, 16) NOT IN (SELECT substr(sha1(text), 1, 16) FROM documents WHERE doc_id % 10 = 0)""")
def snk6(spark, sf):
    docs = table(spark, sf, "documents")
    return K.content_store(docs, docs.where("doc_id % 10 = 0").select(F.substring(F.sha1("text"), 1, 16).alias("name")), "text")


@query("tim8_cue_sheet", f"""WITH {SECTIONS}, r AS (SELECT m.book_id, section_no, para, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 12 AS cs
  FROM marked m JOIN sections s ON m.book_id = s.book_id AND para >= start AND para < "end" WHERE para % 5 NOT IN (1, 2)),
t AS (SELECT *, cs + 50 + CASE WHEN lead(section_no) OVER (PARTITION BY book_id ORDER BY section_no, para) <> section_no THEN 150 ELSE 0 END AS took FROM r)
SELECT book_id, section_no, para, round((sum(took) OVER w - took) / 100.0, 3) AS begin, round((sum(took) OVER w - took + cs) / 100.0, 3) AS finish, cs / 100.0 AS seconds FROM t
WINDOW w AS (PARTITION BY book_id ORDER BY section_no, para ROWS UNBOUNDED PRECEDING)""")
def tim8(spark, sf):
    paras = marked(spark, sf)
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    readable = paras.join(unread(spark, sf), ["book_id", "para"], "left_anti")
    at = C.locate(readable.withColumnRenamed("para", "position"), C.split_sections(paras))
    rows = at.select("book_id", "section_no", F.col("position").alias("para"), (words * 12 / 100.0).alias("seconds"))
    return T.cue_sheet(rows).withColumns({"begin": F.round("begin", 3), "finish": F.round("finish", 3)})
