"""Inputs derived from the star schema's tables: books, two-column pages and reading events. Each has a DuckDB twin as a list
of common table expressions, so that queries of both engines start from the same rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.paragraphs import split_paragraphs


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def paras(spark: SparkSession, sf: str) -> DataFrame:
    return split_paragraphs(_t(spark, sf, "documents"))


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '\s*\n\s*', ' ', 'g'), '[ \t\x{00a0}]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"""
PARAS = rf"""
paras AS (SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS BIGINT) AS para, unnest(ps) AS text FROM (
  SELECT doc_id, list_filter(list_transform(CASE WHEN regexp_matches(t, '\n\s*\n') THEN string_split_regex(t, '\n\s*\n') ELSE string_split(t, chr(10)) END,
    lambda x: {_CLEAN}), lambda x: x <> '') AS ps
  FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)))"""

_WORD = r"[\p{L}\p{N}]+(?:[''’.,\-][\p{L}\p{N}]+)*"
WORDS = PARAS + rf""",
word_pairs AS (SELECT doc_id, para, unnest(regexp_extract_all(text, '(?s)(.*?)({_WORD})', 0)) AS pair, unnest(regexp_extract_all(text, '(?s)(.*?)({_WORD})', 2)) AS word,
  generate_subscripts(regexp_extract_all(text, '(?s)(.*?)({_WORD})', 0), 1) - 1 AS word_no FROM paras),
words AS (SELECT doc_id, para, CAST(word_no AS BIGINT) AS word_no, word, CAST(sum(length(pair)) OVER w - length(word) AS BIGINT) AS start, CAST(sum(length(pair)) OVER w AS BIGINT) AS "end"
  FROM word_pairs WINDOW w AS (PARTITION BY doc_id, para ORDER BY word_no ROWS UNBOUNDED PRECEDING))"""
TIMELINE = WORDS + r""",
gaps AS (SELECT w.*, substr(p.text, CAST("end" + 1 AS BIGINT), CAST(coalesce(lead(w.start) OVER (PARTITION BY w.doc_id, w.para ORDER BY w.start), length(p.text)) - "end" AS BIGINT)) AS gap
  FROM words w JOIN paras p ON w.doc_id = p.doc_id AND w.para = p.para),
weights AS (SELECT *, greatest(1, "end" - start) * 10 + 6 + CASE WHEN regexp_matches(gap, '[.!?…。！？]') THEN 40 WHEN regexp_matches(gap, '[,;:—–、，；：]') THEN 20 ELSE 0 END AS wt FROM gaps),
timeline AS (SELECT doc_id, para, word_no, start, "end", word, (sum(wt) OVER o - wt) / sum(wt) OVER (PARTITION BY doc_id, para) AS f0, sum(wt) OVER o / sum(wt) OVER (PARTITION BY doc_id, para) AS f1
  FROM weights WINDOW o AS (PARTITION BY doc_id, para ORDER BY start ROWS UNBOUNDED PRECEDING))"""


#: Documents of a source make a book for each thousand ids, so that books don't grow with the table.
BOOK_ID = "concat(source, '.', {div})"


def books(spark: SparkSession, sf: str) -> DataFrame:
    """(book_id, para, text): the lines of a source's documents, thousand ids by thousand, with a chapter heading before every
    third document. Numbers are those of the lines in their document behind the documents before, so only sizes are ranked."""
    docs = _t(spark, sf, "documents").select(F.expr(BOOK_ID.format(div="doc_id div 1000")).alias("book_id"), "doc_id", F.filter(F.split("text", "\n"), lambda t: F.length(F.trim(t)) > 0).alias("lines"))
    head = F.when((F.col("doc_id") % 3 == 0) & (F.size("lines") > 0), F.array(F.concat(F.lit("Chapter "), F.col("doc_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumn("lines", F.concat(head, "lines")).where("size(lines) > 0")
    base = docs.select("book_id", "doc_id", F.size("lines").alias("n"))
    base = base.select("book_id", "doc_id", F.expr("sum(n) over (partition by book_id order by doc_id) - n").alias("base"))
    rows = docs.select("book_id", "doc_id", F.posexplode("lines").alias("k", "text")).join(base, ["book_id", "doc_id"])
    return rows.select("book_id", (F.col("base") + F.col("k")).cast("long").alias("para"), "text")


BOOKS = f"""
book_lines AS (SELECT {BOOK_ID.format(div='doc_id // 1000')} AS book_id, doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
book_rows AS (SELECT * FROM book_lines WHERE length(trim(t)) > 0),
books AS (SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY doc_id, line_no) - 1 AS BIGINT) AS para, t AS text FROM (
  SELECT book_id, doc_id, line_no, t FROM book_rows UNION ALL
  SELECT DISTINCT book_id, doc_id, -1, concat('Chapter ', CAST(doc_id AS VARCHAR)) FROM book_rows WHERE doc_id % 3 = 0))"""


#: Up to six words of a line; the first of a line begin with the line's end before them.
_SIX = r"(?:\n[ \n]*+)?+[^ \n]++(?: ++[^ \n]++){0,5}+"


def _layout_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, page, lines): the lines of each page's text, by forty of a document's."""
    docs = _t(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(_SIX), F.lit(0)).alias("cut"))
    # A document's first line has no end before it.
    docs = docs.select("doc_id", F.expr(r"transform(cut, (t, i) -> if(i = 0, concat('\n', ltrim(' \n', t)), t))").alias("cut"))
    return docs.select("doc_id", F.expr("posexplode(filter(transform(sequence(0, (size(cut) - 1) div 40), p -> slice(cut, 40 * p + 1, 40)), x -> size(x) > 0))").alias("page", "lines"))


def layout_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, page) of ``layout_lines``, one row each."""
    return _layout_pages(spark, sf).select("doc_id", "page")


def layout_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, page, k, text, x0, x1, y0, y1, size): two-column pages of 400 by 600 with a title, small print and a number, of all
    documents. The lines of a text hold up to six words; they are numbered by array place, so nothing is shuffled."""
    every = F.concat(F.array(F.lit("")), "lines", F.array(F.lit("")))  # the title first, the number last
    rows = _layout_pages(spark, sf).select("doc_id", "page", F.size("lines").alias("n"), F.posexplode(every).alias("at", "raw"))
    rows = rows.select("doc_id", "page", F.expr("case when at = 0 then -1 when at > n then 99 else at - 1 end").alias("k"), F.col("raw").startswith("\n").alias("opens"), F.expr(r"ltrim('\n ', raw)").alias("raw"))
    text = F.expr("""case k when -1 then concat('Running Title ', page + 1) when 99 then cast(page + 1 as string)
        else if(contains(raw, '  '), regexp_replace(raw, ' +', ' '), raw) end""")
    rows = rows.select("doc_id", "page", "k", text.alias("text"), "opens")
    words = "(length(text) - length(replace(text, ' ', '')) + 1)"
    # Places are doubles from the start (they are halves, so exact): decimals would be worked out by object.
    d = lambda title, number, line: F.expr(f"case k when -1 then cast({title} as double) when 99 then cast({number} as double) else cast({line} as double) end")
    return rows.select(
        "doc_id", "page", "k", "text", d(50, 200, "50 + 170 * (k div 20) + if(opens, 8, 0)").alias("x0"), d(370, 210, f"50 + 170 * (k div 20) + 150D * {words} / 6").alias("x1"),
        d(60, 575, "90 + 16 * (k % 20)").alias("y0"), d("78.4D", "584.2D", "101.5D + 16 * (k % 20)").alias("y1"), d(16, 8, "if(k = 39, 8, 10)").alias("size"))


def layout_spans(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, page, k, span, text, size, bold, family, raised, origin_y, baseline, x0, y0, x1, y1): the layout's body lines in
    pieces, with small and large numbers, note signs, drop caps and hyphens at line ends, by the line's number."""
    lines = layout_lines(spark, sf).where("k between 0 and 39").withColumn("h", F.expr("cast(pmod(doc_id * 7 + page * 3 + k, 40) as int)"))
    base = "y0 + size"
    span = lambda n, text, size, bold="false", family="'Body'", raised="false", rise="0": (
        f"struct({n} as span, {text} as text, cast({size} as double) as size, {bold} as bold, {family} as family, {raised} as raised, {base} - {rise} as origin_y)")
    n = "cast(k + 1 as string)"
    lead = (f"case when h in (1, 2, 3, 4) then {span(0, n, 6, rise='3')} when h = 5 then {span(0, n, 24)} when h = 6 then {span(0, n, 10, bold='true')} "
            f"when h = 7 then {span(0, 'left(text, 1)', 20)} else {span(0, repr(''), 10)} end")
    half, rest = "substring_index(text, ' ', 3)", "substring(text, length(substring_index(text, ' ', 3)) + 1)"
    body = f"case when h = 7 then substring({half}, 2) else {half} end"
    note = f"case when h in (10, 11) then {span(2, n, 6, rise='3')} when h = 12 then {span(2, repr('*'), 5, raised='true')} else {span(2, repr(''), 10)} end"
    end = f"case when h % 10 = 9 then concat({rest}, '-') when h % 10 = 8 then concat({rest}, '\u00ad') else {rest} end"
    pieces = F.expr(f"inline(filter(array({lead}, {span(1, body, 10)}, {note}, {span(3, end, 10)}), s -> s.text <> ''))")
    return lines.select("doc_id", "page", "k", F.expr(base).alias("baseline"), "x0", "y0", "x1", "y1", pieces)


LAYOUT = """
lay_l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)),1)-1 AS line_no FROM documents),
lay_w AS (SELECT doc_id, line_no, unnest(string_split_regex(trim(t), ' +')) AS word, generate_subscripts(string_split_regex(trim(t), ' +'),1)-1 AS w FROM lay_l WHERE length(trim(t)) > 0),
lay_c AS (SELECT doc_id, line_no, w // 6 AS chunk, string_agg(word, ' ' ORDER BY w) AS text, count(*) AS nw FROM lay_w GROUP BY doc_id, line_no, w // 6),
lay_n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, chunk) - 1 AS g FROM lay_c),
lay_b AS (SELECT doc_id, CAST(g // 40 AS INT) AS page, CAST(g % 40 AS INT) AS k, text,
  CAST(50 + 170 * ((g % 40) // 20) + CASE WHEN chunk = 0 THEN 8 ELSE 0 END AS DOUBLE) AS x0, CAST(50 + 170 * ((g % 40) // 20) + 150.0 * nw / 6 AS DOUBLE) AS x1,
  CAST(90 + 16 * (g % 20) AS DOUBLE) AS y0, CAST(101.5 + 16 * (g % 20) AS DOUBLE) AS y1,
  CAST(CASE WHEN g % 20 = 19 AND g % 40 >= 20 THEN 8 ELSE 10 END AS DOUBLE) AS size FROM lay_n),
layout_lines AS (SELECT * FROM lay_b
  UNION ALL SELECT DISTINCT doc_id, page, -1, concat('Running Title ', page + 1), 50.0::DOUBLE, 370.0::DOUBLE, 60.0::DOUBLE, 78.4::DOUBLE, 16.0::DOUBLE FROM lay_b
  UNION ALL SELECT DISTINCT doc_id, page, 99, CAST(page + 1 AS VARCHAR), 200.0::DOUBLE, 210.0::DOUBLE, 575.0::DOUBLE, 584.2::DOUBLE, 8.0::DOUBLE FROM lay_b)"""

_EVENTS = """SELECT event_id, ts, user_id, CAST(event_id % 4 AS BIGINT) AS doc, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  CASE event_type WHEN 'view' THEN 'position' WHEN 'click' THEN 'toggle' WHEN 'purchase' THEN 'highlight' WHEN 'signup' THEN 'open' ELSE 'fail' END AS action,
  CAST(event_id % 60 AS BIGINT) AS c_start, CAST(event_id % 60 + 1 + CAST(floor(value) AS BIGINT) % 30 AS BIGINT) AS c_end,
  CAST(0.5 + (event_id % 8) * 0.25 AS DOUBLE) AS speed_raw, event_id % 1000 / CAST(1000 AS DOUBLE) AS fraction FROM {events}"""
READING = f"reading AS ({_EVENTS.format(events='events')})"


def reading_events(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """Reading actions of ``events`` (batch or stream)."""
    events = _t(spark, sf, "events") if events is None else events
    return spark.sql(_EVENTS, events=events)
