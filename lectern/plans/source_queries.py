"""Queries of sources."""
from pyspark.sql import functions as F

from lectern.sources import web as W

from .registry import query, table


@query("src2_route_sources", """WITH p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'https://a.b/' || doc_id || '.pdf' WHEN 1 THEN '/x/' || doc_id || '.PDF' WHEN 2 THEN 'c:/b/' || doc_id || '.epub' WHEN 3 THEN doc_id || '.md' WHEN 4 THEN doc_id || '.exe' ELSE 'scan' || doc_id || '.jpeg' END AS path FROM documents)
SELECT doc_id, path, CASE doc_id % 6 WHEN 0 THEN 'link' WHEN 1 THEN 'pdf' WHEN 2 THEN 'book' WHEN 3 THEN 'text' WHEN 4 THEN 'unsupported' ELSE 'picture' END AS reader FROM p""")
def src2(spark, sf):
    path = F.expr("case doc_id % 6 when 0 then concat('https://a.b/', doc_id, '.pdf') when 1 then concat('/x/', doc_id, '.PDF') when 2 then concat('c:/b/', doc_id, '.epub') when 3 then concat(doc_id, '.md') when 4 then concat(doc_id, '.exe') else concat('scan', doc_id, '.jpeg') end")
    return W.route_sources(table(spark, sf, "documents").select("doc_id", path.alias("path")), "path")


@query("src3_extract_articles")
def src3(spark, sf):
    return W.extract_articles(table(spark, sf, "pages"))


_DECODED = "x"
for _mark, _char in (("&nbsp;", "chr(160)"), ("&middot;", "'·'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&mdash;", "'—'"), ("&ndash;", "'–'"), ("&hellip;", "'…'"),
                     ("&copy;", "'©'"), ("&eacute;", "'é'"), ("&amp;", "'&'")):
    _DECODED = f"replace({_DECODED}, '{_mark}', {_char})"


@query("src3_headings", rf"""SELECT page_id, trim(regexp_replace(replace({_DECODED.replace("(x,", "(h,")}, chr(160), ' '), '\s+', ' ', 'g')) AS heading
FROM (SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '<[^>]*>', '', 'g') AS h FROM pages) WHERE h <> ''""")
def src3b(spark, sf):
    h = F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)
    return table(spark, sf, "pages").select("page_id", h.alias("h")).where("h <> ''").select("page_id", W.plain("h").alias("heading"))


_OUT = "html"
for _tag in ("script", "style", "nav", *W.SKIPPED.split("|")):
    _OUT = f"regexp_replace({_OUT}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"


@query("src4_html_blocks", rf"""WITH b AS (SELECT page_id, string_split_regex(regexp_replace({_OUT.replace("html", "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')", 1)}, '(?is)<br\s*/?>', ' ', 'g'), '(?i)</?(?:{W.LEAVES}|{W.HOLDERS})\b[^>]*>') AS ps FROM pages),
t AS (SELECT page_id, list_filter(list_transform(ps, lambda y: trim(regexp_replace(replace({_DECODED.replace("(x,", "(regexp_replace(y, '<[^>]*>', '', 'g'),")}, chr(160), ' '), '\s+', ' ', 'g'))), lambda y: y <> '') AS ts FROM b)
SELECT page_id, CAST(generate_subscripts(ts, 1) - 1 AS BIGINT) AS n, unnest(ts) AS text FROM t""")
def src4(spark, sf):
    return W.html_blocks(table(spark, sf, "pages"))


@query("src5_assemble_spine", """WITH s AS (SELECT page_id // 5 AS book_id, page_id AS ord, url FROM pages WHERE page_id % 7 > 0 AND page_id % 11 > 0)
SELECT book_id, flatten(list([url, 'p' || ord] ORDER BY ord)) AS paragraphs FROM s GROUP BY book_id""")
def src5(spark, sf):
    p = table(spark, sf, "pages").select(F.expr("page_id div 5").alias("book_id"), F.col("page_id").alias("ord"), F.concat(F.lit("i"), F.col("page_id")).alias("idref"), "url", F.concat(F.lit("c"), F.col("page_id"), F.lit(".xhtml")).alias("href"))
    spine = p.select("book_id", "idref", "ord", F.expr("if(ord % 7 = 0, 'no', 'yes')").alias("linear"))
    manifest = p.select("book_id", "idref", "href", F.lit("application/xhtml+xml").alias("media"), F.expr("if(ord % 11 = 0, 'nav', null)").alias("properties"))
    return W.assemble_spine(spine, manifest, p.select("book_id", "href", F.array("url", F.concat(F.lit("p"), "ord")).alias("paragraphs")))


_HOST = r"lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"
_PATH = r"CASE WHEN regexp_extract(url, '^https?://[^/]+(/.*)$', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/]+(/.*)$', 1) END"


@query("src6_robots_filter", f"""WITH u AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages), a AS (SELECT DISTINCT host, CASE length(host) % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 200 END AS status FROM u)
SELECT page_id, url FROM u JOIN a USING (host) WHERE NOT (status = 200 AND path <> '/' AND ascii(substr(path, length(path))) % 2 = 0 AND starts_with(path, '/'))
  OR status <> 200""")
def src6(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    host = F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1))
    path = F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1)
    hosts = p.select(host.alias("host")).distinct()
    answers = hosts.withColumn("status", F.expr("case length(host) % 3 when 0 then 200 when 1 then 404 else 200 end"))
    rules = p.select(host.alias("host"), path.alias("prefix")).distinct().where("prefix not in ('', '/')").select("host", "prefix", (F.ascii(F.expr("right(prefix, 1)")) % 2 == 1).alias("allow"), (-F.length("prefix")).alias("seq"))
    return W.robots_filter(p, rules, answers)


@query("src7_admit_pages", """WITH f AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'ftp://x/y' WHEN page_id % 10 = 1 THEN 'http:///y' ELSE url END AS url, CASE WHEN page_id % 10 = 2 THEN 'image/png' ELSE 'Text/HTML; charset=utf-8' END AS content_type,
  CASE WHEN page_id % 10 = 3 THEN 7000000 ELSE strlen(html) END AS bytes, CASE WHEN page_id % 10 = 4 THEN '  ' ELSE html END AS text FROM pages)
SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'scheme' WHEN 1 THEN 'host' WHEN 2 THEN 'type' WHEN 3 THEN 'size' WHEN 4 THEN 'empty' END AS reason FROM f""")
def src7(spark, sf):
    f = table(spark, sf, "pages").select(
        "page_id", F.expr("case when page_id % 10 = 0 then 'ftp://x/y' when page_id % 10 = 1 then 'http:///y' else url end").alias("url"),
        F.expr("if(page_id % 10 = 2, 'image/png', 'Text/HTML; charset=utf-8')").alias("content_type"), F.expr("if(page_id % 10 = 3, 7000000, octet_length(html))").alias("bytes"),
        F.expr("if(page_id % 10 = 4, '  ', html)").alias("text"))
    return W.admit_pages(f).select("page_id", "reason")


@query("src8_reject_encrypted", "SELECT page_id // 4 AS book_id, bool_or(page_id % 3 = 0) AS protected FROM pages GROUP BY 1")
def src8(spark, sf):
    algorithm = F.expr("case page_id % 3 when 0 then 'http://www.w3.org/2001/04/xmlenc#aes128-cbc' when 1 then 'http://www.idpf.org/2008/embedding' else 'http://ns.adobe.com/pdf/enc#RC' end")
    return W.reject_encrypted(table(spark, sf, "pages").select(F.expr("page_id div 4").alias("book_id"), algorithm.alias("algorithm")))
