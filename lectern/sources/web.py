"""Sources: text files, routing of inputs, web pages to paragraphs, admission rules, spines of books."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import markup as M
from lectern.functions.markup import plain
from lectern.functions.text import strip

#: The extensions of each kind of reader; tags of books: what is skipped with all it holds, what makes a
#: paragraph, what only holds others, and the kinds of notes and lists that aren't read.
READERS = {"pdf": "pdf", "epub": "book", "docx": "book", "txt": "text", "md": "text", "png": "picture", "jpg": "picture", "jpeg": "picture", "webp": "picture"}
FONT_ENCRYPTION = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")
SKIPPED = "head|title|svg|math|iframe|object|audio|video|canvas|noscript|button|select|textarea"
LEAVES = "p|h1|h2|h3|h4|h5|h6|li|dt|dd|figcaption|caption|summary|pre|address"
HOLDERS = "html|body|div|section|article|main|blockquote|ul|ol|dl|figure|details|header|footer|aside|form|fieldset|center|tbody|thead|tfoot|hgroup"
NOTES = "noteref|footnote|endnote|rearnote|pagebreak|page-list|toc"
BLOCKS, EDGES = "h1|h2|h3|p|li", "ul|ol|div|section|article|main|body|html|table|nav|header|footer|aside"


def read_text_corpus(spark: SparkSession, path: str, glob: str = "*.{txt,md}", folder: str | None = None) -> DataFrame:
    """(source, title, kind, text): one document for each file, bytes that are no UTF-8 replaced, the title its stem. With ``folder``
    one for each folder ``folder=title`` of parts, such as ``write_texts`` leaves: its files in the order of their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name, text = F.regexp_extract("path", r"([^/]+)$", 1), F.make_valid_utf8(F.col("content").cast("string"))
    if folder is None:
        return files.select(F.col("path").alias("source"), F.regexp_replace(name, r"\.[^.]+$", "").alias("title"), F.lit("file").alias("kind"), text.alias("text"))
    place = F.regexp_extract("path", rf"/{folder}=([^/]*)/[^/]+$", 1)
    title = F.coalesce(F.try_url_decode(F.replace(place, F.lit("+"), F.lit("%2B"))), place)
    parts = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("source"), title.alias("title"), F.struct(name.alias("name"), text.alias("t")).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["t"]), "")
    return parts.groupBy("source", "title").agg(whole.alias("text")).select("source", "title", F.lit("file").alias("kind"), "text")


def route_sources(paths: DataFrame, path_col: str) -> DataFrame:
    """paths with ``reader``: link for web addresses, else by extension, else unsupported."""
    names = F.create_map(*[F.lit(x) for kv in READERS.items() for x in kv])
    ext = F.lower(F.regexp_extract(path_col, r"\.([A-Za-z0-9]+)$", 1))
    return paths.withColumn("reader", F.when(F.col(path_col).rlike("(?i)^https?://"), "link").otherwise(F.coalesce(F.try_element_at(names, ext), F.lit("unsupported"))))


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, n, tag, text) of headings, paragraphs and list items in the order of their beginnings: inside article or main if there is
    one, else outside navigation. A list item that holds a paragraph gives both. A paragraph ends at the next block, and so does
    another element without an end."""
    t = M.stream(pages, id_col, html_col)
    t = t.withColumn("_end", M.closed_at(M.named(f"{BLOCKS}|{EDGES}"))).withColumn("_own", F.coalesce("end", F.lit(1 << 30)))
    main = M.named("article|main") & (F.col("step") == 1)
    t = t.withColumn("_article", M.covered(main, F.col("_own"))).withColumn("_aside", M.covered(M.named("nav|header|footer|aside"), F.col("_own")))
    t = t.withColumn("_some", F.max(main).over(Window.partitionBy("_row"))).where(F.when(F.col("_some"), F.col("_article")).otherwise(~F.col("_aside")))
    # Blocks may hold blocks: how many are open at a token follows from their beginnings and ends, and a text is copied to each.
    opens = M.named(BLOCKS) & (F.col("step") == 1)
    t = M.pieces(t).withColumn("_open", opens)
    ends = t.where("_open").select("_row", "_id", F.col("_end").alias("pos"), F.lit(-1).alias("_turn"), F.lit(False).alias("_open"))
    rest = t.where("_open or piece is not null").select("_row", "_id", "pos", F.col("_open").cast("int").alias("_turn"), "_open", "name", "piece")
    events = rest.unionByName(ends, allowMissingColumns=True)
    order = Window.partitionBy("_row").orderBy("pos", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("_deep", F.sum("_turn").over(order)).where("_turn >= 0 and _deep > 0")
    each = events.withColumn("_d", F.explode(F.when(F.col("_open"), F.array("_deep")).otherwise(F.sequence(F.lit(1).cast("long"), "_deep"))))
    each = each.withColumn("_block", F.last(F.when(F.col("_open"), F.struct("pos", "name")), ignorenulls=True).over(M.upto("_d")))
    found = each.where("piece is not null").groupBy("_row", "_id", "_block").agg(M.text_of(F.collect_list(F.struct("pos", "piece"))).alias("text")).where("text <> ''")
    n = F.row_number().over(Window.partitionBy("_row").orderBy("_block.pos")) - 1
    return found.select(F.col("_id").alias(id_col), n.cast("long").alias("n"), F.col("_block.name").alias("tag"), "text")


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, n, text) of a book page's paragraphs: a paragraph's text with all it holds, a container's own text between its blocks,
    tables row by row (tables in cells are read with the cell, and then row by row). Scripts, styles, navigation, notes and their
    marks, page lists and tables of contents are left out everywhere, pictures, forms and the like outside paragraphs.

    An element without an end ends at the next block."""
    t = M.stream(pages, id_col, html_col)
    block = M.named(f"{LEAVES}|{HOLDERS}|table")
    t = t.withColumn("end", M.closed_at(block))
    tok = F.col("tok")
    kind = rf"(?is)\s(?:epub:type|type)\s*=\s*[\"'][^\"']*(?:{NOTES})|\srole\s*=\s*[\"']doc-(?:noteref|footnote|endnote)[\"']"
    mark = M.named("a|sup") & tok.rlike(r"(?is)\sclass\s*=\s*[\"'](?:[^\"']*\s)?noteref[\s\"']")
    t = t.withColumn("_gone", M.covered(M.named("nav") | tok.rlike(kind) | mark, F.col("end"))).where(~F.col("_gone") & ~F.coalesce(M.named(M.RAW), F.lit(False)))
    # Paragraphs, tables and what is skipped are units: only the outermost counts, the tags in it divide nothing.
    unit = F.when(M.named(LEAVES), "leaf").when(F.col("name") == "table", "table").when(M.named(SKIPPED), "skip")
    t = t.withColumn("_unit", F.when(F.col("step") == 1, unit)).withColumn("_until", F.when(F.col("_unit").isNotNull(), F.col("end")))
    outer = F.col("_unit").isNotNull() & (F.col("pos") >= F.coalesce(F.max("_until").over(M.upto(last=-1)), F.lit(-1)))
    t = t.withColumn("_outer", outer)
    t = t.withColumn("_in", F.last(F.when(F.col("_outer"), F.struct("pos", "_until", F.col("_unit").alias("kind"))), ignorenulls=True).over(M.upto()))
    t = t.withColumn("_in", F.when(F.col("_in._until") > F.col("pos"), F.col("_in")))
    edge = F.coalesce(block & (F.col("step") != 0), F.lit(False)) & F.col("_in").isNull() | F.col("_outer") & (F.col("_unit") != "skip")
    t = M.pieces(t).withColumn("_part", F.sum(edge.cast("int")).over(M.upto()))
    where = F.coalesce(F.col("_in.kind"), F.lit("own"))
    prose = t.where(F.col("piece").isNotNull() & where.isin("own", "leaf"))
    paras = prose.groupBy("_row", "_id", "_part", where.alias("_where")).agg(F.min("pos").alias("_at"), M.text_of(F.collect_list(F.struct("pos", "piece"))).alias("text"))
    rows = paras.select("_row", "_id", "_at", F.lit(0).alias("_i"), "text").unionByName(_table_rows(t.where(where == "table")))
    n = F.row_number().over(Window.partitionBy("_row").orderBy("_at", "_i")) - 1
    return rows.where("text <> ''").select(F.col("_id").alias(id_col), n.cast("long").alias("n"), "text")


def _table_rows(t: DataFrame) -> DataFrame:
    """The tokens of tables to sentences (_row, _id, _at, _i, text). A token belongs to a cell of each table around it: of the last row
    and cell that began at that depth, so cells and rows need no end."""
    t = t.withColumn("_table", F.col("_in.pos"))
    turn = F.when(F.col("name") == "table", F.col("step")).otherwise(0)
    t = t.withColumn("_deep", F.sum(turn).over(M.upto("_table")))
    begins = lambda names: M.named(names) & (F.col("step") == 1)
    t = t.withColumn("_tr", begins("tr")).withColumn("_td", begins("td|th")).where("piece is not null or _tr or _td").where("_deep > 0")
    each = t.withColumn("_d", F.explode(F.sequence(F.lit(1).cast("long"), "_deep")))
    level = M.upto("_table", "_d")
    last = lambda c: F.last(F.when(F.col(c) & (F.col("_d") == F.col("_deep")), F.col("pos")), ignorenulls=True).over(level)
    each = each.withColumn("_r", last("_tr")).withColumn("_c", last("_td")).where("_c > _r")
    cells = each.groupBy("_row", "_id", "_table", "_r", "_c").agg(M.text_of(F.collect_list(F.struct("pos", F.coalesce("piece", F.lit("")).alias("piece")))).alias("cell"))
    row = cells.groupBy("_row", "_id", "_table", "_r").agg(F.transform(F.array_sort(F.collect_list(F.struct("_c", "cell"))), lambda c: c["cell"]).alias("_cells"))
    whole = row.groupBy("_row", "_id", "_table").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_cells"))), lambda r: r["_cells"]).alias("_rows"))
    return whole.select("_row", "_id", F.col("_table").alias("_at"), F.posexplode(M.rows_sentences(F.col("_rows"))).alias("_i", "text"))


def page_title(html: str | Column, url: str | Column, most: int = 120) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    part = lambda tag: plain(F.regexp_extract(h, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1))
    head = F.substring(part("h1"), 1, most)
    return F.when(head != "", head).when(part("title") != "", part("title")).otherwise(F.col(url) if isinstance(url, str) else url)


def extract_articles(pages: DataFrame) -> DataFrame:
    """(page_id, title, paragraphs): ordered texts of a page's blocks."""
    body = blocks(pages).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("paragraphs"))
    return pages.select("page_id", page_title("html", "url").alias("title")).join(body, "page_id", "left")


def assemble_spine(spine: DataFrame, manifest: DataFrame, chapters: DataFrame) -> DataFrame:
    """spine(book_id, idref, ord, linear), manifest(book_id, idref, href, media, properties), chapters(book_id, href, paragraphs)
    -> (book_id, paragraphs): in spine order, without hidden items, navigation and what is no page."""
    read = spine.where("linear <> 'no'").join(manifest.where("media rlike 'html' and not coalesce(properties, '') rlike '\\\\bnav\\\\b'"), ["book_id", "idref"])
    parts = read.join(chapters, ["book_id", "href"]).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("ord", "paragraphs"))).alias("_p"))
    return parts.select("book_id", F.flatten(F.transform("_p", lambda x: x["paragraphs"])).alias("paragraphs"))


def robots_filter(urls: DataFrame, rules: DataFrame, answers: DataFrame) -> DataFrame:
    """urls(page_id, url) that may be read. rules(host, seq, prefix, allow): the first that matches the path counts;
    answers(host, status): a host is refused on a 5xx answer or none at all (null), open on any other answer than 200.

    A path is cut to the lengths that the prefixes of its host have, and the cuts meet the rules by equality, so the work follows
    paths times lengths, not paths times rules."""
    u = urls.withColumn("host", F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1))).withColumn("_path", F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1), F.lit("")), F.lit("/")))
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    u = u.join(answers.join(lengths, "host", "left"), "host", "left").where("status is not null and status < 500")
    cuts = u.where("status = 200 and _lengths is not null").select("page_id", "host", "_path", F.explode("_lengths").alias("_l")).where(F.col("_l") <= F.length("_path"))
    hits = cuts.select("page_id", "host", F.left("_path", F.col("_l")).alias("prefix")).join(rules, ["host", "prefix"])
    refused = hits.groupBy("page_id").agg(F.min_by("allow", "seq").alias("allow")).where("not allow").select("page_id")
    return u.join(refused, "page_id", "left_anti").select("page_id", "url")


def admit_pages(fetched: DataFrame, most: int = 6 * 1024 * 1024) -> DataFrame:
    """fetched(page_id, url, content_type, bytes, text) with the reason it is refused for, null if admitted."""
    reason = (
        F.when(~F.coalesce(F.col("url").rlike("(?i)^https?://"), F.lit(False)), "scheme").when(F.regexp_extract("url", r"(?i)^https?://([^/:?#]+)", 1) == "", "host")
        .when(F.col("bytes") > most, "size").when(~F.lower("content_type").rlike("html|text"), "type").when(strip(F.coalesce("text", F.lit(""))) == "", "empty"))
    return fetched.withColumn("reason", reason)


def reject_encrypted(rows: DataFrame) -> DataFrame:
    """rows(book_id, algorithm) -> (book_id, protected): any algorithm but those that only hide fonts."""
    return rows.groupBy("book_id").agg(F.bool_or(~F.col("algorithm").isin(*FONT_ENCRYPTION)).alias("protected"))
