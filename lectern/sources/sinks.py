"""Exports: whole documents, chapters, manifests, and a store of contents."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import is_picture, safe_filename, speed_label
from lectern.operators.timeline import asof


def joined(order: str, text: str, sep: str):
    """Texts of a group in order, as one string."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), sep)


def export_text(paras: DataFrame, ignored: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(book_id, body): paragraphs but ignored and picture ones, a blank line between; with ``titles`` as Markdown."""
    keep = paras.where(~is_picture("text")).join(ignored, ["book_id", "para"], "left_anti")
    out = keep.groupBy("book_id").agg(F.concat(joined("para", "text", "\n\n"), F.lit("\n")).alias("body"))
    if titles is not None:
        out = out.join(titles, "book_id").select("book_id", F.concat(F.lit("# "), "title", F.lit("\n\n"), "body").alias("body"))
    return out


def export_json(paras: DataFrame, ignored: DataFrame, bookmarks: DataFrame, highlights: DataFrame, sections: DataFrame) -> DataFrame:
    """(book_id, json): title, paragraphs with flags, and the sections if there are several."""
    flag = lambda df, name: df.select("book_id", "para").distinct().withColumn(name, F.lit(True))
    keep = paras.where(~is_picture("text")).join(ignored, ["book_id", "para"], "left_anti")
    keep = keep.join(flag(bookmarks, "bookmarked"), ["book_id", "para"], "left").join(flag(highlights, "highlighted"), ["book_id", "para"], "left")
    item = F.struct(F.col("para").alias("index"), "text", F.coalesce("bookmarked", F.lit(False)).alias("bookmarked"), F.coalesce("highlighted", F.lit(False)).alias("highlighted"))
    body = keep.groupBy("book_id").agg(F.array_sort(F.collect_list(item)).alias("paragraphs"))
    parts = sections.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "title"))).alias("_s"))
    parts = parts.where(F.size("_s") > 1).withColumn("sections", F.transform("_s", lambda x: F.struct(x["title"].alias("title"), x["start"].alias("start"), x["end"].alias("end"))))
    rows = body.join(parts.select("book_id", "sections"), "book_id", "left")
    return rows.select("book_id", F.to_json(F.struct(F.col("book_id").alias("title"), "paragraphs", "sections")).alias("json"))


def export_chapters(paras: DataFrame, sections: DataFrame, unread: DataFrame, ext: str = ".txt") -> DataFrame:
    """(book_id, file_name, body) of every chapter with something to read; numbers count the empty ones too."""
    keep = paras.where(~is_picture("text")).join(unread, ["book_id", "para"], "left_anti")
    both = asof(keep, sections, ["book_id"], "para", "start", ["section_no", "title"]).where("section_no is not null")
    out = both.groupBy("book_id", "section_no", "title").agg(F.concat(joined("para", "text", "\n\n"), F.lit("\n")).alias("body"))
    title = F.when(F.col("title") == "", F.lit("Document")).otherwise(F.col("title"))
    if ext == ".md":
        out = out.withColumn("body", F.concat(F.lit("# "), title, F.lit("\n\n"), "body"))
    return out.select("book_id", F.concat(F.format_string("%04d - ", F.col("section_no") + 1), safe_filename(title), F.lit(ext)).alias("file_name"), "body")


def pending_chapters(paras: DataFrame, sections: DataFrame, unread: DataFrame, files: DataFrame) -> DataFrame:
    """(book_id, section_no) of chapters with something to read and no finished file: files(book_id, section_no, bytes); an
    empty file doesn't count."""
    keep = paras.where(~is_picture("text")).select("book_id", "para").join(unread, ["book_id", "para"], "left_anti")
    readable = asof(keep, sections, ["book_id"], "para", "start", ["section_no"]).where("section_no is not null").select("book_id", "section_no").distinct()
    return readable.join(files.where("bytes > 0"), ["book_id", "section_no"], "left_anti")


def paragraph_manifest(paras: DataFrame, unread: DataFrame, speed: float, voice: str) -> DataFrame:
    """(book_id, file_no, entry): the number of a paragraph's file among the readable ones, and its manifest line."""
    keep = paras.where(~is_picture("text")).join(unread, ["book_id", "para"], "left_anti")
    file_no = F.row_number().over(Window.partitionBy("book_id").orderBy("para")).cast("long")
    entry = F.struct("file_no", F.col("para").alias("paragraph"), "text", speed_label(F.lit(speed)).alias("speed"), F.lit(voice).alias("voice"))
    return keep.withColumn("file_no", file_no).select("book_id", "file_no", F.to_json(entry).alias("entry"))


def content_store(blobs: DataFrame, stored: DataFrame, content: str) -> DataFrame:
    """(name, content) to add to a store: each distinct content once, unless its name is there."""
    named = blobs.select(F.substring(F.sha1(content), 1, 16).alias("name"), content).dropDuplicates(["name"])
    return named.join(stored.select("name"), "name", "left_anti")


# --- files of any size -----------------------------------------------------------------------------------------------

def _book_rows(paras: DataFrame, ignored: DataFrame) -> DataFrame:
    """The paragraphs that are read, with ``_first`` and ``_last`` paragraph of their book, which aggregates find."""
    keep = paras.where(~is_picture("text")).join(ignored, ["book_id", "para"], "left_anti")
    ends = keep.groupBy("book_id").agg(F.min("para").alias("_first"), F.max("para").alias("_last"))
    return keep.join(ends, "book_id")


def _write_in_order(rows: DataFrame, path: str) -> None:
    """rows(book_id, para, value) as text files in a folder for each book. Rows are dealt out by ranges of book and paragraph, so a book
    of any size is written by as many tasks as it needs; its files in the order of their names are the book."""
    ordered = rows.repartitionByRange("book_id", "para").sortWithinPartitions("book_id", "para")
    ordered.select("book_id", "value").write.partitionBy("book_id").text(path)


def write_texts(paras: DataFrame, ignored: DataFrame, path: str, titles: DataFrame | None = None) -> None:
    """What ``export_text`` gives as files, without a book ever being one string."""
    rows = _book_rows(paras, ignored)
    head = F.lit("")
    if titles is not None:
        rows = rows.join(titles.select("book_id", F.col("title").alias("_title")), "book_id")
        head = F.concat(F.lit("# "), "_title", F.lit("\n\n"))
    value = F.concat(F.when(F.col("para") == F.col("_first"), head).otherwise("\n"), "text")
    _write_in_order(rows.select("book_id", "para", value.alias("value")), path)


def write_json(paras: DataFrame, ignored: DataFrame, bookmarks: DataFrame, highlights: DataFrame, sections: DataFrame, path: str) -> None:
    """What ``export_json`` gives as files, a line for each paragraph."""
    flag = lambda df, name: df.select("book_id", "para").distinct().withColumn(name, F.lit(True))
    rows = _book_rows(paras, ignored).join(flag(bookmarks, "bookmarked"), ["book_id", "para"], "left").join(flag(highlights, "highlighted"), ["book_id", "para"], "left")
    item = F.struct(F.col("para").alias("index"), "text", F.coalesce("bookmarked", F.lit(False)).alias("bookmarked"), F.coalesce("highlighted", F.lit(False)).alias("highlighted"))
    parts = sections.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "title"))).alias("_s")).where(F.size("_s") > 1)
    tail = F.to_json(F.transform("_s", lambda x: F.struct(x["title"].alias("title"), x["start"].alias("start"), x["end"].alias("end"))))
    rows = rows.join(parts, "book_id", "left")
    title = F.regexp_extract(F.to_json(F.struct(F.col("book_id").alias("title"))), r"(?s)^\{(.*)\}$", 1)
    open_ = F.when(F.col("para") == F.col("_first"), F.concat(F.lit("{"), title, F.lit(',"paragraphs":['))).otherwise(",")
    close = F.when(F.col("para") == F.col("_last"), F.concat(F.lit("]"), F.coalesce(F.concat(F.lit(',"sections":'), tail), F.lit("")), F.lit("}"))).otherwise("")
    _write_in_order(rows.select("book_id", "para", F.concat(open_, F.to_json(item), close).alias("value")), path)
