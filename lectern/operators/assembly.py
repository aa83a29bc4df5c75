"""From the lines and pieces of a page to its text: roles of spans, joined lines, verses, recognised rows, figures and their words.

Keys are those of the page (doc_id, page); windows and groups are pages or parts of one, so nothing grows with the corpus.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import QUOTES, STOPS, WHITE, finish_paragraph, is_picture, joined_pieces, strip
from lectern.operators.layout import (
    PAGE, _bound, _is_range, cluster_boxes, in_order, merge_boxes, same_heading, stitch_pages, whole_pages, with_breaks, with_gutters, with_metrics, with_roles)

SOFT_HYPHEN = "­"
#: Signs of footnotes, what ends a clause before a new sentence, what opens one.
NOTE_SIGNS, CLAUSE_ENDS, OPENING = "*†‡§¶", ".?!:;”’)\"'", "“‘\"'"
LETTERS = r"\p{L}+(?:-\p{L}+)*"


def _first(c: Column) -> Column:
    return F.left(F.ltrim(c, F.lit(WHITE)), F.lit(1))


def _last(c: Column) -> Column:
    return F.right(F.rtrim(c, F.lit(WHITE)), F.lit(1))


def span_roles(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """spans(doc_id, page, line, span, text, size, bold, family, raised, origin_y, baseline) with ``role``: chapter, verse, caller
    (of a footnote), dropcap or text; pages(doc_id, page, body, family, scripture) tells how ordinary text looks.

    Whether a span is text doesn't depend on its line; whether a small number is a verse or a caller depends on the text before
    it, so the line's text is looked at once the texts are known."""
    return _spans_of(spans, pages).select(*spans.columns, "role")


def _spans_of(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """``span_roles`` with ``_prose``, the role on a page that isn't scripture. Pages are small beside their spans, so each task looks its
    own up, and the spans are sorted once, by line."""
    page = pages.select(*PAGE, "body", F.col("family").alias("_plain"), "scripture").hint("shuffle_hash")
    x = spans.join(page, PAGE).withColumn("_t", strip("text")).withColumn("_r", F.col("size") / F.col("body"))
    line = Window.partitionBy(*PAGE, "line").orderBy("span")
    heavy = (F.col("bold") & (F.length("_t") > 3)).cast("int")
    alone = F.sum(heavy).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - heavy == 0
    little = (F.col("_r") <= 0.8) | F.col("raised") | (F.col("baseline") - F.col("origin_y") >= 0.18 * F.col("body"))
    x = x.withColumn("_little", little).withColumn("_styled", (F.col("family") != F.col("_plain")) | F.col("bold") & alone)
    # A range begins with a digit or a dash, so other texts aren't split.
    digits = F.coalesce(F.when(F.left("_t", F.lit(1)).isin(*"0123456789-–"), _is_range("text")), F.lit(False)) & (F.col("_t") != "")
    x = x.withColumn("_digits", digits)
    digits, big = F.col("_digits"), F.col("_r") >= 1.8
    sign = F.col("_t").isin(*NOTE_SIGNS) | F.when(F.length("_t") <= 2, F.col("_t").rlike("^[A-Za-z]{1,2}$"))
    cap = F.when(F.length("_t") <= 2, F.translate("_t", OPENING, "").rlike("^[A-Za-z]*$"))

    def kind(scripture: Column) -> Column:
        return (
            F.when(digits & big, F.when(scripture, "chapter").otherwise("text"))
            .when(digits & ~F.col("_little") & F.col("_styled") & scripture, "verse").when(digits & F.col("_little"), "mark")
            .when(~digits & F.col("_little") & sign, "caller")
            .when(~digits & big & (F.length("_t") <= 2) & cap & (F.col("_t") != ""), "dropcap").otherwise("text"))

    x = x.withColumn("role", kind(F.col("scripture"))).withColumn("_prose", kind(F.lit(False)))
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    behind = line.rowsBetween(1, Window.unboundedFollowing)
    text, inked = (F.col("role") == "text") & (F.col("text") != ""), F.col("_t") != ""
    end = F.last(F.when(text, F.right("text", F.lit(1))), ignorenulls=True).over(before)
    ink = F.last(F.when(text & inked, _last(F.col("text"))), ignorenulls=True).over(before)
    nxt = F.first(F.when(inked, _first(F.col("text"))), ignorenulls=True).over(behind)
    fresh = ink.isNull() | end.isin(" ", "\n") | ink.isin(*CLAUSE_ENDS) & F.coalesce(nxt.rlike("[A-Z]") | nxt.isin(*OPENING), F.lit(False))
    x = x.withColumn("_fresh", fresh)
    role = F.when(F.col("role") != "mark", F.col("role")).when(F.col("scripture") & F.col("_fresh"), "verse").otherwise("caller")
    prose = F.when(F.col("_prose") != "mark", F.col("_prose")).otherwise("caller")
    return x.withColumn("role", role).select(*spans.columns, "role", prose.alias("_prose"))


def page_mode(spans: DataFrame, pages: DataFrame, verses: str = "auto") -> DataFrame:
    """Span roles with ``mode``: pages of scripture (all for "always", none for "never") are read by verses, but those in which no
    verse or chapter is found are read again as prose. Both readings are made at once, so spans are joined with their page once."""
    wanted = {"always": F.lit(True), "never": F.lit(False)}.get(verses, F.coalesce("scripture", F.lit(False)))
    x = _spans_of(spans, pages.withColumn("scripture", wanted))
    marked = F.col("role").isin("verse", "chapter")
    x = x.withColumn("_verses", F.bool_or(marked).over(Window.partitionBy(*PAGE)))
    role = F.when(F.col("_verses"), F.col("role")).otherwise(F.col("_prose"))
    return x.select(*spans.columns, role.alias("role"), F.when(F.col("_verses"), "verses").otherwise("prose").alias("mode"))


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit(SOFT_HYPHEN), F.lit(""))), F.lit(LETTERS), F.lit(0))


def page_vocabulary(lines: DataFrame) -> DataFrame:
    """(doc_id, page, word) of the words on a page, in lower case."""
    return lines.select(*PAGE, F.explode(F.array_distinct(_words("text"))).alias("word")).distinct()


def join_lines(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """lines(doc_id, page, para, k, text) -> (doc_id, page, para, text). A soft hyphen at a line's end goes, and so does a hyphen
    before a small letter, unless the page has the hyphenated word and not the joined one; no blank follows a hyphen.

    A word that is cut at two line ends is looked up by its part on the line before the end."""
    key = [*PAGE, "para", "k"]
    x = _line_ends(lines.select(*key, "text"))
    cut = x.where("_hard").select(*key, "_a", "_b").where("_a <> '' and _b <> ''")
    known = vocabulary.select(*PAGE, F.col("word").alias("_w"))
    has = lambda word: cut.withColumn("_w", word).join(known, [*PAGE, "_w"], "left_semi").select(*key)
    kept = has(F.concat("_a", F.lit("-"), "_b")).join(has(F.concat("_a", "_b")), key, "left_anti").withColumn("_keep", F.lit(True))
    return _joined(x.join(kept, key, "left"))


def join_page_lines(lines: DataFrame, *also: str) -> DataFrame:
    """``join_lines`` by the words of each line's own page, in one pass over lines that are dealt out by page once; ``also`` are columns
    that a paragraph's lines share.

    A hyphen can stay only where the page has the hyphenated word, and few lines hold one. So a page's hyphenated words are
    gathered, then the joined words that are asked for, then those of them that some line has."""
    page = Window.partitionBy(*PAGE).orderBy("para", "k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = lines.select(*PAGE, "para", "k", "text", *also).where("text <> ''")
    inner = F.when(F.replace("text", F.lit(SOFT_HYPHEN), F.lit("")).rlike(r"\p{L}-\p{L}"), F.filter(_words("text"), lambda w: w.contains("-")))
    x = _line_ends(x.withColumn("_inner", F.array_distinct(F.flatten(F.collect_list(inner).over(page)))))
    asked = F.when(F.col("_hard") & (F.col("_a") != "") & (F.col("_b") != "") & (F.size("_inner") > 0), F.array_contains("_inner", F.concat("_a", F.lit("-"), "_b")))
    x = x.withColumn("_cut", F.when(asked, F.concat("_a", "_b"))).drop("_inner")
    x = x.withColumn("_asked", F.collect_set("_cut").over(page))
    x = x.withColumn("_has", F.flatten(F.collect_list(F.when(F.size("_asked") > 0, F.array_intersect("_asked", _words("text")))).over(page)))
    keep = F.when(F.col("_cut").isNotNull() & ~F.array_contains("_has", F.col("_cut")), True)
    return _joined(x.withColumn("_keep", keep).drop("_cut", "_asked", "_has"), *also)


def _line_ends(lines: DataFrame) -> DataFrame:
    """lines(doc_id, page, para, k, text) that aren't empty, with how they end: in a soft hyphen, in a hard one before a small letter,
    and the parts ``_a`` and ``_b`` of the word that is cut there."""
    x = lines.where("text <> ''").withColumn("_next", F.lead("text").over(Window.partitionBy(*PAGE, "para").orderBy("k")))
    soft = F.col("text").endswith(SOFT_HYPHEN) & F.col("_next").isNotNull()
    hard = F.col("text").endswith("-") & F.left("_next", F.lit(1)).rlike(r"\p{Ll}")
    x = x.withColumn("_soft", soft).withColumn("_hard", F.coalesce(hard, F.lit(False)))
    head = F.replace(F.regexp_extract("text", r"(?U)(\p{L}\S*)-$", 1), F.lit(SOFT_HYPHEN), F.lit(""))
    tail = F.regexp_extract(F.ltrim(F.replace("_next", F.lit(SOFT_HYPHEN), F.lit("")), F.lit(WHITE)), f"^{LETTERS}", 0)
    return x.withColumn("_a", F.when(F.col("_hard"), F.lower(head))).withColumn("_b", F.when(F.col("_hard"), F.lower(tail)))


def _joined(x: DataFrame, *also: str) -> DataFrame:
    """Lines of ``_line_ends`` to texts; ``_keep`` is set where a hyphen stays."""
    order = Window.partitionBy(*PAGE, "para").orderBy("k")
    drop = F.col("_soft") | F.col("_hard") & F.col("_keep").isNull()
    glued = F.coalesce(F.lag(F.col("_soft") | F.col("_hard")).over(order), F.lit(False))
    body = F.when(drop, F.left("text", F.length("text") - 1)).otherwise(F.col("text"))
    gap = F.when(F.col("_next").isNull() | F.col("text").rlike(f"[ {SOFT_HYPHEN}-]$"), "").otherwise(" ")
    x = x.withColumn("_body", F.concat(F.when(glued, F.ltrim(body, F.lit(WHITE))).otherwise(body), gap))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "_body"))), lambda s: s["_body"]), "")
    return x.groupBy(*PAGE, "para").agg(strip(text).alias("text"), *[F.first(c).alias(c) for c in also]).where("text <> ''")


def _parts(words: Column) -> Column:
    """The parts before and behind each hyphen of some words."""
    cut = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.named_struct(
        F.lit("a"), F.array_join(F.slice(p, 1, i), "-"), F.lit("b"), F.array_join(F.slice(p, i + 1, F.size(p)), "-")))
    return F.flatten(F.transform(F.filter(words, lambda w: w.contains("-")), lambda w: _bound(F.split(w, "-"), cut)))


def _hyphenated(lines: Column) -> Column:
    """Where words keep their hyphen when they are cut at it: the parts before and behind each hyphen of a page's words, unless the
    page has the joined word as well. Few words have one, so a page's lines carry little."""
    words = F.array_distinct(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(F.lower(F.replace(x["text"], F.lit(SOFT_HYPHEN), F.lit(""))), F.lit(LETTERS), F.lit(0)))))
    return _bound(words, lambda ws: F.filter(_parts(ws), lambda c: ~F.array_contains(ws, F.concat(c["a"], c["b"]))))


def _with_hyphenated(lines: DataFrame) -> DataFrame:
    """lines with their page's ``_kept``, as ``_hyphenated`` finds it of an array of them. A page's hyphenated words are gathered, then
    those of their joined words that some line has, so only few lines are cut into words, each at most twice."""
    page = Window.partitionBy(*PAGE)
    inner = F.when(F.replace("text", F.lit(SOFT_HYPHEN), F.lit("")).rlike(r"\p{L}-\p{L}"), F.filter(_words("text"), lambda w: w.contains("-")))
    x = lines.withColumn("_inner", F.array_distinct(F.flatten(F.collect_list(inner).over(page))))
    x = x.withColumn("_kept", F.when(F.size("_inner") > 0, _parts(F.col("_inner"))))
    joined = F.transform("_kept", lambda c: F.concat(c["a"], c["b"]))
    x = x.withColumn("_has", F.flatten(F.collect_list(F.when(F.size("_inner") > 0, F.array_intersect(joined, _words("text")))).over(page)))
    return x.withColumn("_kept", F.filter("_kept", lambda c: ~F.array_contains("_has", F.concat(c["a"], c["b"])))).drop("_inner", "_has")


def pages_to_paragraphs(lines: DataFrame, height: float) -> DataFrame:
    """lines(doc_id, page, k, text, size, family, x0, y0, x1, y1) of whole documents -> (doc_id, para, text): furniture and footnotes
    left out, columns in reading order, lines joined to paragraphs and headings, sentences that go on over a page joined.

    The operators of this and the layout module as one plan: lines are dealt out by page once, the page's measures, words and gutters
    are windows over them, and everything up to its paragraphs stays within the page; then the pages of a document are brought
    together. So there are two shuffles, whatever the steps between, and no line works on the whole of its page."""
    each = _with_hyphenated(with_metrics(lines.select(*PAGE, "k", "text", "size", "family", "x0", "y0", "x1", "y1")))
    ordered = with_breaks(in_order(with_gutters(with_roles(each, height)))).where("role in ('body', 'heading', 'title')")
    fresh = F.when(F.col("role") == "body", F.col("breaks")).otherwise(~same_heading())
    block = ordered.withColumn("_new", fresh.cast("int")).withColumn("para", F.sum("_new").over(Window.partitionBy(*PAGE).orderBy("pos")))
    ends = _line_ends(block.select(*PAGE, "para", F.col("pos").alias("k"), F.when(F.col("role") == "body", F.col("text")).otherwise(strip("text")).alias("text"), "_kept"))
    keep = F.exists("_kept", lambda w: (w["a"] == F.col("_a")) & (w["b"] == F.col("_b")))
    joined = _joined(ends.withColumn("_keep", F.when(F.col("_hard") & keep, F.lit(True))).drop("_kept"))
    done = joined.select(*PAGE, "para", finish_paragraph("text").alias("text")).where("text <> ''")
    paras = done.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("para", "text"))), lambda s: s["text"]).alias("paras"))
    return stitch_pages(paras)


def split_verses(spans: DataFrame) -> DataFrame:
    """spans(doc_id, page, pos, span, text, role, line_role) in reading order -> blocks(doc_id, page, seq, kind, text): a paragraph
    from each verse mark to the next, "Chapter N" before the headings that stand right before it, callers left out, a drop cap
    glued to the text behind it. All steps are windows and groups of a page, in one order of its spans."""
    order = Window.partitionBy(*PAGE).orderBy("pos", "span")
    head = F.col("line_role").isin("heading", "title")
    x = spans.where(head | (F.col("role") != "caller")).withColumn("kind", F.when(head, F.col("line_role")).when(F.col("role").isin("chapter", "verse"), F.col("role")).otherwise("body"))
    x = x.withColumn("_n", F.row_number().over(order))
    before = F.lag("kind").over(order)
    fresh = F.col("kind").isin("chapter", "verse") | (F.col("kind") == "body") & before.isin("heading", "title", "chapter") | head & ~F.coalesce(before == F.col("kind"), F.lit(False))
    x = x.withColumn("para", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(order)).where("kind <> 'verse'")
    # A drop cap waits for the next text that isn't blank.
    cap = F.when((F.col("kind") == "body") & (F.col("role") == "dropcap"), strip("text"))
    ink = (F.col("kind") == "body") & (F.col("role") == "text") & (strip("text") != "")
    x = x.withColumn("_ink", F.max(F.when(ink, F.col("_n"))).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_cap", F.last(F.when(cap.isNotNull(), F.struct(F.col("_n").alias("n"), cap.alias("cap"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    caps = F.when(F.col("_cap.n") > F.coalesce("_ink", F.lit(0)), F.col("_cap.cap"))
    x = x.withColumn("text", F.when(ink & caps.isNotNull(), F.concat(caps, F.ltrim("text"))).otherwise(F.col("text"))).where("role <> 'dropcap' or kind <> 'body'")
    x = x.withColumn("text", F.when(F.col("kind") == "chapter", F.concat(F.lit("Chapter "), F.coalesce(F.nullif(F.regexp_extract("text", r"^\s*0*(\d+)", 1), F.lit("")), F.lit("0")))).otherwise(F.col("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]), "")
    lines = x.groupBy(*PAGE, "para", F.col("pos").alias("k")).agg(joined.alias("text"), F.min(F.struct("_n", "kind")).alias("_f"))
    lines = lines.withColumn("_f", F.min("_f").over(Window.partitionBy(*PAGE, "para").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    blocks = join_page_lines(lines, "_f").select(*PAGE, "para", "text", F.col("_f.kind").alias("kind"), F.col("_f._n").cast("double").alias("_at"))
    along = Window.partitionBy(*PAGE).orderBy("_at")
    other = (F.col("kind") != "heading").cast("int")
    blocks = blocks.withColumn("_run", F.sum(other).over(along) - other)  # a chapter shares the number of the headings before it
    start = F.min(F.when(F.col("kind") == "heading", F.col("_at"))).over(Window.partitionBy(*PAGE, "_run"))
    blocks = blocks.withColumn("_at", F.when((F.col("kind") == "chapter") & start.isNotNull(), start - 0.5).otherwise(F.col("_at")))
    return blocks.select(*PAGE, (F.row_number().over(along) - 1).cast("long").alias("seq"), "kind", "text")


def _upper_median(heights: list[float]) -> float:
    return sorted(heights)[len(heights) // 2] or 1.0


def _gutters(lines: list[tuple], unit: float) -> list[tuple[float, float]]:
    """``page_gutters`` of one page's recognised lines, with the bounds of ``reading_groups``."""
    left, right = min(x[2] for x in lines), max(x[4] for x in lines)
    wide = right - left
    narrow = sorted((x[2], x[4]) for x in lines if x[4] - x[2] < 0.62 * wide)
    if len(narrow) < 8 or wide < 8 * unit:
        return []
    gaps, reach = [], narrow[0][1]
    for x0, x1 in narrow[1:]:
        if x0 > reach + 0.3 * unit:
            gaps.append((reach, x0))
        reach = max(reach, x1)
    return [(g0, g1) for g0, g1 in gaps if g1 - g0 >= 0.45 * unit and left + 0.15 * wide <= (g0 + g1) / 2 <= right - 0.15 * wide
            and sum(x1 <= g0 + 1 for _, x1 in narrow) >= 4 and sum(x0 >= g1 - 1 for x0, _ in narrow) >= 4]


def _reading_parts(lines: list[tuple]) -> list[list[tuple]]:
    """``reading_groups`` of one page's lines, part after part."""
    unit = _upper_median([x[5] - x[3] for x in lines])
    gutters = _gutters(lines, unit)
    if not gutters:
        return [lines]
    parts, section, last = {}, 0, None
    for x in sorted(lines, key=lambda x: (x[3] + x[5], x[2], x[0])):
        across = any(x[2] < g0 - 0.15 * unit and x[4] > g1 + 0.15 * unit for g0, g1 in gutters)
        section += last is not None and across != last
        last = across
        column = -1 if across else sum((x[2] + x[4]) / 2 > (g0 + g1) / 2 for g0, g1 in gutters)
        parts.setdefault((section, column), []).append(x)
    return [parts[key] for key in sorted(parts)]


def _part_paragraphs(lines: list[tuple]) -> list[str]:
    """Lines of a part to visual rows, those to paragraphs. A line belongs to the row before if its centre is within half a line's
    height (the part's upper median) of that row's first; pictures stand alone."""
    reach = 0.5 * _upper_median([x[5] - x[3] for x in lines])
    rows, first, alone = [], 0.0, True
    for centre, _, x in sorted(((x[3] + x[5]) / 2, x[0], x) for x in lines):
        if x[6] or alone or abs(centre - first) >= reach:
            rows.append([])
            first, alone = centre, x[6]
        rows[-1].append(x)
    made = [(joined_pieces([t for _, _, t in sorted((x[2], x[0], x[1]) for x in r)]), any(x[6] for x in r), min(x[2] for x in r), min(x[3] for x in r), max(x[4] for x in r), max(x[5] for x in r))
            for r in rows]
    short = 0.7 * (max(r[4] - r[2] for r in made) or 1.0)
    paras, before = [], None
    for row in made:
        text, picture, _, y0, _, _ = row
        if before is None or picture or before[1] or y0 - before[5] > 0.65 * max(before[5] - before[3], 1.0) or before[4] - before[2] < short and before[0][-1:] in _ENDS:
            paras.append([])
        paras[-1].append(text)
        before = row
    return [p for p in map(joined_pieces, paras) if p]


_ENDS = {*STOPS, *QUOTES}
_CHAPTER = re.compile(r"(?:Chapter|CHAPTER)[ \t\n\x0b\f\r]+[0-9]+")


def _page_paragraphs(lines: list[tuple]) -> list[str]:
    """Paragraphs of a page from its lines (k, text, x0, y0, x1, y1, picture): ``stitch_pages`` of its parts."""
    out: list[str] = []
    for part in _reading_parts(lines):
        paras = _part_paragraphs(part)
        if out and paras:
            last = out[-1]
            if last.rstrip(QUOTES)[-1:] not in set(STOPS) and unicodedata.category(paras[0][0]) == "Ll" and len(last) > 20 and not _CHAPTER.fullmatch(last):
                out[-1] = f"{last} {paras.pop(0)}"
        out += paras
    return out


def ocr_paragraphs(lines: DataFrame) -> DataFrame:
    """lines(doc_id, page, k, text, x0, y0, x1, y1) as recognised -> (doc_id, page, para, text): the parts of a page in reading order
    (columns one after another), in each its lines to visual rows, rows to paragraphs at pictures, wide gaps and short rows that
    end a sentence; a sentence that goes on in the next part is joined. The lines are dealt out and sorted by page once; what a
    row and a paragraph are depends on those before, so a page's lines are taken in their order within the task."""
    sides = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    ink = lines.where(strip("text") != "").select(*PAGE, "k", "text", *sides, is_picture("text").alias("picture"))
    names = ["k", "text", "x0", "y0", "x1", "y1", "picture"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, page in whole_pages(batches):
            rows = list(zip(*(table[c].to_pylist() for c in names), strict=True))
            starts = np.flatnonzero(np.diff(page, prepend=-1)).tolist()
            at, para, texts = [], [], []
            for start, end in zip(starts, [*starts[1:], len(rows)], strict=True):
                found = _page_paragraphs(rows[start:end])
                at += [start] * len(found)
                para += range(len(found))
                texts += found
            own = pa.array(at, pa.int64())
            yield from pa.table({c: table[c].take(own) for c in PAGE} | {"para": pa.array(para, pa.int64()), "text": pa.array(texts, pa.string())}).to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in PAGE) + ", para long, text string"
    return ink.repartition(*PAGE).sortWithinPartitions(*PAGE, "k").mapInArrow(solve, schema)


def figure_candidates(images: DataFrame, drawings: DataFrame, words: DataFrame, labels: DataFrame, width: float, height: float) -> DataFrame:
    """Figures of a page, from top to bottom: pictures of a fair size, and clusters of at least four drawings that aren't rules,
    grids, text or background, with short labels within 24 points. images, drawings, words (doc_id, page, box, x0, y0, x1, y1),
    labels with text as well -> (doc_id, page, pos, x0, y0, x1, y1). A page may have any number of drawings."""
    w, h, area = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), width * height
    sides = ["x0", "y0", "x1", "y1"]
    pictures = images.where((w >= 40) & (h >= 30) & (w * h / area).between(0.02, 0.85)).select(*PAGE, *sides)
    rule = (w > 0.6 * width) & (h < 4) | (h > 0.6 * height) & (w < 4) | (w * h > 0.6 * area) | (w < 0.5) & (h < 0.5)
    groups = cluster_boxes(drawings.where(~rule), 40.0).groupBy(*PAGE, "cluster").agg(
        F.count("*").alias("_n"), F.count_if((w < 2) | (h < 2)).alias("_thin"), *[F.min(c).alias(c) for c in sides[:2]], *[F.max(c).alias(c) for c in sides[2:]])
    fair = groups.where((F.col("_n") >= 4) & (w * h / area).between(0.03, 0.85) & (F.col("_thin") < 0.8 * F.col("_n")))
    centre = [(F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.y0") + F.col("w.y1")) / 2]
    inside = [F.col(f"w.{k}") == F.col(f"g.{k}") for k in PAGE] + [centre[0].between(F.col("g.x0"), F.col("g.x1")), centre[1].between(F.col("g.y0"), F.col("g.y1"))]
    text = fair.alias("g").join(words.alias("w"), inside).groupBy(*[F.col(f"g.{c}").alias(c) for c in (*PAGE, "cluster")]).agg(
        F.sum((F.col("w.x1") - F.col("w.x0")) * (F.col("w.y1") - F.col("w.y0"))).alias("_text"))
    drawn = fair.join(text, [*PAGE, "cluster"], "left").where(F.coalesce("_text", F.lit(0.0)) <= 0.3 * w * h).select(*PAGE, *sides)
    numbered = lambda df: df.withColumn("box", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*sides)))
    boxes = merge_boxes(numbered(pictures.unionByName(drawn)), 10.0).select(*PAGE, "box", *sides)
    short = labels.where((F.size(F.filter(F.split("text", r"(?U)\s+"), lambda t: t != "")).between(1, 3)) & (F.length(strip("text")) <= 40))
    near = short.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("box", *sides))).alias("_l"))
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in sides])

    def absorb(b, x):
        cx, cy = (x["x0"] + x["x1"]) / 2, (x["y0"] + x["y1"]) / 2
        hit = cx.between(b["x0"] - 24, b["x1"] + 24) & cy.between(b["y0"] - 24, b["y1"] + 24)
        grown = F.struct(F.least(b["x0"], x["x0"]).alias("x0"), F.least(b["y0"], x["y0"]).alias("y0"), F.greatest(b["x1"], x["x1"]).alias("x1"), F.greatest(b["y1"], x["y1"]).alias("y1"))
        return F.when(hit, grown).otherwise(b)

    grown = boxes.join(near, PAGE, "left").withColumn("_b", F.when(F.col("_l").isNull(), box).otherwise(F.aggregate(F.concat("_l", "_l"), box, absorb)))
    final = merge_boxes(grown.select(*PAGE, "box", "_b.*"), 10.0)
    clipped = final.select(*PAGE, F.greatest(F.col("x0") - 4, F.lit(0.0)).alias("x0"), F.greatest(F.col("y0") - 4, F.lit(0.0)).alias("y0"),
                           F.least(F.col("x1") + 4, F.lit(width)).alias("x1"), F.least(F.col("y1") + 4, F.lit(height)).alias("y1"))
    clipped = clipped.where((w >= 20) & (h >= 20))
    return clipped.select(*PAGE, F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "y1", "x1")).cast("long").alias("pos"), *sides)


def place_picture_text(blocks: DataFrame, pictures: DataFrame) -> DataFrame:
    """blocks(doc_id, page, pos, kind, cx, cy, text) with the texts of pictures(doc_id, page, picture, cx, cy, text) put in: behind
    the last block above it in its column, else before the first one below, else at the end. A text of under three characters
    is left out. Pictures are placed one after another, so a page's blocks and pictures are one row while that is done."""
    item = lambda kind: F.struct(kind.alias("kind"), F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"), "text")
    rows = blocks.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", item(F.col("kind")).alias("b")))), lambda s: s["b"]).alias("_b"))
    said = pictures.where(F.length("text") >= 3).groupBy(*PAGE).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("picture", item(F.lit("image")).alias("b")))), lambda s: s["b"]).alias("_p"))

    def insert(bs, p):
        column = lambda b: (F.abs(b["cx"] - p["cx"]) < 0.3) | (F.abs(b["cx"] - 0.5) < 0.05)
        above = F.array_max(F.transform(bs, lambda b, n: F.when(column(b) & (b["cy"] < p["cy"]), n)))
        below = F.array_min(F.transform(bs, lambda b, n: F.when(column(b) & (b["cy"] >= p["cy"]), n)))
        at = F.coalesce(above + 1, below, F.size(bs))
        return F.concat(F.slice(bs, 1, at), F.array(p), F.slice(bs, at + 1, F.size(bs)))

    kind = rows.schema["_b"].dataType.simpleString()
    none = F.array().cast(kind)
    both = rows.join(said, PAGE, "full").select(*PAGE, F.aggregate(F.coalesce("_p", none), F.coalesce("_b", none), insert).alias("_all"))
    return both.select(*PAGE, F.posexplode("_all").alias("pos", "_i")).select(*PAGE, F.col("pos").cast("long").alias("pos"), "_i.*")
