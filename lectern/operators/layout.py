"""Page layout as relational work. Every window and join has the page (doc_id, page) as its key, so pages spread over tasks.

Lines: doc_id, page, k (line number), text, size, baseline, family, x0, y0, x1, y1; spans have one row for each piece of a line.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.markup import table_sentences
from lectern.functions.text import BULLETS, WHITE, clean_paragraph, clean_pdf_text, ends_sentence, finish_paragraph, replaces, strip

PAGE = ["doc_id", "page"]


def _is_number(text: str | Column) -> Column:
    """Whether the only word of a line is a number: up to four digits or seven Roman ones."""
    words = F.filter(F.split(text, r"(?U)\W+"), lambda w: w != "")
    word = F.lower(F.get(words, F.lit(0)))
    arabic = (F.translate(word, "0123456789", "") == "") & (F.length(word) <= 4)
    return (F.size(words) == 1) & (arabic | (F.translate(word, "ivxlcdm", "") == "") & (F.length(word) <= 7))


def _is_range(text: str | Column) -> Column:
    """Whether a text is one or two small numbers with a dash between ("3", "12 – 14")."""
    ends = F.split(F.translate(strip(text), "–", "-"), "-")
    small = lambda x: (F.translate(strip(x), "0123456789", "") == "") & F.length(strip(x)).between(1, 3)
    return (F.size(ends) <= 2) & F.forall(ends, small)


def _is_item(text: Column) -> Column:
    """Whether a line opens a list item: a bullet, or a number of one or two digits with a point or bracket before a capital."""
    mark, rest = F.substring_index(text, " ", 1), F.ltrim(F.substring(text, F.length(F.substring_index(text, " ", 1)) + 1, F.length(text)))
    number = F.left(mark, F.length(mark) - 1)
    numbered = F.right(mark, F.lit(1)).isin(".", ")") & (F.translate(number, "0123456789", "") == "") & F.length(number).between(1, 2)
    bullet = (text != "") & (F.instr(F.lit(BULLETS), F.left(text, F.lit(1))) > 0)
    return bullet | numbered & rest.rlike(r"^[A-Z“\"(]")


def _page(*order: str):
    return Window.partitionBy(*PAGE).orderBy(*order)


def _median(items: Column, value: str, weight: str) -> Column:
    """The median of the values of some structs, each as often as its weight says; of an even number the middle between two."""
    sized = F.array_sort(F.transform(F.filter(items, lambda x: x[value].isNotNull() & (x[weight] > 0)), lambda x: F.struct(x[value].cast("double").alias("v"), x[weight].alias("w"))))
    start = F.struct(F.array().cast("array<struct<v: double, upto: bigint>>").alias("rows"), F.lit(0).cast("long").alias("upto"))
    step = lambda now, x: F.struct(
        F.concat(now["rows"], F.array(F.struct(x["v"].alias("v"), (now["upto"] + x["w"]).alias("upto")))).alias("rows"), (now["upto"] + x["w"]).alias("upto"))
    at = lambda s, n: F.get(F.filter(s["rows"], lambda x: x["upto"] > n), F.lit(0))["v"]
    half = lambda n: F.floor(n / 2)
    middle = lambda low, high: F.when(low == high, low).otherwise(0.5 * low + 0.5 * high)
    return F.aggregate(sized, start, step, lambda s: middle(at(s, half(s["upto"] - 1)), at(s, half(s["upto"]))))


def page_lines(spans: DataFrame) -> DataFrame:
    """spans(doc_id, page, line, span, text, size, font, x0, y0, x1, y1, origin_y) -> lines: empty ones dropped, size the median
    weighted by characters, baseline the median of spans of more than a character, family the one of most characters.

    A line's spans are brought together once. Most lines have one, which is its own median."""
    n = F.length(strip("text")).cast("long")
    item = F.struct("span", "text", "size", F.regexp_replace("font", "[-,].*$", "").alias("family"), "origin_y", n.alias("n"), F.lit(1).cast("long").alias("one"))
    lines = spans.where(F.length("text") > 0).groupBy(*PAGE, "line").agg(
        F.collect_list(item).alias("_s"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    s, only, single = F.col("_s"), F.get("_s", F.lit(0)), F.size("_s") == 1
    text = F.when(single, only["text"]).otherwise(F.array_join(F.transform(F.array_sort(F.transform(s, lambda x: F.struct(x["span"].alias("span"), x["text"].alias("text")))), lambda x: x["text"]), ""))
    lines = lines.withColumn("text", text).where(strip("text") != "")
    longer = F.filter(s, lambda x: x["n"] > 1)
    baseline = F.when(single, only["origin_y"].cast("double")).otherwise(F.coalesce(_median(longer, "origin_y", "one"), _median(s, "origin_y", "one")))
    size = F.when(single, only["size"].cast("double")).otherwise(_median(s, "size", "n"))
    counted = F.filter(s, lambda x: (x["n"] > 0) & ~_is_range(x["text"]))
    mine = lambda f: F.filter(counted, lambda x: x["family"].eqNullSafe(f))
    families = F.transform(F.array_distinct(F.transform(counted, lambda x: x["family"])), lambda f: F.struct(
        F.aggregate(mine(f), F.lit(0).cast("long"), lambda a, x: a - x["n"]).alias("w"), F.array_min(F.transform(mine(f), lambda x: x["span"])).alias("first"), f.alias("family")))
    digit = F.left(F.ltrim(only["text"], F.lit(WHITE)), F.lit(1)).isin(*"0123456789-–")  # what may be a range
    family = F.when(single & ~digit, only["family"]).otherwise(F.array_min(families)["family"])
    return lines.select(*PAGE, "line", "text", baseline.alias("baseline"), "x0", "y0", "x1", "y1", size.alias("size"), F.coalesce(family, F.lit("")).alias("family"))


def merge_baselines(lines: DataFrame, number: str = "line") -> DataFrame:
    """Neighbours on one baseline that touch become one line: doc_id, page, piece, text, size, x0, y0, x1, y1, pieces."""
    order = _page(F.bround("baseline"), "x0", number)
    near = (F.abs(F.lag("baseline").over(order) - F.col("baseline")) < 1.5) & (F.col("x0") - F.lag("x1").over(order)).between(0, 1e9) & (
        F.col("x0") - F.lag("x1").over(order) < 0.3 * F.greatest(F.lag("size").over(order), F.lit(1.0)))
    m = lines.withColumn("_new", (~F.coalesce(near, F.lit(False))).cast("int")).withColumn("_at", F.row_number().over(order))
    m = m.withColumn("piece", F.sum("_new").over(_page("_at")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"]), "")
    return m.groupBy(*PAGE, "piece").agg(text.alias("text"), F.max("size").alias("size"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"),
                                         F.max("y1").alias("y1"), F.count("*").alias("pieces")).withColumn("piece", F.col("piece").cast("long"))


def body_metrics(spans: DataFrame) -> DataFrame:
    """Per page the size and family of ordinary text: the half-point size with most characters, the mean size in it."""
    s = spans.withColumn("_n", F.length(strip("text")).cast("long")).where("_n > 0").withColumn("_b", F.bround(F.col("size") * 2) / 2)
    first = F.min(F.struct("y0", "x0")).alias("_first")
    sizes = s.groupBy(*PAGE, "_b").agg(F.sum("_n").alias("_w"), (F.sum(F.col("size") * F.col("_n")) / F.sum("_n")).alias("_mean"), first)
    top = sizes.groupBy(*PAGE).agg(F.min_by(F.struct("_b", "_mean"), F.struct(-F.col("_w"), "_first")).alias("_t"))
    families = s.join(top, PAGE).where("_b = _t._b").groupBy(*PAGE, "family").agg(F.sum("_n").alias("_w"), first)
    family = families.groupBy(*PAGE).agg(F.min_by("family", F.struct(-F.col("_w"), "_first")).alias("family"))
    return top.join(family, PAGE).select(*PAGE, F.col("_t._mean").alias("body"), "family")


def with_metrics(lines: DataFrame) -> DataFrame:
    """lines with their page's ``body`` size and family ``_bf``, as ``body_metrics`` finds them; pages without any are left out. The
    lines are dealt out by page once, so whatever works on pages behind this shuffles nothing, and their table is read once."""
    n = F.length(strip("text")).cast("long")
    x = lines.repartition(*PAGE).withColumn("_n", F.when(n > 0, n)).withColumn("_b", F.bround(F.col("size") * 2) / 2)
    place = F.when(F.col("_n").isNotNull(), F.struct("y0", "x0"))
    kind, same, page = Window.partitionBy(*PAGE, "_b", "family"), Window.partitionBy(*PAGE, "_b"), Window.partitionBy(*PAGE)
    x = x.withColumn("_fw", F.sum("_n").over(kind)).withColumn("_ff", F.min(place).over(kind))
    x = x.withColumn("_w", F.sum("_n").over(same)).withColumn("_total", F.sum(F.col("size") * F.col("_n")).over(same)).withColumn("_f", F.min("_ff").over(same))
    most = F.struct((-F.col("_w")).alias("w"), F.col("_f").alias("f"), F.col("_b").alias("b"), (F.col("_total") / F.col("_w")).alias("mean"), (-F.col("_fw")).alias("fw"), F.col("_ff").alias("ff"), F.col("family").alias("family"))
    x = x.withColumn("_top", F.min(F.when(F.col("_fw").isNotNull(), most)).over(page)).where("_top.b is not null")
    return x.withColumn("body", F.col("_top.mean")).withColumn("_bf", F.col("_top.family")).drop("_n", "_b", "_fw", "_ff", "_w", "_total", "_f", "_top")


def classify_lines(lines: DataFrame, metrics: DataFrame, height: float) -> DataFrame:
    """lines with role: furniture, footnote, title, heading or body."""
    return with_roles(lines.join(metrics.select(*PAGE, "body", F.col("family").alias("_bf")), PAGE), height)


def with_roles(lines: DataFrame, height: float) -> DataFrame:
    """``classify_lines`` of lines that have their page's ``body`` size and family ``_bf``."""
    x = lines.withColumn("_t", strip("text"))
    differs = (F.col("size") < 0.97 * F.col("body")) | ~F.col("family").isin("") & (F.col("family") != F.col("_bf"))
    # What costs much is asked only of the lines that it matters for; ``when`` is what keeps it from being made ahead for all.
    number, short = F.coalesce(F.when((F.col("y0") >= 0.93 * height) | (F.col("y1") <= 0.10 * height), _is_number("text")), F.lit(False)), F.length("_t") <= 70
    edge = (F.col("y0") >= 0.955 * height) | (F.col("y1") <= 0.085 * height) & (differs | number)
    bare = ((F.col("y0") >= 0.93 * height) | (F.col("y1") <= 0.10 * height)) & number
    x = x.withColumn("_furniture", short & (F.col("size") <= 1.15 * F.col("body")) & (edge | bare))
    # Footnotes: from the bottom up, as long as lines are small, low enough and close to the one below.
    up = Window.partitionBy(*PAGE, "_furniture").orderBy(F.col("y0").desc(), F.col("k").desc())
    gap = F.coalesce(F.lag("y0").over(up) - F.col("y1"), F.lit(0.0))
    fails = (F.col("size") > 0.86 * F.col("body")) | (F.col("y0") < 0.45 * height) | (gap > 2.2 * F.col("size"))
    x = x.withColumn("_fails", fails.cast("int")).withColumn("_note", ~F.col("_furniture") & (F.max("_fails").over(up) == 0))
    print_ = (F.col("y0") >= 0.91 * height) & short & differs & (F.col("size") <= 0.97 * F.col("body"))
    letters = F.when((F.col("size") >= 1.25 * F.col("body")) | (F.col("family") != F.col("_bf")), F.length(F.regexp_replace("_t", r"(?U)[^\p{L}]", "")))
    title = (F.col("size") >= 1.25 * F.col("body")) & (F.length("_t") <= 120) & (letters >= 2)
    shout = (F.upper("_t") == F.col("_t")) & (F.lower("_t") != F.col("_t"))
    if "bold" in lines.columns:
        shout = shout | F.coalesce(F.col("bold"), F.lit(False))
    heading = (F.length("_t") <= 80) & (F.col("family") != "") & (F.col("family") != F.col("_bf")) & ~ends_sentence("_t") & shout & (letters >= 2)
    role = F.when(F.col("_furniture"), "furniture").when(F.col("_note"), "footnote").when(print_, "furniture").when(title, "title").when(heading, "heading").otherwise("body")
    return x.withColumn("role", role).drop("_t", "_bf", "_furniture", "_fails", "_note")


def find_gutters(lines: DataFrame) -> DataFrame:
    """Gutters (doc_id, page, g0, g1) between text columns of lines(role, body, ...): gaps of the merged narrow lines."""
    gaps = _gaps(lines.where("role in ('body', 'heading')"), F.lit(True), 6, F.col("body"), 12.0, 0.35, 0.5, 3)
    return gaps.where("_gap is not null").select(*PAGE, "_gap.*").distinct()


def with_gutters(lines: DataFrame) -> DataFrame:
    """lines with their page's gutters ``_g``, as ``find_gutters`` finds them."""
    x = _gaps(lines, F.coalesce(F.col("role").isin("body", "heading"), F.lit(False)), 6, F.col("body"), 12.0, 0.35, 0.5, 3)
    return x.withColumn("_g", F.collect_set("_gap").over(Window.partitionBy(*PAGE))).drop("_gap")


def _gaps(lines: DataFrame, counts: Column, least: int, unit: Column, page_units: float, joint: float, gap_units: float, side: int) -> DataFrame:
    """lines with ``_gap``, the gutter (g0, g1) that ends at this line. Only lines that count, and are narrow, make gutters. A gutter
    has ``side`` lines on each side if that many ends come before it and that many beginnings behind: the ends of a page are
    taken in order, so no line is compared with each gap."""
    page = Window.partitionBy(*PAGE)
    whole = page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = lines.withColumn("_u", unit).withColumn("_c", counts).withColumn("_lines", F.count_if("_c").over(page))
    x = x.withColumn("_left", F.min(F.when(F.col("_c"), F.col("x0"))).over(page)).withColumn("_tw", F.max(F.when(F.col("_c"), F.col("x1"))).over(page) - F.col("_left"))
    narrow = F.col("_c") & (F.col("_lines") >= least) & (F.col("_tw") >= page_units * F.col("_u")) & ((F.col("x1") - F.col("x0")) < 0.62 * F.col("_tw"))
    x = x.withColumn("_a", F.when(narrow, F.col("x0"))).withColumn("_e", F.when(narrow, F.col("x1")))
    ends = page.orderBy(F.asc_nulls_last("_e"))
    x = x.withColumn("_at", F.row_number().over(ends)).withColumn("_end", F.max(F.when(F.col("_at") == side, F.col("_e"))).over(page))
    order = page.orderBy("_a", "_e")
    x = x.withColumn("_at", F.count("_a").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("g0", F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_m", F.count("_a").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    x = x.withColumn("_begin", F.max(F.when(F.col("_at") == F.col("_m") - side + 1, F.col("_a"))).over(whole))
    g0, g1 = F.col("g0"), F.col("_a")
    centre = (g0 + g1) / 2
    good = (F.col("_m") >= least) & (g1 > g0 + joint * F.col("_u")) & (g1 - g0 >= gap_units * F.col("_u")) & centre.between(F.col("_left") + 0.15 * F.col("_tw"), F.col("_left") + F.col("_tw") - 0.15 * F.col("_tw"))
    good = good & (F.col("_end") <= g0 + 1) & (F.col("_begin") >= g1 - 1)
    return x.withColumn("_gap", F.when(good, F.struct("g0", F.col("_a").alias("g1")))).drop("_u", "_c", "_lines", "_left", "_tw", "_a", "_e", "_at", "_end", "_m", "_begin", "g0")


def reading_order(lines: DataFrame, gutters: DataFrame) -> DataFrame:
    """Text lines with col, spanning, and pos: bands of columns between the lines that span a gutter."""
    per_page = gutters.groupBy(*PAGE).agg(F.collect_list(F.struct("g0", "g1")).alias("_g"))
    return in_order(lines.join(per_page, PAGE, "left").withColumn("_g", F.coalesce("_g", F.array().cast("array<struct<g0:double,g1:double>>"))))


def in_order(lines: DataFrame) -> DataFrame:
    """``reading_order`` of lines that have their page's gutters ``_g``."""
    x = lines.where("role in ('body', 'heading', 'title', 'table', 'figure')")
    centre = (F.col("x0") + F.col("x1")) / 2
    x = x.withColumn("col", F.size(F.filter("_g", lambda g: centre > (g["g0"] + g["g1"]) / 2)))
    x = x.withColumn("spanning", F.exists("_g", lambda g: (F.col("x0") < g["g0"] - 2) & (F.col("x1") > g["g1"] + 2)))
    # A spanning line closes the band before it: bands count the spanning lines above.
    x = x.withColumn("_band", F.sum(F.col("spanning").cast("int")).over(_page("y0", "x0", "k")))
    column = F.when(F.col("spanning"), -1).otherwise(F.col("col"))
    return x.withColumn("pos", F.row_number().over(_page("_band", column, "y0", "x0", "k")).cast("long")).drop("_g", "_band")


def paragraph_breaks(ordered: DataFrame) -> DataFrame:
    """Body lines in reading order (pos) with ``breaks``: a bullet, a wide gap, an indent, or a short line before a capital."""
    return with_breaks(ordered).where("role = 'body'")


def with_breaks(ordered: DataFrame) -> DataFrame:
    """``paragraph_breaks`` of all lines; only those of body lines mean something."""
    order = _page("pos")
    column = Window.partitionBy(*PAGE, "col", "role")
    x = ordered.withColumn("_lo", F.min("x0").over(column)).withColumn("_hi", F.max("x1").over(column))
    before = lambda c: F.lag(c).over(order)
    body_before = before("role") == "body"
    text = F.ltrim(F.col("text"), F.lit(WHITE))
    gap = (F.col("col") == before("col")) & (F.col("y0") - before("y1") > 0.55 * F.greatest(before("y1") - before("y0"), F.lit(1.0)))
    indent = (F.col("x0") - F.col("_lo")) - (before("x0") - before("_lo")) >= 0.6 * F.col("body")
    short = before("x1") - before("x0") < 0.72 * (before("_hi") - before("_lo"))
    # Texts are looked at only where their place leaves it open.
    said = F.when(indent | short, ends_sentence(strip(before("text"))) & (indent | short & text.rlike(r"^\p{Lu}")))
    item = F.when(F.instr(F.lit(BULLETS + "0123456789"), F.left(text, F.lit(1))) > 0, _is_item(text))
    breaks = F.when(F.coalesce(body_before, F.lit(False)), gap | F.coalesce(said, F.lit(False)) | F.coalesce(item, F.lit(False))).otherwise(True)
    return x.withColumn("breaks", breaks).drop("_lo", "_hi")


def same_heading() -> Column:
    """Whether a line in reading order goes on with the title or heading of the line before."""
    before = lambda c: F.lag(c).over(_page("pos"))
    same = (before("role") == F.col("role")) & (F.abs(before("size") - F.col("size")) <= 0.6) & (F.col("y0") - before("y1") <= 0.9 * before("size")) & (before("col") == F.col("col"))
    return F.coalesce(same, F.lit(False))


def merge_headings(ordered: DataFrame) -> DataFrame:
    """Consecutive title or heading lines of one role, size, column and place as one block."""
    x = ordered.withColumn("_new", (~same_heading()).cast("int"))
    x = x.withColumn("_run", F.sum("_new").over(_page("pos"))).where("role in ('title', 'heading')")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", strip("text").alias("t")))), lambda s: s["t"]), " ")
    return x.groupBy(*PAGE, "_run").agg(F.first("role").alias("role"), text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).drop("_run")


def verse_runs(marks: DataFrame) -> DataFrame:
    """marks(doc_id, page, seq, number) -> the longest run n, n+1, n+2 ... of each page."""
    order = _page("seq")
    x = marks.withColumn("_new", F.when(F.lag("number").over(order) + 1 == F.col("number"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    return x.groupBy(*PAGE, "_run").agg(F.count("*").alias("_c")).groupBy(*PAGE).agg(F.max("_c").alias("run"))


def detect_scripture(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """pages(doc_id, page, n_chars, rotated) and verse runs -> doc_id, scripture: of at most 12 evenly spaced text pages two have
    a run of 5 or more (one, if there are at most two)."""
    text = pages.where("n_chars >= 20 and not rotated").withColumn("_i", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1)
    text = text.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id")))
    picks = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.bround(k * (F.col("_n") - 1) / 11).cast("int"))
    sample = text.where((F.col("_n") <= 12) | F.array_contains(picks, F.col("_i").cast("int")))
    hits = sample.join(runs, PAGE, "left").groupBy("doc_id").agg(F.count_if(F.col("run") >= 5).alias("_hits"), F.first("_n").alias("_n"))
    return hits.select("doc_id", (F.col("_hits") >= F.when(F.col("_n") <= 2, 1).otherwise(2)).alias("scripture"))


_SIDES = ("x0", "y0", "x1", "y1")


def _give_way(lines: DataFrame, boxes: DataFrame, row: Callable[[Column, Column], Column], taken: Callable[[Column, Column], Column]) -> DataFrame:
    """Box after box of a page, in the order of ``box``: the lines whose centre lies in it (margin 1) give way to one row, if it is
    ``taken``. A line in several boxes goes to the first, and the row of a box is a line for the boxes behind it.

    A page's lines and boxes are arrays of one row each, brought together by one join, so nothing is compared across pages."""
    sides = [F.col(c).cast("double").alias(c) for c in _SIDES]
    role = F.col("role") if "role" in lines.columns else F.lit("line")
    rows = F.col("rows") if "rows" in lines.columns else F.lit(None).cast("array<array<string>>")
    item = F.struct(F.col("k").cast("int").alias("k"), F.col("text"), *sides, role.alias("role"), rows.alias("rows"))
    items = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    rest = [c for c in boxes.columns if c not in (*PAGE, "box", *_SIDES)]
    per_page = boxes.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(F.col("box").cast("int").alias("box"), *sides, *rest))).alias("_boxes"))
    kind = items.schema["_items"].dataType.simpleString()  # a type name: what the boxes add may hold nulls

    def step(now: Column, box: Column) -> Column:
        centre = lambda i, u, v: (i[u] + i[v]) / 2
        held = lambda i: centre(i, "x0", "x1").between(box["x0"] - 1, box["x1"] + 1) & centre(i, "y0", "y1").between(box["y0"] - 1, box["y1"] + 1)
        inside = F.filter(now, held)
        new = F.concat(F.filter(now, lambda i: ~held(i)), F.array(row(box, inside))).cast(kind)
        return F.when(taken(box, inside), new).otherwise(now)

    both = items.join(per_page, PAGE, "full")
    left = F.coalesce("_items", F.array().cast(kind)).cast(kind)
    return both.select(*PAGE, F.inline(F.when(F.col("_boxes").isNull(), left).otherwise(F.aggregate("_boxes", left, step))))


def _row(box: Column, text: Column, role: str, rows: Column | None = None) -> Column:
    none = F.lit(None).cast("array<array<string>>") if rows is None else rows
    return F.struct(box["box"].alias("k"), text.alias("text"), *[box[c].alias(c) for c in _SIDES], F.lit(role).alias("role"), none.alias("rows"))


def take_figures(lines: DataFrame, figures: DataFrame) -> DataFrame:
    """Lines and figures(doc_id, page, box, x0, y0, x1, y1) -> (doc_id, page, k, text, x0, y0, x1, y1, role, rows): a figure keeps its
    place, and the words drawn in it are its text, by rows of four points from left to right."""
    def labels(inside: Column) -> Column:
        keyed = F.transform(inside, lambda i, n: F.struct(F.bround(i["y0"] / 4).alias("y"), i["x0"].alias("x"), n.alias("n"), strip(i["text"]).alias("t")))
        return finish_paragraph(F.array_join(F.transform(F.array_sort(keyed), lambda i: i["t"]), " "))

    return _give_way(lines, figures, lambda box, inside: _row(box, labels(inside), "figure"), lambda box, inside: F.lit(True))


def _owners(page: np.ndarray, order: np.ndarray, grid: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Which rows of some pages stay: lines (``order`` 0) that lie in no box, and boxes (1 and on, box after box of a page) that are
    taken and lie in no later one. A box is taken if it is a ``grid`` and holds a row that is still there. All pages take their
    box of the same number at once."""
    stays, cx, cy = order == 0, (x0 + x1) / 2, (y0 + y1) / 2
    first = np.flatnonzero(np.diff(page, prepend=-1))
    ends = np.append(first[1:], len(page))
    boxes = np.flatnonzero((order > 0) & grid)
    for number in np.unique(order[boxes]):
        box = boxes[order[boxes] == number]
        own = np.searchsorted(first, box, side="right") - 1
        size = ends[own] - first[own]
        b = np.repeat(box, size)
        row = np.arange(len(b)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[own], size)
        inside = stays[row] & (cx[row] >= x0[b] - 1) & (cx[row] <= x1[b] + 1) & (cy[row] >= y0[b] - 1) & (cy[row] <= y1[b] + 1)
        stays[row[inside]] = False
        stays[b[inside]] = True
    return stays


def take_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines (or what ``take_figures`` left) and tables(doc_id, page, box, x0, y0, x1, y1, rows array<array<string>>) -> the same
    columns: a table with a line inside, two rows and two columns takes the place of its lines; its cells come out tidied. Box after
    box, as for figures; lines and boxes are dealt out and sorted by page once, and only cells of tables that stay are tidied."""
    sides = [F.col(c).cast("double").alias(c) for c in _SIDES]
    role = F.col("role") if "role" in lines.columns else F.lit("line")
    nested = "array<array<string>>"
    old = F.col("rows") if "rows" in lines.columns else F.lit(None).cast(nested)
    grid = F.coalesce((F.size("rows") >= 2) & (F.array_max(F.transform("rows", F.size)) >= 2), F.lit(False))
    rows = lines.select(*PAGE, F.col("k").cast("int").alias("k"), "text", *sides, role.alias("role"), old.cast(nested).alias("rows"), F.lit(False).alias("_box"), F.lit(True).alias("_grid"))
    rows = rows.unionByName(tables.select(*PAGE, F.col("box").cast("int").alias("k"), F.lit(None).cast("string").alias("text"), *sides, F.lit("table").alias("role"), F.col("rows").cast(nested).alias("rows"),
                                          F.lit(True).alias("_box"), grid.alias("_grid")))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, page in whole_pages(batches):
            box = table["_box"].to_numpy()
            upto = np.cumsum(box)
            first = np.flatnonzero(np.diff(page, prepend=-1))
            before = np.repeat(upto[first] - box[first], np.diff(np.append(first, len(page))))
            stays = _owners(page, np.where(box, upto - before, 0), table["_grid"].to_numpy(), *(table[c].to_numpy() for c in _SIDES))
            yield from table.filter(pa.array(stays)).to_batches()

    dealt = rows.repartition(*PAGE).sortWithinPartitions(*PAGE, "_box", "k")
    left = dealt.mapInArrow(solve, dealt.schema)
    cell = lambda c: finish_paragraph(clean_pdf_text(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))))
    clean = F.when(F.col("_box"), F.transform("rows", lambda r: F.transform(r, cell))).otherwise(F.col("rows"))
    return left.select(*PAGE, "k", "text", *_SIDES, "role", clean.alias("rows"))


def verbalise_tables(cells: DataFrame, book_rule: bool = True) -> DataFrame:
    """cells(table_id, row_no, col_no, text) -> (table_id, row_no, sentence). With a header row (all filled, none a number) every
    cell is announced by its column's name."""
    c = cells.withColumn("text", strip(F.regexp_replace("text", r"(?U)\s+", " ")))
    filled = c.groupBy("table_id", "row_no").agg(F.max(F.length("text")).alias("_l")).where("_l > 0").select("table_id", "row_no")
    c = c.join(filled, ["table_id", "row_no"])
    shape = c.groupBy("table_id").agg(F.min("row_no").alias("_top"), F.count_distinct("row_no").alias("_rows"))
    first = c.join(shape, "table_id").where("row_no = _top").select("table_id", "col_no", F.col("text").alias("_h"), "_top", "_rows")
    clean = (F.col("_h") != "") & ~F.col("_h").rlike(r"^[\d\s.,%$€£-]+$")
    header = first.groupBy("table_id").agg((F.bool_and(clean) & (F.first("_rows") > 1) & ((F.count("*") > 1) if book_rule else F.lit(True))).alias("_header"), F.first("_top").alias("_top"))
    rows = c.join(header, "table_id").join(first.select("table_id", "col_no", "_h"), ["table_id", "col_no"], "left").where("not (_header and row_no = _top) and text <> ''")
    said = F.when(F.col("_header"), F.concat_ws(": ", "_h", "text")).otherwise(F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("col_no", said.alias("s")))), lambda x: x["s"])
    out = rows.groupBy("table_id", "row_no").agg(F.when(F.first("_header"), F.array_join(parts, ". ")).otherwise(F.array_join(parts, ", ")).alias("_s"))
    done = F.col("_s").rlike("[.!?…]$") if book_rule else ends_sentence("_s")
    return out.select("table_id", "row_no", F.when(done, F.col("_s")).otherwise(F.concat("_s", F.lit("."))).alias("sentence"))


def filter_regions(blocks: DataFrame, regions: DataFrame, only: bool) -> DataFrame:
    """blocks(doc_id, page, block, cx, cy, text) without those in Ignore boxes; with ``only``, on pages with Keep boxes just the
    blocks in them, in the boxes' order. regions(doc_id, page or null for all, seq, kind, x0, y0, x1, y1)."""
    inside = (F.col("b.doc_id") == F.col("r.doc_id")) & (F.col("r.page").isNull() | (F.col("r.page") == F.col("b.page"))) & F.col("b.cx").between(F.col("r.x0"), F.col("r.x1")) & F.col("b.cy").between(F.col("r.y0"), F.col("r.y1"))
    left = blocks.alias("b").join(regions.where("kind = 'ignore'").alias("r"), inside, "left_anti")
    if not only:
        return left.withColumn("pos", F.row_number().over(_page("block")).cast("long"))
    keep = regions.where("kind = 'keep'")
    on_page = (F.col("b.doc_id") == F.col("r.doc_id")) & (F.col("r.page").isNull() | (F.col("r.page") == F.col("b.page")))
    free = left.alias("b").join(keep.alias("r"), on_page, "left_anti").withColumn("_order", F.struct(F.lit(0).alias("g"), F.lit(0).cast("long").alias("s")))
    first = left.alias("b").join(keep.alias("r"), inside).groupBy(*[F.col(f"b.{c}").alias(c) for c in blocks.columns]).agg(
        F.min(F.struct(F.col("r.page").isNotNull().cast("int").alias("g"), F.col("r.seq").cast("long").alias("s"))).alias("_order"))
    return free.unionByName(first).withColumn("pos", F.row_number().over(_page("_order", "block")).cast("long")).drop("_order")


def region_signature(regions: DataFrame, options: str) -> DataFrame:
    """doc_id -> a hash that changes with any region or option."""
    item = F.struct(F.coalesce("page", F.lit(-1)).alias("page"), "seq", "kind", "x0", "y0", "x1", "y1")
    return regions.groupBy("doc_id").agg(F.sha1(F.concat(F.to_json(F.array_sort(F.collect_list(item))), F.lit(options))).alias("signature"))


def stitch_pages(pages: DataFrame, key: tuple[str, ...] = ("doc_id",), page: str = "page") -> DataFrame:
    """pages(doc_id, page, paras array) -> (doc_id, para, text): the last paragraph of a page and the first of the next are one
    where the sentence goes on. Blank pages are left out. The carried text makes a page's chance depend on the pages before,
    in closed form: a joint holds if since the last strong joint no page broke the chain. With another ``key`` and ``page`` the
    parts of anything else are stitched, such as the columns of a page."""
    p = pages.where(F.size("paras") > 0).withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(page)))
    order = Window.partitionBy(*key).orderBy("_i")
    last, nxt = F.element_at("paras", -1), F.element_at(F.lead("paras").over(order), 1)
    e = F.coalesce(~ends_sentence(last) & nxt.rlike(r"^\p{Ll}"), F.lit(False))
    strong = (F.length(last) > 20) & ~last.rlike(r"^(Chapter|CHAPTER)\s+\d+$")
    p = p.withColumn("_e", e).withColumn("_s", strong).withColumn("_one", F.size("paras") == 1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    on = F.coalesce(F.max(F.when(F.col("_e") & F.col("_s"), F.col("_i"))).over(upto), F.lit(-1))
    off = F.coalesce(F.max(F.when(~F.col("_e") | ~F.col("_one") & ~F.col("_s"), F.col("_i"))).over(upto), F.lit(-1))
    p = p.withColumn("_joined", F.col("_e") & (on > off) | F.col("_e") & F.col("_s"))
    p = p.withColumn("_cont", F.coalesce(F.lag("_joined").over(order), F.lit(False)))
    rows = p.select(*key, "_i", "_cont", F.posexplode("paras").alias("_k", "t"))
    at = Window.partitionBy(*key).orderBy("_i", "_k")
    rows = rows.withColumn("para", F.sum((~(F.col("_cont") & (F.col("_k") == 0))).cast("int")).over(at) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_k", "t"))), lambda x: x["t"]), " ")
    return rows.groupBy(*key, F.col("para").cast("long").alias("para")).agg(text.alias("text"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once: a lambda's name stands for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def page_gutters(lines: Column, unit: Column, least: int, page_units: float, joint: float, gap_units: float, side: int) -> Column:
    """Gutters of a page of lines: gaps between the narrow lines, taken from left to right, with ``side`` lines on each side. At least
    ``least`` lines and as many narrow ones, on a page at least ``page_units`` wide."""
    left, right = F.array_min(F.transform(lines, lambda x: x["x0"])), F.array_max(F.transform(lines, lambda x: x["x1"]))

    def of_page(page: Column) -> Column:
        narrow, wide, u = page["narrow"], page["right"] - page["left"], page["unit"]
        start = F.struct(F.lit(None).cast("double").alias("reach"), F.array().cast("array<struct<g0:double,g1:double>>").alias("gaps"))
        gap = lambda now, x: F.struct(now["reach"].alias("g0"), x["x0"].alias("g1"))
        step = lambda now, x: F.struct(
            F.greatest(now["reach"], x["x1"]).alias("reach"), F.when(x["x0"] > now["reach"] + joint * u, F.concat(now["gaps"], F.array(gap(now, x)))).otherwise(now["gaps"]).alias("gaps"))
        gaps = F.aggregate(narrow, start, step, lambda end: end["gaps"])
        centre = lambda g: (g["g0"] + g["g1"]) / 2
        inside = lambda g: (g["g1"] - g["g0"] >= gap_units * u) & centre(g).between(page["left"] + 0.15 * wide, page["right"] - 0.15 * wide)
        sides = lambda g: (F.size(F.filter(narrow, lambda x: x["x1"] <= g["g0"] + 1)) >= side) & (F.size(F.filter(narrow, lambda x: x["x0"] >= g["g1"] - 1)) >= side)
        found = F.filter(gaps, lambda g: inside(g) & sides(g))
        return F.when((F.size(lines) >= least) & (wide >= page_units * u) & (F.size(narrow) >= least), found)

    narrow = lambda p: F.array_sort(F.transform(F.filter(lines, lambda x: x["x1"] - x["x0"] < 0.62 * (p["right"] - p["left"])), lambda x: F.struct(x["x0"].alias("x0"), x["x1"].alias("x1"))))
    found = _bound(F.struct(left.alias("left"), right.alias("right")), lambda p: _bound(F.struct(p["left"].alias("left"), p["right"].alias("right"), unit.alias("unit"), narrow(p).alias("narrow")), of_page))
    return F.coalesce(found, F.array().cast("array<struct<g0:double,g1:double>>"))


def _scanned_pages(lines: DataFrame) -> DataFrame:
    """A row for each page: its recognised lines ``_l``, their unit (the upper median height, 1 if that is 0) and gutters ``_g``."""
    pages = lines.groupBy(*PAGE).agg(F.collect_list(F.struct(*[c for c in lines.columns if c not in PAGE])).alias("_l"))
    heights = F.sort_array(F.transform("_l", lambda x: x["y1"] - x["y0"]))
    median = F.get(heights, F.call_function("div", F.size("_l"), F.lit(2)).cast("int"))
    pages = pages.withColumn("_unit", F.when(median == 0, 1.0).otherwise(median))
    return pages.withColumn("_g", page_gutters(F.col("_l"), F.col("_unit"), 8, 8.0, 0.3, 0.45, 4))


def ocr_columns(lines: DataFrame) -> DataFrame:
    """Gutters (doc_id, page, g0, g1) of recognised lines."""
    return _scanned_pages(lines.select(*PAGE, *_SIDES)).select(*PAGE, F.inline("_g"))


def reading_groups(lines: DataFrame) -> DataFrame:
    """Recognised lines with ``group``, the number of their part of the page in reading order: from top to bottom, lines across a
    gutter are parts of their own, and between them each column is a part, from left to right. A page without gutter is one part.
    A page's lines are brought together once, and what follows stays within the page."""
    x = _scanned_pages(lines).select(*PAGE, "_unit", "_g", F.inline("_l"))
    slack, centre = 0.15 * F.col("_unit"), (F.col("x0") + F.col("x1")) / 2
    x = x.withColumn("_across", F.exists("_g", lambda g: (F.col("x0") < g["g0"] - slack) & (F.col("x1") > g["g1"] + slack)))
    column = F.when(F.col("_across"), -1).otherwise(F.size(F.filter("_g", lambda g: centre > (g["g0"] + g["g1"]) / 2)))
    order = _page(F.col("y0") + F.col("y1"), "x0", "k")
    turn = F.coalesce(F.lag("_across").over(order) != F.col("_across"), F.lit(False))
    x = x.withColumn("_column", column).withColumn("_turn", turn.cast("int")).drop("_g", "_unit")
    x = x.withColumn("_section", F.sum("_turn").over(order))
    x = x.withColumn("group", (F.dense_rank().over(_page("_section", "_column")) - 1).cast("int"))
    return x.select(*lines.columns, "group")


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of sets (the smallest number in each) once the pairs of a and b are united as well: round by round every set joins
    the smallest that it is paired with."""
    while True:
        u, v = label[a], label[b]
        apart = u != v
        if not apart.any():
            return label
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label = label[label]


def _clusters(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, gap: float) -> np.ndarray:
    """For each box of some pages the smallest number in its cluster. All pages are taken at once: their boxes lie from top to bottom,
    and each is compared with the next, the one after that and so on, as long as any begins before it ends."""
    order = np.lexsort((y0, page))
    page, x0, y0, x1, y1 = (v[order] for v in (page, x0, y0, x1, y1))
    label, here, step, pairs, held = np.arange(len(order)), np.arange(len(order)), 1, [], 0
    while len(here):
        here = here[: np.searchsorted(here, len(order) - step)]
        later = here + step
        open_ = (page[here] == page[later]) & (y0[later] <= y1[here] + gap)
        here, later = here[open_], later[open_]
        hit = (x0[later] <= x1[here] + gap) & (x0[here] <= x1[later] + gap) & (y0[here] <= y1[later] + gap)
        pairs.append((order[here[hit]], order[later[hit]]))
        held, step = held + len(pairs[-1][0]), step + 1
        if held > 1_000_000 or not len(here):  # what is held stays small on a crowded page
            label, pairs, held = _unite(label, *(np.concatenate(x) for x in zip(*pairs, strict=True))), [], 0
    return label


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of rows sorted by page as tables of whole pages, with each row's page as a number: the last page of a batch waits for
    the next, where it may go on."""
    def numbers(t: pa.Table) -> np.ndarray:
        fresh = np.zeros(t.num_rows, bool)
        for c in PAGE:
            a, b = t[c][1:], t[c][:-1]
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            fresh[1:] |= ~same.to_numpy()
        return np.cumsum(fresh)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        joint = pa.Table.from_batches([*[x.slice(x.num_rows - 1) for x in held[-1:]], batch])
        page = numbers(joint)
        if page[-1] == 0:  # one page so far
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch])
        page = numbers(table)
        cut = int(np.searchsorted(page, page[-1]))
        if cut:
            yield table.slice(0, cut), page[:cut]
        held = table.slice(cut).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, numbers(table)


def _per_page(boxes: DataFrame, work: Callable[..., tuple[np.ndarray, dict[str, np.ndarray]]], columns: str) -> DataFrame:
    """``work`` on whole pages of boxes (page, x0, y0, x1, y1), sorted by number: it gives the rows that stay and columns of theirs.
    One shuffle and sort by page; many small pages are worked on together."""
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*PAGE, "box")) + ", x0 double, y0 double, x1 double, y1 double, " + columns
    sides = [F.col(c).cast("double").alias(c) for c in _SIDES]
    names = [x.split()[0] for x in schema.split(", ")]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, page in whole_pages(batches):
            box = table["box"]
            rows, made = work(page, *(table[c].to_numpy() for c in _SIDES))
            out = {c: table[c].take(pa.array(rows)) for c in (*PAGE, "box", *_SIDES)} | {c: pa.array(v) for c, v in made.items() if c != "cluster"}
            if "cluster" in made:
                out["cluster"] = box.take(pa.array(made["cluster"]))
            yield from pa.table({c: out[c] for c in names}).to_batches()

    return boxes.select(*PAGE, "box", *sides).repartition(*PAGE).sortWithinPartitions(*PAGE, "box").mapInArrow(solve, schema)


def cluster_boxes(boxes: DataFrame, gap: float) -> DataFrame:
    """boxes(doc_id, page, box, x0, y0, x1, y1) with ``cluster``: the smallest box number of those connected by distances of
    at most ``gap`` on both axes. One shuffle by page; the closure over neighbours is taken within the page."""
    def label(page: np.ndarray, *sides: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        return np.arange(len(page)), {"cluster": _clusters(page, *sides, gap)}

    return _per_page(boxes, label, f"cluster {boxes.schema['box'].dataType.simpleString()}")


def merge_boxes(boxes: DataFrame, gap: float) -> DataFrame:
    """Unions of boxes that overlap or come within ``gap``, until all are apart: doc_id, page, box, x0, y0, x1, y1, members."""
    def unite(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        rows, members = np.arange(len(page)), np.ones(len(page), np.int64)
        while True:
            group = _clusters(page, x0, y0, x1, y1, gap)
            one, start = np.unique(np.sort(group), return_index=True)
            if len(one) == len(page):
                return rows, {"x0": x0, "y0": y0, "x1": x1, "y1": y1, "members": members}
            along = np.argsort(group, kind="stable")
            x0, y0 = (np.minimum.reduceat(v[along], start) for v in (x0, y0))
            x1, y1 = (np.maximum.reduceat(v[along], start) for v in (x1, y1))
            page, rows, members = page[one], rows[one], np.add.reduceat(members[along], start)

    return _per_page(boxes, unite, "members long")


def image_candidates(images: DataFrame, width: float, height: float) -> DataFrame:
    """Pictures of at least 60 by 40 that take 3 to 85 % of the page, numbered from top to bottom."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    good = images.where((w >= 60) & (h >= 40) & (w * h / (width * height)).between(0.03, 0.85))
    return good.withColumn("pos", F.row_number().over(_page("y0", "x0", "box")).cast("long"))


def pages_with_rules(drawings: DataFrame) -> DataFrame:
    """Pages with at least 3 long horizontal and 2 long vertical rules: where tables are worth looking for."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sums = drawings.groupBy(*PAGE).agg(F.count_if((h <= 2) & (w >= 40)).alias("across"), F.count_if((w <= 2) & (h >= 20)).alias("down"))
    return sums.where("across >= 3 and down >= 2")


def text_layer_pages(pages: DataFrame, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Pages to read from their text layer (at least 20 characters), and those for recognition."""
    enough = F.length(strip(F.coalesce("text", F.lit("")))) >= least
    return pages.where(enough), pages.where(~enough)


def read_footnotes(spans: DataFrame) -> DataFrame:
    """Spans of footnote lines (doc_id, page, pos, mark, text) -> notes: each starts at a small raised mark."""
    x = spans.withColumn("note", F.sum(F.col("mark").cast("int")).over(_page("pos"))).where("not mark")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", strip("text").alias("t")))), lambda s: s["t"]), " ")
    return x.groupBy(*PAGE, F.col("note").cast("long").alias("note")).agg(text.alias("text"))


#: The layout model's labels of furniture, of what isn't read, and of headings; other labels are text.
FURNITURE = ("header", "header_image", "footer", "footer_image", "number", "aside_text")
UNREAD = ("image", "chart", "seal", "figure", "formula", "formula_number", "algorithm")
TITLES = ("doc_title", "paragraph_title")


def labelled_regions(items: DataFrame, furniture: bool = False, footnotes: bool = False, headings: bool = True, tables: bool = True) -> DataFrame:
    """items(doc_id, page, pos, label, text) in reading order -> (doc_id, page, pos, part, kind, text) of what is read: regions whose
    label isn't switched off, tidied, and tables (by label or by markup) a sentence for each row; with ``tables`` off a table is
    its words."""
    label, raw = F.lower(F.coalesce("label", F.lit(""))), F.coalesce("text", F.lit(""))
    kind = (
        F.when(label.isin(*UNREAD), "unread").when(label.isin(*FURNITURE), "furniture").when(label == "footnote", "footnote").when(label.isin(*TITLES), "heading")
        .when((label == "table") | F.lower(F.ltrim(raw, F.lit(WHITE))).startswith("<table"), "table").otherwise("body"))
    off = ["unread", *[k for k, on in (("furniture", furniture), ("footnote", footnotes), ("heading", headings)) if not on]]
    rows = items.select(*PAGE, "pos", kind.alias("kind"), raw.alias("text")).where(~F.col("kind").isin(*off) & (strip("text") != ""))
    marked = F.lower(F.ltrim("text", F.lit(WHITE))).startswith("<table") | (F.col("kind") == "table")
    words = F.when(marked, replaces("text", (r"<[^>]+>", " "))).otherwise(F.col("text"))
    said = F.array(finish_paragraph(clean_pdf_text(clean_paragraph(words))))
    if tables:
        said = F.when(marked, table_sentences(F.col("text"))).otherwise(said)
    parts = rows.select(*PAGE, "pos", "kind", F.posexplode(F.filter(said, lambda t: t != "")).alias("part", "text"))
    return parts.select(*PAGE, "pos", "part", "kind", "text")
