"""Roles of spans, joined lines, verses, recognised rows, figures and picture texts: small pages, and plain loops over whole tables."""
import re
from collections import defaultdict

import pytest

from lectern.operators import assembly as A
from lectern.plans import layout_queries as Q

SPAN = "doc_id long, page int, line int, span int, text string, size double, bold boolean, family string, raised boolean, origin_y double, baseline double"


def spans(spark, *rows):
    """(line, text, size, how): how has b (bold), r (raised)."""
    out, last = [], {}
    for line, text, size, how in rows:
        last[line] = last.get(line, -1) + 1
        out.append((1, 0, line, last[line], text, float(size), "b" in how, "Body", "r" in how, 10.0, 10.0))
    return spark.createDataFrame(out, SPAN)


def pages(spark, scripture):
    return spark.createDataFrame([(1, 0, 10.0, "Body", scripture)], "doc_id long, page int, body double, family string, scripture boolean")


CASES = [
    ([(0, "12", 6, ""), (0, "And it came", 10, "")], True, ["verse", "text"]),
    ([(0, "12", 6, ""), (0, "And it came", 10, "")], False, ["caller", "text"]),
    ([(0, "a word", 10, ""), (0, "3", 6, ""), (0, " goes on", 10, "")], True, ["text", "caller", "text"]),
    ([(0, "ended.", 10, ""), (0, "3", 6, ""), (0, "Then", 10, "")], True, ["text", "verse", "text"]),
    ([(0, "a word ", 10, ""), (0, "3", 10, "r"), (0, "goes", 10, "")], True, ["text", "verse", "text"]),
    ([(0, "7", 24, ""), (0, "T", 20, ""), (0, "he end", 10, "")], True, ["chapter", "dropcap", "text"]),
    ([(0, "7", 24, ""), (0, "The end", 10, "")], False, ["text", "text"]),
    ([(0, "4", 10, "b"), (0, "plain text", 10, "")], True, ["verse", "text"]),
    ([(0, "4", 10, "b"), (0, "bold text", 10, "b")], True, ["text", "text"]),
    ([(0, "word", 10, ""), (0, "*", 5, ""), (0, "ab", 5, "")], True, ["text", "caller", "caller"]),
    ([(0, " ", 10, ""), (0, "3–5", 6, ""), (0, "1990", 6, "")], True, ["text", "verse", "text"])]


@pytest.mark.parametrize("rows, scripture, want", CASES)
def test_roles(spark, rows, scripture, want):
    got = A.span_roles(spans(spark, *rows), pages(spark, scripture)).orderBy("line", "span").collect()
    assert [r.role for r in got] == want


def test_modes(spark):
    prose = spans(spark, (0, "no marks here", 10, ""), (0, "4", 10, "b"), (0, "bold", 10, "b"))
    verses = spans(spark, (0, "1", 6, ""), (0, "In the", 10, ""))
    mode = lambda s, scripture, how: {r.mode for r in A.page_mode(s, pages(spark, scripture), how).collect()}
    assert mode(prose, True, "auto") == {"prose"} and mode(verses, True, "auto") == {"verses"} and mode(verses, False, "auto") == {"prose"}
    assert mode(verses, False, "always") == {"verses"} and mode(verses, True, "never") == {"prose"}
    assert A.page_mode(verses, pages(spark, True)).count() == verses.count()


@pytest.mark.parametrize("lines, text", [
    (["some in-", "formation"], "some information"), (["a well-", "known fact", "so well-known"], "a well-known fact so well-known"),
    (["a well-", "known fact", "so well-known and wellknown"], "a wellknown fact so well-known and wellknown"), (["co­", " operate"], "cooperate"),
    (["the Anglo-", "Saxon"], "the Anglo-Saxon"), (["one ", "two", "three-"], "one two three-"), (["ends -", "dash"], "ends dash"), ([""], None)])
def test_joined_lines(spark, lines, text):
    df = spark.createDataFrame([(1, 0, 0, k, t) for k, t in enumerate(lines)], "doc_id long, page int, para int, k int, text string")
    got = A.join_lines(df, A.page_vocabulary(df)).collect()
    assert [r.text for r in got] == ([] if text is None else [text])


def test_verses(spark):
    rows = [(0, 0, "A Heading", "text", "heading"), (1, 0, "7", "chapter", "body"), (1, 1, "T", "dropcap", "body"), (1, 2, "he first", "text", "body"), (2, 0, "line ", "text", "body"),
            (2, 1, "2", "verse", "body"), (2, 2, "Second", "text", "body"), (2, 3, "*", "caller", "body"), (3, 0, "verse", "text", "body"), (4, 0, "Title", "text", "title"), (5, 0, "tail", "text", "body")]
    df = spark.createDataFrame([(1, 0, *r) for r in rows], "doc_id long, page int, pos int, span int, text string, role string, line_role string")
    got = [(r.kind, r.text) for r in A.split_verses(df).orderBy("seq").collect()]
    assert got == [("chapter", "Chapter 7"), ("heading", "A Heading"), ("body", "The first line"), ("body", "Second verse"), ("title", "Title"), ("body", "tail")]


def test_verses_keep_every_word(spark, sf):
    """Over whole tables: what the blocks hold is what the spans held, marks aside."""
    count = lambda texts: sum(len("".join(t.split()).replace("-", "").replace("­", "")) for t in texts)
    roles = Q.lay7(spark, sf).collect()
    kept = [r.text for r in roles if (r.doc_id + r.line) % 17 in (0, 1) or r.role in ("text", "dropcap")]
    assert count(r.text for r in Q.lay11(spark, sf).where("kind <> 'chapter'").collect()) == count(kept)
    assert {"chapter", "verse", "caller", "dropcap", "text"} == {r.role for r in roles}


def parts_of_page(lines):
    """The lines of a page in reading order: a list for each run of lines across a gutter and for each column between them."""
    unit = sorted(x.y1 - x.y0 for x in lines)[len(lines) // 2] or 1.0
    left, right = min(x.x0 for x in lines), max(x.x1 for x in lines)
    narrow = [x for x in lines if x.x1 - x.x0 < 0.62 * (right - left)]
    gutters = []
    if len(lines) >= 8 and len(narrow) >= 8 and right - left >= 8 * unit:
        for start in sorted({x.x0 for x in narrow}):
            reach = max((x.x1 for x in narrow if x.x0 < start), default=None)
            if reach is None or start - reach < 0.45 * unit or not 0.15 * (right - left) <= (start + reach) / 2 - left <= 0.85 * (right - left):
                continue
            if sum(x.x1 <= reach + 1 for x in narrow) >= 4 and sum(x.x0 >= start - 1 for x in narrow) >= 4:
                gutters.append((reach, start))
    parts = []
    for x in sorted(lines, key=lambda x: (x.y0 + x.y1, x.x0, x.k)):
        across = any(x.x0 < a - 0.15 * unit and x.x1 > b + 0.15 * unit for a, b in gutters)
        column = -1 if across else sum((x.x0 + x.x1) / 2 > (a + b) / 2 for a, b in gutters)
        if not parts or (column == -1) != (-1 in parts[-1]):
            parts.append(defaultdict(list))
        parts[-1][column].append(x)
    return [section[c] for section in parts for c in sorted(section)]


def rows_of_part(lines):
    lines = sorted(lines, key=lambda x: ((x.y0 + x.y1) / 2, x.k))
    reach, rows = sorted(x.y1 - x.y0 for x in lines)[len(lines) // 2] / 2, []
    for x in lines:
        centre, picture = (x.y0 + x.y1) / 2, x.text.startswith("⟦")
        if rows and not picture and not rows[-1][1] and abs(centre - rows[-1][0]) < reach:
            rows[-1][2].append(x)
        else:
            rows.append((centre, picture, [x]))
    return [(p, pieces([i.text for i in sorted(items, key=lambda i: (i.x0, i.k))]), min(i.x0 for i in items), min(i.y0 for i in items), max(i.x1 for i in items),
             max(i.y1 for i in items)) for _, p, items in rows]


def pieces(texts):
    out = ""
    for t in filter(None, (t.strip() for t in texts)):
        out = out[:-1] + t if out.endswith("-") and t[0].islower() else f"{out} {t}" if out else t
    return out


def paragraphs_of_part(lines):
    rows, paras = rows_of_part(lines), []
    widest = max(r[4] - r[2] for r in rows)
    for i, r in enumerate(rows):
        q = rows[i - 1]
        if not i or r[0] or q[0] or r[3] - q[5] > 0.65 * max(q[5] - q[3], 1.0) or (q[4] - q[2] < 0.7 * widest and q[1][-1] in ".!?。！？…\"”’')]"):
            paras.append([])
        paras[-1].append(r[1])
    return [pieces(p) for p in paras]


def paragraphs_of_page(lines):
    out = []
    for part in parts_of_page([x for x in lines if x.text.strip()]):
        first, *rest = paragraphs_of_part(part)
        last = out[-1] if out else ""
        if last and not re.search(r"[.!?…。！？][\"'”’)\]]*$", last) and first[0].islower() and len(last) > 20:
            out[-1] = f"{last} {first}"
        else:
            out.append(first)
        out += rest
    return out


def test_recognised_paragraphs(spark, sf):
    by, want = defaultdict(list), []
    for r in Q.recognised(spark, sf).collect():
        by[r.doc_id, r.page].append(r)
    for page, lines in by.items():
        want += [(*page, n, p) for n, p in enumerate(paragraphs_of_page(lines))]
    assert sorted(map(tuple, Q.lay22(spark, sf).collect())) == sorted(want)
    assert any(len(parts_of_page(x)) > 3 for x in by.values())


def test_columns_are_read_one_after_another(spark):
    """A heading across both columns, four lines each, a line across, three more each: left before right, band by band."""
    rows = [("A heading across the page.", 50, 350, 0)]
    for i in range(4):
        rows += [(f"left{i}" + "." * (i == 3), 50, 190, 20 + 12 * i), (f"right{i}" + "." * (i == 3), 210, 350, 20 + 12 * i)]
    rows.append(("Across again.", 50, 350, 90))
    for i in range(4, 7):
        rows += [(f"left{i}", 50, 190, 60 + 12 * i), (f"right{i}", 210, 350, 60 + 12 * i)]
    df = spark.createDataFrame([(1, 0, k, t, float(a), float(y), float(b), float(y + 10)) for k, (t, a, b, y) in enumerate(rows)],
                               "doc_id long, page int, k int, text string, x0 double, y0 double, x1 double, y1 double")
    got = [r.text for r in A.ocr_paragraphs(df).orderBy("para").collect()]
    assert got == ["A heading across the page.", "left0 left1 left2 left3.", "right0 right1 right2 right3.", "Across again.", "left4 left5 left6", "right4 right5 right6"]
    plan = A.ocr_paragraphs(df)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan and plan.count("CartesianProduct") == 0


def test_picture_texts(spark, sf):
    bodies, pictures = Q.placed(spark, sf)
    by = defaultdict(lambda: ([], []))
    for r in bodies.collect():
        by[r.doc_id, r.page][0].append((r.pos, r.kind, r.cx, r.cy, r.text))
    for r in pictures.collect():
        if len(r.text) >= 3:
            by[r.doc_id, r.page][1].append((r.picture, "image", r.cx, r.cy, r.text))
    want = set()
    for page, (now, later) in by.items():
        now = sorted(now)
        for p in sorted(later):
            side = [n for n, b in enumerate(now) if abs(b[2] - p[2]) < 0.3 or abs(b[2] - 0.5) < 0.05]
            above, below = [n for n in side if now[n][3] < p[3]], [n for n in side if now[n][3] >= p[3]]
            now.insert(above[-1] + 1 if above else below[0] if below else len(now), p)
        want |= {(*page, n, *b[1:]) for n, b in enumerate(now)}
    assert {tuple(r) for r in Q.lay29(spark, sf).collect()} == want


def test_figures(spark):
    box = "doc_id long, page int, box int, x0 double, y0 double, x1 double, y1 double"
    images = spark.createDataFrame([(1, 0, 1, 10.0, 10.0, 110.0, 110.0), (1, 0, 2, 300.0, 10.0, 310.0, 20.0)], box)
    grid = [(1, 0, i, 200.0 + 50 * (i % 2), 300.0 + 45 * (i // 2), 240.0 + 50 * (i % 2), 340.0 + 45 * (i // 2)) for i in range(4)]
    drawings = spark.createDataFrame([*grid, (1, 0, 9, 0.0, 500.0, 390.0, 501.0), *[(2, 0, *g[2:]) for g in grid[:3]]], box)
    labels = spark.createDataFrame([(1, 0, 1, 205.0, 390.0, 235.0, 400.0, "Upload"), (1, 0, 2, 205.0, 405.0, 235.0, 415.0, "then"), (1, 0, 3, 10.0, 120.0, 380.0, 130.0, "a line of many words")],
                                   box + ", text string")
    got = [tuple(r) for r in A.figure_candidates(images, drawings, images.limit(0), labels, 400.0, 600.0).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 0, 1, 6.0, 6.0, 114.0, 114.0), (1, 0, 2, 196.0, 296.0, 294.0, 419.0)]
    words = spark.createDataFrame([(1, 0, 1, 200.0, 300.0, 290.0, 340.0)], box)
    assert A.figure_candidates(images, drawings, words, labels, 400.0, 600.0).count() == 1


def test_figures_of_many_drawings(spark):
    """Pages are not left out for the number of their drawings: one of 6,400 has the figure that one of 400 on the same place has."""
    box = "doc_id long, page int, box int, x0 double, y0 double, x1 double, y1 double"
    grid = lambda doc, n: [(doc, 0, i, 100.0 + 160.0 * (i % n) / n, 200.0 + 160.0 * (i // n) / n, 100.0 + 160.0 * (i % n + 1) / n, 200.0 + 160.0 * (i // n + 1) / n) for i in range(n * n)]
    fine = [(*r[:5], r[3] + 2.0, r[4] + 2.0) for r in grid(2, 80)]
    drawings = spark.createDataFrame([*grid(1, 20), *fine], box)
    none = drawings.limit(0)
    got = [tuple(r) for r in A.figure_candidates(none, drawings, none, spark.createDataFrame([], box + ", text string"), 400.0, 600.0).orderBy("doc_id", "pos").collect()]
    assert got == [(d, 0, 1, 96.0, 196.0, 264.0, 364.0) for d in (1, 2)]
