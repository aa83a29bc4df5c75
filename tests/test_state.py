"""Highlights against plain play; literal cases of settings, work-lists and sections."""
import random
import time

from pyspark.sql import functions as F

from lectern.operators import chapters as C
from lectern.operators import layout as L
from lectern.operators import state as A
from lectern.operators import worklist as W


def test_overlay(spark):
    rows = [(1, 10, 40, "yellow"), (2, 20, 25, "pink"), (3, 5, 5, "red")]
    adds = spark.createDataFrame([(0, *r, 100) for r in rows], "para long, seq long, start long, end long, colour string, text_length long")
    got = sorted((r.start, r.end, r.colour) for r in A.overlay_highlights(adds, ["para"]).collect())
    assert got == [(10, 20, "yellow"), (20, 25, "pink"), (25, 40, "yellow")]


def test_log_splits_and_removes(spark):
    rows = [(1, "add", 10, 40, "y", 0), (2, "add", 20, 25, "p", 0), (3, "remove", 0, 0, "", 1)]
    log = spark.createDataFrame([(7, 1, 0, *r) for r in rows], LOG)
    assert sorted((r.start, r.end) for r in A.apply_highlight_log(log).collect()) == [(20, 25), (25, 40)]


def test_log_equals_overlay_for_adds(spark, sf):
    from lectern.plans import state_queries as Q

    adds = Q.adds(spark, sf)
    log = adds.selectExpr("user_id", "doc", "para", "seq", "'add' as op", "start", "least(`end`, 80) as end", "colour", "0L as target")
    a = {(r.user_id, r.doc, r.para, r.start, r.end, r.colour) for r in A.apply_highlight_log(log).collect()}
    b = {(r.user_id, r.doc, r.para, r.start, r.end, r.colour) for r in A.overlay_highlights(adds, Q.PARA).collect()}
    assert a == b


def play_plainly(events):
    """Events one after another over a list that is read from end to end."""
    items, fresh = [], 1
    for op, start, end, colour, target in events:
        if op == "add":
            start, end = min(start, end), max(start, end)
            if start < 0 or end <= start:
                continue
            kept = []
            for i, s, t, c in sorted(items, key=lambda x: x[1]):
                if s < start < t:
                    kept.append((i, s, start, c))
                if s < end < t:
                    if s < start:
                        i, fresh = fresh, fresh + 1
                    kept.append((i, end, t, c))
                if t <= start or s >= end:
                    kept.append((i, s, t, c))
            items, fresh = [*kept, (fresh, start, end, colour)], fresh + 1
        elif op == "clear":
            items = []
        else:
            items = [(i, s, t, colour if op == "recolour" and i == target else c) for i, s, t, c in items if op != "remove" or i != target]
    return sorted(items, key=lambda x: x[1]), fresh


def test_marks_against_plain_play():
    rng = random.Random(1)
    for _ in range(300):
        ops = rng.choices(["add", "remove", "recolour", "clear"], [8, 3, 3, 0.2], k=60)
        events = [(op, rng.randint(-2, 40), rng.randint(-2, 40), rng.choice("ab"), rng.randint(1, 40)) for op in ops]
        marks = A.Marks()
        for e in events:
            marks.play(*e)
        assert (marks.items(), marks.next_id) == play_plainly(events)
        cut = rng.randint(0, 60)
        first = A.Marks()
        for e in events[:cut]:
            first.play(*e)
        again = A.Marks(first.items(), first.next_id)
        for e in events[cut:]:
            again.play(*e)
        assert again.items() == marks.items()


LOG = "user_id long, doc long, para long, seq long, op string, start long, end long, colour string, target long"


def test_log_goes_on_from_what_was_there(spark, sf):
    from lectern.plans import state_queries as Q

    log = Q.highlight_log(spark, sf)
    want = sorted(map(tuple, A.apply_highlight_log(log).collect()))
    by = {}
    for r in log.orderBy("seq").collect():
        by.setdefault((r.user_id, r.doc, r.para), []).append((r.op, r.start, r.end, r.colour, r.target))
    plain = {k: play_plainly(e) for k, e in by.items()}
    assert want == sorted((*k, *x) for k, (items, _) in plain.items() for x in items)
    half = log.approxQuantile("seq", [0.5], 0)[0]
    first = {}
    for r in log.where(F.col("seq") < half).orderBy("seq").collect():
        first.setdefault((r.user_id, r.doc, r.para), []).append((r.op, r.start, r.end, r.colour, r.target))
    before = spark.createDataFrame([(*k, n, items) for k, (items, n) in ((k, play_plainly(e)) for k, e in first.items())],
                                   "user_id long, doc long, para long, next long, items array<struct<id: long, start: long, end: long, colour: string>>")
    rest = A.apply_highlight_log(log.where(F.col("seq") >= half), before)
    touched = {tuple(r) for r in log.where(F.col("seq") >= half).select("user_id", "doc", "para").distinct().collect()}
    assert sorted(map(tuple, rest.collect())) == [w for w in want if w[:3] in touched]


def test_hot_paragraphs(spark):
    """100,000 events on one paragraph, most of which overlap: the work follows events and the bits of the length, not their square."""
    n, length = 100_000, 50_000
    log = spark.range(n).selectExpr(
        "1L as user_id", "1L as doc", "1L as para", "id as seq", "'add' as op", f"pmod(xxhash64(id, 1), {length}) as start",
        f"least({length}L, pmod(xxhash64(id, 1), {length}) + 1 + pmod(xxhash64(id, 2), if(id % 100 = 0, {length}, 300))) as end", "string(id % 5) as colour", "0L as target", f"{length}L as text_length")
    began = time.time()
    shown = {(r.start, r.end, r.colour) for r in A.overlay_highlights(log, ["user_id", "doc", "para"]).collect()}
    played = {(r.start, r.end, r.colour) for r in A.apply_highlight_log(log).collect()}
    assert time.time() - began < 120
    newest = [None] * length
    for r in log.orderBy("seq").collect():
        newest[r.start:r.end] = [(r.seq, r.colour)] * (r.end - r.start)
    want, at = set(), 0
    while at < length:
        to = at
        while to < length and newest[to] == newest[at]:
            to += 1
        if newest[at]:
            want.add((at, to, newest[at][1]))
        at = to
    assert shown == want == played


def test_highlights_at_edges(spark):
    marks = spark.createDataFrame([(1, 5, 9, "a"), (1, 9, 12, "b"), (None, 0, 3, "c")], "para long, start long, end long, colour string")
    probes = spark.createDataFrame([(1, c) for c in (4, 5, 8, 9, 11, 12)] + [(2, 5), (None, 1)], "para long, char long")
    got = {(r.para, r.char): (r.start, r.colour) for r in A.highlights_at(probes, marks, ["para"]).collect()}
    none = (None, None)
    assert got == {(1, 4): none, (1, 5): (5, "a"), (1, 8): (5, "a"), (1, 9): (9, "b"), (1, 11): (9, "b"), (1, 12): none, (2, 5): none, (None, 1): (0, "c")}


def test_clean_speeds(spark):
    df = spark.createDataFrame([(1, ["2.0", "1.25", "1.25", "7.0", "junk", "0.75"])], "user_id long, speeds array<string>")
    assert A.clean_speeds(df).first().speeds == [0.75, 1.25, 2.0]


def test_worklist_starts_at_the_active_speed(spark):
    paras = spark.createDataFrame([(1, i, "t") for i in range(3)], "reader long, para long, text string")
    speeds = spark.createDataFrame([(1, s) for s in (0.75, 1.0, 1.25, 1.5, 1.75, 2.0)], "reader long, speed double")
    focus = spark.createDataFrame([(1, 0, 1.0)], "reader long, position long, active double")
    done = spark.createDataFrame([], "reader long, para long, speed double")
    rows = W.synthesis_worklist(paras, speeds, focus, done).orderBy("rank").collect()
    assert len(rows) == 18 and [(r.para, r.speed) for r in rows[:3]] == [(0, 1.0), (1, 1.0), (2, 1.0)]


def test_sections_tile_the_book(spark, sf):
    from lectern.plans import chapter_queries as Q

    paras = Q.marked(spark, "/root/testdata/sf0.01")
    n = {r.book_id: r.n for r in C.book_sizes(paras).collect()}
    by = {}
    for r in C.split_sections(paras).orderBy("book_id", "start").collect():
        assert r.start == by.get(r.book_id, 0) and r.end > r.start and r.end - r.start <= C.MAX_SECTION
        by[r.book_id] = r.end
    assert by == n


def test_stitch(spark):
    cases = [(1, ["The dog ran"], ["over the hill."], 1), (2, ["It ended."], ["then more."], 2), (3, ["The dog ran"], ["Over the hill."], 2), (4, ["Chapter 3"], ["it began there."], 2)]
    rows = [(d, p, x) for d, a, b, _ in cases for p, x in ((0, ["A long enough paragraph here, " + a[0]] if d in (1, 3) else a), (1, b))]
    df = spark.createDataFrame(rows, "doc_id long, page long, paras array<string>")
    got = {r.doc_id: r["count"] for r in L.stitch_pages(df).groupBy("doc_id").count().collect()}
    assert got == {d: n for d, _, _, n in cases}


def test_tables(spark):
    cells = [("t", 0, c, x) for c, x in enumerate(("Name", "Age", "City"))] + [("t", 1, c, x) for c, x in enumerate(("Ann", "", "Rome"))]
    cells += [("n", r, c, str(r + c)) for r in range(2) for c in range(2)] + [("e", 0, 0, " ")]
    df = spark.createDataFrame(cells, "table_id string, row_no long, col_no long, text string")
    got = {(r.table_id, r.row_no): r.sentence for r in L.verbalise_tables(df).collect()}
    assert got == {("t", 1): "Name: Ann. City: Rome.", ("n", 0): "0, 1.", ("n", 1): "1, 2."}


def test_voices(spark):
    asked = ["af_bella", "zm_yunxi", "pack:x", "pack:y", "qq", "", None]
    requests = spark.createDataFrame([(i, v) for i, v in enumerate(asked)], "request_id long, voice string")
    packs = spark.createDataFrame([("x", "it")], "name string, lang string")
    got = {r.request_id: (r.voice, r.label, r.language, r.region, r.gender) for r in A.resolve_voices(requests, packs).collect()}
    assert got[0] == ("af_bella", "Bella · US female", "en-us", "US", "female") and got[1] == ("zm_009", "009 · ZH male", "zh", "ZH", "male")
    assert got[2] == ("pack:x", "x (voice pack)", "it", None, None) and got[3] == ("pack:y", "y (voice pack)", "en-us", None, None)
    assert got[4][1:3] == ("Qq ·  male", "en-us") and got[5][2] == "en-us" and len(got) == len(asked)
    own = A.voice_dimension(spark).collect()
    assert len(own) == 29 and {r.language for r in own} == set(A.VOICES) and {r.label for r in own} >= {"Siwis · FR female", "012 · ZH male"}


BOX = "doc_id long, page int, box int, x0 double, y0 double, x1 double, y1 double"


def test_overlapping_figures(spark):
    lines = spark.createDataFrame([(1, 0, k, t, x, y, x + 20.0, y + 8.0) for k, t, x, y in ((0, "left", 0.0, 0.0), (1, "both ", 40.0, 1.0), (2, "right", 80.0, 0.0), (3, "below", 0.0, 90.0))]
                                  + [(2, 0, 0, "alone", 0.0, 0.0, 9.0, 9.0)], "doc_id long, page int, k int, text string, x0 double, y0 double, x1 double, y1 double")
    figures = spark.createDataFrame([(1, 0, 10, 0.0, 0.0, 60.0, 20.0), (1, 0, 11, 40.0, 0.0, 100.0, 20.0), (3, 0, 12, 0.0, 0.0, 5.0, 5.0)], BOX)
    got = sorted((r.doc_id, r.k, r.text, r.role) for r in L.take_figures(lines, figures).collect())
    assert got == [(1, 3, "below", "line"), (1, 10, "left both", "figure"), (1, 11, "right", "figure"), (2, 0, "alone", "line"), (3, 12, "", "figure")]


def test_tables_take_lines_only_as_grids(spark):
    lines = spark.createDataFrame([(1, 0, k, f"l{k}", 10.0, 20.0 * k, 30.0, 20.0 * k + 10) for k in range(5)], "doc_id long, page int, k int, text string, x0 double, y0 double, x1 double, y1 double")
    grid = [["Name", "Age"], ["Ana ( x )", None]]
    tables = spark.createDataFrame([(1, 0, 20, 0.0, 0.0, 50.0, 30.0, grid), (1, 0, 21, 0.0, 0.0, 50.0, 50.0, [["a", "b"]]), (1, 0, 22, 0.0, 40.0, 50.0, 50.0, [["a"], ["b"]]),
                                    (1, 0, 23, 200.0, 0.0, 250.0, 50.0, grid), (1, 0, 24, 0.0, 55.0, 50.0, 75.0, grid), (1, 0, 25, 0.0, 55.0, 50.0, 75.0, grid), (1, 0, 26, 0.0, 30.0, 50.0, 45.0, None)],
                                   BOX + ", rows array<array<string>>")
    got = {(r.k, r.role): r.rows for r in L.take_tables(lines, tables).collect()}
    # The last box of a pair with the same sides finds the row of the one before inside it.
    assert set(got) == {(2, "line"), (4, "line"), (20, "table"), (25, "table")} and got[20, "table"] == [["Name", "Age"], ["Ana (x)", ""]]


def test_labelled_regions(spark):
    table = "<table><tr><th>A</th><th>B</th></tr><tr><td>1&amp;2</td><td>x</td></tr></table>"
    rows = [("doc_title", "A  Title"), ("Header_Image", "h"), ("footnote", "f"), ("text", "fi ( x ) \u00adend-\nning"), ("table", table), (None, " \n" + table), ("seal", "s"), ("chart", "c"), ("algorithm", "a"),
            ("aside_text", "s"), ("reference", "ref"), ("table", "no markup"), ("text", None), ("text", "  ")]
    items = spark.createDataFrame([(1, 0, i, lab, t) for i, (lab, t) in enumerate(rows)], "doc_id long, page int, pos int, label string, text string")
    said = lambda **k: [(r.pos, r.kind, r.text) for r in L.labelled_regions(items, **k).orderBy("pos", "part").collect()]
    assert said() == [(0, "heading", "A Title"), (3, "body", "fi (x) endning"), (4, "table", "A: 1&2. B: x."), (5, "table", "A: 1&2. B: x."), (10, "body", "ref")]
    assert said(headings=False, tables=False) == [(3, "body", "fi (x) endning"), (4, "table", "A B 1&amp;2 x"), (5, "table", "A B 1&amp;2 x"), (10, "body", "ref"), (11, "table", "no markup")]
    assert [p for p, *_ in said(furniture=True, footnotes=True)] == [0, 1, 2, 3, 4, 5, 9, 10]
