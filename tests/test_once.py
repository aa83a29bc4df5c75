"""Queries that work within a page or paragraph read their table once and deal its rows out once, whatever steps they take."""
import re
import statistics

import pytest
from pyspark.sql import functions as F

from lectern.operators import assembly as A
from lectern.operators import layout as L
from lectern.operators import paragraphs as P
from lectern.operators import timeline as T
from lectern.plans import layout_queries as Q
from lectern.plans.catalog import QUERIES


def moves(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan parquet"), plan.count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["lay4_classify_lines", "lay5_find_gutters", "lay6_reading_order", "lay8_paragraph_breaks", "lay10_merge_headings"])
def test_once(spark, sf, name):
    assert moves(QUERIES[name](spark, sf)) == (1, 1)


@pytest.mark.parametrize("name", ["lay7_span_roles", "lay11_split_verses", "lay15_page_mode"])
def test_spans_meet_their_page_once(spark, sf, name):
    assert moves(QUERIES[name](spark, sf)) == (2, 2)


def test_lines_are_joined_by_their_own_page_once(spark, sf):
    assert moves(QUERIES["lay9_join_lines"](spark, sf)) == (1, 1)
    texts = ["a well-", "known and wellknown", "co-", "op is a co-op", "re\u00adcall-", "ed recall-ed", "x-", "Y end-", "", "ing", "so-", "-far"]
    lines = spark.createDataFrame([(d, 0, d % 2, k, t) for d in range(3) for k, t in enumerate(texts[d:])], "doc_id long, page int, para int, k int, text string")
    assert rows(A.join_page_lines(lines)) == rows(A.join_lines(lines, A.page_vocabulary(lines)))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def odd_lines(spark, sf):
    """Lines of several sizes, families and gaps; some pages without ink, some lines on top of each other."""
    x = Q.lines(spark, sf).where("doc_id < 60").withColumn("size", F.expr("cast(size + pmod(doc_id * 7 + k * 3, 4) * 0.5 as double)"))
    x = x.withColumn("family", F.expr("case pmod(doc_id + k, 5) when 0 then 'Serif' when 1 then '' else 'Body' end")).withColumn("text", F.expr("if(doc_id % 11 = 0, '  ', text)"))
    return x.withColumn("x0", F.expr("x0 + pmod(k * k + doc_id, 6) * 20D")).withColumn("x1", F.expr("x1 - pmod(k + doc_id, 7) * 25D"))


def test_one_plan_finds_what_the_single_steps_find(spark, sf):
    x = odd_lines(spark, sf)
    roles = L.classify_lines(x, L.body_metrics(x), 600.0)
    both = L.with_roles(L.with_metrics(x), 600.0)
    assert rows(both.select(*roles.columns)) == rows(roles)
    gutters = L.find_gutters(roles)
    assert not gutters.isEmpty()
    inside = L.with_gutters(both).select("doc_id", "page", F.explode("_g").alias("g")).select("doc_id", "page", "g.*").distinct()
    assert rows(inside) == rows(gutters)
    want = L.reading_order(roles, gutters)
    assert rows(L.in_order(L.with_gutters(both)).select(*want.columns)) == rows(want)


def test_lines_of_several_pieces(spark):
    """Medians, families and texts of lines against plain loops, with one shuffle."""
    texts = ["word", " ", "12", "x", "", "3 – 4", "longer words", "–"]
    data = [(1, p, i % 7 if i % 5 else 20 + i, i * 3 % 31, texts[(i + p) % 8], [8.0, 9.5, 10.0, 12.0][i % 4], ["A-x", "B,y", "C"][i % 3], float(i), 1.0, i + 2.0, 9.0, float(i * i % 17)) for p in range(4) for i in range(30)]
    spans = spark.createDataFrame(data, "doc_id long, page int, line int, span int, text string, size double, font string, x0 double, y0 double, x1 double, y1 double, origin_y double")
    got = L.page_lines(spans)
    assert moves(got)[1] == 1
    want, lines = [], {}
    for r in data:
        if r[4]:
            lines.setdefault(r[:3], []).append(r)
    for key, own in lines.items():
        text = "".join(r[4] for r in sorted(own, key=lambda r: r[3]))
        if text.strip():
            n = lambda r: len(r[4].strip())
            many = [r[11] for r in own if n(r) > 1] or [r[11] for r in own]
            families = {}
            for r in own:
                if n(r) and not re.fullmatch(r"\d{1,3}(\s*[-–]\s*\d{1,3})?", r[4].strip()):
                    w, first = families.get(r[6][0], (0, r[3]))
                    families[r[6][0]] = w - n(r), min(first, r[3])
            family = min(families, key=families.get) if families else ""
            size = statistics.median([r[5] for r in own for _ in range(n(r))])
            want.append((*key, text, statistics.median(many), min(r[7] for r in own), 1.0, max(r[9] for r in own), 9.0, size, family))
    assert rows(got) == sorted(want, key=repr)


def test_words_are_not_moved_for_lookups(spark, sf):
    assert [moves(QUERIES[name](spark, sf)) for name in ("tim5_sentence_timeline", "tim7_word_at_char")] == [(1, 1), (2, 2)]
    texts = ["One two. Three", "", "!! ?", "  It ended.  Then 3.5 more! (yes.) ", "終わり。次は！ end", "…", "a"]
    paras = spark.createDataFrame([(n, t) for n, t in enumerate(texts * 3)], "n long, text string")
    words = T.paragraph_timeline(paras, ["n"])
    assert rows(T.spoken_sentences(paras, ["n"])) == rows(T.sentence_timeline(words, P.split_sentences(paras, ["n"]), ["n"]).select("n", "sentence_no", "start", "end", "f0", "f1"))
    probes = paras.select("n", F.explode(F.array(*map(F.lit, (-3, 0, 1, 3, 4, 7, 8, 9, 12, 20, 1000)))).alias("char"))
    assert rows(T.words_at_chars(probes, T.timeline_arrays(paras, ["n"]), ["n"])) == rows(T.word_at_char(probes, words, ["n"]))


@pytest.mark.parametrize(("name", "scans"), [("lay16_take_tables", 2), ("lay22_ocr_paragraphs", 1)])
def test_rows_of_a_page_are_sorted_once(spark, sf, name, scans):
    """One shuffle and one sort by page, no array of a page's lines, no join."""
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert moves(df) == (scans, 1) and plan.count("+- Sort ") == 1
    assert not any(x in plan for x in ("collect_list", "Window", "Join"))


def test_tables_are_taken_box_after_box(spark, sf):
    """Boxes that overlap, hold nothing, are no grid, swallow a row before or lie on a page without lines, against a plain loop."""
    lines = Q.S.layout_lines(spark, sf).where("doc_id < 30 and page < 3").select("doc_id", "page", "k", "text", "x0", "y0", "x1", "y1")
    pages = lines.select("doc_id", "page").distinct().unionByName(spark.createDataFrame([(-1, 0)], "doc_id long, page int"))
    side = lambda a, m: F.expr(f"cast(pmod(doc_id * {a} + page * 7 + box * {a + 4}, {m}) as double)")
    boxes = pages.withColumn("box", F.explode(F.sequence(F.lit(200), F.lit(206)))).withColumn("x0", side(5, 300)).withColumn("y0", side(11, 400))
    boxes = boxes.withColumn("x1", F.col("x0") + side(3, 200)).withColumn("y1", F.col("y0") + side(13, 150))
    cell = F.expr("array(array('a'), array(' b ', cast(box as string)))")
    boxes = boxes.withColumn("rows", F.when(F.expr("pmod(doc_id + box, 5) > 0"), cell).when(F.expr("pmod(doc_id, 2) = 0"), F.expr("array(array('a', 'b'))")))
    by, want = {}, []
    for r in lines.collect():
        by.setdefault((r.doc_id, r.page), []).append((*r[2:], "line", None))
    for r in boxes.orderBy("doc_id", "page", "box").collect():
        now = by.setdefault((r.doc_id, r.page), [])
        held = [x for x in now if r.x0 - 1 <= (x[2] + x[4]) / 2 <= r.x1 + 1 and r.y0 - 1 <= (x[3] + x[5]) / 2 <= r.y1 + 1]
        if held and r.rows and len(r.rows) > 1:
            now[:] = [x for x in now if x not in held] + [(r.box, None, r.x0, r.y0, r.x1, r.y1, "table", [["a"], ["b", str(r.box)]])]
    for key, now in by.items():
        want += [(*key, *x) for x in now]
    assert rows(L.take_tables(lines, boxes)) == sorted(want, key=repr) and sum(x[-1] is not None for x in want) > 20
    # what an earlier call left is a line for the next
    again = L.take_tables(L.take_tables(lines, boxes.where("box < 203")), boxes.where("box >= 203"))
    assert rows(again) == rows(L.take_tables(lines, boxes))


def test_pieces_are_joined_alike(spark):
    from lectern.functions.text import join_pieces, joined_pieces

    data = [[], ["", " "], ["a-", "b"], ["a-", "B"], ["x-", "\u00e9t", "-", "\u02b0"], ["\u6d77", "a", "\u3042-", "b"], ["-", "-", "a"], [" a\u2003", "\uac00", "\u4dc0", "z"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, a array<string>")
    assert [r.t for r in df.select("i", join_pieces("a").alias("t")).orderBy("i").collect()] == [joined_pieces(x) for x in data]
