"""Queries without a DuckDB twin against plain loops over whole tables."""
import re
from collections import defaultdict

from lectern.plans import layout_queries, text_queries
from lectern.sources import fixtures

END = re.compile(r"[.!?…。！？][\"'”’)\]]*$")


def sentences(text):
    """(cut_start, cut_end, start, end) of each sentence, read character by character."""
    cuts, i = [0], 0
    while i < len(text):
        if text[i] in ".!?…。！？":
            j = i + 1
            while j < len(text) and text[j] in "\"'”’)]":
                j += 1
            k = j
            while k < len(text) and text[k].isspace():
                k += 1
            if k > j:
                cuts.append(k)
                i = k
                continue
            if text[i] in "。！？":
                cuts.append(i + 1)
        i += 1
    cuts = [c for n, c in enumerate(cuts) if c < len(text) and (n == 0 or c > 0)] + [len(text)]
    return [(a, b, a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


ODD = ["One. Two! Three", "He said \"no.\" Then (yes.) went. ", "3.14 is no end. It is", "終わり。次は！はい？ end", "!! ?", ". Next", "。。", "a…b… c", "wait.)x (done.)  y", "only", "a.’ b"]


def test_odd_sentences(spark):
    from lectern.operators.paragraphs import split_sentences, word_spans

    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "n long, text string")
    got = defaultdict(list)
    for r in split_sentences(df, ["n"]).orderBy("n", "sentence_no").collect():
        got[r.n].append((r.cut_start, r.cut_end, r.start, r.end))
    assert got == {i: sentences(t) for i, t in enumerate(ODD)}
    words = spark.createDataFrame([(0, "it’s 3.5-fold x_y -z-. 海の水abc、ok 가나다")], "n long, text string")
    assert [r.word for r in word_spans(words, ["n"]).orderBy("word_no").collect()] == ["it’s", "3.5-fold", "x", "y", "z", "海", "の", "水abc", "ok", "가", "나", "다"]


def test_sentences_and_their_times(spark, sf):
    want = {(r.doc_id, r.para): sentences(r.text) for r in fixtures.paras(spark, sf).collect()}
    rows = text_queries.txt13(spark, sf).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.sentence_no):
        got[r.doc_id, r.para].append((r.cut_start, r.cut_end, r.start, r.end))
    assert got == want
    words = defaultdict(list)
    for r in text_queries.timeline(spark, sf).orderBy("word_no").collect():
        words[r.doc_id, r.para].append((r.start, r.f0, r.f1))
    times = {}
    for key, cut in want.items():
        for n, (a, b, start, end) in enumerate(cut):
            inside = [w for w in words[key] if a <= w[0] < b]
            if inside:
                times[*key, n] = start, end, inside[0][1], inside[-1][2]
    assert {(r.doc_id, r.para, r.sentence_no): (r.start, r.end, r.f0, r.f1) for r in text_queries.tim5(spark, sf).collect()} == times


def test_stitched_documents(spark, sf):
    docs, paras = {}, defaultdict(list)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        docs[r.doc_id] = f"{r.source}.{r.doc_id // 1000}"
    for r in fixtures.paras(spark, sf).orderBy("doc_id", "para").collect():
        paras[r.doc_id].append(r.text)
    books = defaultdict(list)
    for doc in sorted(docs):
        if paras[doc]:
            out, (first, *rest) = books[docs[doc]], paras[doc]
            if out and not END.search(out[-1]) and first[0].islower() and len(out[-1]) > 20 and not re.fullmatch(r"(Chapter|CHAPTER)\s+\d+", out[-1]):
                out[-1] += " " + first
            else:
                out.append(first)
            out += rest
    got = defaultdict(list)
    for r in layout_queries.lay20b(spark, sf).orderBy("para").collect():
        got[r.doc_id].append(r.text)
    assert got == books
