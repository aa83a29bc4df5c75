"""Layout queries without a twin, over all documents."""
from collections import defaultdict

from lectern.plans import layout_queries as Q


def test_signatures_of_long_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 2 = 0 or doc_id % 3 = 0").collect()
    want = {r.doc_id for r in docs if any(x.strip(" ") for x in (r.text or "").split("\n"))}
    assert any(len(r.text or "") > 4000 for r in docs) and {r.doc_id for r in Q.lay19(spark, sf).collect()} == want


def merged(boxes, gap):
    """[box, x0, y0, x1, y1, members] of one page, pair by pair until all are apart."""
    boxes, i = [list(b) for b in boxes], 0
    while i < len(boxes):
        a = boxes[i]
        for b in boxes[i + 1:]:
            if a[1] <= b[3] + gap and b[1] <= a[3] + gap and a[2] <= b[4] + gap and b[2] <= a[4] + gap:
                boxes.remove(b)
                boxes[i] = [min(a[0], b[0]), min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]), a[5] + b[5]]
                i = -1
                break
        i += 1
    return boxes


def test_merged_boxes_of_all_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sizes = {r.doc_id: sum(-(-len(x.split()) // 6) for x in (r.text or "").split("\n")) for r in docs}
    pages = {}
    for r in Q.all_boxes(spark, sf).collect():
        pages.setdefault((r.doc_id, r.page), []).append((r.box, r.x0, r.y0, r.x1, r.y1, 1))
    got = {}
    for r in Q.lay25(spark, sf).collect():
        got.setdefault((r.doc_id, r.page), []).append([r.box, r.x0, r.y0, r.x1, r.y1, r.members])
    assert sum(b[5] for x in got.values() for b in x) == sum(n + 2 * -(-n // 40) for n in sizes.values())
    assert {p: sorted(x) for p, x in got.items()} == {p: sorted(merged(x, 10.0)) for p, x in pages.items()}
    assert len({b[5] for x in got.values() for b in x}) > 5


def test_clusters_of_all_lines(spark, sf):
    pages = defaultdict(list)
    for r in Q.all_boxes(spark, sf).collect():
        pages[r.doc_id, r.page].append(r)
    want = set()
    for page, boxes in pages.items():
        reach = {b.box: {c.box for c in boxes if b.x0 <= c.x1 + 10 and c.x0 <= b.x1 + 10 and b.y0 <= c.y1 + 10 and c.y0 <= b.y1 + 10} for b in boxes}
        left = set(reach)
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                seen.add(x := todo.pop())
                todo += reach[x] - seen
            left -= seen
            want |= {(*page, x, min(seen)) for x in seen}
    got = {(r.doc_id, r.page, r.box, r.cluster) for r in Q.lay24(spark, sf).collect()}
    assert got == want and len({x[3] for x in want}) > 5


def test_boxes_of_many_pages_at_once(spark):
    """Pages that cross batches, a crowded page, one of a single box and one without a number: as pair by pair."""
    import random

    from lectern.operators.layout import cluster_boxes, merge_boxes

    rnd, rows = random.Random(3), []
    for page, n in [(p, p % 7 + 1) for p in range(60)] + [(100, 150), (None, 5)]:
        for box in rnd.sample(range(1000), n):
            x, y = rnd.randrange(0, 400), rnd.randrange(0, 600)
            rows.append((1, page, box, float(x), float(y), float(x + rnd.randrange(1, 40)), float(y + rnd.randrange(1, 40))))
    df = spark.createDataFrame(rows, "doc_id long, page int, box int, x0 double, y0 double, x1 double, y1 double").repartition(3)
    pages = defaultdict(list)
    for r in rows:
        pages[r[1]].append((*r[2:], 1))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got, labels = defaultdict(list), defaultdict(set)
        for r in merge_boxes(df, 5.0).collect():
            got[r.page].append([r.box, r.x0, r.y0, r.x1, r.y1, r.members])
        for r in cluster_boxes(df, 5.0).collect():
            labels[r.page].add((r.box, r.cluster))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {p: sorted(x) for p, x in got.items()} == {p: sorted(merged(sorted(x), 5.0)) for p, x in pages.items()}
    for page, boxes in pages.items():
        root = {b[0]: b[0] for b in boxes}
        for _ in range(20):
            for a in boxes:
                for b in boxes:
                    if a[1] <= b[3] + 5 and b[1] <= a[3] + 5 and a[2] <= b[4] + 5 and b[2] <= a[4] + 5:
                        root[a[0]] = root[b[0]] = min(root[a[0]], root[b[0]])
        assert labels[page] == set(root.items())


def test_boxes_are_not_grouped_page_by_page(spark, sf):
    """A group handed to Python for each page costs more than its boxes."""
    for df in (Q.lay24(spark, sf), Q.lay25(spark, sf), Q.lay26(spark, sf)):
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
