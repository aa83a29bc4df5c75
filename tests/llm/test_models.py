"""Language identification, neighbours, chats, the pipeline and the registered queries."""
import json

import numpy as np
import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from lectern.llm import ann, chat, langid
from lectern.llm.queries import ORACLE, QUERIES, held_out


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95


def test_language_odd(odd, empty):
    d = langid.learn(odd)
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(odd, d).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (1, "en")} <= got
    assert langid.learn(empty) == {} and langid.predict(empty, {}).count() == 0 and langid.keep_known(odd, {}).count() == 0
    assert langid.keep_known(odd, d).columns == odd.columns


def test_language_margin_of_long_texts(spark):
    """A clean text is accepted at any length: a short sentence, and over 1 MB."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang is not null and text is not null")
    model = langid.Compressors(langid.learn(rows))
    for lang in model.names:
        text = "\n".join(r.text for r in rows.where(F.col("lang") == lang).orderBy("doc_id").limit(3000).collect())
        text = text * (1 + 1_200_000 // len(text))
        found = {n: model.predict(text[:n], langid.NARROW) for n in (20_000, 300_000, 1_200_000)}
        assert all(f[0] == lang and f[3] and f[2] >= 4 * langid.NARROW for f in found.values()), (lang, found)
    assert model.predict("The children walked along the river and looked for their boat.", langid.NARROW)[::3] == ("en", True)


def test_neighbours_recall(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits = total = 0
    got = {}
    for r in ann.nearest(vectors, vectors.where("vec_id % 10 = 0"), block=200).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]].tolist()
        hits, total = hits + len(set(want) & {v for v, _ in found.values()}), total + 10
        assert all(abs(d[ids == v][0] - s) < 1e-9 for v, s in found.values()) and sorted(found) == list(range(1, 11))
    assert hits / total >= 0.9


def test_neighbours_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(v, v, k=2).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (1, 1, 0, 0.0), (1, 2, 2, 0.0), (2, 1, 0, 0.0), (2, 2, 1, 0.0)]
    assert ann.nearest(v.limit(0), v).count() == 0 and ann.nearest(v, v.limit(0)).count() == 0


CALLS = [
    ("k", "a", 3, "search", '{"limit": 1, "query": "é"}'), ("k", "b", 1, "search", '{"query": {"$ref": "a"}, "limit": 2}'),
    ("k", "c", 0, "search", '{"limit": true, "query": "x"}'), ("k", "x", 0, "search", '{"query": {"$ref": "y"}, "limit": 2}'),
    ("k", "y", 1, "search", '{"query": {"$ref": "x"}, "limit": 2}'), ("k", "z", 9, "nope", "{}"), ("k", "j", 9, "search", "not json"), ("k", None, 5, "search", None)]


def test_chat(spark):
    from lectern.llm.queries import TOOLS

    calls = spark.createDataFrame(CALLS, "conv_id string, call_id string, turn long, name string, arguments string")
    results = spark.createDataFrame([("k", "a", 5, "late"), ("k", "a", 4, "soon"), ("k", "q", 4, "orphan")], "conv_id string, call_id string, turn long, content string")
    got = {r.call_id: r for r in chat.link_calls(calls, results, TOOLS).collect()}
    assert len(got) == len(CALLS) and got["a"].linked and json.loads(got["a"].message)["result"] == "soon"
    assert got["a"].message == '{"call":{"arguments":{"limit":1,"query":"é"},"id":"a","name":"search"},"result":"soon"}'
    assert got["b"].level == 1 and got["b"].valid and got["b"].position > got["a"].position
    assert got["x"].cyclic and got["y"].cyclic and got["c"].error == "limit is no integer"
    assert got["z"].error == "unknown tool" and got["j"].error == "arguments are no object" and not got[None].linked
    assert [r.call_id for r in chat.unlinked_results(calls, results).collect()] == ["q"]
    assert chat.link_calls(calls.limit(0), results, TOOLS).count() == 0


def test_chat_keeps_repeated_calls_and_lone_surrogates(spark):
    from lectern.llm.queries import TOOLS

    rows = [("k", "a", 1, "search", '{"query":"\\ud800","limit":1}'), ("k", "a", 2, "open", '{"query":{"$ref":"b"},"limit":1,"\\udc01":0}'),
            ("k", "b", 3, "search", '{"query":"' + "x" * 50_000 + '","limit":1}'), ("k", "b", 3, "search", '{"query":"' + "x" * 50_000 + '","limit":1}')]
    calls = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id string, call_id string, turn long, name string, arguments string, _c string, _n int")
    results = spark.createDataFrame([("k", "a", 4, "\x00 done"), ("k", "a", 4, "\x00 done")], "conv_id string, call_id string, turn long, content string")
    got = sorted(chat.link_calls(calls, results, TOOLS).collect(), key=lambda r: r.position)
    assert [(r.call_id, r.level, r.position, r.linked, r.valid) for r in got] == [
        ("b", 0, 0, False, True), ("b", 0, 1, False, True), ("a", 1, 2, True, True), ("a", 1, 3, True, False)]
    assert json.loads(got[2].message)["call"]["arguments"]["query"] == "\ud800" and got[3].error == "unexpected \\udc01"
    assert '"result":"\\u0000 done"' in got[2].message


def longest_paths(deps):
    """{call: level} by rounds; calls in or behind a circle are missing."""
    level = {}
    while ready := [c for c, d in deps.items() if c not in level and all(x in level for x in d)]:
        level |= {c: max([level[x] + 1 for x in deps[c]], default=0) for c in ready}
    return level


@pytest.mark.parametrize("long, tables", [(chat.LONG, 10), (100, 100), (0, 100)])
def test_chat_levels_and_positions_of_any_graph(spark, monkeypatch, long, tables):
    """Levels against brute force: a chain of 300, trees, calls with several references, circles; positions over several tasks. By
    conversation, by rounds (which follow the logarithm of a chain's length), and some this way and some that."""
    monkeypatch.setattr(chat, "LONG", long)
    rng = np.random.default_rng(5)
    graphs = {"chain": {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(300)}, "ring": {f"c{i}": [f"c{(i + 1) % 7}"] if i < 7 else [f"c{i - 1}"] for i in range(20)}}
    for g in range(6):
        graphs[f"g{g}"] = {f"c{i}": sorted({f"c{int(x)}" for x in rng.integers(0, max(1, i) if g % 2 else 60, min(i, int(rng.choice([0, 1, 1, 1, 2, 3]))))}) for i in range(60)}
    rows = [(g, c, int(c[1:]) % 5, "search", json.dumps({"query": [{"$ref": d} for d in deps]})) for g, x in graphs.items() for c, deps in x.items()]
    rows += [(None, None, i, "search", "{}") for i in range(9)]
    calls = spark.createDataFrame(rows, "conv_id string, call_id string, turn long, name string, arguments string")
    results = spark.createDataFrame([], "conv_id string, call_id string, turn long, content string")
    rounds = count_tables(monkeypatch)
    got = {}
    for r in chat.link_calls(calls, results, {}).collect():
        got.setdefault(r.conv_id, []).append((r.position, r.call_id, r.level, r.cyclic))
    for g, deps in graphs.items():
        level, turn = longest_paths(deps), lambda c: int(c[1:]) % 5
        order = sorted(deps, key=lambda c: (c not in level, level.get(c, 0), turn(c), c))
        assert sorted(got[g]) == [(i, c, level.get(c), c not in level) for i, c in enumerate(order)]
    assert sorted(p for p, *_ in got[None]) == list(range(9))
    assert len(rounds) < tables


def count_tables(monkeypatch):
    rounds = []
    for name in ("durable", "measured"):
        monkeypatch.setattr(chat, name, lambda df, what, real=getattr(chat, name), **k: (rounds.append(what), real(df, what, **k))[1])
    return rounds


def test_a_long_chain_of_calls_that_name_two_others(spark, monkeypatch):
    rounds = count_tables(monkeypatch)
    calls = spark.createDataFrame([("a", f"c{i}", i, "search", json.dumps([{"$ref": f"c{i - 1}"}, {"$ref": f"c{i - 2}"}])) for i in range(1000)],
                                  "conv_id string, call_id string, turn long, name string, arguments string")
    wrapped = calls.withColumn("arguments", F.concat(F.lit('{"query":'), "arguments", F.lit("}")))
    results = spark.createDataFrame([], "conv_id string, call_id string, turn long, content string")
    got = {r.call_id: r.level for r in chat.link_calls(wrapped, results, {}).collect()}
    assert got == {f"c{i}": i for i in range(1000)} and len(rounds) < 10


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_twins(spark, sf, name):
    same(QUERIES[name](spark, sf), connect(sf), ORACLE[name])


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = P.run(spark, sf).collect()
    kept = {r.doc_id for r in rows}
    assert len(kept) >= 0.85 * docs.select("text").distinct().count() and max(r.offset + r.length for r in rows) <= 4096
    copies = docs.groupBy("text").agg(F.collect_set("doc_id").alias("ids")).where("size(ids) > 1").collect()
    assert all(len(kept & set(c.ids)) <= 1 for c in copies)


def test_held_out_is_a_quarter(spark):
    assert 200 <= spark.range(1000).select(held_out("id").alias("h")).where("h").count() <= 300
