"""Runs of a user's function: failures as rows, stopping, resuming, reuse."""
from lectern.operators import hooks as H


def pages_of(spark, n, doc=1):
    return spark.createDataFrame([(doc, k, f"t{k}", "s", n) for k in range(n)], "doc long, page long, text string, signature string, n_pages long")


def keep(df):
    rows = df.collect()
    return df.sparkSession.createDataFrame(rows, df.schema)


def run(spark, pages, engine, saved=None, signature="s", block=2):
    runs = spark.createDataFrame([(1, signature, 10)] if saved is not None else [], "doc long, signature string, n_pages long")
    old = saved if saved is not None else spark.createDataFrame([], "doc long, page long, text string")
    return H.recognition_run(pages, engine, runs, old, keep, block=block)


def test_a_run_stops_resumes_and_ends_with_the_same_table(spark):
    """The third page in a row that fails stops the document, over the edge of two blocks; the second run does the rest."""
    pages = pages_of(spark, 10)

    def worn(page):
        if page["page"] in (1, 5, 6, 7, 8):
            raise OSError(page["text"])
        return page["text"] * 2

    results, summary = run(spark, pages, worn)
    assert [tuple(r) for r in summary.collect()] == [(1, [1, 5, 6], 0, 7)]
    got = {r.page: (r.status, r.text, r.error) for r in results.collect()}
    assert sorted(got) == list(range(7)) and got[1] == ("fail", None, "OSError: t1") and got[4] == ("ok", "t4t4", None)
    good = lambda page: page["text"] * 2
    again, summary = run(spark, pages, good, results.where("status = 'ok'"))
    whole, _ = run(spark, pages, good)
    table = lambda df: sorted((r.page, r.text) for r in df.collect())
    assert table(again) == table(whole) and summary.first().reused == 4
    assert {r.page for r in again.where("status = 'saved'").collect()} == {0, 2, 3, 4}
    other, _ = run(spark, pages, good, results.where("status = 'ok'"), signature="old")
    assert {r.status for r in other.collect()} == {"ok"}  # other settings: nothing is reused


def test_an_engine_that_always_fails_tries_few_pages(spark, tmp_path):
    def broken(page):
        (tmp_path / str(page["page"])).touch()
        raise ImportError("no engine")

    _, summary = run(spark, pages_of(spark, 100), broken, block=50)
    assert summary.first().aborted_at == 2 and len(list(tmp_path.iterdir())) == 6  # three in each of two blocks


def test_nothing_to_do(spark):
    results, summary = run(spark, pages_of(spark, 3).limit(0), lambda page: "")
    assert results.count() == 0 and summary.count() == 0


def test_synthesis_reuses_and_reports(spark):
    requests = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("b", 1, ""), ("c", 2, "z")], "hash string, para long, text string")
    assets = spark.createDataFrame([("c", 2, b"old"), ("c", 2, b"old"), ("d", 1, b"other")], "hash string, para long, audio binary")

    def speak(request):
        if not request["text"]:
            raise ValueError("nothing to say")
        return request["text"].encode()

    got = {r.hash: (r.status, r.audio and bytes(r.audio), r.error) for r in H.synthesise_paragraphs(requests, speak, assets, ["hash", "para"]).collect()}
    assert got == {"a": ("made", b"x", None), "b": ("fail", None, "ValueError: nothing to say"), "c": ("reused", b"old", None)}
    assert H.synthesise_paragraphs(requests, speak, assets, ["hash", "para"]).count() == 3
