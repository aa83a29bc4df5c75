"""Runs of a user's function over many items: recognition of pages, synthesis of paragraphs. A failure is a row, not the end of the job;
what is done is kept, and a later run goes on with the rest.

The function is a plain Python callable that is pickled to the tasks. It may be costly, so items are dealt over all tasks; a page's
document is cut in blocks of pages for it, and no document has to be one task's.
"""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.worklist import failed_pages, pending_pages, reuse_audio

#: Pages of a document that one task takes in order, and failures in a row that stop a document.
BLOCK, MOST = 64, 3


def _in_blocks(function: Callable[[dict], str], most: int, given: list[str]):
    """Task: pages by document and block, in order. A block ends at ``most`` failures in a row, as the document does at that page or
    before."""
    def run(batches):
        key, streak = None, 0
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                now = (row["doc"], row["_block"])
                if now != key:
                    key, streak = now, 0
                if streak >= most:
                    continue
                try:
                    text, error = function({c: row[c] for c in given}), None
                    streak = 0
                except Exception as failure:  # whatever a user's function raises is this page's failure
                    text, error = None, f"{type(failure).__name__}: {failure}"
                    streak += 1
                rows.append((row["doc"], row["page"], "ok" if error is None else "fail", text, error))
            yield pd.DataFrame(rows, columns=["doc", "page", "status", "text", "error"])

    return run


def recognise_pages(pages: DataFrame, recognise: Callable[[dict], str], block: int = BLOCK, most: int = MOST) -> DataFrame:
    """pages(doc, page, ...) -> (doc, page, status ok or fail, text, error): ``recognise`` gets a page's columns as a dict. Blocks of a
    document run side by side, so when it fails everywhere each block tries ``most`` pages and no more."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    dealt = pages.withColumn("_block", F.floor(F.col("page") / block)).repartition("doc", "_block").sortWithinPartitions("doc", "_block", "page")
    return dealt.mapInPandas(_in_blocks(recognise, most, pages.columns), f"doc {kinds['doc']}, page {kinds['page']}, status string, text string, error string")


def recognition_run(pages: DataFrame, recognise: Callable[[dict], str], runs: DataFrame, saved: DataFrame, keep: Callable[[DataFrame], DataFrame],
                    block: int = BLOCK, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """One run over pages(doc, page, signature, n_pages, ...) -> (results, summary).

    runs(doc, signature, n_pages) and saved(doc, page, text) are what earlier runs left: a saved page counts if its run had the same
    signature and page count. results(doc, page, status ok, fail or saved, text, error) are the pages up to where a document stops,
    at its ``most``-th failure in a row; summary(doc, failed, reused, aborted_at) as ``failed_pages`` gives it. ``keep`` writes a
    table and reads it back, so that the function is called once for each page."""
    todo = pending_pages(pages, runs, saved)
    fresh = recognise_pages(pages.join(todo, ["doc", "page"], "left_semi"), recognise, block, most)
    old = pages.join(todo, ["doc", "page"], "left_anti").select("doc", "page").join(saved.select("doc", "page", "text"), ["doc", "page"])
    done = keep(fresh.unionByName(old.select("doc", "page", F.lit("saved").alias("status"), "text", F.lit(None).cast("string").alias("error"))))
    summary = failed_pages(done.select("doc", F.col("page").cast("long").alias("page"), "status"), most)
    seen = done.join(summary.select("doc", "aborted_at"), "doc").where("aborted_at is null or page < aborted_at").drop("aborted_at")
    return seen, summary


def synthesise_paragraphs(requests: DataFrame, synthesise: Callable[[dict], bytes], assets: DataFrame, keys: list[str]) -> DataFrame:
    """requests(keys, ...) -> (keys, status made, reused or fail, audio, error). What is in assets(keys, audio) is reused; of requests with
    equal keys the function is called for one."""
    split = reuse_audio(requests, assets, keys)
    old = split.where("reused").select(*keys).distinct().join(assets.select(*keys, "audio").dropDuplicates(keys), keys)
    todo = split.where("not reused").drop("reused").dropDuplicates(keys)
    kinds = ", ".join(f"{k} {todo.schema[k].dataType.simpleString()}" for k in keys)
    given = todo.columns

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                try:
                    audio, error = synthesise({c: row[c] for c in given}), None
                except Exception as failure:  # as for pages
                    audio, error = None, f"{type(failure).__name__}: {failure}"
                rows.append((*[row[k] for k in keys], "made" if error is None else "fail", audio, error))
            yield pd.DataFrame(rows, columns=[*keys, "status", "audio", "error"])

    made = todo.repartition(*keys).mapInPandas(run, f"{kinds}, status string, audio binary, error string")
    return made.unionByName(old.select(*keys, F.lit("reused").alias("status"), "audio", F.lit(None).cast("string").alias("error")))
