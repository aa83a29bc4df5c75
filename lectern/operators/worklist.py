"""Work-lists of incremental synthesis and extraction, and accounting of what is kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import SPEEDS, is_picture

LOOKAHEAD = 3


def enabled_speeds(chosen: DataFrame, active: DataFrame) -> DataFrame:
    """(reader, speed): chosen(reader, speed) and the active one, those of the catalogue, each once."""
    return chosen.select("reader", "speed").unionByName(active.select("reader", "speed")).where(F.col("speed").isin(*SPEEDS)).distinct()


def synthesis_worklist(paras: DataFrame, speeds: DataFrame, focus: DataFrame, done: DataFrame) -> DataFrame:
    """Per reader the ordered (para, speed) jobs. paras(reader, para, text), speeds(reader, speed), focus(reader, position,
    active), done(reader, para, speed). First what is near the position, at the active speed and then at the others, then
    what follows, then what lies before."""
    n = paras.groupBy("reader").agg(F.count("*").alias("_n"))
    at = focus.join(n, "reader").select("reader", "active", F.least("position", F.greatest(F.col("_n") - 1, F.lit(0))).alias("_cur"))
    jobs = paras.where(~is_picture("text")).select("reader", "para").join(at, "reader").join(speeds, "reader")
    own = F.abs(F.col("speed") - F.col("active")) <= 1e-9
    zone = F.when(F.col("para") < F.col("_cur"), 4).when(F.col("para") < F.col("_cur") + LOOKAHEAD, 0).otherwise(2)
    jobs = jobs.join(done, ["reader", "para", "speed"], "left_anti").withColumn("_tier", zone + F.when(own, 0).otherwise(1))
    rank = F.row_number().over(Window.partitionBy("reader").orderBy("_tier", "para", "speed"))
    return jobs.select("reader", "para", "speed", rank.cast("long").alias("rank"))


def urgent_first(worklist: DataFrame, requests: DataFrame, failed: DataFrame, done: DataFrame) -> DataFrame:
    """Requests (reader, para, speed, asked) before the plan, newest first, each key once; failed keys leave the plan only."""
    keys = ["reader", "para", "speed"]
    asked = requests.join(done, keys, "left_anti").groupBy(*keys).agg(F.max("asked").alias("_asked")).withColumn("_plan", F.lit(None).cast("long"))
    plan = worklist.join(failed, keys, "left_anti").join(asked, keys, "left_anti").select(*keys, F.lit(None).cast("long").alias("_asked"), F.col("rank").alias("_plan"))
    rank = F.row_number().over(Window.partitionBy("reader").orderBy(F.col("_asked").desc_nulls_last(), F.col("_plan").asc_nulls_first(), "para", "speed"))
    return asked.unionByName(plan).select(*keys, F.col("_asked").isNotNull().alias("urgent"), rank.cast("long").alias("rank"))


def coverage(paras: DataFrame, speeds: DataFrame, done: DataFrame) -> DataFrame:
    """(reader, done, total) over the reader's speeds, pictures left out."""
    jobs = paras.where(~is_picture("text")).select("reader", "para").join(speeds, "reader")
    hit = jobs.join(done.select("reader", "para", "speed").distinct().withColumn("_d", F.lit(1)), ["reader", "para", "speed"], "left")
    return hit.groupBy("reader").agg(F.count("_d").alias("done"), F.count("*").alias("total"))


def cache_sizes(assets: DataFrame) -> DataFrame:
    """Bytes and last use of each chapter and, with a null chapter, of all."""
    return assets.rollup("chapter").agg(F.sum("bytes").alias("bytes"), F.max("last_used").alias("last_used"))


def evict_lru(sizes: DataFrame, limit: int, keep: str | None = None) -> DataFrame:
    """Chapters (owner, chapter, bytes, last_used) to delete, least recently used first, until an owner's rest fits; the open
    one stays. No limit (0 or less): none."""
    if limit <= 0:
        return sizes.limit(0).select("owner", "chapter", "bytes")
    total = F.sum("bytes").over(Window.partitionBy("owner"))
    rows = sizes.withColumn("_total", total)
    rows = rows.where(F.col("chapter") != keep) if keep is not None else rows
    order = Window.partitionBy("owner").orderBy("last_used", "chapter").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_before", F.sum("bytes").over(order) - F.col("bytes")).where(F.col("_total") - F.col("_before") > limit).select("owner", "chapter", "bytes")


def emergency_evict(sizes: DataFrame, keep: str) -> DataFrame:
    """(owner, chapters, bytes) freed by deleting all but the open chapter."""
    return sizes.where(F.col("chapter") != keep).groupBy("owner").agg(F.count("*").alias("chapters"), F.sum("bytes").alias("bytes"))


def pending_pages(pages: DataFrame, runs: DataFrame, saved: DataFrame) -> DataFrame:
    """pages(doc, page, signature, n_pages) to process: a saved page counts if its run had this signature and page count."""
    valid = runs.select("doc", "signature", "n_pages")
    same = pages.join(valid, ["doc", "signature", "n_pages"], "left_semi").select("doc", "page").join(saved, ["doc", "page"], "left_semi")
    return pages.join(same, ["doc", "page"], "left_anti").select("doc", "page")


def failed_pages(results: DataFrame, most: int = 3) -> DataFrame:
    """results(doc, page, status: ok, fail or saved) -> doc, failed (list), reused, aborted_at. A saved page neither breaks nor
    feeds a run of failures; the ``most``-th failure in a row stops the document and is itself not listed."""
    order = Window.partitionBy("doc").orderBy("page")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    work = results.where("status <> 'saved'").withColumn("_run", F.sum((F.col("status") == "ok").cast("int")).over(upto))
    streak = F.sum((F.col("status") == "fail").cast("int")).over(Window.partitionBy("doc", "_run").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    stop = work.withColumn("_s", streak).where(F.col("_s") >= most).groupBy("doc").agg(F.min("page").alias("aborted_at"))
    seen = results.join(stop, "doc", "left").where("aborted_at is null or page < aborted_at")
    sums = seen.groupBy("doc").agg(
        F.sort_array(F.collect_list(F.when(F.col("status") == "fail", F.col("page")))).alias("failed"), F.count_if(F.col("status") == "saved").alias("reused"))
    return results.select("doc").distinct().join(sums, "doc", "left").join(stop, "doc", "left").select(
        "doc", F.coalesce("failed", F.array().cast("array<bigint>")).alias("failed"), F.coalesce("reused", F.lit(0)).cast("long").alias("reused"), "aborted_at")


#: Shares of the stages in a page's work.
STAGES = {"layout": 20, "ocr": 50}


def run_progress(reports: DataFrame) -> DataFrame:
    """reports(event_id, page, pages, stage, frac) with the percentage done, 0 to 100."""
    total, first = sum(STAGES.values()), STAGES["layout"]
    within = F.when(F.col("stage") == "layout", F.lit(0) + first * F.col("frac")).otherwise(first + STAGES["ocr"] * F.col("frac"))
    pct = F.floor(100 * ((F.col("page") - 1) + within / total) / F.greatest("pages", F.lit(1)))
    return reports.withColumn("percent", F.greatest(F.lit(0), F.least(F.lit(100), pct)).cast("long"))


def reuse_audio(requests: DataFrame, assets: DataFrame, keys: list[str]) -> DataFrame:
    """requests with ``reused``: whether the audio is there."""
    there = assets.select(*keys).distinct()
    return requests.join(there, keys, "left_semi").withColumn("reused", F.lit(True)).unionByName(requests.join(there, keys, "left_anti").withColumn("reused", F.lit(False)))
