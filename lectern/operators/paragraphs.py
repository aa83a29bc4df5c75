"""Documents to paragraphs, sentences, words and reading statistics."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import QUOTES, STOPS, WHITE, clean_paragraph, col, is_picture

#: The blocks whose characters are words of their own, and the marks that may join parts of a word.
SINGLE_BLOCKS = ("Hiragana", "Katakana", "CJKUnifiedIdeographsExtensionA", "CJKUnifiedIdeographs", "HangulSyllables")
JOINTS = "'’.,-"
CJK = "".join(rf"\p{{In{block}}}" for block in SINGLE_BLOCKS)
#: A word: runs of letters and digits with one joint between each two.
_RUN = r"[a-zA-Z0-9[\w&&[^_]]]++"  # plain letters are tried first
WORD = rf"{_RUN}(?:[{JOINTS}]{_RUN})*+"


def paragraph_array(text: str | Column) -> Column:
    """Cleaned, non-empty paragraphs of a text: split at blank lines if there are any, else at every line."""
    t = F.replace(F.replace(col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    parts = F.when(t.rlike(r"(?U)\n\s*\n"), F.split(t, r"(?U)\n\s*\n")).otherwise(F.split(t, "\n"))
    return F.filter(F.transform(parts, clean_paragraph), lambda p: p != "")


def split_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, para, text): numbered from 0 in each document. No shuffle: a document's paragraphs come from its own row."""
    pos = docs.select(id_col, F.posexplode(paragraph_array(text_col)).alias("para", "text"))
    return pos.withColumn("para", F.col("para").cast("long"))


def word_arrays(paras: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, words, gaps) of paragraphs with a word: arrays of the words and of what lies before, between and behind them. A paragraph
    is cut once into its words and once into its gaps. Paragraphs are dealt over the tasks before that, and never move again."""
    text = F.col(text_col)
    rows = paras.where(text.isNotNull()).select(*keys, text.alias("_t")).repartition(*keys)
    rows = rows.select(*keys, F.regexp_extract_all("_t", F.lit(f"(?U){WORD}"), F.lit(0)).alias("_w"), F.split("_t", f"(?U){WORD}").alias("_g"), F.col("_t").rlike(f"[{CJK}]").alias("_cjk"))
    rows = rows.where(F.size("_w") > 0)
    parts = F.transform("_w", lambda w: F.split(w, f"(?!^)(?=[{CJK}])"))
    cut = rows.withColumn("_parts", F.when(F.col("_cjk"), parts))
    none = F.array().cast("array<string>")
    behind = F.transform("_parts", lambda ps, i: F.concat(F.array_repeat(F.lit(""), F.size(ps) - 1), F.array(F.get("_g", i + 1))))
    return cut.select(
        *keys, F.when(F.col("_cjk"), F.flatten("_parts")).otherwise(F.col("_w")).alias("words"),
        F.when(F.col("_cjk"), F.concat(F.array(F.get("_g", F.lit(0))), F.coalesce(F.flatten(behind), none))).otherwise(F.col("_g")).alias("gaps"))


def lengths_up_to(words: pa.Array, gaps: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a batch in their paragraphs, and the words' offsets: running sums over whole batches."""
    size = lambda a: pc.fill_null(pc.utf8_length(a.flatten()), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False)))).astype(np.int64)
    count = np.diff(at)
    # A paragraph's last gap is behind its last word, so the others pair with the words.
    before, length = np.delete(size(gaps), at[1:] + np.arange(len(count))), size(words)
    ends = np.cumsum(before + length)
    ends -= np.repeat(np.concatenate(([0], ends))[at[:-1]], count)
    return ends - length, ends, at


def as_lists(at: np.ndarray, **columns: np.ndarray) -> pa.Array:
    """Columns of a batch's words as a list of structs for each paragraph."""
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns)))


def _places(words: pa.Array, gaps: pa.Array) -> pa.Array:
    starts, ends, at = lengths_up_to(words, gaps)
    return as_lists(at, start=starts, end=ends)


def word_spans(paras: DataFrame, keys: list[str], text_col: str = "text", gaps: bool = False) -> DataFrame:
    """(keys, word_no, start, end, word). Inner apostrophes, points, commas and hyphens stay inside a word; every CJK
    character is a word, and other characters of such a run join the word right before them. With ``gaps`` also ``gap``, the
    text between a word and the next one or the end. Places are running sums of lengths, so words are neither moved nor sorted."""
    rows = word_arrays(paras, keys, text_col).withColumn("at", F.arrow_udf(_places, "array<struct<start: bigint, end: bigint>>")("words", "gaps"))
    each = F.arrays_zip("words", "at", *([F.slice("gaps", 2, F.size("words")).alias("gap")] if gaps else []))
    flat = rows.select(*keys, F.posexplode(each).alias("word_no", "_i"))
    return flat.select(*keys, F.col("word_no").cast("long").alias("word_no"), "_i.at.start", "_i.at.end", F.col("_i.words").alias("word"), *(["_i.gap"] if gaps else []))


#: The stops that end a sentence without a blank.
WIDE_STOPS = "。！？"
#: A sentence: as little as there is up to a stop, what closes behind it and blanks; up to a wide stop; or up to the end.
SENTENCE = rf"(?Us).*?(?:[{STOPS}][{''.join(chr(92) + c for c in QUOTES)}]*\s+|[{WIDE_STOPS}]|\z)"


def split_sentences(paras: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, sentence_no, cut_start, cut_end, start, end): cuts tile the paragraph; start and end leave outer blanks out."""
    rows = paras.where(F.length(text_col) > 0).select(*keys, F.col(text_col).alias("_t"))
    cut = rows.select(*keys, "_t", F.posexplode(F.regexp_extract_all("_t", F.lit(SENTENCE), F.lit(0))).alias("_n", "_s"))
    upto = Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.where("_s <> ''").withColumn("cut_end", F.sum(F.length("_s")).over(upto).cast("long"))
    cut = cut.withColumn("cut_start", F.col("cut_end") - F.length("_s"))
    blank_before = F.length("_s") - F.length(F.ltrim(F.col("_s"), F.lit(WHITE)))
    blank_behind = F.length("_s") - F.length(F.rtrim(F.col("_s"), F.lit(WHITE)))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("cut_start")) - 1
    return cut.select(
        *keys, number.cast("long").alias("sentence_no"), "cut_start", "cut_end",
        (F.col("cut_start") + blank_before).cast("long").alias("start"), (F.col("cut_end") - blank_behind).cast("long").alias("end"))


def reading_stats(paras: DataFrame, keys: list[str], speed: float = 1.0, text_col: str = "text") -> DataFrame:
    """(keys, paragraphs, words, minutes) at 160 words a minute; pictures have no words."""
    words = F.when(is_picture(text_col), 0).otherwise(F.size(F.filter(F.split(text_col, r"(?U)\s+"), lambda w: w != "")))
    sums = paras.groupBy(*keys).agg(F.count("*").alias("paragraphs"), F.sum(words).cast("long").alias("words"))
    return sums.withColumn("minutes", F.greatest(F.lit(1), F.bround(F.col("words") / (160.0 * speed))).cast("long"))
