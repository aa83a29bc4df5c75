"""Language identification by compression.

``learn`` gathers a bounded sample of labelled rows and joins each language's texts to a raw-content zstandard
dictionary. A text is encoded against every dictionary; the language with the smallest output wins. The score is the
relative margin between the best two, and a narrow margin is a rejection.

Size of an encoding: zstandard counts whole bytes, too coarse for a short text, so texts under ``SHORT`` bytes are
compressed at a higher effort and a tie is settled by the sum over the text's halves, then by language name. A dictionary
saves a bounded number of bytes, so a text is encoded in blocks of at most ``BLOCK`` bytes, all of them, each against the
fresh dictionaries, and their sizes are summed: the margin doesn't shrink with the length.

Nulls and texts without a letter: ``und`` with score 0. An empty table, or one without labels, gives ``und`` throughout.
Extra columns of the input are ignored by ``predict`` and passed untouched by ``keep_known``.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import regex
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back

UND = "und"
#: Bounds of the labelled sample: languages, texts of each, characters of a text that go into a dictionary.
MAX_LANGUAGES, TEXTS, CHARS = 64, 150, 1500
SHORT, BLOCK, LETTER = 2048, 1 << 14, regex.compile(r"\p{L}")


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          texts: int = TEXTS, chars: int = CHARS, max_languages: int = MAX_LANGUAGES) -> dict[str, bytes]:
    """{language: dictionary}. Reads every labelled row once for the counts and keeps ``texts`` of each language, those of
    the smallest hash; a hash threshold from the counts keeps the ranked rows few, so no language fills a task."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)).alias("h"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not counts:
        return {}
    share = {r["lang"]: min(1 << 30, int(3.0 * texts / r["n"] * (1 << 30)) + 1) for r in counts}
    limit = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    ranked = rows.where(F.col("h") < limit[F.col("lang")]).select("lang", "h", F.substring("text", 1, chars).alias("text"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= texts)
    joined: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", F.desc("r")).toLocalIterator():  # bounded: max_languages * texts * chars
        joined.setdefault(r["lang"], []).append(r["text"])
    return {k: b"\n".join(map(plain, v)) for k, v in joined.items()}


#: ASCII bytes that are no letters become blanks, so that case, digits and marks don't weigh on the choice.
BLANK = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """What is compressed: lower case, letters and runs of one blank."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(BLANK).split())


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.fast, self.fine = [], []
        for name in self.names:
            for level, where in ((1, self.fast), (9, self.fine)):
                d = zstd.ZstdCompressionDict(dictionaries[name], dict_type=zstd.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                where.append(zstd.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, data: bytes) -> np.ndarray:
        """Bytes by language, summed over blocks of about the same length."""
        if len(data) > BLOCK:
            step = -(-len(data) // -(-len(data) // BLOCK))
            return sum(self.sizes(data[i:i + step]) for i in range(0, len(data), step))
        return np.array([len(c.compress(data)) for c in (self.fine if len(data) < SHORT else self.fast)], float)

    def predict(self, text: str | None, narrow: float) -> tuple[str, float, float, bool]:
        """Language, score (0 to 1), margin, accepted."""
        if not self.names or text is None or not LETTER.search(text):
            return UND, 0.0, 0.0, False
        data = plain(text)
        sizes = self.sizes(data)
        if len(data) < SHORT:  # a finer measure: whole and halves together
            half = len(data) // 2
            sizes = sizes + self.sizes(data[:half]) + self.sizes(data[half:])
        best = int(np.argmin(sizes))
        if len(sizes) == 1:
            return self.names[0], 1.0, 1.0, True
        low, next_ = np.partition(sizes, 1)[:2]
        margin = float((next_ - low) / next_)
        return self.names[best], min(1.0, 0.5 + 2.5 * margin), margin, margin >= narrow


#: Relative margin under which a prediction is rejected.
NARROW = 0.005


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", narrow: float = NARROW,
            extra: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: id, lang_pred, score, margin, accepted (and the columns named in ``extra``), from the text alone."""
    extra = extra or []
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(extra)])
    types = "".join(f", _x{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(extra))
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by learn()
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = Compressors(shared.value)
        for pdf in batches:
            found = [model.predict(t, narrow) for t in pdf["_text"]]
            out = pd.DataFrame(found, columns=["lang_pred", "score", "margin", "accepted"])
            out.insert(0, "_id", pdf["_id"].to_numpy())
            for i in range(len(extra)):
                out[f"_x{i}"] = pdf[f"_x{i}"].to_numpy()
            yield out

    out = source.mapInPandas(run, f"_id {id_type}, lang_pred string, score double, margin double, accepted boolean{types}")
    return out.select(F.col("_id").alias(id_col), "lang_pred", "score", "margin", "accepted", *[F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)])


def keep_known(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", narrow: float = NARROW) -> DataFrame:
    """The rows of ``docs``, all their columns, whose language is accepted. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        model = Compressors(shared.value) if not hasattr(accepted, "model") else accepted.model
        accepted.model = model
        found = pd.Series([model.predict(t, narrow)[3] for t in texts], dtype=bool)
        give_back()
        return found

    return docs.where(accepted(F.col(text_col)))
