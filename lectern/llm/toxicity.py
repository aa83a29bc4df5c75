"""Toxicity of texts by a word classifier that is held to counterfactuals.

A logistic model over the words and word stems present in a text (a stem, the first 3 to 7 letters of longer words, counts anew where
two different words have it, so that insults are known in forms not seen before). Besides the labels it is fitted to counterfactual sentences: each labelled
sentence that names a group is put beside the same sentence with another group's name, and the squared change of the score
(before the logistic) is penalised. So the names of groups can't carry the verdict, and neutral mentions aren't flagged.

1. Labels are brought to one text each: of equal texts one row counts, with the mean of their labels.
2. All labelled texts are counted by word and stem (combined before the shuffle); the FEATURES whose share in toxic texts departs
   most from chance, each in LEAST texts or more, are the model's, and the group names beside them.
3. Tasks turn the texts into sets of those, and sentences that name groups into pairs of sets; of either the bounded sample
   of smallest hash (ROWS and PAIRS) goes to the fit, which is a fixed number of gradient steps.
4. Scoring is one pass over all whole texts, without a shuffle.

Odd rows. Null and empty texts have the score of no word. Labels that are null are ignored; without labels, or with labels of one
kind only, every text has the share of toxic labels (0.5 if there are none) as its score. Several labels of one id count as
their mean. Repeated rows are scored alike. An empty table gives an empty table. Further columns are ignored by ``score``.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, maybe_broadcast, measured

#: Bounds of the fit: words and stems of the model, labelled texts, counterfactual pairs; a word is in that many labelled texts or more.
FEATURES, ROWS, PAIRS, LEAST, SURELY = 2048, 20_000, 20_000, 3, 4.5
#: Weight of the penalty, of small weights, and the steps of the fit.
PENALTY, SHRINK, STEPS = 1.0, 5e-5, 400
THRESHOLD = 0.3
#: Names of groups that may stand for one another, a neutral word first.
IDENTITIES = (
    ("people", "women", "men", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "africans", "asians",
     "europeans", "americans", "arabs", "latinos", "gays", "lesbians"),
    ("person", "woman", "man", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "immigrant", "refugee", "african", "asian", "european",
     "american", "arab", "latino", "lesbian"),
    ("human", "black", "white", "gay", "straight", "jewish", "transgender", "disabled", "deaf", "blind", "old", "young"),
    ("personas", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "gitanos"),
    ("personnes", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés"),
    ("menschen", "frauen", "männer", "muslime", "christen", "juden", "einwanderer", "flüchtlinge"),
)
WORD, SENTENCE = regex.compile(r"\p{L}+"), regex.compile(r"[.!?\n]+")
#: Letters of a stem, and what marks it as a stem and as one of several words.
STEMS, STEM, STEM_AGAIN = range(3, 8), "-", "--"
#: Features whose counts a task holds before it passes them on.
HELD = 400_000


def features_of(words: set[str]) -> set[str]:
    """Words, stems of longer words, and stems that several of the words have."""
    out, once = set(words), set()
    for k in STEMS:
        once.clear()
        for w in words:
            if len(w) > k:
                stem = w[:k]
                if stem in once:
                    out.add(stem + STEM_AGAIN)
                else:
                    once.add(stem)
                    out.add(stem + STEM)
    return out


@dataclass(frozen=True)
class Model:
    words: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """The probability that a text is toxic."""
        present = self.words.keys() & features_of(set(WORD.findall((text or "").lower()))) if self.words else ()
        z = self.bias + float(np.sort(self.weights[[self.words[w] for w in present]]).sum()) if present else self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))))


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[DataFrame, dict]:
    """(text, y, h) of the labelled texts, each text once, y the mean of its labels; and their number of rows and sum of y. Hashes
    stand for texts while these are brought together, so that no text is shuffled unless the labels are many."""
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_lid")).agg(F.avg(F.col(label_col).cast("double")).alias("_y"))
    marks, seen = measured(marks, "labels")
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text is not null")
    hashes = base.select("_id", F.xxhash64("text", F.lit(5)).alias("h"))
    known = hashes.join(maybe_broadcast(marks, seen["rows"]), F.col("_id") == F.col("_lid")).groupBy("h").agg(F.avg("_y").alias("y"), F.min("_id").alias("_lid"))
    known, seen = measured(known, "labelled", toxic=F.sum("y"))
    chosen = maybe_broadcast(known.withColumnRenamed("h", "_h"), seen["rows"])
    texts = base.join(chosen, (F.col("_id") == F.col("_lid")) & (F.xxhash64("text", F.lit(5)) == F.col("_h")))
    return texts.select("text", "y", F.col("_h").alias("h")), seen


def _count(batches):
    """Task: texts and labels by feature, passed on whenever HELD of them are held."""
    held: dict[str, list[float]] = {}

    def passed() -> pd.DataFrame:
        out = pd.DataFrame([(w, int(n), t) for w, (n, t) in held.items()], columns=["word", "n", "t"])
        held.clear()
        return out

    for pdf in batches:
        for text, y in zip(pdf["text"], pdf["y"], strict=True):
            for w in features_of(set(WORD.findall(text.lower()))):
                seen = held.setdefault(w, [0, 0.0])
                seen[0] += 1
                seen[1] += y
            if len(held) > HELD:
                yield passed()
    yield passed()


def choose_words(texts: DataFrame, rows: int, toxic: float, features: int = FEATURES, least: int = LEAST, surely: float = SURELY) -> list[str]:
    """The words and stems whose share in toxic texts departs most from that of all texts, in standard deviations: by ``surely`` or
    more, after half a text is taken off, so that rare words aren't chosen by chance."""
    share = toxic / rows
    counts = (
        texts.select("text", "y").mapInPandas(_count, "word string, n long, t double")
        .groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("n") >= least))
    depart = (F.abs(F.col("t") - F.col("n") * share) - 0.5) / F.sqrt(F.col("n") * share * (1 - share))
    return [r["word"] for r in counts.select("word", F.round(depart, 6).alias("z")).where(F.col("z") >= surely).orderBy(F.desc("z"), "word").limit(features).collect()]


def _sets(words: dict[str, int], groups: tuple[tuple[str, ...], ...], limit: int):
    """Task: (kind, h, y, own, other): kind 0 a text's features, kind 1 a sentence's features and those of a counterfactual."""
    others = {w: [o for o in g if o != w] for g in groups for w in g}

    def ids(found: set[str]) -> list[int]:
        return sorted(words[w] for w in words.keys() & features_of(found))

    def run(batches):
        for pdf in batches:
            rows = []
            for text, y, h in zip(pdf["text"], pdf["y"], pdf["h"], strict=True):
                text = text.lower()
                found = set(WORD.findall(text))
                if 0 <= h % (1 << 30) < limit:
                    rows.append((0, h, y, ids(found), []))
                if found & others.keys():
                    for i, sentence in enumerate(SENTENCE.split(text)):
                        own = set(WORD.findall(sentence))
                        for w in sorted(own & others.keys()):
                            for o in others[w]:
                                rows.append((1, hash((h, i, words[w], words[o])), y, ids(own), ids(own - {w} | {o})))
            yield pd.DataFrame(rows, columns=["kind", "h", "y", "own", "other"])

    return run


def _design(sets: list[list[int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ones of a sparse matrix."""
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.repeat(np.arange(len(sets)), sizes), np.array([i for s in sets for i in s], np.int64)


def fit(own: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], width: int, penalty: float = PENALTY,
        shrink: float = SHRINK, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise mean log loss + penalty * mean squared change over the pairs + shrink * |weights|^2, by
    gradient steps with momentum scaled by each weight's own gradients."""
    row, col = _design(own, width)
    left, right = _design([p[0] for p in pairs], width), _design([p[1] for p in pairs], width)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w = np.zeros(width + 1)
    w[width] = np.log(share / (1 - share))
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col], len(own)) + w[width]
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(own)
        g = np.append(np.bincount(col, slope[row], width), slope.sum())
        if pairs:
            change = np.bincount(left[0], w[left[1]], len(pairs)) - np.bincount(right[0], w[right[1]], len(pairs))
            change *= 2 * penalty / len(pairs)
            g[:width] += np.bincount(left[1], change[left[0]], width) - np.bincount(right[1], change[right[0]], width)
        g[:width] += 2 * shrink * w[:width]
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        rate = 0.2 / (1 + step / 100)
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return w[:width], float(w[width])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          groups: tuple[tuple[str, ...], ...] = IDENTITIES, features: int = FEATURES, rows: int = ROWS, pairs: int = PAIRS,
          penalty: float = PENALTY, shrink: float = SHRINK) -> Model:
    """A model from the texts of ``docs`` that ``labels`` marks."""
    texts, seen = labelled_texts(docs, labels, id_col, text_col, label_col)
    if not seen["rows"] or not 0 < seen["toxic"] < seen["rows"]:
        share = seen["toxic"] / seen["rows"] if seen["rows"] else 0.5
        return Model({}, np.zeros(0), float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))))
    chosen = choose_words(texts, seen["rows"], seen["toxic"], features)
    words = {w: i for i, w in enumerate(dict.fromkeys([*chosen, *[w for g in groups for w in g]]))}
    limit = min(1 << 30, int(1.5 * rows / seen["rows"] * (1 << 30)) + 1)  # half more than the sample, so that the rest need not be sorted
    sets = durable(texts.mapInPandas(_sets(words, groups, limit), "kind int, h long, y double, own array<int>, other array<int>"), "word-sets")
    sample = sets.where("kind = 0").orderBy("h", "own", "y").limit(rows).collect()  # bounded: rows * features numbers
    swapped = sets.where("kind = 1").orderBy("h", "own", "other").limit(pairs).collect()
    weights, bias = fit([r["own"] for r in sample], np.array([r["y"] for r in sample]), [(r["own"], r["other"]) for r in swapped], len(words), penalty, shrink)
    return Model(words, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, score, predicted (1 if the score is ``threshold`` or more) for each row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by learn()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"_id": pdf["_id"], "score": [shared.value.score(t) for t in pdf["_text"]]})

    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, f"_id {kind}, score double")
    return found.select(F.col("_id").alias(id_col), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
