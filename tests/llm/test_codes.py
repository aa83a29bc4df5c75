"""Spelling variants, vector codes and toxicity against brute force, odd and empty tables, held-out rows."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from lectern.llm import spelling, toxicity, veccode
from lectern.llm.common import attach_totals, durable
from lectern.llm.queries import ORACLE, QUERIES, held_out

# --- spelling --------------------------------------------------------------------------------------------------------


def words_brute(rows, shortest=7, least=2):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def variants_brute(n):
    """By deleted letters: two words are near only if they share a word with a letter less, or one is the other's."""
    less = defaultdict(set)
    for w in n:
        less[w].add(w)
        for i in range(len(w)):
            less[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for ws in less.values():
        for a in ws:
            near[a].update(b for b in ws if b != a and one_edit(a, b))
    out = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = [form, n[w], len(near[w]), n[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.insert(1, root)
    return {w: tuple(r) for w, r in out.items()}


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = variants_brute(words_brute(rows))
    assert rows_of(QUERIES["op11_spelling_variants"](spark, sf)) == want and sum(r[3] for r in want.values()) > 100


def crowded_rows(seed=3):
    """Few letters, so that nearly all words are near others, chains of forms, accents and a very long word."""
    rng = random.Random(seed)
    text = []
    for _ in range(1500):
        word = "".join(rng.choice("abÀé") for _ in range(rng.randint(7, 10)))
        text += [word] * rng.choice([1, 2, 3, 40, 500])
    long = "ab" * 20_000
    text += [long, long, long[:-1] + "z", long[:-1] + "z", "Common" + "ness"] * 2
    return [(i, " ".join(text[i::50])) for i in range(50)] + [(None, "nullid nullidx nullidxx " * 3), (1, None), (2, "")]


@pytest.mark.parametrize("crowd", [5, 20_000])
def test_variants_of_crowded_words(spark, crowd):
    rows = crowded_rows()
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    n = words_brute(rows)
    assert rows_of(spelling.variants(frame, crowd=crowd)) == variants_brute(n)


def test_acceptor_is_minimal():
    machine = spelling.Acceptor(sorted(["tapping", "topping", "tapped", "topped"]))
    assert len(machine.states) == 9  # one tail for both stems: start, a or o, p, p, i or e, n, g, d, end
    pairs = list(spelling.pairs_of(sorted(["ab", "abc", "acb", "b", "bb"]), 9, 2))
    assert sorted(pairs) == [("ab", "abc"), ("ab", "acb"), ("ab", "bb")]


def test_variants_odd(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(spelling.variants(odd)) == variants_brute(words_brute(rows))
    assert spelling.variants(empty).count() == 0


# --- vector codes ----------------------------------------------------------------------------------------------------


def codes_brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, lab, [int(np.floor(4096 * float(x))) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max((len(v) for *_, v in kept), default=1) // parts) * parts
    k = width // parts
    cut = [[(v + [0] * (width - len(v)))[p * k : (p + 1) * k] for p in range(parts)] for *_, v in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0], kept[r][2]))[:entries]
    books = [[list(cut[r][p]) for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, y), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[near(c[p], books[p])[1]].append(c[p])
            for e, xs in own.items():
                books[p][e] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by = defaultdict(int)
    for (_, lab, _), e in zip(kept, errors, strict=True):
        by[lab] += e
    top = veccode.TOP
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), min(e_, top), min(by[lab], top)) for (i, lab, _), f, e_ in zip(kept, found, errors, strict=True)), key=repr), sha


def test_vector_codes_against_twin(spark, sf):
    same(QUERIES["op12_vector_codes"](spark, sf), connect(sf), ORACLE["op12_vector_codes"])


def compressed(frame):
    codes, books = veccode.compress(frame)
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in codes.collect()), key=repr), veccode.fingerprint(books)


SCHEMA = "vec_id long, embedding array<double>, label int, code string, _id int"


def test_vector_codes_odd(spark):
    rng = random.Random(5)
    rows = [(i, None if i % 7 == 0 else i % 3, [rng.uniform(-3, 3) for _ in range(20 if i % 5 else 17)]) for i in range(60)]
    rows += [(3, 1, [1.0] * 20), (3, 1, [1.0] * 20), (None, 2, [0.5] * 20), (None, None, [-0.5] * 3), (99, 0, None), (98, 0, [1.0, None]),
             (97, 0, [float("nan")]), (96, 0, [float("inf"), 1.0]), (95, 0, [])]
    big = [(i, i % 2, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 3, 6, 9]) for _ in range(16)]) for i in range(40)]
    for own in (rows, big, rows[:3]):
        frame = spark.createDataFrame([(i, v, lab, "x", 1) for i, lab, v in own], SCHEMA)
        assert compressed(frame) == codes_brute(own)
    assert compressed(spark.createDataFrame([], SCHEMA))[0] == []


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for size in (3, 20, 26, 31, 50):
        for width in (1, 8, 100):
            x, c = (rng.integers(-(1 << size), 1 << size, (n, width)) for n in (30, 5))
            want = x.astype(object) @ c.astype(object).T
            assert (veccode.exact_product(x, c).astype(object) == want).all()
            far = ((x.astype(object)[:, None] - c.astype(object)[None]) ** 2).sum(2)
            at, d = veccode.nearest(x, c)
            assert (at == np.argmin(far, 1)).all() and (d.astype(object) == far.min(1)).all()


def test_totals_of_hot_keys(spark, monkeypatch):
    from lectern.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = durable(spark.range(500).select(F.when(F.col("id") % 3 > 0, F.col("id") % 60).alias("k"), F.col("id").alias("v")), "rows")
    got = attach_totals(rows, "k", F.sum("v").alias("total"))
    want = defaultdict(int)
    for r in rows.collect():
        want[r.k] += r.v
    assert sorted((r.v, r.total) for r in got.collect()) == sorted((r.v, want[r.k]) for r in rows.collect())


# --- toxicity --------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op13_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    tested = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(p and y for p, y in tested)
    assert hit >= 0.85 * sum(y for _, y in tested) and hit >= 0.95 * sum(p for p, _ in tested)


def test_toxicity_learns_from_the_labelled_part_alone(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs.where(~held_out()), labels)
    turned = labels.join(docs.select("doc_id", held_out().alias("h")), "doc_id").select("doc_id", F.when(F.col("h"), 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    again = toxicity.learn(docs.where(~held_out()), turned)
    assert model.words == again.words and (model.weights == again.weights).all()


def test_counterfactuals_free_group_names(spark):
    """Toxic texts that name one group much more often than clean ones: without the penalty its name alone is flagged."""
    rng = random.Random(2)
    filler = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = rng.choices(filler, k=12)
        if toxic and rng.random() < 0.6:
            words.append(rng.choice(["dreadful", "vermin"]))
        if rng.random() < (0.9 if toxic else 0.02):
            words.append("muslims")
        rng.shuffle(words)
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, held = (toxicity.learn(docs, labels, penalty=p) for p in (0.0, 10.0))
    neutral = "The muslims of the town waa wbb."
    assert plain.score(neutral) > 0.6 and held.score(neutral) < 0.45
    assert abs(held.score(neutral) - held.score("The women of the town waa wbb.")) < 0.1 < abs(plain.score(neutral) - plain.score("The women of the town waa wbb."))
    assert held.score("vermin dreadful waa") > 0.6


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, None), (4, 1), (None, 1), (77, 1), (6, 0), (6, 1)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, model).count() == 0
    for none in (toxicity.learn(empty, labels), toxicity.learn(odd, labels.limit(0))):
        assert none.score("anything") == 0.5 == none.score(None)
    assert toxicity.learn(odd, labels.where("toxic = 1 and doc_id = 1")).score("x") > 0.9
