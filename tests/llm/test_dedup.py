"""Exact, near and passage deduplication against brute force."""
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm import exact_dedup as E
from lectern.llm import minhash as M
from lectern.llm import suffix_dedup as S
from lectern.llm.components import connected_components, joined_components
from lectern.llm.suffix_array import suffix_array


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_golomb_round_trip(n):
    v = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    assert (E.golomb_decode(E.golomb_encode(v)) == v).all()


def test_suffix_array_is_sorted():
    r = np.random.default_rng(3)
    for _ in range(400):
        t = r.integers(0, r.integers(1, 4), r.integers(0, 15), endpoint=True).tolist()
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_exact_groups(odd):
    rows = E.exact_groups(odd).collect()
    assert len(rows) == odd.count()
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert set(kept.values()) == {1}
    fox = [r for r in rows if r.group_size == 3]
    assert {r.keep_id for r in fox} == {2} and sum(r.kept for r in fox) == 1
    assert E.keep_one(odd).count() == len(kept) and E.keep_one(odd).columns == odd.columns


def test_empty_tables(empty):
    assert E.exact_groups(empty).count() == 0 and E.keep_one(empty).count() == 0
    assert M.near_duplicates(empty).count() == 0 and S.cut_repeats(empty).count() == 0


def near_brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        p = (t or "").encode().translate(M.LOWER).split()
        sets[i] = {tuple(p[k : k + words]) for k in range(len(p) - words + 1)} if len(p) >= words else ({tuple(p)} if p else set())
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = near_brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(docs, words=3, percent=85).collect()}
    assert got == want


def test_near_odd(odd):
    rows = M.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    at = {r.doc_id: r for r in rows}
    assert at[2].component_id == 1 and not at[2].kept and at[3].component_id == 1
    assert at[4].n_shingles == at[5].n_shingles == at[6].n_shingles == 0 and at[4].kept and at[7].n_shingles == 1


def test_parity_is_a_lower_bound():
    r = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 3000, 400, dtype=np.uint64) << np.uint64(20)) for _ in range(2))
        bits = sum(int(x).bit_count() for x in (M.parity(a) ^ M.parity(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def passages_brute(rows, length=50):
    first = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None and t):
        b = t.encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                hit[k : k + length] = b"\1" * length
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        out.append((i, len(b), sum(hit), len(bytes(hit).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("wide", [2000, 2])
def test_passages_against_brute_force(spark, sf, wide, monkeypatch):
    monkeypatch.setattr(S, "WIDE", wide)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = passages_brute([(r.doc_id, r.text) for r in docs.collect()])
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.cut_repeats(docs).collect())
    assert got == want


def test_passages_odd(odd):
    from lectern.llm.common import durable

    table = durable(odd, "odd")
    want = passages_brute([(r.doc_id, r.text) for r in table.collect()])
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.cut_repeats(table, keep_text=True, extra=["x"]).collect())
    assert got == want


def test_components(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_near_links_of_repeated_ids(spark, odd):
    """Each text of a repeated id keeps its links: 5 stands for two texts, 7 is near the one and 8 near the other."""
    a, b = (" ".join(f"{c}{i}" for i in range(16)) for c in "ab")
    rows = [(5, a), (5, b), (7, a + " z"), (8, b + " z"), (9, "something else altogether, long enough to have shingles"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in M.near_duplicates(docs, words=3, percent=85).collect())
    assert got == [(0, None, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True)]
    assert M.keep_one_of_near(docs, words=3, percent=85).count() == 4


def test_components_joined_in_steps(spark):
    r = np.random.default_rng(7)
    for seed in range(3):
        pairs = [(int(x), int(y)) for x, y in r.integers(0, 60, (50, 2))]
        frames = [spark.createDataFrame(p, "x long, y long") for p in (pairs[:25], pairs[25:])]
        whole = {tuple(x) for x in connected_components(frames[0].unionByName(frames[1])).collect()}
        assert {tuple(x) for x in joined_components(connected_components(frames[0]), frames[1]).collect()} == whole


def test_copies_beyond_the_broadcast_limit(spark, odd, monkeypatch):
    """With no broadcast at all the groups are the same, and texts are combined before anything is shuffled."""
    from lectern.llm import common

    rows = lambda: sorted(map(tuple, E.exact_groups(odd).drop("_row").collect()), key=repr)
    want, kept = rows(), sorted(map(tuple, E.keep_one(odd).collect()), key=repr)
    plans = []
    monkeypatch.setattr(E, "measured", lambda df, name, real=E.measured, **k: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), real(df, name, **k))[1])
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert rows() == want and sorted(map(tuple, E.keep_one(odd).collect()), key=repr) == kept
    plan = next(p for name, p in plans if name == "copies")
    exchanges = plan.splitlines()
    below = [exchanges[i + 1] for i, line in enumerate(exchanges) if "Exchange hashpartitioning" in line and "_text" in line]
    assert below and all("partial" in b or "Aggregate" in b for b in below)


def test_pairs_of_a_hot_id_are_dealt_before_they_meet(spark):
    """3,000 near copies of one text: the pairs of the smallest id are salted, and all links are found."""
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words + [f"x{i}"])) for i in range(3000)], "doc_id long, text string")
    rows = M.near_duplicates(docs).collect()
    assert {r.component_id for r in rows} == {0} and sum(r.kept for r in rows) == 1


def test_broadcasts_are_bounded_by_bytes(spark):
    from lectern.llm import common

    narrow, wide = spark.createDataFrame([], "a long"), spark.createDataFrame([], "a string, b string, c string")
    hinted = lambda df, n: "hint" in common.maybe_broadcast(df, n)._jdf.queryExecution().logical().toString().lower()
    assert hinted(narrow, 1_000_000) and not hinted(narrow, 1_000_001) and not hinted(wide, 300_000) and hinted(wide, 200_000)


def test_bucket_joins_are_not_sized_before_the_explode(spark, sf, monkeypatch):
    """Each class is in 64 tables; sized without that, one side of the join by bucket was broadcast, 1.6 GB of it on 0.5 GB of texts."""
    plans = {}

    def watch(real):
        return lambda df, name, **k: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), real(df, name, **k))[1]

    monkeypatch.setattr(M, "durable", watch(M.durable))
    monkeypatch.setattr(M, "measured", watch(M.measured))
    M.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), words=3, percent=85)
    for name in ("buckets", "open-buckets", "still-open"):
        assert "SortMergeJoin [_key" in plans[name], name
    assert "SortMergeJoin [_key" in plans["second-star"] and "SortMergeJoin [_key" in plans["pairs"]
    assert "Broadcast" not in plans["buckets"]


def test_tables_go_when_the_next_are_written(spark, tmp_path, monkeypatch):
    """The tables that passages and near copies are found by don't stay on disk until the job's end."""
    from lectern.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda s: str(tmp_path))
    left = lambda: sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    rows = [(i, f"{i} " + " ".join(f"w{(i // 3) * 40 + k}" for k in range(40))) for i in range(60)]
    docs = common.durable(spark.createDataFrame(rows, "doc_id long, text string"), "input")
    cut, near, one = S.cut_repeats(docs), M.keep_one_of_near(docs), E.keep_one(docs)
    assert left() == ["lectern-copies", "lectern-cuts", "lectern-dropped", "lectern-input", "lectern-near-dropped"]
    assert sum(r.n_removed > 0 for r in cut.collect()) == 40 and near.count() == 20 and one.count() == 60
    found = M.near_duplicates(docs)
    assert not {"lectern-sets", "lectern-buckets", "lectern-able"} & set(left()) and found.where("kept").count() == 20
    with common.passing(spark, "b"):
        with common.passing(spark, "a"):
            a = common.durable(docs, "a")
        b = common.durable(a.groupBy("doc_id").count(), "b")
        assert "lectern-a" in left()
    assert "lectern-a" not in left() and b.count() == 60
