"""Near-duplicates against all pairs compared exactly."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import near_dedup as nd


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, threshold):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).add(frozenset(shingles(t)))
    nodes = sorted(sets)
    up = {i: i for i in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(i, s) for i in nodes for s in sets[i] if s]
    for a, (i, s) in enumerate(flat):
        for j, t in flat[a + 1 :]:
            if len(s & t) >= threshold * len(s | t) - 1e-9:
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return sorted(((i, len(shingles(t)), find(i) if i is not None else None) for i, t in rows), key=str)


def got(df, threshold, **options):
    return sorted(map(tuple, nd.near_components(df, threshold=threshold, **options).collect()), key=str)


def copies(r, base, n, most):
    """Copies of a text with up to ``most`` words changed."""
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_groups_of_copies(spark, threshold):
    r = random.Random(int(threshold * 100))
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for size, length, most in ((60, 80, 4), (25, 200, 8), (12, 30, 2), (3, 9, 1), (40, 150, 30)):
        rows += copies(r, " ".join(word() for _ in range(length)), size, most)
    rows += [" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(60)]
    rows += rows[:10] + [rows[3].upper()]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df, threshold) == brute(rows, threshold)


def test_a_chain_is_one_group(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join([f"x{k}_{j}" if j < 2 * k and j % 5 == 0 else w for j, w in enumerate(base)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 0.85) == brute(rows, 0.85)


def test_odd_rows(odd_docs, no_docs, clashing):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    out = got(odd_docs, 0.85)
    assert out == brute(rows, 0.85)
    assert got(no_docs, 0.85) == []
    kept = nd.deduped(clashing, threshold=0.85)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([i for i, _, c in out if i is None or i == c], key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB éÿ日\n\t,", max_size=40), max_size=8))
def test_shingles_of_a_stretch_are_those_of_each_text(texts):
    found = list(nd.shingle_sets([t.encode() for t in texts]))
    assert [len(h) for h in found] == [len(shingles(t)) for t in texts]
    alone = [next(iter(nd.shingle_sets([t.encode()]))) for t in texts]
    assert all((a == b).all() for a, b in zip(found, alone, strict=True))


def test_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    t = 192
    for n, common in ((1, 1), (3, 2), (50, 40), (400, 300), (5000, 2500)):
        agree = []
        for _ in range(20):
            both = r.integers(1, 1 << 62, common, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, r.integers(1, 1 << 62, n - common, dtype=np.uint64)])) for _ in range(2))
            agree.append((nd.sketch(a, t) == nd.sketch(b, t)).mean())
        assert abs(np.mean(agree) - common / (2 * n - common)) < 0.05


def test_every_coordinate_fills():
    for n in (1, 2, 7):
        out = nd.sketch(np.arange(1, n + 1, dtype=np.uint64), 192)
        assert (out != ~np.uint64(0)).all()


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)]
    edges = [(a, b) for a, b in edges if a != b]
    found = {x["id"]: x["component"] for x in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {i: i for e in edges for i in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(up[a], up[b])
            changed |= up[a] != m or up[b] != m
            up[a] = up[b] = m
    assert found == up


def test_rows_a_band_leave_few_pairs_out():
    for threshold in (0.5, 0.8, 0.85, 0.95):
        rows = nd.band_rows(threshold)
        assert (1 - threshold**rows) ** nd.BANDS < 1e-4
