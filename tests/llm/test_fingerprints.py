"""Prefix hashes against slices, and the query against a plain loop."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import fingerprints as fp

TEXT = st.text(alphabet="abé日\U0001f600 ", max_size=120)


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT, st.data())
def test_spans_and_extensions(a, b, data):
    x, y = fp.PrefixHash(fp.codes(a)), fp.PrefixHash(fp.codes(b))
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
    k = 0
    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
        k += 1
    assert x.common_extension(i, y, j) == k


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT, st.data())
def test_an_edit_keeps_the_prefix(a, b, data):
    keep = data.draw(st.integers(0, len(a)))
    code = fp.codes(a)
    changed = fp.PrefixHash(code).edited(keep, fp.codes(b), code)
    assert changed.fingerprint() == fp.PrefixHash(fp.codes(a[:keep] + b)).fingerprint()


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT)
def test_fingerprints_tell_texts_apart(a, b):
    x, y = (fp.PrefixHash(fp.codes(t)).fingerprint() for t in (a, b))
    assert (x == y) == (a == b)
    assert 0 <= fp.likeness(x, y) <= 1 and fp.likeness(x, y) == fp.likeness(y, x)
    assert fp.likeness(x, x) == 1


def test_likeness_estimates_what_is_shared():
    r = random.Random(6)
    for n in (300, 3000, 30000):
        a = "".join(r.choice("abcdefghij ") for _ in range(n))
        b = "".join(r.choice("abcdefghij ") for _ in range(n))
        for share in (0.25, 0.5, 0.9):
            k = int(n * share)
            got = fp.likeness(*(fp.PrefixHash(fp.codes(t)).fingerprint() for t in (a, a[:k] + b[k:])))
            assert abs(got - share) < 0.2
        assert fp.likeness(*(fp.PrefixHash(fp.codes(t)).fingerprint() for t in (a, b))) < 0.05


def test_ranges(spark):
    from bisect import bisect_right

    from pyspark.sql import functions as F

    for splits in ([], [5], [0, 3, 4, 9], list(range(0, 97, 7))):
        got = spark.range(-2, 100).select("id", fp.range_of(F.col("id"), splits).alias("r")).collect()
        assert all(r["r"] == bisect_right(splits, r["id"]) for r in got)


def expected(rows):
    """(id, chars, digest of the edited text) by ascending id."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fp.fingerprints(df).collect()), key=str)


def test_rows_meet_the_next(spark, odd_docs, no_docs, clashing):
    r = random.Random(9)
    rows = [(k * 3, "".join(r.choice("ab é") for _ in range(r.randint(0, 90)))) for k in range(150)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(5)
    assert got(df) == expected(rows)
    assert got(spark.createDataFrame(rows[:1], "doc_id long, text string")) == expected(rows[:1])
    odd = [(x["doc_id"], x["text"]) for x in odd_docs.collect()]
    assert got(odd_docs) == expected(odd) and got(clashing) == expected(odd)
    assert got(no_docs) == []
    one_id = spark.createDataFrame([(5, t) for t in ("abcdefgh", "abcdefgh", "zz", None)], "doc_id long, text string")
    assert got(one_id) == expected([(5, t) for t in ("abcdefgh", "abcdefgh", "zz", None)])
