"""Line dedup against a plain loop, and what bitmaps hold."""

import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import line_dedup as ld


def brute(rows, min_chars=40, min_docs=5):
    """(lines, dropped, kept text) of each (id, text)."""
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(strip))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    order = lambda i: (i is not None, i or 0)
    shared = {k: max(v, key=order) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if shared.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def digests(df):
    from pyspark.sql import functions as F

    out = ld.with_bitmaps(df.select("doc_id", "text")).mapInArrow(ld._digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    return sorted(map(tuple, out.orderBy(F.col("doc_id")).collect()), key=str)


def hashed(rows):
    return sorted(((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in rows), key=str)


def test_random_documents(spark):
    r = random.Random(3)
    pool = [f"Shared line {k} " + "abc é日 " * 6 for k in range(12)] + ["short", "", "x" * 39, "y" * 40, "é" * 39, "é" * 40]
    vary = lambda x: r.choice(["", " ", "\t"]) + r.choice([x, x.upper() if x.isascii() else x, x.lower()]) + r.choice(["", "\r", " \x0b"])
    rows = [(k, "\n".join(vary(r.choice(pool)) for _ in range(r.randint(0, 9)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert digests(df) == hashed(brute(rows))


def test_one_line_in_every_document(spark):
    line = "the same long line stands in every single document"
    rows = [(k, f"{line}\nown {k}\n{line}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert digests(df) == hashed(brute(rows))


def test_odd_rows(odd_docs, no_docs, clashing):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert digests(odd_docs) == hashed(brute(rows))
    assert digests(no_docs) == []
    out = ld.deduped(clashing, length_col="n_chars")
    assert out.columns == clashing.columns and out.count() == clashing.count()
    assert ld.deduped(no_docs).count() == 0


def test_kept_text_and_length(spark):
    line = "a line of more than forty characters that repeats"
    df = spark.createDataFrame([(k, f"{line}\nrest {k}", 99) for k in range(6)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in ld.deduped(df, length_col="n_chars").collect()}
    assert got[5] == (f"{line}\nrest 5", 99)
    assert got[0] == ("rest 0", 6)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.integers(0, n - 1)))))
def test_bitmaps_round_trip(case):
    n, dropped = case
    keep = ld.unpack_bitmap(ld.pack_bitmap(n, sorted(dropped)), n)
    assert {i for i in range(n) if not keep[i]} == dropped
