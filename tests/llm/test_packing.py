"""Packing: ids as the library gives them, nothing lost, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing as pk

LIBRARY = Tokenizer.from_file(pk.default_tokenizer())
TOKENS = pk.WordTokens(pk.default_tokenizer(), cache=500)


def library_ids(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids, "<u4")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=50) | st.text(alphabet="aZé İß'’….,!?\n\t\x0b\x1ć ‍中12<|>endoftext", max_size=80) | st.sampled_from(["<|endoftext|>", "a<|ENDOFTEXT|>b", "it's 's don'T", "x.. y., z.", "İ.", "ﬁ."]), min_size=1, max_size=5))
def test_ids_are_the_librarys(texts):
    assert TOKENS(pa.array(texts, pa.string())) == [library_ids(t).tobytes() for t in texts]


def plain_first_fit(lengths, capacity):
    bins, out = [], []
    for n in lengths:
        k = next((i for i, used in enumerate(bins) if used + n <= capacity), len(bins))
        if k == len(bins):
            bins.append(0)
        out.append((k, bins[k]))
        bins[k] += n
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_tournament_tree_is_first_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, offsets = pk.first_fit_decreasing(np.array(lengths, np.int64), 64)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == plain_first_fit(lengths, 64)


def check(rows, docs, capacity):
    """``docs`` lists texts by id; repeated ids may interchange equal texts."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, texts in docs.items():
        want = []
        for t in texts:
            ids = np.append(library_ids(t), np.uint32(pk.END_ID)).astype("<u4")
            want += [(s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes()), len(ids)) for s in range(0, len(ids), capacity)]
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[i]) == sorted(want)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return by_sequence


def test_odd_rows(odd_docs, no_docs, clashing):
    docs = defaultdict(list)
    for r in odd_docs.collect():
        docs[r["doc_id"]].append(r["text"])
    check(pk.packed(odd_docs).collect(), docs, pk.CAPACITY)
    check(pk.packed(clashing, capacity=256).collect(), docs, 256)
    assert pk.packed(no_docs).count() == 0


def test_query(spark, small):
    rows = pk.op9_packing(spark, small).collect()
    docs = {r["doc_id"]: [r["text"]] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sequences = check(rows, docs, pk.CAPACITY)
    again = pk.op9_packing(spark, small).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    fill = [sum(r["length"] for r in p) for p in sequences.values()]
    padding = sum(0 if n & (n - 1) == 0 else pk.CAPACITY - n for n in fill)
    assert padding < 0.02 * sum(fill)


def test_groups_are_packed_apart(spark):
    df = spark.createDataFrame([(k, "word " * (k % 50)) for k in range(400)], "doc_id long, text string")
    rows = pk.packed(df, capacity=64, group=40).collect()
    assert len({r["sequence_id"] >> 24 for r in rows}) > 5
    check(rows, {k: ["word " * (k % 50)] for k in range(400)}, 64)


def test_stretches_keep_all_texts_in_order():
    from tidemark.llm.common import slices, stretches

    texts = [b"a" * n for n in (0, 5, 30, 2, 3, 100, 1)] + [None]
    parts = list(stretches(texts, 10))
    assert [t for p in parts for t in p] == texts
    assert all(len(p) == 1 or sum(len(t or b"") for t in p) <= 10 for p in parts)
    assert list(stretches([])) == []
    array = pa.array([None if t is None else t.decode() for t in texts], pa.string())
    assert [[None if t is None else t.encode() for t in p.to_pylist()] for p in slices(array, 10)] == parts
    assert list(slices(pa.array([], pa.string()))) == []
    assert TOKENS(pa.array([None, "", " \t", "a"], pa.string()).slice(1)) == [b"", b"", library_ids("a").tobytes()]


def test_repeated_rows_are_dealt_to_many_groups(spark):
    df = spark.createDataFrame([(1, "word " * 20)] * 600, "doc_id long, text string").repartition(3)
    rows = pk.packed(df, capacity=64, group=40).collect()
    groups = [r["sequence_id"] >> 24 for r in rows]
    assert len(set(groups)) > 10 and max(map(groups.count, set(groups))) < 100
    assert sum(r["length"] for r in rows) == 600 * 21
