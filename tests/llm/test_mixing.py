"""Mixing: targets by hand, documents near them, reruns alike."""

from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import mixing as mx


def targets(sizes, share=1.5, most=2.0):
    """Clamp and reshare until nothing is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: mx.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, clamped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in clamped)
        w = sum(weight[s] for s in sizes if s not in clamped)
        out = {s: most * sizes[s] if s in clamped else (left * weight[s] / w if w else 0) for s in sizes}
        over = {s for s in sizes if s not in clamped and out[s] > most * sizes[s]}
        if not over:
            return out
        clamped |= over


def mixed(df):
    return [r.asDict() for r in mx.mixed(df).collect()]


def by_source(rows):
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        size[r["source"]] += r["__mix_size"]
        taken[r["source"]] += r["__mix_size"] * r["__mix_times"]
        target[r["source"]] = r["__mix_target"]
        assert 0 <= r["__mix_times"] <= 2
    return size, taken, target


def test_sources_meet_their_targets(spark):
    rows = [(k, " ".join(["w"] * (1 + k * 37 % 19)), ["big", "a", "b", "Z", None, "ä"][0 if k % 3 else k % 6]) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixed(df)
    assert len(got) == 3000
    size, taken, target = by_source(got)
    want = targets(dict(size))
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 19
    assert sorted(map(str, got)) == sorted(map(str, mixed(df.repartition(2))))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text(min_size=1, max_size=3), st.integers(0, 50), min_size=1, max_size=12))
def test_water_level_is_feasible(sizes):
    out = targets(sizes)
    assert sum(out.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(out[s] <= 2 * sizes[s] + 1e-9 for s in sizes)


def test_water_fill_is_that_of_the_loop(spark):
    sizes = {"a": 5, "b": 500, "c": 1, "d": 80, "e": 0, "f": 40}
    df = spark.createDataFrame([(s, n, float(mx.WEIGHTS[i % 3])) for i, (s, n) in enumerate(sorted(sizes.items()))], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mx.water_fill(df, 1.5 * sum(sizes.values()), 2.0).collect()}
    assert got == pytest.approx(targets(sizes))


def test_odd_rows(odd_docs, no_docs, clashing):
    got = mixed(odd_docs)
    assert len(got) == odd_docs.count()
    size, _, target = by_source(got)
    assert {s: target[s] for s in size} == pytest.approx(targets(dict(size)))
    assert [r["__mix_times"] for r in got if r["text"] is None] == [0] or size[None] > 0
    assert mixed(no_docs) == []
    out = mx.mix(clashing)
    assert out.columns == clashing.columns and out.count() == sum(r["__mix_times"] for r in got)


def test_ascii_white_space_only(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.common import word_count

    rows = [("a b\tc\nd\x0be\x0cf\rg",), ("a b c\x1cd",), ("",), (None,), ("  ",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(word_count(F.col("t"))).collect()] == [7, 1, 0, 0, 0]


@pytest.mark.parametrize("partitions", [1, 5])
def test_repeated_rows_come_near_the_target(spark, partitions):
    rows = [(7, "w " * 6, "a")] * 64 + [(k, "w " * 5, "b") for k in range(40)] + [(None, "w w", "c")] * 30 + [(3, "w " * (1 + k % 9), "d") for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(partitions)
    got = mixed(df)
    assert len(got) == len(rows)
    size, taken, target = by_source(got)
    want = targets(dict(size))
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 9, (s, taken[s], target[s])
    count = lambda x: sorted((str(r["doc_id"]), r["__mix_size"], r["__mix_times"]) for r in x)
    assert count(got) == count(mixed(df)) == count(mixed(df.repartition(3)))


def test_many_sources_are_joined_by_salted_shuffles(spark, monkeypatch):
    rows = [(k, "w " * (1 + k % 7), "abcde"[k % 50 % 5]) for k in range(400)] + [(9000, "w " * 4, "e")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, mixed(df)))
    monkeypatch.setattr(mx, "BROADCAST_SOURCES", 2)
    assert sorted(map(str, mixed(df))) == want
