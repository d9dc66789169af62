"""Nearest neighbours against all pairs in double precision."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same
from pyspark.sql import functions as F

from tidemark.llm import nearest as nn

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in good:
        if q % 20 == 0:
            scores = sorted((-nn.exact(x[None], y[None])[0], j) for j, y in good if j != q and len(y) == len(x))
            out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def got(df, k=20, **options):
    return sorted(map(tuple, nn.nearest(df, F.col("vec_id") % 20 == 0, k=k, **options).collect()))


def test_random_vectors_in_many_blocks(spark):
    r = np.random.default_rng(7)
    rows = [(k, [float(np.float32(x)) for x in r.normal(size=16)]) for k in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows, 20)
    for options in ({}, {"query_block": 7, "block": 40, "run": 3}, {"query_block": 7, "block": 40, "run": 3, "crowd": 1}, {"crowd": 0}):
        assert got(df, **options) == want


def test_many_equal_vectors(spark):
    r = random.Random(2)
    same = [1.0, 2.0, -1.0]
    rows = [(k, same if k % 3 == 0 else [r.choice([0.5, 1.0, -2.0]) for _ in range(3)]) for k in range(400)]
    want = brute(rows, 20)
    for crowd in (0, 2, 32):
        assert got(spark.createDataFrame(rows, SCHEMA), block=64, run=2, query_block=8, crowd=crowd) == want


def test_near_copies_that_codes_cannot_tell_apart(spark):
    r = np.random.default_rng(3)
    rows = [(k, [1.0 + float(np.float32(r.normal() * 1e-5)), 2.0, -1.0, float(k % 3 == 0)]) for k in range(600)]
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in rows]
    for crowd in (1, 32):
        assert got(spark.createDataFrame(rows, SCHEMA), block=100, run=2, query_block=8, crowd=crowd) == brute(rows, 20)


def test_survivors_hold_every_neighbour():
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 8)) * 10.0 ** r.integers(-3, 3, size=(300, 1))
    part = [nn.Block(np.arange(300)[i], np.arange(300)[i], *nn.quantised(x[i])) for i in np.array_split(np.arange(300), 4)]
    found = nn.Survivors(part[0], 5, 1000)
    for p in part:
        found.meet(p)
    got = {(t["asked"], t["cand"]) for t in found.table().to_pylist()}
    for q in part[0].rows:
        scores = sorted((-x[q] @ x[j], j) for j in range(300) if j != q)
        assert {(q, j) for _, j in scores[:5]} <= got
    assert len(got) < 75 * 299 / 2


def test_tiny_vectors(spark):
    rows = [(k, [5e-324 * (k + 1), 1e-310]) for k in range(25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(df) == brute(rows, 20)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]),
        (20, [0.0, 0.0]),
        (40, None),
        (60, []),
        (80, [1.0, None]),
        (100, [float("nan"), 1.0]),
        (120, [float("inf"), 1.0]),
        (140, [1.0, 2.0, 3.0]),
        (None, [5.0, 5.0]),
        (1, [3.0, 1.0]),
        (1, [3.0, 1.0]),
        (2, [-1e30, 1e30]),
        (3, [1e-30, 1e-38]),
        (0, [2.0, 2.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA + "")
    clash = df.withColumns({n: F.lit("x") for n in ("dim", "block", "query", "score", "rank", "ids", "vectors")})
    rows_out = got(df)
    assert rows_out == got(clash)
    assert {r[0] for r in rows_out} == {0}
    assert got(df.where("false")) == []


def test_fewer_candidates_than_asked_for(spark):
    rows = [(k, [float(k + 1), 1.0]) for k in range(5)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 20)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10**6))
def test_bounds_hold(d, seed):
    r = np.random.default_rng(seed)
    x, y = (r.normal(size=(6, d)) * 10.0 ** r.integers(-5, 5, size=(6, 1)) for _ in range(2))
    about, error = nn.tile(x, y)
    assert (np.abs(x @ y.T - about) <= error).all()


def test_query_is_its_sql(spark, small):
    assert_same(spark, small, nn.op8_nearest_neighbours, nn.OP8_SQL)


@pytest.mark.parametrize("v, good", [([1.0], True), ([0.0], False), ([], False), (None, False), ([1.0, None], False), ([float("nan")], False), ([-float("inf"), 1.0], False)])
def test_who_takes_part(spark, v, good):
    assert spark.createDataFrame([(1, v)], SCHEMA).select(nn.taking_part(F.col("embedding"))).first()[0] == good
