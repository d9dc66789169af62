"""The log, snapshots, documents, deltas and streams."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import catalogue
from tidemark.operators import project
from tidemark.operators.modules import ModuleSpace
from tidemark.plans.view import collection
from tidemark.sources import log, tables
from tidemark.sources.hjson import DocumentError, read
from tidemark.streaming import deltas, live

LOG = "seq long, op string, id string, new_id string, payload string"


def test_states_fold_from_the_log(spark):
    rows = [(1, "insert", "a", None, "1"), (2, "insert", "b", None, "2"), (3, "update", "a", None, "3"), (4, "delete", "b", None, None), (5, "rekey", "a", "c", "3"), (6, "insert", "b", None, "4")]
    df = spark.createDataFrame(rows, LOG)
    state = lambda n: {r["id"]: r["payload"] for r in log.state_at(df, n).collect()}
    assert [state(n) for n in range(7)] == [{}, {"a": "1"}, {"a": "1", "b": "2"}, {"a": "3", "b": "2"}, {"a": "3"}, {"c": "3"}, {"c": "3", "b": "4"}]
    later = log.advance(log.state_at(df, 2), df, 2, 6)
    assert {r["id"]: r["payload"] for r in later.collect()} == state(6)
    assert log.corrupt(df).count() == 0 and log.gaps(df).count() == 0
    bad = df.unionByName(spark.createDataFrame([(8, "insert", "b", None, "x")], LOG))
    assert log.corrupt(bad).count() == 1 and [r["seq"] for r in log.gaps(bad).collect()] == [6]
    odd = [(7, "update", "z", None, "x"), (8, "delete", "q", None, None), (9, "rekey", "y", "w", "x"), (10, "rekey", "b", "c", "4"), (11, "update", "c", None, "5")]
    assert sorted(r["seq"] for r in log.corrupt(df.unionByName(spark.createDataFrame(odd, LOG))).collect()) == [7, 8, 9, 10]
    swap = [(7, "rekey", "b", "c", "4"), (7, "rekey", "c", "b", "3")]
    assert log.corrupt(df.unionByName(spark.createDataFrame(swap, LOG))).count() == 0


def test_positions_have_one_owner(spark, tmp_path):
    store = log.ChangeLog(spark, f"file://{tmp_path}/log", "string")
    change = spark.createDataFrame([("insert", "a", None, "1")], "op string, id string, new_id string, payload string")
    assert store.head() == 0 and store.read().count() == 0
    assert store.commit(change, 0) == 1
    with pytest.raises(RuntimeError):
        store.commit(change, 0)
    store.commit(spark.createDataFrame([("delete", "a", None, None)], "op string, id string, new_id string, payload string"), 1)
    assert store.at().count() == 0 and store.at(1).count() == 1


def test_operations_run_once(spark):
    done = spark.createDataFrame([("o1",)], "operation_id string")
    new = spark.createDataFrame([("o1", 1), ("o2", 2), ("o2", 3)], "operation_id string, request_id int")
    assert [tuple(r) for r in log.operation_seen(done, new).collect()] == [("o2", 2)]


def test_snapshots_are_verified(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    tables.write_snapshot(path, {"t": df}, {"seq": 3})
    point, got = tables.read_snapshot(spark, path)
    assert point == {"seq": 3} and got["t"].count() == 2
    df.limit(1).write.mode("append").parquet(f"{path}/t")
    with pytest.raises(ValueError):
        tables.read_snapshot(spark, path)


def test_seed_documents(spark):
    rows = tables.seed_rows(spark, '{"a": {"n": 1}, "b": {}}', "id string, n int", "id")
    assert sorted(tuple(r) for r in rows.collect()) == [("a", 1), ("b", None)]


def test_blobs_are_stored_once(spark, tmp_path):
    df = spark.createDataFrame([(b"x", "t", "1"), (b"x", "t", "2")], "content binary, media string, name string")
    path = f"file://{tmp_path}/blobs"
    assert tables.write_blobs(df, path, "content", "media", "name").count() == 2
    assert spark.read.parquet(path).count() == 1
    more = df.unionByName(spark.createDataFrame([(b"y", "t", "3")], df.schema))
    assert tables.write_blobs(more, path, "content", "media", "name").count() == 3
    assert sorted(bytes(r["content"]) for r in spark.read.parquet(path).collect()) == [b"x", b"y"]


def test_relaxed_documents():
    assert read("{ a: 1, b: [x, 'y' \"z\"] // c\n c: { d: true } }") == {"a": 1, "b": ["x", "y", "z"], "c": {"d": True}}
    assert read("a: '''\nlong\ntext\n'''\nb: null") == {"a": "long\ntext", "b": None}
    for bad in ("{ a: 1", "{ a 1 }", "{ a: 1, a: 2 }", "[1, 2"):
        with pytest.raises(DocumentError):
            read(bad)


WINDOW = st.lists(st.tuples(st.integers(0, 8), st.integers(0, 2)), max_size=8, unique_by=lambda x: x[0])


@settings(max_examples=500, deadline=None)
@given(WINDOW, WINDOW)
def test_patches_make_the_next_window(before, after):
    patches = deltas.patch(before, after)
    assert deltas.applied(before, patches) == after
    assert (not patches) == (before == after)


def test_watches_advance_together(spark):
    df = spark.createDataFrame([(k, v) for k, v in zip("abcd", [3, 1, 2, 4], strict=True)], "id string, n int")
    view = lambda state: project.sort(collection(state, ["id"], "t"), ("n", False), limit=2)
    hub = live.Hub(spark)
    hub.open("w", view)
    kind, first = hub.barrier(df, 1)["w"]
    assert kind == "init" and [r[1][0] for r in first] == ["b", "c"]
    kind, patches = hub.barrier(df.where("id <> 'b'"), 2)["w"]
    assert kind == "patch" and [p[0] for p in patches] == ["remove", "insert"]
    assert hub.barrier(df, 1)["w"][0] == "init"
    hub.watches["w"].close()
    assert hub.barrier(df, 3) == {}


def test_random_watch_matches_its_view(spark):
    r = random.Random(5)
    watch = live.Watch(lambda s: project.sort(collection(s, ["id"], "t"), ("n", True), limit=3))
    window = None
    for k in range(4):
        df = spark.createDataFrame([(i, r.randint(0, 5)) for i in range(6) if r.random() < 0.7], "id int, n int")
        kind, out = watch.advance(df, k)
        window = out if kind == "init" else deltas.applied(window, out)
        assert window == watch.window


def test_module_space(spark):
    a, b = (collection(spark.createDataFrame(rows, "id string"), ["id"], "t") for rows in ([("x",), ("y",)], [("x",)]))
    space = ModuleSpace()
    space.install("one", {"t": a})
    space.install("two", {"t": b})
    assert [tuple(r) for r in space.all("t").delivered().select("instance", "id").collect()] == [("one", "x"), ("one", "y"), ("two", "x")]
    space.rename("two", "zwei")
    space.uninstall("one")
    assert space.all("t").rows().count() == 1
    with pytest.raises(ValueError):
        space.install("zwei", {})


def test_streamed_batches_replace_themselves(spark, small, tmp_path):
    source = spark.readStream.schema(spark.read.parquet(f"{small}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(small)
    path = f"file://{tmp_path}/log"
    live.log_stream(source, path, f"file://{tmp_path}/ck")
    live.log_stream(source, path, f"file://{tmp_path}/ck")
    assert spark.read.parquet(path).count() == spark.read.parquet(f"{small}/events.parquet").count()
    assert spark.read.parquet(path).select(F.countDistinct("event_id")).first()[0] == spark.read.parquet(path).count()


def _spread(spark, tmp_path) -> list[tuple]:
    """A folder ``events.parquet`` whose files hold the events of every user out of order; (user, id, value) as they count."""
    r = random.Random(7)
    rows = [(i, r.choice([None, *range(8)]), None if i == 17 else float(r.randint(1, 60))) for i in range(900)]
    shuffled = r.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "event_id long, user_id long, value double").selectExpr("event_id", "timestamp_ntz '2024-01-01' AS ts", "user_id", "'view' AS event_type", "value")
    df.repartition(3).write.parquet(f"file://{tmp_path}/in/events.parquet")
    return [(u, i, x) for i, u, x in rows]


def test_balances_count_in_order_over_arrow_batches_and_files(spark, tmp_path):
    events = _spread(spark, tmp_path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {tuple(r) for r in catalogue.QUERIES["stream_stateful_balance"](spark, f"file://{tmp_path}/in").select("user_id", "admitted", "rejected").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(None, 0, 0)}
    for user in range(8):
        spent, admitted, rejected, own = 0.0, 0, 0, [x for u, _, x in events if u == user]
        for x in own:
            if x is not None and spent + x <= 500:
                spent, admitted = spent + x, admitted + 1
            elif x is not None:
                rejected += 1
        want.add((user, None, None) if None in own else (user, admitted, rejected))
    assert got == want


@pytest.mark.parametrize("name, counted, expected", [("stream_delta_available_now", "sum(n)", 900), ("stream_tumbling", "sum(n)", 900), ("stream_dedup_opid", "count(*)", 9)])
def test_streams_read_folders(spark, tmp_path, name, counted, expected):
    _spread(spark, tmp_path)
    assert catalogue.QUERIES[name](spark, f"file://{tmp_path}/in").selectExpr(counted).first()[0] == expected
