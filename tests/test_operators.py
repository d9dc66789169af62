"""Operators on small, hand-made rows, null and repeated ones included."""

from datetime import UTC, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changes, combine, constraints, deletion, group, joins, merge, meters, migrate, placement, project, recursion, select, temporal, windows
from tidemark.operators.constraints import Rejection
from tidemark.plans.view import StaticError, collection


def c(name):
    return F.col(name)


@pytest.fixture(scope="module")
def items(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("b", None, "x"), ("c", 1, "y"), ("d", 3, None)], "id string, n int, tag string")
    return collection(df, ["id"], "items")


def ids(view):
    return [r["id"] for r in view.delivered().collect()]


def test_order_skip_and_limit(items):
    assert ids(project.sort(items, ("n", False))) == ["c", "a", "d", "b"]
    assert ids(project.sort(items, ("n", True), skip=1, limit=2)) == ["d", "a"]
    got = project.sort(items, ("n", True), skip=1, limit=2).positions().orderBy("pos").collect()
    assert [(r["id"], r["pos"]) for r in got] == [("d", 1), ("a", 2)]
    with pytest.raises(StaticError):
        project.project(items, {"id": c("id")}, limit=-1)


def test_outputs_may_not_read_in_a_circle(items):
    with pytest.raises(StaticError):
        project.project(items, {"a": lambda s: s["b"], "b": lambda s: s["a"]})
    with pytest.raises(StaticError):
        project.project(items, {"a": lambda s: s["nothing"]})


def test_keys(items):
    assert ids(select.by_keys(items, ["b", "zz", "a", "b"])) == ["b", "a", "b"]
    with pytest.raises(StaticError):
        select.by_keys(items, [("a", "b")])
    with pytest.raises(ValueError):
        select.exactly_one(select.by_keys(items, ["a", "a"]))
    assert select.non_empty(items) and not select.non_empty(select.empty(items))


def test_union_keeps_repeats_of_the_left_only(items):
    twice = select.by_keys(items, ["a", "a"])
    plain = project.project(items, {"id": c("id")})
    assert ids(combine.union(project.project(twice, {"id": c("id")}), plain)) == ["a", "a", "b", "c", "d"]
    assert ids(combine.difference(twice, select.where(items, c("id") == "b"))) == ["a", "a"]
    with pytest.raises(StaticError):
        combine.union(plain, collection(items.df.select("id"), ["id"], "others"))


def test_membership_does_not_trip_over_none(spark, items):
    some = collection(spark.createDataFrame([("a",), (None,)], "k string"), ["k"], "keys")
    assert ids(select.among(items, some, ["id"])) == ["a"]
    assert ids(select.not_among(items, some, ["id"])) == ["b", "c", "d"]


def test_group_with_none_as_key(items):
    got = group.group(items, {"tag": c("tag")}, {"n": lambda g: g.count(), "sum": lambda g: g.sum("n"), "first": lambda g: g.where(c("n") > 1).min("id")}).delivered().collect()
    assert [tuple(r) for r in got] == [("x", 2, 2, "a"), ("y", 1, 1, None), (None, 1, 3, "d")]


def test_correlated_aggregates_have_empty_results(spark, items):
    tags = collection(spark.createDataFrame([("x",), ("z",)], "t string"), ["t"], "tags")
    got = group.correlated(tags, items, {"t": "tag"}, n=lambda g: g.count(), low=lambda g: g.min("n"), all=lambda g: g.distinct("n"))
    assert [tuple(r) for r in got.delivered().collect()] == [("x", 2, 2, [2]), ("z", 0, None, [])]


def test_dangling_scalar_reference_is_an_error(spark, items):
    refs = collection(spark.createDataFrame([(1, "a"), (2, None), (3, "zz")], "k int, item string"), ["k"], "refs")
    good = select.where(refs, c("k") < 3)
    assert [r["n"] for r in joins.dereference_field(good, "item", items, "n", "n").delivered().collect()] == [2, None]
    with pytest.raises(Exception, match="exactly one"):
        joins.dereference_field(refs, "item", items, "n", "n").delivered().collect()


def test_recurrence_keeps_its_anchor(spark):
    df = spark.createDataFrame([(1, datetime(2026, 1, 31))], "id int, at timestamp")
    view = temporal.recurring_calendar(collection(df, ["id"], "s"), c("at"), 1, None, F.lit(datetime(2026, 6, 1)))
    assert [r[0].day for r in view.df.orderBy("__index").select("__from").collect()] == [31, 28, 31, 30, 31]
    with pytest.raises(Exception, match="without this day"):
        temporal.recurring_calendar(collection(df, ["id"], "s"), c("at"), 1, None, F.lit(datetime(2026, 6, 1)), "reject").df.collect()
    with pytest.raises(Exception, match="too many"):
        temporal.recurring(collection(df, ["id"], "s"), c("at"), F.lit(1), None, F.lit(datetime(2027, 1, 1))).df.collect()
    with pytest.raises(ValueError):
        temporal.between(view, datetime(2026, 2, 1), datetime(2026, 2, 1))


def test_wall_clocks_that_jump():
    back, forward = datetime(2026, 10, 25, 2, 30), datetime(2026, 3, 29, 2, 30)
    z = "Europe/Paris"
    assert temporal.zoned_boundary(back, z, ambiguous="earlier") == datetime(2026, 10, 25, 0, 30, tzinfo=UTC)
    assert temporal.zoned_boundary(back, z, ambiguous="later") == datetime(2026, 10, 25, 1, 30, tzinfo=UTC)
    assert temporal.zoned_boundary(forward, z, missing="later") > temporal.zoned_boundary(forward, z, missing="earlier")
    with pytest.raises(ValueError):
        temporal.zoned_boundary(back, z, ambiguous="reject")


def test_drain_over_pools_in_order(spark):
    pools = spark.createDataFrame([("a", 1, Decimal(30), 1), ("a", 2, Decimal(100), 2), ("a", 3, Decimal(400), 3), ("a", 4, Decimal(1000), None)], "acc string, pool int, q decimal(18,2), until int")
    out = meters.drain(pools, ["acc"], F.lit(150), c("q"), [c("until").asc_nulls_last(), c("pool")])
    assert [int(r["take"]) for r in out.orderBy("pool").collect()] == [30, 100, 20, 0]
    short = meters.shortfalls(meters.drain(pools, ["acc"], F.lit(2000), c("q"), [c("until").asc_nulls_last(), c("pool")]), ["acc"])
    assert int(short.first()["short"]) == 470


def test_spends_in_turn_up_to_the_last_unit(spark):
    t = datetime(2026, 1, 1)
    spends = spark.createDataFrame([("a", 1, t, Decimal(60)), ("a", 2, t, Decimal(50)), ("a", 3, t, Decimal(40)), ("a", 4, t, Decimal(1))], "acc string, spend_id int, at timestamp, amount decimal(18,2)")
    pools = spark.createDataFrame([("a", "p", Decimal(100), t, None, 0)], "acc string, pool_id string, quantity decimal(18,2), active_from timestamp, active_until timestamp, place int")
    out = {r["spend_id"]: r["admitted"] for r in meters.fund(spends, pools, "acc").collect()}
    assert out == {1: True, 2: False, 3: True, 4: False}
    funding = meters.fund(spends, pools, "acc").where("admitted")
    assert int(meters.balance(pools, funding, ["acc"]).first()["balance"]) == 0
    left = meters.release(funding, spends.where("spend_id = 3"))
    assert int(meters.balance(pools, left, ["acc"]).first()["balance"]) == 40


def test_coverage_prunes_and_ends_at_cycles(spark):
    df = spark.createDataFrame([("root", None, "open"), ("a", "root", "open"), ("a1", "a", "open"), ("b", "root", "closed"), ("b1", "b", "open"), ("x", "y", "open"), ("y", "x", "open")], "id string, up string, plan string")
    got = recursion.coverage(df, "id", "up", include="plan <> 'closed'").orderBy("path").collect()
    assert [r["node"] for r in got] == ["root", "a", "a1"]
    got = recursion.coverage(df, "id", "up", roots="id = 'x'").collect()
    assert sorted(r["node"] for r in got) == ["x", "y"]


def test_a_recursive_query_has_no_limit_of_rows(spark):
    spark.range(1, 500).selectExpr("id", "CASE WHEN id >= 5 THEN id DIV 5 END AS up", "id % 50 AS size").createOrReplaceTempView("many_nodes")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        out = recursion.coverage_sql(spark, "many_nodes", "id", "up", "size <> 49")
        rows = {(r["node"], r["depth"]) for r in out.collect()}
        assert out.count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert rows == {(r["node"], r["depth"]) for r in recursion.coverage(spark.table("many_nodes"), "id", "up", include="size <> 49").collect()}
    assert len(rows) > 400


def test_cascades_in_a_circle_remove_each_row_once(spark):
    lefts = spark.createDataFrame([("l1", "r1")], "id string, partner string")
    rights = spark.createDataFrame([("r1", "l1")], "id string, partner string")
    edges = deletion.references(lefts, "lefts", "id", "partner", "rights", "cascade").unionByName(deletion.references(rights, "rights", "id", "partner", "lefts", "cascade"))
    gone = deletion.doomed(spark.createDataFrame([("lefts", "l1")], "kind string, id string"), edges)
    assert sorted(tuple(r) for r in gone.collect()) == [("lefts", "l1"), ("rights", "r1")]


def test_policies_of_rows_that_stay(spark):
    sets = spark.createDataFrame([("s", ["a", "b"])], "id string, members array<string>")
    edges = deletion.references(sets, "sets", "id", "members", "items", "drop_member")
    gone = deletion.doomed(spark.createDataFrame([("items", "a")], "kind string, id string"), edges)
    assert [r["from_id"] for r in deletion.dropped_members(gone, edges).collect()] == ["a"]
    undecided = deletion.references(sets, "sets", "id", "members", "items", None)
    assert deletion.undecided(gone, undecided).count() == 1
    patches = spark.createDataFrame([("k", "1", "f", "x"), ("k", "1", "f", None), ("k", "2", "f", "x"), ("k", "2", "f", "x")], "kind string, id string, field string, value string")
    assert [r["id"] for r in deletion.patch_conflicts(patches).collect()] == ["1"]


def test_statements(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(3, "c")], "k int, v string")
    assert changes.insert(rows, new, ["k"]).count() == 3
    with pytest.raises(Rejection):
        changes.insert(rows, rows.limit(1), ["k"])
    with pytest.raises(Rejection):
        changes.insert(rows, new.unionByName(new), ["k"])
    patched = changes.patch(rows, c("v").isNull(), {"v": c("k").cast("string")})
    assert sorted(tuple(r) for r in patched.collect()) == [(1, "a"), (2, "2")]
    assert [r["op"] for r in changes.diff(rows, patched, ["k"]).collect()] == ["update"]
    assert changes.unchanged(changes.diff(rows, changes.patch(rows, F.lit(None).cast("boolean"), {"v": F.lit("x")}), ["k"]))


def test_defaults(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5, None)], "k int, a int, b int")
    out = constraints.with_defaults(df, {"b": lambda s: s["a"] + 1, "a": F.lit(1)}, {"a": c("a").isNotNull()})
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 2), (2, 5, 6)]


def test_uniqueness_leaves_none_alone(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x")], "k int, u string")
    assert [(r["u"], r["rows"]) for r in constraints.unique_violations(df, ["u"]).collect()] == [("x", 2)]


def test_merge(spark):
    schema = "k int, a string, b string"
    base = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, "a", "b"), (4, "a", "b")], schema)
    local = spark.createDataFrame([(1, "A", "b"), (2, "x", "b"), (4, "a", "b"), (5, "n", "n")], schema)
    incoming = spark.createDataFrame([(1, "a", "B"), (2, "y", "b"), (3, "a", "z"), (5, "n", "m")], schema)
    got = {r["k"]: (r["a"], r["b"]) for r in merge.merged(base, local, incoming, ["k"]).collect()}
    assert got == {1: ("A", "B"), 2: ("x", "b"), 5: ("n", "n")}
    kinds = {(r["k"], r["kind"]) for r in merge.conflicts(base, local, incoming, ["k"]).collect()}
    assert kinds == {(2, "incompatible_value"), (3, "delete_vs_modify"), (5, "competing_insert")}
    assert [merge.relation(*x) for x in ((["a"], ["a"]), (["a"], ["a", "b"]), (["a", "b"], ["a"]), (["a", "b"], ["a", "c"]), (["a"], ["z"]))] == list(merge.RELATIONS)


def test_migration(spark):
    df = spark.createDataFrame([(1, "  Ann ", "3"), (2, "Bo", "x")], "k int, name string, n string")
    out = migrate.migrated(df, {"id": "k", "name": F.trim("name")})
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, "Ann"), (2, "Bo")]
    assert [r["k"] for r in migrate.round_trip_violations(df, "name", F.trim("name"), lambda x: x).collect()] == [1]
    assert [r["k"] for r in migrate.not_representable(df, "n", "int").collect()] == [2]
    assert migrate.incompatible(df.schema, df.select("k", F.col("n").cast("int")).schema) == ["name is gone", "n was string and is int"]


def test_placement(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],), ([],)], "s array<string>")
    got = df.select(placement.satisfied({"copies": 2, "of": ["a", "b", "c"]}, c("s")), placement.satisfied({"any": ["a", "z"]}, c("s")), placement.surplus("b", c("s"))).collect()
    assert [tuple(r) for r in got] == [(True, True, ["a"]), (False, True, ["a"]), (False, False, [])]


def test_windows(spark):
    df = spark.createDataFrame([(i, None if i == 3 else 10 - i) for i in range(8)], "k int, v int")
    view = project.sort(collection(df, ["k"], "w"), ("v", False))
    order = [r["k"] for r in view.delivered().collect()]
    keys = lambda d: [r["k"] for r in d.orderBy("pos").collect()]
    assert keys(windows.first(view, 3)) == order[:3] and keys(windows.last(view, 3)) == order[-3:]
    anchor = view.df.where("k = 5").first().asDict()
    i = order.index(5)
    assert keys(windows.anchored(view, anchor, 3)) == order[i : i + 3]
    assert keys(windows.centred(view, anchor, 4)) == order[max(0, i - 2) :][:4]
    gone = view.on(view.df.where("k <> 5"))
    assert keys(windows.anchored(gone, anchor, 2)) == [k for k in order if k != 5][i : i + 2]


def test_every_level_funds_a_spend(spark):
    t = datetime(2026, 1, 1)
    spends = spark.createDataFrame([("o", "a", 1, t, Decimal(60)), ("o", "b", 2, t, Decimal(60)), ("o", "a", 3, t, Decimal(30))], "org string, acc string, spend_id int, at timestamp, amount decimal(18,2)")
    schema = "%s string, pool_id string, quantity decimal(18,2), active_from timestamp, active_until timestamp, place int"
    orgs = spark.createDataFrame([("o", "po", Decimal(100), t, None, 0)], schema % "org")
    accounts = spark.createDataFrame([("a", "pa", Decimal(70), t, None, 0), ("b", "pb", Decimal(90), t, None, 0)], schema % "acc")
    funding, refused = meters.fund_levels(spends, [("org", orgs), ("acc", accounts)])
    assert sorted(r["spend_id"] for r in refused.collect()) == [2, 3]
    assert sorted((r["level"], r["holder"], r["spend_id"]) for r in funding.collect()) == [("acc", "a", 1), ("org", "o", 1)]
    pairs = meters.eligible(spends.withColumnRenamed("acc", "k"), accounts.withColumnRenamed("acc", "k"), ["k"], F.col("quantity") > 80)
    assert [(r["k"], r["pool_id"]) for r in pairs.collect()] == [("b", "pb")]


def test_access(spark, items):
    from tidemark.operators import access

    grants = collection(spark.createDataFrame([("ann", "x"), ("bo", "y")], "account string, scope string"), ["account"], "grants")
    access.authorise(grants, "ann")
    with pytest.raises(access.Denied):
        access.authorise(grants, "cy")
    assert ids(access.visible(items, grants, "tag", "ann")) == ["a", "b"]
    assert access.closed_arguments({"a": ..., "b": 2}, {"a": 1}) == {"a": 1, "b": 2}
    for bad in ({}, {"a": 1, "z": 2}):
        with pytest.raises(TypeError):
            access.closed_arguments({"a": ..., "b": 2}, bad)


def test_views_in_different_orders_meet(items):
    down, up = project.sort(items, ("n", True), limit=2), project.sort(items, ("n", False), limit=2)
    assert ids(combine.concatenated(down, up)) == ["b", "d", "c", "a"]
