"""Value semantics: none, order, numbers, texts, time."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import arith, logic, order, text, times, values


def column(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_none_is_the_greatest_value(spark):
    a, b = F.col("a"), F.col("b")
    rows = [(1, 2), (2, 2), (3, 2), (None, 2), (1, None), (None, None)]
    got = column(spark, rows, "a int, b int", lt=logic.lt(a, b), le=logic.le(a, b), gt=logic.gt(a, b), ge=logic.ge(a, b), eq=logic.eq(a, b), ne=logic.ne(a, b))
    key = lambda x: (x is None, x or 0)
    assert got == [(key(x) < key(y), key(x) <= key(y), key(x) > key(y), key(x) >= key(y), x == y, x != y) for x, y in rows]


def test_logic_has_two_values_and_stops_early(spark):
    a = F.col("a")
    rows = [(True,), (False,), (None,)]
    got = column(spark, rows, "a boolean", both=logic.all_of(a, F.lit(True)), one=logic.any_of(a, F.lit(False)), no=logic.negated(a))
    assert got == [(True, True, False), (False, False, True), (False, False, True)]
    guarded = logic.all_of(F.col("x") != 0, (F.lit(1) / F.col("x")) > 0)
    assert column(spark, [(0,), (2,)], "x int", g=guarded) == [(False,), (True,)]


def test_order_of_none(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "x int")
    assert [r[0] for r in df.orderBy(order.asc("x")).collect()] == [1, 2, None]
    assert [r[0] for r in df.orderBy(order.desc("x")).collect()] == [None, 2, 1]


def test_positions_without_a_single_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = {r["x"]: r["pos"] for r in order.positioned(df, [order.desc("x")]).collect()}
    assert got == {x: 1000 - x for x in range(1000)}
    assert order.positioned(df.where("x < 0"), [order.asc("x")]).count() == 0


JSON = st.recursive(st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=6)


def rank(x):
    """The order of JSON values, written out."""
    for i, kind in enumerate((type(None), bool, int, str, list, dict)):
        if isinstance(x, kind):
            body = {0: 0, 1: x, 2: x, 3: x if i == 3 else 0}.get(i)
            if i == 4:
                return (4, [rank(y) for y in x])
            if i == 5:
                return (5, [(k, rank(x[k])) for k in sorted(x)])
            return (i, body)


@settings(max_examples=300, deadline=None)
@given(JSON, JSON)
def test_json_keys_order_like_json_values(x, y):
    a, b = values.json_bytes(x), values.json_bytes(y)
    assert (a < b, a == b) == (rank(x) < rank(y), rank(x) == rank(y))


def test_json_order_and_text(spark):
    rows = [('{"b":1}',), ('{"a":2}',), ('{"b":0, "a":1}',), ('{"a":1.0}',)]
    df = spark.createDataFrame(rows, "o string")
    assert [r[0] for r in df.orderBy(values.json_key(F.col("o"))).select(values.json_text(F.col("o"))).collect()] == ['{"a":1}', '{"a":1,"b":0}', '{"a":2}', '{"b":1}']


def test_enum_goes_by_declaration(spark):
    df = spark.createDataFrame([("low",), ("high",), (None,), ("mid",)], "e string")
    assert [r[0] for r in df.orderBy(order.asc(order.enum_key(F.col("e"), ["high", "mid", "low"]))).collect()] == ["high", "mid", "low", None]
    with pytest.raises(Exception, match="unknown label"):
        df.select(order.enum_key(F.col("e"), ["high"])).collect()


def test_text_order_is_by_code_points(spark):
    df = spark.createDataFrame([("\U0001f600",), ("～",), ("z",)], "t string")
    assert [r[0] for r in df.orderBy("t").collect()] == ["z", "～", "\U0001f600"]


def test_integers_truncate(spark):
    a, b = F.col("a"), F.col("b")
    assert column(spark, [(-7, 2), (7, -2), (7, 2)], "a long, b long", q=arith.int_div(a, b), r=arith.rem(a, b)) == [(-3, -1), (-3, 1), (3, 1)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        column(spark, [(1, 0)], "a long, b long", q=arith.int_div(a, b))


def test_decimal_division_and_rounding(spark):
    a, b = F.col("a"), F.col("b")
    got = column(spark, [(Decimal("10"), 4), (Decimal("1"), 3), (Decimal("2"), 3)], "a decimal(18,2), b int", q=arith.decimal_text(arith.decimal_div(a, b)))
    assert got == [("2.5",), ("0.3333333333333333",), ("0.6666666666666667",)]
    x = F.col("x")
    modes = {m: arith.rounded(x, 0, m).cast("int") for m in arith.ROUNDINGS}
    assert column(spark, [(Decimal("2.5"),), (Decimal("-2.5"),)], "x decimal(10,1)", **modes) == [(3, 2, 2, 3, 2, 3), (-3, -2, -3, -2, -2, -3)]


def test_casefold_and_trim(spark):
    t = F.col("t")
    got = column(spark, [("Straße",), ("Σς",), ("  x　",), (None,)], "t string", f=text.casefold(t), w=text.trim(t))
    assert got == [("strasse", "Straße"), ("σσ", "Σς"), ("  x　", "x"), (None, None)]


def test_codecs_refuse_what_they_do_not_write(spark):
    t = F.col("t")
    df = spark.createDataFrame([("68c3a9",)], "t string")
    assert df.select(text.utf8_text(text.hex_decode(t))).first()[0] == "hé"
    for bad, f in (("abc", text.hex_decode), ("zz", text.hex_decode), ("aGk", text.base64_decode), ("aGk=\n", text.base64_decode)):
        with pytest.raises(Exception, match="not|INVALID"):
            spark.createDataFrame([(bad,)], "t string").select(f(t)).collect()
    with pytest.raises(Exception, match="UTF"):
        spark.createDataFrame([("ff",)], "t string").select(text.utf8_text(text.hex_decode(t))).collect()


def test_durations():
    assert times.duration("P1DT2H3M4.5S") == 93_784_500_000
    assert times.duration("-P2W") == -1_209_600_000_000
    for bad in ("P", "PT", "1D", "P1Y", "PT0.0000001S", "P1DT"):
        with pytest.raises(ValueError):
            times.duration(bad)


def test_rescaling_rounds_half_away_from_zero(spark):
    t = F.col("t")
    assert column(spark, [(1_500_000,), (-1_500_000,), (1_499_999,)], "t long", s=times.rescaled(t, 6, 0), n=times.rescaled(t, 6, 9)) == [(2, 1_500_000_000), (-2, -1_500_000_000), (1, 1_499_999_000)]


def test_seeded_identities_replay(spark):
    df = spark.range(50)
    one, two, other = ([r[0] for r in df.select(times.seeded_uuid(s, F.col("id"))).collect()] for s in ("a", "a", "b"))
    assert one == two and len(set(one)) == 50 and not set(one) & set(other)
