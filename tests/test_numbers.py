"""Exact decimals, declared rounding and identities of packages."""

from decimal import ROUND_CEILING, ROUND_DOWN, ROUND_FLOOR, ROUND_HALF_EVEN, ROUND_HALF_UP, ROUND_UP, Context, Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions import arith
from tidemark.plans.view import StaticError

PYTHON = {"half_up": ROUND_HALF_UP, "half_even": ROUND_HALF_EVEN, "floor": ROUND_FLOOR, "ceiling": ROUND_CEILING, "toward_zero": ROUND_DOWN, "away_from_zero": ROUND_UP}
PAIRS = [("0.00001234", "1"), ("-2", "3"), ("2", "3"), ("1", "0.00003"), ("-7.5", "2"), ("0.0000000000000001", "2"), ("0.0000000000000003", "2"), ("-0.0000000000000001", "2"), ("123456789012.34", "7"), ("1", "999999.999999"), ("5", "-32"), ("0", "-3"), ("17000000000000", "0.00000003")]


@pytest.mark.parametrize("mode", arith.ROUNDINGS)
def test_quotients_are_rounded_once(spark, mode):
    df = spark.createDataFrame([(Decimal(a), Decimal(b)) for a, b in PAIRS], "a decimal(38,16), b decimal(38,16)")
    got = [r[0] for r in df.select(arith.quotient(F.col("a"), F.col("b"), mode)).collect()]
    exact = Context(prec=80)
    assert got == [exact.divide(Decimal(a), Decimal(b)).quantize(Decimal(1).scaleb(-16), rounding=PYTHON[mode], context=exact) for a, b in PAIRS]


def test_products_are_exact_or_refused(spark):
    pairs = [("0.00001234", "1"), ("123456789.12345", "98765.4321"), ("0.00000001", "0.00000001"), ("0.0000000000000001", "123456789012"), ("-3", "0.1234567890123456")]
    df = spark.createDataFrame([(Decimal(a), Decimal(b)) for a, b in pairs], "a decimal(38,16), b decimal(38,16)")
    assert [r[0] for r in df.select(arith.product(F.col("a"), F.col("b"))).collect()] == [Context(prec=80).multiply(Decimal(a), Decimal(b)) for a, b in pairs]
    with pytest.raises(Exception, match="38 digits"):
        spark.range(1).select(arith.product(F.lit("0.123456789").cast(arith.EXACT), F.lit("0.123456789").cast(arith.EXACT))).collect()
    with pytest.raises(Exception, match="BY_ZERO"):
        spark.range(1).select(arith.quotient(F.lit(1), F.lit(0))).collect()


def sums(spark, a, b, mode=None, **more):
    package = {"$app": "sums@1.0.0", "$model": {"a": "decimal", "b": "decimal", "$mut": {}, "$public": {}}, "$data": {"a": a, "b": b}, **more}
    if mode:
        package["$semantics"] = {"decimal_division": {"rounding": mode}}
    return Engine.load(spark, package)


def test_packages_keep_every_digit(spark):
    e = sums(spark, "0.00001234", "1")
    assert [Decimal(e.query(x)) for x in (".a / .b", ".a * .b", ".a + .b", ".a - .b", ".b % .a")] == [Decimal(x) for x in ("0.00001234", "0.00001234", "1.00001234", "-0.99998766", str(Decimal(1) % Decimal("0.00001234")))]


@pytest.mark.parametrize("mode, a, b, want", [("toward_zero", "5", "3", "1.6666666666666666"), ("away_from_zero", "1", "7", "0.1428571428571429"), ("ceiling", "-5", "3", "-1.6666666666666666"), ("floor", "-1", "7", "-0.1428571428571429"), ("half_even", "0.0000000000000005", "2", "0.0000000000000002"), (None, "0.0000000000000005", "2", "0.0000000000000003")])
def test_declared_rounding_is_used(spark, mode, a, b, want):
    assert Decimal(sums(spark, a, b, mode).query(".a / .b")) == Decimal(want)


@pytest.mark.parametrize("semantics", [{"$rounding": "floor"}, {"decimal_division": {"rounding": "up"}}, {"decimal_division": {"mode": "floor"}}])
def test_unknown_semantics_are_refused(spark, semantics):
    with pytest.raises(StaticError):
        sums(spark, "1", "1", **{"$semantics": semantics})


def test_identities_differ_by_call_place_and_row(spark):
    package = {
        "$app": "notes@1.0.0",
        "$model": {
            "notes": {"$key": "id", "id": "uuid = uuid()", "other": "uuid = uuid()", "body": "text"},
            "$public": {"notes": {"$view": ".notes { id, other, body }", "$mut": {"add": ".notes + { body: @body }"}}},
        },
    }
    e = Engine.load(spark, package)
    assert [e.call("notes.add", body=x).status for x in ("one", "two")] == ["ok", "ok"]
    got = [r[k] for r in e.frame("notes").collect() for k in ("id", "other")]
    assert len(got) == len(set(got)) == 4
