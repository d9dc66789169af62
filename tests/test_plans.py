"""Plans: what reaches the scan, what is shuffled, what stays in the JVM."""

import pytest
from pyspark.sql import functions as F

from tidemark import catalogue
from tidemark.operators import project, select
from tidemark.plans.language import parse
from tidemark.plans.view import StaticError


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, small):
    view = select.where(catalogue.coll(spark, small, "orders"), F.col("o_totalprice") > 1000)
    p = plan(project.project(view, {"o_orderkey": F.col("o_orderkey")}).rows())
    assert "GreaterThan(o_totalprice,1000.0)" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p


def test_the_text_language_reaches_the_scan_too(spark, small):
    from tidemark.engine import Engine

    model = {"orders": {"$key": "o_orderkey", "o_orderkey": "int", "o_totalprice": "int"}, "$public": {"v": {"$view": ".orders[:o | o.o_orderkey > 5 && o.o_totalprice < 9] { o_orderkey }"}}}
    orders = spark.read.parquet(f"{small}/orders.parquet")
    p = plan(Engine.load(spark, {"$model": model}, tables={"orders": orders.withColumn("o_totalprice", F.col("o_orderkey"))}).frame("v"))
    assert "GreaterThan(o_orderkey,5)" in p and "LessThan(o_orderkey,9)" in p


def test_top_k_is_no_full_sort(spark, small):
    assert "TakeOrderedAndProject" in plan(catalogue.filter_project_sort_top100(spark, small))


def test_grouping_is_partial_first(spark, small):
    p = plan(catalogue.QUERIES["group_single_key"](spark, small))
    assert p.count("HashAggregate") >= 2 and "partial_sum" in p


def test_scans_need_no_python_and_no_exchange(spark, small):
    p = plan(catalogue.QUERIES["filter_bind"](spark, small))
    assert "Python" not in p and "Exchange" not in p


@pytest.mark.parametrize("text", ["a ? b", ".x[", "1 +", "(.x", ".a | .b & .c", "'open", ".x {a b}", "a.b.c)"])
def test_texts_that_do_not_parse(text):
    with pytest.raises(StaticError):
        parse(text)


def test_precedence():
    def bare(n):
        """Without the parentheses, which the parser keeps."""
        return bare(n[0]) if n.op == "group" else (n.op, *[bare(a) if hasattr(a, "op") else a for a in n.args])

    assert bare(parse("a + b * c == d && e || f")) == bare(parse("(((a + (b * c)) == d) && e) || f")) != bare(parse("a + b * (c == d) && e || f"))
    n = parse("a + b * c")
    assert (n[0], n[2][0]) == ("+", "*")
    n = parse("a ?? b || c")
    assert n[0] == "??" and n[2][0] == "||"
    assert parse("x ? a : b | c").op == "if"
