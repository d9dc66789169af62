"""Queries that read whole tables leave no row out, and say what their SQL says on more than the smallest tables."""

import pytest
from oracle import assert_same, connection

from tidemark import catalogue

#: Query, the SQL of how many rows it has.
ROWS = [
    ("project_nested_children", "SELECT count(*) FROM orders"),
    ("recurring_fixed", "SELECT 4 * count(*) FROM orders"),
    ("recurring_clipped", "SELECT sum((o_orderkey % 60 + 11) // 7)::BIGINT FROM orders"),
    ("recurring_monthly_clamp", "SELECT 6 * count(*) FROM orders"),
    ("view_delta_sets", "SELECT count(DISTINCT user_id) FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)"),
    ("agg_avg", "SELECT 1"),
    ("ref_deref_set", "SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey)"),
    ("text_view_enum_order", "SELECT count(*) FROM orders WHERE o_orderpriority IN ('5-LOW', '3-MEDIUM')"),
    ("arith_int", "SELECT count(*) FROM lineitem"),
    ("decimal_div16", "SELECT count(*) FROM part"),
    ("module_union", "SELECT count(*) FROM customer"),
]


@pytest.mark.parametrize("name, rows", ROWS)
def test_no_row_is_left_out(spark, name, rows):
    d = "/root/testdata/sf0.01"
    assert catalogue.QUERIES[name](spark, d).count() == connection(d).sql(rows).fetchall()[0][0]
    assert_same(spark, d, catalogue.QUERIES[name], catalogue.ORACLE[name])
