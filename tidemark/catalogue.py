"""Queries over the driver's tables, one or more for each operator, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arith, logic, order, text, times, values
from .operators import changes, combine, constraints, deletion, group, joins, merge, meters, migrate, placement, project, recursion, select, temporal, windows
from .operators.modules import ModuleSpace
from .plans.view import View, collection
from .sources import log as change_log
from .sources.scratch import materialize
from .streaming import deltas, live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, exact: str = ""):
    """Registers a query and its SQL.  ``exact`` names decimal results, shown as doubles on both sides."""

    def register(f):
        names = exact.split()

        @wraps(f)
        def run(spark, d):
            df = f(spark, d)
            return df.withColumns({n: F.col(n).cast("double") for n in names}) if names else df

        QUERIES[f.__name__] = run
        if sql:
            shown = ", ".join(f"{n}::DOUBLE AS {n}" for n in names)
            ORACLE[f.__name__] = f"SELECT * REPLACE ({shown}) FROM ({sql})" if names else sql
        return f

    return register


def table(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}


def coll(spark, d, name) -> View:
    return collection(table(spark, d, name), KEYS[name], name)


def money(x) -> F.Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(18,2)")


c = F.col

# scans and selectors


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_pass_through(spark, d):
    return coll(spark, d, "nation").rows()


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def point_select(spark, d):
    return select.by_keys(coll(spark, d, "nation"), [7]).rows().select("n_nationkey", "n_name")


@query("SELECT k.pos::BIGINT AS pos, n_nationkey, n_name FROM (VALUES (1, 3), (2, 1), (3, 3), (4, 99)) k(pos, key) JOIN nation ON n_nationkey = k.key")
def multi_key_select(spark, d):
    return select.by_keys(coll(spark, d, "nation"), [3, 1, 3, 99]).positions().select("pos", "n_nationkey", "n_name")


@query("SELECT row_number() OVER (ORDER BY p_partkey) AS pos, p_partkey, p_name FROM part WHERE p_partkey IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey < 20)")
def set_key_select(spark, d):
    refs = table(spark, d, "lineitem").where("l_orderkey < 20").agg(F.collect_set("l_partkey").alias("refs"))
    return select.by_set(coll(spark, d, "part"), refs, "refs").positions().select("pos", "p_partkey", "p_name")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey < 50 AND l_linenumber = 1")
def composite_key_select(spark, d):
    view = select.where(coll(spark, d, "lineitem"), (c("l_orderkey") < 50) & (c("l_linenumber") == 1))
    return view.rows().select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def filter_bind(spark, d):
    return select.where(coll(spark, d, "customer"), c("c_acctbal") > 5000, c("c_mktsegment") == "BUILDING").rows().select("c_custkey", "c_name")


BALANCE = "CASE WHEN c_acctbal > 0 THEN c_acctbal END"


@query(f"SELECT c_custkey FROM customer WHERE ({BALANCE}) IS NULL OR ({BALANCE}) > 9000")
def filter_optional_gt(spark, d):
    """None is greater than any number."""
    view = project.computed(coll(spark, d, "customer"), {"balance": F.expr(BALANCE)})
    return select.where(view, logic.gt(c("balance"), F.lit(9000.0))).rows().select("c_custkey")


@query(f"SELECT c_custkey FROM customer WHERE NOT coalesce(({BALANCE}) > 100, false)")
def logic_two_valued(spark, d):
    view = project.computed(coll(spark, d, "customer"), {"balance": F.expr(BALANCE)})
    return select.where(view, logic.negated(c("balance") > 100)).rows().select("c_custkey")


@query(f"SELECT count(*) AS n FROM customer WHERE ({BALANCE}) IS NOT DISTINCT FROM NULL")
def eq_none(spark, d):
    view = project.computed(coll(spark, d, "customer"), {"balance": F.expr(BALANCE)})
    return group.aggregate(select.where(view, logic.eq(c("balance"), F.lit(None).cast("double"))), n=lambda g: g.count())


@query(f"SELECT count(*) FILTER (WHERE b IS NOT NULL) AS present, count(*) FILTER (WHERE b IS NULL) AS absent FROM (SELECT {BALANCE} AS b FROM customer)")
def has_optional(spark, d):
    view = project.computed(coll(spark, d, "customer"), {"balance": F.expr(BALANCE)})
    return group.aggregate(view, present=lambda g: g.where(logic.has(c("balance"))).count(), absent=lambda g: g.where(~logic.has(c("balance"))).count())


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def in_set_filter(spark, d):
    return select.where(coll(spark, d, "orders"), logic.in_set(c("o_orderpriority"), values.set_of(F.lit("1-URGENT"), F.lit("2-HIGH")))).rows().select("o_orderkey")


@query("SELECT n_nationkey FROM nation WHERE false")
def empty_view(spark, d):
    return select.empty(coll(spark, d, "nation")).rows().select("n_nationkey")


# projection


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, net::DECIMAL(18,2) AS net, tax::DECIMAL(18,2) AS tax, (net + tax)::DECIMAL(18,2) AS gross
    FROM (SELECT *, round(net * l_tax::DECIMAL(18,2), 2)::DECIMAL(18,2) AS tax
          FROM (SELECT *, round(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)), 2)::DECIMAL(18,2) AS net FROM lineitem))""",
    exact="net tax gross",
)
def project_computed_chain(spark, d):
    outs = {
        "l_orderkey": c("l_orderkey"),
        "l_partkey": c("l_partkey"),
        "l_suppkey": c("l_suppkey"),
        "l_linenumber": c("l_linenumber"),
        "gross": lambda s: (s["net"] + s["tax"]).cast("decimal(18,2)"),
        "tax": lambda s: F.round(s["net"] * money("l_tax"), 2).cast("decimal(18,2)"),
        "net": lambda s: F.round(money("l_extendedprice") * (1 - money("l_discount")), 2).cast("decimal(18,2)"),
    }
    return project.project(coll(spark, d, "lineitem"), outs).rows()


@query(
    """SELECT o_orderkey, coalesce(string_agg(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR, ',' ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber), '') AS lines
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def project_nested_children(spark, d):
    return _children(spark, d, coll(spark, d, "orders"))


def _children(spark, d, parents: View) -> DataFrame:
    view = project.nested(parents, coll(spark, d, "lineitem"), {"o_orderkey": "l_orderkey"}, "kids", ["l_linenumber", "l_partkey"])
    line = F.transform("kids", lambda k: F.concat_ws(":", k["l_linenumber"].cast("string"), k["l_partkey"].cast("string")))
    return view.rows().select("o_orderkey", F.array_join(line, ",").alias("lines"))


@query("SELECT r_regionkey, r_name, (SELECT count(*) FROM nation) AS nations FROM region")
def root_scalar_cross(spark, d):
    root = group.aggregate(coll(spark, d, "nation"), nations=lambda g: g.count())
    regions = coll(spark, d, "region").rows().withColumn("root", F.lit(0))
    return regions.join(F.broadcast(root.withColumn("root", F.lit(0))), "root").drop("root")


@query("SELECT p_partkey, length(p_name) AS name_size, p_brand || '/' || p_type AS label FROM part")
def project_concat_size(spark, d):
    return project.project(coll(spark, d, "part"), {"p_partkey": c("p_partkey"), "name_size": text.size(c("p_name")), "label": F.concat("p_brand", F.lit("/"), "p_type")}).rows()


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size, coalesce(nullif(o_orderstatus, 'F'), 'done') AS state FROM orders")
def project_conditional(spark, d):
    return project.project(
        coll(spark, d, "orders"),
        {"o_orderkey": c("o_orderkey"), "size": F.when(logic.true(c("o_totalprice") > 200000), "large").otherwise("small"), "state": F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("done"))},
    ).rows()


# joins


@query("SELECT r_name, n_name, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey")
def traverse_two_level(spark, d):
    view = joins.traverse(coll(spark, d, "region"), coll(spark, d, "nation"), {"r_regionkey": "n_regionkey"}, "")
    return view.rows().select("r_name", "n_name", "n_nationkey")


@query("SELECT r_name, n_name, c_custkey, o_orderkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_regionkey = 1")
def traverse_four_level(spark, d):
    view = select.where(coll(spark, d, "region"), c("r_regionkey") == 1)
    for child, on in (("nation", {"r_regionkey": "n_regionkey"}), ("customer", {"n_nationkey": "c_nationkey"}), ("orders", {"c_custkey": "o_custkey"})):
        view = joins.traverse(view, coll(spark, d, child), on, "")
    return view.rows().select("r_name", "n_name", "c_custkey", "o_orderkey")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def ref_deref(spark, d):
    view = joins.dereference(coll(spark, d, "orders"), "o_custkey", coll(spark, d, "customer"), "")
    return view.rows().select("o_orderkey", "c_name")


@query("SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def ref_deref_scalar(spark, d):
    view = joins.dereference_field(coll(spark, d, "customer"), "c_nationkey", coll(spark, d, "nation"), "n_name", "nation")
    return view.rows().select("c_custkey", "nation")


@query("SELECT DISTINCT l_orderkey AS o_orderkey, p_partkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey")
def ref_deref_set(spark, d):
    return _part_sets(spark, d, table(spark, d, "lineitem"))


def _part_sets(spark, d, lines: DataFrame) -> DataFrame:
    sets = lines.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("parts"))
    view = joins.dereference_set(collection(sets, ["o_orderkey"], "carts"), "parts", coll(spark, d, "part"), "")
    return view.rows().select("o_orderkey", "p_partkey", "p_brand")


@query("SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey > n_nationkey * 10")
def theta_correlated(spark, d):
    view = joins.correlate(coll(spark, d, "nation"), coll(spark, d, "supplier"), (c("s_nationkey") == c("n_nationkey")) & (c("s_suppkey") > c("n_nationkey") * 10))
    return view.rows().select("n_nationkey", "s_suppkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_in_view(spark, d):
    large = select.where(coll(spark, d, "orders"), c("o_totalprice") > 300000)
    owners = collection(large.df.select("o_custkey"), ["o_custkey"], "customer")
    return select.among(coll(spark, d, "customer"), owners).rows().select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_not_in_view(spark, d):
    owners = collection(table(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey"), ["o_custkey"], "customer")
    return select.not_among(coll(spark, d, "customer"), owners).rows().select("c_custkey")


@query(
    """SELECT event_id, o_orderkey FROM events JOIN orders ON o_custkey = user_id
    AND o_orderdate <= ts AND (o_orderkey % 11 = 0 OR ts < o_orderdate + INTERVAL 90 DAY) WHERE event_type = 'purchase'"""
)
def asof_pool_active(spark, d):
    spends = select.where(coll(spark, d, "events"), c("event_type") == "purchase")
    pools = temporal.bucket(coll(spark, d, "orders"), c("o_orderdate"), F.when(c("o_orderkey") % 11 != 0, c("o_orderdate") + F.expr("INTERVAL 90 DAYS")))
    pools = pools.on(pools.df.withColumnsRenamed({"__from": "pool_from", "__until": "pool_until"}))
    return joins.active_at(spends, pools, c("o_custkey") == c("user_id"), c("ts").cast("timestamp"), "pool_from", "pool_until").rows().select("event_id", "o_orderkey")


# aggregation

TOTALS = "o_totalprice::DECIMAL(18,2)"


@query("SELECT count(*) AS n FROM orders")
def agg_count(spark, d):
    return group.aggregate(coll(spark, d, "orders"), n=lambda g: g.count())


@query(f"SELECT sum({TOTALS})::DECIMAL(28,2) AS total FROM orders", exact="total")
def agg_sum(spark, d):
    return group.aggregate(coll(spark, d, "orders"), total=lambda g: g.sum(money("o_totalprice")))


@query(f"SELECT round(sum({TOTALS}) / count(*), 6)::DECIMAL(18,6) AS mean FROM orders", exact="mean")
def agg_avg(spark, d):
    return _mean(coll(spark, d, "orders"))


def _mean(orders: View) -> DataFrame:
    return group.aggregate(orders, mean=lambda g: F.round(g.avg(money("o_totalprice")), 6).cast("decimal(18,6)"))


@query(f"SELECT min({TOTALS}) AS lo, max({TOTALS}) AS hi, min(o_orderpriority) AS first, max(o_orderpriority) AS last FROM orders", exact="lo hi")
def agg_min_max(spark, d):
    return group.aggregate(coll(spark, d, "orders"), lo=lambda g: g.min(money("o_totalprice")), hi=lambda g: g.max(money("o_totalprice")), first=lambda g: g.min("o_orderpriority"), last=lambda g: g.max("o_orderpriority"))


@query("SELECT string_agg(p, ',' ORDER BY p) AS priorities FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)")
def agg_distinct(spark, d):
    return group.aggregate(coll(spark, d, "orders"), priorities=lambda g: F.array_join(g.distinct("o_orderpriority"), ","))


@query("SELECT 0::BIGINT AS n, 0::DECIMAL(28,2) AS total, NULL::DECIMAL(32,16) AS mean, NULL::DECIMAL(18,2) AS lo, 0 AS kinds", exact="total mean lo")
def agg_empty_identities(spark, d):
    none = select.empty(coll(spark, d, "orders"))
    m = money("o_totalprice")
    return group.aggregate(none, n=lambda g: g.count(), total=lambda g: g.sum(m), mean=lambda g: g.avg(m), lo=lambda g: g.min(m), kinds=lambda g: F.size(g.distinct("o_orderpriority")))


@query(f"SELECT count(*) AS n, count(b) AS present, coalesce(sum(b::DECIMAL(18,2)), 0)::DECIMAL(28,2) AS total FROM (SELECT {BALANCE} AS b FROM customer)", exact="total")
def agg_skips_none(spark, d):
    view = project.computed(coll(spark, d, "customer"), {"b": F.expr(BALANCE)})
    return group.aggregate(view, n=lambda g: g.count(), present=lambda g: g.where(c("b").isNotNull()).count(), total=lambda g: g.sum(money("b")))


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(o_totalprice::DECIMAL(18,2)), 0)::DECIMAL(28,2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", exact="total")
def agg_correlated_count(spark, d):
    view = group.correlated(coll(spark, d, "customer"), coll(spark, d, "orders"), {"c_custkey": "o_custkey"}, n=lambda g: g.count(), total=lambda g: g.sum(money("o_totalprice")))
    return view.rows().select("c_custkey", "n", "total")


@query("SELECT l_returnflag, sum(l_quantity::DECIMAL(18,2))::DECIMAL(28,2) AS qty, count(*) AS n FROM lineitem GROUP BY l_returnflag", exact="qty")
def group_single_key(spark, d):
    return group.group(coll(spark, d, "lineitem"), {"l_returnflag": c("l_returnflag")}, {"qty": lambda g: g.sum(money("l_quantity")), "n": lambda g: g.count()}).rows()


@query("SELECT l_returnflag, l_linestatus, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(28,2) AS price, max(l_discount::DECIMAL(18,2)) AS discount FROM lineitem GROUP BY 1, 2", exact="price discount")
def group_composite_key(spark, d):
    return group.group(coll(spark, d, "lineitem"), {"l_returnflag": c("l_returnflag"), "l_linestatus": c("l_linestatus")}, {"price": lambda g: g.sum(money("l_extendedprice")), "discount": lambda g: g.max(money("l_discount"))}).rows()


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS large, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE o_orderpriority = '1-URGENT'), 0)::DECIMAL(28,2) AS urgent FROM orders GROUP BY 1", exact="urgent")
def group_filtered(spark, d):
    return group.group(
        coll(spark, d, "orders"),
        {"o_orderstatus": c("o_orderstatus")},
        {"n": lambda g: g.count(), "large": lambda g: g.where(c("o_totalprice") > 100000).count(), "urgent": lambda g: g.where(c("o_orderpriority") == "1-URGENT").sum(money("o_totalprice"))},
    ).rows()


@query("SELECT year, quarter, count(*) AS n FROM (SELECT year(o_orderdate)::INTEGER AS year, (year(o_orderdate) * 10 + quarter(o_orderdate))::INTEGER AS quarter FROM orders) GROUP BY 1, 2")
def group_dependent_key(spark, d):
    """A later key component reads an earlier one."""
    key = {"year": F.year("o_orderdate"), "quarter": lambda s: (s["year"] * 10 + F.quarter("o_orderdate")).cast("int")}
    return group.group(coll(spark, d, "orders"), key, {"n": lambda g: g.count()}).rows()


@query("SELECT row_number() OVER (ORDER BY total DESC, o_custkey) AS pos, o_custkey, total FROM (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(28,2) AS total FROM orders GROUP BY 1) ORDER BY 1 LIMIT 10", exact="total")
def group_sort_by_agg_limit(spark, d):
    return group.group(coll(spark, d, "orders"), {"o_custkey": c("o_custkey")}, {"total": lambda g: g.sum(money("o_totalprice"))}, sort=[("total", True)], limit=10).positions()


@query("SELECT l_returnflag, sum(l_quantity::DECIMAL(18,2))::DECIMAL(28,2) AS qty, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1 ORDER BY qty DESC, 1 LIMIT 10", exact="qty")
def flagship(spark, d):
    """``.lineitem[:l | l.l_quantity > 10] { $key: l_returnflag, qty: sum(group.l_quantity), n: count(group), $sort: [-qty], $limit: 10 }``"""
    some = select.where(coll(spark, d, "lineitem"), c("l_quantity") > 10)
    return group.group(some, {"l_returnflag": c("l_returnflag")}, {"qty": lambda g: g.sum(money("l_quantity")), "n": lambda g: g.count()}, sort=[("qty", True)], limit=10).rows()


# order and bounds

PRICE = "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END"


def _priced(spark, d):
    return project.computed(coll(spark, d, "orders"), {"price": F.expr(PRICE)})


@query(f"SELECT row_number() OVER (ORDER BY {PRICE} ASC NULLS LAST, o_orderkey) AS pos, o_orderkey FROM orders")
def sort_none_asc(spark, d):
    return project.sort(_priced(spark, d), ("price", False)).positions().select("pos", "o_orderkey")


@query(f"SELECT row_number() OVER (ORDER BY {PRICE} DESC NULLS FIRST, o_orderkey) AS pos, o_orderkey FROM orders")
def sort_none_desc(spark, d):
    return project.sort(_priced(spark, d), ("price", True)).positions().select("pos", "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY p_size, p_retailprice DESC, p_partkey) AS pos, p_partkey FROM part")
def sort_mixed_tiebreak(spark, d):
    return project.sort(coll(spark, d, "part"), ("p_size", False), ("p_retailprice", True)).positions().select("pos", "p_partkey")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 10")
def skip_limit(spark, d):
    return project.project(coll(spark, d, "part"), {"p_partkey": c("p_partkey"), "p_retailprice": c("p_retailprice")}, sort=[("p_retailprice", True)], skip=10, limit=25).rows()


@query("SELECT row_number() OVER (ORDER BY lower(p_name), p_partkey) AS pos, p_partkey FROM part")
def sort_casefold(spark, d):
    return project.sort(coll(spark, d, "part"), (text.casefold(c("p_name")), False)).positions().select("pos", "p_partkey")


LABELS = ("5-LOW", "3-MEDIUM", "1-URGENT", "4-NOT SPECIFIED", "2-HIGH")


@query("SELECT row_number() OVER (ORDER BY list_position(['5-LOW', '3-MEDIUM', '1-URGENT', '4-NOT SPECIFIED', '2-HIGH'], o_orderpriority), o_orderkey) AS pos, o_orderkey FROM orders")
def sort_enum_ordinal(spark, d):
    return project.sort(coll(spark, d, "orders"), (order.enum_key(c("o_orderpriority"), LABELS), False)).positions().select("pos", "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY (props::JSON->>'k')::BIGINT, event_id) AS pos, event_id FROM events")
def sort_json(spark, d):
    return project.sort(coll(spark, d, "events"), (values.json_key(c("props")), False)).positions().select("pos", "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def filter_project_sort_top100(spark, d):
    """The shape of the usual interactive read: filter, project, sort, top 100."""
    view = select.where(coll(spark, d, "orders"), c("o_orderstatus") == "O")
    return project.project(view, {"o_orderkey": c("o_orderkey"), "o_totalprice": c("o_totalprice")}, sort=[("o_totalprice", True)], limit=100).rows()


# set operators


def _sides(spark, d):
    customers = coll(spark, d, "customer")
    names = {"c_custkey": c("c_custkey"), "c_name": c("c_name")}
    return (project.project(select.where(customers, cond), names) for cond in (c("c_acctbal") > 3000, c("c_mktsegment") == "BUILDING"))


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY side, c_custkey) AS pos FROM (SELECT *, CASE WHEN c_acctbal > 3000 THEN 0 ELSE 1 END AS side FROM customer WHERE c_acctbal > 3000 OR c_mktsegment = 'BUILDING')")
def union_identity(spark, d):
    return combine.union(*_sides(spark, d)).positions().select("c_custkey", "c_name", "pos")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 3000 AND c_mktsegment = 'BUILDING'")
def intersect_identity(spark, d):
    return combine.intersection(*_sides(spark, d)).rows()


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 3000 AND c_mktsegment <> 'BUILDING'")
def difference_identity(spark, d):
    return combine.difference(*_sides(spark, d)).rows()


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def fallback_empty(spark, d):
    nations = coll(spark, d, "nation")
    return combine.fallback(select.where(nations, c("n_regionkey") == 77), select.where(nations, c("n_regionkey") == 2)).rows().select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def fallback_nonempty(spark, d):
    nations = coll(spark, d, "nation")
    return combine.fallback(select.where(nations, c("n_regionkey") == 1), select.where(nations, c("n_regionkey") == 2)).rows().select("n_nationkey", "n_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def conditional_view(spark, d):
    orders = coll(spark, d, "orders")
    return project.choose(F.lit(1) < F.lit(2), select.where(orders, c("o_orderstatus") == "F"), select.where(orders, c("o_orderstatus") == "O")).rows().select("o_orderkey")


# scalars


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ((l_partkey - 1000) // 7)::BIGINT AS q, ((l_partkey - 1000) % 7)::BIGINT AS r, (l_orderkey * 3 + l_linenumber - 5)::BIGINT AS s FROM lineitem")
def arith_int(spark, d):
    return _integers(coll(spark, d, "lineitem"))


def _integers(view: View) -> DataFrame:
    x = c("l_partkey") - 1000
    keys = {k: c(k) for k in KEYS["lineitem"]}
    return project.project(view, keys | {"q": arith.int_div(x, F.lit(7)), "r": arith.rem(x, F.lit(7)), "s": c("l_orderkey") * 3 + c("l_linenumber") - 5}).rows()


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_extendedprice::DECIMAL(18,2) - l_quantity::DECIMAL(18,2))::DECIMAL(19,2) AS less, (l_quantity::DECIMAL(18,2) % 7.50)::DECIMAL(18,2) AS rest FROM lineitem", exact="less rest")
def arith_decimal(spark, d):
    keys = {k: c(k) for k in KEYS["lineitem"]}
    seven = F.lit("7.50").cast("decimal(18,2)")
    return project.project(coll(spark, d, "lineitem"), keys | {"less": money("l_extendedprice") - money("l_quantity"), "rest": (money("l_quantity") % seven).cast("decimal(18,2)")}).rows()


@query(
    """SELECT p_partkey, (u // 10000000000000000)::VARCHAR || '.' || lpad((u % 10000000000000000)::VARCHAR, 16, '0') AS quotient
    FROM (SELECT p_partkey, (2 * round(p_retailprice * 100)::HUGEINT * 100000000000000 + (p_size + 1)) // (2 * (p_size + 1)::HUGEINT) AS u FROM part)"""
)
def decimal_div16(spark, d):
    """All 16 digits, as text; the SQL rounds half away from zero in whole numbers (no price is negative)."""
    q = arith.decimal_div(money("p_retailprice"), c("p_size") + 1)
    return project.project(coll(spark, d, "part"), {"p_partkey": c("p_partkey"), "quotient": q.cast("decimal(38,16)").cast("string")}).rows()


HALVES = "((p_partkey % 21 - 10) * 5)::BIGINT"


@query(
    f"""SELECT p_partkey, CASE WHEN t >= 0 THEN (t + 5) // 10 ELSE -((-t + 5) // 10) END::BIGINT AS half_up,
    (CASE WHEN abs(t) % 10 = 5 THEN (CASE WHEN (abs(t) // 10) % 2 = 0 THEN abs(t) // 10 ELSE abs(t) // 10 + 1 END) ELSE (abs(t) + 5) // 10 END * sign(t))::BIGINT AS half_even,
    floor(t / 10.0)::BIGINT AS floor, ceil(t / 10.0)::BIGINT AS ceiling, trunc(t / 10.0)::BIGINT AS toward_zero,
    (sign(t) * ceil(abs(t) / 10.0))::BIGINT AS away_from_zero FROM (SELECT p_partkey, {HALVES} AS t FROM part)"""
)
def rounding_modes(spark, d):
    tenths = (((c("p_partkey") % 21 - 10) * 5).cast("decimal(10,0)") / F.lit(10).cast("decimal(3,0)")).cast("decimal(10,1)")
    return project.project(coll(spark, d, "part"), {"p_partkey": c("p_partkey")} | {m: arith.rounded(tenths, 0, m).cast("long") for m in arith.ROUNDINGS}).rows()


@query("SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, length(c_name) AS size, trim('  ' || c_name || '  ') AS trimmed FROM customer")
def string_functions(spark, d):
    padded = F.concat(F.lit("  "), "c_name", F.lit("　 "))
    return project.project(coll(spark, d, "customer"), {"c_custkey": c("c_custkey"), "low": text.lower(c("c_name")), "up": text.upper(c("c_mktsegment")), "size": text.size(c("c_name")), "trimmed": text.trim(padded)}).rows()


@query("SELECT doc_id, lower(hex(encode(text))) AS hexed, base64(encode(text)) AS coded, sha256(text) AS digest FROM documents")
def codecs(spark, d):
    raw = text.utf8_bytes(c("text"))
    hexed, coded = text.hex_encode(raw), text.base64_encode(raw)
    view = project.project(coll(spark, d, "documents"), {"doc_id": c("doc_id"), "hexed": hexed, "coded": coded, "digest": text.digest(c("text"))})
    back = (text.utf8_text(text.hex_decode(c("hexed"))) == text.utf8_text(text.base64_decode(c("coded")))).alias("same")
    return view.rows().withColumn("same", back).where("same").drop("same")


@query("SELECT n_nationkey, replace(replace(replace(n_name || ':/%', '%', '%25'), '/', '%2F'), ':', '%3A') || ':' || n_regionkey::VARCHAR AS key FROM nation")
def key_text(spark, d):
    return project.project(coll(spark, d, "nation"), {"n_nationkey": c("n_nationkey"), "key": text.key_text(F.concat("n_name", F.lit(":/%")), c("n_regionkey"))}).rows()


@query("SELECT event_id, (epoch_us(ts) + 93784500000)::BIGINT AS later, (epoch_us(ts) - 604800000000)::BIGINT AS earlier FROM events")
def time_shift(spark, d):
    ts = c("ts").cast("timestamp")
    return project.project(coll(spark, d, "events"), {"event_id": c("event_id"), "later": F.unix_micros(times.shifted(ts, times.duration("P1DT2H3M4.5S"))), "earlier": F.unix_micros(times.shifted(ts, times.duration("-P1W")))}).rows()


@query("SELECT event_id, CASE WHEN t >= 0 THEN (t + 500000) // 1000000 ELSE -((-t + 500000) // 1000000) END::BIGINT AS seconds, (t * 1000)::VARCHAR AS nanos FROM (SELECT event_id, epoch_us(ts) AS t FROM events)")
def time_rescale(spark, d):
    t = F.unix_micros(c("ts").cast("timestamp"))
    return project.project(coll(spark, d, "events"), {"event_id": c("event_id"), "seconds": times.rescaled(t, 6, 0), "nanos": times.rescaled(t, 6, 9).cast("string")}).rows()


@query("SELECT count(*) AS rows, count(*) AS ids, count(*) AS shaped FROM orders")
def uuid_seeded(spark, d):
    ids = coll(spark, d, "orders").rows().select(times.seeded_uuid("request-1", c("o_orderkey")).alias("u"))
    return ids.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("u").alias("ids"), F.count_if(c("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("shaped"))


@query("SELECT p_partkey, rtrim(rtrim(p_retailprice::DECIMAL(18,2)::VARCHAR, '0'), '.') AS price FROM part")
def decimal_canonical_text(spark, d):
    return project.project(coll(spark, d, "part"), {"p_partkey": c("p_partkey"), "price": arith.decimal_text(money("p_retailprice"))}).rows()


@query("SELECT event_id, '{\"k\":' || (props::JSON->>'k') || '}' AS canonical FROM events")
def json_canonical(spark, d):
    return project.project(coll(spark, d, "events"), {"event_id": c("event_id"), "canonical": values.json_text(c("props"))}).rows()


@query("SELECT o_custkey, string_agg(k, ',' ORDER BY k) AS kinds FROM (SELECT DISTINCT o_custkey, o_orderpriority AS k FROM orders WHERE o_orderpriority <> '5-LOW' UNION SELECT DISTINCT o_custkey, 'new' FROM orders) GROUP BY o_custkey")
def set_add_remove(spark, d):
    sets = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("s"))
    out = values.set_remove(values.set_add(c("s"), F.array(F.lit("new"))), F.array(F.lit("5-LOW")))
    return sets.select("o_custkey", F.array_join(out, ",").alias("kinds"))


# time

DAYS = "(5 + o_orderkey % 60)"
UNTIL = f"CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + {DAYS} * INTERVAL 1 DAY END"


def _valid(spark, d):
    until = F.when(c("o_orderkey") % 11 != 0, times.shifted(c("o_orderdate").cast("timestamp"), (c("o_orderkey") % 60 + 5) * 86_400_000_000))
    return temporal.bucket(coll(spark, d, "orders"), c("o_orderdate"), until)


def instant(x: str) -> F.Column:
    return F.lit(x).cast("timestamp_ntz").cast("timestamp")


@query(f"SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND (({UNTIL}) IS NULL OR TIMESTAMP '1996-06-01' < ({UNTIL}))")
def bucket_active_at(spark, d):
    return temporal.at(_valid(spark, d), instant("1996-06-01 00:00:00")).rows().select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-07-01' AND (({UNTIL}) IS NULL OR ({UNTIL}) > TIMESTAMP '1996-06-01')")
def bucket_between(spark, d):
    return temporal.between(_valid(spark, d), instant("1996-06-01 00:00:00"), instant("1996-07-01 00:00:00")).rows().select("o_orderkey")


@query("SELECT count(*) AS n FROM orders")
def bucket_all(spark, d):
    return group.aggregate(temporal.always(_valid(spark, d)), n=lambda g: g.count())


def _micros(view: View, *fields: str) -> DataFrame:
    return view.df.select(*fields, c("__index").alias("index"), F.unix_micros("__from").alias("start"), F.unix_micros("__until").alias("until"))


@query(
    """SELECT o_orderkey, i AS index, epoch_us(o_orderdate) + i * 604800000000 AS start, epoch_us(o_orderdate) + (i + 1) * 604800000000 AS until
    FROM orders, LATERAL (SELECT unnest(range(0, 4)) AS i)"""
)
def recurring_fixed(spark, d):
    return _weeks(coll(spark, d, "orders"))


def _weeks(orders: View) -> DataFrame:
    view = temporal.recurring(orders, c("o_orderdate"), F.lit(7 * 86_400_000_000), None, times.shifted(c("o_orderdate").cast("timestamp"), 28 * 86_400_000_000))
    return _micros(view, "o_orderkey")


@query(
    f"""SELECT o_orderkey, i AS index, a + i * 604800000000 AS start, least(a + (i + 1) * 604800000000, a + days * 86400000000) AS until
    FROM (SELECT o_orderkey, epoch_us(o_orderdate) AS a, {DAYS} AS days, unnest(range(0, ((5 + o_orderkey % 60) + 6) // 7)) AS i FROM orders)"""
)
def recurring_clipped(spark, d):
    return _clipped_weeks(coll(spark, d, "orders"))


def _clipped_weeks(orders: View) -> DataFrame:
    end = times.shifted(c("o_orderdate").cast("timestamp"), (c("o_orderkey") % 60 + 5) * 86_400_000_000)
    view = temporal.recurring(orders, c("o_orderdate"), F.lit(7 * 86_400_000_000), end, instant("2100-01-01 00:00:00"))
    return _micros(view, "o_orderkey")


@query(
    """SELECT o_orderkey, i AS index, epoch_us(a + to_months(i::INTEGER)) AS start, epoch_us(a + to_months((i + 1)::INTEGER)) AS until
    FROM (SELECT o_orderkey, date_trunc('year', o_orderdate) + INTERVAL 30 DAY AS a, unnest(range(0, 12)) AS i FROM orders) WHERE a + to_months(i::INTEGER) < a + INTERVAL 180 DAY"""
)
def recurring_monthly_clamp(spark, d):
    """Only the horizon ends the series."""
    return _months(coll(spark, d, "orders"))


def _months(orders: View) -> DataFrame:
    anchor = (F.date_trunc("year", "o_orderdate") + F.expr("INTERVAL 30 DAYS")).cast("timestamp")
    view = temporal.recurring_calendar(orders, anchor, 1, None, times.shifted(anchor, 180 * 86_400_000_000))
    return _micros(view, "o_orderkey")


@query(f"SELECT count(*) AS n FROM orders WHERE ({UNTIL}) <= o_orderdate")
def reversed_interval_violations(spark, d):
    return group.aggregate(temporal.reversed_intervals(_valid(spark, d)), n=lambda g: g.count())


# bounded windows

PART_ORDER = "row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)"


def _parts(spark, d):
    return project.project(coll(spark, d, "part"), {"p_partkey": c("p_partkey"), "p_retailprice": c("p_retailprice")}, sort=[("p_retailprice", True)])


def _anchor(view: View, key: int) -> dict:
    row = view.df.where(c("p_partkey") == key).first()
    return {k: row[k] for k in ("__ord0", "__id0")} if row else {}


@query(f"SELECT * FROM (SELECT {PART_ORDER} AS pos, p_partkey FROM part) WHERE pos <= 12")
def window_first(spark, d):
    return windows.first(_parts(spark, d), 12).select("pos", "p_partkey")


@query(f"SELECT pos, p_partkey FROM (SELECT {PART_ORDER} AS pos, p_partkey, count(*) OVER () AS n FROM part) WHERE pos > n - 12")
def window_last(spark, d):
    return windows.last(_parts(spark, d), 12).select("pos", "p_partkey")


@query(f"WITH o AS (SELECT {PART_ORDER} AS pos, p_partkey FROM part) SELECT pos, p_partkey FROM o WHERE pos >= (SELECT pos FROM o WHERE p_partkey = 17) AND pos < (SELECT pos FROM o WHERE p_partkey = 17) + 9")
def window_anchor(spark, d):
    view = _parts(spark, d)
    return windows.anchored(view, _anchor(view, 17), 9).select("pos", "p_partkey")


@query(
    f"""WITH o AS (SELECT {PART_ORDER} AS pos, p_partkey, count(*) OVER () AS n FROM part),
    s AS (SELECT least(greatest(pos - 1 - 4, 0), greatest(n - 9, 0)) AS start FROM o WHERE p_partkey = 30)
    SELECT pos, p_partkey FROM o, s WHERE pos > start AND pos <= start + 9"""
)
def window_slide(spark, d):
    view = _parts(spark, d)
    return windows.centred(view, _anchor(view, 30), 9).select("pos", "p_partkey")


@query(
    """WITH a AS (SELECT p_retailprice AS price, p_partkey AS key FROM part WHERE p_partkey = 17),
    o AS (SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS pos, p_partkey, p_retailprice FROM part WHERE p_partkey <> 17),
    b AS (SELECT count(*) AS n FROM o, a WHERE p_retailprice > price OR (p_retailprice = price AND p_partkey < key))
    SELECT pos, p_partkey FROM o, b WHERE pos > n AND pos <= n + 9"""
)
def window_gap(spark, d):
    """The anchor has left the view; its place stays."""
    whole = _parts(spark, d)
    rest = whole.on(whole.df.where("p_partkey <> 17"))
    return windows.anchored(rest, _anchor(whole, 17), 9).select("pos", "p_partkey")


# capacity


def _pools(spark, d, where="true"):
    return table(spark, d, "orders").where(where).select("o_custkey", "o_orderkey", money("o_totalprice").alias("quantity"), c("o_orderdate"))


@query(
    """WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice::DECIMAL(18,2) AS q,
      coalesce(sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM orders)
    SELECT o_custkey, o_orderkey, greatest(0, least(q, 250000 - pre))::DECIMAL(18,2) AS take FROM p""",
    exact="take",
)
def meter_single_spend(spark, d):
    need = F.lit(250000).cast("decimal(18,2)")
    out = meters.drain(_pools(spark, d), ["o_custkey"], need, c("quantity"), [order.asc("o_orderdate"), order.asc("o_orderkey")])
    return out.select("o_custkey", "o_orderkey", "take")


@query("SELECT o_custkey, (250000 - sum(o_totalprice::DECIMAL(18,2)))::DECIMAL(18,2) AS short FROM orders GROUP BY 1 HAVING sum(o_totalprice::DECIMAL(18,2)) < 250000", exact="short")
def meter_shortfall(spark, d):
    need = F.lit(250000).cast("decimal(18,2)")
    out = meters.drain(_pools(spark, d), ["o_custkey"], need, c("quantity"), [order.asc("o_orderdate"), order.asc("o_orderkey")])
    return meters.shortfalls(out, ["o_custkey"])


@query(
    """WITH h AS (SELECT l_orderkey, sum(l_quantity::DECIMAL(18,2)) * 1000 AS held FROM lineitem GROUP BY 1)
    SELECT o_custkey, sum(greatest(0, o_totalprice::DECIMAL(18,2) - coalesce(held, 0)))::DECIMAL(18,2) AS balance FROM orders LEFT JOIN h ON l_orderkey = o_orderkey GROUP BY 1""",
    exact="balance",
)
def meter_balance(spark, d):
    pools = _pools(spark, d).withColumnRenamed("o_orderkey", "pool_id")
    owner = pools.select("o_custkey", "pool_id")
    funding = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("pool_id")).agg((F.sum(money("l_quantity")) * 1000).cast("decimal(18,2)").alias("amount")).join(owner, "pool_id")
    return meters.balance(pools, funding, ["o_custkey"])


@query(
    """WITH RECURSIVE s AS (
      SELECT user_id, event_id, value::DECIMAL(18,2) AS amount, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase'
    ), f AS (
      SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS event_id, 0::DECIMAL(18,2) AS amount, 100::DECIMAL(18,2) AS left_, true AS admitted FROM (SELECT DISTINCT user_id FROM s)
      UNION ALL
      SELECT s.user_id, s.k, s.event_id, s.amount, CASE WHEN s.amount <= f.left_ THEN (f.left_ - s.amount)::DECIMAL(18,2) ELSE f.left_ END, s.amount <= f.left_
      FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1
    )
    SELECT user_id, event_id AS spend_id, CASE WHEN admitted AND amount > 0 THEN amount END AS amount, admitted FROM f WHERE k > 0 AND NOT (admitted AND amount <= 0)""",
    exact="amount",
)
def meter_sequential(spark, d):
    """Spends of each user in turn, from one pool of 100."""
    spends = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", c("event_id").alias("spend_id"), c("ts").alias("at"), money("value").alias("amount"))
    pools = spends.select("user_id").distinct().select("user_id", F.lit("base").alias("pool_id"), F.lit(100).cast("decimal(18,2)").alias("quantity"), F.lit("1970-01-01").cast("timestamp_ntz").alias("active_from"), F.lit(None).cast("timestamp_ntz").alias("active_until"), F.lit(0).alias("place"))
    return meters.fund(spends, pools, "user_id").select("user_id", "spend_id", "amount", "admitted")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice < 50000")
def meter_negative_pools(spark, d):
    pools = _pools(spark, d).withColumn("quantity", c("quantity") - 50000)
    return meters.negative_pools(pools).select(c("o_custkey").alias("c_custkey"), "o_orderkey")


# recursion

TREE = "SELECT p_partkey AS id, CASE WHEN p_partkey >= 5 THEN p_partkey // 5 END AS up, p_size FROM part WHERE p_partkey > 0"


def _tree(spark, d):
    return table(spark, d, "part").where("p_partkey > 0").select(c("p_partkey").alias("id"), F.when(c("p_partkey") >= 5, F.call_function("div", c("p_partkey"), F.lit(5))).cast("long").alias("up"), "p_size")


@query(f"WITH RECURSIVE n AS ({TREE}), t AS (SELECT id, id AS root, 0 AS depth, id::VARCHAR AS path FROM n WHERE up IS NULL UNION ALL SELECT n.id, root, depth + 1, path || '/' || n.id::VARCHAR FROM t JOIN n ON n.up = t.id) SELECT id, root, depth, path FROM t")
def recursive_coverage(spark, d):
    out = recursion.coverage(_tree(spark, d), "id", "up")
    return out.select(c("node").alias("id"), "root", "depth", F.array_join("path", "/").alias("path"))


@query(f"WITH RECURSIVE n AS ({TREE}), t AS (SELECT id, 0 AS depth FROM n WHERE up IS NULL AND p_size <> 7 UNION ALL SELECT n.id, depth + 1 FROM t JOIN n ON n.up = t.id WHERE p_size <> 7) SELECT id, depth FROM t")
def recursive_prune(spark, d):
    """A node that is left out takes its subtree with it."""
    out = recursion.coverage(_tree(spark, d), "id", "up", include="p_size <> 7")
    return out.select(c("node").alias("id"), "depth")


@query(f"WITH RECURSIVE n AS ({TREE}), t AS (SELECT id, 0 AS depth FROM n WHERE up IS NULL AND p_size <> 7 UNION ALL SELECT n.id, depth + 1 FROM t JOIN n ON n.up = t.id WHERE p_size <> 7) SELECT id, depth FROM t")
def recursive_prune_sql(spark, d):
    _tree(spark, d).createOrReplaceTempView("tidemark_tree")
    out = recursion.coverage_sql(spark, "tidemark_tree", "id", "up", "p_size <> 7")
    return out.select(c("node").alias("id"), "depth")


def _edges(spark, d):
    customers = table(spark, d, "customer")
    orders = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").select(F.concat_ws(":", *KEYS["lineitem"]).alias("line"), c("l_orderkey").cast("string").alias("l_orderkey"))
    a = deletion.references(orders.select(c("o_orderkey").cast("string").alias("o_orderkey"), c("o_custkey").cast("string").alias("o_custkey")), "orders", "o_orderkey", "o_custkey", "customer", "cascade")
    b = deletion.references(lines, "lineitem", "line", "l_orderkey", "orders", "cascade")
    n = deletion.references(customers.select(c("c_custkey").cast("string").alias("c_custkey"), c("c_nationkey").cast("string").alias("c_nationkey")), "customer", "c_custkey", "c_nationkey", "nation", "restrict")
    return a.unionByName(b).unionByName(n)


@query(
    """SELECT 'customer' AS kind, c_custkey::VARCHAR AS id FROM customer WHERE c_custkey % 50 = 0
    UNION ALL SELECT 'orders', o_orderkey::VARCHAR FROM orders WHERE o_custkey % 50 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'lineitem', concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 50 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)"""
)
def cascade_closure(spark, d):
    seeds = table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.lit("customer").alias("kind"), c("c_custkey").cast("string").alias("id"))
    return deletion.doomed(seeds, _edges(spark, d)).select("kind", "id")


@query("SELECT 'customer' AS to_kind, c_custkey::VARCHAR AS to_id, n_nationkey::VARCHAR AS from_id FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey IN (3, 4)")
def restrict_violations(spark, d):
    seeds = table(spark, d, "nation").where("n_nationkey IN (3, 4)").select(F.lit("nation").alias("kind"), c("n_nationkey").cast("string").alias("id"))
    edges = _edges(spark, d)
    return deletion.restricted(deletion.doomed(seeds, edges), edges).select("to_kind", "to_id", "from_id")


@query("SELECT 'orders' AS kind, l_orderkey::VARCHAR AS id, 'o_orderstatus' AS field, count(DISTINCT l_returnflag) AS values FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1")
def patch_conflicts(spark, d):
    """Deleted lines that would set their order's status differently."""
    gone = table(spark, d, "lineitem").where("l_partkey % 3 = 0")
    patches = gone.select(F.lit("orders").alias("kind"), c("l_orderkey").cast("string").alias("id"), F.lit("o_orderstatus").alias("field"), c("l_returnflag").alias("value"))
    return deletion.patch_conflicts(patches)


# transitions


@query(
    """SELECT c_custkey, c_name, c_nationkey FROM customer
    UNION ALL SELECT s_suppkey + 10000000, s_name, s_nationkey FROM supplier"""
)
def insert_from_view(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    new = table(spark, d, "supplier").select((c("s_suppkey") + 10_000_000).alias("c_custkey"), c("s_name").alias("c_name"), c("s_nationkey").alias("c_nationkey"))
    return changes.insert(rows, new, ["c_custkey"])


@query("SELECT c_custkey, 'kept ' || c_custkey::VARCHAR AS c_name, c_acctbal::DECIMAL(18,2) AS c_acctbal FROM customer WHERE c_custkey % 2 = 0", exact="c_acctbal")
def replace_collection(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", money("c_acctbal").alias("c_acctbal"))
    new = rows.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("kept "), c("c_custkey").cast("string")).alias("c_name"))
    return changes.replace(rows, new, ["c_custkey"], keep=["c_acctbal"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'P' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_orderstatus || o_orderpriority ELSE o_orderpriority END AS o_orderpriority FROM orders")
def bulk_patch(spark, d):
    """Right sides read the row before the patch."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return changes.patch(rows, c("o_orderstatus") == "O", {"o_orderstatus": F.lit("P"), "o_orderpriority": F.concat("o_orderstatus", "o_orderpriority")})


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def delete_keys(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey")
    gone = rows.where("o_orderkey % 3 = 0").unionByName(spark.range(10**9, 10**9 + 5).select(c("id").alias("o_orderkey")))
    return changes.delete_keys(rows, gone, ["o_orderkey"])


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_nationkey + 100 ELSE c_nationkey END::INTEGER AS c_nationkey FROM customer")
def rekey_refs(spark, d):
    nations = table(spark, d, "nation")
    renamed = nations.where("n_nationkey < 5").select(c("n_nationkey").alias("old"), (c("n_nationkey") + 100).cast("int").alias("new"))
    _, followed = changes.rekey(nations, "n_nationkey", renamed, {"customer": (table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey")})
    return followed["customer"]


@query(
    """SELECT c_custkey, trim(lower(c_name)) AS c_name, coalesce(c_mktsegment, 'NONE') AS c_mktsegment, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal::DECIMAL(18,2) END, 10.00)::DECIMAL(18,2) AS credit
    FROM customer WHERE length(c_name) > 3 AND coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal::DECIMAL(18,2) END, 10.00) < 5000""",
    exact="credit",
)
def defaults_normalize_checks(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.when(c("c_acctbal") > 0, money("c_acctbal")).alias("credit"))
    rows = constraints.with_defaults(rows, {"credit": F.lit(10).cast("decimal(18,2)"), "c_mktsegment": F.lit("NONE")}, {"credit": c("credit").isNotNull(), "c_mktsegment": c("c_mktsegment").isNotNull()})
    rows = constraints.normalised(rows, {"c_name": text.trim(text.lower(c("c_name")))})
    bad = constraints.check_violations(rows, logic.all_of(F.char_length("c_name") > 3, c("credit") < 5000)).select("c_custkey")
    return changes.delete_keys(rows, bad, ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, d):
    return constraints.unique_violations(table(spark, d, "lineitem"), ["l_linenumber"], ["l_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def ref_violations(spark, d):
    some = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    return constraints.reference_violations(table(spark, d, "orders"), "o_custkey", some, "c_custkey").select("o_orderkey")


@query("SELECT count(*) AS n FROM customer WHERE c_name = ''")
def empty_key_violations(spark, d):
    return constraints.empty_keys(table(spark, d, "customer"), ["c_name"]).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 'insert' AS op, s_suppkey + 10000000 AS o_orderkey FROM supplier
    UNION ALL SELECT 'delete', o_orderkey FROM orders WHERE o_orderkey % 10 = 0
    UNION ALL SELECT 'update', o_orderkey FROM orders WHERE o_orderkey % 10 = 1"""
)
def state_diff(spark, d):
    before = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    after = before.where("o_orderkey % 10 <> 0").withColumn("o_orderstatus", F.when(c("o_orderkey") % 10 == 1, "X").otherwise(c("o_orderstatus")))
    after = after.unionByName(table(spark, d, "supplier").select((c("s_suppkey") + 10_000_000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    return changes.diff(before, after, ["o_orderkey"]).select("op", "o_orderkey")


@query("SELECT c_custkey, c_name, c_acctbal::DECIMAL(18,2) AS c_acctbal FROM customer", exact="c_acctbal")
def erase_reinsert(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", money("c_acctbal").alias("c_acctbal"))
    stubs, extract = changes.erase(rows, c("c_custkey") % 4 == 0, ["c_name", "c_acctbal"])
    return changes.reinsert(stubs, extract, ["c_custkey"], ["c_name", "c_acctbal"]).where("erased IS NULL").drop("erased")


# history


def _log(spark, d):
    """Events as operations on users: a view opens, a refund ends, all others update."""
    op = F.when(c("event_type") == "refund", "delete").otherwise("update")
    return table(spark, d, "events").select(c("event_id").alias("seq"), op.alias("op"), c("user_id").cast("string").alias("id"), F.lit(None).cast("string").alias("new_id"), money("value").alias("payload"))


SNAPSHOT = """SELECT user_id::VARCHAR AS id, event_id AS seq, value::DECIMAL(18,2) AS payload FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id <= {seq}) WHERE k = 1 AND event_type <> 'refund'"""


@query(SNAPSHOT.format(seq="(SELECT max(event_id) // 2 FROM events)"), exact="payload")
def snapshot_at_seq(spark, d):
    half = table(spark, d, "events").agg(F.expr("max(event_id) div 2")).first()[0]
    return change_log.state_at(_log(spark, d), half)


@query(SNAPSHOT.format(seq="(SELECT max(event_id) FROM events)"), exact="payload")
def snapshot_advance(spark, d):
    """A state carried on from a snapshot is that folded from the whole log."""
    last = table(spark, d, "events").agg(F.max("event_id")).first()[0]
    log = _log(spark, d)
    return change_log.advance(materialize(change_log.state_at(log, last // 2), "half"), log, last // 2, last)


@query("SELECT event_id AS seq, user_id::VARCHAR AS id FROM events WHERE event_id >= (SELECT max(event_id) - 99 FROM events)")
def change_feed(spark, d):
    last = table(spark, d, "events").agg(F.max("event_id")).first()[0]
    return change_log.changes_since(_log(spark, d), last - 99).select("seq", "id")


@query("SELECT CASE WHEN b IS NULL THEN 'insert' WHEN a IS NULL THEN 'remove' ELSE 'update' END AS op, coalesce(a, b) AS user_id FROM (SELECT user_id AS b, count(*) AS nb FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY 1) FULL JOIN (SELECT user_id AS a, count(*) AS na FROM events GROUP BY 1) ON a = b WHERE a IS NULL OR b IS NULL OR na <> nb")
def view_delta_sets(spark, d):
    """The first half of the log against all of it."""
    events = coll(spark, d, "events")
    half = events.df.agg(F.expr("max(event_id) div 2")).first()[0]

    def state(view):
        return group.group(view, {"user_id": c("user_id")}, {"n": lambda g: g.count()})

    return deltas.changed(state(select.where(events, c("event_id") <= half)), state(events)).select("op", c("id0").alias("user_id"))


def _versions(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    local = base.where("c_custkey % 13 <> 0").withColumn("c_name", F.when(c("c_custkey") % 3 == 0, F.concat("c_name", F.lit("!"))).otherwise(c("c_name")))
    incoming = base.where("c_custkey % 17 <> 0").withColumn("c_mktsegment", F.when(c("c_custkey") % 5 == 0, "X").otherwise(c("c_mktsegment")))
    incoming = incoming.withColumn("c_name", F.when(c("c_custkey") % 21 == 0, F.concat("c_name", F.lit("?"))).otherwise(c("c_name")))
    return base, local, incoming


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 13 <> 0 THEN c_name || '!' ELSE c_name END AS c_name,
    CASE WHEN c_custkey % 5 = 0 AND c_custkey % 17 <> 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment
    FROM customer WHERE NOT (c_custkey % 13 = 0) AND NOT (c_custkey % 17 = 0 AND c_custkey % 3 <> 0)"""
)
def merge_three_way(spark, d):
    return merge.merged(*_versions(spark, d), ["c_custkey"])


@query(
    """SELECT c_custkey, NULL::VARCHAR AS field, 'delete_vs_modify' AS kind FROM customer
      WHERE (c_custkey % 13 = 0 AND c_custkey % 17 <> 0 AND ((c_custkey % 5 = 0 AND c_mktsegment <> 'X') OR c_custkey % 21 = 0)) OR (c_custkey % 17 = 0 AND c_custkey % 13 <> 0 AND c_custkey % 3 = 0)
    UNION ALL SELECT c_custkey, 'c_name', 'incompatible_value' FROM customer WHERE c_custkey % 21 = 0 AND c_custkey % 13 <> 0 AND c_custkey % 17 <> 0"""
)
def merge_conflicts(spark, d):
    return merge.conflicts(*_versions(spark, d), ["c_custkey"])


@query("SELECT p_partkey AS id, p_name AS title, (round(p_retailprice::DECIMAL(18,2) * 100))::BIGINT AS cents, split_part(p_type, ' ', 1) AS family FROM part")
def migrate_rename_transform(spark, d):
    return migrate.migrated(table(spark, d, "part"), {"id": "p_partkey", "title": "p_name", "cents": F.round(money("p_retailprice") * 100).cast("long"), "family": F.split_part("p_type", F.lit(" "), F.lit(1))})


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 1")
def roundtrip_violations(spark, d):
    """Halving and doubling loses odd sizes."""
    return migrate.round_trip_violations(table(spark, d, "part"), "p_size", F.call_function("div", c("p_size"), F.lit(2)), lambda x: (x * 2).cast("int")).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE round(o_totalprice) <> o_totalprice")
def downgrade_not_representable(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return migrate.not_representable(rows, "o_totalprice", "decimal(18,0)").select("o_orderkey")


@query("SELECT 'n' || c_nationkey::VARCHAR AS instance, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey")
def module_union(spark, d):
    """One module for every row of nation."""
    return _instances(spark, d, [r[0] for r in table(spark, d, "nation").select("n_nationkey").collect()])


def _instances(spark, d, nations) -> DataFrame:
    space = ModuleSpace()
    for n in nations:
        part = select.where(coll(spark, d, "customer"), c("c_nationkey") == n)
        space.install(f"n{n}", {"customers": part})
    return space.all("customers").rows().select("instance", "c_custkey")


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') > 0 AND (count(*) FILTER (WHERE o_orderpriority = '2-HIGH') > 0 OR count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') > 0) AS ok FROM orders GROUP BY 1")
def placement_satisfied(spark, d):
    stores = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("stores"))
    policy = {"all": ["1-URGENT", {"copies": 1, "of": ["2-HIGH", "3-MEDIUM"]}]}
    return stores.select("o_custkey", placement.satisfied(policy, c("stores")).alias("ok"))


# streaming


def _stream(spark, d, name, **options):
    schema = table(spark, d, name).schema
    reader = spark.readStream.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.parquet(f"{d}/{name}.parque[t]")  # a file or a folder; without a pattern a stream takes only folders


def _scratch(spark, name) -> str:
    import uuid

    from .sources.scratch import shared_dir

    return f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}/{name}"


@query("SELECT user_id, count(*) AS n, sum(value::DECIMAL(18,2))::DECIMAL(28,2) AS total FROM events GROUP BY 1", exact="total")
def stream_delta_available_now(spark, d):
    """The stream fills a log; the view over the log is the view over the table."""
    path, ck = _scratch(spark, "log"), _scratch(spark, "checkpoint")
    live.log_stream(_stream(spark, d, "events"), path, ck)
    events = collection(spark.read.parquet(path), ["event_id"], "events")
    return group.group(events, {"user_id": c("user_id")}, {"n": lambda g: g.count(), "total": lambda g: g.sum(money("value"))}).rows()


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup_opid(spark, d):
    path, ck = _scratch(spark, "unique"), _scratch(spark, "checkpoint")
    once = live.deduplicated(_stream(spark, d, "events").withColumn("ts", c("ts").cast("timestamp")), "user_id", "ts", "10000 days")
    live.drain(once.select("user_id").writeStream.format("parquet").option("path", path).option("checkpointLocation", ck))
    return spark.read.schema("user_id long").parquet(path)


@query(
    """WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    f AS (SELECT user_id, 0::BIGINT AS k, 0::DOUBLE AS spent, 0::BIGINT AS admitted, 0::BIGINT AS rejected FROM (SELECT DISTINCT user_id FROM s)
      UNION ALL SELECT s.user_id, s.k, CASE WHEN spent + value <= 500 THEN spent + value ELSE spent END, admitted + (spent + value <= 500)::BIGINT, rejected + (spent + value > 500)::BIGINT
      FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1)
    SELECT user_id, admitted, rejected FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS last FROM f) WHERE last = 1"""
)
def stream_stateful_balance(spark, d):
    path, ck = _scratch(spark, "balances"), _scratch(spark, "checkpoint")
    source = _stream(spark, d, "events").select("user_id", c("event_id").alias("seq"), "value")
    states = live.balances(source, "user_id", "value", 500.0)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    live.drain(states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", ck))
    out = spark.read.parquet(path)
    return out.groupBy("user_id").agg(F.max_by("admitted", "batch").alias("admitted"), F.max_by("rejected", "batch").alias("rejected"))


@query("SELECT epoch_us(date_trunc('day', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    path, ck = _scratch(spark, "tumbling"), _scratch(spark, "checkpoint")
    counts = live.tumbling(_stream(spark, d, "events").withColumn("ts", c("ts").cast("timestamp")), "ts", "1 day", ["event_type"], F.count(F.lit(1)).alias("n"))

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    live.drain(counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", ck))
    last = spark.read.parquet(path)
    last = last.join(F.broadcast(last.agg(F.max("batch").alias("batch"))), "batch", "left_semi")
    return last.select(F.unix_micros("window.start").alias("start"), "event_type", "n")


# the text language over stored tables

MODEL = {
    "nation": {"$key": "n_nationkey", "n_nationkey": "int", "n_name": "text", "n_regionkey": "int"},
    "customer": {"$key": "c_custkey", "c_custkey": "int", "c_name": "text", "c_nationkey": {"$ref": "/nation"}, "c_acctbal": "decimal", "c_mktsegment": "text", "orders_count": "= count(/orders[:o | o.o_custkey == .c_custkey])"},
    "orders": {"$key": "o_orderkey", "o_orderkey": "int", "o_custkey": {"$ref": "/customer"}, "o_orderstatus": "text", "o_totalprice": "decimal", "o_orderpriority": {"$enum": list(LABELS)}},
}


def _text(spark, d, view: str, **params) -> DataFrame:
    """A view of the text language; references of stored tables are taken as sound, so nothing is validated here."""
    from datetime import UTC, datetime

    from .engine import Engine
    from .plans.model import Model

    model = Model({"$model": {**MODEL, "$public": {"v": {"$view": view, "$params": params}}}})
    frames = {(): spark.range(1).select(F.lit(1).alias("__root"))}
    for name in ("nation", "customer", "orders"):
        shape = model.find((name,))
        frames[shape.path] = table(spark, d, name).select(*[c(f.name).cast(f.dataType) for f in shape.schema()])
    return Engine(spark, model, frames, datetime(2026, 1, 1, tzinfo=UTC)).frame("v")


@query("SELECT o_orderstatus, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(28,2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY 1", exact="total")
def text_view_group(spark, d):
    return _text(spark, d, ".orders[:o | o.o_totalprice > 1000] { $key: o_orderstatus, o_orderstatus, n: count(group), total: sum(group.o_totalprice) }")


@query("SELECT o_orderkey, c_name AS name, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'")
def text_view_deref(spark, d):
    return _text(spark, d, ".orders[:o | o.o_orderstatus == 'F'] { o_orderkey, name: /customer[.o_custkey].c_name, nation: /nation[/customer[.o_custkey].c_nationkey].n_name }")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY 1")
def text_view_correlated(spark, d):
    return _text(spark, d, ".customer { c_custkey, n: count(/orders[:o | o.o_custkey == .c_custkey && o.o_totalprice > 200000]) }")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def text_view_computed_top(spark, d):
    return _text(spark, d, ".customer { c_custkey, n: orders_count, $sort: [-n], $limit: 20 }")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 OR c_mktsegment = 'BUILDING'")
def text_view_union(spark, d):
    return _text(spark, d, ".customer[:x | x.c_acctbal > 5000] { c_custkey } | .customer[:y | y.c_mktsegment == 'BUILDING'] { c_custkey }")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'")
def text_view_difference(spark, d):
    return _text(spark, d, ".customer[:x | x.c_acctbal > 5000] { c_custkey } - .customer[:y | y.c_mktsegment == 'BUILDING']")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS large FROM customer")
def text_view_has(spark, d):
    return _text(spark, d, ".customer { c_custkey, large: has(/orders[:o | o.o_custkey == .c_custkey && o.o_totalprice > 400000]) }")


@query("""SELECT c_custkey, (n - 1)::INTEGER AS place, o_orderkey FROM (
    SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders
) WHERE n <= 3""")
def text_view_nested_top(spark, d):
    """The three dearest orders of every customer, in a nested view that is sorted downwards; its places are shown as rows."""
    rows = _text(spark, d, ".customer { c_custkey, dearest: /orders[:o | o.o_custkey == .c_custkey] { o_orderkey, $sort: [-o_totalprice], $limit: 3 } }")
    return rows.select("c_custkey", F.posexplode("dearest").alias("place", "order")).select("c_custkey", "place", "order.o_orderkey")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_nationkey IN (7, 3)")
def text_view_keys(spark, d):
    return _text(spark, d, ".nation[7, 3] { n_nationkey, n_name }")


@query("SELECT o_orderkey FROM orders WHERE list_position(['5-LOW', '3-MEDIUM', '1-URGENT', '4-NOT SPECIFIED', '2-HIGH'], o_orderpriority) < 3")
def text_view_enum_order(spark, d):
    return _text(spark, d, ".orders[:o | o.o_orderpriority < '1-URGENT' || o.o_orderpriority == '3-MEDIUM'] { o_orderkey }")


@query("SELECT c_custkey, upper(c_mktsegment) || '-' || lower(c_name) AS label, (c_acctbal::DECIMAL(18,2) * 2 + 1)::DECIMAL(28,2) AS twice FROM customer", exact="twice")
def text_view_scalars(spark, d):
    return _text(spark, d, ".customer { c_custkey, label: string.upper(c_mktsegment) + '-' + string.lower(c_name), twice: c_acctbal * 2 + 1 }")


# host functions, access, stores


@query("SELECT n_nationkey, upper(n_name) || '!' AS shout FROM nation")
def host_function_call(spark, d):
    from pyspark.sql.types import StringType

    from .functions.host import Registry

    hosts = Registry()
    hosts.register("demo.shout", ["text"], StringType(), lambda s: s.str.upper() + "!")
    return project.project(coll(spark, d, "nation"), {"n_nationkey": c("n_nationkey"), "shout": hosts.call("demo.shout", [(c("n_name"), "text")])}).rows()


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def access_visible_rows(spark, d):
    from .operators import access

    grants = table(spark, d, "customer").where("c_nationkey = 3").select(c("c_custkey").alias("scope"), F.lit("ann").alias("account"))
    return access.visible(coll(spark, d, "orders"), collection(grants, ["scope"], "grants"), "o_custkey", "ann").rows().select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part")
def artifact_round_trip(spark, d):
    from .sources import tables

    path = _scratch(spark, "artifact")
    tables.write_snapshot(path, {"part": table(spark, d, "part").select("p_partkey", "p_name")}, {"seq": 1})
    return tables.read_snapshot(spark, path)[1]["part"]


@query("SELECT count(DISTINCT text) AS stored, count(*) AS described, count(DISTINCT sha256(text)) AS digests FROM documents")
def blob_store(spark, d):
    from .sources import tables

    path = _scratch(spark, "blobs")
    docs = table(spark, d, "documents").select(F.encode("text", "UTF-8").alias("content"), F.lit("text/plain").alias("media"), c("doc_id").cast("string").alias("name"))
    blobs = tables.write_blobs(docs, path, "content", "media", "name")
    stored = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("stored"))
    out = blobs.agg(F.count(F.lit(1)).alias("described"), F.count_distinct("blob.sha512").alias("digests"))
    return stored.withColumn("k", F.lit(1)).join(out.withColumn("k", F.lit(1)), "k").select("stored", "described", "digests")


@query("SELECT (user_id % 10)::BIGINT AS ring, max(event_id) AS version FROM events WHERE event_type <> 'refund' GROUP BY 1")
def key_ring_current(spark, d):
    versions = table(spark, d, "events").select((c("user_id") % 10).alias("ring"), c("event_id").alias("version"), F.when(c("event_type") == "refund", c("ts")).alias("revoked_at"))
    return placement.ring_current(versions).select("ring", "version")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def series_key_conflicts(spark, d):
    """A custom key that several intervals of a series share."""
    view = temporal.bucket(coll(spark, d, "orders"), c("o_orderdate"))
    return temporal.series_key_conflicts(view, ["o_custkey"]).df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'remove' AS op, p_partkey FROM (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10) WHERE p_partkey % 2 = 0 UNION ALL SELECT 'insert', p_partkey FROM (SELECT p_partkey FROM part WHERE p_partkey % 2 = 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 10) WHERE p_partkey NOT IN (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10)")
def watch_patches(spark, d):
    """A watch over the ten dearest parts, before and after the even ones go."""
    watch = live.Watch(lambda s: project.sort(collection(s, ["p_partkey"], "part"), ("p_retailprice", True), limit=10))
    parts = table(spark, d, "part").select("p_partkey", "p_retailprice")
    watch.advance(parts, 1)
    _, patches = watch.advance(parts.where("p_partkey % 2 = 1"), 2)
    return spark.createDataFrame([(op, i[0]) for op, i, _, _ in patches if op in ("insert", "remove")], "op string, p_partkey long")


@query("SELECT seq, id FROM (SELECT event_id AS seq, user_id::VARCHAR AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1")
def operation_dedup(spark, d):
    """The first request of every operation id runs; later ones do not."""
    new = table(spark, d, "events").select(c("user_id").cast("string").alias("operation_id"), c("event_id").alias("request_id"))
    done = spark.createDataFrame([], "operation_id string")
    return change_log.operation_seen(done, new).select(c("request_id").alias("seq"), c("operation_id").alias("id"))


@query("SELECT user_id::VARCHAR AS id, max(event_id) AS seq FROM events GROUP BY 1")
def log_rekey(spark, d):
    """Every user's log ends in a rename and another one back: the state is under the first name."""
    log = _log(spark, d).withColumn("op", F.lit("update"))
    last = log.groupBy("id").agg(F.max("seq").alias("seq"))
    moves = last.select(c("seq"), F.lit("rekey").alias("op"), c("id"), F.concat("id", F.lit("'")).alias("new_id"), F.lit(None).cast("decimal(18,2)").alias("payload"))
    back = moves.select((c("seq") + 10**9).alias("seq"), "op", c("new_id").alias("id"), c("id").alias("new_id"), "payload")
    moves = moves.withColumn("seq", c("seq") + 10**8)
    return change_log.state_at(log.unionByName(moves).unionByName(back), 10**10).select("id", (c("seq") - 10**9).alias("seq"))
