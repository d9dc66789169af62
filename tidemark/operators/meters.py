"""Capacity: spends are funded from pools in an order, each pool as far as it reaches.

One spend a key is a prefix sum.  Several spends one after another are an
order-dependent fold, run for each enforcing row on its own.
"""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drain(pools: DataFrame, by: list[str], need: Column, available: Column, order: list[Column]) -> DataFrame:
    """``pools`` with ``take``, what the spend of each key takes from it, and ``short``, what no pool covers.

    What a pool gives is what is left of the need after all pools before it,
    from 0 up to what it has.
    """
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(available).over(before), F.lit(0))
    take = F.greatest(F.lit(0).cast("decimal(18,2)"), F.least(available, need - taken))
    whole = Window.partitionBy(*by)
    return pools.withColumn("take", take.cast("decimal(18,2)")).withColumn("short", F.greatest(F.lit(0), need - F.sum(available).over(whole)).cast("decimal(18,2)"))


def shortfalls(drained: DataFrame, by: list[str]) -> DataFrame:
    """Keys whose spend cannot be funded; a transition with any is rejected as a whole."""
    return drained.where("short > 0").select(*by, "short").distinct()


def fund(spends: DataFrame, pools: DataFrame, by: str) -> DataFrame:
    """Funds spends one after another: rows (by, spend_id, pool_id, amount, admitted).

    ``spends`` has (by, spend_id, at, amount), ``pools`` (by, pool_id, quantity,
    active_from, active_until, place): a pool serves while it is active, the
    least place first, then the id.  A spend that pools cannot cover is rejected
    and takes nothing.  Keys are folded apart from one another, many in a task
    call; one key's spends are sequential by what they mean.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        # a side without rows comes without columns
        pools_of = dict(list(right.groupby("holder"))) if len(right) else {}
        none = pd.DataFrame(columns=["place", "pool_id", "quantity"])
        out = []
        for key, mine in left.groupby(by) if len(left) else ():
            out += one(mine, pools_of.get(key, none))
        return pd.DataFrame(out, columns=[by, "spend_id", "pool_id", "amount", "admitted"])

    def one(left: pd.DataFrame, right: pd.DataFrame) -> list[tuple]:
        pool = right.sort_values(["place", "pool_id"], na_position="last").to_dict("records")
        rest = [Decimal(p["quantity"]) for p in pool]
        out = []
        for s in left.sort_values(["at", "spend_id"]).itertuples(index=False):
            need, takes = Decimal(s.amount), []
            for i, p in enumerate(pool):
                if need > 0 and rest[i] > 0 and p["active_from"] <= s.at and (pd.isna(p["active_until"]) or s.at < p["active_until"]):
                    take = min(rest[i], need)
                    takes.append((i, take))
                    need -= take
            if need > 0:
                out.append((getattr(s, by), s.spend_id, None, None, False))
                continue
            for i, take in takes:
                rest[i] -= take
                out.append((getattr(s, by), s.spend_id, pool[i]["pool_id"], take, True))
        return out

    kind = spends.schema[by].dataType.simpleString()
    spend_id, pool_id = (d.schema[c].dataType.simpleString() for d, c in ((spends, "spend_id"), (pools, "pool_id")))
    schema = f"{by} {kind}, spend_id {spend_id}, pool_id {pool_id}, amount decimal(18,2), admitted boolean"
    # a few calls for each shuffle partition: a call costs more than a small key's fold
    calls = 4 * int(spends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    call = lambda k: F.pmod(F.xxhash64(k), F.lit(calls)).alias("call")
    spends = spends.where(F.col(by).isNotNull()).select("*", call(by))
    # columns of their own: pools may be made from the spends themselves
    pools = pools.where(F.col(by).isNotNull()).select(F.col(by).alias("holder"), "pool_id", "quantity", "active_from", "active_until", "place", call(by))
    return spends.groupBy("call").cogroup(pools.groupBy("call")).applyInPandas(run, schema)


def fund_levels(spends: DataFrame, levels: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Funds spends at every ancestor level that has pools: (funding with ``level``, ids of spends that a level cannot cover).

    ``levels`` lists (key column of ``spends``, pools); a spend that one level
    rejects is rejected as a whole.
    """
    funded = [fund(spends, pools, by).select(F.lit(by).alias("level"), F.col(by).cast("string").alias("holder"), "spend_id", "pool_id", "amount", "admitted") for by, pools in levels]
    every = funded[0]
    for df in funded[1:]:
        every = every.unionByName(df)
    refused = every.where("NOT admitted").select("spend_id").distinct()
    return every.where("admitted").join(refused, "spend_id", "left_anti").drop("admitted"), refused


def held(funding: DataFrame, by: list[str]) -> DataFrame:
    """What earlier spends hold of each pool."""
    return funding.groupBy(*by, "pool_id").agg(F.sum("amount").cast("decimal(18,2)").alias("held"))


def balance(pools: DataFrame, funding: DataFrame, by: list[str], instant: Column | None = None) -> DataFrame:
    """What is left for each key, of pools active at the instant if one is given; a pool never counts below 0."""
    if instant is not None:
        pools = pools.where((F.col("active_from") <= instant) & (F.col("active_until").isNull() | (instant < F.col("active_until"))))
    left = pools.join(held(funding, by), [*by, "pool_id"], "left")
    rest = F.greatest(F.lit(0), F.col("quantity") - F.coalesce("held", F.lit(0)))
    return left.groupBy(*by).agg(F.sum(rest).cast("decimal(18,2)").alias("balance"))


def release(funding: DataFrame, spends: DataFrame) -> DataFrame:
    """Funding without that of deleted or updated spends."""
    return funding.join(spends.select("spend_id"), "spend_id", "left_anti")


def eligible(spends: DataFrame, pools: DataFrame, by: list[str], condition: Column) -> DataFrame:
    """Pools that may serve each spend: of its key, active then, and for which the condition on both holds.

    A pool reached by several sources must say the same quantity each time.
    """
    pairs = spends.alias("spend").join(pools.alias("pool"), by).where((F.col("active_from") <= F.col("at")) & (F.col("active_until").isNull() | (F.col("at") < F.col("active_until"))) & condition)
    keys = [*by, "spend_id", "pool_id"]
    agreed = pairs.groupBy(*keys).agg(F.min("quantity").alias("lo"), F.max("quantity").alias("quantity"), F.first("amount").alias("amount"), F.min("place").alias("place"))
    same = F.when(F.col("lo") == F.col("quantity"), F.col("quantity")).otherwise(F.raise_error(F.lit("sources disagree about a pool")).cast("decimal(18,2)"))
    return agreed.withColumn("quantity", same).drop("lo")


def negative_pools(pools: DataFrame) -> DataFrame:
    return pools.where("quantity < 0")
