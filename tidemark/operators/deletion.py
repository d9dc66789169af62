"""Planning a deletion: what goes with it, what forbids it, what is changed instead.

``edges`` holds a row for each reference: (from_kind, from_id) is referred to
by (to_kind, to_id), with the reference's policy: restrict, cascade, clear,
patch or drop_member.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recursion import closure

POLICIES = ("restrict", "cascade", "clear", "patch", "drop_member")


def references(referring: DataFrame, kind: str, key: str, ref: str, target: str, policy: str | None) -> DataFrame:
    """Edges of one reference field, of single references or sets of them."""
    many = referring.schema[ref].dataType.typeName() == "array"
    to = F.explode(F.col(ref)) if many else F.col(ref)
    df = referring.select(F.lit(target).alias("from_kind"), to.alias("from_id"), F.lit(kind).alias("to_kind"), F.col(key).alias("to_id"))
    return df.where(F.col("from_id").isNotNull()).withColumns({"policy": F.lit(policy), "field": F.lit(ref)})


def doomed(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows that go: the seeds and all that cascades from them; cycles end."""
    return closure(seeds, edges.where("policy = 'cascade'").select("from_kind", "from_id", "to_kind", "to_id"))


def _touched(gone: DataFrame, edges: DataFrame, policy: str) -> DataFrame:
    hit = edges.where(F.col("policy").eqNullSafe(policy)).join(gone, (F.col("kind") == F.col("from_kind")) & (F.col("id") == F.col("from_id")), "left_semi")
    stay = gone.select(F.col("kind").alias("gk"), F.col("id").alias("gi"))
    return hit.join(stay, (F.col("to_kind") == F.col("gk")) & (F.col("to_id") == F.col("gi")), "left_anti")


def restricted(gone: DataFrame, edges: DataFrame) -> DataFrame:
    """References that forbid the deletion: of rows that stay."""
    return _touched(gone, edges, "restrict")


def undecided(gone: DataFrame, edges: DataFrame) -> DataFrame:
    """References without a policy of rows that stay; a deletion that meets one is an error."""
    return _touched(gone, edges, None)


def cleared(gone: DataFrame, edges: DataFrame) -> DataFrame:
    """References of rows that stay which become none."""
    return _touched(gone, edges, "clear")


def dropped_members(gone: DataFrame, edges: DataFrame) -> DataFrame:
    """Set members that rows that stay lose."""
    return _touched(gone, edges, "drop_member")


def patch_conflicts(patches: DataFrame) -> DataFrame:
    """(kind, id, field) that several deletions would set to different values."""
    return patches.groupBy("kind", "id", "field").agg(F.count_distinct(F.coalesce(F.col("value").cast("string"), F.lit("\x00none"))).alias("values")).where("values > 1")
