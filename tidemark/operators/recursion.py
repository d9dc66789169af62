"""Recursion over parent links: coverage with pruning, closures, ancestors.

A recursive query carries the path, so cycles end where a node would come
twice; a predicate stands in the recursive term, so a pruned node's subtree is
never visited.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize

MAX_DEPTH = 1000


def coverage(nodes: DataFrame, node: str, parent: str, roots: str = "parent IS NULL", include: str = "true", max_depth: int = 100) -> DataFrame:
    """(node, root, depth, path) of every node that roots reach through included nodes.

    ``roots`` and ``include`` are conditions on ``nodes``.  Level by level, the
    frontier is joined with its children; each level is written before the
    next, so a level is computed once and survives the loss of an executor.
    """
    base = nodes.withColumnsRenamed({node: "__node", parent: "__parent"})
    base = base.withColumns({node: F.col("__node"), parent: F.col("__parent")})
    kept = base.where(include)
    frontier = kept.where(roots.replace("parent", "__parent") if roots == "parent IS NULL" else roots).select(F.col("__node").alias("node"), F.col("__node").alias("root"), F.lit(0).alias("depth"), F.array("__node").alias("path"))
    frontier = materialize(frontier, "level")
    found, links = frontier, kept.select(F.col("__parent").alias("up"), F.col("__node").alias("next"))
    for _ in range(max_depth):
        step = frontier.join(links, F.col("node") == F.col("up")).where(~F.array_contains("path", F.col("next")))
        frontier = materialize(step.select(F.col("next").alias("node"), "root", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("next")).alias("path")), "level")
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
    raise RecursionError(f"deeper than {max_depth} levels")


def coverage_sql(spark, table: str, node: str, parent: str, include: str = "true", max_depth: int = 100) -> DataFrame:
    """The same as one recursive query, for trees of moderate depth and of any number of rows.

    ``LIMIT ALL`` lifts ``spark.sql.cteRecursionRowLimit``, past which a recursive query fails.
    """
    return spark.sql(
        f"""
        WITH RECURSIVE t(node, root, depth, path) MAX RECURSION LEVEL {max_depth} AS (
          SELECT {node}, {node}, 0, array({node}) FROM {table} WHERE {parent} IS NULL AND ({include})
          UNION ALL
          SELECT c.{node}, t.root, t.depth + 1, concat(t.path, array(c.{node}))
          FROM t JOIN {table} c ON c.{parent} = t.node
          WHERE ({include}) AND NOT array_contains(t.path, c.{node})
        )
        SELECT * FROM t LIMIT ALL
        """
    )


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Every (kind, id) that ``seeds`` reach along ``edges`` (from_kind, from_id, to_kind, to_id), each once.

    Rounds join only what the last round added.
    """
    seen = frontier = materialize(seeds.select("kind", "id").distinct(), "reached")
    while not frontier.isEmpty():
        on = (F.col("kind") == F.col("from_kind")) & (F.col("id") == F.col("from_id"))
        step = frontier.join(edges, on).select(F.col("to_kind").alias("kind"), F.col("to_id").alias("id")).distinct()
        frontier = materialize(step.join(seen, ["kind", "id"], "left_anti"), "reached")
        seen = materialize(seen.unionByName(frontier), "seen")
    return seen
