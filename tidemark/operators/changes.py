"""Statements of a transition: each takes a collection's rows and gives those after it.

Frames are never changed in place; a transition is the difference of the first
and the last frame.  All right sides of a patch read the rows before it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constraints import Rejection


def _match(key: Iterable[str]):
    return [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]


def insert(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Adds rows; a key that is there already, or comes twice, is rejected."""
    if not new.join(rows, key, "left_semi").isEmpty() or not new.groupBy(*key).count().where("count > 1").isEmpty():
        raise Rejection("duplicate_key", ",".join(key))
    return rows.unionByName(new, allowMissingColumns=True)


def insert_missing(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Adds the rows whose key is not there yet."""
    return rows.unionByName(new.join(rows, key, "left_anti").dropDuplicates(key), allowMissingColumns=True)


def replace(rows: DataFrame, new: DataFrame, key: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """The new rows; of a row that was there, the ``keep`` columns stay as they were."""
    keep = list(keep)
    if not keep:
        return new
    old = rows.select(*key, *[F.col(c).alias(f"__old_{c}") for c in keep])
    out = new.join(old, key, "left")
    return out.withColumns({c: F.coalesce(F.col(f"__old_{c}"), F.col(c)) if c in new.columns else F.col(f"__old_{c}") for c in keep}).drop(*[f"__old_{c}" for c in keep])


def patch(rows: DataFrame, selected: Column, values: Mapping[str, Column]) -> DataFrame:
    """Sets fields of the selected rows."""
    pick = F.coalesce(selected, F.lit(False))
    new = {f: F.when(pick, v).otherwise(F.col(f)).cast(rows.schema[f].dataType).alias(f) for f, v in values.items()}
    return rows.select(*[new.get(c, F.col(c)) for c in rows.columns])


def clear(rows: DataFrame, selected: Column, field: str) -> DataFrame:
    return patch(rows, selected, {field: F.lit(None)})


def delete_keys(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Without the rows of the keys; keys that are not there are ignored."""
    return rows.join(keys.select(*key), key, "left_anti")


def delete_where(rows: DataFrame, selected: Column) -> DataFrame:
    return rows.where(~F.coalesce(selected, F.lit(False)))


def rekey(rows: DataFrame, key: str, renamed: DataFrame, referring: Mapping[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows with new keys from ``renamed`` (old, new), and every referring frame with its references following."""

    def followed(df: DataFrame, column: str) -> DataFrame:
        out = df.join(renamed.select(F.col("old").alias("__old"), F.col("new").alias("__new")), F.col(column) == F.col("__old"), "left")
        return out.withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")

    return followed(rows, key), {name: followed(df, ref) for name, (df, ref) in referring.items()}


def diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(op, key..., before, after): inserts, deletes and updates by identity; empty if nothing changed."""
    fields = [c for c in before.columns if c not in key]
    b = before.select(*key, F.struct(*fields).alias("before"), F.lit(True).alias("__b"))
    a = after.select(*key, F.struct(*fields).alias("after"), F.lit(True).alias("__a"))
    both = b.join(a, key, "full")
    op = F.when(F.col("__b").isNull(), "insert").when(F.col("__a").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    return both.withColumn("op", op).where("op IS NOT NULL").select("op", *key, "before", "after")


def unchanged(changes: DataFrame) -> bool:
    return changes.isEmpty()


def erase(rows: DataFrame, selected: Column, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """Takes payload fields out of the selected rows: (rows with a digest in their stead, the payload taken out)."""
    pick = F.coalesce(selected, F.lit(False))
    digest = F.sha2(F.to_json(F.struct(*payload)), 256)
    stubs = rows.withColumn("erased", F.when(pick, digest))
    stubs = stubs.withColumns({c: F.when(pick, F.lit(None)).otherwise(F.col(c)) for c in payload})
    return stubs, rows.where(pick).withColumn("erased", digest)


def reinsert(rows: DataFrame, extract: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """Puts extracted payload back where the digest agrees."""
    back = extract.where(F.sha2(F.to_json(F.struct(*payload)), 256) == F.col("erased")).select(*key, F.col("erased").alias("__proof"), *[F.col(c).alias(f"__x_{c}") for c in payload])
    out = rows.join(back, key, "left")
    good = F.coalesce(F.col("erased") == F.col("__proof"), F.lit(False))
    out = out.withColumns({c: F.when(good, F.col(f"__x_{c}")).otherwise(F.col(c)) for c in payload} | {"erased": F.when(good, F.lit(None)).otherwise(F.col("erased"))})
    return out.drop("__proof", *[f"__x_{c}" for c in payload])
