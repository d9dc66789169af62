"""Collections in Parquet, seeds in JSON, snapshots with a manifest."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.view import View, collection


def read_collection(spark: SparkSession, path: str, key: list[str], relation: str) -> View:
    """A stored collection: filters and columns reach the Parquet scan."""
    return collection(spark.read.parquet(path), key, relation)


def read_row(view: View, *key) -> DataFrame:
    """The row of a key, by equality on key columns, which Parquet's statistics prune by."""
    df = view.df
    for c, k in zip(view.id_columns, key, strict=True):
        df = df.where(F.col(c) == F.lit(k))
    return df.select(*view.fields)


def read_subtree(views: Mapping[str, View], prefix: tuple) -> dict[str, DataFrame]:
    """The rows under an ancestor's key in every nested collection: all hold their ancestors' keys first."""
    out = {}
    for name, view in views.items():
        df = view.df
        for c, k in zip(view.id_columns, prefix, strict=False):
            df = df.where(F.col(c) == F.lit(k))
        out[name] = df.select(*view.fields)
    return out


def seed_rows(spark: SparkSession, document: str | Mapping, schema: str, key: str) -> DataFrame:
    """Rows of a seed document, an object of key text to fields; the member's name is the key."""
    rows = json.loads(document) if isinstance(document, str) else document
    lines = [json.dumps({**fields, key: name}) for name, fields in rows.items()]
    text = spark.createDataFrame([(line,) for line in lines], "value string")
    return text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def reconcile_seed(base: DataFrame, local: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """A new bundle against local changes since the old one: (rows, conflicts)."""
    from ..operators.merge import conflicts, merged

    return merged(base, local, new, key), conflicts(base, local, new, key)


def write_snapshot(path: str, tables: Mapping[str, DataFrame], point: Mapping) -> None:
    """All collections as Parquet under one folder, with a manifest of rows, schemas and digests.

    A table's digest adds up row hashes, so it does not hang on partitions.
    """
    spark = next(iter(tables.values())).sparkSession
    entries = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        stored = spark.read.parquet(f"{path}/{name}")
        entries[name] = {"schema": df.schema.jsonValue(), **_digest(stored)}
    manifest = json.dumps({"point": dict(point), "tables": entries}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/_manifest")


def _digest(df: DataFrame) -> dict:
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")), F.lit(0)).alias("sum")).first()
    return {"rows": row["rows"], "digest": str(row["sum"])}


def read_snapshot(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """(point, tables) of a snapshot; an error where a table is not what the manifest says."""
    manifest = json.loads(spark.read.text(f"{path}/_manifest", wholetext=True).first()[0])
    tables = {}
    for name, entry in manifest["tables"].items():
        df = spark.read.parquet(f"{path}/{name}")
        if _digest(df) != {k: entry[k] for k in ("rows", "digest")}:
            raise ValueError(f"{name} differs from the manifest")
        tables[name] = df
    return manifest["point"], tables


def write_blobs(df: DataFrame, path: str, content: str, media: str, name: str) -> DataFrame:
    """Stores contents once each, by their SHA-512; gives descriptors."""
    described = df.withColumn("sha512", F.sha2(content, 512))
    new = described.select("sha512", F.col(content).alias("content")).dropDuplicates(["sha512"])
    jvm = df.sparkSession.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        new = new.join(df.sparkSession.read.parquet(path).select("sha512"), "sha512", "left_anti")
    new.write.mode("append").parquet(path)
    return described.select(F.struct("sha512", F.octet_length(content).cast("long").alias("bytes"), F.col(media).alias("media"), F.col(name).alias("name")).alias("blob"))
