"""What the operators share: session settings, shared storage, global ranks."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space, for bytes.strip.
ASCII_SPACE = b" \t\n\x0b\x0c\r"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session names it in ``spark.checkpoint.dir``.  Where that is unset a
    temporary folder serves, but only for a local master, whose executor is
    the driver itself.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    _own_dir = _own_dir or "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, not the plan
    above, and what was drawn from a sample (range bounds) stays as drawn.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tune_arrow(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches of long texts small: a batch is held twice, in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def stretches(texts: list[bytes | None], size: int = 2 << 20):
    """Yields runs of texts of about ``size`` bytes at most, or single texts, so that what is made of a run stays small."""
    part, held = [], 0
    for t in texts:
        n = len(t or b"")
        if part and held + n > size:
            yield part
            part, held = [], 0
        part.append(t)
        held += n
    if part:
        yield part


def numbered_slices(texts: pa.Array, size: int = 8 << 20):
    """The same runs of an Arrow array, each with the number of its first row."""
    at = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > at and held + n > size:
            yield at, texts.slice(at, i - at)
            at, held = i, 0
        held += n
    if len(texts) > at:
        yield at, texts.slice(at)


def slices(texts: pa.Array, size: int = 2 << 20):
    """The runs alone."""
    return (run for _, run in numbered_slices(texts, size))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key that makes up one in so many rows is common; there are at most as many such keys.
HOT = 1000


def join_common(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join on ``key``, of which ``right`` has each value once, with the number ``rows`` of its rows in ``left``.

    Common keys, at most ``HOT``, are broadcast, so that none lands in one
    task; the others are joined by a shuffle or as the session decides.
    """
    total, right = left.count(), materialize(right, "keys")
    common, rare = (right.where((F.col(rows) * HOT >= total) == x) for x in (True, False))
    mark = F.broadcast(common.select(key))
    out = left.join(F.broadcast(common), key)
    return out.unionByName(left.join(mark, key, "left_anti").join(rare, key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, *order: Column, name: str = "__rank") -> DataFrame:
    """``df`` with a dense position from 0 in ``order``, without a single task that sees all rows.

    Rows are range-partitioned and sorted; the driver learns one count for
    each partition, never a row.
    """
    n = shuffle_partitions(df.sparkSession)
    dealt = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__in_part", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    dealt = materialize(dealt, "ranked")
    base, before = {}, 0
    for part, count in sorted(dealt.groupBy("__part").count().collect()):
        base[part] = before
        before += count
    if not base:
        return dealt.withColumn(name, F.col("__in_part")).drop("__part", "__in_part")
    offsets = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])
    return dealt.withColumn(name, offsets[F.col("__part")] + F.col("__in_part")).drop("__part", "__in_part")
