"""One total order over all values.

None comes last in ascending and first in descending order.  Every order ends
in the row's identity, so delivered order never depends on partitioning.  For
types that Spark cannot order, or orders otherwise, a key column stands in.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def asc(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).asc_nulls_last()


def desc(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).desc_nulls_first()


def enum_key(label: Column, labels: Iterable[str]) -> Column:
    """Position in the declaration; none for none, an error for an unknown label."""
    found = None
    for i, name in enumerate(labels):
        found = F.when(label == name, i) if found is None else found.when(label == name, i)
    return found.when(label.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("unknown label "), label)).cast("int"))


def set_key(elements: Column) -> Column:
    """Sets compare by their sorted members; a set that another one continues comes first."""
    return F.array_sort(F.array_distinct(elements))


def map_key(entries: Column) -> Column:
    """Maps, which Spark does not order, compare by their entries in key order."""
    return F.array_sort(F.map_entries(entries))


def struct_keys(value: Column, fields: Iterable[str]) -> list[Column]:
    """Structs compare field by field in the order of names, absent ones last."""
    return [asc(value[f]) for f in sorted(fields)]


def positioned(df: DataFrame, order: list[Column], name: str = "pos", limit: int | None = None) -> DataFrame:
    """``df`` with the position of each row in ``order``, from 1.

    With a limit the first rows are taken by a bounded top-k.  Without one, rows
    are range-partitioned and sorted, and only one count for each partition
    meets on the driver; no task sees all rows.
    """
    if limit is not None:
        first = df.orderBy(*order).limit(limit)
        return first.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = materialize(dealt, "positions")
    offsets, before = {}, 1
    for part, count in sorted(dealt.groupBy("__part").count().collect()):
        offsets[part] = before
        before += count
    start = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("__part")) if offsets else F.lit(1)
    return dealt.withColumn(name, (start + F.col("__row")).cast("long")).drop("__part", "__row")
