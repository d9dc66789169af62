"""Moving rows from one version of a schema to the next."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.logic import ne


def migrated(old: DataFrame, fields: Mapping[str, str | Column]) -> DataFrame:
    """New fields from old ones: a name copies (and so renames), a column computes."""
    return old.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])


def round_trip_violations(old: DataFrame, field: str, forward: Column, back) -> DataFrame:
    """Rows for which going forward and ``back`` does not give the value again."""
    return old.withColumn("__there", forward).where(ne(back(F.col("__there")), F.col(field))).drop("__there")


def not_representable(df: DataFrame, field: str, kind: str) -> DataFrame:
    """Rows that would be lost in a narrower type: a cast there and back changes them."""
    own = df.schema[field].dataType
    return df.where(F.col(field).isNotNull() & ne(F.col(field).try_cast(kind).cast(own), F.col(field)))


_WIDER = {("integer", "long"), ("integer", "double"), ("float", "double"), ("date", "timestamp"), ("integer", "decimal"), ("long", "decimal")}


def incompatible(old: StructType, new: StructType) -> list[str]:
    """What a reader of the old schema could not read in the new one."""
    out = []
    there = {f.name: f for f in new.fields}
    for f in old.fields:
        g = there.get(f.name)
        if g is None:
            out.append(f"{f.name} is gone")
        elif f.dataType != g.dataType and (f.dataType.typeName(), g.dataType.typeName()) not in _WIDER:
            out.append(f"{f.name} was {f.dataType.simpleString()} and is {g.dataType.simpleString()}")
        elif not f.nullable and g.nullable:
            out.append(f"{f.name} may be none")
    return out
