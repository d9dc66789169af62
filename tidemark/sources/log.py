"""The change log: an append-only table of operations at serial positions, and states folded from it.

Rows are (seq, op, id, new_id, payload): insert, update, delete, rekey.  A state
is the last operation of every identity, so it is one aggregation over the log;
what a snapshot already holds is not folded again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPS = ("insert", "update", "delete", "rekey")


def changes_since(log: DataFrame, seq: int) -> DataFrame:
    """The change feed from a position on."""
    return log.where(F.col("seq") >= seq)


def _touches(log: DataFrame) -> DataFrame:
    """An operation for each identity it touches: a rekey deletes one and writes another."""
    gone = log.where("op = 'rekey'").select("seq", F.lit("delete").alias("op"), "id", "payload")
    here = log.select("seq", F.when(F.col("op") == "rekey", "update").otherwise(F.col("op")).alias("op"), F.when(F.col("op") == "rekey", F.col("new_id")).otherwise(F.col("id")).alias("id"), "payload")
    return here.unionByName(gone)


def state_at(log: DataFrame, seq: int) -> DataFrame:
    """(id, seq, payload) of the rows that exist after a position.

    The last operation is found by a partial aggregation, map side first, so a
    row with a long history costs one row a partition in the shuffle.
    """
    last = _touches(log.where(F.col("seq") <= seq)).groupBy("id").agg(F.max_by(F.struct("seq", "op", "payload"), F.struct("seq", F.col("op") != "delete")).alias("x"))
    return last.where("x.op <> 'delete'").select("id", "x.seq", "x.payload")


def advance(snapshot: DataFrame, log: DataFrame, seq_from: int, seq_to: int) -> DataFrame:
    """A later state from a snapshot and the log between: only that part of the log is read."""
    part = _touches(log.where((F.col("seq") > seq_from) & (F.col("seq") <= seq_to)))
    old = snapshot.select("seq", F.lit("insert").alias("op"), "id", "payload")
    last = part.unionByName(old).groupBy("id").agg(F.max_by(F.struct("seq", "op", "payload"), F.struct("seq", F.col("op") != "delete")).alias("x"))
    return last.where("x.op <> 'delete'").select("id", "x.seq", "x.payload")


def corrupt(log: DataFrame) -> DataFrame:
    """Operations that cannot follow what came before: an insert of, or a rekey to, what is there, or a change of nothing."""
    moved = log.withColumn("op", F.when(F.col("op") == "rekey", "arrive").otherwise(F.col("op"))).withColumn("id", F.when(F.col("op") == "arrive", F.col("new_id")).otherwise(F.col("id")))
    left = log.where("op = 'rekey'").withColumn("op", F.lit("delete"))
    order = Window.partitionBy("id").orderBy("seq", F.col("op") != "delete", "op")
    seen = moved.unionByName(left).select("seq", "op", "id", "payload").withColumn("before", F.lag("op").over(order))
    absent = F.col("before").isNull() | (F.col("before") == "delete")
    return seen.where(F.when(F.col("op").isin("insert", "arrive"), ~absent).otherwise(absent))


def gaps(log: DataFrame) -> DataFrame:
    """Positions after which the next is missing: serial positions have none."""
    seqs = log.select("seq").distinct()
    after = seqs.select((F.col("seq") - 1).alias("seq"))
    last = seqs.agg(F.max("seq").alias("last"))
    return seqs.join(after, "seq", "left_anti").join(F.broadcast(last), F.col("seq") < F.col("last"), "left_semi")


class ChangeLog:
    """A log in a folder: one Parquet folder for each position, taken by a single writer.

    A commit writes its rows under a name of its own and then renames the folder.
    Where the position is taken the rename fails, or moves the draft into the
    owner's folder, where readers overlook it and it is removed again; so a
    position has one owner and is seen whole or not at all.
    """

    def __init__(self, spark: SparkSession, path: str, payload: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = f"seq long, op string, id string, new_id string, payload {payload}"
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def head(self) -> int:
        if not self._fs.exists(self._Path(self.path)):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._Path(self.path))]
        return max((int(n[4:]) for n in names if n.startswith("seq=")), default=0)

    def commit(self, changes: DataFrame, expected: int) -> int:
        """Appends changes as the position after ``expected``, or fails if someone was faster."""
        seq = expected + 1
        name = f"_draft-{seq}-{uuid.uuid4().hex}"
        target, draft = self._Path(f"{self.path}/seq={seq}"), self._Path(f"{self.path}/{name}")
        if self.head() != expected:
            raise RuntimeError(f"the log has moved on to {self.head()}")
        changes.select("op", "id", "new_id", "payload").write.parquet(draft.toString())
        inside = self._Path(f"{self.path}/seq={seq}/{name}")
        if self._fs.exists(target) or not self._fs.rename(draft, target) or self._fs.exists(inside):
            for path in (draft, inside):
                self._fs.delete(path, True)
            raise RuntimeError(f"position {seq} is taken")
        return seq

    def read(self) -> DataFrame:
        if not self.head():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def at(self, seq: int | None = None) -> DataFrame:
        return state_at(self.read(), self.head() if seq is None else seq)


def operation_seen(operations: DataFrame, new: DataFrame) -> DataFrame:
    """New requests whose operation id was not carried out yet; the first of repeats in a batch."""
    first = Window.partitionBy("operation_id").orderBy("request_id")
    new = new.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return new.join(operations, "operation_id", "left_anti")


def points(names: dict[str, int]) -> str:
    """Named history points as a line of JSON."""
    return json.dumps(names, sort_keys=True)
