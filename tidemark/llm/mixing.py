"""Mixing sources to target weights by capped water-filling.

Every source has a weight; together the targets are a share of all words.
A source whose target would pass ``max_epochs`` times its size is clamped
there, and the excess is shared among the others by weight, again and again
until no source is above its cap.  A source then takes whole repetitions of
all its documents and, for the rest of its target, one more repetition of the
documents that come first in a seeded hash order.

The choice of documents is a pure function of a row and of one small row for
its source (a cut in the hash order), so texts are never shuffled.  The cut is
found by two rounds of 1024 hash bins, summed before they move, and an exact
order inside the one bin that the cut falls into.

Defined results: a null text has size 0; null sources are one source, ranked
last; documents without words take 0; repeated rows are documents of their
own and share their hash, so ties at the cut go by document id and equal ids
go together; an empty table gives an empty result; other columns stay as they
are in ``mixed`` (names starting ``__mix_`` are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ranked, word_count

WEIGHTS = (5, 2, 1)
BITS = 10
#: Up to this many sources their plan is broadcast (a row has under 200 bytes); beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Tasks that the rows of one source are dealt to then.
SALTS = 32
#: Stands for a null document id, before all others.
FIRST = -(1 << 63)


def _hash(doc_id: Column, seed: int) -> Column:
    """63 bits, the order in which documents are taken."""
    return F.xxhash64(F.lit(seed), doc_id).bitwiseAND(F.lit((1 << 63) - 1))


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """``sources`` (weight, source_size) with ``target``.

    Each round sums what is clamped and what is not, in one aggregate over the
    table of sources.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > cap
        row = sources.agg(
            F.count(F.when(over, 1)).alias("n"),
            F.sum(F.when(over, F.col("source_size"))).alias("size"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
        ).first()
        if row["n"] == clamped or not row["weight"]:
            break
        clamped = row["n"]
        level = (total - (row["size"] or 0) * max_epochs) / row["weight"]
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)).cast("double"))


def plan_sources(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row a source from ``sized`` (source, doc_id, size, hash): its target, whole repetitions and cut."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = ranked(sources, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    sources = materialize(sources.select("source", "source_size", weight.alias("weight")), "sources")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    filled = water_fill(sources, words * share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    filled = filled.withColumn("whole", F.floor(epochs))
    filled = materialize(filled.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "targets")

    low = filled.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("low"))
    for k in (1, 2):
        shift = 63 - BITS * k
        inside = _join(sized, low).where(F.shiftright("hash", shift + BITS) == F.shiftright("low", shift + BITS))
        bins = inside.groupBy("s", F.shiftright("hash", shift).alias("bin")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("bin"))
        bins = bins.withColumn("before", upto - F.col("words")).where((F.col("before") <= F.col("rest")) & (F.col("words") > 0))
        low = bins.groupBy("s").agg(F.max(F.struct("bin", "before", "rest")).alias("x"))
        low = low.select("s", (F.col("x.rest") - F.col("x.before")).alias("rest"), F.shiftleft("x.bin", shift).alias("low"))
        low = materialize(low, f"cut{k}")
    shift = 63 - BITS * 2
    last = _join(sized, low).where(F.shiftright("hash", shift) == F.shiftright("low", shift))
    # equal rows are one with a count, so that copies are no burden on the bin's task
    last = last.groupBy("s", "hash", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"))
    upto = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("s").orderBy("hash", "doc_id", "size"))
    fits = F.floor((F.col("rest") - (upto - F.col("size") * F.col("n"))) / F.col("size") + 0.5)
    last = last.withColumn("taken", F.when(F.col("size") > 0, F.least(F.col("n"), fits)).otherwise(F.col("n"))).where("taken > 0")
    last = last.groupBy("s").agg(F.max(F.struct("hash", "doc_id", "size", "taken", "n")).alias("cut"))
    cuts = low.withColumnRenamed("s", "ls").join(last, F.col("ls").eqNullSafe(F.col("s")), "left")
    before = F.struct((F.col("low") - 1).alias("hash"), F.lit(FIRST).alias("doc_id"), F.lit(-1).cast("long").alias("size"), F.lit(1).cast("long").alias("taken"), F.lit(1).cast("long").alias("n"))
    cuts = cuts.select(F.col("ls").alias("cs"), F.coalesce("cut", before).alias("cut"))
    planned = filled.join(cuts, F.col("source").eqNullSafe(F.col("cs")), "left")
    return materialize(planned.select("source", "source_size", "target", "whole", F.when(F.col("rest") > 0, F.col("cut")).alias("cut")), "plan")


def _join(sized: DataFrame, low: DataFrame) -> DataFrame:
    """Rows with what belongs to their source; past a bound, a source's rows are dealt to ``SALTS`` tasks."""
    if low.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return sized.join(F.broadcast(low), F.col("source").eqNullSafe(F.col("s")))
    salted = low.withColumn("salt_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = sized.withColumn("salt", F.pmod(F.xxhash64("hash", "doc_id", F.spark_partition_id()), F.lit(SALTS)))
    return salt.join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("salt_s"))).drop("salt", "salt_s")


def _id(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(FIRST))


def _numbered(x: DataFrame, equal: Column) -> DataFrame:
    """``x`` with ``nth``, which counts the rows of a source that are ``equal`` to its cut.

    They are counted within the partitions that they were written in, after a
    sum of the counts of earlier partitions, a row a partition and source.
    """
    x = materialize(x, "at_cut").withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()})
    x = materialize(x, "placed")
    here = x.where(equal).withColumn("nth", F.row_number().over(Window.partitionBy("part", "s").orderBy("pos")))
    counts = x.where(equal).groupBy("part", "s").count()
    before = F.sum("count").over(Window.partitionBy("s").orderBy("part")) - F.col("count")
    counts = counts.select(F.col("part").alias("cp"), F.col("s").alias("cs"), before.alias("before"))
    here = here.join(counts, (F.col("part") == F.col("cp")) & F.col("s").eqNullSafe(F.col("cs"))).withColumn("nth", F.col("nth") + F.col("before"))
    rest = x.where(~F.coalesce(equal, F.lit(False))).withColumn("nth", F.lit(0).cast("long"))
    return rest.unionByName(here.select(*rest.columns))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 20_011,
) -> DataFrame:
    """``docs`` with ``__mix_size``, ``__mix_source_size``, ``__mix_target`` and ``__mix_times``, how often the mix takes the document."""
    slim = docs.select(F.col(source_col).alias("source"), _id(F.col(id_col)).alias("doc_id"), word_count(F.col(text_col)).alias("size"))
    slim = materialize(slim.withColumn("hash", _hash(F.col("doc_id"), seed)), "sized")
    plan = plan_sources(slim, weights, share, max_epochs)
    plan = plan.withColumnRenamed("source", "s")
    split = bool(plan.where("cut.taken < cut.n").limit(1).count())
    x = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.col(source_col).alias("source"),
        _id(F.col(id_col)).alias("doc_id"),
        word_count(F.col(text_col)).alias("size"),
    )
    x = _join(x.withColumn("hash", _hash(F.col("doc_id"), seed)), plan)
    own, cut = F.struct("hash", "doc_id", "size"), F.struct("cut.hash", "cut.doc_id", "cut.size")
    equal = F.col("cut").isNotNull() & (own == cut)
    if split:
        x = _numbered(x, equal & (F.col("cut.taken") < F.col("cut.n")))
        taken = (own < cut) | (equal & (F.col("nth") <= F.col("cut.taken")))
    else:
        taken = own <= cut
    more = F.when(F.col("cut").isNotNull() & taken, 1).otherwise(0)
    return x.select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns],
        F.col("size").alias("__mix_size"),
        F.col("source_size").alias("__mix_source_size"),
        F.col("target").alias("__mix_target"),
        (F.col("whole") + more).cast("int").alias("__mix_times"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    out = mixed(docs, **options)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("__mix_times")))
    return out.where("__mix_times > 0").select(*docs.columns, copies.alias("__mix_copy")).drop("__mix_copy")


def op2_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = mixed(docs)
    return out.select(
        "doc_id",
        F.col("__mix_size").alias("size"),
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        (F.col("__mix_size") * F.col("__mix_times")).alias("taken"),
    )
