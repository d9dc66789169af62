"""Nearest neighbours by a block matrix join with int8 product tiles.

Vectors are quantised once and dealt by hash into blocks of a bounded number of
vectors; a block's int8 codes, scales and ids, not its vectors, are the row that
moves.  A task gets one block of queries and a run of candidate blocks.  A tile
multiplies both blocks' codes; products of up to 1040 components are whole
numbers below 2**24, so float32 matrix products, of longer vectors in runs, give
them exactly.  With scales s and t, a vector x is s * (a + e) with |e| <= 1/2 in
every component, so a true inner product lies within
s * t * (|a|_1 / 2 + |b|_1 / 2 + d / 4) of the tile's.  Pairs whose upper bound
reaches the k-th largest lower bound, first of the task and then of the whole
query, survive; only their original vectors are fetched, and multiplied in
double precision.  The bound never loses a neighbour: the result is exact.

Where more than ``crowd * k`` candidates of a query survive, as among very many
copies of one vector that the codes cannot tell apart, fetching a vector for
each pair would cost more than moving blocks.  Such a query meets all blocks of
original vectors instead, and a heap of its k best keeps what a task returns
small.  No candidate is dropped either way.

Defined results: a vector that is null, empty, zero or holds a null, NaN or
infinite component takes no part, nor does a row without an id; vectors meet
only vectors of their own length; equal scores go by the smaller id; rows with
the query's id are not its candidates, other repeated rows are candidates of
their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_common, materialize, tune_arrow

QUERY_BLOCK = 512
BLOCK = 2048
#: Candidate blocks that one task takes one after another.
RUN = 8
#: Components whose int8 products add up exactly in float32: 1040 * 127**2 < 2**24.
EXACT = 1040
#: Survivors of a query, in units of k, past which its candidates' vectors move as blocks.
CROWD = 32


def taking_part(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Block:
    """Rows, ids, codes and scales of some vectors."""

    rows: np.ndarray
    ids: np.ndarray
    codes: np.ndarray
    scales: np.ndarray


def _vectors(key, group) -> np.ndarray:
    return group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, key[0].as_py())


def _pack(key, group):
    """One row of a block's ids and vectors."""
    ids = group.column("vec_id").to_numpy()
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([_vectors(key, group).tobytes()], pa.binary())})


def _pack_codes(key, group):
    """One row of a block's rows, ids, codes and scales."""
    codes, scales = quantised(_vectors(key, group))
    held = {"rows": group.column("row").to_numpy().astype("<i8"), "ids": group.column("vec_id").to_numpy().astype("<i8"), "codes": codes, "scales": scales.astype("<f8")}
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64())} | {n: pa.array([x.tobytes()], pa.binary()) for n, x in held.items()})


def blocks(vectors: DataFrame, n: int, codes: bool = False) -> DataFrame:
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n))).groupBy("dim", "block")
    if codes:
        return dealt.applyInArrow(_pack_codes, "dim int, block long, rows binary, ids binary, codes binary, scales binary")
    return dealt.applyInArrow(_pack, "dim int, block long, ids binary, vectors binary")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from -127 to 127, and the scale of each row."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(np.float64).tiny)
    return np.rint(x / scale[:, None]).astype(np.int8), scale


def bounds(a: np.ndarray, s: np.ndarray, b: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products from int8 codes and scales, and bounds of their errors."""
    a, b = a.astype(np.float32), b.astype(np.float32)
    st = s[:, None] * t[None, :]
    norms = np.abs(a).sum(axis=1, dtype=np.float64)[:, None] + np.abs(b).sum(axis=1, dtype=np.float64)[None, :]
    # a float's rounding on top, far below the quantisation error
    return product(a, b) * st, (0.5 * norms + 0.25 * a.shape[1]) * st * (1 + 1e-6) + 1e-12


def tile(queries: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of vectors."""
    return bounds(*quantised(queries), *quantised(candidates))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers up to 127, exactly: each run of components stays below 2**24."""
    if a.shape[1] <= EXACT:
        return a @ b.T
    return sum((a[:, i : i + EXACT] @ b[:, i : i + EXACT].T).astype(np.float64) for i in range(0, a.shape[1], EXACT))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x and y, summed in the order of the components."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * y[:, k]
    return total


class Survivors:
    """Pairs of a block of queries that may be among the k best: (query, row, id, upper bound, lower bound)."""

    def __init__(self, asked: Block, k: int, limit: int):
        self.asked, self.k, self.limit = asked, k, limit
        self.lows = np.full((len(asked.rows), k), -np.inf)
        self.crowded = np.zeros(len(asked.rows), bool)
        self.pairs = [np.zeros(0, t) for t in ("i8", "i8", "i8", "f8", "f8")]

    def meet(self, there: Block) -> None:
        about, error = bounds(self.asked.codes, self.asked.scales, there.codes, there.scales)
        own = self.asked.ids[:, None] == there.ids[None, :]
        low, upper = about - error, about + error
        low[own | np.isnan(low)] = -np.inf
        best = np.partition(low, -self.k, axis=1)[:, -self.k :] if low.shape[1] > self.k else low
        self.lows = np.partition(np.concatenate([self.lows, best], axis=1), -self.k, axis=1)[:, -self.k :]
        floor = self.lows.min(axis=1)
        q, c = np.nonzero(~(upper < floor[:, None]) & ~own & ~self.crowded[:, None])
        pairs = [np.concatenate(x) for x in zip(self.pairs, (q, there.rows[c], there.ids[c], upper[q, c], low[q, c]), strict=True)]
        pairs = [x[~(pairs[3] < floor[pairs[0]])] for x in pairs]
        self.crowded |= np.bincount(pairs[0], minlength=len(self.crowded)) > self.limit
        self.pairs = [x[~self.crowded[pairs[0]]] for x in pairs]

    def table(self) -> pa.Table:
        """The pairs, and a row without a candidate for each crowded query."""
        q, row, vec, upper, low = self.pairs
        crowded = self.asked.rows[self.crowded]
        none = [None] * len(crowded)
        found = pa.table([pa.array(self.asked.rows[q]), pa.array(row), pa.array(vec), pa.array(upper), pa.array(low)], SURVIVOR)
        return pa.concat_tables([found, pa.table([pa.array(crowded), *[pa.array(none, t) for t in SURVIVOR.types[1:]]], SURVIVOR)])


SURVIVOR = pa.schema([("asked", pa.int64()), ("cand", pa.int64()), ("vec_id", pa.int64()), ("upper", pa.float64()), ("low", pa.float64())])


def _survivors(k: int, limit: int):
    def run(key, group):
        dim = key[0].as_py()
        held = {n: group.column(n).to_pylist() for n in ("query", "rows", "ids", "codes", "scales")}
        queries, there = [], []
        for query, rows, ids, codes, scales in zip(*held.values(), strict=True):
            part = Block(np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(codes, np.int8).reshape(-1, dim), np.frombuffer(scales, "<f8"))
            (queries if query else there).append(part)
        found = [SURVIVOR.empty_table()]
        for asked in queries:
            survivors = Survivors(asked, k, limit)
            for part in there:
                survivors.meet(part)
            found.append(survivors.table())
        return pa.concat_tables(found)

    return run


class Heaps:
    """The k best of every query so far: heaps of (score, -id), the worst on top."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k, self.heaps = ids, vectors, k, [[] for _ in ids]

    def floors(self) -> np.ndarray:
        return np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.heaps])

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        about, error = tile(self.vectors, vectors)
        own = self.ids[:, None] == ids[None, :]
        about[own] = -np.inf
        low = about - error
        floor = self.floors()
        if low.shape[1] >= self.k:
            floor = np.maximum(floor, np.partition(low, -self.k, axis=1)[:, -self.k])
        q, c = np.nonzero((about + error >= floor[:, None]) & ~own)
        score = exact(self.vectors[q], vectors[c])
        order = np.lexsort((ids[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place < self.k
        for i, s, j in zip(q[best].tolist(), score[best].tolist(), ids[c[best]].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -j))
            else:
                heapq.heappushpop(heap, (s, -j))


def _search(k: int):
    def run(key, group):
        dim = key[0].as_py()
        heaps, found = None, []
        ids = [np.frombuffer(x, "<i8") for x in group.column("ids").to_pylist()]
        vectors = [np.frombuffer(x, "<f8").reshape(-1, dim) for x in group.column("vectors").to_pylist()]
        query = np.array(group.column("query").to_pylist(), bool)
        for r in np.flatnonzero(query):
            heaps = Heaps(ids[r], vectors[r], k)
            for c in np.flatnonzero(~query):
                heaps.meet(ids[c], vectors[c])
            found += [(int(i), -j, s) for i, h in zip(ids[r], heaps.heaps, strict=True) for s, j in h]
        q, v, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def _met(queries: DataFrame, part: DataFrame, n: int, m: int, sizes: tuple[int, int, int], codes: bool):
    """Blocks of ``m`` queries beside runs of blocks of ``n`` candidates, grouped for a task each."""
    query_block, block, run = sizes
    n_blocks, n_queries = max(1, -(-n // block)), max(1, -(-m // query_block))
    runs = -(-n_blocks // run)
    asked, there = blocks(queries, n_queries, codes), blocks(part, n_blocks, codes)
    asked = asked.withColumns({"run": F.explode(F.sequence(F.lit(0), F.lit(runs - 1))), "query": F.lit(True)}).withColumnRenamed("block", "asked")
    there = there.withColumns({"asked": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))), "run": (F.col("block") % runs).cast("int"), "query": F.lit(False)}).drop("block")
    return asked.unionByName(there).groupBy("dim", "asked", "run")


def _recomputed(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) from the original vectors; a candidate that many queries share does not land in one task."""
    rows = pairs.groupBy("cand").agg(F.count(F.lit(1)).alias("rows"))
    there = part.select(F.col("row").alias("cand"), F.col("vector").alias("y")).join(rows, "cand")
    asked = part.where("query").select(F.col("row").alias("asked"), F.col("vec_id").alias("query_id"), F.col("vector").alias("x"))
    both = join_common(pairs, there, "cand", "rows").join(asked, "asked")
    # summed in the order of the components
    score = F.aggregate(F.zip_with("x", "y", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, xy: total + xy)
    return both.select("query_id", "vec_id", score.alias("score"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, block: int = BLOCK, run: int = RUN, crowd: int = CROWD) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each query."""
    spark = vectors.sparkSession
    tune_arrow(spark, 2048)
    sizes = query_block, block, run
    part = vectors.where(taking_part(F.col(vector_col)) & F.col(id_col).isNotNull())
    # floats stay floats while they move
    kind = "array<float>" if vectors.select(vector_col).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    part = part.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    part = materialize(part.withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()}), "vectors")
    n, m = part.agg(F.count(F.lit(1)), F.count_if("query")).first()
    met = _met(part.where("query"), part, n, m, sizes, codes=True)
    survivors = materialize(met.applyInArrow(_survivors(k, crowd * k), "asked long, cand long, vec_id long, upper double, low double"), "survivors")
    # the k-th largest lower bound of the whole query
    pairs = survivors.where("cand IS NOT NULL")
    lows = pairs.select("asked", "low", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("low"))).alias("n")).where(F.col("n") <= k)
    floors = lows.groupBy("asked").agg(F.when(F.count(F.lit(1)) == k, F.min("low")).alias("floor"))
    pairs = materialize(pairs.join(floors, "asked").where(F.col("floor").isNull() | ~(F.col("upper") < F.col("floor"))).select("asked", "cand", "vec_id"), "pairs")
    many = pairs.groupBy("asked").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd * k).select("asked")
    crowded = materialize(survivors.where("cand IS NULL").select("asked").unionByName(many).distinct(), "crowded")
    found = _recomputed(pairs.join(crowded, "asked", "left_anti"), part)
    if left := crowded.count():
        queries = part.where("query").join(crowded.withColumnRenamed("asked", "row"), "row", "left_semi")
        # few queries: a task for each block of candidates
        met = _met(queries, part, n, left, (query_block, block, 1), codes=False)
        found = found.unionByName(materialize(met.applyInArrow(_search(k), "query_id long, vec_id long, score double"), "met"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
) WHERE rank <= 20
"""
