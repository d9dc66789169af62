"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document is the set of its distinct five-word shingles.  Its sketch has one
coordinate for each of ``bands * rows`` bins.  In round ``i`` every shingle is
hashed to a bin and a value; a bin keeps the least value of the first round
that reaches it, and after as many rounds as bins each empty bin takes the
least value over the whole set, so every coordinate fills.  Two sketches agree
in a coordinate with the Jaccard similarity as probability, with Chernoff-like
concentration.  Documents that agree in all coordinates of a band meet in a
bucket.  The number of rows a band is set from the threshold so that a pair at
the threshold is missed with a probability below 1e-4.

Documents with equal word sequences are one *representative* from the start.
Buckets never become groups in one task and never give all their pairs:

1. a bucket of up to ``SMALL`` representatives gives its pairs; in a larger one
   every member is paired with a few hubs, the members that come first in
   seeded orders;
2. pairs are verified on full shingle sets, in tasks of one hub and at most
   about ``CHUNK`` partners, and links are contracted to components;
3. in the large buckets that still hold several components, documents with so
   many shingles of their own that nobody can be similar to them leave; of the
   others, every pair across components is compared, in blocks of at most
   about ``BLOCK`` by ``BLOCK`` documents, whose intersections are products of
   0-1 matrices; only links come out.

So every candidate pair is decided, except where its ends are linked already.
The cost of step 3 grows with the unlinked members of a large bucket times its
members, in tasks of bounded size; no row is dropped or capped.

Defined results: null or empty texts and texts of white space have no
shingles and are linked with nothing; texts of fewer than five words have one
shingle; rows with a null id are linked with nothing and kept; rows with the
same id are one node; an empty table gives an empty result; further columns
stay in ``deduped`` (names starting ``__nd_`` are reserved).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, join_common, materialize, tune_arrow

SHINGLE = 5
BANDS = 32
SMALL = 8
HUBS = 4
CHUNK = 64
BLOCK = 128
#: Bytes of texts that are hashed together.
STRETCH = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20_117)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[list(ASCII_SPACE)] = True
_P, _C = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_P_INV = _U(pow(int(_P), -1, 1 << 64))
_ROUND = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 2 * STRETCH)
        for i, base in enumerate((_P, _P_INV)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _stretch(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct shingle hashes, sorted, of each text; all texts of a stretch go through numpy together."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    word = np.empty(len(joined) + 1, bool)
    word[0] = False
    np.logical_not(_SPACE[joined], out=word[1:])
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _power(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[joined] * up[: len(joined)], out=sums[1:])
    words = _mix((sums[end] - sums[start]) * down[start])
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(start, ends)
    n = len(words)
    full = words[: max(0, n - SHINGLE + 1)].copy()
    for k in range(1, SHINGLE):
        full = full * _C + words[k : n - SHINGLE + 1 + k] if n >= SHINGLE else full
    full = _mix(full)
    out, a = [], 0
    for b in last.tolist():
        if b - a >= SHINGLE:
            out.append(np.unique(full[a : b - SHINGLE + 1]))
        elif b > a:
            h = _U(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * _C + w
            out.append(_mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        a = b
    return out


def shingle_sets(texts: list[bytes | None]):
    """Yields the shingle set of each text, as sorted 64-bit hashes."""
    part, size = [], 0
    for t in texts:
        part.append(t or b"")
        size += len(part[-1]) + 1
        if size >= STRETCH:
            yield from _stretch(part)
            part, size = [], 0
    if part:
        yield from _stretch(part)


def sketch(hashes: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch with ``t`` coordinates of a set that is not empty.

    A coordinate is (round, value); enough rounds for the expected fill are
    placed in one step, further ones only while a bin is empty.
    """
    n = len(hashes)
    out = np.full(t, ~_U(0), np.uint64)
    step = min(t, max(1, math.ceil(t * (math.log(t) + 2) / n)))
    first = 0
    while first < t:
        rounds = np.arange(first, min(t, first + step), dtype=np.uint64)
        x = _mix(hashes[None, :] + _ROUND[rounds][:, None])
        bins = ((x >> _U(40)) % _U(t)).astype(np.int64)
        np.minimum.at(out, bins.ravel(), ((rounds[:, None] << _U(40)) | (x & _U((1 << 40) - 1))).ravel())
        first += step
        if (out != ~_U(0)).all():
            return out
        step = min(4 * step, max(1, (1 << 20) // n))
    for b in np.flatnonzero(out == ~_U(0)):
        x = _mix(hashes + _ROUND[t + b])
        out[b] = (_U(t + b) << _U(40)) | (x & _U((1 << 40) - 1)).min()
    return out


def band_rows(threshold: float, bands: int = BANDS, miss: float = 1e-4) -> int:
    """The most rows a band for which a pair at the threshold is missed with a probability below ``miss``."""
    rows = 1
    while (1 - threshold ** (rows + 1)) ** bands < miss:
        rows += 1
    return rows


def _sketches(bands: int, rows: int):
    t = bands * rows
    salt = np.arange(bands, dtype=np.uint64) * _U(0xA24BAED4963EE407)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            keys, sizes, found = [], [], []
            for text, h in zip(texts, shingle_sets(texts), strict=True):
                sizes.append(len(h))
                keys.append(xxhash.xxh3_128_digest(b" ".join(text.lower().split())) if len(h) else None)
                if len(h):
                    x = salt.copy()
                    for c in sketch(h, t).reshape(bands, rows).T:
                        x = _mix(x * _C + c)
                    found.append(x.view(np.int64).tolist())
                else:
                    found.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "key", "n", "bands"],
            )

    return run


def _sets(batches):
    for batch in batches:
        sets = [h.tobytes() for h in shingle_sets(batch.column(1).cast(pa.binary()).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])


def _compare(key, group):
    """Intersections of a hub's set with its partners'."""
    roles, ids, sets = (group.column(c).to_pylist() for c in ("partner", "id", "shingles"))
    hub = next(np.frombuffer(s, np.uint64) for r, s in zip(roles, sets, strict=True) if not r)
    rows = [(i, np.frombuffer(s, np.uint64)) for r, i, s in zip(roles, ids, sets, strict=True) if r]
    both = []
    for _, other in rows:
        a, b = (hub, other) if len(hub) >= len(other) else (other, hub)
        at = np.searchsorted(a, b)
        both.append(int((a[np.minimum(at, len(a) - 1)] == b).sum()))
    n = len(rows)
    return pa.table(
        {
            "hub": pa.array([key[0].as_py()] * n, pa.int64()),
            "id": pa.array([i for i, _ in rows], pa.int64()),
            "both": pa.array(both, pa.int64()),
            "n_hub": pa.array([len(hub)] * n, pa.int64()),
            "n": pa.array([len(x) for _, x in rows], pa.int64()),
        }
    )


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(hub, id) -> (hub, id, both, n_hub, n) on full shingle sets; ``texts`` is (id, text), unique by id."""
    tune_arrow(texts.sparkSession)
    pairs = materialize(pairs, "pairs")
    need = pairs.select(F.explode(F.array("hub", "id")).alias("id")).distinct()
    sets = materialize(texts.join(need.hint("merge"), "id", "left_semi").mapInArrow(_sets, "id long, shingles binary"), "sets")
    degree = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("partners"))
    degree = degree.withColumn("chunks", F.ceil(F.col("partners") / CHUNK))
    dealt = join_common(pairs, degree, "hub", "partners").select("hub", F.pmod(F.xxhash64("id"), "chunks").alias("chunk"), "id")
    hubs = dealt.select("hub", "chunk").distinct().select("hub", "chunk", F.col("hub").alias("id"), F.lit(False).alias("partner"))
    asked = hubs.unionByName(dealt.withColumn("partner", F.lit(True))).join(sets, "id")
    return asked.groupBy("hub", "chunk").applyInArrow(_compare, "hub long, id long, both long, n_hub long, n long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b): the smallest id that links reach.

    Every node hooks on to its least neighbour, pointers are followed to their
    roots, and the edges between roots go on to the next round, with at most
    half as many nodes.
    """
    edges = materialize(edges.select("a", "b"), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("up")).select("id", F.least("id", "up").alias("up"))
        parent = materialize(parent, "parents")
        while True:
            above = parent.select(F.col("id").alias("up"), F.col("up").alias("top"))
            jumped = materialize(parent.join(above, "up").select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "parents")
            parent = jumped.select("id", "up")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = parent.withColumnRenamed("up", "component")
        else:
            moved = parent.select(F.col("id").alias("component"), "up")
            found = found.join(moved, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
        found = materialize(found, "components")
        root = parent.select(F.col("id").alias("a"), F.col("up").alias("ra"))
        other = parent.select(F.col("id").alias("b"), F.col("up").alias("rb"))
        edges = edges.join(root, "a").join(other, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = materialize(edges, "edges")
    return found if found is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _open_links(large: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) across components between members of large buckets that hold several components."""
    inside = materialize(large.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "large")
    inside = materialize(_several(inside), "open")
    if inside.isEmpty():
        return inside.select(F.col("id").alias("a"), F.col("id").alias("b"))
    # a document that has too many shingles of its own is linked with nothing
    ids = inside.select("id").distinct()
    sets = materialize(texts.join(ids.hint("merge"), "id", "left_semi").mapInArrow(_sets, "id long, shingles binary"), "open_sets")
    common = sets.mapInArrow(_exploded, "id long, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("id"))
    own = common.where("docs = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    size = F.octet_length("shingles") / 8
    able = sets.join(own, "id", "left").where(size - F.coalesce("own", F.lit(0)) >= size * threshold - 1e-9)
    able = materialize(able.select("id", F.floor(F.log(size) / math.log(1 / threshold) - 1e-9).alias("class")), "classes")
    inside = materialize(_several(materialize(inside.join(able.select("id"), "id"), "left")), "able")
    if inside.isEmpty():
        return inside.select(F.col("id").alias("a"), F.col("id").alias("b"))
    # buckets that share members are compared once, as one cluster
    least = inside.groupBy("bucket").agg(F.min("id").alias("b"))
    clusters = components(inside.join(least, "bucket").where("id <> b").select(F.col("id").alias("a"), "b").distinct())
    docs = inside.select("id", "component").distinct().join(clusters.withColumnRenamed("component", "cluster"), "id").join(able, "id")
    docs = materialize(docs, "clusters")
    main = docs.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster").agg(F.max(F.struct("c", "component")).alias("m"))
    docs = docs.join(main.select("cluster", F.col("m.component").alias("main")), "cluster")
    # sizes of linked documents differ by less than the threshold, so classes that are no neighbours do not meet
    part = F.xxhash64("cluster", "class").alias("part")
    left = docs.where("component <> main").select(part, "id", "component")
    right = docs.select("cluster", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), "id", "component").select(part, "id", "component")
    blocks = left.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("lefts")).join(right.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("rights")), "part")
    blocks = materialize(blocks, "blocks")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    left = left.join(blocks, "part").select(F.col("part").alias("cluster"), F.pmod(F.xxhash64("id"), "lefts").alias("left"), F.explode(upto("rights")).alias("right"), "id", "component", F.lit(True).alias("is_left"))
    right = right.join(blocks, "part").select(F.col("part").alias("cluster"), F.explode(upto("lefts")).alias("left"), F.pmod(F.xxhash64("id", F.lit(1)), "rights").alias("right"), "id", "component", F.lit(False).alias("is_left"))
    asked = left.unionByName(right).join(sets, "id")
    return asked.groupBy("cluster", "left", "right").applyInArrow(_block_links(threshold), "a long, b long").distinct()


def _several(inside: DataFrame) -> DataFrame:
    """Rows of buckets with several components."""
    inside = inside.select("bucket", "id", "component")
    mixed = inside.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi")
    return join_common(inside, mixed.select("bucket", "members"), "bucket", "members").drop("members")


def _block_links(threshold: float):
    """Links across components between the left and the right documents of a block, one for each left document and other component.

    Intersections are products of 0-1 matrices over the shingles that both
    sides have, a bounded number of shingles at a time.
    """

    def run(group):
        left = np.array(group.column("is_left").to_pylist(), bool)
        ids, component = group.column("id").to_numpy(), group.column("component").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        sides = [np.flatnonzero(left), np.flatnonzero(~left)]
        links = []
        if len(sides[0]) and len(sides[1]):
            words = np.intersect1d(*(np.unique(np.concatenate([sets[r] for r in side])) for side in sides))
            both = np.zeros((len(sides[0]), len(sides[1])))
            for at in range(0, len(words), 1 << 14):
                part = words[at : at + (1 << 14)]
                flags = []
                for side in sides:
                    m = np.zeros((len(side), len(part)), np.float32)
                    for k, r in enumerate(side):
                        s = sets[r][np.searchsorted(sets[r], part[0]) : np.searchsorted(sets[r], part[-1], "right")]
                        place = np.searchsorted(part, s)
                        m[k, place[part[place] == s]] = 1
                    flags.append(m)
                both += flags[0] @ flags[1].T
            n = np.array([len(s) for s in sets])
            linked = both >= threshold * (n[sides[0]][:, None] + n[sides[1]][None, :] - both) - 1e-9
            for x, y in np.argwhere(linked & (component[sides[0]][:, None] != component[sides[1]][None, :])):
                links.append((ids[sides[0][x]], ids[sides[1][y]], component[sides[1][y]]))
        first = {(a, c): b for a, b, c in reversed(links)}
        a, b = [min(x, y) for (x, _), y in first.items()], [max(x, y) for (x, _), y in first.items()]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _exploded(batches):
    for batch in batches:
        sets = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
        ids = np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))], names=["id", "shingle"])


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``."""
    tune_arrow(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = source.mapInArrow(_sketches(bands, band_rows(threshold, bands)), "doc_id long, key binary, n long, bands array<long>")
    sketched = materialize(sketched, "sketches")
    reps = sketched.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "bands")).alias("r"))
    reps = materialize(reps.select("key", F.col("r.doc_id").alias("id"), F.col("r.bands").alias("bands")), "representatives")
    texts = source.withColumnRenamed("doc_id", "id")

    spread = reps.select("id", F.posexplode("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("bucket"), "id")
    order = [F.min(F.struct(F.xxhash64("id", F.lit(k)), F.col("id"))).alias(f"h{k}") for k in range(HUBS)]
    buckets = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), *order).where("size > 1")
    buckets = buckets.select("bucket", "size", F.array_distinct(F.array(*[F.col(f"h{k}.id") for k in range(HUBS)])).alias("hubs"))
    spread = materialize(spread, "spread")
    inside = materialize(join_common(spread, buckets, "bucket", "size"), "buckets")
    starred = inside.select(F.explode("hubs").alias("hub"), "id").where("hub <> id")
    small = inside.where(F.col("size").between(3, SMALL)).select("bucket", "id")
    paired = small.join(small.select("bucket", F.col("id").alias("hub")), "bucket").where("hub < id").select("hub", "id")
    pairs = starred.unionByName(paired).select(F.least("hub", "id").alias("hub"), F.greatest("hub", "id").alias("id")).distinct()

    checked = verify(pairs, texts)
    links = checked.where(F.col("both") >= F.lit(threshold) * (F.col("n") + F.col("n_hub") - F.col("both")) - 1e-9)
    links = materialize(links.select(F.col("hub").alias("a"), F.col("id").alias("b")), "links")
    labels = components(links)
    large = inside.where(F.col("size") > SMALL).select("bucket", "id")
    more = materialize(_open_links(large, labels, texts, threshold), "more_links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    named = reps.select("key", F.col("id").alias("rep")).join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select(F.col("key"), F.coalesce("component", "rep").alias("component_id"))
    whole = sketched.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that are linked to one of a smaller id."""
    found = near_components(docs, id_col, text_col, **options)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__nd_id"))
    gone = materialize(gone, "copies")
    return docs.join(gone.hint("merge"), F.col(id_col).cast("long") == F.col("__nd_id"), "left_anti")


def op5_near_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_components(docs, threshold=0.85)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words))
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS id, doc_id AS at FROM documents
  UNION
  SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.at
)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.at) AS component_id, d.doc_id = min(r.at) AS kept
FROM documents d JOIN reach r ON r.id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id
"""
