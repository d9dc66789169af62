"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds the hashes of all its prefixes: sums of code
points times powers of a base, modulo 2**31 - 1, for two bases.  The hash of any
span is a difference of two of them over a power, so spans are compared in
constant time and the longest common extension of two positions is found by
binary search.  The prefix array of an edited text keeps the part before the
edit.

A fingerprint is the text's length, the two hashes of the whole and two
bottom-k samples of span hashes: of all spans of 12 code points for texts of
32 or more, and of all spans of 3 for texts under 64.  The likeness of two
fingerprints estimates the share of spans that the texts have in common (the
Dice coefficient) on the longest span length that both have.

Every document also meets the next one by id.  Rows are dealt out by ranges of
ids, and the first document of a range goes to the range before it too, so
each task streams its documents in order and holds two texts at a time.

Defined results: a null text is empty; an empty text has likeness 1 to an empty
one and 0 to others; rows go by (id, text), null ids last, repeated rows follow
each other; a single row is followed by itself; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, tune_arrow

M = np.uint64((1 << 31) - 1)
BASES = (48_271, 1_583_458_089)
SPAN, SHORT_SPAN = 12, 3
LONG_FROM, SHORT_TO = 32, 64
SAMPLE = 64
LAST = (1 << 63) - 1


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1 for x below 2**62."""
    x = (x & M) + (x >> np.uint64(31))
    x = (x & M) + (x >> np.uint64(31))
    return np.where(x == M, np.uint64(0), x)


class Powers:
    """Powers of a base and of its inverse, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, int(M))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, _mod(self.up * np.uint64(pow(self.base, k, int(M))))])
            self.down = np.concatenate([self.down, _mod(self.down * np.uint64(pow(self.inverse, k, int(M))))])


POWERS = [Powers(b) for b in BASES]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


class PrefixHash:
    """The prefix arrays of a text."""

    def __init__(self, code: np.ndarray, prefix: list[np.ndarray] | None = None):
        """``prefix`` holds arrays of a beginning of the text that is known already."""
        n = len(code)
        self.n, self.prefix = n, []
        for p, power in enumerate(POWERS):
            power.upto(n + 1)
            known = prefix[p] if prefix else np.zeros(1, np.uint64)
            k = len(known) - 1
            terms = _mod(code[k:] * power.up[k:n])
            out = np.empty(n + 1, np.uint64)
            out[: k + 1] = known
            out[k + 1 :] = _mod(known[-1] + np.cumsum(terms, dtype=np.uint64))
            self.prefix.append(out)

    def edited(self, keep: int, tail: np.ndarray, code: np.ndarray) -> PrefixHash:
        """Of the text's first ``keep`` code points followed by ``tail``."""
        return PrefixHash(np.concatenate([code[:keep], tail]), [p[: keep + 1] for p in self.prefix])

    def span(self, start: int, end: int) -> tuple[int, ...]:
        m = int(M)
        return tuple((int(p[end]) - int(p[start])) * int(w.down[start]) % m for p, w in zip(self.prefix, POWERS, strict=True))

    def equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(other_start, other_start + length)

    def common_extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """Length of the longest common span from the two positions on."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, length: int) -> np.ndarray:
        """Hashes of all spans of a length."""
        if self.n < length:
            return np.zeros(0, np.uint64)
        p, w = self.prefix[0], POWERS[0]
        return _mod(_mod(p[length:] + (M - p[:-length])) * w.down[: self.n - length + 1])

    def sample(self, length: int) -> np.ndarray:
        """The least of the mixed span hashes, distinct and sorted, as 32-bit numbers."""
        h = self.spans(length) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
        if len(h) > 16 * SAMPLE:
            least = np.unique(np.partition(h, 4 * SAMPLE)[: 4 * SAMPLE])
            if len(least) > SAMPLE:
                return least[:SAMPLE]
        return np.unique(h)[:SAMPLE]

    def fingerprint(self) -> str:
        whole = "".join(f"{x:08x}" for x in self.span(0, self.n))
        parts = [self.sample(SHORT_SPAN) if self.n < SHORT_TO else (), self.sample(SPAN) if self.n >= LONG_FROM else ()]
        return f"{self.n:x}-{whole}-" + "-".join(np.array(p, ">u4").tobytes().hex() for p in parts)


def likeness(a: str, b: str) -> float:
    """From 0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = a.split("-"), b.split("-")
    for k in (3, 2):
        if x[k] and y[k]:
            p, q = (np.frombuffer(bytes.fromhex(s[k]), ">u4") for s in (x, y))
            least = np.union1d(p, q)[:SAMPLE]
            share = len(np.intersect1d(np.intersect1d(p, q), least)) / len(least)
            return 2 * share / (1 + share)
    return 0.0


class _Row:
    def __init__(self, doc_id, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.code = codes(self.text)
        self.hash = PrefixHash(self.code)
        self.fingerprint = self.hash.fingerprint()


FIELDS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long")


def _judged(row: _Row, following: _Row) -> tuple:
    n = len(row.code)
    k = n // 4
    text = row.text[: n - k] + following.text[:k]
    changed = row.hash.edited(n - k, following.code[:k], row.code) if k else row.hash
    print_ = changed.fingerprint() if k else row.fingerprint
    return (
        row.doc_id,
        n,
        hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
        row.fingerprint,
        print_,
        likeness(row.fingerprint, print_),
        likeness(row.fingerprint, following.fingerprint),
        row.hash.common_extension(0, changed, 0),
        row.hash.common_extension(0, following.hash, 0),
    )


def _stream(batches):
    """Rows of ranges, each sorted, its follower last."""
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, *[pa.int64()] * 2]
    names = [f.split()[0] for f in FIELDS.split(", ")]
    before, range_ = None, None
    for batch in batches:
        out = []
        for part, tail, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if part != range_:
                before, range_ = None, part
            if tail and before is None:
                continue
            row = _Row(doc_id, text)
            if before is not None:
                out.append(_judged(before, row))
            before = None if tail else row
        columns = zip(*out, strict=True) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def range_of(key: Column, splits: list[int], first: int = 0) -> Column:
    """The number of ``splits`` (ascending) up to a key, plus ``first``: a tree of comparisons, as deep as the logarithm of their number."""
    if not splits:
        return F.lit(first)
    k = len(splits) // 2
    return F.when(key < splits[k], range_of(key, splits[:k], first)).otherwise(range_of(key, splits[k + 1 :], first + k + 1))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs`` with its fingerprint and what becomes of it in an edit; see ``FIELDS``."""
    tune_arrow(docs.sparkSession)
    n = shuffle_partitions(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    splits = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 20_000)).first()[0] or []
    splits = sorted(set(splits))
    part = range_of(key, splits).cast("int")
    slim = docs.select(part.alias("part"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    firsts = dict(slim.select("part", F.coalesce("doc_id", F.lit(LAST)).alias("k")).groupBy("part").agg(F.min("k")).collect())
    ranges = sorted(firsts)
    before = {p: ranges[i - 1] for i, p in enumerate(ranges)}
    first = F.array(*[F.lit(firsts.get(p)).cast("long") for p in range(len(splits) + 1)])
    goes = F.array(*[F.lit(before.get(p, 0)) for p in range(len(splits) + 1)])
    is_first = F.coalesce("doc_id", F.lit(LAST)) == F.get(first, F.col("part"))
    here = F.struct(F.col("part"), F.lit(False).alias("tail"))
    there = F.struct(F.get(goes, F.col("part")).alias("part"), F.lit(True).alias("tail"))
    dealt = slim.withColumn("to", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))))
    dealt = dealt.select(F.col("to.part").alias("part"), F.col("to.tail").alias("tail"), "doc_id", "text").repartitionById(n, F.col("part"))
    return dealt.sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_last(), "text").mapInArrow(_stream, FIELDS)


def op6_fingerprints(spark, sf_dir):
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
