"""Line dedup: lines that many documents share go everywhere but in one document.

Lines become rows of a 128-bit hash of their key, document and position.  They
are range-partitioned by hash *and document*, so that a line which a third of
all documents hold spreads over many partitions, and sorted within a partition
by hash, document and position.  A stream over each partition meets every first
occurrence of a line in a document and returns one short row for each run of a
hash; runs that a partition border cuts are added up afterwards.  The decisions
come back as a compressed keep bitmap for each document that loses a line;
texts move only where a caller asks for them.

Defined results: a null or empty text is one empty line; rows with the same
document id are one document when documents are counted, and the bitmap of a
row belongs to its id and text, so repeated rows lose the same lines; a null id
counts as one document, the smallest; an empty table gives an empty result;
further columns stay (names starting ``__ld_`` are reserved).
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, join_common, materialize, shuffle_partitions, tune_arrow

MIN_CHARS = 40
MIN_DOCS = 5


def split_lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def line_key(line: bytes) -> bytes:
    return line.strip(ASCII_SPACE).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    """UTF-8 has one to four bytes a code point; only keys between need decoding."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def pack_bitmap(n_lines: int, dropped) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[np.asarray(dropped, dtype=np.int64)] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def unpack_bitmap(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which lines stay; all of them where there is no bitmap."""
    if bitmap is None:
        return np.ones(n_lines, bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines, bitorder="little").astype(bool)


def _lines(min_chars: int):
    def run(batches):
        for batch in batches:
            ids, marks, texts = (batch.column(i) for i in range(3))
            keys, rows, positions, counts = [], [], [], []
            for r, text in enumerate(texts.cast(pa.binary()).to_pylist()):
                lines = split_lines(text)
                for p, line in enumerate(lines):
                    if len(line) >= min_chars and _long_enough(key := line_key(line), min_chars):
                        keys.append(xxhash.xxh3_128_digest(key))
                        rows.append(r)
                        positions.append(p)
                        counts.append(len(lines))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), ids.take(at), marks.take(at), pa.array(positions, pa.int32()), pa.array(counts, pa.int32())],
                names=["line", "doc_id", "mark", "pos", "n_lines"],
            )

    return run


def _runs(batches):
    """Of rows sorted by line and document: (line, rows, documents, largest document) for every run of a line."""
    line = doc = None
    docs = rows = 0
    for batch in batches:
        out = []
        for h, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if h != line:
                if line is not None:
                    out.append((line, rows, docs, doc))
                line, doc, docs, rows = h, d, 1, 1
                continue
            rows += 1
            if d != doc:  # the first occurrence in the next document
                doc, docs = d, docs + 1
        yield _run_batch(out)
    if line is not None:
        yield _run_batch([(line, rows, docs, doc)])


def _run_batch(out):
    line, rows, docs, last = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(line, pa.binary()), pa.array(rows, pa.int64()), pa.array(docs, pa.int64()), pa.array(last, pa.int64())], names=["line", "rows", "docs", "last"])


def _bitmaps(batches):
    for batch in batches:
        ids, marks, lines, dropped = (batch.column(i) for i in range(4))
        maps = [pack_bitmap(n, p) for n, p in zip(lines.to_pylist(), dropped.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([ids, marks, pa.array(maps, pa.binary())], names=["__ld_id", "__ld_mark", "__ld_keep"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(``__ld_id``, ``__ld_mark``, ``__ld_keep``) for each document, known by id and a hash of its text, that loses lines."""
    spark = docs.sparkSession
    tune_arrow(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    lines = slim.mapInArrow(_lines(min_chars), "line binary, doc_id long, mark long, pos int, n_lines int")
    lines = materialize(lines, "lines")
    dealt = lines.select("line", "doc_id", "pos").repartitionByRange(shuffle_partitions(spark), "line", "doc_id").sortWithinPartitions("line", "doc_id", "pos")
    runs = dealt.mapInArrow(_runs, "line binary, rows long, docs long, last long")
    shared = runs.groupBy("line").agg(F.sum("rows").alias("rows"), F.sum("docs").alias("docs"), F.max("last").alias("last"))
    shared = shared.where(F.col("docs") >= min_docs).select("line", "rows", "last")
    gone = join_common(lines, shared, "line", "rows").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = gone.groupBy("doc_id", "mark").agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("dropped"))
    return materialize(gone.select("doc_id", "mark", "n_lines", "dropped").mapInArrow(_bitmaps, "__ld_id long, __ld_mark long, __ld_keep binary"), "bitmaps")


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``__ld_keep``, null where every line stays."""
    maps = keep_bitmaps(docs, id_col, text_col, **options)
    on = F.col(id_col).cast("long").eqNullSafe(F.col("__ld_id")) & (F.xxhash64(text_col) == F.col("__ld_mark"))
    return docs.join(maps.hint("merge"), on, "left").select(*[docs[c] for c in docs.columns], "__ld_keep")


def _kept(text: bytes | None, bitmap: bytes | None) -> tuple[int, int, bytes]:
    lines = split_lines(text)
    if bitmap is None:
        return len(lines), 0, text or b""
    keep = unpack_bitmap(bitmap, len(lines))
    return len(lines), int(len(lines) - keep.sum()), b"\n".join(x for x, k in zip(lines, keep, strict=True) if k)


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """``docs`` with the lines that go taken out of ``text_col``.

    A text that loses nothing stays as it is, null included.  ``length_col``,
    if there is one of this name, gets the new length of a text that changed.
    """
    marked = with_bitmaps(docs, id_col, text_col, **options)
    schema = docs.schema
    at, names = docs.columns.index(text_col), docs.columns
    length = names.index(length_col) if length_col in names else None

    def run(batches):
        for batch in batches:
            arrays = [batch.column(i) for i in range(len(names))]
            keep = batch.column(len(names))
            texts = [t if k is None else _kept(t, k)[2] for t, k in zip(arrays[at].cast(pa.binary()).to_pylist(), keep.to_pylist(), strict=True)]
            arrays[at] = pa.array(texts, pa.binary()).cast(pa.string())
            if length is not None:
                arrays[length] = pc.if_else(keep.is_null(), arrays[length], pc.utf8_length(arrays[at]).cast(arrays[length].type))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return marked.mapInArrow(run, schema)


def _digests(batches):
    for batch in batches:
        n_lines, n_dropped, sha = [], [], []
        for text, bitmap in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n, gone, kept = _kept(text, bitmap)
            n_lines.append(n)
            n_dropped.append(gone)
            sha.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def op10_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_bitmaps(docs).mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, lower_key
  FROM (
    SELECT doc_id, pos, line,
           translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))
),
shared AS (
  SELECT lower_key, max(doc_id) AS last FROM lines WHERE length(lower_key) >= 40
  GROUP BY lower_key HAVING count(DISTINCT doc_id) >= 5
),
marked AS (
  SELECT l.doc_id, l.pos, l.line, s.last IS NOT NULL AND l.doc_id <> s.last AS gone
  FROM lines l LEFT JOIN shared s ON l.lower_key = s.lower_key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
