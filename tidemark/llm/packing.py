"""Packing documents into sequences: first-fit decreasing with a tournament tree.

A document is tokenized once, white-space-delimited word by word through a
cache, and cut into full pieces of the sequence length and one shorter rest.
The rests are dealt at random, by a seeded hash of what they hold and of their
place in their partition, into groups of a few thousand;
each group is packed on its own by first-fit decreasing.  A tournament tree
over the bins' free room finds the first bin with room in logarithmic time.
Only (id, length) rows move, never tokens or texts: the checksum of a piece is
taken where its document is read.

Defined results: a null or empty text is its end token alone; repeated rows
are packed as documents of their own; equal lengths go by document id, start
and checksum; an empty table gives no sequences; further columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, tune_arrow

CAPACITY = 2048
END_ID = 1
#: Rests in a group, about.
GROUP = 4096
#: Words that a Python worker keeps the ids of, about 200 bytes each.
CACHE = 1_200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    The tokenizer's normaliser folds white space and its pre-tokenizer never
    joins across it, so the ids of a text are those of its words in a row.
    Words are kept in two generations, so that frequent ones outlast the
    flood of words that are seen once; a Python worker keeps them between tasks.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        # an executor's cores run tasks of their own; more threads only get in their way
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.size, self.known, self.older = Tokenizer.from_file(path), cache, {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.tail: dict[bytes, bytes] = {}
        marks = [b".", b",", b";", b":", b"!", b"?"]
        self.learn(marks)
        self.tail = {m: self.known[m] for m in marks}

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Arrow parts the texts and numbers their distinct words; only those are looked up, and numpy puts their ids in a row."""
        parted = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = parted.flatten().dictionary_encode()
        words, place = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        if len(self.known) > self.size // 2:
            self.older, self.known = self.known, {}
        ids = list(map(self.known.get, words))
        if None in ids:
            self.meet([w for w, x in zip(words, ids, strict=True) if x is None])
            ids = [self.known[w] if x is None else x for w, x in zip(words, ids, strict=True)]
        pool = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        length = size[place]
        end = np.concatenate([[0], np.cumsum(length)])
        # the place in the pool of each token: its word's first, plus how far into the word it is
        row = pool[np.arange(end[-1]) + np.repeat(first[place] - end[:-1], length)]
        cut = end[np.concatenate([[0], np.cumsum(parted.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)].tolist()
        return [row[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def meet(self, words: list[bytes]) -> None:
        """Makes words known."""
        simple, new = {}, set()
        for w in words:
            if (ids := self.older.get(w)) is not None:
                self.known[w] = ids
                continue
            core = simple[w] = self.core(w)
            if core not in self.known:
                if (ids := self.older.get(core)) is not None:
                    self.known[core] = ids
                else:
                    new.add(core)
        self.learn(list(new))
        for w, core in simple.items():
            if w != core:
                self.known[w] = self.known[core] + (self.tail[w[-1:]] if len(w) > len(core) else b"")

    def core(self, word: bytes) -> bytes:
        """What is left to tokenize of a word: the tokenizer lower-cases letters itself, and a mark after letters is a token apart."""
        if b"<" in word:
            return word  # perhaps a special token, which is matched before lower-casing
        low = word.lower()
        if low[-1:] in self.tail and low[:-1].decode("utf-8", "replace").lower().isalpha():
            return low[:-1]
        return low

    def learn(self, words: list[bytes]) -> None:
        """Words of letters only are tokenized many in one text, and their ids parted where a token ends a word."""
        words = [(w, w.decode("utf-8", "replace")) for w in words]
        plain = [x for x in words if x[1].isalpha()]
        other = [x for x in words if not x[1].isalpha()]
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            ids = np.array(self.tokenizer.encode(" ".join([t for _, t in part]), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):  # a word that lower-casing takes apart
                other += part
                continue
            raw, at = ids.tobytes(), 0
            for (w, _), end in zip(part, (4 * ends).tolist(), strict=True):
                self.known[w] = raw[at:end]
                at = end
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            for (w, _), e in zip(part, self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ``lengths`` come largest first.

    ``room[1]`` of the tree is the largest free room of all bins; going down to
    the left child whenever it has room finds the first bin that fits.
    """
    n = len(lengths)
    leaves = 1
    while leaves < n:
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, need in enumerate(lengths.tolist()):
        k = 1
        while k < leaves:
            k *= 2
            if room[k] < need:
                k += 1
        bins[i], offsets[i] = k - leaves, capacity - room[k]
        room[k] -= need
        while k > 1:
            k //= 2
            best = room[2 * k] if room[2 * k] >= room[2 * k + 1] else room[2 * k + 1]
            if room[k] == best:
                break
            room[k] = best
    return bins, offsets


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        tokens = word_tokens(path)
        end, before = struct.pack("<I", end_id), 0
        for batch in batches:
            rows, start, length, crc, total = [], [], [], [], []
            for r, ids in enumerate(ids for part in slices(batch.column(1)) for ids in tokens(part)):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    piece = ids[4 * s : 4 * (s + capacity)]
                    rows.append(r)
                    start.append(s)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total, np.array(rows, np.int64) + before)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"],
            )
            before += len(batch)

    return run


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document cut into full pieces and a rest; ``place`` counts the rows of a partition."""
    tune_arrow(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity, end_id), PIECE + ", place long")


def _pack(capacity: int):
    def run(key, group):
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), capacity)
        sequence = pa.array((key[0].as_py() << 24) + bins, pa.int64())
        group = group.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return group.append_column("sequence_id", sequence).append_column("offset", pa.array(offsets, pa.int64()))

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, seed: int = 9, **options) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece."""
    cut = materialize(pieces(docs, capacity=capacity, **options), "pieces")
    groups = max(1, round(cut.count() / group))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "place"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_pack(capacity), PIECE + ", sequence_id long, offset long")


def op9_packing(spark, sf_dir):
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
