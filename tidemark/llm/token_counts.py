"""Token counts by a linear longest-match automaton.

Word pieces are taken greedily, the longest that the vocabulary has.  The
pieces form a trie whose nodes have a failure link, to where matching goes on
when no child fits, and the number of pieces that are given out on the way.
Both are worked out once for every node, so counting takes time linear in the
word, never goes back and never builds a piece.

Words are what the vocabulary's tokenizer takes apart: texts are composed (NFC)
and lower-cased letter by letter, and parted into contractions, runs of letters,
single digits and runs of other characters, as UTF-8 bytes with an end mark.  A
word that pieces cannot cover counts as one unknown token.  Counts of
white-space-delimited words are remembered within bounds.

Defined results: null and empty texts and white space have 0 tokens; strings of
special tokens are text like any other; bytes that are no UTF-8 read as U+FFFD; repeated
rows are counted each; an empty table gives an empty result; in ``counted``
further columns stay (the name ``__tc_tokens`` is reserved).
"""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stretches, tune_arrow

# fixed values: the vocabulary's contractions and kinds of words
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: The symbol after a word's last byte.
END = 256


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read_pieces(path: str, suffix: str = "</w>") -> list[tuple[int, ...]]:
    """The vocabulary's pieces as symbols; special tokens, which no word holds, are left out."""
    letters = byte_letters()
    out = []
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    for piece in vocabulary:
        last = piece.endswith(suffix) and piece != suffix
        body = piece[: -len(suffix)] if last else piece
        if body and all(c in letters for c in body):
            out.append((*(letters[c] for c in body), *[END] * last))
    return out


class Automaton:
    """Trie, failure links and popped counts of a vocabulary of symbol tuples."""

    def __init__(self, pieces):
        self.child: dict[int, int] = {}  # node * 512 + symbol -> node
        order, whole = [(-1, -1)], {0: False}
        for piece in pieces:
            node = 0
            for s in piece:
                at = node * 512 + s
                nxt = self.child.get(at)
                if nxt is None:
                    nxt = self.child[at] = len(order)
                    order.append((node, s))
                    whole[nxt] = False
                node = nxt
            whole[node] = node != 0
        n = len(order)
        depth = [0] * n
        for v in range(1, n):
            depth[v] = depth[order[v][0]] + 1
        #: -1: no way on.
        self.fail, self.popped = [-1] * n, [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            if whole[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            up, s = order[v]
            z, count = self.fail[up], self.popped[up]
            while z >= 0 and z * 512 + s not in self.child:
                count += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.child[z * 512 + s], count

    def count(self, symbols) -> int:
        """Number of greedy pieces; 1 where pieces cannot cover the word."""
        child, fail, popped = self.child, self.fail, self.popped
        node = total = 0
        for s in symbols:
            nxt = child.get(node * 512 + s)
            while nxt is None:
                if fail[node] < 0:
                    return 1
                total += popped[node]
                node = fail[node]
                nxt = child.get(node * 512 + s)
            node = nxt
        while node:
            if fail[node] < 0:
                return 1
            total += popped[node]
            node = fail[node]
        return total


def words(text: str) -> list[str]:
    """The words of a text as the vocabulary's tokenizer has them."""
    if text.isascii():
        return WORDS.findall(text.lower())
    # letter by letter: a sigma that ends a word stays an ordinary one
    return WORDS.findall("".join(map(str.lower, unicodedata.normalize("NFC", text))))


class Counter:
    def __init__(self, path: str, remember: int = 600_000):
        self.automaton, self.known, self.size = Automaton(read_pieces(path)), {}, remember

    def word(self, word: bytes) -> int:
        count = self.automaton.count
        return sum(count((*w.encode(), END)) for w in words(word.decode("utf-8", "replace")))

    def __call__(self, texts: list[bytes | None]) -> list[int]:
        texts = [(t or b"").split() for t in texts]
        words = set()
        for t in texts:
            words.update(t)
        missing = words - self.known.keys()
        if len(self.known) + len(missing) > self.size:
            self.known, missing = {}, words
        for w in missing:
            self.known[w] = self.word(w)
        find = self.known.__getitem__
        return [sum(map(find, t)) for t in texts]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """A Python worker builds the automaton once and keeps it between tasks."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def counted(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``__tc_tokens``."""
    tune_arrow(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        count = counter(path)
        for batch in batches:
            found = [n for part in stretches(batch.column(at).cast(pa.binary()).to_pylist()) for n in count(part)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*names, "__tc_tokens"])

    schema = docs.schema.__class__(docs.schema.fields[:])
    return docs.mapInArrow(run, schema.add("__tc_tokens", "long"))


def op3_token_counts(spark, sf_dir):
    out = counted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("__tc_tokens").alias("n_tokens"))
