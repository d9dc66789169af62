"""Toxicity by weak supervision.

Voters are found, not given.  A text's features are its words (a lexicon) and
patterns: word beginnings (``lowe*``), word ends (``*weig``), runs of letters
anywhere in a word (``*owei*``) and pairs of neighbouring words.  A word is also
read in its plain spelling: without accents, digits and signs read as the
letters they stand for, marks inside it left out, stretched letters shortened,
single letters in a row put together.  Every feature whose share of toxic and
of clean training documents differs beyond chance takes part; none is left out
by number.  Those with a clear tendency vote, for toxic or for clean, and
abstain where they do not occur; features that occur in the same documents are
one voter.

A generative label model over two hidden classes estimates by EM how many votes
a document of either class gets and which share of them each voter casts (its
accuracy), so that what voters of one language leave unsaid tells nothing about
texts in another.  The given label is one more voter, whose two rates of error
are estimated too.  Voters that fire
together within a class are not independent: their correlations given the class
are estimated from the posteriors and a voter's evidence is divided by the sum
of its correlations.  A logistic regression over all the features is then
trained on the posterior labels, and it alone scores texts.

The training sample is bounded: ``per_class`` documents of either label, the
first in a seeded hash order, each text once.  What the driver holds follows
from it: the features that differ beyond chance there, and the sample's rows in
their terms.  Scoring reads every whole text, without a shuffle, with the model
in the tasks' closure.

Defined results: null and empty texts are scored like texts without any
feature; without labelled rows of both classes every score is 0; a label that
is null is none; documents with several labels count as toxic if one says so,
as do equal texts with different labels; repeated rows are scored alike; an
empty table gives an empty result; further columns stay in ``scored`` (names
starting ``__tox_`` are reserved).
"""

from __future__ import annotations

import re
import unicodedata
from itertools import chain
from statistics import NormalDist

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered_slices, slices, tune_arrow

PARTS = re.compile(r"\w+")
#: Lengths of word beginnings and ends, and of runs of letters anywhere.
ENDS = (3, 4, 5, 6)
RUNS = (4, 5)
PER_CLASS = 6000
#: Toxic training documents that a feature must occur in: fewer are never beyond chance.
LEAST = 3
#: Deviations between a feature's shares in toxic and clean documents from which it takes part at least, and from which it votes.
BEYOND_CHANCE = 3.0
CLEAR = 5.0
#: How many times as often a feature occurs in the documents of one class as in those of the other.
LIFT = 1.5
#: How many times as many deviations a pattern has that makes what implies it superfluous.
SURER = 1.2
#: How much smaller a share of its documents may be of the class that it speaks for.
AS_PURE = 0.03
#: How many times as often a voter occurs in the documents of the class it votes for.
TENDENCY = 3.0
#: Deviations from which a weight is hardly shrunk.
SIGNIFICANT = 8.0
THRESHOLD = 0.3
#: What toxic documents weigh in the classifier's training, of 1.
TOXIC_WEIGHT = 0.3

STRETCHED = re.compile(r"(.)\1{2,}")


class _Letters(dict):
    """Translation of characters: what digits and signs stand for, and no accents."""

    def __missing__(self, code: int):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        self[code] = bare
        return bare


LETTERS = _Letters({ord(a): b for a, b in zip("013457@$!|", "oieastasil")})


#: Marks, and those around a token but for signs that may begin a word.
MARKS, OUTER = re.compile(r"[^\w\n]+"), re.compile(r"^[^\w@$\n]+|[^\w\n]+$", re.M)


def words_of(tokens: list[str]) -> tuple[list[str], list[str]]:
    """The words of each token (what stands between white space), a space between them: as written, and in plain spelling as well.

    Both are lower-cased.  Plain spelling has no accents, letters for digits and
    signs, and neither marks inside a word nor stretched letters.
    """
    line = "\n".join(tokens).lower()
    written = MARKS.sub(" ", line).split("\n")
    bare = OUTER.sub("", line)
    simple = STRETCHED.sub(r"\1", MARKS.sub("", bare.translate(LETTERS)))
    if simple == line:
        return written, written
    return written, [w if s == w or not s or s in w.split(" ") or b.isdigit() else f"{w} {s}" for w, s, b in zip(written, simple.split("\n"), bare.split("\n"))]


def patterns(word: str) -> set[str]:
    """The word itself, its beginnings, ends and runs of letters."""
    n, out = len(word), {word}
    for k in ENDS:
        if n >= k:
            out.add(word[:k] + "*")
            out.add("*" + word[-k:])
    for k in RUNS:
        out.update(["*" + word[i : i + k] + "*" for i in range(n - k + 1)])
    return out


def implied(feature: str) -> set[str]:
    """Patterns that occur wherever ``feature`` does; of a pair, its words and their patterns."""
    out = set()
    for w in feature.replace("-", " ").split(" "):
        first, last = w.startswith("*"), w.endswith("*")
        for f in patterns(w.strip("*")):
            at_start, at_end = not f.startswith("*"), not f.endswith("*")
            if not (at_start and first or at_end and last):
                out.add(f)
    out.discard(feature)
    return out


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """The texts' tokens: row, number of the distinct token, the distinct tokens; and whether the next one stands beside it.

    Single letters in a row, three at least, are one more token of their row.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    rows, ids = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False)), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    tokens = coded.dictionary.to_pylist()
    size = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
    if (size == 0).any():
        full = size[ids] > 0
        rows, ids = rows[full], ids[full]
    beside = np.append(rows[1:] == rows[:-1], False) if len(rows) else np.zeros(0, bool)
    letter = size == 1
    letter[letter] = [tokens[i].isalnum() for i in np.flatnonzero(letter)]
    single = letter[ids]
    if single.any():
        # where runs of single letters in one row begin and end
        edge = np.diff(np.concatenate([[0], (single[:-1] & single[1:] & beside[:-1]).view(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        more = [(rows[a], "".join(tokens[i] for i in ids[a : b + 1])) for a, b in zip(begin, end) if b - a > 1]
        if more:
            number = {w: i for i, w in enumerate(tokens)}
            rows, ids = np.concatenate([rows, [r for r, _ in more]]), np.concatenate([ids, [number.setdefault(w, len(number)) for _, w in more]])
            tokens, beside = list(number), np.append(beside, np.zeros(len(more), bool))
    return rows, ids, tokens, beside


def _distinct(rows: np.ndarray, features: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, feature) once, in order."""
    key = np.sort(rows * max(m, 1) + features)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key // max(m, 1), key % max(m, 1)


def _expanded(rows: np.ndarray, ids: np.ndarray, token: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every occurrence of a token from the features of each distinct one, (token, feature) in order."""
    size = np.bincount(token, minlength=n)
    some = size[ids] > 0
    rows, ids = rows[some], ids[some]
    begin, k = (np.cumsum(size) - size)[ids], size[ids]
    step = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    return np.repeat(rows, k), feature[np.repeat(begin, k) + step]


def _occurrences(rows: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct token of each row once."""
    return _distinct(rows, ids, n)


def _core(words: str) -> str:
    """A token's words as one member of a pair."""
    return words.strip().replace(" ", "-")


def all_features(texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    """In how many of the texts each feature occurs."""
    rows, ids, tokens, beside = tokens_of(texts)
    number: dict[str, int] = {}
    token, feature = [], []
    written, words = words_of(tokens)
    for k, line in enumerate(words):
        for f in {f for w in line.split() for f in patterns(w)}:
            token.append(k)
            feature.append(number.setdefault(f, len(number)))
    r, f = _expanded(*_occurrences(rows, ids, len(tokens)), np.array(token, np.int64), np.array(feature, np.int64), len(tokens))
    docs = np.bincount(_distinct(r, f, len(number))[1], minlength=len(number)).tolist()
    names = list(number)
    cores: dict[str, int] = {}
    core = np.array([cores.setdefault(w, len(cores)) if w else -1 for w in map(_core, written)], np.int64)[ids] if tokens else ids
    left = np.flatnonzero(beside & (core >= 0))
    left, n = left[core[left + 1] >= 0], max(len(cores), 1)
    _, pair = _distinct(rows[left], core[left] * n + core[left + 1], n * n)
    pair, times = np.unique(pair, return_counts=True)
    core = list(cores)
    names += [f"{core[a]} {core[b]}" for a, b in zip((pair // n).tolist(), (pair % n).tolist())]
    docs += times.tolist()
    return np.array(docs, np.int64), names


class Reader:
    """Finds the features ``names`` in texts, as their numbers: all patterns at once, in each distinct word once."""

    def __init__(self, names: list[str]):
        self.m = len(names)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        pairs = []
        for i, f in enumerate(names):
            if " " in f:
                pairs.append((*f.split(" ", 1), i))
            else:
                first, last = f.startswith("*"), f.endswith("*")
                self.automaton.add_word(("" if first else " ") + f.strip("*") + ("" if last else " "), i)
        self.automaton.make_automaton()
        self.empty = not len(self.automaton)
        self.member = {w: i for i, w in enumerate(dict.fromkeys(w for a, b, _ in pairs for w in (a, b)))}
        keys = np.array([self.member[a] * len(self.member) + self.member[b] for a, b, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_number = keys[order], np.array([i for *_, i in pairs], np.int64)[order]

    def _found(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(line, feature), each once, in order."""
        if self.empty or not lines:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 3)
        hits = np.fromiter(chain.from_iterable(self.automaton.iter(" " + " \n ".join(lines) + " ")), np.int64)
        return _distinct(np.searchsorted(ends, hits[::2], side="right"), hits[1::2], self.m)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature), each once, in order."""
        rows, ids, tokens, beside = tokens_of(texts)
        written, words = words_of(tokens)
        token, feature = self._found(words)
        has = np.zeros(len(tokens), bool)
        has[token] = True
        some = has[ids]
        r, f = _expanded(*_occurrences(rows[some], ids[some], len(tokens)), token, feature, len(tokens))
        if len(self.pairs) and tokens:
            member = self.member.get
            core = np.array([member(w, -1) for w in map(_core, written)], np.int64)[ids]
            left = np.flatnonzero(beside & (core >= 0))
            left = left[core[left + 1] >= 0]
            keys = core[left] * len(self.member) + core[left + 1]
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            hit = self.pairs[at] == keys
            r, f = np.concatenate([r, rows[left[hit]]]), np.concatenate([f, self.pair_number[at[hit]]])
        return _distinct(r, f, self.m)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _support(batches):
    """(feature, documents) of each stretch of texts."""
    for batch in batches:
        for texts in slices(batch.column(0)):
            docs, names = all_features(texts)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(docs, pa.int64())], names=["feature", "docs"])


def deviations(in1: np.ndarray, in0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How far shares of toxic and clean documents differ: the signed root of the likelihood ratio statistic, nearly normal where chance alone makes them differ."""
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda k, expected: np.where(k > 0, k * np.log(k / expected), 0)
        share = (in0 + in1) / (n0 + n1)
        g = part(in1, n1 * share) + part(in0, n0 * share) + part(n1 - in1, n1 * (1 - share)) + part(n0 - in0, n0 * (1 - share))
    return np.sign(in1 / n1 - in0 / n0) * np.sqrt(np.maximum(2 * g, 0))


def least_support(n1: int, n0: int) -> int:
    """Toxic documents that a feature must occur in to differ beyond chance, even where no clean one holds it."""
    k = np.arange(1, n1 + 1)
    enough = deviations(k, 0 * k, n1, n0) >= BEYOND_CHANCE
    return max(LEAST, int(np.argmax(enough)) + 1 if enough.any() else n1 + 1)


def beyond_chance(tested: int) -> float:
    """Deviations that about one of so many features reaches by chance."""
    return max(BEYOND_CHANCE, NormalDist().inv_cdf(1 - 1 / max(tested, 2)))


def enough(names: list[str], docs: np.ndarray, n1: int, n0: int) -> list[str]:
    """Features in so many toxic documents that they could differ beyond what chance does among as many features."""
    reach = deviations(np.arange(1, n1 + 1), np.zeros(n1), n1, n0)
    more = np.cumsum(np.bincount(docs, minlength=n1 + 1)[::-1])[::-1][1:]
    fits = [k for k in range(n1) if reach[k] >= beyond_chance(int(more[k]))]
    return sorted(f for f, d in zip(names, docs.tolist()) if d > fits[0]) if fits else []


def telling(names: list[str], z: np.ndarray, lift: np.ndarray) -> np.ndarray:
    """Which features differ beyond chance, and by enough, and are no special case of a surer pattern that is as pure."""
    good = (np.abs(z) >= beyond_chance(len(names))) & ((lift >= LIFT) | (lift <= 1 / LIFT))
    pure = np.where(z > 0, lift, 1 / lift)
    pure = pure / (1 + pure)
    at = {names[i]: i for i in np.flatnonzero(good)}
    for i in at.values():
        more = (k for f in implied(names[i]) if (k := at.get(f)) is not None)
        good[i] = not any(z[k] * np.sign(z[i]) > SURER * abs(z[i]) and pure[k] > pure[i] - AS_PURE for k in more)
    return good


def merged(indptr: np.ndarray, indices: np.ndarray, m: int) -> np.ndarray:
    """For each column the first column with the same rows; sums of seeded row numbers tell columns apart."""
    rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    sums = np.zeros(m, np.uint64)
    np.add.at(sums, indices, np.random.default_rng(7).integers(0, 1 << 63, len(indptr) - 1, np.uint64)[rows])
    _, first, back = np.unique(sums, return_index=True, return_inverse=True)
    return first[back]


def correlation_sums(votes: np.ndarray, post: np.ndarray, fire: np.ndarray, block: int = 256) -> np.ndarray:
    """For each voter the sum of its clear correlations, itself included, with all voters given the class.

    What is left of a vote after the class means is never held as a whole: its
    products follow from those of the votes, a block of voters at a time.
    """
    n, m = votes.shape
    if not m:
        return np.ones(0)
    p = np.stack([1 - post, post])
    held = np.stack([np.concatenate([c @ votes[:, a : a + block] for a in range(0, m, block)]) for c in p])
    inner = p @ p.T

    def left(a: int, b: int) -> np.ndarray:
        x, y, u, w = fire[:, a : a + block], fire[:, b : b + block], held[:, a : a + block], held[:, b : b + block]
        both = votes[:, a : a + block].astype(np.float32).T @ votes[:, b : b + block].astype(np.float32)
        return both - u.T @ y - x.T @ w + x.T @ inner @ y

    sd = np.sqrt(np.concatenate([np.diag(left(a, a)) for a in range(0, m, block)]).clip(1e-9))
    out = np.zeros(m)
    for a in range(0, m, block):
        for b in range(a, m, block):
            corr = left(a, b) / np.outer(sd[a : a + block], sd[b : b + block])
            corr = np.where(corr > 0.1, corr, 0)
            out[a : a + block] += corr.sum(axis=1)
            if b > a:
                out[b : b + block] += corr.sum(axis=0)
    return np.maximum(out, 1)


#: Documents with more votes than that are alike.
MANY = 6


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, dict]:
    """Posterior of toxic for each row of ``votes`` (rows x voters, 0 or 1), and the model.

    A class gives out how many votes a document gets, and which voters cast
    them, each with a share of its own (``fire`` holds how often it fires).
    ``gold`` holds the given labels.  EM starts from them.
    """
    n, m = votes.shape
    rows, columns = np.nonzero(votes)
    prior = float(np.clip(gold.mean(), 0.005, 0.995))
    post = np.where(gold == 1, 0.95, 0.05)
    for k in range(rounds):
        classes = 1 - post, post
        mass = np.array([p.sum() for p in classes])
        held = np.stack([np.bincount(columns, p[rows], m) + 0.5 for p in classes])
        fire = held / (mass[:, None] + 1)
        if k % 12 == 0:
            weight = 1 / correlation_sums(votes, post, fire)
            cast = np.bincount(rows, weight[columns], n)
            cast = np.where(cast > 0, np.clip(np.rint(cast), 1, MANY), 0).astype(int)
        share = held / (held @ weight)[:, None]
        number = np.stack([(np.bincount(cast, p, MANY + 1) + 0.5) / (p.sum() + 0.5 * (MANY + 1)) for p in classes])
        # how often the given label says toxic in either class
        said = np.clip([(gold * (1 - post)).sum() / mass[0], (gold * post).sum() / mass[1]], [0.002, 0.6], [0.2, 0.995])
        z = np.log(prior / (1 - prior)) + np.log(number[1] / number[0])[cast] + np.bincount(rows, (np.log(share[1] / share[0]) * weight)[columns], n)
        z += np.where(gold == 1, np.log(said[1] / said[0]), np.log((1 - said[1]) / (1 - said[0])))
        post = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return post, {"fire": fire, "weight": weight, "label": said}


def fit_linear(indptr: np.ndarray, indices: np.ndarray, y: np.ndarray, weight: np.ndarray, m: int, l2: np.ndarray, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels over sparse rows of ones, by accelerated steps of each coordinate's own size.

    With r features in a row, a quarter of the weighted sum of r + 1 over a
    feature's rows bounds the curvature from above coordinate by coordinate, so
    rare features take larger steps than frequent ones.  ``l2`` is each
    coordinate's own shrinkage.
    """
    rows = np.repeat(np.arange(len(y)), np.diff(indptr))
    weight = weight / weight.sum()
    load = weight * (np.diff(indptr) + 1.0) / 4
    bound, bound_b = np.bincount(indices, load[rows], minlength=m) + l2, load.sum()
    w, b = np.zeros(m), 0.0
    vw, vb = w.copy(), b
    for k in range(steps):
        z = np.bincount(rows, vw[indices], minlength=len(y)) + vb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        nw = vw - (np.bincount(indices, g[rows], minlength=m) + l2 * vw) / bound
        nb = vb - g.sum() / bound_b
        momentum = k / (k + 3)
        vw, vb = nw + momentum * (nw - w), nb + momentum * (nb - b)
        w, b = nw, nb
    return w, b


def fit(indptr: np.ndarray, indices: np.ndarray, gold: np.ndarray, m: int, z: np.ndarray, lift: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept from the sample's rows in terms of ``m`` features, each with its deviations and its lift."""
    votes_for = np.where(z > 0, lift, 1 / lift)
    clear = (np.abs(z) >= CLEAR) & (votes_for >= TENDENCY)
    voters = np.flatnonzero(clear & (merged(indptr, indices, m) == np.arange(m)))
    votes = np.zeros((len(gold), len(voters)), np.uint8)
    column = np.full(m, -1)
    column[voters] = np.arange(len(voters))
    rows = np.repeat(np.arange(len(gold)), np.diff(indptr))
    cast = column[indices] >= 0
    votes[rows[cast], column[indices[cast]]] = 1
    post, _ = label_model(votes, gold)
    # missing a toxic document costs more than its share of the labels
    n = np.bincount(gold, minlength=2)
    weight = np.where(gold == 1, TOXIC_WEIGHT / n[1], (1 - TOXIC_WEIGHT) / n[0])
    # what may be chance explains a document only where nothing surer does
    shrink = 1e-5 * (SIGNIFICANT / np.clip(np.abs(z), 1, SIGNIFICANT)) ** 4
    return fit_linear(indptr, indices, post, weight * len(gold), m, shrink)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> tuple[list[str], np.ndarray, float]:
    """Features, weights and intercept, learnt from labelled rows outside the held-out fold.

    At most ``per_class`` toxic and twice as many clean documents are read.
    """
    nothing = [], np.zeros(0), -np.inf
    tune_arrow(docs.sparkSession)
    given = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    given = materialize(given, "given")
    # a few thousand ids of either class: at most 3 * per_class rows of 12 bytes are broadcast
    picked = [given.where(F.col("toxic") == y).orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(per_class * (2 - y)) for y in (0, 1)]
    picked = materialize(picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("__tox_id"), F.col("toxic").cast("int").alias("toxic")), "picked")
    slim = docs.select(F.col(id_col).alias("__tox_doc"), F.col(text_col).alias("text"))
    sample = slim.join(F.broadcast(picked), F.col("__tox_doc") == F.col("__tox_id")).select("text", "toxic")
    # each text once, copies say nothing new; dealt anew, as few partitions hold most of a large table's sample
    n_parts = max(8, docs.sparkSession.sparkContext.defaultParallelism)
    sample = materialize(sample.groupBy("text").agg(F.max("toxic").alias("toxic")).repartition(n_parts, F.xxhash64("text")), "sample")
    count = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not count.get(0) or not count.get(1):
        return nothing
    n0, n1 = count[0], count[1]
    support = sample.where("toxic = 1").select("text").mapInArrow(_support, "feature string, docs long")
    support = support.groupBy("feature").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_support(n1, n0)).toArrow()
    names = enough(support.column("feature").to_pylist(), support.column("docs").to_numpy(), n1, n0)
    if not names:
        return nothing

    def counted(batches):
        read, counts = Reader(names), np.zeros((2, len(names)), np.int64)
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for at, texts in numbered_slices(batch.column(0)):
                rows, found = read(texts)
                y = toxic[at + rows]
                for k in (0, 1):
                    counts[k] += np.bincount(found[y == k], minlength=len(names))
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[0, some]), pa.array(counts[1, some])], names=["feature", "in0", "in1"])

    counts = sample.select("text", "toxic").mapInArrow(counted, "feature long, in0 long, in1 long").groupBy("feature").agg(F.sum("in0").alias("in0"), F.sum("in1").alias("in1")).toArrow()
    in0, in1 = (np.bincount(counts.column("feature").to_numpy(), counts.column(c).to_numpy(), len(names)) for c in ("in0", "in1"))
    z = deviations(in1, in0, n1, n0)
    lift = ((in1 + 0.5) / (n1 + 1)) / ((in0 + 0.5) / (n0 + 1))
    chosen = telling(names, z, lift)
    if not chosen.any():
        return nothing
    names, z, lift = [names[i] for i in np.flatnonzero(chosen)], z[chosen], lift[chosen]

    def found(batches):
        read = Reader(names)
        for batch in batches:
            for at, texts in numbered_slices(batch.column(0)):
                rows, got = read(texts)
                ends = np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(got, pa.int32()))], names=["toxic", "found"])

    got = sample.select("text", "toxic").orderBy(F.xxhash64("text")).mapInArrow(found, "toxic int, found array<int>").toArrow()
    lists = got.column("found").combine_chunks()
    indptr = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    w, b = fit(indptr, lists.flatten().to_numpy(), got.column("toxic").to_numpy(), len(names), z, lift)
    return names, w, float(b)


def scored(docs: DataFrame, model: tuple[list[str], np.ndarray, float], text_col: str = "text") -> DataFrame:
    """``docs`` with ``__tox_score``."""
    tune_arrow(docs.sparkSession)
    features, weights, intercept = model
    at, columns = docs.columns.index(text_col), docs.columns

    def run(batches):
        read = Reader(features)
        for batch in batches:
            z = [intercept + np.bincount(rows, weights[got], len(texts)) for _, texts in numbered_slices(batch.column(at)) for rows, got in (read(texts),)]
            with np.errstate(over="ignore"):
                score = 1 / (1 + np.exp(-np.concatenate(z))) if z else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*columns, "__tox_score"])

    schema = docs.schema.__class__(docs.schema.fields[:])
    return docs.mapInArrow(run, schema.add("__tox_score", "double"))


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score at the threshold or above."""
    model = train(docs, labels, id_col, text_col)
    return scored(docs, model, text_col).where(F.col("__tox_score") < threshold).select(*docs.columns)


def op1_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = scored(docs, train(docs, labels))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("__tox_score").alias("score"),
        (F.col("__tox_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
