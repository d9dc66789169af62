"""Toxicity: held-out accuracy, what is never read, and defined results."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity as tx

BAD = ["grunk", "snarf", "blorf"]


@pytest.fixture(scope="module")
def made(spark):
    """Clean prose, and toxic prose with one of three words or with words that begin alike."""
    r = random.Random(2)
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for k in range(1500):
        w = [word() for _ in range(r.randint(20, 120))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(BAD) if k % 12 == 0 else "zquo" + word())
        docs.append((k, " ".join(w), "en", "s", len(w)))
        labels.append((k, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents(made):
    docs, labels = made
    model = tx.train(docs, labels)
    rows = tx.scored(docs, model).join(labels, "doc_id").where(tx.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 250
    wrong = [r for r in rows if (r["__tox_score"] >= tx.THRESHOLD) != bool(r["toxic"])]
    assert len(wrong) <= 0.02 * len(rows)
    assert all(0 <= r["__tox_score"] <= 1 for r in rows)


def test_the_held_out_fold_is_never_learnt_from(made):
    docs, labels = made
    turned = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = tx.train(docs, labels), tx.train(docs, turned)
    assert a[0] == b[0] and np.array_equal(a[1], b[1]) and a[2] == b[2]


def test_the_fold_is_that_of_zlib(spark):
    got = spark.range(500).select("id", tx.held_out(F.col("id"))).collect()
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in got)


def test_label_model_finds_accuracies_and_wrong_labels():
    r = np.random.default_rng(4)
    y = r.random(4000) < 0.3
    fire = [(0.02, 0.7), (0.05, 0.6), (0.01, 0.4)]
    votes = np.stack([np.where(y, r.random(4000) < p, r.random(4000) < q) for q, p in fire], axis=1).astype(np.uint8)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)
    gold = np.where(r.random(4000) < 0.05, ~y, y).astype(int)
    post, model = tx.label_model(votes, gold)
    assert abs(model["fire"][1][0] - 0.7) < 0.08 and abs(model["fire"][0][0] - 0.02) < 0.03
    assert model["weight"][0] < 0.7 < model["weight"][2]
    assert ((post > 0.5) == y).mean() > (gold == y).mean() - 0.01


def test_without_voters_the_labels_decide():
    gold = np.array([0, 0, 0, 1])
    post, _ = tx.label_model(np.zeros((4, 0), np.uint8), gold)
    assert ((post > 0.5) == gold).all()


def test_voters_of_one_language_say_nothing_about_another():
    r = np.random.default_rng(6)
    y, rare = r.random(6000) < 0.3, r.random(6000) < 0.1
    votes = np.stack([y & (rare if k > 20 else ~rare) & (r.random(6000) < 0.5) for k in range(24)], axis=1).astype(np.uint8)
    post, _ = tx.label_model(votes, y.astype(int))
    held = votes.any(axis=1) & rare & y
    assert held.any() and post[held].min() > 0.9


def test_correlations_against_plain_loops():
    r = np.random.default_rng(5)
    votes, post = (r.random((200, 9)) < 0.3).astype(np.uint8), r.random(200)
    votes[:, 4] = votes[:, 2]
    fire = np.stack([[np.average(votes[:, j], weights=w) for j in range(9)] for w in (1 - post, post)])
    rest = np.array([[votes[i, j] - (1 - post[i]) * fire[0, j] - post[i] * fire[1, j] for j in range(9)] for i in range(200)])
    want = []
    for j in range(9):
        c = [(rest[:, j] * rest[:, k]).sum() / np.sqrt((rest[:, j] ** 2).sum() * (rest[:, k] ** 2).sum()) for k in range(9)]
        want.append(sum(x for x in c if x > 0.1))
    assert np.allclose(tx.correlation_sums(votes, post, fire, block=4), want, atol=1e-4)


def plain_features(text: str) -> set[str]:
    """All features, read one after the other."""
    out, tokens, run = set(), text.split(), []
    joined = []
    for t in (*tokens, ""):
        if len(t) == 1 and t.isalnum():
            run.append(t)
        else:
            joined += ["".join(run)] if len(run) > 2 else []
            run = []
    for t in tokens + joined:
        for w in tx.words_of([t])[1][0].split():
            out |= {w} | {w[i : i + k].join("**") for k in (4, 5) for i in range(len(w) - k + 1)}
            out |= {w[:k] + "*" for k in (3, 4, 5, 6) if len(w) >= k} | {"*" + w[-k:] for k in (3, 4, 5, 6) if len(w) >= k}
    core = ["-".join(tx.words_of([t])[0][0].split()) for t in tokens]
    return out | {f"{a} {b}" for a, b in zip(core, core[1:]) if a and b}


def test_features_against_one_after_the_other():
    r = random.Random(9)
    syllables = ["ba", "no", "é", "x1", "-", "?", "Zu", "oooo", "i", "ß", "$", "日"]
    texts = [" ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 40))) for _ in range(60)] + [None, "", " a b c d  e ", "g r u n k", "\n\n"]
    want = [plain_features(t or "") for t in texts]
    docs, names = tx.all_features(pa.array(texts, pa.string()))
    counts = dict(zip(names, docs.tolist()))
    assert counts == {f: sum(f in w for w in want) for w in want for f in w}
    some = sorted(names)[::3]
    rows, found = tx.Reader(some)(pa.array(texts, pa.string()))
    got = [set() for _ in texts]
    for k, f in zip(rows.tolist(), found.tolist()):
        got[k].add(some[f])
    assert got == [w & set(some) for w in want]
    assert all(tx.implied(f) <= w for w in want for f in w)


def test_plain_spelling():
    read = lambda t: set(tx.words_of([t])[1][0].split())
    assert "idiot" in read("1d10t,") & read("i.d-i_o-t".replace("_", "")) & read("IDÍÓT!!") & read("idiooooot")
    assert "stupid" in read("$tup1d") and read("2024") == {"2024"} and read("--") == set()


KINDS = ("beginning", "end", "inside", "spelling", "pair", "apart")


@pytest.fixture(scope="module")
def altered(spark):
    """Toxic prose of six kinds, a seventh of the toxic documents each with plain words besides, none of them seen while thresholds were chosen."""
    r = random.Random(31)
    syllables = [a + b for a in "kvzjqwhcy" for b in ("a", "e", "i", "o", "ur", "en")]
    word = lambda n=4: "".join(r.choice(syllables) for _ in range(r.randint(1, n)))
    spelt = lambda w: r.choice([w.replace("o", "0").replace("i", "1"), "-".join((w[:2], w[2:])), w[:3] + w[3] * 4 + w[4:], w.replace("a", "á").upper()])
    docs, labels, kinds = [], [], []
    for k in range(4200):
        w = [word() for _ in range(r.randint(20, 150))]
        toxic = k % 6 == 0
        kind = (*KINDS, "word")[k // 6 % 7] if toxic else ""
        bad = lambda: r.choice(["gromida", "plattoni"])
        made = {
            "beginning": lambda: "mabdu" + word(2),
            "end": lambda: word(2) + "rostl",
            "inside": lambda: word(1) + "ddlump" + word(1),
            "spelling": lambda: spelt(bad()),
            "pair": lambda: "soft noodle",
            "apart": lambda: " ".join(bad()),
            "word": bad,
        }
        for _ in range(r.randint(2, 4) if toxic else 0):
            w.insert(r.randrange(len(w)), made[kind]())
        if not toxic and k % 5 == 0:  # either word of the pair alone
            w.insert(r.randrange(len(w)), r.choice(["soft", "noodle"]))
        docs.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
        kinds.append((k, kind))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(kinds)


def test_kinds_of_altered_words(altered):
    docs, labels, kinds = altered
    model = tx.train(docs, labels)
    rows = tx.scored(docs, model).where(tx.held_out(F.col("doc_id"))).select("doc_id", "__tox_score").collect()
    caught = {kind: [r[1] >= tx.THRESHOLD for r in rows if kinds[r[0]] == kind] for kind in (*KINDS, "word", "")}
    share = {kind: sum(x) / len(x) for kind, x in caught.items()}
    print(share)
    assert share.pop("") <= 0.01
    assert min(share.values()) >= 0.9, share


def test_odd_rows(made, odd_docs, no_docs, clashing):
    docs, labels = made
    model = tx.train(docs, labels)
    rows = tx.scored(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    empty = {r["__tox_score"] for r in rows if not (r["text"] or "").strip()}
    assert len(empty) == 1 and empty.pop() < tx.THRESHOLD
    assert tx.scored(no_docs, model).count() == 0
    out = tx.scored(clashing, model)
    assert out.columns == [*clashing.columns, "__tox_score"] and out.count() == clashing.count()


def test_without_labels_nothing_is_toxic(odd_docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    for labels in (none, one):
        model = tx.train(odd_docs, labels)
        assert {r["__tox_score"] for r in tx.scored(odd_docs, model).collect()} == {0.0}
    assert tx.clean(odd_docs, none).columns == odd_docs.columns


def test_clean_documents_stay(made):
    docs, labels = made
    kept = tx.clean(docs, labels).join(labels, "doc_id")
    row = kept.agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    total = labels.where("toxic = 0").count()
    assert row["clean"] >= 0.99 * total and row["toxic"] <= 0.03 * (1500 - total)
