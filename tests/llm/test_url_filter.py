"""URL rules against a plain parser; models that learn; defined results."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import url_filter as uf


def parsed(url):
    """(host, path, rule, verdict)"""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1])
    fits = [(name + start, said) for said, name, start in uf.RULES if (host == name or host.endswith("." + name)) and m[2].startswith(start)]
    rule, said = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, m[2], rule, said


URLS = [
    None,
    "",
    "no scheme.org/x",
    "http://",
    "https://A.Example.ORG/es/1?q=://",
    "http://example.org/en/19#x",
    "http://example.org/en/2",
    "http://myexample.org/es/",
    "http://x.com/fr",
    "http://x.com/france?x",
    "http://com/de/1",
    "http://x.com/de",
    "http://x.com?/de/",
    "http://x.com#/fr",
    "ftp://u@x.org:80/",
    "http://ünï.net/ß\n?",
    "http://x.net/" + "a" * 3000,
]


def judge(df):
    return [r.asDict() for r in uf.judged(df).collect()]


def test_rules(spark):
    rows = [(k, u) for k, u in enumerate(URLS * 2)]
    got = judge(spark.createDataFrame(rows, "page_id long, url string"))
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, said = parsed(r["url"])
        assert (r["__url_host"], r["__url_path"], r["__url_rule"]) == (host, path, rule)
        assert r["__url_verdict"] in ("allow", "block") and (said is None or r["__url_verdict"] == said)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ahmnoregcdfs.:/?#/E1", max_size=30), min_size=1, max_size=30))
def test_random_addresses(spark, urls):
    host, path = uf.host_and_path(F.col("url"))
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host.alias("h"), path.alias("p"))
    rule, _ = uf.longest_rule(F.col("h"), F.col("p"))
    assert [(r["h"], r["p"], r["r"]) for r in df.select("url", "h", "p", rule.alias("r")).collect()] == [parsed(u)[:3] for u in urls]


def test_models_tell_addresses_apart(spark):
    r = random.Random(1)
    good = lambda: f"{r.choice(['newspaper', 'library', 'journal'])}/{r.randint(1, 99)}"
    bad = lambda: f"{r.choice(['casino', 'cheappills', 'jackpot'])}-{r.randint(1, 99)}"
    rows = [f"http://a.org/{good()}" for _ in range(300)] + [f"http://a.example.org/es/{bad()}" for _ in range(300)]
    asked = [(f"http://b.net/x/{good()}", "allow") for _ in range(60)] + [(f"http://b.net/x/{bad()}", "block") for _ in range(60)]
    df = spark.createDataFrame([(u,) for u in rows + [u for u, _ in asked]], "url string")
    got = {x["url"]: x["__url_verdict"] for x in judge(df)}
    assert sum(got[u] == v for u, v in asked) > 0.9 * len(asked)


def test_probabilities_add_up(spark):
    """Without pruning, each history's estimates of all known characters and the rest are a distribution."""
    import math

    rows = [("^abab$", 1), ("^abba$", 1), ("^cc$", 0)]
    gains, steps, unknown = uf.fit(spark.createDataFrame(rows, "__url_s string, allow int"), share=10**9)
    assert gains.count() > 0 and steps.count() > 0
    assert unknown == pytest.approx(math.log((3 + len(uf.ALPHABET)) / (10 + len(uf.ALPHABET))))


def test_no_rows_and_one_verdict(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judge(empty) == []
    one = spark.createDataFrame([("http://a.org/x",), ("http://b.net/x",)], "url string")
    assert {r["url"]: r["__url_verdict"] for r in judge(one)}["http://a.org/x"] == "allow"


def test_other_columns_stay(spark):
    df = spark.createDataFrame([("http://b.net/x", "k", "g", "s")], "url string, key string, gain string, score string")
    out = uf.judged(df)
    assert out.columns[:4] == df.columns and out.first()["score"] == "s"


def test_no_python_in_the_plan(spark, small):
    plan = uf.op4_url_filter(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_models(rows):
    """What each sequence adds to a score, by counting all of them in plain Python."""
    import math
    from collections import Counter

    counts = [Counter(), Counter()]
    for s, allow in rows:
        for end in range(2, len(s) + 1):
            counts[allow].update(s[end - k : end] for k in range(1, min(end, uf.ORDER) + 1))
    after = [{}, {}]
    for side in (0, 1):
        for gram, n in counts[side].items():
            after[side].setdefault(gram[:-1], []).append(n)

    def p(gram, side):
        if len(gram) == 1:
            return (counts[side][gram] + 1) / (sum(after[side][""]) + len(uf.ALPHABET))
        kinds = after[side].get(gram[:-1])
        return (counts[side][gram] + len(kinds) * p(gram[1:], side)) / (sum(kinds) + len(kinds)) if kinds else p(gram[1:], side)

    score = lambda s: sum(math.log(p(g, 1) / p(g, 0)) for g in (s[max(0, end - uf.ORDER) : end] for end in range(2, len(s) + 1))) / (len(s) - 1)
    return set(counts[0]) | set(counts[1]), score


def test_rare_sequences_stay_in_large_models(spark):
    """With far more than 40,000 positions, sequences seen once count too; scores are those of plain counting."""
    r = random.Random(7)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(3, 9)))
    rows = [(f"^{word('abcdefgh')}.example.org/{word('aeiorstn')}/{word('0123456789')}/{word('abcdefghijklmnopqrstuvwxyz')}$", k % 2) for k in range(3000)]
    sequences, score = plain_models(rows)
    gains, steps, unknown = uf.fit(spark.createDataFrame(rows, "__url_s string, allow int"))
    assert gains.count() == len(sequences)
    asked = ["^$", "^zq#%$", *{s for s, _ in rows[:300]}, *{f"^{word('abcdxyz')}.net/{word('aeiorstn019')}$" for _ in range(300)}]
    got = uf.differences(spark.createDataFrame([(s,) for s in asked], "__url_s string"), gains, steps, unknown).collect()
    assert sorted(x["__url_s"] for x in got) == sorted(asked)
    assert all(x["score"] == pytest.approx(score(x["__url_s"]), abs=1e-9) for x in got)


def test_rules_are_the_contracts():
    """Written out, so that a rule changed in the code is noticed."""
    assert set(uf.RULES) == {
        ("allow", "org", "/"),
        ("block", "example.org", "/es/"),
        ("block", "example.org", "/en/1"),
        ("allow", "com", "/fr/"),
        ("block", "com", "/de/"),
    }


@pytest.mark.parametrize("url, rule", [("http://x.com/fr/1", "com/fr/"), ("http://x.com/fr/", "com/fr/"), ("http://x.com/fr", None), ("http://x.com/france", None), ("http://com/fr/?q", "com/fr/")])
def test_paths_under_fr(spark, url, rule):
    host, path = uf.host_and_path(F.col("url"))
    found, said = uf.longest_rule(F.col("h"), F.col("p"))
    got = spark.createDataFrame([(url,)], "url string").select(host.alias("h"), path.alias("p")).select(found.alias("rule"), said.alias("said")).first()
    assert (got["rule"], got["said"]) == (rule, "allow" if rule else None)
