"""URL filter: rules first, then a ratio of character language models.

Rules of (host, path) allow or block; a rule fits its host and all subdomains
of it where the path starts with the rule's, and the longest rule wins.  Two
variable-order Markov models are counted over the characters of all allowed
and all blocked addresses.  Every sequence of up to ``ORDER`` characters and
every history is kept, however rare, so the models grow with the addresses that
rules decide.  Estimates of a longer history are interpolated with those of the
shorter one (Witten-Bell), down to add-one smoothing without history.  An
address is judged by the difference of the two log-likelihoods divided by its
length; the border is calibrated on a fold of the rules' addresses that the
counts leave out.

Everything is DataFrame functions: positions are exploded and counted with
partial sums; the distinct sequences to judge are looked up in the models by
shuffled joins, shortest first, and their scores are joined to the positions
by the sequence.  Sequences that make up at least one in ``HOT`` positions, of
which there are at most ``HOT``, are joined by broadcast instead, so that a
common one does not land in one task.

Defined results: an address that is null or lacks ``://`` has an empty host and
path, fits no rule and has the likelihood difference 0; without addresses of
both verdicts the border is 0 and every difference is 0, which allows; repeated
rows are counted and judged each; an empty table gives an empty result; further
columns stay in ``judged`` (names starting ``__url_`` are reserved).
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Longest sequence of characters that is counted: a history and what follows it.
ORDER = 5
#: A sequence that makes up one in so many positions is common.
HOT = 1000
#: One in so many addresses with a rule calibrates.
FOLD = 5
ALPHABET = string.ascii_lowercase + string.digits + "/.-_?=&#:%~^$"


def address(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = address(url)
    return (
        F.coalesce(lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit("")),
        F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
    )


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule as a string and its verdict, or nulls."""
    found = verdict = None
    for said, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, name + start) if found is None else found.when(fits, name + start)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return found, verdict


def _letters(url: Column) -> Column:
    """The address in the models' alphabet between a start and an end mark; other characters become ``~``."""
    known = F.regexp_replace(lower(F.coalesce(address(url), F.lit(""))), r"[^a-z0-9/.\-_?=&#:%]", "~")
    return F.concat(F.lit("^"), known, F.lit("$"))


def _gram(s: str, at: str, k: int) -> Column:
    """The k characters that end at a position, null where there are fewer."""
    return F.expr(f"CASE WHEN {at} >= {k} THEN substring({s}, {at} - {k - 1}, {k}) END")


def _positions(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, "__url_s", F.explode(F.sequence(F.lit(2), F.char_length("__url_s"))).alias("at"))


def fit(labelled: DataFrame, share: int | None = None) -> tuple[DataFrame, DataFrame, float]:
    """The models from (``__url_s``, ``allow`` 0 or 1): (key, gain) of sequences, (key, step) of histories, and the gain of an unknown character.

    Only a caller that gives ``share`` has longer sequences and histories left out: those seen once or less than once in ``share`` positions.
    """
    grams = _positions(labelled, "allow").select("allow", F.explode(F.array(*[_gram("__url_s", "at", k) for k in range(1, ORDER + 1)])).alias("gram")).where("gram IS NOT NULL")
    grams = grams.groupBy("gram").agg(F.sum("allow").alias("a"), F.sum(1 - F.col("allow")).alias("r"))
    grams = materialize(grams.withColumn("k", F.char_length("gram")), "grams")
    total = grams.where("k = 1").agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0))).first()
    n_a, n_r = int(total[0]), int(total[1])
    least = max(2.0, (n_a + n_r) / share) if share else 1.0
    kinds = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).cast("double")
    history = grams.groupBy(F.expr("substring(gram, 1, k - 1)").alias("history")).agg(F.sum("a").alias("na"), F.sum("r").alias("nr"), kinds("a").alias("ta"), kinds("r").alias("tr"))
    history = materialize(history.where(f"history <> '' AND na + nr >= {least}"), "histories")
    v = len(ALPHABET)
    level = grams.where("k = 1").select("gram", (F.col("a") + 1).alias("x"), (F.col("r") + 1).alias("y"))
    level = materialize(level.select("gram", (F.col("x") / (n_a + v)).alias("pa"), (F.col("y") / (n_r + v)).alias("pr")), "level1")
    levels = [level]
    for k in range(2, ORDER + 1):
        kept = grams.where((F.col("k") == k) & (F.col("a") + F.col("r") >= least)).select("gram", "a", "r", F.expr("substring(gram, 1, k - 1)").alias("history"), F.expr("substring(gram, 2)").alias("shorter"))
        kept = kept.join(history, "history").join(level.select(F.col("gram").alias("shorter"), "pa", "pr"), "shorter")
        mixed = lambda c, n, t, p: F.when(F.col(n) > 0, (F.col(c) + F.col(t) * F.col(p)) / (F.col(n) + F.col(t))).otherwise(F.col(p))
        level = materialize(kept.select("gram", mixed("a", "na", "ta", "pa").alias("pa"), mixed("r", "nr", "tr", "pr").alias("pr")), f"level{k}")
        levels.append(level)
    known = levels[0]
    for level in levels[1:]:
        known = known.unionByName(level)
    known = known.select(F.col("gram").alias("key"), F.ln(F.col("pa") / F.col("pr")).alias("gain"))
    left = lambda n, t: F.when(F.col(n) > 0, F.col(t) / (F.col(n) + F.col(t))).otherwise(F.lit(1.0))
    steps = history.select(F.col("history").alias("key"), F.ln(left("na", "ta") / left("nr", "tr")).alias("step"))
    return materialize(known, "gains"), materialize(steps, "steps"), math.log((n_r + v) / (n_a + v))


def differences(addresses: DataFrame, gains: DataFrame, steps: DataFrame, unknown: float) -> DataFrame:
    """(``__url_s``, score) of distinct ``addresses``: the log-likelihood difference by length."""
    x = materialize(addresses.select("__url_s", F.monotonically_increasing_id().alias("id")), "asked")
    at = _positions(x, "id").select("id", F.expr(f"substring(__url_s, greatest(at - {ORDER - 1}, 1), least(at, {ORDER}))").alias("gram"))
    grams = materialize(at.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "asked_grams")
    suffixes = lambda k: grams.where(F.char_length("gram") >= k).select(F.expr(f"right(gram, {k})").alias("gram")).distinct()
    # a shorter sequence is the end of at most one longer one for each letter of the alphabet
    level = suffixes(1).join(gains.withColumnRenamed("key", "gram"), "gram", "left").select("gram", F.coalesce("gain", F.lit(unknown)).alias("score"))
    scored = level = materialize(level, "scored1")
    for k in range(2, ORDER + 1):
        wanted = suffixes(k).select("gram", F.expr(f"left(gram, {k - 1})").alias("history"), F.expr("substring(gram, 2)").alias("shorter"))
        wanted = wanted.join(level.select(F.col("gram").alias("shorter"), "score"), "shorter").join(steps.withColumnRenamed("key", "history"), "history", "left").join(gains.withColumnRenamed("key", "gram"), "gram", "left")
        level = materialize(wanted.select("gram", F.coalesce("gain", F.coalesce("step", F.lit(0.0)) + F.col("score")).alias("score")), f"scored{k}")
        scored = scored.unionByName(level)
    scored = materialize(grams.join(scored, "gram"), "scored")
    positions = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = scored.where(F.col("n") * HOT >= positions).select("gram", F.col("score").alias("common"))  # at most HOT rows
    at = at.join(F.broadcast(common), "gram", "left")
    rare = at.where("common IS NULL").select("id", "gram").join(scored.where(F.col("n") * HOT < positions).select("gram", "score"), "gram")
    sums = at.where("common IS NOT NULL").select("id", F.col("common").alias("score")).unionByName(rare.select("id", "score"))
    # decimals add up to the same in any order
    sums = sums.groupBy("id").agg((F.sum(F.col("score").cast("decimal(18,14)")).cast("double") / F.count(F.lit(1))).alias("score"))
    return x.join(sums, "id").select("__url_s", "score")


def border(scores: DataFrame) -> float:
    """Where normal curves through both verdicts' scores (score, allow) lie equally many deviations away."""
    found = {r["allow"]: r for r in scores.groupBy("allow").agg(F.avg("score").alias("m"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("s")).collect()}
    if len(found) < 2:
        return 0.0
    a, r = found[1], found[0]
    if a["s"] + r["s"] == 0:
        return (a["m"] + r["m"]) / 2
    return (a["m"] * r["s"] + r["m"] * a["s"]) / (a["s"] + r["s"])


def judged(pages: DataFrame, url_col: str = "url", rules=RULES, share: int | None = None) -> DataFrame:
    """``pages`` with ``__url_host``, ``__url_path``, ``__url_rule``, ``__url_score`` (null where a rule decides) and ``__url_verdict``."""
    host, path = host_and_path(F.col(url_col))
    x = pages.withColumn("__url_host", host).withColumn("__url_path", path)
    found, said = longest_rule(F.col("__url_host"), F.col("__url_path"), rules)
    x = x.withColumn("__url_rule", found).withColumn("__url_said", said).withColumn("__url_s", _letters(F.col(url_col)))
    slim = materialize(x.select("__url_s", "__url_said"), "addresses")
    with_rule = slim.where("__url_said IS NOT NULL").select("__url_s", F.when(F.col("__url_said") == "allow", 1).otherwise(0).alias("allow"))
    calibrating = F.crc32(F.col("__url_s")) % FOLD == 0
    gains, steps, unknown = fit(with_rule.where(~calibrating), share)
    held = with_rule.where(calibrating)
    asked = slim.where(F.col("__url_said").isNull() | calibrating).select("__url_s").distinct()
    scores = materialize(differences(asked, gains, steps, unknown), "scores")
    limit = border(held.join(scores, "__url_s"))
    scores = scores.select(F.col("__url_s").alias("__url_t"), F.when(F.col("__url_s") != "^$", F.col("score")).otherwise(0.0).alias("__url_score"))
    out = x.join(scores, F.col("__url_s") == F.col("__url_t"), "left")
    score = F.when(F.col("__url_said").isNull(), F.coalesce("__url_score", F.lit(0.0)))
    verdict = F.coalesce("__url_said", F.when(score >= limit, "allow").otherwise("block"))
    return out.select(*[pages[c] for c in pages.columns], "__url_host", "__url_path", "__url_rule", score.alias("__url_score"), verdict.alias("__url_verdict"))


def op4_url_filter(spark, sf_dir):
    out = judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select(
        "page_id",
        F.col("__url_host").alias("host"),
        F.col("__url_path").alias("path"),
        F.col("__url_rule").alias("rule"),
        F.col("__url_verdict").alias("verdict"),
        F.col("__url_score").alias("score"),
    )
