"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1) or bad (0) on a document, or abstains.  Nobody says
which rules are right: expectation-maximisation over the counts of vote
patterns estimates each rule's accuracy in either class and the share of good
documents.  A document stays if its posterior probability of being good
reaches the threshold, so one odd measure does not reject it.

The only values that reach the driver are the counts of vote patterns, of which
there are at most 3 ** len(RULES) however large the input is.

Defined results: a null or empty text has no words and fails the base rules;
a null id is a row like any other; repeated rows give repeated rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SEPARATOR, SEPARATORS, let, stored

WINDOW, STRETCH = 8, 200
SYMBOLS = "[#*$%&|<>]"
#: No rule is trusted beyond this, so that one vote alone does not reject a document that all others like.
MOST_TRUST = 0.98


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            at = F.sequence(F.lit(0), F.size(s) - 1)
            same = lambda k, d: F.coalesce(F.get(s, k + d)["h"] == F.get(s, k)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(at, lambda k: same(k, -1) | same(k, 1)), lambda k: F.get(s, k)["i"]))

        def width(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(pairs, positions), width))

    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def _kinds(words: Column) -> Column:
    """Distinct words of each stretch of ``STRETCH`` words, added up: their share does not fall with a text's length."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(STRETCH))
    return F.aggregate(starts, F.lit(0).cast("long"), lambda n, i: n + F.size(F.array_distinct(F.slice(words, i, STRETCH))))


def measures(text: Column) -> Column:
    """A struct of what the rules look at, over the whole text."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SEPARATOR)), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
            _repeat_words(words).alias("n_repeat_words"),
            _kinds(words).alias("n_distinct"),
            F.size(F.filter(words, lambda w: w.rlike(SYMBOLS))).cast("long").alias("n_symbol_words"),
            F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
            F.regexp_count(text, F.lit("[!?]")).cast("long").alias("n_marks"),
        )

    return let(F.array_remove(F.split(text, SEPARATORS + "+"), ""), of)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1))


def rules(m: Column) -> dict[str, Column]:
    """The rules' votes: 1 good, 0 bad, null abstains."""
    words = F.greatest(m["n_words"], F.lit(1))
    chars = F.greatest(m["word_chars"], F.lit(1))
    lines = F.greatest(m["lines"]["n"], F.lit(1))
    mean = m["word_chars"] / words
    symbols, repeat, upper, marks = m["n_symbols"] / words, m["n_repeat_words"] / words, m["n_upper"] / chars, m["n_marks"] / words
    dup, kinds = m["lines"]["dup"] / lines, m["n_distinct"] / words
    return {
        "length": _vote(m["n_words"] >= 40, m["n_words"] < 20),
        "symbols": _vote(symbols < 0.02, symbols > 0.1),
        "symbol_words": _vote(m["n_symbol_words"] / words < 0.03, m["n_symbol_words"] / words > 0.1),
        "lines": _vote((m["lines"]["n"] >= 3) & (dup < 0.1), dup > 0.3),
        "repeats": _vote(repeat < 0.05, repeat > 0.3),
        "upper": _vote(upper < 0.15, upper > 0.35),
        "mean_word": _vote((mean >= 3) & (mean <= 9), (mean < 2.5) | (mean > 15)),
        "kinds": _vote(kinds > 0.3, (m["n_words"] >= 20) & (kinds < 0.15)),
        "marks": _vote(marks < 0.05, marks > 0.3),
    }


def pattern(m: Column) -> Column:
    """The votes as text: one of g, b and - for each rule."""
    return F.concat(*(F.when(v.isNull(), "-").when(v == 1, "g").otherwise("b") for v in rules(m).values()))


def fit(counts: dict[str, int], rounds: int = 50, tolerance: float = 1e-6, start: tuple[float, float, float] = (0.85, 0.98, 0.75)) -> dict:
    """Class share and each rule's chance to vote good in either class.

    ``counts``: documents by vote pattern (at most 3 ** rules entries).
    ``start``: the share of good documents, and the chance of a good vote on a
    good and on a bad document, before the first round.  Rules start better than
    chance and stay so, which settles which class is which.
    """
    n_rules = max(map(len, counts), default=0)
    share, p_good, p_bad = start[0], [start[1]] * n_rules, [start[2]] * n_rules
    clamp = lambda x, lo, hi: min(max(x, lo), hi)
    total = sum(counts.values())
    for _ in range(rounds if total else 0):
        good = {}
        for votes in counts:
            odds = math.log(share / (1 - share))
            for j, v in enumerate(votes):
                if v != "-":
                    odds += math.log(p_good[j] / p_bad[j]) if v == "g" else math.log((1 - p_good[j]) / (1 - p_bad[j]))
            good[votes] = 1 / (1 + math.exp(-clamp(odds, -500, 500)))
        old = [share, *p_good, *p_bad]
        share = clamp(sum(good[v] * n for v, n in counts.items()) / total, 0.05, 0.95)
        for j in range(n_rules):
            # two counts of each vote as a prior: a rule that seldom votes stays near where it began
            voted = [(good[v], n, v[j] == "g") for v, n in counts.items() if v[j] != "-"]
            g, b = sum(p * n for p, n, _ in voted), sum((1 - p) * n for p, n, _ in voted)
            p_good[j] = clamp((sum(p * n for p, n, yes in voted if yes) + 1.7) / (g + 2), 0.5, MOST_TRUST)
            p_bad[j] = clamp((sum((1 - p) * n for p, n, yes in voted if yes) + 0.7) / (b + 2), 0.001, p_good[j] - 0.01)
        if max(abs(x - y) for x, y in zip(old, [share, *p_good, *p_bad], strict=True)) < tolerance:
            break
    return {"share": share, "good": p_good, "bad": p_bad}


def posterior(model: dict, votes: Column) -> Column:
    """Probability that a document with this vote pattern is good."""
    odds = F.lit(math.log(model["share"] / (1 - model["share"])))
    for j, (g, b) in enumerate(zip(model["good"], model["bad"], strict=True)):
        vote = F.substring(votes, j + 1, 1)
        odds = odds + F.when(vote == "g", F.lit(math.log(g / b))).when(vote == "b", F.lit(math.log((1 - g) / (1 - b)))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def pattern_counts(votes: DataFrame, column: str) -> dict[str, int]:
    return {r[0]: r[1] for r in votes.groupBy(column).count().collect()}


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: id, measures, votes, posterior and verdict."""
    m = stored(df.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m")).select("doc_id", "m", pattern(F.col("m")).alias("votes")), "quality")
    model = fit(pattern_counts(m, "votes"))
    m = m.withColumn("posterior", posterior(model, F.col("votes"))).withColumn("base_failed", base_failed(F.col("m")))
    return m.select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", F.col("m.lines.dup").cast("long").alias("n_dup_lines"), "m.n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "votes", "posterior",
    )


def keep_good(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose text the rules keep, with all their columns.

    The rows are stored once with their votes, so that texts are measured once.
    """
    columns = df.columns
    both = let(measures(F.col(text_col)), lambda m: F.struct(pattern(m).alias("votes"), base_failed(m).alias("failed")))
    rows = stored(df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), both.alias("m")), "quality-votes")
    model = fit(pattern_counts(rows.select(F.col("m.votes").alias("votes")), "votes"))
    kept = rows.filter(~F.col("m.failed") & (posterior(model, F.col("m.votes")) >= threshold))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in columns))
