"""Toxic passages: maximum-scoring segments over token log-odds.

1. Log-odds.  Tokens are words and their beginnings and endings of a few lengths.
   The rows that have a token are counted by label; its log-odds come with an
   informative Dirichlet prior (its share of all rows), and count only if they lie
   ``Z`` standard errors from zero, on either side.  A word scores what its most
   toxic token does, or else its least toxic one; a word without a significant
   token scores ``LOSS``, the drift that theory asks for.
2. Segments.  A linear-time scan finds every maximal scoring segment of a text
   (the algorithm of Ruzzo and Tompa).
3. Calibration.  By extreme-value theory the number of segments of score S or
   more that n clean words give by chance is about K n exp(-lambda S), where
   lambda solves E[exp(lambda s)] = 1 over clean words and K is counted on the
   clean rows.  A text's statistic is the sum, over its segments, of how far each
   lies beyond chance; a logistic curve turns it into a probability.  Both are
   fitted on labelled rows, each half scored with the log-odds of the other half.

Labelled rows are a bounded sample: at most about ``ROWS`` of either label, by
hash of the id.  Scoring covers every word of every text.  Token counts stay
with Spark; only significant tokens reach the driver.

Defined results: null and empty texts have no segments and get the score of such
texts; without labelled rows of both labels all scores are close to 0; repeated
rows give repeated rows; a repeated id of ``labels`` counts as often as it is there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import crc_mod, stored

ROWS = 10_000
Z, LEAST_ROWS = 3.5, 4
#: Lengths in bytes of the beginnings and endings of words that are tokens too.
AFFIXES = (5, 6, 7)
#: Score of a word without significant log-odds.
LOSS = -0.05
#: Segments of lambda times score below this are never significant; K is counted on those above.
LEAST_SCORE = 1.0
BINS = 400


def _usable():
    """Labelled rows that may be learned from."""
    return F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), 4) != 2)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """(text, toxic, half) of at most about ``rows`` labelled rows of either label."""
    labels = labels.filter(_usable()).select("doc_id", "toxic")
    sizes = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    h = F.xxhash64("doc_id", F.lit("toxicity"))
    share = F.when(F.col("toxic") == 1, F.lit(rows / max(1, sizes.get(1, 0)))).otherwise(F.lit(rows / max(1, sizes.get(0, 0))))
    some = labels.filter(F.pmod(h, F.lit(1_000_000)) < share * 1_000_000).withColumn("half", F.pmod(F.shiftright(h, 40), F.lit(2)))
    # at most about 2 * rows rows of a few bytes
    return docs.join(F.broadcast(some), "doc_id").select("text", "toxic", "half")


def _tokens(w: wordhash.Words) -> tuple[np.ndarray, np.ndarray]:
    """(token, word) of all tokens of all words."""
    whole = np.arange(len(w.hashes))
    return np.concatenate([w.hashes, *(h for _, h in (w.parts or ()))]), np.concatenate([whole, *(k for k, _ in (w.parts or ()))])


def token_rows(rows: DataFrame) -> DataFrame:
    """(token, kind, rows, n): rows of each kind (2 * toxic + half) that have a token, and how often they do."""

    def run(batches):
        for b in batches:
            kind = b.column(1).to_numpy()
            for w in wordhash.slices(b.column(0), separator=wordhash.NOT_ALNUM, affixes=AFFIXES):
                token, word = _tokens(w)
                if not len(token):
                    continue
                u, at = np.unique(token, return_inverse=True)
                n_texts = len(w.first) - 1
                pair, n = np.unique(at.astype(np.int64) * n_texts + w.text_of_word()[word], return_counts=True)
                cell = pair // n_texts * 4 + kind[w.row + pair % n_texts]
                r, n = np.bincount(cell, minlength=4 * len(u)), np.bincount(cell, n, 4 * len(u))
                some = np.flatnonzero(r)
                yield pa.RecordBatch.from_arrays([pa.array(u[some // 4].view(np.int64)), pa.array((some % 4).astype(np.int32)), pa.array(r[some]), pa.array(n[some].astype(np.int64))], ["token", "kind", "rows", "n"])

    counted = rows.select("text", (2 * F.col("toxic") + F.col("half")).cast("int").alias("kind")).mapInArrow(run, "token long, kind int, rows long, n long")
    return counted.groupBy("token", "kind").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"))


def _log_odds(t, o, rows_t, rows_o, log):
    """(log-odds, standard errors from zero) of tokens that ``t`` toxic and ``o`` other rows have; for arrays and columns alike."""
    weight = rows_t  # the prior is worth as many rows as there are toxic ones
    prior = (t + o + 1e-9) * (weight / (rows_t + rows_o))
    odds = log((t + prior) / (rows_t + weight - t - prior + 0.5)) - log((o + prior) / (rows_o + weight - o - prior + 0.5))
    return odds, odds / (1 / (t + prior) + 1 / (o + prior)) ** 0.5


def counts(rows: DataFrame) -> dict:
    """Rows by token, label and half, for the tokens whose log-odds are significant in some fit."""
    sizes, words = np.zeros((2, 2)), 0.0  # label, half
    for r in rows.groupBy("toxic", "half").agg(F.count("*").alias("k"), F.sum(F.octet_length("text") / 6).alias("w")).collect():
        sizes[r["toxic"], r["half"]] = r["k"]
        words += (r["w"] or 0.0) if r["toxic"] == 0 else 0.0
    empty = np.zeros((2, 0))
    out = {"sizes": sizes, "words": max(1.0, words), "token": np.zeros(0, np.uint64), "toxic": empty, "other": empty, "n": np.zeros(0)}
    if not sizes.sum(1).all():
        return out
    cell = lambda k, c: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(c))), F.lit(0))
    names = ("o0", "o1", "t0", "t1")
    table = token_rows(rows).groupBy("token").agg(*(cell(k, "rows").alias(c) for k, c in enumerate(names)), (cell(0, "n") + cell(1, "n")).alias("n"))
    table = table.filter(F.col("t0") + F.col("t1") >= LEAST_ROWS)
    some = F.lit(False)
    for halves in ((0, 1), (0,), (1,)):
        t, o = (sum(F.col(f"{c}{h}") for h in halves) for c in "to")
        rows_t, rows_o = (float(sizes[y, list(halves)].sum()) for y in (1, 0))
        if rows_t and rows_o:
            some = some | (F.abs(_log_odds(t, o, rows_t, rows_o, F.log)[1]) >= Z - 1e-6)
    got = table.filter(some).toArrow()
    token = got.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    column = lambda c: got.column(c).to_numpy()[order].astype(float)
    return out | {"token": token[order], "toxic": np.stack([column("t0"), column("t1")]), "other": np.stack([column("o0"), column("o1")]), "n": column("n")}


def fit(c: dict, halves: tuple[int, ...] = (0, 1)) -> dict:
    """Significant tokens with their log-odds, and lambda, from the rows of some halves."""
    h = list(halves)
    t, o = c["toxic"][h].sum(0), c["other"][h].sum(0)
    rows_t, rows_o = c["sizes"][1, h].sum(), c["sizes"][0, h].sum()
    if not rows_t or not rows_o or not len(t):
        return {"tokens": np.zeros(0, np.uint64), "scores": np.zeros(0), "lam": 1.0}
    odds, z = _log_odds(t, o, rows_t, rows_o, np.log)
    good = (abs(z) >= Z) & (t >= LEAST_ROWS / 2)
    scores, share = odds[good], np.maximum(c["n"][good], 0.5) / c["words"]
    # lambda: the positive root of sum p exp(lambda s) = 1 over clean words
    rest = max(0.0, 1 - share.sum())
    lo, hi = 1e-3, 50.0
    for _ in range(80):
        mid = (lo + hi) / 2
        total = (share * np.exp(np.minimum(mid * scores, 500))).sum() + rest * math.exp(mid * LOSS)
        lo, hi = (mid, hi) if total < share.sum() + rest else (lo, mid)
    return {"tokens": c["token"][good], "scores": scores, "lam": lo}


def segments(at: list[int], score: list[float], loss: float = LOSS) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment as (first, last, score).

    ``at``, ``score``: places and scores of the significant tokens; all others
    cost ``loss``.  Linear in the number of significant tokens, as a segment
    begins and ends with one that scores above zero.
    """
    out: list[list] = []  # first, last, sum ahead of it, sum through it, link to the last one that starts lower
    total, last = 0.0, -1
    for x, s in zip(at, score, strict=True):
        total += loss * (x - last - 1)
        last = x
        if s <= 0:
            total += s
            continue
        new = [x, x, total, total + s, None]
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            new[4] = j
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3], None]
            del out[j:]
    return [(a, b, high - low) for a, b, low, high, _ in out]


PASSAGES = "array<struct<score:double,first:bigint,last:bigint>>"


def evidence(docs: DataFrame, model: dict, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, and ``extra`` columns): its words, and its segments as (lambda times score, first word, last word)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = ["doc_id", *extra]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", n_words long, passages {PASSAGES}"
    kind = pa.list_(pa.struct([("score", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        m = sent.value
        tokens, scores, lam = m["tokens"], m["scores"], m["lam"]
        some = np.zeros(1 << 20, bool)
        some[(tokens & np.uint64(0xFFFFF)).astype(np.int64)] = True
        for b in batches:
            size, found = np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)]
            for w in wordhash.slices(b.column(len(keep)), separator=wordhash.NOT_ALNUM, affixes=AFFIXES):
                best, worst = np.zeros(len(w.hashes)), np.zeros(len(w.hashes))
                for word, h in [(None, w.hashes), *(w.parts or ())]:
                    i = np.flatnonzero(some[(h & np.uint64(0xFFFFF)).astype(np.int64)])
                    k = np.searchsorted(tokens, h[i])
                    k[k == len(tokens)] = 0
                    hit = tokens[k] == h[i] if len(tokens) else np.zeros(0, bool)
                    i = i[hit] if word is None else word[i[hit]]
                    best[i] = np.maximum(best[i], scores[k[hit]])
                    worst[i] = np.minimum(worst[i], scores[k[hit]])
                size[w.row : w.row + len(w.first) - 1] = np.diff(w.first)
                best = np.where(best > 0, best, worst)
                at = np.flatnonzero(best)
                cut = np.searchsorted(at, w.first)
                for t in np.flatnonzero(np.diff(cut)).tolist():
                    own = slice(cut[t], cut[t + 1])
                    found[w.row + t] = [(lam * s, a, z) for a, z, s in segments((at[own] - w.first[t]).tolist(), best[at[own]].tolist()) if lam * s >= LEAST_SCORE]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(size), pa.array(found, kind)], [*keep, "n_words", "passages"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


#: Levels of lambda times score at which segments of clean rows are counted.
LEVELS = range(1, 11)


def chance(clean: DataFrame) -> float:
    """K, so that no more than K n exp(-x) segments of lambda times score x or more are to be expected in n clean words.

    It is the largest that any of ``LEVELS`` asks for, as clean rows too hold a
    single strong word now and then and their tail is longer than the theory's.
    """
    n, *found = clean.agg(F.sum("n_words"), *(F.sum(_above(x)) for x in LEVELS)).first()
    return max(((k or 0) + 0.5 * (x == LEVELS[0])) * math.exp(x) for k, x in zip(found, LEVELS, strict=True)) / max(n or 0, 1)


def _above(x: float) -> Column:
    return F.size(F.filter("passages", lambda p: p["score"] >= x))


def significant(rows: DataFrame, k: float) -> DataFrame:
    """``rows`` with those of their passages that lie beyond chance, and ``stat``, the sum of how far each does."""
    beyond = F.log(F.greatest(F.lit(k) * F.col("n_words"), F.lit(1.0)))
    passages = F.filter(F.transform("passages", lambda p: F.struct((p["score"] - beyond).alias("score"), p["first"].alias("first"), p["last"].alias("last"))), lambda p: p["score"] > 0)
    return rows.withColumn("passages", passages).withColumn("stat", F.aggregate("passages", F.lit(0.0), lambda a, p: a + p["score"]))


def calibrate(rows: DataFrame, weights: dict[int, float]) -> tuple[float, float]:
    """Intercept and slope of log odds over log(1 + stat), from (toxic, stat) rows in at most ``BINS`` bins a label."""
    x = F.least(F.floor(F.log1p("stat") * 40), F.lit(BINS - 1))
    seen = [(r[0] / 40, r[1], r[2] * weights.get(r[1], 1.0)) for r in rows.groupBy(x.alias("x"), "toxic").count().collect()]
    a, b = 0.0, 1.0
    if {y for _, y, _ in seen} != {0, 1}:
        return (-50.0, 0.0)
    for _ in range(100):  # Newton's steps, with a weak prior on both values
        g0, g1, h00, h01, h11 = -0.01 * a, -0.01 * b, 0.01, 0.0, 0.01
        for v, y, n in seen:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * v))))
            g0, g1 = g0 + n * (y - p), g1 + n * (y - p) * v
            h00, h01, h11 = h00 + n * p * (1 - p), h01 + n * p * (1 - p) * v, h11 + n * p * (1 - p) * v * v
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + max(-2.0, min(2.0, da)), b + max(-2.0, min(2.0, db))
        if abs(da) + abs(db) < 1e-8:
            break
    return a, max(0.0, b)


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, all significant passages, and the strongest one's first and last word."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    train = stored(training_rows(docs, labels, rows), "toxicity-rows")
    c = counts(train)
    across = [evidence(train.filter(f"half = {h}").select(F.lit(0).alias("doc_id"), "text", "toxic"), fit(c, (1 - h,)), ("toxic",)) for h in (0, 1)]
    across = stored(across[0].unionByName(across[1]), "toxicity-across")
    k = chance(across.filter("toxic = 0"))
    true = {r[0]: r[1] for r in labels.filter(_usable()).groupBy("toxic").count().collect()}
    seen = c["sizes"].sum(1)
    a, b = calibrate(significant(across, k), {y: n / max(1, seen[y]) for y, n in true.items()})
    out = significant(evidence(docs, fit(c)), k).withColumn("score", 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.log1p("stat")))))
    best = F.array_max("passages")
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"), best["first"].alias("first_word"), best["last"].alias("last_word"), "passages")
