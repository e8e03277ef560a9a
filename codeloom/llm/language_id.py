"""Language mixtures of documents by expectation-maximisation.

1. Likelihoods.  Hashed byte trigrams around letters are counted by language over
   labelled rows (a bounded sample: about ``ROWS`` a language, by hash of the id)
   and smoothed towards all languages together.
2. Mixture.  A document's words go in units of ``UNIT``; letters without a space
   count as a new word every ``RUN`` bytes.  Expectation-maximisation
   estimates the proportions of the languages from the units' likelihoods.
3. Selection.  Languages join one by one, by falling proportion, as long as the
   likelihood rises by more than a penalty that grows with the logarithm of the
   number of units.

The table has languages times ``BUCKETS`` values whatever the input's size; more
than ``MOST_LANGUAGES`` labels raise an error.

Defined results: a null text, one without a letter, and every text where nothing
was learned are ``und`` with score 0; a text with a letter but no trigram gets
the most frequent label, with its share of the learned rows as score; a null id
is a row like any other; ties go to the language that comes first by name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import crc_mod

ROWS, BUCKETS, UNIT = 5_000, 1 << 16, 4
RUN, MOST_LANGUAGES = 32, 256
SLICE = 1_000_000  # bytes of text at a time
PENALTY, ROUNDS = 3.0, 12
_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.full(256, 32, np.int64)
_LOWER[128:] = np.arange(128, 256)
_LOWER[65:91] = _LOWER[97:123] = np.arange(97, 123)


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, place) of each trigram with a letter in its middle, and the folded bytes.

    Trigrams do not cross from one text to the next.
    """
    m = _LOWER[data]
    if len(m) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), m
    h = (m[:-2] * 0x9E3779B1 + m[1:-1] * 0x85EBCA6B + m[2:] * 0xC2B2AE35) & 0xFFFFFFFF
    h = (h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
    own = m[1:-1] != 32
    edges = bounds[1:-1]
    for d in (1, 2):
        own[edges[(edges >= d) & (edges - d < len(own))] - d] = False
    at = np.flatnonzero(own)
    return (h[at] >> 16) % BUCKETS, at + 1, m


def count(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over labelled rows (text, lang)."""

    def run(batches):
        for b in batches:
            langs = b.column(1).to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            total = np.zeros((len(names), BUCKETS), np.int64)
            for data, bounds, row in wordhash.buffers(b.column(0)):
                bucket, at, _ = trigrams(data, bounds)
                lang = code[row + np.searchsorted(bounds, at, "right") - 1]
                total += np.bincount(lang * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
            lang, bucket = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in lang.tolist()], pa.string()), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, rows: int = ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages, the log-likelihood of each bucket in each, and their shares of the labelled rows."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(crc_mod(F.col("doc_id"), 5), F.lit(1)) != 0))
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels in the column of languages")
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)
    h = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000))
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows / n) * 1_000_000)))
    counted = count(labelled.filter(h < share[F.col("lang")])).toArrow()
    langs = sorted(sizes)
    n = np.zeros((BUCKETS, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    n[counted.column("bucket").to_numpy(), [place[x] for x in counted.column("lang").to_pylist()]] = counted.column("n").to_numpy()
    every = n.sum(1) + 0.5
    prior = 200.0 * every / every.sum()
    share = np.array([sizes[x] for x in langs]) / sum(sizes.values())
    return langs, np.log((n + prior[:, None]) / (n.sum(0) + 200.0)).astype(np.float32), share


def _groups(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``x`` between bounds, some of which may be equal."""
    out = np.zeros((len(bounds) - 1, *x.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(x, bounds[:-1][full], axis=0, dtype=np.float64)
    return out


def mixture(ll: np.ndarray, first: np.ndarray, mask: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text, over the languages that ``mask`` allows it.

    ``ll``: log-likelihoods of units; text i has those from first[i] to first[i + 1].
    """
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    top = np.where(mask[of], ll, -np.inf).max(1, initial=-np.inf)
    like = np.where(mask[of], np.exp(ll - top[:, None]), 0.0)
    share = mask / np.maximum(mask.sum(1, keepdims=True), 1)
    moving = n > 0  # each text goes on until its own proportions settle, whatever is beside it
    for _ in range(rounds):
        if not moving.any():
            break
        r = share[of] * like
        r /= r.sum(1, keepdims=True)
        new = np.where(moving[:, None], _groups(r, first) / np.maximum(n, 1)[:, None], share)
        moving &= np.abs(new - share).max(1) >= 1e-3
        share = new
    total = np.log(np.maximum((share[of] * like).sum(1), 1e-300)) + top
    return share, _groups(total, first)


def select(ll: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Proportions over each text's selected languages (0 for the others)."""
    n_langs, n = ll.shape[1], np.diff(first)
    alone = _groups(ll, first)
    share, _ = mixture(ll, first, np.ones((len(n), n_langs), bool))
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    best = np.argmax(alone, axis=1)
    out = np.zeros((len(n), n_langs))
    out[np.arange(len(n)), best] = 1.0
    value = alone[np.arange(len(n)), best]
    penalty = PENALTY * np.log(np.maximum(n, 2))
    going = np.flatnonzero(n > 1)
    for k in range(2, n_langs + 1):
        if not len(going):
            break
        units = np.concatenate([np.arange(a, b) for a, b in zip(first[going].tolist(), first[going + 1].tolist(), strict=True)])
        sub = np.concatenate([[0], np.cumsum(n[going])])
        s, v = mixture(ll[units], sub, rank[going] < k)
        better = v - penalty[going] > value[going]
        out[going[better]] = s[better]
        value[going[better]] = v[better]
        going = going[better]
    return out


def long_units(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`units` of one long text, taken in stretches that end behind a byte without a letter, if there is one."""
    found, at = [], 0
    while at < len(data):
        stop = min(at + SLICE, len(data))
        gap = np.flatnonzero(_LOWER[data[at:stop]] == 32)
        stop = at + int(gap[-1]) + 1 if stop < len(data) and len(gap) else stop
        found.append(units(data[at:stop], np.array([0, stop - at]), table)[0])
        at = stop
    ll = np.concatenate(found)
    return ll, np.array([0, len(ll)])


def units(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of units of ``UNIT`` words, and where each text's begin.

    Letters without a space between them count as a new word every ``RUN`` bytes.
    """
    bucket, at, m = trigrams(data, bounds)
    letter = m != 32
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    inner = bounds[:-1][bounds[:-1] < len(m)]
    start[inner] = letter[inner]
    begun = np.flatnonzero(start)
    if len(begun):
        place = np.arange(len(m))
        since = place - begun[np.maximum(np.cumsum(start) - 1, 0)]
        start |= letter & (since > 0) & (since % RUN == 0)
    word = np.cumsum(start)  # number of words begun, through each byte
    text = np.searchsorted(bounds, at, "right") - 1
    ahead = np.concatenate([[0], word])[bounds[:-1]]  # words of earlier texts
    unit = (word[at] - 1 - ahead[text]) // UNIT
    change = np.ones(len(at), bool)
    change[1:] = (text[1:] != text[:-1]) | (unit[1:] != unit[:-1])
    begin = np.flatnonzero(change)
    ll = np.add.reduceat(table[bucket], begin, axis=0) if len(begin) else np.zeros((0, table.shape[1]))
    return ll, np.searchsorted(text[begin], np.arange(len(bounds)))


def predict(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (its proportion) and langs (all selected, as name:proportion)."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sent = df.sparkSession.sparkContext.broadcast(fit(docs, rows))

    def run(batches):
        names, ll, prior = sent.value
        usual = int(np.argmax(prior)) if names else 0
        for b in batches:
            texts = b.column(1)
            pred, score, said = ["und"] * b.num_rows, [0.0] * b.num_rows, [""] * b.num_rows
            for data, bounds, row in wordhash.buffers(texts, SLICE):
                if not names:
                    break
                u, first = units(data, bounds, ll) if len(data) <= SLICE else long_units(data, ll)
                share = select(u, first)
                top = np.argmax(share, axis=1)
                for t in range(len(bounds) - 1):
                    if bounds[t + 1] > bounds[t] and _LETTER.search(texts[row + t].as_py()):
                        if first[t] == first[t + 1]:
                            pred[row + t], score[row + t] = names[usual], float(prior[usual])
                            continue
                        s = share[t]
                        pred[row + t], score[row + t] = names[top[t]], float(min(1.0, s[top[t]]))
                        said[row + t] = ",".join(f"{names[i]}:{s[i]:.3f}" for i in np.argsort(-s, kind="stable") if s[i] > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred), pa.array(score, pa.float64()), pa.array(said)], ["doc_id", "lang_pred", "score", "langs"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, langs string")
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "langs")
