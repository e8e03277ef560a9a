"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import spelling


def counted(rows):
    out = collections.Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'null' if i is None else i}:{r}".encode())
            out[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 97 == 0 else r] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(words):
    forms = {}
    out = {}
    for w, n in words.items():
        some = [(-words[v], v) for v in words if near(w, v)]
        k, v = min(some, default=(0, None))
        forms[w] = v if some and -k >= 2 * n else None
        out[w] = [forms[w], None, n, len(some), -k if forms[w] else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def result(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def edited(rnd, w, alphabet):
    i = rnd.randrange(len(w) + 1)
    return rnd.choice([w[:i] + rnd.choice(alphabet) + w[i:], w[:i] + rnd.choice(alphabet) + w[i + 1 :], w[: max(i - 1, 0)] + w[i:]])


@pytest.mark.parametrize("seed", range(3))
def test_variants(spark, seed):
    rnd = random.Random(seed)
    alphabet = ["abß", "abcdeñü", "aeiounrst"][seed]
    stems = ["".join(rnd.choices(alphabet, k=rnd.randint(4, 12))) for _ in range(40)] + ["a" * 40, "ab" * 16, "abc" * 30, "a" * 31, "n" * 33]
    pool = [w for s in stems for w in [s, *(edited(rnd, s, alphabet) for _ in range(6))]]
    pool += [edited(rnd, w, alphabet) for w in pool]
    weight = [rnd.choice([1, 1, 2, 5, 20]) for _ in pool]
    rows = [(i, " ".join(x if rnd.random() < 0.8 else x.upper() for x in rnd.choices(pool, weight, k=60)) + rnd.choice(["", "語", "\nx'y ", "×÷ÀÿĀ"])) for i in range(90)]
    rows += [(None, "Hello hello HELLO hallo"), (7, None), (7, ""), (7, "hello hallo hallo"), (7, "hello hallo hallo")]
    words = counted(rows)
    assert len(words) > 100
    df = spark.createDataFrame([(i, t, "w", 3) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    assert result(spelling.variants(df)) == brute(words)


def test_empty(spark):
    df = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert spelling.variants(df).count() == 0 and spelling.variants(df.limit(0)).count() == 0


def test_ties_and_chains(spark):
    """The first of equal forms in code-point order; a root over several steps."""
    texts = {"house": 100, "houße": 40, "mouße": 12, "mouses": 2, "moußez": 4, "rouse": 100}
    words = {w: n for w, n in texts.items() if n >= 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = result(spelling.group(df, spelling.near_pairs(df)))
    assert got == brute(words)
    assert got["moußez"][1] == "house"


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=5, max_size=9), st.integers(0, 10**6), st.sets(st.text("abc^$", min_size=3, max_size=5), max_size=25))
def test_bound(word, seed, grams):
    """One edit leaves all grams but the bound, at their place or one beside it, whatever the dictionary."""
    index, rnd = spelling.Grams(grams), random.Random(seed)
    other = edited(rnd, word, "abcd")
    a, b = spelling.framed(word), spelling.framed(other)
    cut_a, cut_b = index.decompose(a), index.decompose(b)
    here = collections.Counter(b[p:e] for p, e in cut_b)
    there = collections.Counter(a[p:e] for p, e in cut_a)
    assert sum((here & there).values()) >= len(cut_a) - index.bound(a, cut_a)


@pytest.mark.parametrize("grams", [set(), {"abc", "bca", "cab", "abca", "^ab", "ca$", "bcab"}])
def test_pairs_whatever_the_dictionary(spark, grams):
    rnd = random.Random(len(grams))
    words = {"".join(rnd.choices("abc", k=rnd.randint(5, 8))) for _ in range(300)}
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(df, grams).collect()]
    assert len(set(got)) == len(got)
    assert set(got) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_words_and_their_keys_are_not_broadcast(spark, tmp_path):
    """The planner takes a word's keys for as little as the word: where words just fit a broadcast, their keys do not."""
    rnd = random.Random(5)
    words = {"".join(rnd.choices("abc", k=6)): n for n in range(3, 90)}
    spark.createDataFrame(list(words.items()), "word string, n long").write.parquet(str(tmp_path / "words"))
    df = spark.read.parquet(str(tmp_path / "words"))
    pairs = spelling.near_pairs(df, set())
    out = spelling.group(df, pairs)
    for x in (pairs, out):
        assert "BroadcastHashJoin" not in x._jdf.queryExecution().executedPlan().toString()
    assert result(out) == brute(words)
