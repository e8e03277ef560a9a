"""Languages of texts, one text at a time in plain Python: counts, likelihoods, expectation-maximisation, selection."""

import math
import random
import re
import zlib

import pytest

from codeloom.llm import language_id

BUCKETS = 1 << 16


def folded(text):
    return [x + 32 if 65 <= x <= 90 else x if x >= 128 or 97 <= x <= 122 else 32 for x in text.encode()]


def grams(m):
    """(bucket, place) of trigrams with a letter in the middle."""
    for i in range(len(m) - 2):
        if m[i + 1] != 32:
            h = (m[i] * 0x9E3779B1 + m[i + 1] * 0x85EBCA6B + m[i + 2] * 0xC2B2AE35) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
            yield (h >> 16) % BUCKETS, i + 1


def fitted(rows):
    used = [(t, lang) for i, t, lang in rows if lang is not None and t is not None and (i is None or zlib.crc32(str(i).encode()) % 5 != 0)]
    langs = sorted({x for _, x in used})
    n = {x: {} for x in langs}
    for t, x in used:
        for b, _ in grams(folded(t)):
            n[x][b] = n[x].get(b, 0) + 1
    size = {x: sum(n[x].values()) for x in langs}
    every = sum(size.values()) + 0.5 * BUCKETS

    def ll(b, x):
        prior = 200.0 * (sum(n[y].get(b, 0) for y in langs) + 0.5) / every
        return math.log((n[x].get(b, 0) + prior) / (size[x] + 200.0))

    return langs, ll, [sum(y == x for _, y in used) / len(used) for x in langs]


def units(text, langs, ll):
    m, word, words, begun = folded(text), [], 0, 0
    for i, x in enumerate(m):
        if x != 32:
            if i == 0 or m[i - 1] == 32:
                words, begun = words + 1, i
            elif (i - begun) % 32 == 0:
                words += 1
        word.append(words)
    out = {}
    for b, at in grams(m):
        own = out.setdefault((word[at] - 1) // 4, [0.0] * len(langs))
        for k, x in enumerate(langs):
            own[k] += ll(b, x)
    return [out[k] for k in sorted(out)]


def mixture(rows, allowed):
    share = [1 / len(allowed) if k in allowed else 0.0 for k in range(len(rows[0]))]
    top = [max(r[k] for k in allowed) for r in rows]
    like = [[math.exp(x - t) if k in allowed else 0.0 for k, x in enumerate(r)] for r, t in zip(rows, top, strict=True)]
    for _ in range(12):
        new = [0.0] * len(share)
        for r in like:
            total = sum(s * x for s, x in zip(share, r, strict=True))
            for k, x in enumerate(r):
                new[k] += share[k] * x / total / len(rows)
        done = max(abs(a - b) for a, b in zip(new, share, strict=True)) < 1e-3
        share = new
        if done:
            break
    return share, sum(math.log(sum(s * x for s, x in zip(share, r, strict=True))) + t for r, t in zip(like, top, strict=True))


def chosen(rows):
    count = len(rows[0])
    alone = [sum(r[k] for r in rows) for k in range(count)]
    best = max(range(count), key=lambda k: (alone[k], -k))
    out, value = [float(k == best) for k in range(count)], alone[best]
    order = sorted(range(count), key=lambda k: (-mixture(rows, range(count))[0][k], k))
    for k in range(2, count + 1 if len(rows) > 1 else 2):
        share, v = mixture(rows, order[:k])
        if v - 3.0 * math.log(max(len(rows), 2)) <= value:
            break
        out, value = share, v
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_language_by_brute_force(spark, parts):
    rnd = random.Random(23)
    alphabets = {"aa": "abcdefg", "bb": "hijklmñ", "cc": "opqrstü", "dd": "abchijop"}
    make = lambda lang, n: " ".join("".join(rnd.choices(alphabets[lang], k=rnd.randint(2, 8))) for _ in range(n))
    rows = [(i, make(lang, rnd.randint(3, 30)), lang) for i, lang in enumerate(rnd.choices(list(alphabets), [5, 3, 3, 2], k=80))]
    rows += [(200 + i, make("aa", 20) + ". " + make("bb", 20) + rnd.choice(["", " " + make("cc", 25)]), None) for i in range(12)]
    rows += [(300, None, "aa"), (301, "", "bb"), (302, "12 !?", None), (303, "ab", None), (304, "q" * 200, None), (None, make("cc", 9), None), (305, "É", None), (5, "abc abc", None), (5, "abc abc", None)]
    langs, ll, prior = fitted(rows)
    want = []
    for i, t, _ in rows:
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        if t is None or not re.search(r"[^\W\d_]", t):
            want.append((i, held, "und", 0.0))
        elif u := units(t, langs, ll):
            share = chosen(u)
            k = max(range(len(langs)), key=lambda j: (share[j], -j))
            want.append((i, held, langs[k], share[k]))
        else:
            k = max(range(len(langs)), key=lambda j: (prior[j], -j))
            want.append((i, held, langs[k], prior[k]))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string").repartition(parts)
    got = [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in language_id.predict(df).collect()]
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 3))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-4, (a, b)
    assert sum(0.02 < s < 0.98 for *_, s in want) > 5
