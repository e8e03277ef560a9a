"""Grouping of spelling variants over a variable-length gram index.

1. Words and their frequencies come from all texts; every task adds up its own.
2. The gram dictionary: all grams of two characters, and longer ones, up to
   ``LONGEST``, where the gram that they extend is frequent.  Frequent means a share
   of all grams (``SHARE``), so that the dictionary's size is bounded by the
   alphabet and that share, however many words there are; it is broadcast.
3. A word is decomposed into variable grams: from each place the longest gram of
   the dictionary, but for grams inside an earlier one.  For every place where an
   edit may happen, the grams that it may affect are counted: those over the place,
   those before it that a longer gram might replace or swallow, and those behind it
   that a gram which begins before them might swallow.  The worst place gives the
   word's bound.
4. Near words share all grams but those that the edit affects.  Where that is two
   grams or more, two shared ones are among the rarest of either word, as many as
   its bound and two.  The lists of pairs of such grams, with their places (an edit
   moves what is behind it by one at most) and the word's length, are merged, and
   words that meet are verified.  Frequent grams' lists are never read.
5. Words whose bounds leave no two grams meet each other by their deletions, words
   of ``LONG`` characters and more by their halves, one of which no edit touches.
6. Near words are counted, each word's form is chosen, and roots are found by
   pointer doubling: a form is at least twice as frequent as its word, so that
   chains end after a logarithm of the largest frequency.

Defined results: null and empty texts have no words; null ids stand as "null" in
the hash; repeated rows count again; of several near words of one frequency the
first in code-point order is the form.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .pieces import texts

#: Runs in Latin-1: what is not of it separates runs like any other sign.
RUN = re.compile(rb"[a-z\xc0-\xff]+")
#: Characters and occurrences of a word; how much more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: Lengths of grams, and the share of all grams from which a gram is extended; a longer one is kept from an eighth of it.
SHORTEST, LONGEST, SHARE = 2, 3, 1 / 10_000
#: From this length on words are compared by halves.
LONG = 32
#: Bytes of counts that a task holds.
HELD = 64_000_000
#: Bits of a gram's number, a place and a length in a key.
_GRAM, _PLACE = 17, 6


def runs(text: str) -> list[bytes]:
    """The runs of letters of a text in Latin-1, A-Z in lower case."""
    return RUN.findall(text.encode("latin-1", "replace").lower())


def noisy(run: bytes, before: int) -> bytes:
    """The run, without one letter where its hash says so; ``before`` is the checksum of what stands ahead of it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def frequencies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts, one code point dropped where the hash of document and word says so."""
    kept = df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        seen, held = Counter(), 0

        def flush():
            rows = list(seen.items())
            seen.clear()
            for at in range(0, len(rows), 50_000):
                w, n = zip(*rows[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([x.decode("latin-1") for x in w], pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), texts(b, 1), strict=True):
                size, before = len(seen), zlib.crc32(f"{'null' if key is None else key}:".encode())
                for w, n in Counter(runs(t)).items():
                    w = noisy(w, before)
                    if len(w) >= LEAST_LENGTH:
                        seen[w] += n
                held += (len(seen) - size) * 160
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    return kept.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def framed(word: str) -> str:
    """A word between marks, so that its first and last characters are in two grams too."""
    return f"^{word}$"


class Grams:
    """The gram dictionary: which grams to take, and what may become one."""

    def __init__(self, grams: set[str]):
        self.grams = grams
        #: Proper prefixes of grams, and proper suffixes.
        self.begins = {g[:k] for g in grams for k in range(1, len(g))}
        self.ends = {g[k:] for g in grams for k in range(1, len(g))}
        self.longest = max(map(len, grams), default=SHORTEST)

    def decompose(self, s: str) -> list[tuple[int, int]]:
        """(start, end) of the variable grams of ``s``."""
        out, reached, grams = [], 0, self.grams
        for at in range(len(s) - SHORTEST + 1):
            for size in range(min(self.longest, len(s) - at), SHORTEST, -1):
                if s[at : at + size] in grams:
                    break
            else:
                size = SHORTEST
            if at + size > reached:
                reached = at + size
                out.append((at, reached))
        return out

    def bound(self, s: str, cut: list[tuple[int, int]]) -> int:
        """How many of the grams of ``s`` one edit of a character may affect, at most.  The frame is never edited."""
        n, worst = len(s), 0
        far = [self._reach(s, at) for at in range(n + 1)]
        for at in range(1, n):
            # before this place: the first start from which a longer gram may reach over it
            low = at
            for q in range(max(0, at - self.longest + 1), at):
                if s[q:at] in self.begins:
                    low = q
                    break
            # an insertion here, and the character here deleted or replaced; behind it, what a gram from before may reach
            insert = change = 0
            for p, e in cut:
                if p < at:
                    if e > at or p >= low:
                        insert += 1
                        change += 1
                else:
                    insert += e <= far[at]
                    change += p == at or e <= far[at + 1]
            worst = max(worst, insert, change if at < n - 1 else 0)
        return worst

    def _reach(self, s: str, at: int) -> int:
        for x in range(min(len(s), at + self.longest - 1), at, -1):
            if s[at:x] in self.ends:
                return x
        return at


def dictionary(words: DataFrame, share: float = SHARE) -> set[str]:
    """The pruned dictionary, built from all words."""
    framed_word = F.concat(F.lit("^"), "word", F.lit("$"))
    size = F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("framed")))
    all_grams = (
        words.select(framed_word.alias("framed")).select("framed", F.explode(size).alias("size"))
        .select(F.explode(F.expr("transform(sequence(1, length(framed) - size + 1), i -> substring(framed, i, size))")).alias("gram"))
        .groupBy("gram").agg(F.count("*").alias("n"))
    )
    counts = stored(all_grams, "grams")
    least = F.lit((counts.filter(F.length("gram") == SHORTEST).agg(F.sum("n")).first()[0] or 0) * share)
    # a gram is frequent if so many words have it; all shorter ones in it then are too
    extended = counts.filter((F.col("n") > least) & (F.length("gram") < LONGEST)).select(F.col("gram").alias("stem"))
    longer = counts.filter((F.length("gram") > SHORTEST) & (F.col("n") > least / 8)).withColumn("stem", F.expr("left(gram, length(gram) - 1)"))
    got = longer.join(F.broadcast(extended), "stem").select("gram").toArrow()
    return set(got.column("gram").to_pylist())


def _number(x: str) -> int:
    """A negative number for a text; gram keys are not negative."""
    return -1 - (int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) >> 1)


def keys(word: str, index: Grams, rank: dict[str, int]) -> Iterator[tuple[int, bool]]:
    """A word's keys: near words share one that neither asks with, or one that the longer asks with and the other holds."""
    size = len(word)
    if size >= LONG:
        half = size // 2
        yield _number(f"{size}<{word[:half]}"), False
        yield _number(f"{size}>{word[half:]}"), False
        half = (size - 1) // 2
        yield _number(f"{size - 1}<{word[:half]}"), True
        yield _number(f"{size - 1}>{word[half + 1 :]}"), True
    if size > LONG:
        return
    s = framed(word)
    cut = index.decompose(s)
    bound = index.bound(s, cut)
    if len(cut) - bound < 2:
        for x in {word, *(word[:i] + word[i + 1 :] for i in range(size))}:
            yield _number(x), False
    grams = sorted((rank[s[p:e]], p) for p, e in cut)
    last = grams[min(len(grams), bound + 2) - 1][0]
    # by place; ties of the last gram come along
    for (p, g), (q, h) in combinations(sorted((p, g) for g, p in grams if g <= last), 2):
        yield _key(g, p, h, q, size), False
        # one letter less: the edit is behind both, between them, or ahead of both
        yield _key(g, p, h, q, size - 1), True
        yield _key(g, p, h, q - 1, size - 1), True
        if p:
            yield _key(g, p - 1, h, q - 1, size - 1), True


def _key(g: int, p: int, h: int, q: int, size: int) -> int:
    return ((((g << _PLACE | p) << _GRAM | h) << _PLACE | q) << _PLACE) | size


def near_pairs(words: DataFrame, grams: set[str] | None = None) -> DataFrame:
    """(a, b, n_a, n_b): the pairs of ``words`` that one inserted, deleted or replaced code point makes equal, each once."""
    index = Grams(dictionary(words) if grams is None else grams)

    def count(batches):
        for b in batches:
            seen = Counter(s[p:e] for s in map(framed, texts(b, 0)) for p, e in index.decompose(s))
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["gram", "n"])

    # no more rows than the dictionary has grams, and pairs of letters
    got = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    order = sorted(zip(got.column("n").to_pylist(), got.column("gram").to_pylist(), strict=True))
    if len(order) >= 1 << _GRAM:
        raise ValueError("too many grams: take a larger share")
    rank = words.sparkSession.sparkContext.broadcast({g: k for k, (_, g) in enumerate(order)})

    def make(batches):
        for b in batches:
            for part in (b.slice(i, 2000) for i in range(0, b.num_rows, 2000)):
                at, key, ask = [], [], []
                for i, w in enumerate(texts(part, 0)):
                    for k, a in keys(w, index, rank.value):
                        at.append(i), key.append(k), ask.append(a)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in part.columns), pa.array(key, pa.int64()), pa.array(ask, pa.bool_())], ["word", "n", "key", "ask"])

    rows = words.select("word", "n").mapInArrow(make, "word string, n long, key long, ask boolean")
    asks = rows.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "key", "ask")
    held = rows.filter(~F.col("ask")).select(F.col("word").alias("b"), F.col("n").alias("n_b"), "key")
    # the planner takes a word's keys for as little as the word
    met = asks.hint("merge").join(held, "key").filter(F.col("ask") | (F.col("a") < F.col("b")))
    return met.filter("levenshtein(a, b, 1) = 1").select("a", "b", "n_a", "n_b").distinct()


def group(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per word: form, root, n, n_near and form_n.  Stored words are small as files, so that their tables are not broadcast."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = words.hint("merge").join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= TIMES * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f"))
    out = stored(out.select("word", "n", "n_near", "f.form", "f.form_n"), "forms")
    chain = stored(out.filter("form is not null").select("word", F.col("form").alias("root")), "roots-0")
    for k in range(1, 64):
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(chain.hint("merge").join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots-{k}")
        chain = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return out.hint("merge").join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n (see above)."""
    words = stored(frequencies(df, id_col, text_col), "words")
    return group(words, near_pairs(words))
