"""Benchmark decontamination with SimHash over item-sized windows.

The benchmark is taken in blocks of bounded size; each block is sent to all
tasks, which scan every document whole.

1. Items fall into classes of length.  Three windows of each item (first, middle
   and last, of its class's length: 60 to 75 % of its own) have 64-bit
   fingerprints: the signs of weighted sums over their words' hashes.  A passage
   that is cut or edited as far as the threshold allows still holds most of one.
2. Every window of class length in a document gets its fingerprint from sums over
   runs of 1, 2, 4, ... words; a long text is taken in overlapping stretches.
   Fingerprints are cut into four blocks of 16 bits.  Two fingerprints within
   ``RADIUS`` = 11 bits differ by at most 2 bits in some block, and each block's
   index lists the items' fingerprints under all values within 2 bits of theirs:
   none is missed.  Those listed are compared in full; the ones within the radius
   are candidates.
3. Fingerprints are a matter of chance at the edge of the radius.  So that no
   match depends on it, every place is a candidate too that has one of an item's
   *probes*: its rarest shingles, so many that what is left weighs less than the
   threshold of the whole.  A window without a probe cannot reach the threshold.
4. Around the candidates all item-sized windows (or the text, if it is shorter) are
   compared with the item by the weighted Jaccard similarity of their shingles,
   exactly; the best counts if it reaches the threshold.

A word weighs 1 up to three bytes (mostly function words), else 2; a shingle
weighs what its words do.

Defined results: null and empty texts and items match nothing; items of fewer
words than a shingle are compared by shingles of their own length; each row of
the documents is judged by itself, so repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import stored

RADIUS, BLOCK_RADIUS = 11, 2
#: Items, and bytes of their texts, that are sent to the tasks at a time.
ITEMS, ITEM_BYTES = 4_000, 4_000_000
#: Classes of length grow by this factor; longer windows than ``LONGEST`` words have no fingerprint of their own.
GROWTH, LONGEST = 1.25, 2_048
#: Bytes of text that are hashed, and words whose windows are fingerprinted, at a time.
SLICE, STRETCH = 150_000, 32_768


@dataclass
class Item:
    item_id: object
    hashes: np.ndarray
    weights: np.ndarray
    size: int  # of a shingle
    shingles: np.ndarray = field(init=False)
    shingle_weights: np.ndarray = field(init=False)

    def __post_init__(self):
        self.shingles, at = np.unique(wordhash.runs(self.hashes, self.size), return_index=True)
        self.shingle_weights = _sums(self.weights, self.size)[at]


@dataclass
class Class:
    """Fingerprints of windows of one length, with their items and their places in those."""

    length: int
    prints: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(init=False)

    def __post_init__(self):
        self.blocks = []
        for k in range(4):
            own = (self.prints >> np.uint64(16 * k)).astype(np.uint16)
            values = (own[:, None] ^ _NEAR[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            marked = np.zeros(65_536, bool)
            marked[values] = True
            # where the fingerprints of each of the block's 65,536 values begin, and the end
            starts = np.searchsorted(values[order], np.arange(65_537)).astype(np.int32)
            self.blocks.append((marked, starts, np.repeat(np.arange(len(own), dtype=np.int32), len(_NEAR))[order]))

    def near(self, p: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, fingerprint) of all pairs within the radius, among the windows that ``same`` allows."""
        windows, which = [], []
        for k, (marked, starts, prints) in enumerate(self.blocks):
            at = np.flatnonzero(marked[p[k]] & same)
            for part in np.split(at, range(50_000, len(at), 50_000)):
                value = p[k][part].astype(np.int32)
                first = starts[value]
                n = starts[value + 1] - first
                w = np.repeat(part, n)
                f = prints[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
                hit = np.bitwise_count(_whole(p[:, w]) ^ self.prints[f]) <= RADIUS
                windows.append(w[hit]), which.append(f[hit])
        return np.concatenate(windows), np.concatenate(which)


@dataclass
class Probes:
    size: int  # of a shingle
    keys: np.ndarray  # sorted
    first: np.ndarray  # of each key's items, and the total
    items: np.ndarray
    table: np.ndarray  # whether a key has these upper bits


def word_weights(sizes: np.ndarray) -> np.ndarray:
    return np.where(sizes <= 3, 1, 2)


def _sums(x: np.ndarray, n: int) -> np.ndarray:
    s = np.concatenate([[0], np.cumsum(x)])
    return s[n:] - s[:-n]


class Signs:
    """Sums of the words' signed weights over 1, 2, 4, ... words, a row for each of 64 bits."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, longest: int):
        # sums of up to 63 words fit a signed byte
        kind = np.int8 if 2 * longest < 128 else np.int16 if 2 * longest < 32_768 else np.int32
        w = weights.astype(kind)
        twice = 2 * w
        one = np.empty((64, len(hashes)), kind)
        for k in range(8):
            byte = (hashes >> np.uint64(8 * k)).astype(np.uint8)
            for j in range(8):
                one[8 * k + j] = (byte >> np.uint8(j) & np.uint8(1)).astype(kind) * twice - w
        self.sums = [one]
        while 2 ** len(self.sums) <= min(longest, len(hashes)):
            x, n = self.sums[-1], 2 ** (len(self.sums) - 1)
            self.sums.append(x[:, :-n] + x[:, n:])

    def prints(self, length: int) -> np.ndarray:
        """Fingerprints of all windows of ``length`` words, as 16-bit blocks (4, windows)."""
        n = self.sums[0].shape[1] - length + 1
        out = np.zeros((4, max(n, 0)), np.uint16)
        if n <= 0:
            return out
        at, total = 0, None
        for k in reversed(range(length.bit_length())):
            if length >> k & 1:
                part = self.sums[k][:, at : at + n]
                total = part if total is None else total + part
                at += 1 << k
        for k in range(64):
            out[k // 16] |= (total[k] > 0).astype(np.uint16) << np.uint16(k % 16)
        return out


def _whole(blocks: np.ndarray) -> np.ndarray:
    b = blocks.astype(np.uint64)
    return b[0] | b[1] << np.uint64(16) | b[2] << np.uint64(32) | b[3] << np.uint64(48)


_NEAR = np.array([m for m in range(65_536) if m.bit_count() <= BLOCK_RADIUS], np.uint16)


def index(rows: list[tuple[object, str]], size: int = 5) -> tuple[list[Item], list[Class]]:
    """The items with words, and their fingerprints by class of length."""
    items, by_length = [], {}
    for w in wordhash.slices(pa.array([t or "" for _, t in rows], pa.string())):
        for k in range(len(w.first) - 1):
            a, b = w.first[k], w.first[k + 1]
            if b > a:
                items.append(Item(rows[w.row + k][0], w.hashes[a:b], word_weights(w.sizes[a:b]), int(min(size, b - a))))
    for i, x in enumerate(items):
        n = len(x.hashes)
        length = n if n <= 10 else max(8, min(LONGEST, int(8 * GROWTH ** int(np.log(0.75 * n / 8) / np.log(GROWTH)))))
        by_length.setdefault(length, []).append(i)
    classes = []
    for length, own in sorted(by_length.items()):
        prints, who, offsets = [], [], []
        for i in own:
            p = _whole(Signs(items[i].hashes, items[i].weights, length).prints(length))
            for at in sorted({0, (len(p) - 1) // 2, len(p) - 1}):
                prints.append(p[at]), who.append(i), offsets.append(at)
        classes.append(Class(length, np.array(prints, np.uint64), np.array(who), np.array(offsets)))
    return items, classes


_UPPER = np.uint64(64 - 20)


def probes(items: list[Item], percent: int) -> list[Probes]:
    """By size of shingle the items' probes: what any window of ``percent`` similarity has one of."""
    out = []
    for size in sorted({x.size for x in items}):
        own = [i for i, x in enumerate(items) if x.size == size]
        _, at, df = np.unique(np.concatenate([items[i].shingles for i in own]), return_inverse=True, return_counts=True)
        df = np.split(df[at], np.cumsum([len(items[i].shingles) for i in own])[:-1])
        keys = []
        for i, d in zip(own, df, strict=True):
            x = items[i]
            order = np.lexsort((x.shingles, -d))
            left = np.cumsum(x.shingle_weights[order])
            keys.append(x.shingles[order[100 * left >= percent * left[-1]]])
        who = np.repeat(np.array(own), [len(k) for k in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        table = np.zeros(1 << 20, bool)
        table[keys >> _UPPER] = True
        out.append(Probes(size, keys, np.append(first, len(who)), who[order], table))
    return out


def _probed(w: wordhash.Words, text: np.ndarray, known: list[Probes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word, item) of each probe in the texts."""
    found = []
    for p in known:
        s = wordhash.runs(w.hashes, p.size)
        at = np.flatnonzero(p.table[s >> _UPPER])
        at = at[text[at] == text[at + p.size - 1]]
        k = np.minimum(np.searchsorted(p.keys, s[at]), len(p.keys) - 1)
        same = p.keys[k] == s[at]
        at, k = at[same], k[same]
        n = p.first[k + 1] - p.first[k]
        at, who = np.repeat(at, n), p.items[np.repeat(p.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        found.append((at, at + p.size, who))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3


def _printed(w: wordhash.Words, text: np.ndarray, weights: np.ndarray, classes: list[Class]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, item) of the windows whose fingerprint is near one of an item's."""
    found = [(np.zeros(0, int),) * 3]
    longest = max((c.length for c in classes), default=0)
    for lo in range(0, len(w.hashes), STRETCH):
        part = slice(lo, lo + STRETCH + longest)
        signs = Signs(w.hashes[part], weights[part], longest)
        for c in classes:
            p = signs.prints(c.length)[:, :STRETCH]
            m = p.shape[1]
            at, f = c.near(p, text[lo : lo + m] == text[lo + c.length - 1 : lo + c.length - 1 + m])
            found.append((at + lo, at + lo + c.length, c.items[f]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _stretches(w: wordhash.Words, text: np.ndarray, items: list[Item], first: np.ndarray, end: np.ndarray, who: np.ndarray):
    """(text, item, first word, end) of the stretches that hold all item-sized windows around the candidates.

    Stretches of one item that overlap are one.
    """
    t, size = text[first], np.array([len(x.hashes) for x in items])[who]
    size = np.maximum(size, end - first)
    a, b = np.maximum(end - size, w.first[t]), np.minimum(first + size, w.first[t + 1])
    order = np.lexsort((a, who, t))
    last = None
    for x in zip(t[order].tolist(), who[order].tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        if last and x[:2] == last[:2] and x[2] < last[3]:
            last = (*last[:3], max(last[3], x[3]))
        else:
            if last:
                yield last
            last = x
    if last:
        yield last


def similarity(item: Item, hashes: np.ndarray, weights: np.ndarray, percent: int = 0) -> tuple[float, int]:
    """Best weighted Jaccard similarity of the item's windows in these words, and where.

    Windows that cannot reach ``percent`` are left out.
    """
    n, k = len(item.hashes), item.size
    if len(hashes) < k:
        return 0.0, 0
    s, sw = wordhash.runs(hashes, k), _sums(weights, k)
    shared = np.isin(s, item.shingles)
    if not shared.any():
        return 0.0, 0
    total, best = item.shingle_weights.sum(), (0.0, 0)
    # a shingle that a window repeats counts each time: no less than what is shared
    most = _sums(np.where(shared, sw, 0), min(len(s), n - k + 1))
    for at in np.flatnonzero(100 * most >= percent * total).tolist():
        u, first = np.unique(s[at : at + n - k + 1], return_index=True)
        uw = sw[at : at + n - k + 1][first]
        both = uw[np.isin(u, item.shingles, assume_unique=True)].sum()
        best = max(best, (both / (total + uw.sum() - both), -at))
        if best[0] == 1:
            break
    return float(best[0]), -best[1]


def scan(w: wordhash.Words, items: list[Item], classes: list[Class], known: list[Probes], percent: int):
    """(row, item, similarity, first word, words) of the matches in some texts."""
    if not len(w.hashes) or not classes:
        return
    text, weights = w.text_of_word(), word_weights(w.sizes)
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    both = (np.concatenate(x) for x in zip(_printed(w, text, weights, classes), _probed(w, text, known), strict=True))
    for t, i, a, b in _stretches(w, text, items, *both):
        if found.get((t, i), (0.0,))[0] < 1:  # an exact passage further on changes nothing: the first counts
            s, k = similarity(items[i], w.hashes[a:b], weights[a:b], percent)
            if 100 * s >= percent:
                found[t, i] = max(found.get((t, i), (0.0, 0, 0)), (s, -(a + k - int(w.first[t])), min(len(items[i].hashes), b - a)))
    for (t, i), (s, at, n) in found.items():
        yield w.row + t, items[i].item_id, s, -at, n


def _blocks(bench: DataFrame, items: int, size: int, percent: int):
    """The benchmark (item_id, text) in blocks, each sent to all tasks: items, classes and probes."""
    n, size_bytes = bench.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // items), -(-size_bytes // ITEM_BYTES))
    for k in range(blocks):
        block = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        own, classes = index(list(zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True)), size)
        yield bench.sparkSession.sparkContext.broadcast((own, classes, probes(own, percent)))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 5, percent: int = 75, items: int = ITEMS) -> DataFrame:
    """A row for each document row and item that it has a passage of.

    Columns: doc_id, item_id, similarity, first_word (from 0), n_words.
    """
    bench = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, item_id {bench.schema['item_id'].dataType.simpleString()}, similarity double, first_word long, n_words long"
    item_type = bench.limit(0).toArrow().schema.field("item_id").type
    out = None
    for known in _blocks(bench, items, size, percent):

        def run(batches, known=known):
            own, classes, marks = known.value
            for b in batches:
                rows = [r for w in wordhash.slices(b.column(1), SLICE) for r in scan(w, own, classes, marks, percent)]
                row, item, s, at, n = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(item, item_type), pa.array(s, pa.float64()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        some = kept.mapInArrow(run, schema)
        out = some if out is None else out.unionByName(some)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 5, percent: int = 75, items: int = ITEMS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; ids play no part."""
    bench = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    out, at = docs, docs.columns.index(text_col)
    for k, known in enumerate(_blocks(bench, items, size, percent)):
        if k:  # else the workers of all blocks would hold theirs at once
            out = stored(out, "clean")

        def run(batches, known=known):
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for w in wordhash.slices(b.column(at), SLICE):
                    clean[[r[0] for r in scan(w, *known.value, percent)]] = False
                yield b.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
