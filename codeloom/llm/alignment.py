"""Alignment of two tokenizers' tokens over the bytes of a text.

Tokenizer A is a byte-level BPE that reads a space and the text; tokenizer B is a
SentencePiece BPE that puts that space ahead itself.  Both cut the same bytes.

1. A text falls into units at which neither tokenizer joins anything: runs of
   white space that begin with a space or a line feed, and what follows them.
   Tasks hold a table of distinct units, within bounded memory.
2. New units are aligned together by sparse products.  ``A`` and ``B`` are the
   incidence matrices of tokens and bytes in compressed rows; row products of A
   and B transposed give the pairs of tokens that overlap.  A group ends where a
   token of A and the last token of B that it overlaps end at the same byte.
   With the incidence of tokens and groups, the same product gives the pairs that
   share a group.
3. Each text's distinct id pairs are stored with its own figures.  Spark counts, for
   each id pair, the documents that hold it, and for each id of A the highest
   count: a table no larger than the vocabulary, which is broadcast.  The
   ``HEAD`` most frequent pairs are broadcast too; the rest, which few
   documents hold, meet their counts in a join.

Defined results: null and empty texts, and those whose tokens do not give back
the text's bytes, have no tokens, and all figures are 0; null ids and repeated
rows each keep their row, and count as documents of their own; further columns of
the input are no matter.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .pieces import model_bytes, segmenter, texts

#: Bytes of a task's table of units, bytes of text handled at once, id pairs broadcast with their counts.
TABLE_BYTES, SLICE_BYTES, HEAD = 64_000_000, 1_500_000, 1_000_000
#: Longer units are aligned where they stand and not kept.
LONG = 256

_W = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_X = _W.replace("\t-\r ", "\t\x0b-\r")  # white space at which B may join
UNIT = re.compile(f"[ \n][{_W}]*+(?:[^{_W}]++(?:[{_X}][{_W}]*+)?)*+")
#: Texts without this have units that a split at spaces finds.
_RUN = re.compile(f"[{_W}][{_W}]|[{_X}]|[ \n]$|^\n")


class CSR(NamedTuple):
    """A sparse matrix in compressed rows."""

    ends: np.ndarray  # row i has the entries ends[i] to ends[i + 1]
    column: np.ndarray
    value: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def product(left: CSR, right: CSR) -> CSR:
    """Gustavson's product by rows: row i is the sum of the rows of ``right`` that row i of ``left`` names, times its values.

    All rows are laid out one after the other; entries of one row and column are then added up.
    """
    sizes = right.ends[left.column + 1] - right.ends[left.column]
    at = spread(right.ends[left.column], sizes)
    row, column = np.repeat(left.rows(), sizes), right.column[at]
    value = np.repeat(left.value, sizes) * right.value[at]
    width = int(right.column.max()) + 1 if len(right.column) else 1
    key, where = np.unique(row * width + column, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, where, value)
    rows = len(left.ends) - 1
    return CSR(np.concatenate([[0], np.cumsum(np.bincount(key // width, minlength=rows))]).astype(np.int64), key % width, total)


def incidence(sizes: np.ndarray) -> CSR:
    """Tokens by bytes: token i covers the next ``sizes[i]`` bytes."""
    n = int(sizes.sum())
    return CSR(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.arange(n), np.ones(n, np.int64))


def single(column: np.ndarray) -> CSR:
    """A one in each row, at the given columns: bytes by tokens, or tokens by groups."""
    n = len(column)
    return CSR(np.arange(n + 1), column, np.ones(n, np.int64))


def single_transposed(column: np.ndarray, columns: int) -> CSR:
    """The transposed matrix of :func:`single`, for columns that do not decrease."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=columns))]).astype(np.int64)
    return CSR(ends, np.arange(len(column)), np.ones(len(column), np.int64))


class Aligned(NamedTuple):
    """Overlaps, groups and links of token sequences over the same bytes."""

    overlap: CSR  # tokens of A by tokens of B: shared bytes
    group_a: np.ndarray  # group of each token
    group_b: np.ndarray
    link: CSR  # tokens of A by tokens of B that share a group


def align_tokens(size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """Aligns two cuts of the same bytes; sizes are the tokens' bytes."""
    a, b = incidence(size_a), incidence(size_b)
    overlap = product(a, single(b.rows()))
    # the last token of B that a token of A overlaps; the group ends where both end
    last = overlap.column[overlap.ends[1:] - 1]
    border = a.ends[1:] == b.ends[1:][last]
    group_a = np.concatenate([[0], np.cumsum(border)[:-1]]).astype(np.int64) if len(size_a) else np.zeros(0, np.int64)
    group_b = np.zeros(len(size_b), np.int64)
    group_b[overlap.column] = group_a[overlap.rows()]
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    return Aligned(overlap, group_a, group_b, product(single(group_a), single_transposed(group_b, groups)))


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, all other bytes for U+0100 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """Tokenizer A: ids of plain text and each id's bytes.

    Where the vocabulary is numbered in the order of its merges, tiktoken gives the
    library's ids in a fraction of its time; else the library is asked.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model, of = spec["model"], _byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        self.bytes = dict(zip(ranks.values(), ranks, strict=True))
        self.size = 1 + max([*ranks.values(), *(t["id"] for t in spec["added_tokens"])])
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if plain and all(model["vocab"][x + y] == 256 + k for k, (x, y) in enumerate(merges)):
            import public_tokenizers
            import tiktoken

            self.encode = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            t = Tokenizer.from_str(source)
            t.encode_special_tokens = True
            self.encode = lambda text: t.encode(text, add_special_tokens=False).ids


class Units(NamedTuple):
    """Aligned units: their figures, the id pairs of their links (one after the other) and their groups as text."""

    figures: np.ndarray  # rows: whether the bytes agree, n_a, n_b, n_groups, n_links, n_overlaps
    n_pairs: np.ndarray
    pairs: np.ndarray
    groups: list[str]


class Aligner:
    """Both tokenizers, and the alignment of units."""

    def __init__(self, source: str, model: bytes):
        self.a, self.s = ByteBPE(source), segmenter(model)
        sp = self.s.sp
        self.width = sp.get_piece_size()
        self.b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(self.width)]
        self.a_size = np.array([len(self.a.bytes.get(i, b"")) for i in range(self.a.size)], np.int64)
        self.b_size = np.array([len(b) for b in self.b_bytes], np.int64)
        self.a_text, self.b_text = [str(i) for i in range(self.a.size)], [str(i) for i in range(self.width)]

    def units(self, text: str) -> list[str]:
        """The units of a space and the text."""
        if not text:
            return []
        if not self.s.separable:
            return [" " + text]
        if _RUN.search(text) is None:
            return [x if x[:1] == "\n" else " " + x for x in text.replace("\n", " \n").split(" ")]
        return UNIT.findall(" " + text)

    def _b(self, unit: str) -> list[int]:
        if unit[0] != " ":
            return self.s.sp.encode(unit)[1:]
        return self.s.sp.encode(unit[1:]) if len(unit) > 1 else [self.s.mark]

    def align(self, units: list[str]) -> Units:
        as_, bs, good = [], [], []
        for u in units:
            a, b, raw = self.a.encode(u), self._b(u), u.encode()
            ok = b"".join(map(self.a.bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
            as_.append(a if ok else []), bs.append(b if ok else []), good.append(ok)
        n_a, n_b = np.array([len(x) for x in as_], np.int64), np.array([len(x) for x in bs], np.int64)
        a, b = np.fromiter(chain.from_iterable(as_), np.int64), np.fromiter(chain.from_iterable(bs), np.int64)
        got = align_tokens(self.a_size[a], self.b_size[b])
        of_a = np.repeat(np.arange(len(units)), n_a)  # the unit of each token of A
        by = lambda rows: np.bincount(of_a[rows], minlength=len(units))
        links, rows = by(got.link.rows()), got.link.rows()
        new = np.concatenate([[True], np.diff(got.group_a) > 0]) if len(a) else np.zeros(0, bool)
        first_a = np.flatnonzero(new)
        first_b = np.searchsorted(got.group_b, np.arange(len(first_a)))
        figures = np.stack([np.array(good, np.int64), n_a, n_b, by(first_a), links, by(got.overlap.rows())], axis=1) if units else np.zeros((0, 6), np.int64)
        return Units(figures, links, a[rows] * self.width + b[got.link.column], self._texts(figures[:, 3].tolist(), a.tolist(), b.tolist(), [*first_a.tolist(), len(a)], [*first_b.tolist(), len(b)]))

    def _texts(self, n_groups: list[int], a: list[int], b: list[int], from_a: list[int], from_b: list[int]) -> list[str]:
        a, b = [self.a_text[i] for i in a], [self.b_text[i] for i in b]
        each = [f"{','.join(a[i:k])}|{','.join(b[j:m])}" for i, k, j, m in zip(from_a, from_a[1:], from_b, from_b[1:], strict=False)]
        out, at = [], 0
        for n in n_groups:
            out.append(";".join(each[at : at + n]))
            at += n
        return out


@lru_cache(maxsize=1)
def aligner(source: str, model: bytes) -> Aligner:
    return Aligner(source, model)


class Table:
    """Distinct units and their alignment, within bounded memory; emptied between batches."""

    def __init__(self, aligner: Aligner, limit: int = TABLE_BYTES):
        self.aligner, self.limit = aligner, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.size, self.groups = 0, []
        self.figures, self.ends, self.pairs = np.zeros((0, 6), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def add(self, units: list[str]) -> None:
        got = self.aligner.align(units)
        self.index.update(zip(units, range(len(self.index), len(self.index) + len(units)), strict=True))
        self.figures = np.concatenate([self.figures, got.figures])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(got.n_pairs)])
        self.pairs = np.concatenate([self.pairs, got.pairs])
        self.groups += got.groups
        # two strings, a place in two tables and the arrays' rows
        self.size += sum(260 + len(u) + len(g) for u, g in zip(units, got.groups, strict=True)) + 8 * len(got.pairs)

    def documents(self, some: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Figures (as in Units, without the first), groups as text, and (document, id pair, times) of texts."""
        if self.size > self.limit:
            self.clear()
        cut = list(map(self.aligner.units, some))
        self.add(list(set().union(*cut) - self.index.keys()))
        n = np.array([len(c) for c in cut], np.int64)
        unit = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        ends = np.concatenate([[0], np.cumsum(n)])
        sums = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(self.figures[unit], axis=0)])
        figures = sums[ends[1:]] - sums[ends[:-1]]
        good = (figures[:, 0] == n) & (n > 0)
        groups = [";".join(map(self.groups.__getitem__, unit[i:k].tolist())) if ok else "" for i, k, ok in zip(ends, ends[1:], good, strict=False)]
        doc = np.repeat(np.arange(len(some)), n)
        held = good[doc]
        key, times = np.unique(doc[held] * len(self.index) + unit[held], return_counts=True)
        doc, unit = np.divmod(key, max(len(self.index), 1))
        sizes = self.ends[unit + 1] - self.ends[unit]
        pair = self.pairs[spread(self.ends[unit], sizes)]
        width = self.aligner.width * self.aligner.a.size
        order = np.argsort(key := np.repeat(doc, sizes) * width + pair, kind="stable")
        key, times = key[order], np.repeat(times, sizes)[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(key) > 0])) if len(key) else np.zeros(0, np.int64)
        doc, pair = np.divmod(key[first], width)
        if self.size > self.limit:
            self.clear()
        return figures[:, 1:] * good[:, None], groups, doc, pair, np.add.reduceat(times, first) if len(first) else np.zeros(0, np.int64)


def _slices(batch):
    """An Arrow batch in parts of at most about SLICE_BYTES of text, or one row."""
    at, size = 0, 0
    for i, t in enumerate(batch.column(1)):
        n = t.as_buffer().size if t.is_valid else 0
        if size + n > SLICE_BYTES and i > at:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if batch.num_rows > at:
        yield batch.slice(at)


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, model_path: str | None = None, digest: bool = False) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups, and its distinct linked id pairs with their occurrences.

    ``pairs`` holds A's id times the size of B's vocabulary plus B's id.  With
    ``digest`` there is ``groups_sha256`` for ``groups``.
    """
    if json_path is None:
        import public_tokenizers

        json_path = public_tokenizers.path("byte_bpe_50k.json")
    with open(json_path, encoding="utf-8") as f:
        source = f.read()
    model = model_bytes(model_path)
    small = aligner(source, model)
    kind = "int" if small.width * small.a.size < 2**31 else "long"
    number, name = pa.int32() if kind == "int" else pa.int64(), "groups_sha256" if digest else "groups"
    kept = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    both = df.sparkSession.sparkContext.broadcast((source, model))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest() if x else ""

    def run(batches):
        table = Table(aligner(*both.value))
        for b in batches:
            for part in _slices(b):
                figures, groups, doc, pair, times = table.documents(list(texts(part, 1)))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]).astype(np.int32))
                columns = [part.column(0), *(pa.array(figures[:, k]) for k in range(5)), pa.array(map(sha, groups) if digest else groups, pa.string())]
                columns += [pa.ListArray.from_arrays(ends, pa.array(pair.astype(number.to_pandas_dtype()))), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *FIGURES, name, "pairs", "times"])

    columns = ", ".join(f"{c} long" for c in FIGURES)
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, {columns}, {name} string, pairs array<{kind}>, times array<int>")


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): the documents that hold an id pair linked, and whether that is its A id's highest count."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = stored(counts.withColumn("a", F.expr(f"pair div {width}").cast("int")), "pairs")
    # one row an id of A: no more than its vocabulary
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def weigh(aligned: DataFrame, width: int, head: int = HEAD) -> DataFrame:
    """Stored rows of :func:`align` with n_best and count_sum in place of ``pairs`` and ``times``."""
    aligned = stored(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(aligned, width), "counts")
    level, least, held = F.floor(F.log2("n") * 16), None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect(), reverse=True):
        if held + r["k"] > head:
            break
        held, least = held + r["k"], r["n"]
    top = counts.filter(F.lit(False) if least is None else F.col("n") >= least).toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    known = aligned.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy()[order] for c in ("pair", "n", "best")))
    keys = [f for f in aligned.schema if f.name not in ("pairs", "times")]
    at_pairs, at_times = aligned.columns.index("pairs"), aligned.columns.index("times")
    kind = aligned.schema["pairs"].dataType.elementType.simpleString()

    def run(batches):
        pairs, n, best = known.value
        for b in batches:
            lists = b.column(at_pairs)
            ends = lists.offsets.to_numpy().astype(np.int64)
            pair, times = lists.values.to_numpy()[ends[0] : ends[-1]], b.column(at_times).values.to_numpy()[ends[0] : ends[-1]].astype(np.int64)
            ends = ends - ends[0]
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            found = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            # of a pair outside the table, 0 here
            total = lambda x, ends=ends: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
            got = [total(np.where(found, times * v[at], 0) if len(pairs) else times * 0) for v in (best, n)]
            rare = np.flatnonzero(~found)
            rare_ends = pa.array(np.searchsorted(rare, ends).astype(np.int32))
            out = [b.column(i) for i in range(b.num_columns) if i not in (at_pairs, at_times)]
            out += [pa.array(g) for g in got]
            out += [pa.ListArray.from_arrays(rare_ends, pa.array(pair[rare])), pa.ListArray.from_arrays(rare_ends, pa.array(times[rare]))]
            yield pa.RecordBatch.from_arrays(out, [*(f.name for f in keys), "n_best", "count_sum", "pairs", "times"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)
    part = stored(aligned.mapInArrow(run, f"{columns}, n_best long, count_sum long, pairs array<{kind}>, times array<long>"), "weighed")
    rare = part.filter(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    whole = part.drop("pairs", "times").join(rare, "row", "left")
    for c, more in (("n_best", "more_best"), ("count_sum", "more_sum")):
        whole = whole.withColumn(c, F.col(c) + F.coalesce(F.col(more), F.lit(0)))
    return whole.drop("row", "more_best", "more_sum")


def links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, model_path: str | None = None, digest: bool = True, head: int = HEAD) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256 (or groups), n_best and count_sum."""
    width = segmenter(model_bytes(model_path)).sp.get_piece_size()
    return weigh(align(df, id_col, text_col, json_path, model_path, digest), width, head)
