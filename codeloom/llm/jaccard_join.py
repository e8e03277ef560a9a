"""Similarity join of documents on 5-word shingles, by rare-first prefixes.

1. Equal shingle sets are one *class*; what follows works on classes.
2. Shingle hashes are dealt by range into buckets.  A bucket finds its shingles
   that two or more classes have, and their document frequencies; only these
   can link.  Hashes travel packed, many to a row, each once per class and slice.
3. A class puts its shingles in order, rarest first.  Those of frequency one lead
   and match nothing, so a class with too many of them has no partner; the rest
   of its prefix (of n - ceil(0.75 n) + 1 shingles) is indexed.
4. Candidates share a prefix shingle and pass the length and positional filters;
   pairs are verified once each, with the suffix filter before the whole
   intersection.
5. No group is ever expanded into all its pairs.  Rounds first compare the
   members of each posting list with one of them, which joins large groups of
   copies into components, until lists hold few components.  Then all candidates
   between different components are verified, so no link between components is
   lost.

Memory: buckets are sized from the number of shingles, not from the number of
machines.  A first pass counts the shingles of each range of hashes; a bucket in
a range with a shingle that very many classes have is dealt among several
groups by class, whose shingles' frequencies are then added up by Spark.  A list
of any length meets only in minima and joins, whose hot keys Spark may split.

Defined results: a text without words has no shingles and is linked with
nothing; one of fewer words than a shingle is its whole sequence; rows that share
an id stay separate rows.  A class is known by a 64-bit hash of its shingles.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import release_shuffles, stored
from .components import components

#: Shingles a bucket holds on average, and bytes of text a slice holds.
BUCKET, SLICE = 600_000, 2_000_000
#: Bytes of a packed hash: the rest of its 64 bits is its range.
PACKED = 6
RANGES = 1 << 16
#: Tasks of a shuffle at most; each takes its buckets one after the other.
PARTITIONS = 20_000
#: A bucket is dealt among several groups if its range holds this many times its share.
HOT = 4


def _pack(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PACKED]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // PACKED, 8), np.uint8)
    out[:, :PACKED] = np.frombuffer(b, np.uint8).reshape(-1, PACKED)
    return out.reshape(-1).view("<u8")


def _class(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True)


def least_overlap(n, percent: int):
    """What a set of ``n`` must share with any partner: ceil(n * percent / 100)."""
    return (n * percent + 99) // 100


def classes(docs: DataFrame, size: int) -> DataFrame:
    """The columns of ``docs`` but the last, its text, and (node, n), for each row.

    Each task adds one row of its own: how many shingles it met in each range.
    """
    kept = docs.columns[:-1]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        met, types = np.zeros(RANGES, np.int64), None
        for b in batches:
            types = [c.type for c in b.columns[:-1]]
            node, n = [], []
            for w in wordhash.slices(b.column(b.num_columns - 1), SLICE):
                sets = {}
                for s in wordhash.shingles(w, size):
                    node.append(_class(s)), n.append(len(s))
                    sets.setdefault(node[-1], s)
                met += np.bincount((np.concatenate(list(sets.values())) >> np.uint64(8 * PACKED)).astype(np.int64), minlength=RANGES)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.binary())], [*kept, "node", "n", "met"])
        if types is not None:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), *(pa.nulls(1, pa.int64()) for _ in range(2)), pa.array([met.astype(np.uint32).tobytes()], pa.binary())], [*kept, "node", "n", "met"])

    return docs.mapInArrow(run, f"{kinds}, node long, n long, met binary")


def ranges(rows: DataFrame) -> np.ndarray:
    """Shingles by range of their hashes, as the tasks of :func:`classes` met them."""

    def run(batches):
        met = np.zeros(RANGES, np.int64)
        for b in batches:
            for x in b.column(0):
                met += np.frombuffer(x.as_py(), np.uint32)
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(met[at])], ["at", "k"])

    got = rows.filter("met is not null").select("met").mapInArrow(run, "at long, k long").groupBy("at").agg(F.sum("k").alias("k")).toArrow()
    out = np.zeros(RANGES, np.int64)
    out[got.column("at").to_numpy()] = got.column("k").to_numpy()
    return out


@dataclass
class Deal:
    """How shingles are dealt: ``groups[r]`` groups for each bucket of range r; more than one where it is hot."""

    per_range: int  # buckets of a range, or 0
    ranges: int  # that make up a bucket, if several do
    groups: np.ndarray

    @classmethod
    def of(cls, met: np.ndarray, bucket: int) -> Deal:
        total = max(1, int(met.sum()))
        per_range, several = max(1, -(-total // (bucket * RANGES))), 1
        while several < RANGES // 8 and 2 * several * total <= bucket * RANGES:
            several *= 2
        held = met.reshape(-1, several).sum(1) / per_range
        groups = np.where(held > HOT * max(bucket, total / len(held) / per_range), np.ceil(held / bucket), 1).astype(np.int64)
        return cls(per_range, several, np.repeat(groups, several))

    @property
    def buckets(self) -> int:
        return RANGES // self.ranges * self.per_range

    @property
    def hot(self) -> bool:
        return bool((self.groups > 1).any())

    def place(self, h: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, group) of shingles of classes; a bucket that is not hot has group -1 alone."""
        at = (h >> np.uint64(8 * PACKED)).astype(np.int64)
        bucket = at // self.ranges * self.per_range + (h >> np.uint64(16)).astype(np.uint32) % np.uint32(self.per_range)
        if not self.hot:
            return bucket, np.full(len(h), -1)
        n = self.groups[at]
        return bucket, np.where(n > 1, (wordhash.mix(node.view(np.uint64) + np.uint64(1)) % n.astype(np.uint64)).astype(np.int64), -1)


def _dealt(docs: DataFrame, size: int, deal: Deal) -> DataFrame:
    """Packed shingle hashes by bucket and group, with the classes that have them."""

    def run(batches):
        for b in batches:
            for w in wordhash.slices(b.column(0), SLICE):
                sets = {}
                for s in wordhash.shingles(w, size):
                    if len(s):
                        sets.setdefault(_class(s), s)
                if not sets:
                    continue
                nodes = np.fromiter(sets, np.int64, len(sets))
                sizes = np.fromiter(map(len, sets.values()), np.uint32, len(sets))
                h = np.concatenate(list(sets.values()))
                own = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
                del sets
                bucket, group = deal.place(h, nodes[own])
                order = np.lexsort((group, bucket)) if deal.hot else np.argsort(bucket, kind="stable")
                h, own, bucket, group = h[order], own[order], bucket[order], group[order]
                stops = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(group) != 0)) + 1
                rows = []
                for x, y in zip([0, *stops.tolist()], [*stops.tolist(), len(h)], strict=True):
                    first = np.concatenate([[0], np.flatnonzero(np.diff(own[x:y])) + 1])
                    who = own[x:y][first]
                    rows.append((int(bucket[x]), int(group[x]), _pack(h[x:y]), nodes[who].tobytes(), sizes[who].tobytes(), np.diff(np.append(first, y - x)).astype(np.uint32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["bucket", "group", "keys", "nodes", "sizes", "counts"])

    return docs.select("text").mapInArrow(run, "bucket long, group int, keys binary, nodes binary, sizes binary, counts binary")


_BY_CLASS = "part int, keys binary, dfs binary, nodes binary, sizes binary, counts binary"


def _by_class(h: np.ndarray, node: np.ndarray, size: np.ndarray, df: np.ndarray, parts: int) -> list[pa.Array]:
    """Columns of ``_BY_CLASS``: shingles packed by class, classes dealt among ``parts`` (none: part -1)."""
    part = (wordhash.mix(node.view(np.uint64)) % np.uint64(parts)).astype(np.int64) if parts else np.full(len(node), -1)
    order = np.lexsort((node, part))
    h, node, size, df, part = h[order], node[order], size[order], df[order], part[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, int)
    rows = []
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        first = np.concatenate([[0], np.flatnonzero(np.diff(node[x:y])) + 1])
        rows.append((int(part[x]), h[x:y].tobytes(), df[x:y].tobytes(), node[x:y][first].tobytes(), size[x:y][first].tobytes(), np.diff(np.append(first, y - x)).astype(np.uint32).tobytes()))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return [pa.array(c, k) for c, k in zip(columns, (pa.int32(), *[pa.binary()] * 5), strict=True)]


_NAMES = ["part", "keys", "dfs", "nodes", "sizes", "counts"]


def _repeated(deal: Deal, parts: int):
    """A bucket's shingles that two or more classes have, packed by class.

    Of a hot bucket this is one group of several: all its shingles go on, under part -1.
    """

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        h = np.concatenate([_unpack(x.as_py()) for x in t.column("keys")])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in t.column("counts")])
        node = np.repeat(np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in t.column("nodes")]), counts)
        size = np.repeat(np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in t.column("sizes")]), counts)
        whole = key[1].as_py() < 0
        if whole:
            order = np.argsort(h)
            s = h[order]
            same = s[1:] == s[:-1]
            twice = np.zeros(len(s), bool)
            twice[1:] |= same
            twice[:-1] |= same
            pick = order[twice]
            del order, s, same, twice
            h, node, size = h[pick], node[pick], size[pick]
        order = np.lexsort((node, h))
        h, node, size = h[order], node[order], size[order]
        new = np.ones(len(h), bool)  # a class counts once, however many slices saw it
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node, size = h[new], node[new], size[new]
        _, at, df = np.unique(h, return_inverse=True, return_counts=True)
        df = df[at].astype(np.uint32)
        h = h | np.uint64(key[0].as_py() // deal.per_range * deal.ranges << (8 * PACKED))
        if whole:
            keep = df > 1
            h, node, size, df = h[keep], node[keep], size[keep], df[keep]
        return pa.table(_by_class(h, node, size, df, parts if whole else 0), _NAMES)

    return run


def _loose(repeated: DataFrame, parts: int) -> DataFrame:
    """What :func:`_repeated` gives, for shingles of hot buckets: their frequencies are added up over all groups."""

    def rows(batches):
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c, k, b=b, i=i: np.frombuffer(b.column(c)[i].as_py(), k)
                n = get(3, np.uint32)
                h, node, size = get(0, np.int64), np.repeat(get(1, np.int64), n), np.repeat(get(2, np.uint32), n)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(node), pa.array(size.astype(np.int64))], ["key", "node", "size"])

    def packed(batches):
        for b in batches:
            h, node, size, df = (b.column(c).to_numpy() for c in ("key", "node", "size", "df"))
            yield pa.RecordBatch.from_arrays(_by_class(h.view(np.uint64), node, size.astype(np.uint32), df.astype(np.uint32), parts), _NAMES)

    one = repeated.filter("part < 0").select("keys", "nodes", "sizes", "counts").mapInArrow(rows, "key long, node long, size long")
    df = one.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    return one.join(df, "key").mapInArrow(packed, _BY_CLASS)


def _ordered(percent: int):
    """Classes that can have a partner: their repeated shingles, rarest first, and how many of them are indexed."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        col = lambda c, k: np.concatenate([np.frombuffer(x, k) for x in t.column(c).to_pylist()])
        counts = col("counts", np.uint32)
        node, size = np.repeat(col("nodes", np.int64), counts), np.repeat(col("sizes", np.uint32), counts)
        h, df = col("keys", np.uint64), col("dfs", np.uint32)
        order = np.lexsort((h, df, node))
        h, node, size = h[order], node[order], size[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1])
        had = np.diff(np.append(first, len(node)))
        rows = []
        for x, r in zip(first.tolist(), had.tolist(), strict=True):
            n = int(size[x])
            need = least_overlap(n, percent)
            if r >= need:
                rows.append((int(node[x]), n, h[x : x + r].tobytes(), (n - need + 1) - (n - r)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.int32()), strict=True)], ["node", "n", "keys", "prefix"])

    return run


def _postings(candidates: DataFrame, percent: int) -> DataFrame:
    """The indexed shingles: key, node, n, r, pos, most.

    ``r``: repeated shingles of the class; ``pos``: the shingle's place in its
    order, the n - r others leading; ``most``: a larger set cannot be its partner,
    as the r shingles that may be shared would be too small a part.
    """

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n, p = part.column(1).to_numpy(), part.column(3).to_numpy()
                rows = [np.frombuffer(x.as_py(), np.uint64) for x in part.column(2)]
                keys = np.concatenate([x[:k] for x, k in zip(rows, p, strict=True)])
                pos = np.concatenate([np.arange(k) + (m - len(x)) for x, k, m in zip(rows, p, n, strict=True)])
                r = np.fromiter(map(len, rows), np.int64, len(rows))
                small = [np.repeat(x, p).astype(np.int32) for x in (n, r)]
                most = np.repeat((100 + percent) * r // percent - n, p).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.view(np.int64), np.repeat(part.column(0).to_numpy(), p), *small, pos.astype(np.int32), most)], ["key", "node", "n", "r", "pos", "most"])

    return candidates.mapInArrow(run, "key long, node long, n int, r int, pos int, most int")


def overlap(x: np.ndarray, y: np.ndarray, need: int, depth: int = 3) -> int:
    """Size of the intersection of sorted distinct arrays, or 0 if it is below ``need``.

    Suffix filter: around a probe the parts on either side bound the overlap;
    halving again, up to ``depth`` times, stops most hopeless pairs.
    """

    def most(x, y, d):
        if not d or not len(x) or not len(y):
            return min(len(x), len(y))
        i = len(x) // 2
        j = int(np.searchsorted(y, x[i]))
        hit = j < len(y) and y[j] == x[i]
        return most(x[:i], y[:j], d - 1) + hit + most(x[i + 1 :], y[j + hit :], d - 1)

    if most(x, y, depth) < need:
        return 0
    got = len(np.intersect1d(x, y, assume_unique=True))
    return got if got >= need else 0


def _verified(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs`` (a, b) of classes."""
    side = lambda c: candidates.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("keys").alias(f"keys_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "keys_a", "keys_b")

    def run(batches):
        for t in batches:
            keep = []
            last, x = None, None
            for a, na, nb, ka, kb in zip(t.column(0).to_pylist(), t.column(2).to_pylist(), t.column(3).to_pylist(), t.column(4), t.column(5), strict=True):
                if a != last:
                    last, x = a, np.sort(np.frombuffer(ka.as_py(), np.uint64))
                need = -(-percent * (na + nb) // (100 + percent))
                keep.append(overlap(x, np.sort(np.frombuffer(kb.as_py(), np.uint64)), need) > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(mask), t.column(1).filter(mask)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _fits(x: str, y: str) -> str:
    """Length filter: both sets are small enough for what the other can share."""
    return f"{x}.n <= {y}.most and {y}.n <= {x}.most"


def _early(n: str, pos: str, m: str, percent: int) -> str:
    """Positional filter: from its place on, the first shingle that is shared with a set of ``m`` must leave enough."""
    return f"{100 + percent} * ({n} - {pos}) >= {percent} * ({n} + {m})"


def _by_one(posts: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs of each class with one other: the member that leads most of its lists in this turn.

    Only members of other components pair.  Lists are split by bands of length,
    within which lengths fit.  First the class with the fewest shingles of its
    own leads, as the original of many copies has; then chance decides.
    """
    posts = posts.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.2)) + turn / 2))
    rank = F.xxhash64(F.lit(turn), "comp") if turn else (F.col("n") - F.col("r")).cast("long")
    lead = posts.groupBy("key", "band").agg(F.min(F.struct(rank.alias("rank"), "node", "n", "r", "pos", "most", "comp")).alias("y"), F.count("*").alias("k")).filter("k > 1").select("key", "band", "y")
    pairs = posts.alias("x").join(lead, ["key", "band"]).filter(f"comp <> y.comp and {_fits('x', 'y')} and {_early('x.n', 'x.pos', 'y.n', percent)} and {_early('y.n', 'y.pos', 'x.n', percent)}")
    pairs = pairs.groupBy("node", F.col("y.node").alias("to")).agg(F.count("*").alias("k"))
    best = pairs.groupBy("node").agg(F.max_by("to", F.struct("k", "to")).alias("to"))
    return best.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()


def _all_between(posts: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs between different components, once each."""
    # what a list's members of one component can do at best: smallest size, largest partner, most that is left
    lists = posts.groupBy("key", "comp").agg(F.min("n").alias("n"), F.max("most").alias("most"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    enough = lambda x, y, n: f"{100 + percent} * {x}.rest >= {percent} * ({n} + {y}.n)"
    meet = lists.alias("p").join(lists.alias("q"), F.expr(f"p.key = q.key and p.comp < q.comp and {_fits('p', 'q')} and {enough('p', 'q', 'p.n')} and {enough('q', 'p', 'q.n')}"))
    meet = meet.select("p.key", F.col("p.comp").alias("comp_a"), F.col("q.comp").alias("comp_b"), "q.n", "q.most", "q.rest")
    a = meet.alias("m").join(posts.alias("x"), F.expr(f"m.key = x.key and comp_a = x.comp and {_fits('x', 'm')} and {_early('x.n', 'x.pos', 'm.n', percent)} and {enough('m', 'm', 'x.n')}"))
    a = a.select("m.key", "comp_b", F.struct("x.node", "x.n", "x.pos", "x.most").alias("x"))
    pairs = a.alias("m").join(posts.alias("y"), F.expr(f"m.key = y.key and comp_b = y.comp and {_fits('x', 'y')} and {_early('x.n', 'x.pos', 'y.n', percent)} and {_early('y.n', 'y.pos', 'x.n', percent)}"))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _few_left(posts: DataFrame) -> bool:
    """Whether the lists hold no more pairs of components than twice their entries."""
    c = posts.groupBy("key").agg(F.countDistinct("comp").alias("c"), F.count("*").alias("k"))
    r = c.agg(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.sum("k")).first()
    return (r[0] or 0) <= 2 * (r[1] or 0)


def _across(posts: DataFrame, comp: DataFrame) -> DataFrame:
    """The postings with their components, of lists that more than one component is in."""
    posts = posts.join(comp, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    mixed = posts.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    return posts.join(mixed, "key", "left_semi")


def _linked(docs: DataFrame, size: int, percent: int, bucket: int = BUCKET, rounds: int = 6) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (its last column is text) with their classes, and (node, root) of linked classes."""
    spark = docs.sparkSession
    rows = stored(classes(docs, size), "classes")
    deal = Deal.of(ranges(rows), bucket)
    rows = rows.filter("met is null").drop("met")
    parts = min(deal.buckets, PARTITIONS)
    dealt = _dealt(docs, size, deal).repartition(parts, "bucket", "group")
    repeated = dealt.groupBy("bucket", "group").applyInArrow(_repeated(deal, deal.buckets), _BY_CLASS)
    if deal.hot:
        repeated = stored(repeated, "repeated")
        repeated = repeated.filter("part >= 0").unionByName(_loose(repeated, deal.buckets))
    candidates = stored(repeated.repartition(parts, "part").groupBy("part").applyInArrow(_ordered(percent), "node long, n int, keys binary, prefix int"), "candidates")
    del dealt, repeated
    release_shuffles(spark)
    posts = _postings(candidates, percent)
    shared = posts.groupBy("key").count().filter("count > 1").select("key")
    posts = stored(posts.join(shared, "key", "left_semi"), "postings")
    links, tried, n_found, n_candidates = None, None, 0, candidates.count()
    comp, some = spark.createDataFrame([], "node long, root long"), posts.withColumn("comp", F.col("node"))
    for turn in range(rounds + 1):
        last = turn == rounds or turn > 0 and (n_found < n_candidates // 50 or _few_left(some))
        pairs = _all_between(some, percent) if last else _by_one(some, percent, turn)
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), f"pairs-{turn}")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = stored(_verified(pairs, candidates, percent), f"links-{turn}")
        links = found if links is None else links.unionByName(found)
        if n_found := found.count():
            comp = stored(components(links), f"components-{turn}")
            release_shuffles(spark)
        if last:
            break
        some = stored(_across(posts, comp), f"across-{turn}")
    return rows, comp


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, bucket: int = BUCKET, rounds: int = 6) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id that links reach), class_id."""
    rows, comp = _linked(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), size, percent, bucket, rounds)
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    linked = nodes.join(comp, "node").select("node", "root", "low")
    low = linked.groupBy("root").agg(F.min("low").alias("root_low"))
    linked = linked.join(low, "root").select("node", "root_low")
    nodes = nodes.join(linked, "node", "left").select("node", F.coalesce("root_low", "low").alias("component"))
    out = rows.join(nodes, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("node")).alias("class_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, row_col: str | None = None) -> DataFrame:
    """One row of each component, that of the smallest id (null is the largest), and all rows without shingles.

    Rows that share an id are told apart by ``row_col``, a column that differs in
    every row; without one, ``df`` is stored with row numbers.
    """
    columns = [c for c in df.columns if c != row_col]
    if row_col is None:
        row_col = "_row"
        df = stored(df.withColumn(row_col, F.monotonically_increasing_id()), "rows")
    rows, comp = _linked(df.select(F.col(id_col).alias("doc_id"), F.col(row_col).alias("row"), F.col(text_col).alias("text")), size, percent)
    first = rows.filter("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
    first = first.join(comp, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = first.select(F.col("first.row").alias(row_col)).union(rows.filter("n = 0").select("row"))
    return df.join(kept, row_col, "left_semi").select(columns)
