"""The table of frequent chunks: each is segmented once for the whole corpus.

Every task counts the chunks that it meets; Spark adds the counts up.  The most
frequent chunks, at most ``HEAD`` of them and ``HEAD_BYTES`` bytes, are segmented
once and broadcast, whatever the input's size.  A chunk outside this table is
rare by construction: it makes up no more than one in ``HEAD`` of all chunks
(or is longer than ``LONG`` bytes).

The cut is by levels of frequency, a few hundred at any size of input; of the
level that does not fit whole, a share chosen by hash is taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .pieces import Segmenter, segmenter, texts

HEAD, HEAD_BYTES = 400_000, 32_000_000
#: A task reports the chunks that it has met this often; it holds so many distinct characters at a time.
LEAST, HELD_CHARS = 4, 16_000_000
#: Longer chunks are no words; they stay out of the table and are never shuffled.
LONG = 256
_SHARES = 1_000_000


def frequent(texts_df: DataFrame, model: bytes) -> DataFrame:
    """(chunk, n): how often tasks met the chunks that are not rare within them."""
    least = LEAST

    def run(batches):
        s, seen, held = segmenter(model), Counter(), 0

        def flush():
            rows = [(k, n) for k, n in seen.items() if n >= least and len(k) <= LONG]
            seen.clear()
            for at in range(0, len(rows), 50_000):
                k, n = zip(*rows[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(n, pa.int64())], ["chunk", "n"])

        for b in batches:
            for t in texts(b, 0):
                before = len(seen)
                seen.update(s.chunks(t))
                held += (len(seen) - before) * 10 + len(t) // 50  # about the characters of its new chunks
                if held > HELD_CHARS:
                    yield from flush()
                    held = 0
        yield from flush()

    return texts_df.mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def leading(counts: DataFrame, limit: int, limit_bytes: int) -> DataFrame:
    """The most frequent chunks of stored ``counts`` (chunk, n), at most about ``limit`` of them and ``limit_bytes`` bytes."""
    counts, size = counts.withColumn("level", F.floor(F.log2("n") * 16)), F.octet_length("chunk") + 8
    cut, share = None, 0.0
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("k"), F.sum(size).alias("b")).collect(), reverse=True):
        cut = r["level"]
        if r["k"] > limit or r["b"] > limit_bytes:
            share = min(limit / r["k"], limit_bytes / r["b"])
            break
        share, limit, limit_bytes = 1.0, limit - r["k"], limit_bytes - r["b"]
    some = F.pmod(F.xxhash64("chunk"), F.lit(_SHARES)) < int(share * _SHARES)
    return counts.filter((F.col("level") > F.lit(cut)) | (F.col("level") == F.lit(cut)) & some).select("chunk")


def head(texts_df: DataFrame, model: bytes, make: Callable[[Segmenter, str], tuple], schema: str, limit: int = HEAD, limit_bytes: int = HEAD_BYTES) -> dict[str, tuple]:
    """``make`` of the most frequent chunks, at most about ``limit`` of them; ``schema`` names its values."""
    some = leading(stored(frequent(texts_df, model), "chunks"), limit, limit_bytes)
    names = [x.split()[0] for x in schema.split(",")]
    kinds = [{"int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in schema.split(",")]

    def run(batches):
        s = segmenter(model)
        for x in batches:
            made = list(zip(*(make(s, c) for c in texts(x, 0)), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array(m, k) for m, k in zip(made, kinds, strict=True))], ["chunk", *names])

    got = some.mapInArrow(run, f"chunk string, {schema}").toArrow()
    return dict(zip(got.column("chunk").to_pylist(), zip(*(got.column(n).to_pylist() for n in names), strict=True), strict=True))
