"""Token counts by distinct pre-token.

The pieces of a text are those of its pre-tokens, so a text's count is the sum,
over its distinct pre-tokens, of frequency times pieces; ids are never made.

1. Frequent pre-tokens are counted once for the whole corpus, and this table of
   bounded size is broadcast (see :mod:`.chunks`).
2. Every document adds up its frequent pre-tokens on the spot and sends on the
   frequencies of the others.  Those meet by pre-token, each is counted once
   where it lands, and the products are summed by document.

A pre-token outside the table is rare by construction (a task has met it fewer
than ``chunks.LEAST`` times at a stretch, or it is no more than one in ``HEAD`` of
all), so no key of that shuffle is hot; documents go by id and text.  Only those of more than ``LONG`` characters, which are whole texts
without spaces rather than words, are counted where they stand: moving them
would cost more than counting them.

Defined results: null and empty texts have 0 bytes and 0 tokens; null ids and
repeated rows (of one id and text, or of one id and several texts) each keep
their row.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import HEAD, LONG, head
from .pieces import model_bytes, segmenter, texts


def count(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, model_path: str | None = None, head_size: int = HEAD) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    model = model_bytes(model_path)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = head(docs.select("text"), model, lambda s, c: (len(s.ids(c)),), "pieces int", head_size)
    known = df.sparkSession.sparkContext.broadcast({c: p for c, (p,) in table.items()})

    def split(batches):
        """Rows for documents (chunk null) and rows for their rare chunks."""
        s, pieces = segmenter(model), known.value
        for b in batches:
            at, mark, size, n, chunk = [], [], [], [], []

            def batch(b=b, at=at, mark=mark, size=size, n=n, chunk=chunk):
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(mark, pa.binary()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(chunk, pa.string())], ["doc_id", "mark", "n_bytes", "n", "chunk"])

            for i, t in enumerate(texts(b, 1)):
                found, rare = 0, []
                for c, k in Counter(s.chunks(t)).items():
                    p = pieces.get(c)
                    if p is None and len(c) > LONG:
                        p = len(s.ids(c))
                    if p is None:
                        rare.append((c, k))
                    else:
                        found += p * k
                raw = t.encode()
                m = hashlib.blake2b(raw, digest_size=8).digest()
                for c, k in [(None, found), *rare]:
                    at.append(i), mark.append(m), size.append(len(raw)), n.append(k), chunk.append(c)
                if len(at) > 50_000:
                    yield batch()
                    for x in (at, mark, size, n, chunk):
                        x.clear()
            yield batch()

    def counted(batches):
        """Rows sorted by chunk: each chunk's pieces are counted as it first appears."""
        s, last, pieces = segmenter(model), None, 0
        for b in batches:
            out = []
            for c, n in zip(b.column(4).to_pylist(), b.column(3).to_pylist(), strict=True):
                if c is None:
                    out.append(n)
                    continue
                if c != last:
                    last, pieces = c, len(s.ids(c))
                out.append(n * pieces)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.int64()), pc.cast(pc.is_null(b.column(4)), pa.int32())], ["doc_id", "mark", "n_bytes", "n", "copies"])

    rows = docs.mapInArrow(split, f"doc_id {kind}, mark binary, n_bytes long, n long, chunk string")
    # a document's own row has no chunk; its id and mark deal copies of a text over all tasks
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), "mark")
    rows = rows.repartition(F.coalesce(F.col("chunk").cast("binary"), own)).sortWithinPartitions("chunk")
    rows = rows.mapInArrow(counted, f"doc_id {kind}, mark binary, n_bytes long, n long, copies int")
    by_doc = rows.groupBy("doc_id", "mark").agg(F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n"), F.sum("copies").alias("copies"))
    by_doc = by_doc.select("doc_id", "n_bytes", F.expr("n div copies").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return by_doc.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
