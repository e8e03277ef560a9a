"""SentencePiece encoding and decoding over a distinct-chunk table.

When pieces cannot cross white-space markers, a text's ids are those of its
marked words, one after the other.  The corpus's frequent words are segmented
(and their ids decoded) once, in a table of bounded size that is broadcast (see
:mod:`.chunks`); ids are joined back by position in the text.  Words outside
that table go into a table of the task's own, which is emptied when it reaches
``TABLE_BYTES`` of memory; neither bound changes results.  (To join the rare
words across machines too, every text would have to be shuffled to meet its ids;
the README has the figures.)

Defined results: null and empty texts have no ids; a null id, repeated rows and
further columns of the input are no matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import head
from .pieces import MARK, Segmenter, model_bytes, segmenter, texts

#: Entries of the broadcast table, and bytes of a task's own.
HEAD, TABLE_BYTES = 100_000, 16_000_000
SLICE = 2000  # rows a result batch

#: Number of ids, ids as text, decoded text.
Coded = tuple[int, str, str]


def make(s: Segmenter, chunk: str) -> Coded:
    ids = s.ids(chunk)
    return len(ids), ",".join(map(str, ids)), s.text(ids)


class ChunkTable:
    """Distinct chunks and what was made of each: those that are ``known``, and further ones within bounded memory."""

    def __init__(self, known: dict[str, Coded], make: Callable[[str], Coded], limit: int = TABLE_BYTES):
        self.known, self.make, self.limit, self.size, self.rows = known, make, limit, 0, {}

    def look(self, chunks: list[str]) -> list[Coded]:
        known, rows = self.known, self.rows
        out = list(map(known.get, chunks))
        if None not in out:
            return out
        for i, c in enumerate(chunks):
            if out[i] is None:
                got = rows.get(c)
                if got is None:
                    if self.size > self.limit:
                        rows.clear()
                        self.size = 0
                    got = rows[c] = self.make(c)
                    # three strings, a tuple, a number and a place in the table, as CPython lays them out
                    self.size += 400 + 2 * len(c) + len(got[1]) + 2 * len(got[2])
                out[i] = got
        return out


def frequent(docs: DataFrame, model: bytes, size: int = HEAD) -> dict[str, Coded]:
    """The table of the corpus's frequent chunks."""
    return head(docs.select("text"), model, make, "n int, ids string, decoded string", size)


def codec(model: bytes, known: dict[str, Coded]) -> Callable[[str], Coded]:
    """text -> (number of ids, ids as text, decoded text)."""
    s = segmenter(model)
    table = ChunkTable(known, lambda c: make(s, c))

    def code(text: str) -> Coded:
        rows = table.look(s.chunks(text))
        if not rows:
            return 0, "", ""
        n, ids, out = zip(*rows, strict=True)
        whole = "".join(out)
        # the marker that the model puts ahead of every text goes again
        return sum(n), ",".join(ids), whole[1:] if s.separable and whole[:1] == " " else whole

    return code


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, head_size: int = HEAD) -> DataFrame:
    """Columns doc_id, ids (array), n_tokens, and whether the ids decode to the text (with any marker read as a space)."""
    model = model_bytes(model_path)
    kept = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = df.sparkSession.sparkContext.broadcast(frequent(kept, model, head_size))
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens long, round_trip boolean"

    def run(batches):
        code = codec(model, known.value)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                ids, n, same = [], [], []
                for t in texts(part, 1):
                    k, joined, out = code(t)
                    ids.append(np.fromstring(joined, np.int32, sep=",") if k else np.zeros(0, np.int32))
                    n.append(k)
                    same.append(out == t.replace(MARK, " "))
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(n, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """Columns doc_id and text: what the library's decode gives for the ids."""
    model = model_bytes(model_path)
    kept = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches):
        sp = segmenter(model).sp
        for b in batches:
            out = [sp.decode([i for i in x.as_py() or [] if i is not None]) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, text string")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, head_size: int = HEAD) -> DataFrame:
    """Per row: doc_id, n_tokens and the digests of its ids and of what they decode to."""
    model = model_bytes(model_path)
    kept = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = df.sparkSession.sparkContext.broadcast(frequent(kept, model, head_size))
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        code, sha = codec(model, known.value), lambda x: hashlib.sha256(x.encode()).hexdigest()
        for b in batches:
            rows = [(n, sha(ids), sha(out)) for n, ids, out in map(code, texts(b, 1))]
            n, ids, out = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return kept.mapInArrow(run, schema)
