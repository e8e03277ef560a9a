"""BPE encoding and decoding over a transducer of the corpus's frequent words.

The tokenizer lower-cases, drops white space and merges within words, so a text's
ids are those of its words, one after the other.

1. Every task counts the words that it meets; Spark adds the counts up.  The most
   frequent words, a bounded number, are merged once.
2. The driver compiles these words and their ids into a minimal acyclic
   transducer (see :mod:`.transducer`) and writes it to the shared folder; Spark
   ships the file to every executor, where all workers map the same pages.
3. A task takes each new word through the transducer.  Words outside it are merged
   by the tokenizer's own model, so results never depend on what is in the
   lexicon.  Words met before come from a table of bounded memory.

Of texts with characters above U+00FF or with ``<|`` (special tokens may be inside),
the runs without white space that hold them go through the library: their
normalisation has rules of its own.

Defined results: null and empty texts have no ids; a null id, repeated rows and
further columns of the input are no matter.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import leading
from .common import ship, stored
from .pieces import texts
from .transducer import Transducer, compile_words

#: Words of the transducer, and their bytes.
WORDS, WORDS_BYTES = 200_000, 16_000_000
#: Bytes of a task's table of units and of its counts; longer units are never kept.
TABLE_BYTES, LONG = 64_000_000, 256
SLICE = 1000  # rows handled at once


def _class(*kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] in kinds)


_L, _N, _S = _class("L"), _class("N"), r"\t-\r \x85\xa0"
#: The tokenizer's rule for words, for lower-cased text up to U+00FF.
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's file, read once by the driver and sent to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class Words:
    """The tokenizer, by units and words."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def split(self, text: str) -> list[str]:
        """A text's words, and behind a line feed each unit that only the library may split."""
        if "<|" not in text:
            try:
                text.encode("latin-1")
                return WORD.findall(text.lower())
            except UnicodeEncodeError:
                pass
        out = []
        for unit in map(bytes.decode, text.encode().split()):
            if "<|" in unit or not (unit.isascii() or max(unit) <= "\xff"):
                out.append("\n" + unit)
            else:
                out += WORD.findall(unit.lower())
        return out

    def merge(self, word: str) -> list[int]:
        """A word's ids by the tokenizer's merges; those of a unit behind a line feed."""
        if word[0] == "\n":
            return self.encode(word[1:])
        (seen, _), *_ = self.bytes_of.pre_tokenize_str(word)
        return [t.id for t in self.tokenizer.model.tokenize(seen)]

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def words_of(source: str) -> Words:
    return Words(source)


@lru_cache(maxsize=2)
def opened(name: str) -> Transducer:
    return Transducer(SparkFiles.get(name))


class Table:
    """Words and what was made of each, within bounded memory: ids and tokens as text.  Emptied between slices of rows."""

    def __init__(self, words: Words, lexicon: Transducer, limit: int = TABLE_BYTES):
        self.words, self.lexicon, self.limit, self.size = words, lexicon, limit, 0
        self.ids, self.tokens = {}, {}
        self.shown: dict[int, tuple[str, str]] = {}  # by output of the transducer

    def show(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), " ".join(map(self.words.tokenizer.id_to_token, ids))

    def make(self, word: str) -> tuple[str, str]:
        path = self.lexicon.path(word)
        if path is None:
            return self.show(self.words.merge(word))
        shown = self.shown
        for k in path:
            if k not in shown:
                shown[k] = self.show(self.lexicon.output(k))
        if len(path) == 1:
            return shown[path[0]]
        return " ".join([shown[k][0] for k in path]), " ".join([shown[k][1] for k in path])

    def code(self, some: list[str]) -> list[tuple[str, str]]:
        """Texts' ids and tokens, joined by a space."""
        if self.size > self.limit:
            self.ids.clear()
            self.tokens.clear()
            self.size = 0
        cut = list(map(self.words.split, some))
        for w in set().union(*cut) - self.ids.keys():
            ids, tokens = self.ids[w], self.tokens[w] = self.make(w)
            # three strings and places in two tables, as CPython lays them out
            self.size += 340 + len(w) + len(ids) + 2 * len(tokens)
        ids, tokens = self.ids.__getitem__, self.tokens.__getitem__
        # a unit may be of white space beyond ASCII only, and have no ids
        return [(" ".join(filter(None, map(ids, words))), " ".join(filter(None, map(tokens, words)))) for words in cut]


def frequent(docs: DataFrame, source: str) -> DataFrame:
    """(chunk, n): how often tasks met words, but for those met once."""

    def run(batches):
        w, seen, held = words_of(source), Counter(), 0

        def flush():
            rows = [(k, n) for k, n in seen.items() if n > 1 and len(k) <= LONG and k[0] != "\n"]
            seen.clear()
            for at in range(0, len(rows), 50_000):
                k, n = zip(*rows[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(n, pa.int64())], ["chunk", "n"])

        for b in batches:
            for t in texts(b, 0):
                before = len(seen)
                seen.update(w.split(t))
                held += (len(seen) - before) * 150
                if held > TABLE_BYTES:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.select("text").mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, source: str, size: int = WORDS) -> str:
    """Compiles the most frequent words and ships the file; gives the name under which executors have it."""

    def run(batches):
        w = words_of(source)
        for b in batches:
            chunks = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w.merge(c) for c in chunks], pa.list_(pa.int32()))], ["chunk", "ids"])

    top = leading(stored(frequent(docs, source), "words"), size, WORDS_BYTES)
    got = top.mapInArrow(run, "chunk string, ids array<int>").toArrow()
    # zip of two lists and not to_pylist of rows: half the memory
    pairs = sorted(zip(got.column("chunk").to_pylist(), map(tuple, got.column("ids").to_pylist()), strict=True))
    return ship(docs.sparkSession, compile_words(pairs), "transducer")


def _coded(df: DataFrame, id_col: str, text_col: str, json_path: str | None, words: int, schema: str, make):
    source = tokenizer_json(json_path)
    kept = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    name = lexicon(kept, source, words)

    def run(batches):
        table = Table(words_of(source), opened(name))
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                yield make(part.column(0), table.code(list(texts(part, 1))))

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, {schema}")


def _n(ids: str) -> int:
    return ids.count(" ") + 1 if ids else 0


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, words: int = WORDS) -> DataFrame:
    """Columns doc_id, ids (array) and n_tokens."""

    def make(keys, coded):
        n = np.array([_n(ids) for ids, _ in coded], np.int64)
        flat = np.fromstring(" ".join(ids for ids, _ in coded if ids), np.int32, sep=" ") if n.sum() else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays([keys, lists, pa.array(n)], ["doc_id", "ids", "n_tokens"])

    return _coded(df, id_col, text_col, json_path, words, "ids array<int>, n_tokens long", make)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", json_path: str | None = None) -> DataFrame:
    """Columns doc_id and text: what the library's decode gives for the ids, special tokens included."""
    source = tokenizer_json(json_path)
    kept = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches):
        t = words_of(source).tokenizer
        for b in batches:
            out = [t.decode([i for i in x.as_py() or [] if i is not None], skip_special_tokens=False) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, text string")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, n_tokens and the digests of its ids and of what they decode to.

    The tokenizer has no decoder, so ids decode to their tokens with spaces between.
    """
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def make(keys, coded):
        columns = [pa.array([_n(i) for i, _ in coded], pa.int64()), pa.array([sha(i) for i, _ in coded], pa.string()), pa.array([sha(t) for _, t in coded], pa.string())]
        return pa.RecordBatch.from_arrays([keys, *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _coded(df, id_col, text_col, json_path, words, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
