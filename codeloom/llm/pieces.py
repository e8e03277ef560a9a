"""Distinct-chunk segmentation for SentencePiece models.

No piece of the model has a white-space marker behind another character, so no
merge crosses the place where a marked word begins: words can be segmented one
by one.  A line feed that is in no longer piece is such a border too.

A *chunk* is written with its first marker left out: ``"word"`` stands for
``▁word``, ``" word"`` for ``▁▁word``, ``"\\nword"`` for a line feed and the
unmarked ``word`` behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

MARK = "▁"
_CHUNK = re.compile(" +[^ \n]*|\n[^ \n]*")


class Segmenter:
    """Segments chunks, and texts by their chunks."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        own = [p.piece for p in proto.pieces if p.type in (1, 4)]
        crosses = any(MARK in p.lstrip(MARK) for p in own) or any("\n" in p and len(p) > 1 for p in own)
        #: Else every text is one chunk.
        self.separable = not crosses and spec.name == "identity" and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix and all(p.type != 4 for p in proto.pieces)
        self.mark = self.sp.piece_to_id(MARK)
        self.ahead = self.sp.encode("a")
        self.skip = len(self.sp.decode(self.ahead))

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, in order."""
        if not text:
            return []
        if not self.separable:
            return [text]
        text = text.replace(MARK, " ").replace("\n", " \n") if MARK in text else text.replace("\n", " \n")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        text = text.replace(" \n", "\n")  # the space ahead of each line feed was added above
        return [x[1:] if x[0] == " " else x for x in _CHUNK.findall(" " + text)]

    def ids(self, chunk: str) -> list[int]:
        if not self.separable:
            return self.sp.encode(chunk)
        if not chunk:
            return [self.mark]
        return self.sp.encode(chunk)[1:] if chunk[0] == "\n" else self.sp.encode(chunk)

    def text(self, ids: list[int]) -> str:
        """What ``ids`` decode to behind other pieces."""
        return self.sp.decode(ids) if not self.separable else self.sp.decode(self.ahead + ids)[self.skip :]


@lru_cache(maxsize=2)
def segmenter(model: bytes) -> Segmenter:
    return Segmenter(model)


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read once by the driver and sent to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def texts(batch, column: int) -> Iterator[str]:
    """The strings of an Arrow batch's column, null as empty, one at a time."""
    for x in batch.column(column):
        yield x.as_py() or ""
