"""The alignment of tokens against brute force over token bytes."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from codeloom.llm import alignment

TEXTS = [
    None, "", " ", "\n", "\n\n x", "Hello, World!  It's unbelievable", "tab\there \t and\n\n\nlines \n end ", "a ▁b", "▁", "x\xa0 \xa0y 　z   w", "日本語 é🙂 <s> </s> <unk> <|endoftext|> 12 3", "<0x0A> a",
    "\x00a\x00", "a\x1cb \x85c", "long words " * 9_000, "Q" * 3_000, "Hello, World!", "  two  spaces   three", "antidisestablishmentarianism pneumonoultramicroscopic", "é" * 50, "\ta", "a\t b\t\n c",
]


@pytest.fixture(scope="module")
def both():
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(both, rows):
    a_lib, sp = both
    alphabet = alignment._byte_alphabet()
    out, holds = [], collections.Counter()
    for i, t in rows:
        raw = (" " + (t or "")).encode()
        a = [(x, bytes(alphabet[c] for c in a_lib.id_to_token(x))) for x in a_lib.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(x, bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode()) for x in sp.encode(t)] if t else []
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a, b = [], []
        ends_a, ends_b = np.cumsum([0, *(len(x) for _, x in a)]), np.cumsum([0, *(len(x) for _, x in b)])
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        links, groups = [], []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            ga = [x for (x, _), e in zip(a, ends_a[1:], strict=True) if lo < e <= hi] if len(a) < 500 else [a[k][0] for k in range(np.searchsorted(ends_a, lo), np.searchsorted(ends_a, hi))]
            gb = [x for (x, _), e in zip(b, ends_b[1:], strict=True) if lo < e <= hi] if len(b) < 500 else [b[k][0] for k in range(np.searchsorted(ends_b, lo), np.searchsorted(ends_b, hi))]
            links += [(x, y) for x in ga for y in gb]
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        over = len(set(ends_a[1:].tolist()) | set(ends_b[1:].tolist()))  # every end of either opens one further overlap
        holds.update(set(links))
        out.append((i, len(a), len(b), len(groups), links, over, ";".join(groups)))
    most = collections.Counter()
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    return [(i, na, nb, ng, len(ls), ov, g, sum(holds[p] == most[p[0]] for p in ls), sum(holds[p] for p in ls)) for i, na, nb, ng, ls, ov, g in out]


@pytest.mark.parametrize("head,limit", [(1_000_000, 64_000_000), (30, 2_000), (0, 0)])
def test_links(spark, both, head, limit, monkeypatch):
    monkeypatch.setattr(alignment.Table.__init__, "__defaults__", (limit,))
    monkeypatch.setattr(alignment, "SLICE_BYTES", 300)
    rnd = random.Random(head)
    words = ["the", "unlinked", "Straße", "x\n", "\n", " ", "\t", "ñandú", "12,5", "\xa0", "(a)", "▁", "antelope"]
    rows = [*enumerate(TEXTS), (None, "Hello, World!"), (5, "again"), *((100 + i, " ".join(rnd.choices(words, weights=[9, 9, 9, 3, 1, 2, 1, 9, 9, 1, 9, 0.05, 9], k=rnd.randint(1, 30)))) for i in range(200))]
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, row int, pairs string").repartition(5)
    want = brute(both, rows)
    got = alignment.links(df, digest=False, head=head).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups", "n_best", "count_sum").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))


def test_digest(spark, both):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = {r[0]: hashlib.sha256(r[6].encode()).hexdigest() if r[6] else "" for r in brute(both, list(enumerate(TEXTS)))}
    assert {r.doc_id: r.groups_sha256 for r in alignment.links(df).collect()} == want
    assert alignment.links(df.limit(0)).count() == 0


def test_product():
    rnd = np.random.default_rng(5)
    for _ in range(30):
        x, y = rnd.integers(0, 3, (5, 7)) * rnd.integers(0, 2, (5, 7)), rnd.integers(0, 3, (7, 4)) * rnd.integers(0, 2, (7, 4))
        csr = [alignment.CSR(np.concatenate([[0], np.cumsum((m != 0).sum(1))]), np.nonzero(m)[1], m[m != 0]) for m in (x, y)]
        got, dense = alignment.product(*csr), np.zeros((5, 4), int)
        dense[got.rows(), got.column] = got.value
        assert (dense == x @ y).all()


def test_same_ids_as_the_library(both):
    """The quick tokenizer cuts every character as the library does."""
    ids = alignment.ByteBPE(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()).encode
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b 1{c} {c}!{c}" for c in chars]
    assert [ids(t) for t in texts] == [e.ids for e in both[0].encode_batch(texts, add_special_tokens=False)]
