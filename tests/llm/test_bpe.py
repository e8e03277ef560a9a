"""The transducer against a dictionary, and the BPE codec against the library."""

import hashlib
import random

import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import bpe_codec
from codeloom.llm.transducer import Transducer, compile_words

TEXTS = [
    None, "", " ", "Hello, World!", "it's we'LL 'S ''s don't", "á éx ́x", "NAÏVE Ünïcode ß ÷×µªº²½", "tab\tnew\nline\x0bvt\x0cff\rcr", "a\x1cb\x85c\xa0d　e f \x85 \xa0",
    "x<|endoftext|>y <|startoftext|><|endoftext|> <|ENDOFTEXT|> <| |>", "İstanbul ΣΑΣ ς ﬁ Ⅷ ǅ", "日本語 é🙂 한글 12 34567", "\x00a\x00 b", "word " * 20_000, "Q" * 5_000, "ñandú ÑANDÚ", "<|endoftext|>", "'", "don’t “quoted”", "ạ̀ 가",
]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abcé", max_size=6), st.lists(st.integers(0, 3), max_size=4).map(tuple), max_size=30))
def test_transducer(tmp_path_factory, words):
    path = tmp_path_factory.mktemp("t") / "file"
    path.write_bytes(compile_words(sorted(words.items())) + b"\n")
    t = Transducer(str(path))
    for w, out in words.items():
        assert t.look(w) == list(out)
    for w in ("", "a", "ab", "zz", "abcabcabc"):
        assert (t.look(w) is None) == (w not in words)


def test_transducer_shares(tmp_path):
    """Equal futures are one state, whatever the outputs on the way."""
    stems, ends = ["walk", "talk", "jump", "climb"], ["ed", "ing", "s"]
    pairs = sorted((a + b, (i, 10 + j)) for i, a in enumerate(stems) for j, b in enumerate(ends))
    (tmp_path / "f").write_bytes(compile_words(pairs))
    t = Transducer(str(tmp_path / "f"))
    assert all(t.look(w) == list(o) for w, o in pairs)
    # the start, 3 for (w or t)alk, 3 for jump, 4 for climb, and 5 that all stems share
    assert t.states == 16
    with pytest.raises(ValueError):
        compile_words([("b", ()), ("a", ())])


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(library, rows):
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(map(str, out))


@pytest.mark.parametrize("words", [60_000, 5, 0])
def test_digests(spark, library, words):
    rnd = random.Random(words)
    alphabet = "aAbé'sS ,.19\n\t<|>ß́Σ\xa0\x1c語"
    rows = [*enumerate(TEXTS), (None, "zz top"), (3, "Hello, World!"), *((100 + i, "".join(rnd.choices(alphabet, k=rnd.randint(0, 40)))) for i in range(300))]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, ids string, chunk string")
    got = bpe_codec.digests(df, words=words)
    assert sorted(str(tuple(r)) for r in got.collect()) == expected(library, rows)


def test_encode_and_decode(spark, library):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    coded = bpe_codec.encode(df)
    rows = {r.doc_id: r for r in coded.collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
    for r in bpe_codec.decode(coded).collect():
        assert r.text == library.decode(rows[r.doc_id].ids, skip_special_tokens=False)
    assert bpe_codec.encode(df.limit(0)).count() == 0 and bpe_codec.digests(df.limit(0)).count() == 0


def test_table_empties(tmp_path, library):
    (tmp_path / "f").write_bytes(compile_words([]))
    units = bpe_codec.Table(bpe_codec.words_of(bpe_codec.tokenizer_json()), Transducer(str(tmp_path / "f")), limit=1_000)
    for t in ["one two three", "two one", "four five six seven", "one", "", "\xa0"] * 3:
        ((ids, tokens),) = units.code([t])
        assert ids == " ".join(map(str, library.encode(t).ids)) and tokens == library.decode(library.encode(t).ids)
        assert units.size < 4_000
