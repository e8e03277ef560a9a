"""Stems, token filters and the binding cascade: published pairs and a plain-Python model."""

import collections
import random
import re

from pyspark.sql import functions as F

from codeloom.functions.stems import porter, with_stems
from codeloom.operators import tokens
from codeloom.plans import binding, cascade

PAIRS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil""".split()


def test_porter(spark):
    for word, want in zip(PAIRS[::2], PAIRS[1::2], strict=True):
        assert porter(word) == want, word
    assert [porter(x) for x in ("", "a", "by", "yyy", "s")] == ["", "a", "by", "yyi", "s"]
    df = spark.createDataFrame([("Hopping", 1), (None, 2), ("Hopping", 3)], "w string, n int")
    assert sorted((r.n, r.stem) for r in with_stems(df, "w").collect()) == [(1, "hop"), (2, None), (3, "hop")]


def test_tokens(spark):
    lexicon = spark.createDataFrame([("quickly", "RB"), ("user-defined", "JJ"), ("green", "JJ"), ("user", "NN"), ("defined", "VBN"), ("red-green", "JJ")], "word string, tag string")
    stop = spark.createDataFrame([("the", ), ("and", )], "word string")
    known = spark.createDataFrame([("return type",), ("Mutex",)], "phrase string")
    text = "The (mutex) of user-defined buffers, quickly 123 green red-green -stack- list ab return mutexes the"
    got = tokens.comment_tokens(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "id", "text", known, stop, lexicon)
    # mutex and return begin known phrases; green is an adjective, of red-green only red is left
    assert sorted((r.id, r.token) for r in got.collect()) == [(1, "buffers"), (1, "defined"), (1, "mutexes"), (1, "red"), (1, "stack"), (1, "user")]
    names = spark.createDataFrame([("f", "getGreenBuffer_list")], "id string, spelling string")
    out = tokens.name_tokens(names, "id", "spelling", F.split(F.lit("get Green Buffer list and many io"), " "), stop, lexicon)
    assert sorted(r.token for r in out.collect()) == ["Buffer", "get", "getGreenBuffer_list"]


def model(questions, dictionary, names, comments, sim_names, sim_comments):
    """The cascade and the conflicts, question by question, by looking at every token."""
    out = set()
    for q, text in questions:
        ws = [w for w in (re.sub(r"^[.,;:!?()\"']+|[.,;:!?()\"']+$", "", x) for x in text.lower().split()) if len(w) > 1]
        runs = [(i, j, " ".join(ws[i:j])) for i in range(len(ws)) for j in range(i + 1, min(i + 3, len(ws)) + 1)]
        said = {p for _, _, p in runs}
        found = {(p, k, p, "exact") for p in said for x, k in dictionary if x == p}
        looks = lambda p: {p, porter(p)}
        best = lambda rows: min(((-s, t) for t, _, s in rows), default=(0, None))[1]
        symbol = any(k == "symbol" for _, k, _, _ in found)
        named = set() if symbol else {(p, "name_token", t, "prefix") for p in said for t in names if any(len(x) > 1 and t.lower().startswith(x) for x in looks(p))}
        if not symbol and not named:
            for p in said:
                if t := best([r for r in sim_names if any(len(x) > 1 and r[1].lower().startswith(x) for x in looks(p))]):
                    named.add((p, "name_token", t, "similar"))
        direct = {(p, "comment_token", t, "prefix") for p in said for t in comments if t.lower().startswith(p)}
        if not direct:
            for p in said:
                if t := best([r for r in sim_comments if looks(p) & set(re.split(r"\W+", r[1].lower()))]):
                    direct.add((p, "comment_token", t, "similar"))
        have = {(p, t) for p, _, t, _ in direct}
        related = {(p, "comment_token", s, "related") for p, _, t, _ in direct for u, s, _ in sim_comments if u == t and porter(u.lower()) != porter(s.lower()) and (p, s) not in have}
        found |= named | direct | related
        kinds = collections.defaultdict(set)
        for p, k, _, _ in found:
            kinds[p].add(k)
        kept = []
        for p, k, t, how in found:
            ks = kinds[p]
            c = "comment_token" in ks and not ks & {"values", "common_word", "symbol", "static_attribute"}
            n = "name_token" in ks and "values" not in ks
            conflict = c and n
            n, c = n and not conflict and "static_attribute" not in ks, c and "dynamic_attribute" not in ks
            if (c if k == "comment_token" else n if k == "name_token" else True):
                kept.append((p, k, t, how, conflict))
        alive = {p for p, *_ in kept}
        spans = [(i, j, p) for i, j, p in runs if p in alive]
        for i, j, p in spans:
            if not any((a <= i and j <= b) and (a, b) != (i, j) for a, b, _ in spans):
                out |= {(q, p, i + 1, j + 1, k, t, how, c) for x, k, t, how, c in kept if x == p}
    return out


def test_cascade(spark):
    rnd = random.Random(17)
    vocabulary = ["mutex", "lock", "locking", "thread", "threads", "buffer", "png", "image", "return", "type", "main", "read", "readers", "file", "hopping", "hop"]
    dictionary = [("return type", "static_attribute"), ("type", "static_attribute"), ("main", "symbol"), ("lock", "values"), ("file", "common_word"), ("read", "dynamic_attribute"), ("thread", "dynamic_attribute"), ("thread", "values")]
    names, comments = ["lockMutex", "bufferSize", "readHeader", "pngImage", "typeName", "Hopper", "return_type_of"], ["buffer", "threading", "reader", "lockfree", "image", "types"]
    sim_names = [("pngImage", "picture", 0.7), ("bufferSize", "lengthy", 0.6), ("Hopper", "lengthy", 0.6), ("typeName", "hopes", 0.9)]
    sim_comments = [("buffer", "memory block", 0.8), ("image", "picture", 0.5), ("image", "main thread", 0.9), ("reader", "readers", 0.99), ("types", "hop", 0.3), ("reader", "hop", 0.4), ("threading", "mutex", 0.7)]
    extra = ["picture", "lengthening", "block", "hopes", "memory", "zebra", "of", "the", "a", "Main?"]
    questions = [(i, " ".join(rnd.choices(vocabulary + extra, k=rnd.randint(1, 5)))) for i in range(150)] + [(900, ""), (901, "?! ,")]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = cascade.bind(
        df([*questions, (902, None)], "q int, text string"), ["q"], df(dictionary, "phrase string, kind string"), df([(x,) for x in names], "token string"), df([(x,) for x in comments], "token string"),
        df(sim_names, "token string, similar string, score double"), df(sim_comments, "token string, similar string, score double"),
    )
    rows = [(r.q, r.phrase, r.start, r.end, r.kind, r.token, r.how, r.conflict) for r in got.collect()]
    want = model(questions, dictionary, names, comments, sim_names, sim_comments)
    assert set(rows) == want and len(rows) == len(want)
    assert {how for *_, how, _ in want} == {"exact", "prefix", "similar", "related"} and any(c for *_, c in want)


def test_abstract(spark):
    df = spark.createDataFrame([("what is the return type of main or main", [(4, 6, "attribute"), (7, 8, "symbol"), (9, 10, "symbol")])], "text string, found array<struct<start:int,end:int,kind:string>>")
    # places, not strings: neither occurrence of main is replaced inside another
    assert df.select(cascade.abstract(binding.words(F.col("text")), F.col("found"))).first()[0] == "what is the <<attribute>> of <<symbol>> or <<symbol>>"


def test_questions_that_say_the_same_are_answered_once(spark):
    from codeloom.plans import dispatch

    bound = spark.createDataFrame([(1, 1, 2, "a", "symbol"), (2, 1, 2, "a", "symbol"), (3, 1, 2, "b", "symbol"), (4, 1, 2, "p", "static_attribute")], "id long, start int, end int, phrase string, kind string")
    by, asked = dispatch._classes(bound, ["id"])
    assert asked.count() == 3 and by.select("said").distinct().count() == 3
    found = asked.select("said", "template", F.lit("s").alias("s"), F.coalesce("q_symbol", F.array_join("q_static_attributes", "|")).alias("answer"))
    assert sorted((r.id, r.template, r.answer) for r in dispatch._dealt(found, by, ["id"]).collect()) == [(1, "attributes_of", "a"), (2, "attributes_of", "a"), (3, "attributes_of", "b"), (4, "with_attributes", "p")]
