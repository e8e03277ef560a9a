"""Blocks cut at calls, addresses in memory, ranges of tokens: against plain-Python models."""

import random

from codeloom.operators import blocks, memory, ranges

PLACE = "struct<line:int,col:int>"


def test_split_and_edges(spark):
    b = spark.createDataFrame(
        [
            ("f", 0, "ENTRY", None, None, [1]), ("f", 1, "BLOCK", (1, 1), (5, 80), [2]), ("f", 2, "BLOCK", (6, 1), (6, 80), [3]), ("f", 3, "EXIT", None, None, []),
            ("g", 0, "ENTRY", None, None, [1]), ("g", 1, "BLOCK", (20, 1), (21, 1), [2]), ("g", 2, "EXIT", None, None, []), ("one", 5, "BLOCK", (30, 1), (31, 1), []),
        ],
        f"func string, id int, kind string, begin {PLACE}, end {PLACE}, succ array<int>",
    )
    # a(b(), c()) on line 2; one() in the second block; a call outside every block
    calls = [("f", 1, "h", (2, 5), (2, 30)), ("f", 2, "g", (2, 7), (2, 10)), ("f", 3, "f", (2, 12), (2, 15)), ("f", 4, "one", (6, 2), (6, 9)), ("f", 5, "g", (9, 1), (9, 2))]
    c = spark.createDataFrame(calls, f"func string, call int, callee string, first {PLACE}, last {PLACE}")
    pieces = blocks.split_at_calls(b, c)
    plain = lambda x: tuple(x) if x else None
    got = {(r.func, r.id, r.piece): (plain(r.begin), plain(r.end), r.callee) for r in pieces.collect()}
    assert got == {
        ("f", 0, 0): (None, None, None), ("f", 3, 0): (None, None, None), ("g", 0, 0): (None, None, None), ("g", 2, 0): (None, None, None),
        ("f", 1, 0): ((1, 1), (2, 10), "g"), ("f", 1, 1): ((2, 10), (2, 15), "f"), ("f", 1, 2): ((2, 15), (2, 30), "h"), ("f", 1, 3): ((2, 30), (5, 80), None),
        ("f", 2, 0): ((6, 1), (6, 9), "one"), ("f", 2, 1): ((6, 9), (6, 80), None), ("g", 1, 0): ((20, 1), (21, 1), None), ("one", 5, 0): ((30, 1), (31, 1), None),
    }
    edges = {(tuple(r.src), tuple(r.dst), r.kind) for r in blocks.interprocedural(b, pieces).collect()}
    assert edges == {
        (("f", 0, 0), ("f", 1, 0), "FLOW"), (("f", 1, 3), ("f", 2, 0), "FLOW"), (("f", 2, 1), ("f", 3, 0), "FLOW"), (("g", 0, 0), ("g", 1, 0), "FLOW"), (("g", 1, 0), ("g", 2, 0), "FLOW"),
        (("f", 1, 0), ("g", 0, 0), "CALL"), (("g", 2, 0), ("f", 1, 1), "RETURN"), (("f", 1, 1), ("f", 0, 0), "CALL"), (("f", 3, 0), ("f", 1, 2), "RETURN"),
        (("f", 1, 2), ("h", 0, 0), "CALL"), (("h", 0, 0), ("f", 1, 3), "RETURN"), (("f", 2, 0), ("one", 5, 0), "CALL"), (("one", 5, 0), ("f", 2, 1), "RETURN"),
    }
    # a call belongs to the piece that it ends, a variable to the first block with it on that line, the rest to the function's first block
    uses = spark.createDataFrame([("f", "g", 2, (2, 10)), ("f", "h", 2, (2, 30)), ("f", "x", 2, (2, 20)), ("f", "x", 2, (2, 6)), ("f", "y", 3, (3, 1))], f"func string, name string, line int, at {PLACE}")
    records = spark.createDataFrame([(1, "f", "g", 2), (2, "f", "h", 2), (3, "f", "x", 2), (4, "f", "y", 3), (5, "f", "z", 3), (6, "one", "x", 2)], "record int, func string, name string, line int")
    at = {r.record: (r.func, r.id, r.piece) for r in blocks.attributed(records, uses, pieces).collect()}
    assert at == {1: ("f", 1, 0), 2: ("f", 1, 2), 3: ("f", 1, 0), 4: ("f", 1, 3), 5: ("f", 0, 0), 6: ("one", 5, 0)}


def test_pieces_partition_blocks(spark):
    rnd = random.Random(3)
    b, c = [], []
    for f in range(6):
        line = 1
        for i in range(12):
            size = rnd.choice([1, 3, 70])
            b.append((f"f{f}", i, "BLOCK", (line, 1), (line + size, 90), []))
            for k in range(rnd.randrange(5)):
                at = rnd.randint(line, line + size - 1)
                c.append((f"f{f}", i * 10 + k, "g", (at, rnd.randint(2, 40)), (at, rnd.randint(41, 89))))
            line += size + 1
    pieces = blocks.split_at_calls(spark.createDataFrame(b, f"func string, id int, kind string, begin {PLACE}, end {PLACE}, succ array<int>"), spark.createDataFrame(c, f"func string, call int, callee string, first {PLACE}, last {PLACE}"))
    rows = sorted((r.func, r.id, r.piece, tuple(r.begin), tuple(r.end), r.callee) for r in pieces.collect())
    for f, i, _, begin, end, _ in b:
        own = [r for r in rows if r[:2] == (f, i)]
        cuts = sorted(last for g, k, _, _, last in c if g == f and k // 10 == i)
        assert [r[2] for r in own] == list(range(len(cuts) + 1))
        assert [r[3] for r in own] == [begin, *cuts] and [r[4] for r in own] == [*cuts, end]
        assert [r[5] for r in own] == ["g"] * len(cuts) + [None]


def model(access, globals_, locals_, frames, heap):
    """The variable of an address, by looking at every variable."""
    _, at, func, rbp = access
    down = lambda name, off: max(((-o, n, s, k) for f, n, o, s, k in locals_ if f == name and o >= off), default=None)

    def up(some):
        best = max(((b, n, s, k) for n, b, s, k in some if b <= at), default=None)
        if best and at - best[0] < best[2] * (best[3] or 1):
            return best[1], None, (at - best[0]) // best[2] if best[3] is not None else None

    def below(name, off):
        best = down(name, off)
        if best and -best[0] - off < best[2] * (best[3] or 1):
            return best[1], name, (-best[0] - off) // best[2] if best[3] is not None else None

    if hit := up(globals_):
        return ("GLOBAL", *hit)
    if hit := below(func, rbp - at):
        return ("LOCAL", *hit)
    above = min(((p, f) for f, p in frames if p > at), default=None)
    if above and (hit := below(above[1], above[0] - at)):
        return ("NONLOCALSTACK", *hit)
    if hit := up(heap):
        return ("HEAP", *hit)
    return None, None, None, None


def test_locate(spark):
    rnd = random.Random(8)
    n = lambda: rnd.choice([None, None, 3, 5])
    globals_ = [(f"g{i}", 1000 + 40 * i, rnd.choice([4, 8]), n()) for i in range(20)]
    heap = [(f"h{i}", 5000 + 50 * i, rnd.choice([4, 8]), n()) for i in range(20)]
    locals_ = [(f"f{k}", f"v{k}{i}", 24 * (i + 1), rnd.choice([4, 8]), n()) for k in range(4) for i in range(5)]
    frames = [(f"f{rnd.randrange(4)}", 9000 + 150 * i) for i in range(10)]
    accesses = []
    for i in range(800):
        f, p = rnd.choice(frames)
        accesses.append((i, rnd.choice([rnd.randint(990, 1830), p - rnd.randint(0, 130), rnd.randint(8800, 10600), rnd.randint(4990, 6020)]), f, p))
    df = [spark.createDataFrame(rows, schema) for rows, schema in ((accesses, "id long, at long, func string, rbp long"), (globals_, "name string, base long, size int, n int"), (locals_, "func string, name string, offset long, size int, n int"), (frames, "func string, rbp long"), (heap, "name string, base long, size int, n int"))]
    got = {r.id: (r["class"], r.name, r.owner, r.position) for r in memory.locate(*df).collect()}
    want = {a[0]: model(a, globals_, locals_, frames, heap) for a in accesses}
    assert got == want
    assert {w[0] for w in want.values()} == {"GLOBAL", "LOCAL", "NONLOCALSTACK", "HEAP", None}


def test_texts_of_ranges(spark):
    rnd = random.Random(5)
    tokens = [("a.c", (line, 1 + 4 * k), f"t{line}_{k}") for line in range(1, 60) for k in range(rnd.randrange(6))] + [("a.c", (7, 90), "/* two\nlines */"), ("b.c", (3, 3), "other")]
    spans = []
    for i in range(80):
        first = (rnd.randint(1, 58), rnd.randint(1, 25))
        spans.append(("a.c", i, first, max(first, (first[0] + rnd.choice([0, 0, 1, 30]), rnd.randint(1, 99)))))
    spans += [("a.c", 900, (7, 1), (7, 99)), ("c.c", 901, (1, 1), (9, 9))]
    got = ranges.texts_of(spark.createDataFrame(tokens, f"file string, at {PLACE}, token string"), spark.createDataFrame(spans, f"file string, id int, first {PLACE}, last {PLACE}"), 8)
    want = {i: " ".join(t for g, at, t in tokens if g == f and a <= at < z and "\n" not in t) for f, i, a, z in spans}
    assert {r.id: r.text for r in got.collect()} == want
