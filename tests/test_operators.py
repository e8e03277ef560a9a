"""Operators on inputs that the driver's tables do not hold: cycles, deep chains, hot keys, odd texts."""

import pytest
from pyspark.sql import functions as F

from codeloom import shared
from codeloom.functions import names
from codeloom.operators import attribution, graphs, relevance, windows
from codeloom.sources import sinks, trace, turtle


@pytest.fixture(autouse=True)
def folder(spark):
    shared.folder(spark)


def roots(spark, pairs):
    df = spark.createDataFrame(pairs, "id long, to long")
    return {r.id: r.root for r in graphs.fixpoint(df).collect()}


def test_fixpoint_on_cycles_and_chains(spark):
    assert roots(spark, [(1, 2), (2, 3), (3, 1)]) == {1: 1, 2: 1, 3: 1}
    assert roots(spark, [(5, 4), (4, 5)]) == {4: 4, 5: 4}
    assert roots(spark, [(7, 8), (8, 6), (6, 9), (9, 8), (1, 7), (3, 3), (2, None)]) == {7: 6, 8: 6, 6: 6, 9: 6, 1: 6, 3: 3, 2: 2}
    chain = [(i, i + 1 if i < 100 else None) for i in range(101)]
    assert set(roots(spark, chain).values()) == {100}
    assert roots(spark, [(10, 99)]) == {10: 99} and roots(spark, []) == {}
    eight = [(i, (i + 1) % 8 + 20 if i >= 20 else 20) for i in range(20, 28)]
    assert roots(spark, [(i, 20 + (i - 19) % 8) for i, _ in eight]) == {i: 20 for i in range(20, 28)}


def test_closure_on_cycles_and_depth(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(70, 0), (50, 3)], "src long, dst long")
    got = {r.node: r.level for r in graphs.closure(edges, spark.createDataFrame([(0,)], "root long")).collect()}
    assert got == {i: i for i in range(71)}


def test_first_along(spark):
    rows = spark.createDataFrame([(1, 2, None), (2, 3, None), (3, 4, "x"), (4, None, "y"), (5, 6, None), (6, 5, None), (7, None, None), (8, 99, None)], "id long, to long, v string")
    assert {r.id: r.v for r in attribution.first_along(rows, "id", "to", "v").collect()} == {1: "x", 2: "x", 3: "x", 4: "y", 5: None, 6: None, 7: None, 8: None}


def test_ranges_carry_on(spark):
    """One part over many ranges: segments and floors go on across their borders."""
    n = 400
    log = spark.createDataFrame([(0, i, i % 90 == 5, i // 200) for i in range(n)], "part int, at long, special boolean, ctx int")
    got = {r.at: r.seg for r in windows.segments(log, ["part"], "at", F.col("special"), ["ctx"], strict=False).collect()}
    assert got == {i: sum(j % 90 == 5 for j in range(i + 1)) for i in range(n) if i % 90 != 5}
    strict = {r.at for r in windows.segments(log, ["part"], "at", F.col("special"), ["ctx"]).collect()}
    first = {s: min(i for i in got if got[i] == s) // 200 for s in set(got.values())}
    assert strict == {i for i in got if i // 200 == first[got[i]]}
    points = spark.createDataFrame([(0, i, i) for i in range(n)] + [(1, 5, 1000)], "part int, at long, id long")
    bases = spark.createDataFrame([(0, 3, "a", 50), (0, 300, "b", 10)], "part int, base long, var string, size long")
    low = {r.id: r.value for r in windows.floor_lookup(points, bases, "part", "at", "base", "var").collect()}
    assert low == {i: None if i < 3 else "a" if i < 300 else "b" for i in range(n)} | {1000: None}
    held = {r.id: r.value for r in windows.floor_lookup(points, bases, "part", "at", "base", "var", "size").collect()}
    assert held == {i: "a" if 3 <= i < 53 else "b" if 300 <= i < 310 else None for i in range(n)} | {1000: None}


def test_related_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(60, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    queries = rows.filter("vec_id % 5 = 0")
    whole = sorted(map(tuple, relevance.most_similar(queries, rows, 4).collect()))
    monkeypatch.setattr(relevance, "QUERIES", 3)
    monkeypatch.setattr(relevance, "BLOCK", 10)
    assert sorted(map(tuple, relevance.most_similar(queries, rows, 4).collect())) == whole and len(whole) == 12 * 4


def test_turtle(spark):
    base = "http://x/"
    text = '@prefix p: <http://x/properties#> .\n# note\n<http://x/f#1> p:name "a;b, \\"c\\" ." ;\n  p:in <http://x/file#2> , <http://x/file#3> .\n<http://x/f#4> p:name "z"@en .\n'
    got = turtle.parse(spark.createDataFrame([(text,)], "value string"), base, {"p": "http://x/properties#"}).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("1", "f", "name", 'a;b, "c" .', None), ("1", "f", "in", "2", "file"), ("1", "f", "in", "3", "file"), ("4", "f", "name", "z", None)]))
    odd = spark.createDataFrame([("1", "f", "p", 'back\\slash "q"\n\r end', None), ("2", "f", "p", "", None)], "s string, ns string, p string, o string, o_ns string")
    assert sorted(map(str, map(tuple, turtle.parse(sinks.turtle(odd, base), base).collect()))) == sorted(str(tuple(r)) for r in odd.select("s", "ns", "p", "o", "o_ns").collect())


def test_lock_lists(spark):
    lines = spark.createDataFrame([("READ TS r_1 SYNCS 2 ADDRESS 0x1 TYPE MUTEX ADDRESS 0x2 TYPE READ X 1",), ("DYNAMICTRACE INP a b c RUNID r TS r_2",), ("",)], "value string")
    got = {r.seq: r for r in trace.parse(lines).collect()}
    assert [tuple(x) for x in got[1].locks] == [("0x1", "MUTEX"), ("0x2", "READ")] and got[1].attrs["X"] == "1" and got[2].inputs == ["a", "b", "c"] and got[2].locks == []


def test_parameter_types(spark):
    df = spark.createDataFrame([("f(std::map<int, std::pair<a, b>>, void (*)(int, char), x)",), ("f()",), ("f(void)",)], "s string")
    got = [r[0] for r in df.select(names.parameter_types(F.col("s"))).collect()]
    assert got == [["std::map<int, std::pair<a, b>>", "void (*)(int, char)", "x"], [], ["void"]]


def test_closure_over_many_levels_keeps_plans_small(spark):
    """Each level's paths meet; what plans know of columns must not grow from level to level."""
    edges = spark.createDataFrame([(k, k + d) for k in range(12) for d in (1, 2)], "src long, dst long")
    got = graphs.closure(edges, spark.createDataFrame([(0,)], "root long"))
    assert {r.node: r.level for r in got.collect()} == {n: (n + 1) // 2 for n in range(14)}
    assert "LogicalRDD" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_are_joined_by_the_few_parts_that_cross_them(spark):
    """What earlier ranges hold is one row a range, and no table of all parts is sorted and joined."""
    from codeloom.operators import windows

    rows = spark.range(400).selectExpr("id div 7 AS p", "id AS k")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for got, want in ((windows.running(rows, ["p"], ["k"], n=F.lit(1)), lambda k: k % 7 + 1), (windows.following(rows, ["p"], ["k"], F.when(F.col("k") % 7 == 6, F.col("k")), "n"), lambda k: None if k % 7 == 6 or k > 398 else k // 7 * 7 + 6)):
            assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
            assert {r.k: r.n for r in got.collect()} == {k: want(k) for k in range(400)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
