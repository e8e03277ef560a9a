"""Code lines against a character-wise model; the rules of scopes; repeated subtrees."""

import random
import re

from codeloom.operators import windows
from codeloom.sources import comments, lexer, syntax


def stripped(text):
    """Character by character: code without comments, by line, and whether each line begins in a comment."""
    out, state, begins = [""], "code", [False]
    i = 0
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if c == "\n":
            state = "code" if state in ("line", '"', "'") else state
            out.append("")
            begins.append(state == "block")
        elif state == "code":
            if two == "//":
                state = "line"
            elif two == "/*":
                state, i = "block", i + 1
            else:
                state = c if c in "\"'" else state
                out[-1] += c
        elif state == "block":
            if two == "*/":
                state, i = "code", i + 1
        elif state in "\"'":
            out[-1] += c
            if c == "\\":
                i += 1
                out[-1] += text[i]
            elif c == state:
                state = "code"
        i += 1
    return out, begins


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, value string")


def test_code(spark):
    rnd = random.Random(12)
    bits = ["a", "{", "}", "/*", "*/", "//", '"s{*/ // \\" }"', "'\\''", "\n", "\n", "/*/", "x;", " "]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 60))) for _ in range(60)] + ["", "/* a\n b */ c { /* d\n\n e */ }", "/*/\n/*/\nx\n/*/ y"]
    got = lexer.code(lexer.lines(files(spark, *texts, None))).collect()
    for i, t in enumerate(texts):
        code, begins = stripped(t)
        rows = sorted((r for r in got if r.path == f"f{i}"), key=lambda r: r.line)
        assert [r.code for r in rows] == code, t
        assert [r.begins_in for r in rows] == begins
        deep = 0
        for r, c in zip(rows, code, strict=True):
            bare = c.replace('"s{*/ // \\" }"', "")
            assert r.before == deep
            deep += bare.count("{") - bare.count("}")
            assert r.after == deep
    assert {r.path: r.value for r in lexer.without_comments(files(spark, "a/*\n*/b", "c // d")).collect()} == {"f0": "a\nb", "f1": "c "}


SOURCE = """// about the file
#include <x>
int a; // beside
// one
// two

void f()
{
  s = "}"; /* } */
  // inner
  x;
  // later
  y; {
  }
}
// head
int g() { // opens
  z;
}
// tail
w;
// at the end
"""


def test_scopes(spark):
    of = files(spark, SOURCE, "x; // a\n", "// only")
    found = comments.extract(of)
    got = {(r.path, r.nth): (r.begin, r.end, r.rule) for r in lexer.scopes(lexer.code(lexer.lines(of)), found).collect()}
    text = {(r.path, r.nth): r.text for r in found.collect()}
    assert {text[k]: v for k, v in got.items() if k[0] == "f0"} == {
        "// about the file": (1, 23, "include"), "// beside": (3, 3, "inline"), "// one": (4, 15, "block"), "// two": (4, 15, "block"), "/* } */": (9, 9, "inline"),
        "// inner": (10, 11, "next"), "// later": (12, 14, "block"), "// head": (16, 19, "block"), "// opens": (17, 19, "next"), "// tail": (20, 21, "next"), "// at the end": (23, 23, "end"),
    }
    assert [v for k, v in got.items() if k[0] == "f1"] == [(1, 1, "inline")] and [v for k, v in got.items() if k[0] == "f2"] == [(1, 1, "end")]


def test_scopes_broadcast_no_lines(spark, tmp_path):
    """What is broadcast are the few parts that cross a range, by hand; the planner takes lines for as little as their files."""
    files(spark, SOURCE, "x; // a\n", "// only").write.parquet(str(tmp_path / "texts"))
    of = spark.read.parquet(str(tmp_path / "texts"))
    got = lexer.scopes(lexer.code(lexer.lines(of)), comments.extract(of))
    joins = re.findall(r"BroadcastHashJoin (.*)", got._jdf.queryExecution().executedPlan().toString())
    assert all("__range" in x for x in joins), joins
    assert got.count() == 13


def pruned_model(trees):
    """Post-order over nested (tag, id, attribute, children), as sets of kept ids."""
    seen, kept = set(), set()

    def walk(node):
        tag, key, said, children = node
        left = [c for c in children if walk(c)]
        if key is None:
            kept.add(("", tag, said))
            return True
        new = (tag, said) not in seen
        seen.add((tag, said))
        if new or left:
            kept.add((key, tag, said))
        return new or bool(left)

    for t in trees:
        walk(t)
    return kept


def test_pruned(spark):
    rnd = random.Random(9)
    ids = iter(range(10_000))

    def tree(depth):
        return (rnd.choice("ABC"), next(ids) if rnd.random() < 0.9 else None, rnd.randrange(3), [tree(depth - 1) for _ in range(rnd.randrange(4))] if depth else [])

    def xml(node):
        tag, key, said, children = node
        own = f' id="{key}"' if key is not None else ""
        return f'<{tag}{own} spelling="{said}">{"".join(map(xml, children))}</{tag}>'

    deep = ("A", next(ids), 0, [])
    for _ in range(300):
        deep = ("A", next(ids), 0, [deep])
    trees = [tree(4) for _ in range(12)] + [deep]
    nodes = syntax.flatten(spark.createDataFrame([(f"u{i:03d}", bytearray(xml(t).encode())) for i, t in enumerate(trees)], "path string, content binary"))
    kept = syntax.pruned(nodes)
    assert kept.columns == nodes.columns and 10 < kept.count() < nodes.count()
    assert {(r.attrs.get("id", ""), r.tag, r.attrs["spelling"]) for r in kept.collect()} == {(str(i), t, str(s)) for i, t, s in pruned_model(trees)}
    # what is left hangs together
    assert kept.filter("up is not null").join(kept.select("unit", "node").withColumnRenamed("node", "up"), ["unit", "up"], "left_anti").isEmpty()


def test_running_and_following(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", None]), i, rnd.choice([None, None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "part string, at long, value long").repartition(5)
    from pyspark.sql import functions as F

    got = {r["at"]: (r.total, r.nxt) for r in windows.following(windows.running(df, ["part"], ["at"], total=F.coalesce("value", F.lit(0))), ["part"], ["at"], F.col("value"), "nxt").collect()}
    for p, at, _ in rows:
        own = [(a, v) for q, a, v in rows if q == p]
        assert got[at] == (sum(v or 0 for a, v in own if a <= at), next((v for a, v in own if a > at and v is not None), None))
