"""Emitters and small operators on programs, on inline samples."""

from pyspark.sql import functions as F

from codeloom.operators import programs
from codeloom.sources import emit, runs, syntax

TREE = """<TU><ClassDecl id="c" spelling="K"><VarDecl id="v1" spelling="n" mangled_name="_ZN1K1nE" address="0x10" size="4" type="int" lex_parent_id="c"/><VarDecl id="f" spelling="m" address="0x11" offset="8" type="int"/>
  <CXXMethod id="m" spelling="get" linkage_name="_ZN1K3getEv" mangled_name="_ZN1K3getEv" funcargs="int,char *" return_type="int" file="/p/k.h" isDef="True" range.start="[3:1]" range.end="[9:2]">
    <VarDecl id="v2" spelling="once" address="0x20" size="8" type="long" sem_parent_id="m" storage_class="STATIC"/><ParmDecl id="p1" spelling="i" offset="0x14" file="/p/k.h" type="int" size="4" lex_parent_id="m"/></CXXMethod></ClassDecl>
  <StructDecl id="s" spelling="S"><VarDecl id="v3" spelling="x" address="0x30" type="int"/></StructDecl><StructDecl id="t"><VarDecl id="v4" spelling="y" address="0x40" type="int"/></StructDecl>
  <VarDecl id="v5" spelling="g" address="0x50" storage_class="STATIC" type="int"/><VarDecl id="v6" spelling="h" address="0x20" type="int"/><VarDecl id="v7" spelling="e" linkage_kind="external" type="int"/>
  <FunctionDecl id="fn" spelling="main" linkage_name="main" funcargs="" return_type="int" file="/p/a.c" isDef="True" range.start="[1:1]" range.end="[2:2]"><VarDecl id="l" spelling="buf" offset="0x8" file="/p/a.c" type="char [4]"/></FunctionDecl><FunctionDecl id="tm" spelling="t" linkage_name="" file="/p/a.c"/></TU>"""


def nodes(spark, xml=TREE):
    return syntax.flatten(spark.createDataFrame([("u", bytearray(xml.encode()))], "path string, content binary"))


def test_emitters(spark):
    n = nodes(spark)
    assert sorted(r.value for r in emit.signatures(n).collect()) == ["/p/a.c\tfn\tmain\t0\t\tint", "/p/k.h\tm\t_ZN1K3getEv\t2\tint\tchar *\tint"]
    got = {r.id: (r.address, r.name, r["class"], r.container, r.parent, r.size) for r in emit.static_variables(n).collect()}
    assert got == {
        "v1": ("0x10", "_ZN1K1nE", "CLASSSTATIC", "K", "c", "4"), "v2": ("0x20", "once", "FUNCSTATIC", "_ZN1K3getEv", "m", "8"), "v3": ("0x30", "x", "STRUCTSTATIC", "S", "None", "0"),
        "v4": ("0x40", "y", "GLOBAL", None, "None", "0"), "v5": ("0x50", "g", "STATIC", None, "None", "0"),
    }
    assert {r.id: r.address for r in emit.static_variables(n, True).collect()}["v7"] == "-1"
    assert sorted(map(tuple, emit.local_variables(n).collect())) == [("/p/a.c", "main", "0x8", "buf", "l", "char [4]", "0", "None"), ("/p/k.h", "_ZN1K3getEv", "0x14", "i", "p1", "int", "4", "m")]
    one = emit.lines(emit.static_variables(n).filter("id = 'v5'")).first().value
    assert one == "0x50\tg\tv5\tint\t0\tNone\tSTATIC"
    parts = [spark.createDataFrame([("# A\tB",), (f"{i}\tx",)], "value string") for i in range(2)]
    assert [r.value for r in emit.merged(parts, "# A\tB").orderBy(F.desc("first"), "value").collect()] == ["# A\tB", "0\tx", "1\tx"]
    dots = spark.createDataFrame([("g", 2, '"b"->"c"'), ("g", 1, '"a"->"b"')], "key string, nth int, line string")
    assert emit.viewer(dots, "key", "line", "nth").first().value == 'digraph {"a"->"b"; "b"->"c"; }'


def test_trace_documents(spark):
    xml = '<DYNAMICTRACE INP="in &lt;1&gt;" RUNID="0_1" EXE="e"><IO FUNCNAME="f" INVNO="1" SYNCS="1" THREADID="0"><NONLOCALREAD TS="0_1_3" VARNAME="c"><POSIXLOCK ADDRESS="0x6" TYPE="MUTEX"/></NONLOCALREAD><LOCALACCESS FIRSTREAD="0_1_4" VARNAME="i"/></IO><CALL ARGS="a &quot;b&quot; &amp; c" TS="0_1_5"/></DYNAMICTRACE>'
    first = runs.records(nodes(spark, xml))
    again = runs.records(syntax.flatten(emit.trace_documents(first).select(F.col("unit").alias("path"), F.col("value").cast("binary").alias("content"))))
    plain = lambda df: [(r.run, r.input, r.rectype, r.seq, r.func, r.attrs, [tuple(x) for x in r.locks]) for r in df.orderBy("nth").collect()]
    assert plain(again) == plain(first) and len(plain(first)) == 4


def test_programs(spark):
    edges = spark.createDataFrame([("/b/app", "/b/a.o"), ("/b/lib.so", "/b/a.o"), ("/b/.hid", "x"), ("/b.d/tool", "y")], "src string, dst string")
    assert sorted(r.path for r in programs.executables(edges).collect()) == ["/b.d/tool", "/b/.hid", "/b/app"]
    assert ("EXEC_START#0", "main#0") in set(map(tuple, programs.with_start(edges, "main#0").collect()))
    facts = spark.createDataFrame([("a", "ref_usr", "b"), ("a", "type", "int")], "s string, p string, o string")
    assert set(map(tuple, programs.inverse(facts, {"ref_usr": "referenced_id"}).collect())) == {("a", "ref_usr", "b"), ("a", "type", "int"), ("b", "referenced_id", "a")}
    files = spark.createDataFrame([(1, "/p/a.h"), (2, "/q/a.h"), (2, "b.h"), (1, "/r/a.h")], "unit int, file string")
    assert sorted((r.unit, r.file, r.known_as) for r in programs.seen_before(files, "unit", "file").collect()) == [(1, "/p/a.h", "a.h"), (1, "/r/a.h", "a.h"), (2, "/q/a.h", "a.h_1"), (2, "b.h", "b.h")]
    n = nodes(spark)
    assert {r.linkage_name: (r.file, tuple(r.begin), tuple(r.end)) for r in programs.extents(n).collect()} == {"main": ("/p/a.c", (1, 1), (2, 2)), "_ZN1K3getEv": ("/p/k.h", (3, 1), (9, 2))}
    words = programs.vocabulary(spark.createDataFrame([("Get,Access",), ("get,Access",), ("mutex",), ("",)], "value string"))
    assert sorted(map(tuple, words.collect())) == [("get", "Access"), ("mutex", "")]
    ids = {r.symbol: (r.kind, r.begin, r.end, r.domains) for r in programs.identifiers(n, words).collect()}
    assert ids == {"get": ("CXXMethod", 3, 9, ["get : Access"]), "main": ("FunctionDecl", 1, 2, [])}
    tokens = spark.createDataFrame([("1", "lock"), ("9", "lock")], "s string, token string")
    spelled = spark.createDataFrame([("1", "main"), ("2", "f"), ("3", "f"), ("4", "g")], "s string, name string")
    calls = spark.createDataFrame([("main", "f"), ("main", "f"), ("f", "g")], "caller_name string, callee_name string")
    assert sorted(map(tuple, programs.callees_by_token(tokens, spelled, calls).collect())) == [("lock", "2"), ("lock", "3")]
    a, b = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"])], "k int, words array<string>"), spark.createDataFrame([(1, ["y"]), (1, ["x", "q"]), (2, [])], "k int, words array<string>")
    assert {r.k: r.words for r in programs.shared_words(a, b, "k").collect()} == {1: ["x", "y"]}


def test_pointer_writes(spark):
    w = spark.createDataFrame([(1, 7, 1, "p"), (1, 7, 4, "q"), (2, 7, 2, "r"), (1, 8, 3, "s")], "thread int, ins int, seq int, name string")
    t = spark.createDataFrame([(1, 7, 2, 99, "x"), (1, 7, 5, 0, None), (2, 7, 3, 5, None), (3, 7, 9, 5, "z")], "thread int, ins int, seq int, value long, pointee string")
    got = sorted((r.thread, r["at"], r.name, r.pointee) for r in programs.pointer_writes(w, t).collect())
    assert got == [(1, 1, "p", "x"), (1, 4, "q", "NULL"), (2, 2, "r", None)]


def test_texts(spark):
    patch = "--- a/src/x.c\n+++ b/src/x.c\n@@ -1 +1 @@\n---  a/y.h\n+++ /dev/null\n-a/z\n"
    df = spark.createDataFrame([(patch, " Alpha-Beta of Search ", "/home/p/proj/src/a.c", "lib/b.c", "http://x/symbol#12", "/usr/include/a.h")], "patch string, concept string, path string, other string, uri string, system string")
    r = df.select(
        programs.changed_files(F.col("patch")).alias("files"), programs.concept_words(F.col("concept"), ["of"]).alias("words"), programs.shortened(F.col("path"), "proj").alias("a"), programs.shortened(F.col("other"), "proj").alias("b"),
        programs.local_name(F.col("uri")).alias("name"), programs.own_code(F.col("path"), ["c", "h"]).alias("own"), programs.own_code(F.col("system"), ["c", "h"]).alias("sys"), programs.own_code(F.lit("/p/c"), ["c", "/p/c"]).alias("bare"),
    ).first()
    assert (r.files, r.words, r.a, r.b, r.name, r.own, r.sys, r.bare) == (["src/x.c", "y.h"], ["alpha", "beta", "search"], "src/a.c", "build/lib/b.c", "12", True, False, False)
