import pytest
from pyspark.sql import functions as F

from codeloom.operators import graphs
from codeloom.sources import build, comments, flow, linkage, runs, sinks, syntax, trace


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text], "value string")


def test_build_log(spark):
    log = ["make[1]: Entering directory `/p/build'", "/usr/bin/c++ -g -c ../src/./a.cpp -o obj/a.o", "cd /p/lib && /usr/bin/ar qc libx.a b.o c.o", "echo done", "g++ obj/a.o ../lib/libx.a -o app -lm"]
    df = spark.createDataFrame([("log", i, x) for i, x in enumerate(log)], "log string, line int, value string")
    calls = build.commands(df).orderBy("line").collect()
    assert [(r.tool, r.target, r.inputs) for r in calls] == [
        ("c++", "/p/build/obj/a.o", ["/p/src/a.cpp"]),
        ("ar", "/p/lib/libx.a", ["/p/lib/b.o", "/p/lib/c.o"]),
        ("g++", "/p/lib/app", ["/p/lib/obj/a.o", "/p/lib/libx.a"]),
    ]
    edges = build.edges(build.commands(df))
    assert {(r.src, r.dst, r.kind) for r in edges.filter("kind = 'AR'").collect()} == {("/p/lib/libx.a", "/p/lib/b.o", "AR"), ("/p/lib/libx.a", "/p/lib/c.o", "AR")}


@pytest.mark.parametrize("path,want", [("/a/../b//c/.", "/b/c"), ("../x", "../x"), ("/../x", "/x"), ("../../x/..", "../.."), ("a/b/../../c", "c"), ("", "")])
def test_normalise(spark, path, want):
    assert spark.range(1).select(build.normalise(F.lit(path))).first()[0] == want


def test_flow(spark):
    text = "SEP\nf /p/a.c\n4\n0 EXIT [1] []\n1 [4,1,4,9] [2] [0]\n2 [] [3] [1]\n3 ENTRY [] [2]\nSEP\n2\n<root>: [f,]\nf: [g,h,]\nSEP\n"
    parts = flow.sections(spark.createDataFrame([("x", text)], "path string, value string"), "SEP")
    rows = {r.id: r for r in flow.blocks(parts).collect()}
    assert sorted(rows) == [0, 1, 2, 3] and rows[0].kind == "EXIT" and rows[3].kind == "ENTRY"
    assert rows[1].range.first.line == 4 and rows[2].range.last.col == 9 and rows[0].range is None
    assert (rows[1].pred, rows[1].succ) == ([2], [0]) and rows[3].succ == [2] and rows[0].pred == [1]
    edges = flow.edges(flow.blocks(parts))
    assert {(r.src, r.dst) for r in edges.collect()} == {(3, 2), (2, 1), (1, 0)}
    start = spark.createDataFrame([(3,)], "root int")
    assert {(r.node, r.level) for r in graphs.closure(edges, start).collect()} == {(3, 0), (2, 1), (1, 2), (0, 3)}
    assert {(r.caller, r.callee) for r in flow.calls(parts).collect()} == {("<root>", "f"), ("f", "g"), ("f", "h")}


def test_linkage(spark):
    off = linkage.parse(lines(spark, ["# FILENAME\tX", "a.c\tmain\tNone\ts\t12\tchar *\t8\t7", "", "a.c\tmain\t0x10\tt\t13\tint"]), "offset").collect()
    assert [(r.offset, r.varname, r.parentid) for r in off] == [(None, "s", "7"), ("0x10", "t", None)]
    sig = linkage.parse_signatures(lines(spark, ["a.h\t5\tf\t2\tint\tchar *\tvoid", "a.h\t6\tg\t0\tint"])).collect()
    assert [(r.nargs, r.argtypes, r.rettype) for r in sig] == [(2, ["int", "char *"], "void"), (0, [], "int")]
    table = linkage.parse(lines(spark, ["-1\tx\t1", "0x10\ty\t2", "-1\tz\t"]), "address")
    known = spark.createDataFrame([("x", "0x20"), ("x", "0x20")], "varname string, address string")
    assert {(r.varname, r.address) for r in linkage.filled(table, known).collect()} == {("x", "0x20"), ("y", "0x10")}
    assert {(r.varname, r["at"]) for r in linkage.relocated(linkage.filled(table, known), F.lit(100)).collect()} == {("x", 132), ("y", 116)}
    ids = spark.createDataFrame([("1", "9")], "id string, new string")
    assert {(r.varname, r.varid) for r in linkage.remapped(table, ids, "varid").collect()} == {("x", "9"), ("y", "2")}


def test_comments(spark):
    text = "int a; // one\n// two\n\n/* three\n   lines */ int b; // x\n"
    df = spark.createDataFrame([("f", text), ("g", "none"), ("h", None)], "path string, value string")
    got = comments.extract(df)
    assert [(r.text, r["first"], r["last"]) for r in got.orderBy("nth").collect()] == [("// one", 1, 1), ("// two", 2, 2), ("/* three\n   lines */", 4, 5), ("// x", 5, 5)]
    runs = comments.bundled(got).orderBy("first", "last").collect()
    assert [(r.text, r["first"], r["last"]) for r in runs] == [("// one\n// two", 1, 2), ("/* three\n   lines */", 4, 5), ("// x", 5, 5)]
    vocabulary = spark.createDataFrame([("three lines", "count")], "word string, kind string")
    assert [(r.word, r.kind) for r in comments.about(got, vocabulary, ["path"]).collect()] == [("three lines", "count")]
    assert comments.without_licences(got.withColumn("text", F.lit("Copyright (c) A"))).count() == 0


def test_syntax(spark):
    xml = b"""<TranslationUnit><ClassDecl id="1" spelling="A" isDecl="True" isDef="True" file="/s/a.h" line="1"><VarDecl id="2" spelling="n" isDecl="True" file="a.h" line="2"/>
    <CXXBaseClassSpecifier id="3" ref_id="8"/><CXXBaseClassSpecifier id="4" ref_id="9"/></ClassDecl>
    <BinaryOperator id="5"><DeclRefExpr id="6" spelling="x" ref_id="20" file="/s/a.c" line="7"/><DeclRefExpr id="7" spelling="y" ref_id="21" file="/s/a.c" line="7"/></BinaryOperator></TranslationUnit>"""
    nodes = syntax.flatten(spark.createDataFrame([("u", bytearray(xml)), ("v", bytearray(xml.replace(b'id="1"', b'id="51"').replace(b'id="2"', b'id="52"')))], "path string, content binary"))
    assert nodes.filter("unit = 'u'").count() == 8
    facts = lambda df: {(r.s, r.p, r.o) for r in df.collect()}
    one = nodes.filter("unit = 'u'")
    assert facts(syntax.relations(one)) == {("2", "is_static", "True"), ("1", "is_subclass_of", "8"), ("1", "is_subclass_of", "9"), ("1", "multiple_inheritance", "True")}
    assert facts(syntax.operands(one)) == {("20", "isWritten_file_line", "s/a.c#7"), ("21", "isRead_file_line", "s/a.c#7")}
    assert {("1", "is_defined_file", "a.h"), ("2", "is_extern_file", "a.h"), ("6", "is_called_file", "a.c"), ("6", "isUse_file_line", "s/a.c#7")} <= facts(syntax.places(one))
    assert not any(s == "2" and "line" in p for s, p, _ in facts(syntax.places(one)))  # a path without a folder
    assert ("2", "has_parent", "1") in facts(syntax.family(one)) and ("1", "has_child", "2") in facts(syntax.family(one))
    assert {(r.id, r.to) for r in syntax.canonical(one).collect()} == {("1", "1"), ("2", None), ("6", "20"), ("7", "21")}
    new = {r.id: r.new for r in syntax.uniform(nodes).collect()}
    assert new["51"] == "1" and new["52"] == "2" and new["6"] == "6"


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("1", "symbol", "spelling", 'a"b\n', None), ("2", "symbol", "has_parent", "1", "symbol"), ("3", "symbol", "type", None, None)], "s string, ns string, p string, o string, o_ns string")
    sinks.write_turtle(t, str(tmp_path / "t"), "http://x/")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ['<http://x/symbol#1> <http://x/properties#spelling> "a\\"b\\n" .', "<http://x/symbol#2> <http://x/properties#has_parent> <http://x/symbol#1> ."]
    sinks.write_triples(t, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("p = 'has_parent'").first().o == "1"
    assert [r.value for r in sinks.answer(spark.createDataFrame([("f", None, "int")], "n string, f string, t string"), {"n": "name", "f": "file", "t": "type"}).collect()] == ["name: f\ntype: int"]


def test_blocks_of_queries(spark, monkeypatch):
    """More queries than one broadcast takes give the same pairs."""
    from codeloom.operators import relevance

    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    q = v.filter("vec_id % 4 = 0")
    want = {(r.query_id, r.id, r.rank) for r in relevance.most_similar(q, v, 3).collect()}
    monkeypatch.setattr(relevance, "QUERIES", 4)
    monkeypatch.setattr(relevance, "BLOCK", 25)
    assert {(r.query_id, r.id, r.rank) for r in relevance.most_similar(q, v, 3).collect()} == want and len(want) == 45


def test_closure_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(66)], "src long, dst long").coalesce(1)
    got = graphs.closure(edges, spark.createDataFrame([(0,)], "root long").coalesce(1)).collect()
    assert sorted((r.node, r.level) for r in got) == [(i, i) for i in range(67)]


DUMP = """DYNAMICTRACE INP in put.txt -v RUNID 0_1 EXE thread
WRITE THREADID 0 FUNCNAME main FUNCNODEID 20 INVNO 1 SYNCS ASYNC VARNAME i VARID 203 VARCLASS LOCAL VAROFFSET 0x14 INSLOC /p/main.cpp:17 TS 0_1_1
CALL THREADID 1  CALLERNAME main CALLEENAME f INVNO 1 ARGS NONE STATICCALL [\t] INSLOC /p/main.cpp:18 TS 0_1_2
CALL THREADID 0 CALLERNAME main CALLEENAME g@plt TS 0_1_3 ARGS NONE STATICCALL [\t103112251204 g ( & ( tid [ i ] ) , ( void * ) ( & a [ i ] ) )\t] INVNO 1
LOCK TID 1 ADDRESS 0x6020c0 TYPE MUTEX TS 0_1_4

READ THREADID 1 VARCLASS GLOBAL ADDRESS 0x6020a0 VARNAME counter VARID 101 FUNCNAME _Z3fPv SYNCS 2 ADDRESS 0x6020c0 TYPE MUTEX TYPE READ ADDRESS 0x6020d0 TS 0_1_5 INVNO 1
READ THREADID 1 VARNAME x SYNCS 1 ADDRESS 0x1 TYPE MUTEX ADDRESS 0x2 TYPE int TS 0_1_6
MALLOC TID 1 BYTES 8 MEMORY 0x77 TS 0_1_7
RETURN THREADID"""


def test_trace_dump(spark):
    rows = trace.parse(lines_of(spark, DUMP)).collect()
    head, write, call, call2, lock, read, odd, malloc, cut = rows
    assert (head.rectype, head.run, head.inputs, head.attrs) == ("DYNAMICTRACE", "0_1", ["in", "put.txt", "-v"], {"INP": "in put.txt -v", "RUNID": "0_1", "EXE": "thread"})
    assert (write.seq, write.thread, write.offset, write.locks, write.attrs["SYNCS"], write.attrs["INSLOC"]) == (1, "0", "0x14", [], "ASYNC", "/p/main.cpp:17")
    assert (call.attrs["STATICCALL"], call.attrs["TS"]) == ("[ ]", "0_1_2")
    assert call2.attrs["STATICCALL"] == "[ 103112251204 g ( & ( tid [ i ] ) , ( void * ) ( & a [ i ] ) ) ]" and call2.attrs["INVNO"] == "1"
    assert (lock.thread, lock.attrs["ADDRESS"], lock.locks) == ("1", "0x6020c0", [])
    assert [tuple(x) for x in read.locks] == [("0x6020c0", "MUTEX"), ("0x6020d0", "READ")] and read.attrs["ADDRESS"] == "0x6020a0" and read.attrs["INVNO"] == "1" and "TYPE" not in read.attrs
    assert [tuple(x) for x in odd.locks] == [("0x1", "MUTEX")] and (odd.attrs["ADDRESS"], odd.attrs["TYPE"], odd.seq) == ("0x2", "int", 6)
    assert malloc.attrs["BYTES"] == "8" and cut.attrs == {"THREADID": ""}


def lines_of(spark, text):
    return lines(spark, text.split("\n")).coalesce(1)


def files(spark, **texts):
    return spark.createDataFrame([(k, bytearray(v.encode())) for k, v in texts.items()], "path string, content binary")


def test_trace_xml(spark):
    xml = """<DYNAMICTRACE INP="[None]" RUNID="0_1" EXE="thread">
   <IO FUNCNAME="main" INVNO="1" SYNCS="ASYNC" THREADID="0">
      <LOCALACCESS VAROFFSET="0x4" READCOUNT="0" VARID="103" VARNAME="i" WRITECOUNT="1" FIRSTREAD="UND" FIRSTWRITE="0_1_7"/>
   </IO>
   <CALL ARGS="NONE" CALLEENAME="f" CALLERNAME="main" INVNO="1" STATICCALL="[ 1 f ( &amp; lock ) ]" THREADID="0" TS="0_1_9"/>
   <IO FUNCNAME="f" INVNO="2" SYNCS="1" THREADID="1">
      <NONLOCALREAD VARNAME="c" TS="0_1_12" THREADID="1"><POSIXLOCK ADDRESS="0x6" TYPE="MUTEX"/></NONLOCALREAD>
   </IO>
   <LOCK TID="1" ADDRESS="0x6" TYPE="MUTEX" TS="0_1_13"/>
</DYNAMICTRACE>"""
    got = runs.records(syntax.flatten(files(spark, a=xml, b="<DYNAMICTRACE/>"))).orderBy("nth").collect()
    assert [(r.rectype, r.seq, r.thread, r.func, r.invno) for r in got] == [
        ("IO", None, "0", "main", 1), ("LOCALACCESS", 7, "0", "main", 1), ("CALL", 9, "0", None, 1), ("IO", None, "1", "f", 2), ("NONLOCALREAD", 12, "1", "f", 2), ("LOCK", 13, "1", None, None),
    ]
    assert {(r.run, r.input, r.exe) for r in got} == {("0_1", "[None]", "thread")}
    assert [[tuple(x) for x in r.locks] for r in got if r.rectype.startswith("NON")] == [[("0x6", "MUTEX")]]
    assert got[1].within == got[0].nth and got[1].attrs["WRITECOUNT"] == "1" and got[1].attrs["SYNCS"] == "ASYNC"


def test_comment_xml(spark):
    xml = """<COMMENTS project_name="S"><COMMENT comment_id="1" comment_scope_end="34" comment_scope_start="15" comment_text="To demonstrate" src_file_location="/p/main.cpp">
      <SYMBOLS><MemberRefExpr id="200" spelling="makeSquare" type="&lt;bound&gt;" /><FunctionDecl id="201" spelling="main" type="int ()" /></SYMBOLS>
      <PROGRAM_DOMAINS><POGRAM_DOMAIN type=" 'Operations" word="include" /></PROGRAM_DOMAINS><PROBLEM_DOMAINS><PROBLEM_DOMAIN word="graph"/></PROBLEM_DOMAINS></COMMENT></COMMENTS>"""
    nodes = syntax.flatten(files(spark, c=xml))
    assert [(r.comment, r.text, r["first"], r["last"], r.file) for r in runs.comments(nodes).collect()] == [("1", "To demonstrate", 15, 34, "/p/main.cpp")]
    assert sorted((r.comment, r.symbol, r.kind, r.spelling, r.type) for r in runs.comment_symbols(nodes).collect()) == [("1", "200", "MemberRefExpr", "makeSquare", "<bound>"), ("1", "201", "FunctionDecl", "main", "int ()")]
    assert sorted((r.comment, r.domain, r.word, r.type) for r in runs.comment_domains(nodes).collect()) == [("1", "problem", "graph", None), ("1", "program", "include", "'Operations")]


def test_run_configuration(spark):
    text = '{"runs": {"/b/pngtest": {"/b/a.png": 1, "/b/b.png": 2}}, "comments": {"project_name": "libpng"}, "vcs": {"fresh_fetch": true}}'
    df = lines(spark, [text, "{}", "no json"])
    assert sorted(map(tuple, runs.configurations(df).collect())) == [("/b/pngtest", "/b/a.png", 1), ("/b/pngtest", "/b/b.png", 2)]
    assert sorted(map(tuple, runs.settings(df).collect())) == [("comments", "project_name", "libpng"), ("vcs", "fresh_fetch", "true")]


def test_members_of_classes(spark):
    xml = """<TU><ClassDecl id="d" spelling="D"><CXXBaseClassSpecifier id="i" spelling="class B" ref_id="r" def_id="b"/><CXXConstructor id="c1" spelling="D"/><CXXDestructor id="d1"><CompoundStmt><CallExpr id="x" def_id="f" line="4"/></CompoundStmt></CXXDestructor>
      <CXXMethod id="m"><CallExpr ref_id="g" line="5"/></CXXMethod></ClassDecl><TypeRef id="r" spelling="B" def_id="b"/><ClassDecl id="b" spelling="B" isDecl="True" isDef="True"/></TU>"""
    nodes = syntax.flatten(files(spark, u=xml))
    assert sorted(map(tuple, syntax.special_members(nodes).collect())) == [("c1", "constructor", "r"), ("d1", "destructor", "r")]
    assert sorted(map(tuple, syntax.call_edges(nodes).collect())) == [("d1", "f", "4"), ("m", "g", "5")]
    roots = graphs.fixpoint(syntax.canonical(nodes))
    assert ("d", "is_subclass_of", "b") in set(map(tuple, syntax.resolved(syntax.relations(nodes), roots).collect()))


def test_small_texts_share_a_batch_of_elements():
    import pyarrow as pa

    texts = pa.RecordBatch.from_pydict({"path": [f"u{k}" for k in range(300)] + ["large"], "content": [b'<a x="1"><b/></a>'] * 300 + [b"<a>" + b"<b/>" * 20_000 + b"</a>"]})
    got = list(syntax._batches(iter([texts])))
    assert [b.num_rows for b in got] == [10_000, 10_000, 601]
    assert got[0].slice(0, 2).to_pylist() == [
        {"unit": "u0", "node": 1, "up": 0, "depth": 1, "tag": "b", "attrs": [], "last": 1, "post": 0}, {"unit": "u0", "node": 0, "up": None, "depth": 0, "tag": "a", "attrs": [("x", "1")], "last": 1, "post": 1},
    ]
