"""Queries on readers, writers and scalar functions: texts of each format are made from the driver's tables, parsed, and compared with those tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import names
from .operators import graphs, triples
from .registry import Tables, query
from .sources import build, flow, linkage, runs, sinks, syntax, trace, turtle

BASE = "http://example.org/facts/"


def _joined(values: Column) -> Column:
    return F.array_join(values, "|")


# --- scalar functions --------------------------------------------------------

@query("""SELECT l_orderkey AS k, l_linenumber AS n, 'int' AS ret, 'std::map<int, char>|double[' || l_linenumber || ']' AS params, l_linenumber || '|8' AS sizes,
  CASE l_linenumber % 3 WHEN 0 THEN 'multi_array' WHEN 1 THEN 'pointer' ELSE 'scalar' END AS class, l_partkey AS addr, '0x' || lower(hex(abs(l_linenumber - 40))) AS frame,
  l_orderkey::VARCHAR || lpad(l_suppkey::VARCHAR, 11, '0') AS gid, 'f' || l_partkey || '.c' AS base, 'src/f' || l_partkey || '.c#' || l_linenumber AS place, 'get|Max|Value|' || l_linenumber AS parts FROM lineitem""")
def name_functions(t: Tables) -> DataFrame:
    """Types, addresses, offsets and paths taken apart."""
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    signature = F.format_string("int (std::map<int, char>, double[%d])", n)
    kind = F.when(n % 3 == 0, "int[2][3]").when(n % 3 == 1, "char *").otherwise("long")
    path = F.format_string("/work/src/f%d.c", k)
    return t.lineitem.select(
        F.col("l_orderkey").alias("k"), n.alias("n"), names.return_type(signature).alias("ret"), _joined(names.parameter_types(signature)).alias("params"), _joined(names.array_sizes(F.format_string("int[%d][8]", n))).alias("sizes"), names.type_class(kind).alias("class"),
        names.address(F.format_string("0x%x", k)).alias("addr"), names.frame_offset((n - 56).cast("long")).alias("frame"), names.global_id(F.col("l_orderkey"), F.col("l_suppkey")).alias("gid"),
        names.basename(path).alias("base"), names.last_two(path, n).alias("place"), _joined(names.segment(F.format_string("getMaxValue_%d", n))).alias("parts"),
    )


# --- triples -----------------------------------------------------------------

def _facts(t: Tables) -> DataFrame:
    c = triples.unpivot(t.customer, F.col("c_custkey"), "customer", {"spelling": F.concat(F.lit('a "quoted" \\ name\n'), "c_name"), "is_a": F.col("c_mktsegment")}).withColumn("o_ns", F.lit(None).cast("string"))
    n = triples.unpivot(t.customer, F.col("c_custkey"), "customer", {"lex_parent_id": F.col("c_nationkey")}).withColumn("o_ns", F.lit("nation"))
    return c.unionByName(n)


@query("SELECT c_custkey::VARCHAR s, 'customer' ns, 'spelling' p, 'a \"quoted\" \\ name' || chr(10) || c_name AS o, NULL::VARCHAR AS o_ns FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'customer', 'is_a', c_mktsegment, NULL FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'customer', 'lex_parent_id', c_nationkey::VARCHAR, 'nation' FROM customer")
def turtle_round_trip(t: Tables) -> DataFrame:
    """Facts written as Turtle and read again, links and quoted values included."""
    return turtle.parse(sinks.turtle(_facts(t), BASE), BASE)


@query("SELECT c_custkey::VARCHAR AS s, 'x' || (100 + c_nationkey) || '|x' || (101 + c_nationkey) AS tag FROM customer")
def triples_wide(t: Tables) -> DataFrame:
    """Graphs merged as sets, then one row an entity with the values of a property."""
    tagged = lambda k: triples.unpivot(t.customer, F.col("c_custkey"), "customer", {"tag": F.concat(F.lit("x"), F.col("c_nationkey") + k)})
    both = triples.wide(triples.merge(tagged(100), None, tagged(101), tagged(100)), ["tag"])
    return both.select("s", _joined(F.col("tag")).alias("tag"))


@query("SELECT p_partkey AS id, 'name: ' || p_name || chr(10) || 'size: ' || p_size AS value FROM part")
def answer_text(t: Tables) -> DataFrame:
    """Answers as labelled lines; what is null is left out."""
    rows = t.part.select("p_partkey", "p_name", F.lit(None).cast("string").alias("none"), "p_size")
    text = sinks.answer_column({"p_name": "name", "none": "nothing", "p_size": "size"})
    return rows.select(F.col("p_partkey").alias("id"), text.alias("value"))


@query("SELECT DISTINCT n_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def neighbours(t: Tables) -> DataFrame:
    edges = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    return graphs.neighbours(edges, "ASIA")


# --- traces ------------------------------------------------------------------

@query("""SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'READ' WHEN 'click' THEN 'WRITE' WHEN 'purchase' THEN 'DYNAMICTRACE' ELSE 'CALL' END AS rectype, CASE event_type WHEN 'purchase' THEN NULL ELSE (user_id % 7)::VARCHAR END AS thread, 'run_' || (user_id % 10) AS run,
  CASE WHEN event_type IN ('view', 'click') THEN '-' || (event_id % 64) END AS "offset", CASE event_type WHEN 'click' THEN '0x' || lower(hex(event_id)) || ' MUTEX|0x10 READ' ELSE '' END AS locks, CASE event_type WHEN 'purchase' THEN 'a' || user_id || '|b' ELSE '' END AS inputs,
  CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN '[ ' || event_id || ' f ( & a [ i ] ) ]' END AS static FROM events""")
def trace_dump(t: Tables) -> DataFrame:
    """Records of a run-time dump: all locks that an access holds, the inputs of the header, the expressions of a call."""
    kind = F.when(F.col("event_type") == "view", "READ").when(F.col("event_type") == "click", "WRITE").when(F.col("event_type") == "purchase", "DYNAMICTRACE").otherwise("CALL")
    ts = F.format_string("run_%d_%d", F.col("user_id") % 10, F.col("event_id"))
    access = F.concat(
        F.format_string(" THREADID %d FUNCNAME f INVNO 1 SYNCS ", F.col("user_id") % 7), F.when(kind == "READ", "ASYNC").otherwise(F.format_string("2 ADDRESS 0x%x TYPE MUTEX ADDRESS 0x10 TYPE READ", "event_id")),
        F.lit(" VARNAME x "), F.when(kind == "READ", "VAROFFSET").otherwise("VARCLASS GLOBAL ADDRESS 0x99 OFFSET"), F.format_string(" -%d TS ", F.col("event_id") % 64), ts,
    )
    call = F.concat(F.format_string(" THREADID %d  CALLERNAME g CALLEENAME f STATICCALL [\t%d f ( & a [ i ] )\t] TS ", F.col("user_id") % 7, F.col("event_id")), ts)
    header = F.concat(F.format_string(" INP a%d b RUNID run_%d EXE app TS ", "user_id", F.col("user_id") % 10), ts)
    got = trace.parse(t.events.select(F.concat(kind, F.when(kind.isin("READ", "WRITE"), access).when(kind == "CALL", call).otherwise(header)).alias("value")))
    locks = F.transform("locks", lambda x: F.concat_ws(" ", x["address"], x["type"]))
    return got.select("seq", "rectype", "thread", "run", "offset", _joined(locks).alias("locks"), _joined(F.col("inputs")).alias("inputs"), F.try_element_at("attrs", F.lit("STATICCALL")).alias("static"))


# --- tables, build logs, control flow ----------------------------------------

@query("SELECT coalesce(s_suppkey::VARCHAR, l_partkey::VARCHAR) AS id, l_orderkey + 4096 AS at, 'v' || l_linenumber AS name, l_quantity::INT::VARCHAR AS size FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) ON l_partkey = s_suppkey")
def linkage_table(t: Tables) -> DataFrame:
    """Lines of an address table: parsed, moved by the image's load address, ids remapped."""
    line = F.concat_ws("\t", F.format_string("0x%x", "l_orderkey"), F.format_string("v%d", "l_linenumber"), F.col("l_partkey").cast("string"), F.lit("int"), F.round("l_quantity").cast("int").cast("string"), F.lit("None"), F.lit("scalar"))
    lines = t.lineitem.select(line.alias("value")).unionByName(t.region.select(F.lit("#ADDRESS\tNAME").alias("value")))
    ids = t.supplier.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_suppkey").cast("string").alias("new"))
    got = linkage.relocated(linkage.remapped(linkage.parse(lines, "address"), ids, "varid"), F.lit(4096))
    return got.select(F.col("varid").alias("id"), "at", F.col("varname").alias("name"), F.col("varsize").alias("size"))


@query("SELECT 'f' || o_custkey || '.c' AS filename, o_orderkey::VARCHAR AS funcnodeid, 2 AS nargs, 'int|char *' AS argtypes, o_orderpriority AS rettype FROM orders")
def linkage_signatures(t: Tables) -> DataFrame:
    line = F.concat_ws("\t", F.format_string("f%d.c", "o_custkey"), F.col("o_orderkey").cast("string"), F.lit("func"), F.lit("2"), F.lit("int"), F.lit("char *"), F.col("o_orderpriority"))
    return linkage.parse_signatures(t.orders.select(line.alias("value"))).drop("funcname").withColumn("argtypes", _joined(F.col("argtypes")))


@query("SELECT DISTINCT '/w/d' || (o_custkey % 50) || '/m' || o_orderkey || '.o' AS src, '/w/d' || (o_custkey % 50) || '/m' || o_orderkey || '.c' AS dst, 'OBJ' AS kind FROM orders UNION ALL SELECT '/w/lib' || o_orderkey || '.a', '/w/d' || (o_custkey % 50) || '/m' || o_orderkey || '.o', 'AR' FROM orders WHERE o_orderkey % 3 = 0")
def build_edges(t: Tables) -> DataFrame:
    """Edges of a build log's compiler and archiver calls, with paths taken from the directory that is current."""
    o = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 50).alias("d"))
    calls = F.array(
        F.format_string("make: Entering directory '/w/d%d'", "d"), F.format_string("gcc -O2 -c ./x/../m%d.c -o m%d.o", "k", "k"),
        F.when(F.col("k") % 3 == 0, F.format_string("ar rcs ../lib%d.a m%d.o", "k", "k")),
    )
    lines = o.select(F.col("k").alias("log"), F.posexplode(calls).alias("line", "value")).filter("value is not null")
    return build.edges(build.commands(lines))


_FLOW = "SELECT 'f' || n_nationkey AS func, k::INTEGER AS src, (k + 1)::INTEGER AS dst FROM nation, unnest(range(3)) r(k)"


def _flow(t: Tables) -> DataFrame:
    key = F.col("n_nationkey")
    body = F.concat(F.format_string("-----\nf%d a.c\n4\n0 ENTRY [] [1]\n1 [%d,1,%d,9] [0] [2]\n2 [7,1,7,5] [1] [3]\n3 EXIT [2] []\n-----\n1\nf%d: [g,", key, key + 1, key + 2, key), F.concat(F.lit("h"), key.cast("string")), F.lit(",]\n"))
    return t.nation.select(F.format_string("u%d", key).alias("path"), body.alias("value"))


@query(_FLOW)
def flow_edges(t: Tables) -> DataFrame:
    """Edges between the blocks of control-flow text."""
    return flow.edges(flow.blocks(flow.sections(_flow(t), "-----")))


@query("SELECT 'f' || n_nationkey AS caller, c AS callee FROM nation, unnest(['g', 'h' || n_nationkey]) u(c)")
def flow_calls(t: Tables) -> DataFrame:
    return flow.calls(flow.sections(_flow(t), "-----"))


# --- syntax trees ------------------------------------------------------------

def _nodes(t: Tables) -> DataFrame:
    """A tree a nation: a class with a base, a static member and an assignment."""
    k = F.col("n_nationkey")
    xml = F.format_string(
        '<TranslationUnit><ClassDecl id="c%d" spelling="%s" isDecl="1" isDef="1" file="/p/n%d.h" line="%d"><CXXBaseClassSpecifier ref_id="c%d"/><CXXBaseClassSpecifier ref_id="z"/>'
        '<VarDecl id="v%d" spelling="x" isDecl="1" storage_class="extern" file="n%d.h" line="2"/></ClassDecl>'
        '<BinaryOperator><DeclRefExpr id="a%d" spelling="x" ref_id="v%d" file="/q/p/n%d.c" line="5"/><DeclRefExpr id="b%d" spelling="y" ref_id="w" file="/q/p/n%d.c" line="5"/></BinaryOperator></TranslationUnit>',
        k, F.col("n_name"), k, k + 1, F.col("n_regionkey"), k, k, k, k, k, k, k,
    )
    return syntax.flatten(t.nation.select(F.format_string("n%d.xml", k).alias("path"), xml.cast("binary").alias("content")))


@query("SELECT 'n' || n_nationkey || '.xml' AS unit, unnest(['TranslationUnit', 'ClassDecl', 'CXXBaseClassSpecifier', 'CXXBaseClassSpecifier', 'VarDecl', 'BinaryOperator', 'DeclRefExpr', 'DeclRefExpr']) AS tag, unnest(range(8))::INTEGER AS node, unnest([NULL, 0, 1, 1, 1, 0, 5, 5])::INTEGER AS up FROM nation")
def syntax_nodes(t: Tables) -> DataFrame:
    """Elements of syntax trees as rows, with their parents."""
    return _nodes(t).select("unit", "tag", "node", "up")


@query("SELECT DISTINCT 'c' || n_nationkey AS s, unnest(['is_subclass_of', 'is_subclass_of', 'multiple_inheritance']) AS p, unnest(['c' || n_regionkey, 'z', 'True']) AS o FROM nation UNION ALL SELECT 'v' || n_nationkey, 'is_static', 'True' FROM nation UNION ALL SELECT 'g' || n_nationkey, 'is_friend_of', 'c' || n_nationkey FROM nation")
def syntax_relations(t: Tables) -> DataFrame:
    """Base classes (by what their ids lead to), several of them, static members and friends."""
    from . import shared

    shared.folder(t.nation.sparkSession)
    k = F.col("n_nationkey")
    more = F.format_string(
        '<TU><FriendDecl lex_parent_id="c%d"><Attr id="n"/><FunctionDecl id="g%d" spelling="f"/><TypeRef id="late"/></FriendDecl><TypeRef id="b%d" spelling="B" ref_id="c%d"/><ClassDecl id="c%d" spelling="C" isDecl="1" isDef="1"><CXXBaseClassSpecifier id="i" ref_id="b%d"/></ClassDecl></TU>',
        k, k, k, F.col("n_regionkey"), k, k,
    )
    other = syntax.flatten(t.nation.select(F.format_string("m%d.xml", k).alias("path"), more.cast("binary").alias("content")))
    nodes = _nodes(t).unionByName(other)
    return syntax.resolved(syntax.relations(nodes), graphs.fixpoint(syntax.canonical(nodes)))


@query("SELECT 'v' || n_nationkey AS s, 'has_parent' AS p, 'c' || n_nationkey AS o FROM nation UNION ALL SELECT 'c' || n_nationkey, 'has_child', 'v' || n_nationkey FROM nation")
def syntax_family(t: Tables) -> DataFrame:
    return syntax.family(_nodes(t))


@query("""SELECT 'c' || n_nationkey AS s, unnest(['is_defined_file', 'isDecl_file_line', 'isDef_file_line']) AS p, unnest(['n' || n_nationkey || '.h', 'p/n' || n_nationkey || '.h#' || (n_nationkey + 1), 'p/n' || n_nationkey || '.h#' || (n_nationkey + 1)]) AS o FROM nation
  UNION ALL SELECT 'v' || n_nationkey, 'is_extern_file', 'n' || n_nationkey || '.h' FROM nation
  UNION ALL SELECT x || n_nationkey, unnest(['is_called_file', 'isUse_file_line']), unnest(['n' || n_nationkey || '.c', 'p/n' || n_nationkey || '.c#5']) FROM nation, unnest(['a', 'b']) u(x)""")
def syntax_places(t: Tables) -> DataFrame:
    """Where symbols are declared, defined and used."""
    return syntax.places(_nodes(t))


@query("SELECT 'v' || n_nationkey AS s, 'isWritten_file_line' AS p, 'p/n' || n_nationkey || '.c#5' AS o FROM nation UNION ALL SELECT 'w', 'isRead_file_line', 'p/n' || n_nationkey || '.c#5' FROM nation")
def syntax_operands(t: Tables) -> DataFrame:
    return syntax.operands(_nodes(t))


@query("SELECT x || n_nationkey AS id, CASE x WHEN 'a' THEN 'v' || n_nationkey WHEN 'b' THEN 'w' ELSE x || n_nationkey END AS root FROM nation, unnest(['c', 'v', 'a', 'b']) u(x)")
def syntax_canonical(t: Tables) -> DataFrame:
    """Ids of uses chased to what they refer to."""
    from . import shared

    shared.folder(t.nation.sparkSession)
    return graphs.fixpoint(syntax.canonical(_nodes(t)))


def _calls(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    xml = F.format_string(
        '<TU><ClassDecl id="k%d"><CXXBaseClassSpecifier ref_id="k%d"/><CXXConstructor id="new%d"/><CXXDestructor id="end%d"><CompoundStmt><CallExpr ref_id="r%d" def_id="x" line="3"/></CompoundStmt></CXXDestructor></ClassDecl>'
        '<CXXMethod id="f%d"><CompoundStmt><IfStmt><CallExpr def_id="d%d" line="9"/></IfStmt></CompoundStmt></CXXMethod><CallExpr ref_id="loose"/></TU>',
        k, F.col("n_regionkey"), k, k, k, k, k,
    )
    return syntax.flatten(t.nation.select(F.format_string("n%d.xml", k).alias("path"), xml.cast("binary").alias("content")))


@query("SELECT unnest(['end', 'f']) || n_nationkey AS caller, unnest(['r', 'd']) || n_nationkey AS callee, unnest(['3', '9']) AS line FROM nation")
def call_edges(t: Tables) -> DataFrame:
    """Calls with the function around them."""
    from . import shared

    shared.folder(t.nation.sparkSession)
    return syntax.call_edges(_calls(t))


@query("SELECT unnest(['new', 'end']) || n_nationkey AS id, unnest(['constructor', 'destructor']) AS kind, 'k' || n_regionkey AS base FROM nation")
def special_members(t: Tables) -> DataFrame:
    return syntax.special_members(_calls(t))


@query("SELECT 'e' || n_nationkey AS exe, 'run' || n_regionkey || '.txt' AS input, (n_regionkey + 1)::BIGINT AS times FROM nation UNION ALL SELECT 'e' || n_nationkey, 'x', 2 FROM nation UNION ALL SELECT 'g', 'x', 1 FROM nation")
def run_config(t: Tables) -> DataFrame:
    """A run configuration in JSON, one row for each input of each program."""
    got = runs.configurations(_configured(t))
    return got.select("exe", "input", F.col("times").cast("long").alias("times"))


def _configured(t: Tables) -> DataFrame:
    text = F.format_string('{"runs": {"e%d": {"run%d.txt": %d, "x": 2}, "g": {"x": 1}}, "comments": {"project_name": "%s"}, "vcs": {"repo": "r%d", "fresh_fetch": true}}', "n_nationkey", "n_regionkey", F.col("n_regionkey") + 1, F.col("n_name"), "n_nationkey")
    return t.nation.select(text.alias("value"))


@query("SELECT unnest(['comments', 'vcs', 'vcs']) AS section, unnest(['project_name', 'repo', 'fresh_fetch']) AS key, unnest([n_name, 'r' || n_nationkey, 'true']) AS value FROM nation")
def run_settings(t: Tables) -> DataFrame:
    return runs.settings(_configured(t))


TRACE_XML = """SELECT 'run_' || (event_id // 200) AS run, event_id AS seq, CASE event_type WHEN 'view' THEN 'NONLOCALREAD' WHEN 'click' THEN 'LOCALACCESS' ELSE 'CALL' END AS rectype, user_id::VARCHAR AS thread, CASE WHEN event_type IN ('view', 'click') THEN 'f' || (user_id % 5) END AS func,
  CASE event_type WHEN 'view' THEN '0x' || lower(hex(user_id)) || ' MUTEX|0x1 READ' ELSE '' END AS locks, CASE event_type WHEN 'click' THEN '1' END AS writes FROM events"""


@query(TRACE_XML)
def trace_xml(t: Tables) -> DataFrame:
    """Compacted traces in XML: blocks of accesses with the locks held, and the events between them."""
    return told(trace_records(t))


def trace_records(t: Tables) -> DataFrame:
    ts, block = F.format_string("run_%d_%d", F.floor(F.col("event_id") / 200), F.col("event_id")), F.format_string('<IO THREADID="%d" FUNCNAME="f%d" INVNO="1" SYNCS="2">', "user_id", F.col("user_id") % 5)
    item = (
        F.when(F.col("event_type") == "view", F.concat(block, F.format_string('<NONLOCALREAD VARNAME="v" TS="%s"><POSIXLOCK ADDRESS="0x%x" TYPE="MUTEX"/><POSIXLOCK ADDRESS="0x1" TYPE="READ"/></NONLOCALREAD></IO>', ts, "user_id")))
        .when(F.col("event_type") == "click", F.concat(block, F.format_string('<LOCALACCESS VARID="7" VARNAME="x" READCOUNT="0" WRITECOUNT="1" FIRSTREAD="UND" FIRSTWRITE="%s"/></IO>', ts)))
        .otherwise(F.format_string('<CALL THREADID="%d" ARGS="NONE" TS="%s"/>', "user_id", ts))
    )
    # a file of 200 events
    body = t.events.groupBy(F.floor(F.col("event_id") / 200).alias("k")).agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("x")))).alias("items"))
    xml = F.concat(F.format_string('<DYNAMICTRACE INP="[None]" RUNID="run_%d" EXE="app">', "k"), F.array_join(F.transform("items", lambda i: i["x"]), ""), F.lit("</DYNAMICTRACE>"))
    return runs.records(syntax.flatten(body.select(F.format_string("t%d.xml", "k").alias("path"), xml.cast("binary").alias("content"))))


def told(records: DataFrame) -> DataFrame:
    got = records.filter("rectype <> 'IO'")
    return got.select("run", "seq", "rectype", "thread", "func", _joined(F.transform("locks", lambda x: F.concat_ws(" ", x["address"], x["type"]))).alias("locks"), F.try_element_at("attrs", F.lit("WRITECOUNT")).alias("writes"))


def _commented(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    xml = F.format_string(
        '<COMMENTS project_name="p"><COMMENT comment_id="%d" comment_scope_start="%d" comment_scope_end="99" comment_text="about %s" src_file_location="/p/a.c"><SYMBOLS><FunctionDecl id="s%d" spelling="f" type="int ()"/><CallExpr id="main" spelling="g" type=""/></SYMBOLS>'
        '<PROGRAM_DOMAINS><POGRAM_DOMAIN word="include" type=" Operations"/></PROGRAM_DOMAINS><PROBLEM_DOMAINS><PROBLEM_DOMAIN word="threads"/></PROBLEM_DOMAINS></COMMENT><COMMENT comment_id="x%d"><SYMBOLS/><PROBLEM_DOMAINS/></COMMENT></COMMENTS>',
        k, k, F.col("n_name"), F.col("n_regionkey"), k,
    )
    return syntax.flatten(t.nation.select(F.format_string("c%d.xml", k).alias("path"), xml.cast("binary").alias("content")))


@query("SELECT n_nationkey::VARCHAR AS comment, unnest(['s' || n_regionkey, 'main', 's' || n_regionkey, 'main']) AS symbol, unnest(['FunctionDecl', 'CallExpr', 'FunctionDecl', 'CallExpr']) AS kind, unnest(['program', 'program', 'problem', 'problem']) AS domain, unnest(['include', 'include', 'threads', 'threads']) AS word FROM nation")
def comment_xml(t: Tables) -> DataFrame:
    """Comments in XML: the symbols in their scope with each word that they are about."""
    nodes = _commented(t)
    return runs.comment_symbols(nodes).join(runs.comment_domains(nodes), ["unit", "comment"]).select("comment", "symbol", "kind", "domain", "word")


@query("SELECT n_nationkey::VARCHAR AS comment, 'about ' || n_name AS text, n_nationkey AS first, 99 AS last, '/p/a.c' AS file FROM nation UNION ALL SELECT 'x' || n_nationkey, NULL, NULL, NULL, NULL FROM nation")
def comment_texts(t: Tables) -> DataFrame:
    return runs.comments(_commented(t)).select("comment", "text", "first", "last", "file")
