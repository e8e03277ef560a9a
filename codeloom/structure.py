"""Queries on the structure of programs: blocks cut at calls, memory, repeated subtrees, call texts, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import texts
from .functions import mangling, names
from .operators import blocks, memory, programs, ranges, tokens
from .plans import binding, cascade
from .registry import Tables, query
from .sources import comments, emit, lexer, linkage, runs, syntax

# --- blocks: a customer is a function, its orders are blocks, their items are calls ---

_BLOCKS = """o AS (SELECT o_custkey AS func, o_orderkey AS id, lead(o_orderkey) OVER w AS succ, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
  c AS (SELECT o.func, o.id, l_suppkey AS callee, l_partkey AS part, l_linenumber AS line, (row_number() OVER (PARTITION BY o.id ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS piece FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) JOIN o ON l_orderkey = o.id),
  t AS (SELECT id, max(piece) + 1 AS piece, max(line) AS line FROM c GROUP BY id),
  p AS (SELECT func, id, piece, id * 20 + coalesce(lag(line) OVER (PARTITION BY id ORDER BY piece), 0) AS begin_line, id * 20 + line AS end_line, callee, part FROM c
    UNION ALL SELECT o.func, o.id, coalesce(t.piece, 0), o.id * 20 + coalesce(t.line, 0), o.id * 20 + 15, NULL, NULL FROM o LEFT JOIN t ON o.id = t.id)"""


def _place(line: Column, col: int | Column) -> Column:
    return F.struct(line.cast("int").alias("line"), (F.lit(col) if isinstance(col, int) else col).cast("int").alias("col"))


def _pieces(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = t.orders.select("o_custkey", "o_orderkey")
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    before, after = F.lag("o_orderkey").over(w), F.lead("o_orderkey").over(w)
    k = F.col("o_orderkey")
    kind = F.when(F.col("before").isNull(), "ENTRY").when(F.col("next").isNull(), "EXIT").otherwise("BLOCK")
    of = o.select("*", before.alias("before"), after.alias("next")).select(F.col("o_custkey").alias("func"), k.alias("id"), kind.alias("kind"), _place(k * 20, 0).alias("begin"), _place(k * 20 + 15, 0).alias("end"), F.array_compact(F.array("next")).alias("succ"))
    line = F.col("l_orderkey") * 20 + F.col("l_linenumber")
    calls = t.lineitem.join(o, F.col("l_orderkey") == k).select(F.col("o_custkey").alias("func"), F.col("l_suppkey").alias("call"), F.col("l_suppkey").alias("callee"), _place(line, 1).alias("first"), _place(line, F.col("l_partkey") + 2).alias("last"))
    return of, blocks.split_at_calls(of, calls)


@query(f"WITH {_BLOCKS} SELECT func, id, piece::INT AS piece, begin_line::BIGINT AS begin_line, end_line::BIGINT AS end_line, callee FROM p")
def split_blocks(t: Tables) -> DataFrame:
    """Blocks cut where the calls in them end."""
    return _pieces(t)[1].select("func", "id", "piece", F.col("begin.line").cast("long").alias("begin_line"), F.col("end.line").cast("long").alias("end_line"), "callee")


@query(f"""WITH {_BLOCKS}, z AS (SELECT func, id, max(piece) AS piece FROM p GROUP BY ALL), f AS (SELECT o.func, min(o.id) AS entry, max(o.id) AS exit FROM o GROUP BY ALL), e AS (SELECT f.func, f.entry, f.exit, z.piece FROM f JOIN z ON f.exit = z.id)
  SELECT o.func || '#' || o.id || '#' || z.piece AS src, o.func || '#' || o.succ || '#0' AS dst, 'FLOW' AS kind FROM o JOIN z ON o.id = z.id WHERE o.succ IS NOT NULL
  UNION ALL SELECT p.func || '#' || p.id || '#' || p.piece, p.callee || '#' || coalesce(e.entry, 0) || '#0', 'CALL' FROM p LEFT JOIN e ON p.callee = e.func WHERE p.callee IS NOT NULL
  UNION ALL SELECT p.callee || '#' || coalesce(e.exit, 0) || '#' || coalesce(e.piece, 0), p.func || '#' || p.id || '#' || (p.piece + 1), 'RETURN' FROM p LEFT JOIN e ON p.callee = e.func WHERE p.callee IS NOT NULL""")
def interprocedural_edges(t: Tables) -> DataFrame:
    """Flow between blocks, into called functions and back."""
    node = lambda c: F.concat_ws("#", *(F.col(f"{c}.{x}").cast("string") for x in ("func", "id", "piece"))).alias(c)
    return blocks.interprocedural(*_pieces(t)).select(node("src"), node("dst"), "kind")


@query(f"""WITH {_BLOCKS}, m AS (SELECT func, id, end_line, part, min(piece) AS piece FROM p WHERE callee IS NOT NULL GROUP BY ALL),
  u AS (SELECT func, id, end_line, l_suppkey AS name, min(piece) AS piece FROM lineitem JOIN m ON id = l_orderkey AND end_line = l_orderkey * 20 + l_linenumber AND part = l_partkey GROUP BY ALL)
  SELECT l_orderkey * 8 + l_linenumber AS record, func, id, piece FROM lineitem JOIN u ON id = l_orderkey AND end_line = l_orderkey * 20 + l_linenumber AND name = l_suppkey WHERE l_linenumber % 2 = 0
  UNION ALL SELECT l_orderkey * 8 + l_linenumber, f.func, f.id, 0 FROM lineitem JOIN o ON o.id = l_orderkey JOIN o f ON f.func = o.func AND f.k = 1 WHERE l_linenumber % 2 = 1""")
def block_of_record(t: Tables) -> DataFrame:
    """Records of a trace by the block that they were made in; those that the text does not show go to the function's first."""
    of, pieces = _pieces(t)
    line = F.col("l_orderkey") * 20 + F.col("l_linenumber")
    items = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    uses = items.select(F.col("o_custkey").alias("func"), F.col("l_suppkey").alias("name"), line.alias("line"), _place(line, F.col("l_partkey") + 2).alias("at"))
    name = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).otherwise(F.lit(-1))
    records = items.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("record"), F.col("o_custkey").alias("func"), name.alias("name"), line.alias("line"))
    return blocks.attributed(records, uses, pieces)


# --- memory ------------------------------------------------------------------

@query("""WITH g AS (SELECT p_partkey * 64 AS base, p_name AS name, nullif(p_size % 8, 0) AS n FROM part), l AS (SELECT 'f' || s_nationkey AS func, 8 * (1 + s_suppkey % 40) AS off, max(s_name) AS name, nullif(max(s_suppkey % 3), 0) AS n FROM supplier GROUP BY ALL),
  f AS (SELECT 'f' || c_nationkey AS func, 100000000 + c_custkey * 200 AS rbp FROM customer), h AS (SELECT 1000000000 + o_orderkey * 100 AS base, 'h' || o_orderkey AS name, nullif(o_custkey % 120, 0) AS n FROM orders),
  e AS (SELECT event_id AS id, user_id AS u, floor(value)::BIGINT % 97 AS q FROM events),
  a AS (SELECT e.id, f.func, f.rbp, CASE e.id % 4 WHEN 0 THEN u * 64 + q WHEN 1 THEN f.rbp - q * 4 WHEN 2 THEN 100000000 + (e.id % 150) * 200 - q * 3 ELSE 1000000000 + e.id * 100 + q END AS adr FROM e JOIN f ON f.rbp = 100000000 + u * 200),
  x AS (SELECT a.*, a.rbp - a.adr AS dist, g.base AS gb, g.name AS gn, g.n AS gk FROM a ASOF LEFT JOIN g ON a.adr >= g.base), y AS (SELECT x.*, l.off AS lo, l.name AS ln, l.n AS lk FROM x ASOF LEFT JOIN l ON x.func = l.func AND x.dist <= l.off),
  z AS (SELECT y.*, f.func AS fn, f.rbp - y.adr AS ooff FROM y ASOF LEFT JOIN f ON y.adr < f.rbp), u AS (SELECT z.*, l.off AS oo, l.name AS nm, l.n AS ok FROM z ASOF LEFT JOIN l ON z.fn = l.func AND z.ooff <= l.off), v AS (SELECT u.*, h.base AS hb, h.name AS hn, h.n AS hk FROM u ASOF LEFT JOIN h ON u.adr >= h.base),
  w AS (SELECT *, CASE WHEN adr - gb < 8 * coalesce(gk, 1) THEN 'GLOBAL' WHEN lo - dist < 4 * coalesce(lk, 1) THEN 'LOCAL' WHEN oo - ooff < 4 * coalesce(ok, 1) THEN 'NONLOCALSTACK' WHEN adr - hb < coalesce(hk, 1) THEN 'HEAP' END AS class FROM v)
  SELECT id, class, CASE class WHEN 'GLOBAL' THEN gn WHEN 'LOCAL' THEN ln WHEN 'NONLOCALSTACK' THEN nm WHEN 'HEAP' THEN hn END AS name, CASE class WHEN 'LOCAL' THEN func WHEN 'NONLOCALSTACK' THEN fn END AS owner,
  (CASE class WHEN 'GLOBAL' THEN CASE WHEN gk > 0 THEN (adr - gb) // 8 END WHEN 'LOCAL' THEN CASE WHEN lk > 0 THEN (lo - dist) // 4 END WHEN 'NONLOCALSTACK' THEN CASE WHEN ok > 0 THEN (oo - ooff) // 4 END WHEN 'HEAP' THEN CASE WHEN hk > 0 THEN adr - hb END END)::BIGINT AS position FROM w""")
def cascade_lookup(t: Tables) -> DataFrame:
    """The variable of each address: globals, the own frame, other frames, the heap."""
    some = lambda x: F.when(x != 0, x)
    globals_ = t.part.select(F.col("p_name").alias("name"), (F.col("p_partkey") * 64).alias("base"), F.lit(8).alias("size"), some(F.col("p_size") % 8).alias("n"))
    locals_ = t.supplier.groupBy(F.concat(F.lit("f"), "s_nationkey").alias("func"), (8 * (1 + F.col("s_suppkey") % 40)).alias("offset")).agg(F.max("s_name").alias("name"), F.lit(4).alias("size"), some(F.max(F.col("s_suppkey") % 3)).alias("n"))
    frames = t.customer.select(F.concat(F.lit("f"), "c_nationkey").alias("func"), (100_000_000 + F.col("c_custkey") * 200).alias("rbp"))
    heap = t.orders.select(F.concat(F.lit("h"), "o_orderkey").alias("name"), (1_000_000_000 + F.col("o_orderkey") * 100).alias("base"), F.lit(1).alias("size"), some(F.col("o_custkey") % 120).alias("n"))
    e = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("u"), (F.floor("value") % 97).alias("q"), (100_000_000 + F.col("user_id") * 200).alias("rbp"))
    k, q, n = F.col("id"), F.col("q"), F.col("id") % 4
    at = F.when(n == 0, F.col("u") * 64 + q).when(n == 1, F.col("rbp") - q * 4).when(n == 2, 100_000_000 + k % 150 * 200 - q * 3).otherwise(1_000_000_000 + k * 100 + q)
    accesses = e.join(frames, "rbp").select("id", at.alias("at"), "func", "rbp")
    return memory.locate(accesses, globals_, locals_, frames, heap)


# --- texts -------------------------------------------------------------------

@query("""WITH v AS (SELECT l_orderkey AS k, 'l' || l_orderkey || '_' || l_linenumber AS id, row_number() OVER (PARTITION BY l_partkey % 40 ORDER BY l_orderkey, l_linenumber) = 1 AS fresh FROM lineitem), f AS (SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) = 1 AS fresh FROM orders)
  SELECT 'VarDecl' AS tag, id FROM v WHERE fresh UNION ALL SELECT 'FunctionDecl', 'o' || k FROM f WHERE fresh OR k IN (SELECT k FROM v WHERE fresh) UNION ALL SELECT 'TU', NULL FROM orders""")
def pruned_trees(t: Tables) -> DataFrame:
    """Syntax trees without the subtrees that were there before."""
    item = F.format_string('<VarDecl id="l%d_%d" spelling="v%d"/>', "l_orderkey", "l_linenumber", F.col("l_partkey") % 40)
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("x")))), lambda x: x["x"]), "").alias("items"))
    xml = F.format_string('<TU><FunctionDecl id="o%d" spelling="f%d">%s</FunctionDecl></TU>', "o_orderkey", F.col("o_custkey") % 50, F.coalesce("items", F.lit("")))
    files = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.format_string("%012d", "o_orderkey").alias("path"), xml.cast("binary").alias("content"))
    return syntax.pruned(syntax.flatten(files)).select("tag", syntax.attribute("id").alias("id"))


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, 't' || l_partkey AS token FROM lineitem), c AS (SELECT o_orderkey AS call, o_custkey % 3 AS low, o_custkey % 3 + 1 + o_custkey % 4 AS high FROM orders)
  SELECT call, 'outer' AS kind, coalesce(string_agg(token, ' ' ORDER BY l_linenumber, token), '') AS text FROM c LEFT JOIN k ON l_orderkey = call GROUP BY call
  UNION ALL SELECT call, 'inner', coalesce(string_agg(token, ' ' ORDER BY l_linenumber, token), '') FROM c LEFT JOIN k ON l_orderkey = call AND l_linenumber >= low AND l_linenumber < high GROUP BY call""")
def call_texts(t: Tables) -> DataFrame:
    """The text of call expressions from the tokens in their ranges, of nested ones each its own."""
    line = F.col("l_orderkey") % 1000 * 10 + F.col("l_linenumber")
    tokens = t.lineitem.select(F.floor(F.col("l_orderkey") / 1000).alias("file"), _place(line, 5).alias("at"), F.concat(F.lit("t"), "l_partkey").alias("token"))
    k = F.col("o_orderkey") % 1000 * 10
    low = F.col("o_custkey") % 3
    spans = F.array(F.struct(F.lit("outer").alias("kind"), _place(k, 0).alias("first"), _place(k + 9, 99).alias("last")), F.struct(F.lit("inner").alias("kind"), _place(k + low, 0).alias("first"), _place(k + low + 1 + F.col("o_custkey") % 4, 0).alias("last")))
    calls = t.orders.select(F.floor(F.col("o_orderkey") / 1000).alias("file"), F.col("o_orderkey"), F.explode(spans).alias("x")).select("file", F.struct("o_orderkey", "x.kind").alias("id"), "x.first", "x.last")
    return ranges.texts_of(tokens, calls).select(F.col("id.o_orderkey").alias("call"), "id.kind", "text")


_SOURCE = """// about %d
#include <x>
int a; // beside %d
// one
// two

void f()
{
  s = "}"; /* } */
  // inner
  x%d;
  // later
  y;
}
// tail
"""


def _sources(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(F.concat(F.lit("p"), k).alias("path"), F.format_string(_SOURCE, k, k, k).alias("value"))


@query("""SELECT 'p' || p_partkey AS path, unnest(range(8))::INT AS nth, unnest([1, 3, 4, 4, 9, 10, 12, 16])::INT AS begin, unnest([16, 3, 14, 14, 9, 11, 14, 16])::INT AS "end", unnest(['include', 'inline', 'block', 'block', 'inline', 'next', 'next', 'end']) AS rule FROM part""")
def scope_rules(t: Tables) -> DataFrame:
    """What comments are about: code beside them, the whole file, the block behind them, or what comes up to the next one."""
    of = _sources(t)
    return lexer.scopes(lexer.code(lexer.lines(of)), comments.extract(of)).select("path", "nth", F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end"), "rule")


@query("""SELECT 'p' || p_partkey AS path, chr(10) || '#include <x>' || chr(10) || 'int a; ' || repeat(chr(10), 4) || 'void f()' || chr(10) || '{' || chr(10) || '  s = "}"; ' || chr(10) || '  ' || chr(10) || '  x' || p_partkey || ';' || chr(10) || '  ' || chr(10) || '  y;' || chr(10) || '}' || chr(10) || chr(10) AS value FROM part""")
def comment_free(t: Tables) -> DataFrame:
    """Program texts without their comments; what looks like one in a string stays."""
    return lexer.without_comments(_sources(t))


# --- words -------------------------------------------------------------------

@query("""SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN '_ZN' || length('C' || p_partkey) || 'C' || p_partkey || 'C2Ev' WHEN 1 THEN '_ZN' || length('C' || p_partkey) || 'C' || p_partkey || 'D0Ev' ELSE '_ZNK' || length('C' || p_partkey) || 'C' || p_partkey || '3getERKS_i' END AS name,
  'C' || p_partkey || '::' || CASE p_size % 3 WHEN 0 THEN 'C' || p_partkey || '()' WHEN 1 THEN '~C' || p_partkey || '()' ELSE 'get(C' || p_partkey || ' const&, int) const' END AS demangled, p_size % 3 = 1 AS destructor FROM part""")
def demangled_names(t: Tables) -> DataFrame:
    """Constructors, destructors and methods by their names in the program text."""
    own = F.concat(F.lit("C"), "p_partkey")
    kind, inner = F.col("p_size") % 3, F.concat(F.length(own).cast("string"), own)
    name = F.when(kind == 0, F.concat(F.lit("_ZN"), inner, F.lit("C2Ev"))).when(kind == 1, F.concat(F.lit("_ZN"), inner, F.lit("D0Ev"))).otherwise(F.concat(F.lit("_ZNK"), inner, F.lit("3getERKS_i")))
    got = mangling.with_demangled(t.part.select(F.col("p_partkey").alias("k"), name.alias("name")), "name")
    return got.withColumn("destructor", mangling.is_destructor("demangled"))


@query("""WITH w AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS token FROM part), jj AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS word FROM part)
  SELECT DISTINCT id, token FROM w WHERE token NOT IN (SELECT word FROM jj) AND length(token) > 2 UNION SELECT p_partkey, unnest(['well', 'made']) FROM part""")
def comment_token_filter(t: Tables) -> DataFrame:
    """Words of comments without function words, numbers, known phrases and adjectives; hyphenated adjectives by their parts."""
    spark = t.part.sparkSession
    notes = t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("The "), "p_name", F.lit(" of a well-made list, Region 42 ab")).alias("text"))
    adjectives = t.part.select(F.split("p_name", " ")[0].alias("word")).distinct().withColumn("tag", F.lit("JJ"))
    lexicon = adjectives.unionByName(spark.createDataFrame([("well-made", "JJ"), ("made", "VBN")], "word string, tag string"))
    known = t.region.select(F.concat(F.lit("region "), "r_name").alias("phrase"))
    return tokens.comment_tokens(notes, "id", "text", known, spark.createDataFrame([("the",), ("of",)], "word string"), lexicon)


@query()
def question_cascade(t: Tables) -> DataFrame:
    """Questions bound to phrases, beginnings of tokens and similar tokens, with the conflicts of kinds (no SQL: stems are beyond it)."""
    words = F.split("p_name", " ")
    questions = t.part.select(F.col("p_partkey").alias("q"), F.concat(F.lit("which "), "p_name", F.lit(" holds "), F.lower("p_brand")).alias("text"))
    first, second = t.part.select(words[0].alias("token")).distinct(), t.part.select(words[1].alias("token")).distinct()
    dictionary = t.part.select(F.lower("p_brand").alias("phrase")).distinct().withColumn("kind", F.lit("values")).unionByName(t.part.filter("p_size = 1").select(F.col("p_name").alias("phrase")).distinct().withColumn("kind", F.lit("symbol")))
    name_tokens = second.select(F.concat("token", F.lit("Table")).alias("token"))
    likes = lambda df: df.select("token", F.concat(F.lit("hold"), "token").alias("similar"), (F.length("token") / 10).alias("score"))
    return cascade.bind(questions, ["q"], dictionary, name_tokens, first, likes(name_tokens), likes(first))


@query("""SELECT 'p' || p_partkey AS path, unnest(['// one ' || p_partkey || chr(10) || '// two', '/* three' || chr(10) || ' lines */', '// four']) AS text, unnest([1, 4, 5])::INT AS first, unnest([2, 5, 5])::INT AS last FROM part""")
def bundled_comments(t: Tables) -> DataFrame:
    """Line comments on lines that follow each other as one."""
    text = F.format_string("// one %d\n// two\n\n/* three\n lines */ int a; // four\n", "p_partkey")
    got = comments.bundled(comments.extract(t.part.select(F.concat(F.lit("p"), "p_partkey").alias("path"), text.alias("value"))))
    return got.select("path", "text", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN '0x' || lower(hex(s_nationkey + 16)) ELSE '0x' || lower(hex(s_suppkey)) END AS address FROM supplier""")
def filled_addresses(t: Tables) -> DataFrame:
    """Addresses that a table leaves open, taken from the table of symbols by name."""
    line = F.concat_ws("\t", F.when(F.col("s_suppkey") % 3 == 0, "-1").otherwise(F.format_string("0x%x", "s_suppkey")), F.format_string("n%d", "s_nationkey"), F.col("s_suppkey").cast("string"))
    known = t.nation.select(F.format_string("n%d", "n_nationkey").alias("varname"), F.format_string("0x%x", F.col("n_nationkey") + 16).alias("address"))
    got = linkage.filled(linkage.parse(t.supplier.select(line.alias("value")), "address"), known)
    return got.select(F.col("varid").cast("long").alias("id"), "address")


@query("""SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber AS line, l_partkey::INT AS col FROM lineitem""")
def positions(t: Tables) -> DataFrame:
    """Places in text as line and column."""
    at = names.position(F.format_string("[%d:%d]", "l_linenumber", "l_partkey"))
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), at["line"].alias("line"), at["col"].alias("col"))


@query("""SELECT p_partkey AS k, lower(p_name) AS words FROM part""")
def question_words(t: Tables) -> DataFrame:
    """Words of questions without punctuation and stop words."""
    text = F.concat(F.lit("What is the ("), "p_name", F.lit(") of a ?"))
    return t.part.select(F.col("p_partkey").alias("k"), F.array_join(binding.words(text, ["what", "is", "the", "of"]), " ").alias("words"))



# --- writers -----------------------------------------------------------------

@query(texts.TRACE_XML)
def trace_documents(t: Tables) -> DataFrame:
    """Compacted traces written as XML and read again."""
    made = emit.trace_documents(texts.trace_records(t))
    return texts.told(runs.records(syntax.flatten(made.select(F.col("unit").alias("path"), F.col("value").cast("binary").alias("content")))))


def _declared(t: Tables) -> DataFrame:
    """A class a part: a member, a variable of a method, one outside, one of an earlier address, and a local."""
    k = F.col("p_partkey")
    xml = F.format_string(
        '<TU><ClassDecl id="c%d" spelling="K%d"><VarDecl id="v%d" spelling="n" address="0x1%d" type="int"/><CXXMethod id="m%d" spelling="get" linkage_name="get%d" funcargs="int,char" return_type="int" file="/p/k.h" isDef="1" range.start="[%d:1]" range.end="[99:2]">'
        '<VarDecl id="w%d" spelling="once" address="0x2%d" size="8" type="long"/><ParmDecl id="p%d" spelling="i" offset="0x14" file="/p/k.h" type="int"/></CXXMethod></ClassDecl><VarDecl id="g%d" spelling="g" address="0x3%d" storage_class="STATIC" type="int"/><VarDecl id="late%d" spelling="h" address="0x2%d" type="int"/></TU>',
        *(14 * [k]),
    )
    return syntax.flatten(t.part.select(F.format_string("p%d.xml", k).alias("path"), xml.cast("binary").alias("content")))


@query("""SELECT unnest(['0x1' || p_partkey, '0x2' || p_partkey, '0x3' || p_partkey]) AS address, unnest(['v' || p_partkey, 'w' || p_partkey, 'g' || p_partkey]) AS id, unnest(['CLASSSTATIC', 'FUNCSTATIC', 'STATIC']) AS class, unnest(['K' || p_partkey, 'get', NULL]) AS container FROM part""")
def static_variables(t: Tables) -> DataFrame:
    """Variables at fixed addresses, each address once, with the kind of what they stand in."""
    return emit.static_variables(_declared(t)).select("address", "id", "class", "container")


@query("""SELECT '/p/k.h' || chr(9) || 'get' || p_partkey || chr(9) || '0x14' || chr(9) || 'i' || chr(9) || 'p' || p_partkey || chr(9) || 'int' || chr(9) || '0' || chr(9) || 'None' AS value FROM part""")
def local_variables(t: Tables) -> DataFrame:
    return emit.lines(emit.local_variables(_declared(t)))


@query("""SELECT '/p/k.h' || chr(9) || 'm' || p_partkey || chr(9) || 'get' || p_partkey || chr(9) || '2' || chr(9) || 'int' || chr(9) || 'char' || chr(9) || 'int' AS value, false AS first FROM part UNION ALL SELECT '# FILENAME' || chr(9) || 'FUNCNODEID' || chr(9) || 'FUNCNAME' || chr(9) || 'NARGS' || chr(9) || 'ARGTYPE*' || chr(9) || 'RETTYPE', true""")
def signature_lines(t: Tables) -> DataFrame:
    """Signatures of several units under one header."""
    own = emit.signatures(_declared(t))
    return emit.merged([own, t.region.select(F.lit(emit.SIGNATURES).alias("value"))], emit.SIGNATURES)


@query("""SELECT 'get' || p_partkey AS linkage_name, 'm' || p_partkey AS id, p_partkey::INT AS begin_line, 99 AS end_line FROM part""")
def function_extents(t: Tables) -> DataFrame:
    return programs.extents(_declared(t)).select("linkage_name", "id", F.col("begin.line").alias("begin_line"), F.col("end.line").alias("end_line"))


@query("""SELECT 'm' || p_partkey AS id, 'get' AS symbol, 'CXXMethod' AS kind, p_partkey::INT AS begin, 99 AS "end", 'get : access' AS domains FROM part""")
def identifier_table(t: Tables) -> DataFrame:
    """Names with their lines, words and what these are about."""
    words = programs.vocabulary(t.region.select(F.concat(F.lit("Get,access"), F.lit("")).alias("value")))
    return programs.identifiers(_declared(t), words).select("id", "symbol", "kind", "begin", "end", F.array_join("domains", "|").alias("domains"))


# --- small joins ---------------------------------------------------------------

@query("""SELECT DISTINCT '/w/' || c_mktsegment || (c_custkey % 100) AS path FROM customer WHERE c_custkey % 2 = 0""")
def executable_files(t: Tables) -> DataFrame:
    """What is built and has no extension."""
    built = F.concat(F.lit("/w/"), "c_mktsegment", (F.col("c_custkey") % 100).cast("string"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(".so"))
    return programs.executables(t.customer.select(built.alias("src"), F.col("c_name").alias("dst")))


@query("""SELECT s_suppkey::VARCHAR AS s, 'ref_usr' AS p, s_nationkey::VARCHAR AS o FROM supplier UNION ALL SELECT s_nationkey::VARCHAR, 'referenced_id', s_suppkey::VARCHAR FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, 'spelling', s_name FROM supplier""")
def inverse_facts(t: Tables) -> DataFrame:
    facts = t.supplier.select(F.col("s_suppkey").cast("string").alias("s"), F.lit("ref_usr").alias("p"), F.col("s_nationkey").cast("string").alias("o"))
    named = t.supplier.select(F.col("s_suppkey").cast("string").alias("s"), F.lit("spelling").alias("p"), F.col("s_name").alias("o"))
    return programs.inverse(facts.unionByName(named), {"ref_usr": "referenced_id"})


@query("""SELECT o_orderkey AS unit, 'f' || (o_custkey % 100) || '.h' || CASE WHEN min(o_orderkey) OVER (PARTITION BY o_custkey % 100) < o_orderkey THEN '_1' ELSE '' END AS known_as FROM orders""")
def files_seen_before(t: Tables) -> DataFrame:
    files = t.orders.select(F.col("o_orderkey").alias("unit"), F.format_string("/p/f%d.h", F.col("o_custkey") % 100).alias("file"))
    return programs.seen_before(files, "unit", "file").select("unit", "known_as")


@query("""WITH r AS (SELECT *, 'run_' || (event_id // 200) AS run FROM events) SELECT run, event_id AS seq, (SUM(CASE WHEN event_type IN ('view', 'click') THEN 2 ELSE 1 END) OVER (PARTITION BY run ORDER BY event_id))::BIGINT AS seqno FROM r""")
def numbered_records(t: Tables) -> DataFrame:
    """Records of a trace by their place, blocks ahead of what is in them."""
    return programs.numbered(texts.trace_records(t)).filter("rectype <> 'IO'").select("run", "seq", "seqno")


@query("""SELECT DISTINCT o_orderpriority AS token, s_suppkey AS id FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_nationkey = (c_nationkey + 1) % 25""")
def callees_by_token(t: Tables) -> DataFrame:
    """Functions called by those whose symbols have a comment's token, by names in the trace."""
    own = F.lit(-1) - F.col("c_custkey")
    tokens_ = t.orders.select((F.lit(-1) - F.col("o_custkey")).alias("s"), F.col("o_orderpriority").alias("token"))
    spelled = t.customer.select(own.alias("s"), F.concat(F.lit("n"), "c_nationkey").alias("name")).unionByName(t.supplier.select(F.col("s_suppkey").alias("s"), F.concat(F.lit("f"), "s_nationkey").alias("name")))
    calls = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("caller_name"), F.concat(F.lit("f"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("callee_name"))
    return programs.callees_by_token(tokens_, spelled, calls)


@query("""SELECT o_orderkey AS k, array_to_string(list_sort(list_distinct(list_filter(['w' || (o_custkey % 9), 'w' || (o_orderkey % 9)], lambda x: list_contains(s.words, x)))), '|') AS words FROM orders JOIN (SELECT l_orderkey, list('w' || (l_partkey % 9)) AS words FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey""")
def shared_domain_words(t: Tables) -> DataFrame:
    """Domain words that comments share with the symbols in their scope."""
    word = lambda c: F.concat(F.lit("w"), (F.col(c) % 9).cast("string"))
    said = t.orders.select(F.col("o_orderkey").alias("k"), F.array(word("o_custkey"), word("o_orderkey")).alias("words"))
    got = programs.shared_words(said, t.lineitem.select(F.col("l_orderkey").alias("k"), F.array(word("l_partkey")).alias("words")), "k")
    return got.select("k", F.array_join("words", "|").alias("words"))


@query("""WITH w AS (SELECT * FROM events WHERE event_type = 'click'), v AS (SELECT * FROM events WHERE event_type = 'view') SELECT v.event_id AS seq, w.event_id AS "at", CASE WHEN v.event_id % 3 = 0 THEN 'NULL' ELSE 'v' || v.event_id END AS pointee FROM v ASOF JOIN w ON v.user_id = w.user_id AND v.event_id > w.event_id""")
def pointer_writes(t: Tables) -> DataFrame:
    """Writes through pointers with what they then point at."""
    row = t.events.select("event_type", F.col("user_id").alias("thread"), F.lit(1).alias("ins"), F.col("event_id").alias("seq"))
    writes = row.filter("event_type = 'click'").drop("event_type")
    seen = row.filter("event_type = 'view'").drop("event_type").select("*", (F.col("seq") % 3).alias("value"), F.concat(F.lit("v"), "seq").alias("pointee"))
    return programs.pointer_writes(writes, seen).select("seq", "at", "pointee")


@query("""SELECT p_partkey AS k, p_partkey::VARCHAR AS name, CASE WHEN p_size % 2 = 0 THEN 'src/p' || p_partkey || '.c' ELSE 'build/p' || p_partkey || '.c' END AS short, p_size % 3 <> 0 AS own, 'x' || p_partkey || '.c|y.h' AS changed, replace(lower(p_name), ' ', '|') AS words FROM part""")
def program_paths(t: Tables) -> DataFrame:
    """Names, paths and patches taken apart."""
    k = F.col("p_partkey")
    path = F.when(F.col("p_size") % 2 == 0, F.format_string("/home/me/proj/src/p%d.c", k)).otherwise(F.format_string("p%d.c", k))
    patch = F.format_string("--- a/x%d.c\n+++ b/x%d.c\n@@\n+++ b/y.h\n--- /dev/null", k, k)
    return t.part.select(
        k.alias("k"), programs.local_name(F.format_string("http://x/symbol#%d", k)).alias("name"), programs.shortened(path, "proj").alias("short"), programs.own_code(F.when(F.col("p_size") % 3 == 0, "/usr/lib/a.c").otherwise(path), ["c"]).alias("own"),
        F.array_join(programs.changed_files(patch), "|").alias("changed"), F.array_join(programs.concept_words(F.concat(F.lit(" The "), F.replace("p_name", F.lit(" "), F.lit("-"))), ["the"]), "|").alias("words"),
    )
