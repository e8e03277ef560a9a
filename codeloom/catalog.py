"""All registered queries on the driver's tables, with their SQL.

Parts, customers and suppliers stand for symbols, nations for files, market
segments for tags, events for trace records (users are threads), documents for
comments, embeddings for token vectors, orders for nodes with a parent pointer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import answers, shared, streams, structure, texts  # noqa: F401  (registers their queries)
from .functions import names
from .operators import attribution, graphs, relevance, triples, windows
from .registry import Tables, oracle_sql, queries, query  # noqa: F401
from .sources import comments

# --- entities and properties -------------------------------------------------

def _facts(t: Tables) -> DataFrame:
    c = triples.unpivot(t.customer, F.col("c_custkey"), "customer", {"spelling": F.col("c_name"), "is_a": F.col("c_mktsegment"), "is_defined_file": F.col("c_nationkey")})
    n = triples.unpivot(t.nation, F.col("n_nationkey"), "nation", {"spelling": F.col("n_name"), "lex_parent_id": F.col("n_regionkey")})
    return c.unionByName(n)


_FACTS_SQL = """WITH facts AS (
  SELECT c_custkey::VARCHAR s, 'customer' ns, 'spelling' p, c_name o FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'customer', 'is_a', c_mktsegment FROM customer
  UNION ALL SELECT c_custkey::VARCHAR, 'customer', 'is_defined_file', c_nationkey::VARCHAR FROM customer
  UNION ALL SELECT n_nationkey::VARCHAR, 'nation', 'spelling', n_name FROM nation UNION ALL SELECT n_nationkey::VARCHAR, 'nation', 'lex_parent_id', n_regionkey::VARCHAR FROM nation) """


@query("SELECT c_custkey AS id, c_name AS spelling, n_name AS file FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def star_lookup(t):
    """Entities with a tag in a file, as in "all functions in file F"."""
    c = t.customer.filter(F.col("c_mktsegment") == "BUILDING")
    return c.join(t.nation, c.c_nationkey == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("spelling"), F.col("n_name").alias("file"))


@query(_FACTS_SQL + "SELECT ns, p, COUNT(*)::BIGINT AS n, COUNT(DISTINCT o)::BIGINT AS kinds FROM facts GROUP BY ns, p")
def triples_unpivot(t):
    return _facts(t).groupBy("ns", "p").agg(F.count("*").alias("n"), F.count_distinct("o").alias("kinds"))


@query(_FACTS_SQL + "SELECT s, ns, p FROM facts WHERE o = '3'")
def any_predicate_value(t):
    return triples.with_value(_facts(t), "3").select("s", "ns", "p")


@query(_FACTS_SQL + "SELECT s FROM facts WHERE p IN ('spelling', 'lex_parent_id') GROUP BY s HAVING COUNT(DISTINCT p) = 2")
def attr_exists(t):
    return triples.having(_facts(t), "spelling", "lex_parent_id")


@query("SELECT n_nationkey AS id, n_name AS spelling FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
def child_names(t):
    symbols = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("spelling"), F.col("n_regionkey").alias("up"))
    return symbols.join(t.region.filter(F.col("r_name") == "ASIA"), F.col("up") == F.col("r_regionkey"), "left_semi").select("id", "spelling")


@query("SELECT o_orderkey AS id, c_name AS parent FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def parent_names(t):
    return t.orders.filter(F.col("o_orderpriority") == "1-URGENT").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("parent"))


@query("SELECT c_name AS func, l_partkey AS var, COUNT(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' GROUP BY c_name, l_partkey")
def three_way(t):
    c = t.customer.filter(F.col("c_mktsegment") == "MACHINERY").select("c_custkey", "c_name")
    o = t.orders.select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return t.lineitem.select("l_orderkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("c_name").alias("func"), F.col("l_partkey").alias("var")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS a, c_custkey AS b FROM supplier JOIN customer ON replace(s_name, 'Supplier', '') = replace(c_name, 'Customer', '')")
def name_value_join(t):
    key = lambda c, w: F.replace(F.col(c), F.lit(w), F.lit(""))
    s = t.supplier.select(F.col("s_suppkey").alias("a"), key("s_name", "Supplier").alias("name"))
    return s.join(t.customer.select(F.col("c_custkey").alias("b"), key("c_name", "Customer").alias("name")), "name").select("a", "b")


@query("SELECT k AS file, COUNT(*)::BIGINT AS n FROM (SELECT c_nationkey k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation) GROUP BY k")
def union3_files(t):
    """Bag union of three relations that name a file."""
    ks = [t.customer.select(F.col("c_nationkey").alias("file")), t.supplier.select(F.col("s_nationkey").alias("file")), t.nation.select(F.col("n_nationkey").alias("file"))]
    return ks[0].unionAll(ks[1]).unionAll(ks[2]).groupBy("file").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, COUNT(*) OVER (PARTITION BY p_brand, p_type, p_size) - 1 AS siblings FROM part QUALIFY siblings > 0")
def overload_groups(t):
    """Symbols that share name and scope, with the number of their siblings (pairs stay implicit)."""
    key = ["p_brand", "p_type", "p_size"]
    groups = t.part.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    return t.part.join(groups, key).select(F.col("p_partkey").alias("id"), (F.col("n") - 1).alias("siblings"))


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'NO SUCH' UNION ALL SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'NO SUCH')")
def type_fallback(t):
    """Entities with a value; only where none has it, those with another."""
    first = t.customer.filter(F.col("c_mktsegment") == "NO SUCH").select(F.col("c_custkey").alias("id"))
    second = t.customer.filter(F.col("c_nationkey") == 7).select(F.col("c_custkey").alias("id"))
    found = first.select(F.lit(1).alias("one")).limit(1)
    return first.unionByName(second.join(F.broadcast(found), F.lit(True), "left_anti"))


@query("SELECT p_partkey AS id FROM part WHERE p_type LIKE 'PROMO%' UNION SELECT p_partkey FROM part WHERE lower(p_name) LIKE 'blue%'")
def prefix_match(t):
    """Literal prefixes, whatever the case."""
    return t.part.filter(F.col("p_type").startswith("PROMO") | F.lower("p_name").startswith("blue")).select(F.col("p_partkey").alias("id")).distinct()


@query("SELECT f.c_custkey AS id, MIN(f.bucket)::INTEGER AS bucket FROM (SELECT c_custkey, 1 bucket FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_mktsegment = 'FURNITURE' UNION ALL SELECT c_custkey, 3 FROM customer WHERE c_nationkey < 5) f GROUP BY f.c_custkey")
def comment_buckets(t):
    c = t.customer.withColumnRenamed("c_custkey", "id")
    return relevance.first_bucket(c.filter("c_acctbal > 9000"), c.filter("c_mktsegment = 'FURNITURE'"), c.filter("c_nationkey < 5"))


# --- tokens and similarity ---------------------------------------------------

_TOKENS_SQL = "WITH tok AS (SELECT doc_id AS file, unnest(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+')) AS token FROM documents), w AS (SELECT token, file, COUNT(*) n FROM tok WHERE token <> '' GROUP BY ALL), score AS (SELECT token, file, n, n::DOUBLE / COUNT(*) OVER (PARTITION BY file) * ((SELECT COUNT(DISTINCT file) FROM w)::DOUBLE / COUNT(*) OVER (PARTITION BY token)) AS score FROM w) "


def _tokens(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", "text").repartition("doc_id").select(F.col("doc_id").alias("file"), F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("token"))
    return words.filter("token <> ''")


@query(_TOKENS_SQL + "SELECT file, COUNT(*)::BIGINT AS tokens, round(MAX(score), 6) AS best FROM score GROUP BY file")
def tfidf_docs(t):
    return relevance.term_weights(_tokens(t)).groupBy("file").agg(F.count("*").alias("tokens"), F.round(F.max("score"), 6).alias("best"))


@query(_TOKENS_SQL + "SELECT token, file FROM (SELECT token, file, row_number() OVER (PARTITION BY token ORDER BY round(score, 9) DESC, file) r FROM score) WHERE r = 1")
def tfidf_top1_file(t):
    return relevance.best_file(relevance.term_weights(_tokens(t))).select("token", "file")


@query("SELECT p_partkey AS id, list_aggregate(list_sort(list_distinct(string_split(regexp_replace(lower(p_name), ' +', '_', 'g'), '_'))), 'string_agg', '|') AS tokens FROM part")
def name_tokens(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(F.sort_array(names.camel_tokens(F.lower("p_name"))), "|").alias("tokens"))


@query("WITH w AS (SELECT item_id, string_split(text, ' ') ws FROM benchmark) SELECT item_id, (3 * len(ws) - 3)::BIGINT AS n FROM w")
def ngrams_benchmark(t):
    """Runs of one to three words of each item."""
    return t.benchmark.select("item_id", F.size(names.grams(F.split("text", " "))).cast("long").alias("n"))


_COS_SQL = "list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])))"


@query(f"SELECT query_id, id, rank::INTEGER AS rank FROM (SELECT q.vec_id query_id, e.vec_id id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS_SQL}, 9) DESC, e.vec_id) rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 10")
def top10_similar(t):
    """The ten nearest of every twentieth vector."""
    return relevance.most_similar(t.embeddings.filter("vec_id % 20 = 0"), t.embeddings, 10).select("query_id", "id", "rank")


@query(f"SELECT q.vec_id AS query_id, e.vec_id AS id FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0 AND round({_COS_SQL}, 9) > 0.3")
def concept_threshold(t):
    return relevance.related(t.embeddings.filter("vec_id % 20 = 0"), t.embeddings, 0.3).select("query_id", "id")


# --- traces ------------------------------------------------------------------

_SPECIAL = "event_type IN ('signup', 'error', 'purchase')"
_SEG_SQL = f"WITH n AS (SELECT *, SUM(({_SPECIAL})::INT) OVER (PARTITION BY user_id % 10 ORDER BY event_id) seg, user_id % 10 run FROM events), pl AS (SELECT *, first_value(user_id) OVER (PARTITION BY run, seg ORDER BY event_id) fu FROM n WHERE NOT {_SPECIAL}) "


def _trace(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", "value", (F.col("user_id") % 10).alias("run"))


@query(_SEG_SQL + "SELECT run, seg::BIGINT AS seg, user_id, SUM((event_type = 'view')::INT)::BIGINT AS reads, SUM((event_type <> 'view')::INT)::BIGINT AS writes, MIN(CASE WHEN event_type = 'view' THEN event_id END) AS first_read, MIN(CASE WHEN event_type <> 'view' THEN event_id END) AS first_write FROM pl WHERE user_id = fu GROUP BY run, seg, user_id")
def trace_segments(t):
    shared.folder(t.events.sparkSession)
    plain = windows.segments(_trace(t), ["run"], "event_id", F.expr(_SPECIAL), ["user_id"])
    return windows.compact(plain, ["run", "seg", "user_id"], "event_id", F.col("event_type") == "view")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id)::INTEGER AS invno FROM events")
def invocation_no(t):
    return windows.invocation(t.events, ["event_type", "user_id"], "event_id").select("event_id", "invno")


@query("SELECT event_id, SUM(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS depth FROM events")
def lock_depth(t):
    return windows.depth(t.events, ["user_id"], "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase").select("event_id", "depth")


@query("WITH d AS (SELECT *, SUM(CASE event_type WHEN 'signup' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) dep FROM events WHERE event_type IN ('signup', 'purchase')), l AS (SELECT *, CASE event_type WHEN 'signup' THEN dep ELSE dep + 1 END lev FROM d), x AS (SELECT *, lead(event_type) OVER w nt, lead(event_id) OVER w ne FROM l WINDOW w AS (PARTITION BY user_id, lev ORDER BY event_id)) SELECT event_id, lev::BIGINT AS level, CASE WHEN nt = 'purchase' THEN ne END AS closed_by FROM x WHERE event_type = 'signup'")
def call_depth_pairs(t):
    return windows.brackets(t.events, ["user_id"], "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase").select("event_id", "level", "closed_by")


@query("SELECT event_id, ended FROM (SELECT event_id, event_type, MIN(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) ended FROM events) WHERE event_type = 'signup'")
def heap_lifetime(t):
    return windows.lifetimes(t.events, ["user_id"], "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase").select("event_id", "ended")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND event_type IN ('view', 'click')")
def sync_sequence(t):
    """Accesses of the threads with a tag, as facts joined to their dimension."""
    c = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return t.events.filter(F.col("event_type").isin("view", "click")).join(c, F.col("user_id") == F.col("c_custkey"), "left_semi").select("event_id", "user_id", "event_type", "value")


@query("SELECT e.event_id AS id, b.base AS base, b.value AS value FROM (SELECT event_id, user_id % 25 AS part, floor(value * 100)::BIGINT AS at FROM events) e ASOF LEFT JOIN (SELECT c_nationkey part, floor(c_acctbal)::BIGINT base, MAX(c_custkey) value FROM customer GROUP BY ALL) b ON e.part = b.part AND e.at >= b.base")
def asof_floor_lookup(t):
    """The variable at or below an address, within its region."""
    shared.folder(t.events.sparkSession)
    points = t.events.select(F.col("event_id").alias("id"), (F.col("user_id") % 25).cast("int").alias("part"), F.floor(F.col("value") * 100).alias("at"))
    bases = t.customer.select(F.col("c_nationkey").alias("part"), F.floor("c_acctbal").alias("base"), "c_custkey").groupBy("part", "base").agg(F.max("c_custkey").alias("var"))
    return windows.floor_lookup(points, bases, "part", "at", "base", "var").select("id", "base", "value")


@query("WITH e AS (SELECT event_id, user_id, (event_type = 'error') d FROM events) SELECT event_id AS id, coalesce(MIN(CASE WHEN d THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), MIN(CASE WHEN d THEN event_id END) OVER (PARTITION BY user_id)) AS def_id FROM e")
def usr_first_def(t):
    return windows.next_definition(t.events, "user_id", "event_id", "event_id", F.col("event_type") == "error").select(F.col("event_id").alias("id"), "def_id")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current FROM events")
def last_directory(t):
    return windows.last_seen(t.events, "user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id"))).select("event_id", "current")


@query("SELECT user_id, dense_rank() OVER (ORDER BY f)::INTEGER AS ordinal FROM (SELECT user_id, MIN(event_id) f FROM events GROUP BY user_id)")
def input_ordinal(t):
    """Inputs numbered by first appearance, over ranges of it."""
    shared.folder(t.events.sparkSession)
    first = t.events.groupBy("user_id").agg(F.min("event_id").alias("f"))
    return windows.ordinal(first, "f").select("user_id", "ordinal")


# --- intervals and identities ------------------------------------------------

@query("SELECT a.o_orderkey AS a, l_linenumber AS b FROM orders a JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate <= l_shipdate + INTERVAL 30 DAY AND o_orderdate + INTERVAL 60 DAY >= l_shipdate + INTERVAL 30 DAY")
def scope_overlap(t):
    """Scopes that reach the end of a range: an equi-join on the file, then the interval test."""
    o, li = t.orders.select("o_orderkey", "o_orderdate"), t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
    both = o.join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.filter("o_orderdate <= l_shipdate + interval 30 days and o_orderdate + interval 60 days >= l_shipdate + interval 30 days").select(F.col("o_orderkey").alias("a"), F.col("l_linenumber").alias("b"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, p_partkey AS block FROM lineitem JOIN part ON l_partkey = p_partkey WHERE (l_linenumber, l_quantity::INT) >= (1, 5) AND (l_linenumber, l_quantity::INT) <= (4, p_size)")
def point_in_range(t):
    """Positions inside blocks: structs compare by line, then column."""
    both = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    at = F.struct(F.col("l_linenumber").alias("line"), F.round("l_quantity").cast("int").alias("col"))
    point = lambda a, b: F.struct(a.cast("int").alias("line"), b.cast("int").alias("col"))
    return both.filter((at >= point(F.lit(1), F.lit(5))) & (at <= point(F.lit(4), F.col("p_size")))).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("p_partkey").alias("block"))


@query("WITH RECURSIVE c AS (SELECT o_orderkey id, o_orderkey node FROM orders UNION ALL SELECT c.id, p.par FROM c JOIN (SELECT a.o_orderkey k, a.o_orderkey // 2 par FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey // 2 WHERE a.o_orderkey > 1) p ON p.k = c.node) SELECT id, MIN(node) AS root FROM c GROUP BY id")
def id_fixpoint(t):
    """Ids chased to their ends; a pointer to a missing id ends a chain."""
    ids = t.orders.select(F.col("o_orderkey").alias("id"))
    some = ids.withColumn("to", F.expr("id div 2")).filter("id > 1").join(ids.select(F.col("id").alias("to")), "to", "left_semi")
    shared.folder(ids.sparkSession)
    return graphs.fixpoint(ids.join(some.select("id", "to"), "id", "left"))


@query("WITH RECURSIVE c AS (SELECT r_regionkey root, r_regionkey::BIGINT + 1 node, 0 level FROM region UNION ALL SELECT c.root, o_orderkey, level + 1 FROM c JOIN orders ON o_orderkey // 5 = c.node WHERE o_orderkey >= 5) SELECT root, node, MIN(level)::INTEGER AS level FROM c GROUP BY ALL")
def dep_closure(t):
    """What each start reaches over parent pointers read backwards."""
    edges = t.orders.select(F.expr("o_orderkey div 5").alias("src"), F.col("o_orderkey").alias("dst")).filter("dst >= 5")
    start = t.region.select(F.col("r_regionkey").alias("root"))
    shared.folder(edges.sparkSession)
    found = graphs.closure(edges, start.select(F.col("root"), (F.col("root").cast("long") + 1).alias("node")))
    return found.select("root", "node", "level")


@query("SELECT a.p_partkey AS id, b.s_suppkey AS match FROM (SELECT *, COUNT(*) OVER (PARTITION BY p_size, p_brand) n FROM part) a JOIN (SELECT s_suppkey, s_nationkey, COUNT(*) OVER (PARTITION BY s_nationkey) m FROM supplier) b ON a.p_size = b.s_nationkey WHERE n = 1 AND m = 1")
def unique_loc_match(t):
    """A join on location that keeps only keys with one match on either side."""
    a = t.part.join(t.part.groupBy("p_size", "p_brand").count().filter("count = 1").drop("count"), ["p_size", "p_brand"], "left_semi")
    b = t.supplier.groupBy("s_nationkey").agg(F.first("s_suppkey").alias("match"), F.count("*").alias("m")).filter("m = 1")
    return a.join(b, F.col("p_size") == F.col("s_nationkey")).select(F.col("p_partkey").alias("id"), "match")


@query("SELECT l_orderkey, l_linenumber, coalesce(s_nationkey::BIGINT, l_suppkey) AS id FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey")
def remap_ids(t):
    m = t.supplier.filter("s_acctbal > 0").select("s_suppkey", F.col("s_nationkey").cast("long").alias("new"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").join(m, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", F.coalesce("new", "l_suppkey").alias("id"))


@query("SELECT doc_id AS id, MIN(doc_id) OVER (PARTITION BY sha256(text)) AS canonical FROM documents")
def dedup_content(t):
    """Each node's canonical id: the first with the same content (hashes travel, not contents)."""
    h = t.documents.select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return h.join(h.groupBy("h").agg(F.min("id").alias("canonical")), "h").select("id", "canonical")


# --- graphs ------------------------------------------------------------------

@query("SELECT DISTINCT 'nested' AS kind, r_name AS src, n_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT 'inherits', n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey")
def class_map_edges(t):
    nested = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("nested").alias("kind"), F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    bases = t.customer.select("c_nationkey", "c_mktsegment").distinct().join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("inherits").alias("kind"), F.col("n_name").alias("src"), F.col("c_mktsegment").alias("dst"))
    return nested.unionByName(bases).distinct()


@query("SELECT DISTINCT user_id AS src, floor(value)::BIGINT AS dst FROM events WHERE event_type = 'view' EXCEPT SELECT DISTINCT user_id, floor(value)::BIGINT FROM events WHERE event_type = 'click'")
def virtual_edges(t):
    e = t.events.select(F.col("user_id").alias("src"), F.floor("value").alias("dst"), "event_type")
    return graphs.dynamic_only(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"))


@query("SELECT user_id AS func, bool_or(event_type = 'error') AS covered, COUNT(*)::BIGINT AS blocks FROM events GROUP BY user_id")
def coverage_by_func(t):
    return t.events.groupBy(F.col("user_id").alias("func")).agg(F.bool_or(F.col("event_type") == "error").alias("covered"), F.count("*").alias("blocks"))


@query("SELECT DISTINCT '\"' || r_name || '\"->\"' || n_name || '\"' AS line FROM nation JOIN region ON n_regionkey = r_regionkey")
def dot_export(t):
    return graphs.dot(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst")))


@query("SELECT l_orderkey AS parent, l_linenumber AS child, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1 AS written FROM lineitem")
def first_child_write(t):
    """The first operand is written, the others are read."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber")
    return t.lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("child"), (F.row_number().over(w) == 1).alias("written"))


@query("SELECT o_custkey AS id FROM orders GROUP BY o_custkey HAVING COUNT(DISTINCT o_orderpriority) >= 2")
def multi_inherit(t):
    return t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count_distinct("o_orderpriority").alias("n")).filter("n >= 2").select("id")


@query("SELECT p_partkey AS id, list_aggregate(list_sort(list_distinct(string_split(regexp_replace(camel, '(.+?)([A-Z])', '\\1_\\2', 'g'), '_'))), 'string_agg', '|') AS tokens FROM (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), '') AS camel FROM part)")
def camel_tokens(t):
    """Parts of names at their capitals."""
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(F.sort_array(names.camel_tokens(camel)), "|").alias("tokens"))


_GRAMS_SQL = "WITH b AS (SELECT list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') ws FROM benchmark), c AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') ws FROM conversations), n AS (SELECT unnest(range(1, 4)) n), bg AS (SELECT DISTINCT array_to_string(ws[i:i + n - 1], ' ') w FROM (SELECT ws, n, unnest(range(1, len(ws) - n + 2)) i FROM b, n WHERE len(ws) >= n)), cg AS (SELECT DISTINCT conv_id, turn, array_to_string(ws[i:i + n - 1], ' ') w FROM (SELECT conv_id, turn, ws, n, unnest(range(1, len(ws) - n + 2)) i FROM c, n WHERE len(ws) >= n)) "


@query(_GRAMS_SQL + "SELECT conv_id, turn, COUNT(*)::BIGINT AS n FROM cg JOIN bg USING (w) GROUP BY conv_id, turn")
def ngrams_vocab(t):
    """Runs of one to three words that a vocabulary knows."""
    ws = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    known = t.benchmark.select(F.explode(names.grams(ws)).alias("w")).distinct()
    runs = t.conversations.select("conv_id", "turn", F.explode(F.array_distinct(names.grams(ws))).alias("w"))
    return runs.join(known, "w").groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, event_type, SUM(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) d FROM events) WHERE d > 0 AND event_type IN ('view', 'click')")
def held_locks(t):
    """Accesses while their thread holds a lock."""
    d = windows.depth(t.events, ["user_id"], "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase")
    return d.filter((F.col("depth") > 0) & F.col("event_type").isin("view", "click")).select("event_id", "user_id")


@query("SELECT DISTINCT 'REFERED' AS kind, o_orderpriority AS src, c_mktsegment AS dst FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT DISTINCT 'DEFINED', c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def extern_edges(t):
    """Uses of a symbol, and the place that defines it."""
    c = t.customer.select("c_custkey", "c_mktsegment", "c_nationkey")
    used = t.orders.select("o_custkey", "o_orderpriority").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.lit("REFERED").alias("kind"), F.col("o_orderpriority").alias("src"), F.col("c_mktsegment").alias("dst"))
    defined = c.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("DEFINED").alias("kind"), F.col("c_mktsegment").alias("src"), F.col("n_name").alias("dst"))
    return used.unionByName(defined).distinct()


@query("WITH RECURSIVE e AS (SELECT o_orderkey // 2 src, o_orderkey dst FROM orders WHERE o_orderkey > 1 UNION SELECT o_orderkey // 3, o_orderkey FROM orders WHERE o_orderkey > 2), r AS (SELECT r_regionkey::BIGINT root, r_regionkey::BIGINT node, 0 level FROM region UNION SELECT root, dst, level + 1 FROM r JOIN e ON e.src = r.node) SELECT root, node, MIN(level)::INTEGER AS level FROM r GROUP BY root, node")
def bfs_reach(t):
    """What each start reaches where paths meet again, at its least distance."""
    o = t.orders.select(F.col("o_orderkey").alias("dst"))
    edges = o.filter("dst > 1").select(F.expr("dst div 2").alias("src"), "dst").unionByName(o.filter("dst > 2").select(F.expr("dst div 3").alias("src"), "dst")).distinct()
    shared.folder(o.sparkSession)
    return graphs.closure(edges, t.region.select(F.col("r_regionkey").cast("long").alias("root")))


_COMMENT = r"//[^\n]*|/\*(?s:.*?)\*/"


@query(f"SELECT page_id, len(found)::BIGINT AS n, list_sum(list_transform(found, lambda x: len(x)))::BIGINT AS chars, (1 + len(html) - len(replace(html, chr(10), '')) - len(rest[-1]) + len(replace(rest[-1], chr(10), '')))::BIGINT AS last FROM (SELECT page_id, html, regexp_extract_all(html, '{_COMMENT}') AS found, string_split_regex(html, '{_COMMENT}') AS rest FROM (SELECT page_id, url || chr(10) || html AS html FROM pages)) WHERE len(found) > 0")
def comment_scan(t):
    """Comments of each text, and the line where the last one ends."""
    found = comments.extract(t.pages.select("page_id", F.concat_ws("\n", "url", "html").alias("html")), "page_id", "html")
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("last").cast("long").alias("last"))


# --- attribution -------------------------------------------------------------

@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b USING (p_brand, p_type, p_size) WHERE a.p_partkey <> b.p_partkey")
def sibling_pairs(t):
    """Pairs of symbols that share name and scope."""
    return attribution.pairs(t.part, ["p_brand", "p_type", "p_size"], "p_partkey")


@query("SELECT c_custkey AS id, n_regionkey AS pos FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 3")
def load_order(t):
    """Rows of loaded images with their place in the order of loading."""
    loaded = t.nation.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("image"), F.col("n_regionkey").alias("pos"))
    return attribution.in_load_order(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("image")), loaded, "image", "pos").select("id", "pos")


@query("WITH RECURSIVE o AS (SELECT o_orderkey id, CASE WHEN o_orderkey > 0 THEN o_orderkey // 2 END AS up, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey END AS size FROM orders), c AS (SELECT id, up, size FROM o UNION ALL SELECT c.id, o.up, o.size FROM c JOIN o ON c.up = o.id WHERE c.size IS NULL) SELECT id, MAX(size) AS size FROM c GROUP BY id")
def type_sizes(t):
    """Sizes found along chains of type references."""
    shared.folder(t.orders.sparkSession)
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") > 0, F.expr("o_orderkey div 2")).alias("up"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey")).alias("size"))
    return attribution.first_along(rows, "id", "up", "size")


@query("SELECT c.c_custkey AS id, c.c_name AS name, coalesce(CASE WHEN c.c_acctbal > 0 THEN c.c_mktsegment END, CASE WHEN d.c_acctbal > 0 THEN d.c_mktsegment END) AS type FROM customer c LEFT JOIN customer d ON c.c_custkey // 2 = d.c_custkey")
def specification_merge(t):
    """Attributes that a definition lacks, from the declaration that it refers to."""
    both = F.map_from_entries(F.filter(F.array(*(F.when(ok, F.struct(F.lit(k).alias("key"), F.col(c).alias("value"))) for ok, k, c in ((F.lit(True), "name", "c_name"), (F.col("c_acctbal") > 0, "type", "c_mktsegment")))), lambda x: x.isNotNull()))
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.expr("c_custkey div 2").alias("to"), both.alias("attrs"))
    out = attribution.merged_attributes(rows, "id", "to", "attrs")
    return out.select("id", *(F.try_element_at("attrs", F.lit(k)).alias(k) for k in ("name", "type")))


@query("SELECT p_partkey AS id, CASE WHEN n = 1 AND m = 1 THEN s END AS match FROM (SELECT *, COUNT(*) OVER (PARTITION BY p_size, p_brand) n FROM part) LEFT JOIN (SELECT s_nationkey, s_suppkey % 5 AS b, COUNT(*) m, MIN(s_suppkey) s FROM supplier GROUP BY ALL) ON p_size = s_nationkey AND right(p_brand, 1) = b::VARCHAR")
def enriched(t):
    """Names from a table that match on a location only once, on either side."""
    parts = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("line"), F.col("p_brand").alias("brand"))
    names_ = t.supplier.select(F.col("s_nationkey").cast("long").alias("line"), (F.col("s_suppkey") % 5).cast("string").alias("digit"), F.col("s_suppkey").alias("match"))
    brands = parts.select("brand").distinct().withColumn("digit", F.right("brand", F.lit(1)))
    return attribution.unique_match(parts, names_.join(F.broadcast(brands), "digit").drop("digit"), ["line", "brand"], "match").select("id", "match")


_SIZED = "(SELECT c_nationkey part, floor(c_acctbal)::BIGINT base, MAX(c_custkey) var, MAX(c_custkey % 40)::BIGINT size FROM customer GROUP BY ALL)"


@query(f"SELECT e.event_id AS id, CASE WHEN e.at < b.base + b.size THEN b.var END AS var, CASE WHEN e.at < b.base + b.size THEN (e.at - b.base) // 4 END AS element FROM (SELECT event_id, user_id % 25 AS part, floor(value * 100)::BIGINT AS at FROM events) e ASOF LEFT JOIN {_SIZED} b ON e.part = b.part AND e.at >= b.base")
def sized_floor_lookup(t):
    """The variable that holds an address, if it is large enough, and the element of it."""
    shared.folder(t.events.sparkSession)
    points = t.events.select(F.col("event_id").alias("id"), (F.col("user_id") % 25).cast("int").alias("part"), F.floor(F.col("value") * 100).alias("at"))
    bases = t.customer.groupBy(F.col("c_nationkey").alias("part"), F.floor("c_acctbal").alias("base")).agg(F.max("c_custkey").alias("var"), F.max(F.col("c_custkey") % 40).alias("size"))
    got = windows.floor_lookup(points, bases, "part", "at", "base", "var", "size")
    return got.select("id", F.col("value").alias("var"), F.when(F.col("value").isNotNull(), F.floor((F.col("at") - F.col("base")) / 4)).alias("element"))


@query("WITH n AS (SELECT *, SUM(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) d, MAX(event_id) OVER (PARTITION BY user_id) eof FROM events), l AS (SELECT *, d + (event_type = 'purchase')::INT AS level FROM n WHERE event_type IN ('purchase', 'error')) SELECT event_id, level::BIGINT AS level, scope_end FROM (SELECT event_id, event_type, level, coalesce(lead(event_id) OVER (PARTITION BY user_id, level ORDER BY event_id), eof) AS scope_end FROM l) WHERE event_type = 'error'")
def comment_scopes(t):
    """How far comments reach: to the closing brace, or to the next comment of their scope."""
    kind = F.col("event_type")
    return attribution.scope_ends(t.events.select("event_id", "user_id", "event_type"), "user_id", "event_id", kind == "signup", kind == "purchase", kind == "error").select("event_id", "level", "scope_end")


@query("SELECT l_suppkey AS symbol, t.w AS word, COUNT(DISTINCT o_orderkey)::BIGINT AS n FROM (SELECT o_orderkey, unnest(string_split(lower(o_orderpriority), '-')) AS w FROM orders) t JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def comment_words_of_symbols(t):
    """Words of comments, copied to the symbols in their scope."""
    tokens = t.orders.select(F.col("o_orderkey").alias("comment"), F.explode(F.split(F.lower("o_orderpriority"), "-")).alias("word"))
    return attribution.propagated(tokens, t.lineitem.select(F.col("l_orderkey").alias("comment"), F.col("l_suppkey").alias("symbol")), "comment", "symbol")


@query("SELECT l_orderkey AS k, l_linenumber AS n, o_custkey AS block FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE ((l_linenumber, l_quantity::INT) BETWEEN (2, 10) AND (4, o_custkey % 50)) OR ((l_linenumber + 1, 3) BETWEEN (2, 10) AND (4, o_custkey % 50))")
def block_attribution(t):
    """Places whose first or last position lies in a block of their function."""
    at = lambda a, b: F.struct(a.cast("int").alias("line"), b.cast("int").alias("col"))
    n = F.col("l_linenumber")
    places = t.lineitem.select(F.col("l_orderkey").alias("k"), n.alias("n"), at(n, F.round("l_quantity")).alias("first"), at(n + 1, F.lit(3)).alias("last"))
    blocks = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("block"), at(F.lit(2), F.lit(10)).alias("begin"), at(F.lit(4), F.col("o_custkey") % 50).alias("end"))
    return attribution.in_blocks(places, blocks, ["k"]).select("k", "n", "block")


@query("SELECT event_id AS id, string_agg(o_orderkey, '|' ORDER BY o_orderkey) AS sites FROM events JOIN (SELECT o_custkey, o_orderstatus, o_orderkey FROM orders) ON user_id = o_custkey AND CASE event_type WHEN 'view' THEN 'O' WHEN 'click' THEN 'F' ELSE 'P' END = o_orderstatus GROUP BY event_id")
def call_site_join(t):
    """All expressions at a call's place that name its callee."""
    calls = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("line"), F.when(F.col("event_type") == "view", "O").when(F.col("event_type") == "click", "F").otherwise("P").alias("callee"))
    sites = t.orders.select(F.col("o_custkey").alias("line"), F.col("o_orderstatus").alias("callee"), "o_orderkey")
    return attribution.call_sites(calls, sites, ["line", "callee"], "o_orderkey").select("id", F.array_join(F.transform("sites", lambda x: x.cast("string")), "|").alias("sites"))
