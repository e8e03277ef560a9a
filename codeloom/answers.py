"""The question templates on the driver's tables, with their SQL.

Regions are name spaces, nations functions, customers variables (segments are
their tags) and suppliers classes; a symbol's file is its region.  Documents are
comments on the customer of the same number, events accesses to it.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import relevance
from .plans import binding, dispatch, templates
from .registry import Tables, query

_K = """WITH sym AS (
  SELECT 'r' || r_regionkey s, 'Namespace' is_a, r_name spelling, NULL::VARCHAR file, NULL::VARCHAR parent, NULL::VARCHAR type, NULL::VARCHAR return_type FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'FunctionDecl', n_name, r_name, 'r' || n_regionkey, NULL, CASE WHEN n_nationkey % 2 = 0 THEN 'void' ELSE 'int' END FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'c' || c_custkey, c_mktsegment, c_name, r_name, 'n' || c_nationkey, CASE WHEN c_acctbal < 0 THEN 'int' ELSE 'double' END, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 's' || s_suppkey, 'ClassDecl', s_name, r_name, 'n' || s_nationkey, 'Supplier', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
tok AS (SELECT DISTINCT s, unnest(string_split_regex(lower(spelling), '[#_]')) token, 'name' kind FROM sym UNION ALL SELECT * FROM (SELECT DISTINCT 'c' || doc_id, unnest(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+')) t, 'comment' FROM documents) WHERE t <> ''),
acc AS (SELECT event_id seq, user_id % 7 thread, CASE event_type WHEN 'view' THEN 'READ' WHEN 'click' THEN 'WRITE' ELSE 'CALL' END kind, 'c' || user_id var_id, 'Customer#' || lpad(user_id::VARCHAR, 9, '0') var_name, 'NATION_' || (event_id % 25) func_name, CASE WHEN user_id % 5 = 0 THEN 'SYNC' ELSE 'ASYNC' END sync, CASE WHEN event_type = 'error' THEN 'MUTEX' END AS lock FROM events),
facts AS (SELECT s, 'is_a' p, is_a o FROM sym UNION ALL SELECT s, 'spelling', spelling FROM sym UNION ALL SELECT s, 'file', file FROM sym WHERE file IS NOT NULL UNION ALL SELECT s, 'parent', parent FROM sym WHERE parent IS NOT NULL UNION ALL SELECT s, 'type', type FROM sym WHERE type IS NOT NULL UNION ALL SELECT s, 'return_type', return_type FROM sym WHERE return_type IS NOT NULL),
nt AS (SELECT t.token, y.file, COUNT(*) n FROM tok t JOIN sym y USING (s) WHERE t.kind = 'name' GROUP BY ALL),
score AS (SELECT token, file, n::DOUBLE / COUNT(*) OVER (PARTITION BY file) * ((SELECT COUNT(DISTINCT file) + MAX((file IS NULL)::INT) FROM nt)::DOUBLE / COUNT(*) OVER (PARTITION BY token)) AS w FROM nt WHERE file IS NOT NULL),
best AS (SELECT token, file FROM (SELECT token, file, row_number() OVER (PARTITION BY token ORDER BY round(w, 9) DESC, file) r FROM score) WHERE r = 1)
"""


def _knowledge(t: Tables) -> templates.Knowledge:
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    shape = lambda df, s, is_a, spelling, file, parent, kind, result: df.select(s.alias("s"), is_a.alias("is_a"), spelling.alias("spelling"), file.alias("file"), parent.alias("parent"), kind.alias("type"), result.alias("return_type"))
    key = lambda letter, c: F.concat(F.lit(letter), text(c))
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    # by the planner's estimate, a product, nations may be more than customers
    customer = t.customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = t.supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    file = F.col("r_name")
    symbols = (
        shape(t.region, key("r", "r_regionkey"), F.lit("Namespace"), file, none, none, none, none)
        .unionByName(shape(nation, key("n", "n_nationkey"), F.lit("FunctionDecl"), F.col("n_name"), file, key("r", "n_regionkey"), none, F.when(F.col("n_nationkey") % 2 == 0, "void").otherwise("int")))
        .unionByName(shape(customer, key("c", "c_custkey"), F.col("c_mktsegment"), F.col("c_name"), file, key("n", "c_nationkey"), F.when(F.col("c_acctbal") < 0, "int").otherwise("double"), none))
        .unionByName(shape(supplier, key("s", "s_suppkey"), F.lit("ClassDecl"), F.col("s_name"), file, key("n", "s_nationkey"), F.lit("Supplier"), none))
    )
    named = symbols.select("s", F.explode(F.array_distinct(F.split(F.lower("spelling"), "[#_]"))).alias("token"), F.lit("name").alias("kind"))
    said = t.documents.select(key("c", "doc_id").alias("s"), F.explode(F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))).alias("token"), F.lit("comment").alias("kind")).filter("token <> ''")
    e = t.events
    accesses = e.select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 7).alias("thread"), F.when(F.col("event_type") == "view", "READ").when(F.col("event_type") == "click", "WRITE").otherwise("CALL").alias("kind"),
        key("c", "user_id").alias("var_id"), F.concat(F.lit("Customer#"), F.lpad(text("user_id"), 9, "0")).alias("var_name"), F.concat(F.lit("NATION_"), (F.col("event_id") % 25).cast("string")).alias("func_name"),
        F.when(F.col("user_id") % 5 == 0, "SYNC").otherwise("ASYNC").alias("sync"), F.when(F.col("event_type") == "error", "MUTEX").alias("lock"),
    )
    return templates.Knowledge(symbols, named.unionByName(said), accesses)


def template(sql: str):
    """Register a function of Knowledge (and Tables)."""

    def add(f):
        def on_tables(t: Tables) -> DataFrame:
            return f(_knowledge(t), t)

        on_tables.__name__ = f.__name__
        return query(_K + sql)(on_tables)

    return add


SOME = ["BUILDING", "MACHINERY"]
_SOME = "('BUILDING', 'MACHINERY')"


@template(f"SELECT s, spelling FROM sym WHERE is_a IN {_SOME} AND type = 'double' AND parent IN (SELECT s FROM sym WHERE spelling = 'NATION_3')")
def t00_children_with(k, t):
    return templates.children_with(k, "NATION_3", SOME, type="double")


@template("SELECT seq, s FROM acc JOIN sym ON var_name = spelling WHERE sync <> 'ASYNC' AND file = 'ASIA' AND type = 'double' AND s IN (SELECT s FROM tok WHERE token = 'the' AND kind = 'comment')")
def t01_synchronised_in_file(k, t):
    return templates.synchronised_in_file(k, "ASIA", "the", type="double")


@template(f"SELECT DISTINCT spelling FROM sym WHERE is_a IN {_SOME} AND file = 'EUROPE' AND type = 'double'")
def t02_names_with(k, t):
    return templates.names_with(k, "EUROPE", SOME, type="double")


@template("SELECT p, string_agg(DISTINCT o, '|' ORDER BY o) AS vals FROM facts WHERE p IN ('type', 'file', 'parent') AND s IN (SELECT s FROM sym WHERE spelling = 'Customer#000000003' AND is_a <> 'ClassDecl') GROUP BY p")
def t03_attributes_of_tagged(k, t):
    tags = [*SOME, "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"]
    return templates.attributes_of(k, "Customer#000000003", ["type", "file", "parent"], tags).select("p", F.array_join("values", "|").alias("vals"))


@template(f"SELECT parent, s, spelling FROM sym WHERE is_a IN {_SOME} AND parent IN (SELECT s FROM sym WHERE spelling = 'NATION_2') AND s IN (SELECT s FROM tok WHERE token = 'the' AND kind = 'comment')")
def t04_children_with_token(k, t):
    return templates.children_with_token(k, "NATION_2", SOME, "the")


_OF = "SELECT seq, var_id, kind, row_number() OVER (PARTITION BY var_id ORDER BY seq)::INTEGER AS nth FROM acc WHERE kind IN ('READ', 'WRITE') AND var_id IN (SELECT s FROM sym WHERE spelling = 'Customer#000000008'"


@template(_OF + " AND file = (SELECT file FROM sym WHERE s = 'c8'))")
def t05_accesses_of_in_file(k, t):
    """The file is that of customer 8, taken by a join: no value travels through the driver."""
    file = k.symbols.filter("s = 'c8'").select("file")
    return templates.accesses_of(dataclasses.replace(k, symbols=k.symbols.join(file, "file", "left_semi")), "Customer#000000008")


@template("SELECT seq, s FROM acc JOIN sym ON func_name = spelling WHERE sync <> 'ASYNC' AND file = 'AFRICA'")
def t06_synchronised_functions(k, t):
    return templates.synchronised_functions(k, "AFRICA")


_TWO = "('Customer#000000008', 'NATION_3', 'NATION_8', 'Customer#000000012')"


@template(f"SELECT seq, var_name, func_name, kind FROM acc WHERE var_name IN {_TWO} AND func_name IN {_TWO}")
def t07_accesses_between(k, t):
    return templates.accesses_between(k, ["Customer#000000008", "NATION_3", "NATION_8", "Customer#000000012"])


@template(_OF + ")")
def t08_accesses_of(k, t):
    return templates.accesses_of(k, "Customer#000000008")


@template("SELECT seq, var_id, spelling, kind FROM acc JOIN sym ON var_id = s WHERE func_name = 'NATION_7'")
def t08b_accesses_inside(k, t):
    return templates.accesses_inside(k, "NATION_7")


@template(f"SELECT seq, var_id, kind FROM acc WHERE kind <> 'CALL' AND var_id IN (SELECT s FROM sym WHERE is_a IN {_SOME} AND s IN (SELECT s FROM tok WHERE token = 'the' AND kind = 'comment'))")
def t09_accesses_by_token(k, t):
    return templates.accesses_by_token(k, "the", SOME)


@template("SELECT s, spelling FROM sym WHERE s IN (SELECT var_id FROM acc WHERE lock = 'MUTEX') AND s IN (SELECT s FROM tok WHERE token = 'the' AND kind = 'comment')")
def t10_locked_variables(k, t):
    return templates.locked_variables(k, "MUTEX", "the")


@template(f"SELECT s, spelling, file FROM sym WHERE is_a IN {_SOME} AND file IN ('ASIA', 'AMERICA')")
def t11_in_files(k, t):
    return templates.in_files(k, SOME, ["ASIA", "AMERICA"])


@template("SELECT 'parent' AS side, s, spelling FROM sym WHERE is_a IN ('Namespace', 'BUILDING') AND s IN (SELECT parent FROM sym WHERE spelling = 'NATION_4') UNION ALL SELECT 'child', s, spelling FROM sym WHERE is_a IN ('Namespace', 'BUILDING') AND parent IN (SELECT s FROM sym WHERE spelling = 'NATION_4')")
def t12_relatives(k, t):
    return templates.relatives(k, "NATION_4", ["Namespace", "BUILDING"])


@template("SELECT p, string_agg(DISTINCT o, '|' ORDER BY o) AS vals FROM facts WHERE p IN ('return_type', 'file') AND s IN (SELECT s FROM sym WHERE spelling = 'NATION_5') GROUP BY p")
def t13_attributes_of(k, t):
    return templates.attributes_of(k, "NATION_5", ["return_type", "file"]).select("p", F.array_join("values", "|").alias("vals"))


@template("SELECT s, is_a, spelling FROM sym y WHERE is_a IN ('FunctionDecl', 'BUILDING', 'MACHINERY') AND (type = 'int' OR return_type = 'int' AND NOT EXISTS (SELECT 1 FROM sym z WHERE z.is_a = y.is_a AND z.type = 'int'))")
def t14_with_value_or(k, t):
    return templates.with_value_or(k, ["FunctionDecl", *SOME], "type", "return_type", "int")


_BY = "SELECT s, spelling, MIN(bucket)::INTEGER AS bucket FROM (SELECT s, 1 bucket FROM tok WHERE token = '{0}' AND kind = 'comment' UNION ALL SELECT s, 2 FROM tok JOIN sym USING (s) JOIN best USING (token, file) WHERE token = '{0}' AND kind = 'name' UNION ALL SELECT s, CASE kind WHEN 'comment' THEN 3 ELSE 4 END FROM tok WHERE starts_with(token, '{1}') AND token <> '{0}') JOIN sym USING (s) {2} GROUP BY s, spelling"


@template(_BY.format("the", "the", f"WHERE is_a IN {_SOME}"))
def t15_by_token_and_tag(k, t):
    return templates.by_token(k, "the", k.tokens.filter(F.col("token").startswith("the")), SOME)


@template("SELECT p, string_agg(DISTINCT o, '|' ORDER BY o) AS vals FROM facts WHERE s IN (SELECT s FROM sym WHERE spelling = 'Customer#000000005') GROUP BY p")
def t16_all_of(k, t):
    return templates.attributes_of(k, "Customer#000000005").select("p", F.array_join("values", "|").alias("vals"))


@template("SELECT DISTINCT spelling FROM sym WHERE is_a = 'ClassDecl' AND file = 'AMERICA'")
def t17_names_of_tag(k, t):
    return templates.names_with(k, "AMERICA", ["ClassDecl"])


@template(_BY.format("nation", "na", ""))
def t18_by_token(k, t):
    return templates.by_token(k, "nation", k.tokens.filter(F.col("token").startswith("na")))


@template("SELECT s, spelling, file FROM tok JOIN sym USING (s) JOIN best USING (token, file) WHERE token = 'nation' AND kind = 'name'")
def t19_by_name_token(k, t):
    return templates.by_name_token(k, "nation")


@template("SELECT s, spelling FROM sym WHERE type IS NOT NULL AND parent IS NOT NULL AND file = 'MIDDLE EAST'")
def t20_with_attributes(k, t):
    return templates.with_attributes(k, ["type", "parent"], "MIDDLE EAST")


@template("SELECT DISTINCT s, spelling FROM facts JOIN sym USING (s) WHERE o = 'int' AND file = 'ASIA'")
def t21_with_any_value(k, t):
    return templates.with_any_value(k, "int", "ASIA")


_COS = "list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])))"


@template(f", con AS (SELECT DISTINCT lpad(e.vec_id::VARCHAR, 9, '0') token FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id = 0 AND round({_COS}, 9) > 0.2), hit AS (SELECT s, kind FROM tok JOIN con USING (token)) SELECT s, spelling FROM sym WHERE s IN (SELECT s FROM hit WHERE kind = (SELECT MIN(kind) FROM hit))")
def t22_by_concept(k, t):
    near = relevance.related(t.embeddings.filter("vec_id = 0"), t.embeddings, 0.2)
    return templates.by_concept(k, near.select(F.lpad(F.col("id").cast("string"), 9, "0").alias("token")))


_WORDS = "list_filter(list_transform(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: regexp_replace(x, '^[.,;:!?()\"'']+|[.,;:!?()\"'']+$', '', 'g')), lambda x: len(x) > 1)"
_KIND = "CASE WHEN n > 1 THEN 'symbol' WHEN len(w) = 4 THEN 'common_word' WHEN len(w) = 5 THEN 'file' WHEN len(w) = 6 THEN 'dynamic_attribute' WHEN len(w) = 7 THEN 'values' ELSE 'comment_token' END"
_RUNS = "SELECT {0}, n, i, array_to_string(ws[i:i + n - 1], ' ') w FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) i FROM {1}, (SELECT unnest(range(1, {2})) n) WHERE len(ws) >= n)"


@query(
    f"WITH b AS (SELECT item_id, {_WORDS} ws FROM benchmark), c AS (SELECT conv_id, turn, {_WORDS} ws FROM conversations), d AS (SELECT DISTINCT w, {_KIND} kind FROM ({_RUNS.format('item_id', 'b', 3)}) WHERE n > 1 OR len(w) > 3), "
    f"f AS (SELECT conv_id, turn, i, i + n AS e, kind FROM ({_RUNS.format('conv_id, turn', 'c', 4)}) JOIN d USING (w)), g AS (SELECT conv_id, turn, i, e, kind FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.conv_id = f.conv_id AND o.turn = f.turn AND o.i <= f.i AND o.e >= f.e AND (o.i < f.i OR o.e > f.e))) "
    "SELECT conv_id, turn, string_agg(kind || ':' || i, '|' ORDER BY i) AS bound FROM g GROUP BY conv_id, turn"
)
def question_binding(t):
    """Turns bound to a dictionary of the benchmark's words and pairs of words."""
    found = binding.bind(t.conversations, _dictionary(t), ["conv_id", "turn"])
    placed = F.array_sort(F.collect_list(F.struct("start", F.concat_ws(":", "kind", F.col("start").cast("string")).alias("x"))))
    return found.groupBy("conv_id", "turn").agg(F.array_join(F.transform(placed, lambda p: p["x"]), "|").alias("bound"))


def _dictionary(t: Tables) -> DataFrame:
    w = F.length("phrase")
    kind = F.when(F.col("phrase").contains(" "), "symbol").when(w == 4, "common_word").when(w == 5, "file").when(w == 6, "dynamic_attribute").when(w == 7, "values").otherwise("comment_token")
    return binding.phrases(t.benchmark, ["item_id"], "text", 2).filter(F.col("phrase").contains(" ") | (w > 3)).select("phrase", kind.alias("kind")).distinct()


_HAS = lambda *kinds: " AND ".join(f"list_contains(ks, '{x}')" for x in kinds)


@query(
    f"WITH b AS (SELECT item_id, {_WORDS} ws FROM benchmark), c AS (SELECT conv_id, turn, {_WORDS} ws FROM conversations), d AS (SELECT DISTINCT w, {_KIND} kind FROM ({_RUNS.format('item_id', 'b', 3)}) WHERE n > 1 OR len(w) > 3), "
    f"f AS (SELECT conv_id, turn, i, i + n AS e, kind FROM ({_RUNS.format('conv_id, turn', 'c', 4)}) JOIN d USING (w)), k AS (SELECT conv_id, turn, list(DISTINCT kind) ks FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.conv_id = f.conv_id AND o.turn = f.turn AND o.i <= f.i AND o.e >= f.e AND (o.i < f.i OR o.e > f.e)) GROUP BY conv_id, turn) "
    f"SELECT template, COUNT(*)::BIGINT AS questions FROM (SELECT CASE {' '.join(f'WHEN {_HAS(*need)} THEN {chr(39)}{name}{chr(39)}' for need, name in binding.TEMPLATES)} END AS template FROM k) GROUP BY template"
)
def question_templates(t):
    """How many turns each template would answer."""
    chosen = binding.choose(binding.bind(t.conversations, _dictionary(t), ["conv_id", "turn"]), ["conv_id", "turn"])
    return chosen.groupBy("template").agg(F.count("*").alias("questions"))


_ASKED = "q AS (SELECT s_suppkey AS id, s_suppkey % 4 AS way, 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') AS c, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(
    _K.rstrip() + f", {_ASKED} SELECT id, 'attributes_of' AS template, s, p || '=' || o AS answer FROM q JOIN sym ON spelling = c JOIN facts USING (s) WHERE way = 0 "
    "UNION SELECT id, 'in_files', s, spelling FROM q JOIN sym ON file = r_name AND is_a = 'MACHINERY' WHERE way = 1 "
    "UNION SELECT id, 'relatives', y.s, y.spelling FROM q JOIN sym x ON x.spelling = n_name JOIN sym y ON y.parent = x.s AND y.is_a = 'BUILDING' WHERE way = 2 "
    "UNION SELECT id, 'accesses_of', var_id, kind || ' ' || seq FROM q JOIN acc ON var_name = c JOIN sym ON sym.s = var_id WHERE way = 3 AND kind IN ('READ', 'WRITE')"
)
def answers_in_batch(t):
    """A table of English questions, bound, given their templates and answered together."""
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    s, name = t.supplier.join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey")), F.format_string("Customer#%09d", "s_suppkey")
    way = F.col("s_suppkey") % 4
    text = F.when(way == 0, F.concat(F.lit("Please describe "), name, F.lit("."))).when(way == 1, F.concat(F.lit("Which MACHINERY is there in "), "r_name", F.lit("?"))).when(way == 2, F.concat(F.lit("Show the building of "), "n_name", F.lit("!"))).otherwise(F.concat(F.lit("Who accessed the variable "), name, F.lit("?")))
    known = lambda df, c, kind: df.select(F.lower(c).alias("phrase"), F.lit(kind).alias("kind")).distinct()
    dictionary = known(t.customer, "c_name", "symbol").unionByName(known(t.nation, "n_name", "symbol")).unionByName(known(t.region, "r_name", "file")).unionByName(known(t.customer, "c_mktsegment", "common_word"))
    words = t.region.limit(1).select(F.explode(F.array(*(F.struct(F.lit(p).alias("phrase"), F.lit(k).alias("kind")) for p, k in (("accessed", "dynamic_attribute"), ("variable", "common_word"))))).alias("x")).select("x.*")
    bound = binding.bind(s.select(F.col("s_suppkey").alias("id"), text.alias("text")), dictionary.unionByName(words), ["id"])
    return dispatch.answers(_knowledge(t), bound, ["id"])


_MORE = _ASKED.replace("s_suppkey % 4", "s_suppkey % 9")


@query(
    _K.rstrip() + f", {_MORE} SELECT id, 'children_with' AS template, y.s, y.spelling AS answer FROM q JOIN sym x ON x.spelling = n_name JOIN sym y ON y.parent = x.s AND y.is_a = 'BUILDING' JOIN facts f ON f.s = y.s AND lower(o) = 'double' WHERE way = 0 "
    "UNION SELECT id, 'synchronised_in_file', y.s, kind || ' ' || seq FROM q JOIN sym y ON y.file = r_name JOIN facts f ON f.s = y.s AND lower(o) = 'double' JOIN acc ON var_name = y.spelling AND sync <> 'ASYNC' WHERE way = 1 "
    "UNION SELECT id, 'children_with_token', y.s, y.spelling FROM q JOIN sym x ON x.spelling = n_name JOIN sym y ON y.parent = x.s AND y.is_a = 'BUILDING' JOIN tok ON tok.s = y.s AND token = 'the' AND kind = 'comment' WHERE way = 2 "
    "UNION SELECT id, 'synchronised_functions', y.s, kind || ' ' || seq FROM q JOIN sym y ON y.file = r_name JOIN acc ON func_name = y.spelling AND sync <> 'ASYNC' WHERE way = 3 "
    "UNION SELECT id, 'accesses_between', var_id, kind || ' ' || seq FROM q JOIN acc ON var_name = c AND func_name = n_name WHERE way = 4 "
    "UNION SELECT id, 'accesses_by_token', y.s, acc.kind || ' ' || seq FROM q JOIN tok ON token = 'the' AND tok.kind = 'comment' JOIN sym y ON y.s = tok.s AND y.is_a = 'BUILDING' JOIN acc ON var_id = y.s AND acc.kind IN ('READ', 'WRITE') WHERE way = 5 "
    "UNION SELECT id, 'locked_variables', y.s, y.spelling FROM q JOIN sym y ON y.is_a = 'MACHINERY' JOIN acc ON var_id = y.s AND lock = 'MUTEX' WHERE way = 6 "
    "UNION SELECT id, 'with_attributes', s, spelling FROM q JOIN sym ON return_type IS NOT NULL AND parent IS NOT NULL WHERE way = 7 "
    "UNION SELECT id, 'by_name_token', y.s, y.spelling FROM q JOIN tok ON token = 'nation' AND kind = 'name' JOIN sym y ON y.s = tok.s JOIN best ON best.token = tok.token AND best.file = y.file WHERE way = 8"
)
def answers_of_all_templates(t):
    """Questions of the other templates in one batch, those on two symbols included."""
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    s, name = t.supplier.join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey")), F.format_string("Customer#%09d", "s_suppkey")
    asked = [
        ("Which double building is below ", "n_name"), ("Which double machinery is accessed in ", "r_name"), ("What building about the things is in ", "n_name"), ("Who accessed ", "r_name"), (None, None),
        ("Who accessed the building", None), ("Who accessed machinery", None), ("Which have a return_type and a parent", None), ("What is a nation", None),
    ]
    text = F.concat(F.lit("What accessed "), name, F.lit(" in "), "n_name", F.lit("?"))
    for way, (said, place_) in enumerate(asked):
        if said:
            text = F.when(F.col("s_suppkey") % 9 == way, F.concat(F.lit(said), F.col(place_) if place_ else F.lit("?"))).otherwise(text)
    known = lambda df, c, kind: df.select(F.lower(c).alias("phrase"), F.lit(kind).alias("kind")).distinct()
    dictionary = known(t.customer, "c_name", "symbol").unionByName(known(t.nation, "n_name", "symbol")).unionByName(known(t.region, "r_name", "file")).unionByName(known(t.customer, "c_mktsegment", "common_word"))
    words = t.nation.sparkSession.createDataFrame([("accessed", "dynamic_attribute"), ("double", "values"), ("the", "comment_token"), ("return_type", "static_attribute"), ("parent", "static_attribute"), ("nation", "name_token")], "phrase string, kind string")
    bound = binding.bind(s.select(F.col("s_suppkey").alias("id"), text.alias("text")), dictionary.unionByName(words), ["id"])
    return dispatch.answers(_knowledge(t), bound, ["id"])
