"""Syntax trees in XML as flat rows, and the facts that follow from them."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import basename, last_two

#: Elements that are functions: plain ones, methods, constructors and destructors.
FUNCTIONS = ("FunctionDecl", "CXXMethod", "CXXConstructor", "CXXDestructor")
NODE = "unit string, node int, up int, depth int, tag string, attrs map<string,string>, last int, post int"
ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32()}.get(c.split()[1], pa.map_(pa.string(), pa.string()))) for c in NODE.split(", ")])
BATCH, STEP = 10_000, 1 << 16


class _Elements:
    """What a parser tells of elements, as rows in the order of their ends; no tree is kept."""

    def __init__(self, unit: str):
        self.unit, self.begun, self.open, self.rows, self.ended = unit, 0, [], [], 0

    def start(self, tag: str, attrs: dict[str, str]):
        self.open.append((self.begun, self.open[-1][0] if self.open else None, len(self.open), tag, list(attrs.items())))
        self.begun += 1

    def end(self, tag: str):
        self.rows.append((self.unit, *self.open.pop(), self.begun - 1, self.ended))
        self.ended += 1


def _rows(unit: str, content: bytes | None) -> Iterator[tuple]:
    told, content = _Elements(unit), content or b""
    parser = ElementTree.XMLParser(target=told)
    for k in range(0, len(content), STEP):
        parser.feed(content[k : k + STEP])
        yield from told.rows
        told.rows.clear()
    parser.close()
    yield from told.rows


def _maps(attrs: tuple[list, ...]) -> pa.Array:
    pairs = list(itertools.chain.from_iterable(attrs))
    at = pa.array(itertools.accumulate(map(len, attrs), initial=0), pa.int32())
    return pa.MapArray.from_arrays(at, pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements in batches of ``BATCH``: small texts share one, large ones have several."""
    texts = ((path.as_py(), content.as_py()) for b in batches for path, content in zip(b["path"], b["content"]))
    rows = itertools.chain.from_iterable(itertools.starmap(_rows, texts))
    while part := list(itertools.islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([_maps(c) if pa.types.is_map(kind) else pa.array(c, kind) for c, kind in zip(zip(*part), ARROW.types)], schema=ARROW)


def flatten(files: DataFrame) -> DataFrame:
    """(unit, node, up, depth, tag, attrs, last, post) of each element.

    ``node`` counts the elements as they begin, ``post`` as they end; ``last`` is
    the last node within an element, so that a subtree is a range of nodes.
    ``files``: path, content (one unit each).  A text that is no XML raises an error.
    """

    return files.select("path", "content").mapInArrow(_batches, NODE)


def read(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    return flatten(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def attribute(name: str):
    return F.try_element_at("attrs", F.lit(name))


def parents(nodes: DataFrame) -> DataFrame:
    """Each node with its parent's tag and attributes (columns up_tag, up_attrs)."""
    up = nodes.select("unit", F.col("node").alias("up"), F.col("tag").alias("up_tag"), F.col("attrs").alias("up_attrs"))
    return nodes.join(up, ["unit", "up"], "left")


def enclosing(nodes: DataFrame, *tags: str) -> DataFrame:
    """(unit, node, within): the id of the nearest element around each node that has one of these tags."""
    from ..operators.attribution import first_along

    key = lambda c: F.concat_ws(":", "unit", F.col(c).cast("string"))
    up = parents(nodes).select("unit", "node", key("node").alias("k"), F.when(F.col("up").isNotNull(), key("up")).alias("to"), F.when(F.col("up_tag").isin(*tags), F.try_element_at("up_attrs", F.lit("id"))).alias("within"))
    return up.select("unit", "node", "k").join(first_along(up, "k", "to", "within"), "k").drop("k")


def call_edges(nodes: DataFrame) -> DataFrame:
    """(caller, callee, line): call expressions with the function around them and what they refer to, else define."""
    calls = nodes.filter(F.col("tag").isin("CallExpr", "CXXMemberCallExpr")).select("unit", "node", F.coalesce(attribute("ref_id"), attribute("def_id")).alias("callee"), attribute("line").alias("line"))
    return calls.join(enclosing(nodes, *FUNCTIONS), ["unit", "node"]).filter("within is not null and callee is not null").select(F.col("within").alias("caller"), "callee", "line")


def special_members(nodes: DataFrame) -> DataFrame:
    """(id, kind, base): constructors and destructors of classes, each with the base classes whose own it runs too (or null)."""
    n = parents(nodes)
    up = F.try_element_at("up_attrs", F.lit("id"))
    kinds = n.filter(F.col("tag").isin("CXXConstructor", "CXXDestructor")).select(attribute("id").alias("id"), F.when(F.col("tag") == "CXXConstructor", "constructor").otherwise("destructor").alias("kind"), up.alias("of"))
    bases = n.filter(F.col("tag") == "CXXBaseClassSpecifier").select(up.alias("of"), F.coalesce(attribute("ref_id"), attribute("def_id")).alias("base"))
    return kinds.join(bases, "of", "left").select("id", "kind", "base").distinct()


def canonical(nodes: DataFrame) -> DataFrame:
    """(id, to) of spelled nodes: itself where it declares and defines, or declares an extern; else ref_id, else def_id; null ends a chain."""
    both = attribute("isDecl").isNotNull() & (attribute("isDef").isNotNull() | (attribute("storage_class") == "extern"))
    to = F.when(F.coalesce(both, F.lit(False)), attribute("id")).otherwise(F.coalesce(attribute("ref_id"), attribute("def_id")))
    return nodes.filter(attribute("spelling").isNotNull() & attribute("id").isNotNull()).select(attribute("id").alias("id"), to.alias("to")).groupBy("id").agg(F.min("to").alias("to"))


def family(nodes: DataFrame) -> DataFrame:
    """(s, p, o): has_parent and has_child, both ways."""
    k = parents(nodes).select(attribute("id").alias("s"), F.try_element_at("up_attrs", F.lit("id")).alias("up")).filter("s is not null and up is not null")
    return k.select("s", F.lit("has_parent").alias("p"), F.col("up").alias("o")).unionByName(k.select(F.col("up").alias("s"), F.lit("has_child").alias("p"), F.col("s").alias("o")))


def relations(nodes: DataFrame) -> DataFrame:
    """(s, p, o): static members, base classes, friends, several bases."""
    n = parents(nodes)
    up_id = F.try_element_at("up_attrs", F.lit("id"))
    static = n.filter((F.col("tag") == "VarDecl") & (F.col("up_tag") == "ClassDecl")).select(attribute("id").alias("s"), F.lit("is_static").alias("p"), F.lit("True").alias("o"))
    bases = n.filter(F.col("tag") == "CXXBaseClassSpecifier").select(up_id.alias("s"), F.lit("is_subclass_of").alias("p"), F.coalesce(attribute("ref_id"), attribute("def_id")).alias("o"))
    several = bases.groupBy("s").agg(F.count("*").alias("n")).filter("n >= 2").select("s", F.lit("multiple_inheritance").alias("p"), F.lit("True").alias("o"))
    w = W.partitionBy("unit", "up").orderBy("node")
    friend = n.filter(F.col("tag").isin("TypeRef", "FunctionDecl") & (F.col("up_tag") == "FriendDecl")).withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    friends = friend.select(F.coalesce(attribute("ref_id"), attribute("def_id"), attribute("id")).alias("s"), F.lit("is_friend_of").alias("p"), F.try_element_at("up_attrs", F.lit("lex_parent_id")).alias("o"))
    return static.unionByName(bases).unionByName(several).unionByName(friends).filter("s is not null and o is not null")


def resolved(facts: DataFrame, roots: DataFrame) -> DataFrame:
    """Facts (s, p, o) with both ids replaced by what they lead to (``roots``: id, root); others stay."""
    for c in ("s", "o"):
        one = roots.select(F.col("id").alias(c), F.col("root").alias("__root"))
        facts = facts.join(one, c, "left").withColumn(c, F.coalesce("__root", c)).drop("__root")
    return facts.select("s", "p", "o").distinct()


def places(nodes: DataFrame) -> DataFrame:
    """(s, p, o): the file and lines where a symbol is declared, defined or used; lines as the last two parts of a path and a number.

    Declared and defined: is_defined_file and both lines; declared alone:
    is_extern_file; neither: is_called_file and isUse_file_line; defined alone: no file.
    Files are known by their names; a path without a folder has no lines.
    """
    decl, define = attribute("isDecl").isNotNull(), attribute("isDef").isNotNull()
    at = F.when(attribute("file").contains("/"), last_two(attribute("file"), attribute("line")))
    fact = lambda when, p, o: F.when(when, F.struct(F.lit(p).alias("p"), o.alias("o")))
    name = basename(attribute("file"))
    all_ = F.array(
        fact(decl & define, "is_defined_file", name), fact(decl & ~define, "is_extern_file", name), fact(~decl & ~define, "is_called_file", name),
        fact(decl, "isDecl_file_line", at), fact(define, "isDef_file_line", at), fact(~decl & ~define, "isUse_file_line", at),
    )
    spelled = nodes.filter(attribute("spelling").isNotNull() & attribute("id").isNotNull())
    return spelled.select(attribute("id").alias("s"), F.explode(F.filter(all_, lambda x: x.isNotNull())).alias("x")).select("s", "x.p", "x.o").filter("o is not null").distinct()


def operands(nodes: DataFrame) -> DataFrame:
    """(s, p, o) of operators of two operands: the first spelled child is written, the others are read."""
    n = parents(nodes).filter(F.col("up_tag").isin("BinaryOperator", "CompoundAssignOperator") & attribute("spelling").isNotNull() & attribute("file").contains("/"))
    nth = F.row_number().over(W.partitionBy("unit", "up").orderBy("node"))
    p = F.when(nth == 1, "isWritten_file_line").otherwise("isRead_file_line")
    return n.select(F.coalesce(attribute("ref_id"), attribute("def_id"), attribute("id")).alias("s"), p.alias("p"), last_two(attribute("file"), attribute("line")).alias("o")).filter("s is not null and o is not null")


#: Attributes that are ids, and tell nothing of what an element says.
IDS = ["id", "lex_parent_id", "sem_parent_id", "def_id", "ref_id", "ref_tmp"]


def _printed(nodes: DataFrame) -> DataFrame:
    """Nodes with ``print``: equal for nodes equal in tag and all attributes but ids; null without an id."""
    said = F.map_filter("attrs", lambda k, v: ~k.isin(IDS))
    print_ = F.sha2(F.concat_ws("\u0001", "tag", F.to_json(F.sort_array(F.map_entries(said)))), 256)
    return nodes.withColumn("print", F.when(attribute("id").isNotNull(), print_))


def uniform(nodes: DataFrame) -> DataFrame:
    """(id, new): nodes equal in tag and all attributes but ids share the id of the one that ends first."""
    k = _printed(nodes).filter("print is not null").select(attribute("id").alias("id"), "print", F.struct("unit", "post").alias("at"))
    first = k.groupBy("print").agg(F.min_by("id", "at").alias("new"))
    return k.join(first, "print").groupBy("id").agg(F.min_by("new", "at").alias("new"))


def pruned(nodes: DataFrame) -> DataFrame:
    """Nodes without the subtrees that are repeated whole.

    A node repeats another if one that is equal but for its ids ended before it.
    Leaves that repeat others go, then what has thereby become a leaf and repeats
    others too, until nothing changes: a node stays if it, or any node in its
    subtree, is new.  A subtree is a range of nodes, so that is one look at the
    next new node, however deep the tree.  Nodes without an id always stay.
    """
    from .. import shared
    from ..operators.windows import following

    # texts are parsed once
    told = shared.stored(_printed(nodes), "nodes")
    first = told.filter("print is not null").groupBy("print").agg(F.min(F.struct("unit", "post")).alias("first"))
    told = told.join(first, "print", "left").withColumn("new", F.col("print").isNull() | (F.col("first") == F.struct("unit", "post")))
    ahead = following(told, ["unit"], ["node"], F.when(F.col("new"), F.col("node")), "next_new")
    return ahead.filter(F.col("new") | (F.col("next_new") <= F.col("last"))).select(nodes.columns)
