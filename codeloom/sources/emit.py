"""Writers of tables and documents that tracers and graph viewers read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared
from .syntax import FUNCTIONS, attribute

SIGNATURES = "# FILENAME\tFUNCNODEID\tFUNCNAME\tNARGS\tARGTYPE*\tRETTYPE"
ADDRESSES = "# ADDRESS\tVARNAME\tVARID\tVARTYPE\tVARSIZE\tPARENTID\tVARCLASS\t[VARCONTAINER]"
OFFSETS = "# FILENAME\tFUNCTION\tOFFSET\tVARNAME\tVARID\tVARTYPE\tVARSIZE\tPARENTID"
#: Elements whose variables are their own, the first that holds one counts, and the class of such variables.
CONTAINERS = {**dict.fromkeys(FUNCTIONS, "FUNCSTATIC"), "StructDecl": "STRUCTSTATIC", "ClassDecl": "CLASSSTATIC", "UnionDecl": "UNIONSTATIC"}


def signatures(nodes: DataFrame) -> DataFrame:
    """(value): a line for each function with a name for the linker; templates have an empty one and are left out."""
    own = nodes.filter(F.col("tag").isin(*FUNCTIONS) & (attribute("linkage_name") != ""))
    args = F.filter(F.split(F.coalesce(attribute("funcargs"), F.lit("")), ","), lambda x: x != "")
    return own.select(F.concat_ws("\t", attribute("file"), attribute("id"), attribute("linkage_name"), F.size(args).cast("string"), F.array_join(args, "\t"), F.coalesce(attribute("return_type"), F.lit(""))).alias("value"))


def _name() -> Column:
    return F.coalesce(attribute("mangled_name"), attribute("spelling"))


def _held(nodes: DataFrame, variables: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(unit, node, container, rank, first): for each variable the outermost spelled element of ``tags`` around it.

    A subtree is a range of nodes; variables and containers meet by unit and by bins of nodes.
    """
    size = 1024
    boxes = nodes.filter(F.col("tag").isin(*tags) & attribute("spelling").isNotNull()).select("unit", F.col("node").alias("begin"), "last", "tag", _name().alias("container"))
    boxes = boxes.withColumn("bin", F.explode(F.sequence(F.floor(F.col("begin") / size), F.floor(F.col("last") / size))))
    met = variables.select("unit", "node", F.floor(F.col("node") / size).alias("bin")).join(boxes, ["unit", "bin"]).filter("begin < node and node <= last")
    rank = reduce(lambda c, i: c.when(F.col("tag") == tags[i], i), range(1, len(tags)), F.when(F.col("tag") == tags[0], 0))
    return met.groupBy("unit", "node").agg(F.min(F.struct(rank.alias("rank"), "begin", "tag", "container")).alias("box"))


def static_variables(nodes: DataFrame, program: bool = False) -> DataFrame:
    """(address, name, id, type, size, parent, class, container) of variables at fixed addresses, each address once.

    Variables with an address and no offset; with ``program`` external ones without
    address too (address -1, known by their names).  The class is that of the
    first kind of container, in the order of ``CONTAINERS``, that the variable stands
    in; outside of all it is STATIC or GLOBAL.  What stands in a container comes
    ahead of what does not, and then the first of the text.
    """
    nodes = shared.stored(nodes, "nodes")  # texts are parsed once
    fixed = attribute("address").isNotNull()
    if program:
        fixed = fixed | ((F.col("tag") == "VarDecl") & (attribute("linkage_kind") == "external"))
    own = nodes.filter(fixed & attribute("offset").isNull())
    own = own.join(_held(nodes, own, tuple(CONTAINERS)), ["unit", "node"], "left").withColumn("key", F.coalesce(attribute("address"), attribute("mangled_name"), attribute("spelling")))
    kinds = F.create_map(*(F.lit(x) for pair in CONTAINERS.items() for x in pair))
    outside = F.when(attribute("storage_class") == "STATIC", "STATIC").otherwise("GLOBAL")
    rows = own.select(
        "key", F.struct(F.coalesce("box.rank", F.lit(len(CONTAINERS))).alias("rank"), "unit", F.col("box.begin").alias("begin"), "node").alias("at"), F.coalesce(attribute("address"), F.lit("-1")).alias("address"), _name().alias("name"), attribute("id").alias("id"),
        attribute("type").alias("type"), F.coalesce(attribute("size"), F.lit("0")).alias("size"), F.coalesce(attribute("sem_parent_id"), attribute("lex_parent_id"), F.lit("None")).alias("parent"), F.coalesce(kinds[F.col("box.tag")], outside).alias("class"), F.col("box.container").alias("container"),
    )
    kept = [c for c in rows.columns if c not in ("key", "at")]
    return rows.groupBy("key").agg(F.min_by(F.struct(*kept), "at").alias("x")).select("x.*")


def local_variables(nodes: DataFrame) -> DataFrame:
    """(file, function, offset, name, id, type, size, parent) of variables with an offset in their function's frame (the innermost function)."""
    nodes = shared.stored(nodes, "nodes")  # texts are parsed once
    own = nodes.filter(F.col("tag").isin("VarDecl", "ParmDecl") & attribute("offset").isNotNull())
    boxes = nodes.filter(F.col("tag").isin(*FUNCTIONS) & attribute("spelling").isNotNull()).select("unit", F.col("node").alias("begin"), F.col("last").alias("upto"), F.coalesce(attribute("linkage_name"), attribute("spelling")).alias("function"))
    boxes = boxes.withColumn("bin", F.explode(F.sequence(F.floor(F.col("begin") / 1024), F.floor(F.col("upto") / 1024))))
    met = own.withColumn("bin", F.floor(F.col("node") / 1024)).join(boxes, ["unit", "bin"]).filter("begin < node and node <= upto")
    best = met.groupBy("unit", "node").agg(F.max(F.struct("begin", "function")).alias("f"), F.first("attrs").alias("attrs"))
    return best.select(
        attribute("file").alias("file"), F.col("f.function").alias("function"), attribute("offset").alias("offset"), attribute("spelling").alias("name"), attribute("id").alias("id"), attribute("type").alias("type"), F.coalesce(attribute("size"), F.lit("0")).alias("size"),
        F.coalesce(attribute("sem_parent_id"), attribute("lex_parent_id"), F.lit("None")).alias("parent"),
    )


def lines(table: DataFrame) -> DataFrame:
    """(value): rows as tab-separated lines; a null last column is left out."""
    return table.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in table.columns)).alias("value"))


def merged(parts: list[DataFrame], header: str) -> DataFrame:
    """(value): the lines of several units under one header, in no order but that of the header, which comes first (column ``first``)."""
    rows = reduce(DataFrame.unionByName, [p.select("value") for p in parts]).filter(~F.startswith("value", F.lit("#")))
    return rows.sparkSession.createDataFrame([(header,)], "value string").withColumn("first", F.lit(True)).unionByName(rows.withColumn("first", F.lit(False)))


def viewer(graphs: DataFrame, key: str, line: str, order: str) -> DataFrame:
    """(key, value): each graph's lines in the DOT language as one line."""
    some = graphs.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(order, line))).alias("all"))
    return some.select(key, F.concat(F.lit("digraph {"), F.array_join(F.transform("all", lambda x: x[line]), "; "), F.lit("; }")).alias("value"))


def _quoted(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def element(tag: Column, attrs: Column, inner: Column) -> Column:
    """An XML element with its attributes in the order of their names."""
    said = F.array_join(F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), _quoted(e["value"]), F.lit('"'))), "")
    return F.concat(F.lit("<"), tag, said, F.when(inner == "", F.lit("/>")).otherwise(F.concat(F.lit(">"), inner, F.lit("</"), tag, F.lit(">"))))


def trace_documents(records: DataFrame) -> DataFrame:
    """(unit, value): compacted traces as XML, from records as ``runs.records`` gives them."""
    lock = lambda x: F.concat(F.lit('<POSIXLOCK ADDRESS="'), x["address"], F.lit('" TYPE="'), x["type"], F.lit('"/>'))
    rows = shared.stored(records, "records").withColumn("xml", element(F.col("rectype"), F.col("attrs"), F.array_join(F.transform("locks", lock), "")))
    inner = rows.filter("within is not null").groupBy("unit", F.col("within").alias("nth")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "xml"))), lambda x: x["xml"]), "").alias("inner"))
    own = rows.filter("within is null").join(inner, ["unit", "nth"], "left").withColumn("xml", F.when(F.col("inner").isNull(), F.col("xml")).otherwise(element(F.col("rectype"), F.col("attrs"), F.col("inner"))))
    whole = own.groupBy("unit", "run", "input", "exe").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "xml"))), lambda x: x["xml"]), "\n").alias("body"))
    head = F.map_from_arrays(F.array(F.lit("INP"), F.lit("RUNID"), F.lit("EXE")), F.array(*(F.coalesce(c, F.lit("")) for c in ("input", "run", "exe"))))
    return whole.select("unit", element(F.lit("DYNAMICTRACE"), head, F.concat(F.lit("\n"), "body", F.lit("\n"))).alias("value"))
