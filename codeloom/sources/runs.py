"""Run configurations in JSON, compacted traces and comments in XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared
from .syntax import attribute, parents
from .trace import LOCK

CONFIG = "runs map<string,map<string,int>>, comments map<string,string>, vcs map<string,string>"


def _configuration(texts: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    kept = [c for c in texts.columns if c != column]
    return texts.select(*kept, F.from_json(column, CONFIG).alias("c")), kept


def configurations(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row for each input of each program: exe, input and how often it runs (other columns stay)."""
    read, kept = _configuration(texts, column)
    return read.select(*kept, F.explode("c.runs").alias("exe", "inputs")).select(*kept, "exe", F.explode("inputs").alias("input", "times"))


def settings(texts: DataFrame, column: str = "value") -> DataFrame:
    """(section, key, value): what a configuration says on comments and on version control (other columns stay)."""
    read, kept = _configuration(texts, column)
    both = F.map_filter(F.create_map(F.lit("comments"), F.col("c.comments"), F.lit("vcs"), F.col("c.vcs")), lambda k, v: v.isNotNull())
    return read.select(*kept, F.explode(both).alias("section", "m")).select(*kept, "section", F.explode("m").alias("key", "value"))


def _up(name: str) -> Column:
    return F.try_element_at("up_attrs", F.lit(name))


def records(nodes: DataFrame) -> DataFrame:
    """The records of compacted traces: events of a DYNAMICTRACE, and the accesses in its IO blocks.

    unit, run, input, exe of the trace; nth (order of the text), within (the IO
    block's nth, or null), rectype, seq, thread, func, invno, attrs, and locks:
    address and type of each POSIXLOCK of an access.  An access takes what it
    lacks from its IO block.  ``seq`` is the number at the end of TS, else of the
    first read or write.  Blocks themselves are rows too.
    """
    # texts are parsed once, and a row looks for its parent among traces or blocks only
    nodes = shared.stored(nodes, "nodes")
    traces = nodes.filter("tag = 'DYNAMICTRACE'").select("unit", F.col("node").alias("up"), attribute("RUNID").alias("run"), attribute("INP").alias("input"), attribute("EXE").alias("exe"))
    own = nodes.join(traces, ["unit", "up"]).select("unit", "run", "input", "exe", F.col("node").alias("nth"), F.lit(None).cast("int").alias("within"), F.col("tag").alias("rectype"), "attrs")
    blocks = own.filter("rectype = 'IO'").select("unit", "run", "input", "exe", F.col("nth").alias("up"), F.col("attrs").alias("of_block"))
    inner = nodes.filter("tag <> 'POSIXLOCK'").join(blocks, ["unit", "up"])
    lacking = F.map_filter("of_block", lambda k, v: ~F.map_contains_key("attrs", k))
    inner = inner.select("unit", "run", "input", "exe", F.col("node").alias("nth"), F.col("up").alias("within"), F.col("tag").alias("rectype"), F.map_concat("attrs", lacking).alias("attrs"))
    locks = nodes.filter("tag = 'POSIXLOCK'").groupBy("unit", F.col("up").alias("nth")).agg(F.array_sort(F.collect_list(F.struct("node", attribute("ADDRESS").alias("address"), attribute("TYPE").alias("type")))).alias("locks"))
    number = lambda name: F.regexp_extract(attribute(name), r"(\d+)$", 1).try_cast("long")
    rows = own.unionByName(inner).join(locks, ["unit", "nth"], "left")
    return rows.select(
        "unit", "run", "input", "exe", "nth", "within", "rectype", F.coalesce(number("TS"), F.least(number("FIRSTREAD"), number("FIRSTWRITE"))).alias("seq"),
        F.coalesce(attribute("THREADID"), attribute("TID")).alias("thread"), attribute("FUNCNAME").alias("func"), attribute("INVNO").try_cast("int").alias("invno"), "attrs",
        F.coalesce(F.transform("locks", lambda x: F.struct(x["address"], x["type"])), F.array().cast(f"array<{LOCK}>")).alias("locks"),
    )


def comments(nodes: DataFrame) -> DataFrame:
    """(unit, node, comment, text, first, last, file): each comment with the lines of its scope."""
    line = lambda name: attribute(name).try_cast("int")
    return nodes.filter("tag = 'COMMENT'").select(
        "unit", "node", attribute("comment_id").alias("comment"), attribute("comment_text").alias("text"), line("comment_scope_start").alias("first"), line("comment_scope_end").alias("last"), attribute("src_file_location").alias("file"),
    )


def _below(nodes: DataFrame, *groups: str) -> DataFrame:
    """The elements of a comment's groups: unit, comment, group, tag, attrs."""
    n = parents(nodes)
    of = n.filter(F.col("tag").isin(*groups) & (F.col("up_tag") == "COMMENT")).select("unit", F.col("node").alias("up"), _up("comment_id").alias("comment"), F.col("tag").alias("group"))
    return nodes.select("unit", "up", "tag", "attrs").join(of, ["unit", "up"])


def comment_symbols(nodes: DataFrame) -> DataFrame:
    """(unit, comment, symbol, kind, spelling, type): the symbols in each comment's scope; kind is the element's name."""
    return _below(nodes, "SYMBOLS").select("unit", "comment", attribute("id").alias("symbol"), F.col("tag").alias("kind"), attribute("spelling").alias("spelling"), attribute("type").alias("type"))


def comment_domains(nodes: DataFrame) -> DataFrame:
    """(unit, comment, domain, word, type): what a comment is about, of the program's or the problem's domain."""
    of = _below(nodes, "PROGRAM_DOMAINS", "PROBLEM_DOMAINS")
    # files spell the element of the former without its first R
    some = of.filter(F.col("tag").isin("POGRAM_DOMAIN", "PROGRAM_DOMAIN", "PROBLEM_DOMAIN"))
    return some.select("unit", "comment", F.when(F.col("group") == "PROGRAM_DOMAINS", "program").otherwise("problem").alias("domain"), attribute("word").alias("word"), F.trim(attribute("type")).alias("type"))
