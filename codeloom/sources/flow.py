"""Control-flow text: sections between separator lines hold blocks and calls by turns.

A block section: ``function file``, the number of blocks, then a line
``id [range] [predecessors] [successors]`` each, where ENTRY and EXIT stand for
the range.  A call section: a number, then ``caller: [callee,callee,]`` lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sections(files: DataFrame, separator: str) -> DataFrame:
    """(path, nth, lines) of each section that is not empty.  ``files``: path, value (a whole text)."""
    parts = F.filter(F.transform(F.split("value", f"(?m)^\\Q{separator}\\E$"), F.trim), lambda x: F.regexp_replace(x, r"\s", "") != "")
    rows = files.select("path", F.posexplode(parts).alias("nth", "body"))
    return rows.select("path", "nth", F.filter(F.transform(F.split("body", "\n"), F.trim), lambda x: x != "").alias("lines"))


def _ints(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))


def blocks(parts: DataFrame) -> DataFrame:
    """(path, func, file, id, kind, range, succ, pred); a block without a range has that of the one before."""
    own = parts.filter("nth % 2 = 0").select("path", F.get("lines", F.lit(0)).alias("head"), F.explode(F.slice("lines", 3, F.greatest(F.size("lines"), F.lit(1)))).alias("line"))
    p = r"^(\d+) (ENTRY|EXIT|\[[^\]]*\]) \[([^\]]*)\] \[([^\]]*)\]$"
    g = lambda i: F.regexp_extract("line", p, i)
    cut = own.filter(F.col("line").rlike(p)).select("path", F.split("head", " ", 2).alias("head"), g(1).cast("int").alias("id"), g(2).alias("at"), g(3).alias("one"), g(4).alias("two"))
    kind = F.when(F.col("at").isin("ENTRY", "EXIT"), F.col("at")).otherwise("BLOCK")
    span = _ints(F.regexp_replace("at", r"[\[\]]", ""))
    place = F.when((kind == "BLOCK") & (F.size(span) == 4), F.struct(F.struct(span[0].alias("line"), span[1].alias("col")).alias("first"), F.struct(span[2].alias("line"), span[3].alias("col")).alias("last")))
    out = cut.select("path", F.get("head", F.lit(0)).alias("func"), F.get("head", F.lit(1)).alias("file"), "id", kind.alias("kind"), place.alias("own"), _ints(F.col("one")).alias("one"), _ints(F.col("two")).alias("two"))
    w = W.partitionBy("path", "func").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    filled = F.when(F.col("kind") == "BLOCK", F.last("own", ignorenulls=True).over(w))
    return out.select("path", "func", "file", "id", "kind", filled.alias("range"), F.col("one").alias("pred"), F.col("two").alias("succ"))


def edges(of: DataFrame) -> DataFrame:
    """(func, src, dst) between blocks of a function."""
    return of.select("func", F.col("id").alias("src"), F.explode("succ").alias("dst")).distinct()


def calls(parts: DataFrame) -> DataFrame:
    """(caller, callee), each once over all units."""
    lines = parts.filter("nth % 2 = 1").select(F.explode("lines").alias("line"))
    p = r"^(.+): \[(.*)\]$"
    some = lines.filter(F.col("line").rlike(p)).select(F.regexp_extract("line", p, 1).alias("caller"), F.explode(F.split(F.regexp_extract("line", p, 2), ",")).alias("callee"))
    return some.filter("trim(callee) <> ''").distinct()
