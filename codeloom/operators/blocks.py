"""Control-flow blocks cut at the calls in them, with edges into the called functions and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import shared

#: Lines of a bin: ranges meet by bins of lines, so that no function is compared whole with itself.
BIN = 32


def _bins(first: str, last: str):
    return F.explode(F.sequence(F.floor(F.col(first)["line"] / BIN), F.greatest(F.floor(F.col(first)["line"] / BIN), F.floor(F.col(last)["line"] / BIN))))


def containing(ranges: DataFrame, places: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``places`` (key, first, last) with the range (key, begin, end) that holds both ends: the innermost, then the first by ``order``.

    Ends are structs of line and column.  A place in no range is left out.  The
    innermost is the one that begins last, then the one that ends first; a range
    that only touches the place, as it begins where the place ends, comes last.
    """
    cut = ranges.withColumn("__bin", _bins("begin", "end"))
    met = places.withColumn("__bin", F.floor(F.col("first")["line"] / BIN)).join(cut, [key, "__bin"])
    met = met.filter((F.col("begin") <= F.col("first")) & (F.col("last") <= F.col("end")))
    back = lambda c: F.struct((-F.col(c)["line"]).alias("line"), (-F.col(c)["col"]).alias("col"))
    held = [c for c in ranges.columns if c != key]
    # a place has one bin: with it the rows are grouped where they met
    best = met.groupBy(*places.columns, "__bin").agg(F.min_by(F.struct(*held), F.struct((F.col("begin") == F.col("last")).alias("touch"), back("begin").alias("a"), F.col("end").alias("b"), *order)).alias("__in"))
    return best.select(*places.columns, *(F.col("__in")[c].alias(c) for c in held))


def split_at_calls(blocks: DataFrame, calls: DataFrame) -> DataFrame:
    """(func, id, piece, begin, end, callee): each block cut where its calls end.

    ``blocks``: func, id, kind (ENTRY, EXIT or BLOCK), begin, end (structs of line
    and column; null without text), succ.  ``calls``: func, call, callee, first,
    last.  Pieces count from 0 and share their ends; ``callee`` is what the piece's
    end calls, null for the last one.  Calls are taken by where they end, so that
    in ``a(b(), c())`` b and c come ahead of a; of equal ends the one that begins
    later is the inner one and comes first.
    """
    spans = blocks.filter("begin is not null and end is not null").select("func", "id", "begin", "end")
    own = containing(spans, calls.select("func", "call", "callee", "first", "last"), "func", ["id"]).withColumn("tail", F.lit(False))
    none = lambda c: F.lit(None).cast(own.schema[c].dataType).alias(c)
    # each block stands behind its calls as the piece that is left, so that one shuffle cuts both
    left = blocks.select("func", none("call"), none("callee"), none("first"), none("last"), "id", "begin", "end", F.lit(True).alias("tail"))
    w = W.partitionBy("func", "id").orderBy("tail", "last", F.desc("first"), "call").rowsBetween(W.unboundedPreceding, -1)
    cut = own.unionByName(left).withColumn("piece", F.coalesce(F.sum((~F.col("tail")).cast("int")).over(w), F.lit(0)).cast("int")).withColumn("before", F.last("last", ignorenulls=True).over(w))
    return cut.select("func", "id", "piece", F.coalesce("before", "begin").alias("begin"), F.coalesce("last", "end").alias("end"), "callee")


def interprocedural(blocks: DataFrame, pieces: DataFrame) -> DataFrame:
    """(src, dst, kind) between pieces (structs of func, id, piece).

    FLOW: the last piece of a block to the first ones of its successors.  CALL: a
    piece that ends in a call to the callee's entry.  RETURN: the callee's exit to
    the piece behind the call.  Without a block so marked the first one is the
    entry and the last one the exit; a callee without blocks has one of its own, id 0.
    """
    pieces = shared.stored(pieces, "pieces")
    node = lambda f, i, p: F.struct(F.col(f).alias("func"), F.col(i).alias("id"), p.alias("piece"))
    zero = F.lit(0)
    tails = pieces.groupBy("func", "id").agg(F.max("piece").alias("last"))
    flow = blocks.select("func", "id", F.explode("succ").alias("to")).join(tails, ["func", "id"])
    flow = flow.select(node("func", "id", F.col("last")).alias("src"), node("func", "to", zero).alias("dst"), F.lit("FLOW").alias("kind"))
    ends = tails.join(blocks.select("func", "id", "kind"), ["func", "id"]).groupBy(F.col("func").alias("callee")).agg(
        F.coalesce(F.min(F.when(F.col("kind") == "ENTRY", F.col("id"))), F.min("id")).alias("entry"),
        F.coalesce(F.min(F.when(F.col("kind") == "EXIT", F.struct("id", "last"))), F.max(F.struct("id", "last"))).alias("exit"),
    )
    made = pieces.filter("callee is not null").join(ends, "callee", "left")
    entry = F.coalesce("entry", zero)
    exit_ = F.coalesce("exit", F.struct(zero.cast(blocks.schema["id"].dataType).alias("id"), zero.alias("last")))
    here = node("func", "id", F.col("piece"))
    into = made.select(here.alias("src"), F.struct(F.col("callee").alias("func"), entry.alias("id"), zero.alias("piece")).alias("dst"), F.lit("CALL").alias("kind"))
    back = made.select(F.struct(F.col("callee").alias("func"), exit_["id"].alias("id"), exit_["last"].alias("piece")).alias("src"), node("func", "id", F.col("piece") + 1).alias("dst"), F.lit("RETURN").alias("kind"))
    return flow.unionByName(into).unionByName(back)


def attributed(records: DataFrame, uses: DataFrame, pieces: DataFrame) -> DataFrame:
    """(record, func, id, piece): records of a trace by the block in which what they name stands.

    ``records``: record, func, name, line.  ``uses``: func, name, line, at (places of
    the program text that name it: where a variable begins, or a call ends).  All
    uses on the record's line are looked for; of the blocks that hold one the
    first counts, else the function's first.
    """
    pieces = shared.stored(pieces, "pieces")
    spans = pieces.filter("begin is not null and end is not null").select("func", "id", "piece", "begin", "end")
    # equal places are one group of ``containing``
    places = uses.select("func", "name", "line", F.col("at").alias("first"), F.col("at").alias("last"))
    found = containing(spans, places, "func", ["id", "piece"]).groupBy("func", "name", "line").agg(F.min(F.struct("id", "piece")).alias("at"))
    first = pieces.groupBy("func").agg(F.min(F.struct("id", "piece")).alias("first"))
    out = records.join(found, ["func", "name", "line"], "left").join(first, "func").withColumn("at", F.coalesce("at", "first"))
    return out.select("record", "func", "at.id", "at.piece")
