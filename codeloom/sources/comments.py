"""Comments of source texts: where they stand, runs of line comments, what they are about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A comment to the end of the line, or between marks over several lines.
PATTERN = r"//[^\n]*|/\*(?s:.*?)\*/"


def extract(files: DataFrame, key: str = "path", column: str = "value") -> DataFrame:
    """(key, nth, text, first, last): each comment of a text with its lines, counted from 1.

    Splitting by the pattern gives the stretches between comments; lines are
    counted over stretches and comments in turn.
    """
    both = files.select(key, F.regexp_extract_all(column, F.lit(PATTERN), 0).alias("found"), F.split(F.col(column), PATTERN).alias("between")).filter(F.size("found") > 0)
    rows = both.select(key, F.posexplode(F.arrays_zip("found", F.slice("between", 1, F.size("found")).alias("between"))).alias("nth", "x"))
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    rows = rows.select(key, "nth", F.col("x.found").alias("text"), breaks(F.col("x.between")).alias("gap"), breaks(F.col("x.found")).alias("own"))
    w = W.partitionBy(key).orderBy("nth")
    first = 1 + F.sum("gap").over(w) + F.coalesce(F.sum("own").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.select(key, "nth", "text", first.alias("first"), (first + F.col("own")).alias("last"))


def bundled(comments: DataFrame, key: str = "path") -> DataFrame:
    """Line comments on lines that follow each other become one."""
    w = W.partitionBy(key).orderBy("nth")
    line = F.col("text").startswith("//")
    joins = line & F.lag(line).over(w) & (F.col("first") == F.lag("last").over(w) + 1)
    marked = comments.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "\n")
    return runs.groupBy(key, "run").agg(text.alias("text"), F.min("first").alias("first"), F.max("last").alias("last"))


def without_licences(comments: DataFrame) -> DataFrame:
    return comments.filter(~F.col("text").contains("Copyright (c)"))


def in_scope(comments: DataFrame, symbols: DataFrame, key: str = "path") -> DataFrame:
    """Comments (first, scope_end) with the symbols (s, begin, end) of their file whose lines reach the scope's end from its start."""
    return comments.join(symbols, key).filter((F.col("first") <= F.col("end")) & (F.col("scope_end") >= F.col("end")))


def about(comments: DataFrame, vocabulary: DataFrame, key: list[str]) -> DataFrame:
    """(key, word, kind): words of one to three parts that the vocabulary (word, kind) knows."""
    from ..functions.names import grams

    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    return comments.select(*key, F.explode(F.array_distinct(grams(words))).alias("word")).join(vocabulary, "word").select(*key, "word", "kind")
