"""Ranges of a text joined with its tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def texts_of(tokens: DataFrame, ranges: DataFrame, lines_a_bin: int = 16) -> DataFrame:
    """``ranges`` (file, id, first, last) with ``text``: the tokens from ``first`` on and ahead of ``last``, one space between them.

    ``tokens``: file, at, token; places are structs of line and column.  Tokens meet
    ranges by bins of lines: a token's bin is its own, a range has those that it
    reaches into.  A range within another has its own text; tokens of several
    lines are left out, and a range without tokens has an empty text.
    """
    some = tokens.filter(~F.col("token").contains("\n")).select("file", (F.floor(F.col("at")["line"] / lines_a_bin)).alias("bin"), "at", "token")
    low, high = (F.floor(F.col(c)["line"] / lines_a_bin) for c in ("first", "last"))
    wanted = ranges.select("file", "id", "first", "last", F.explode(F.sequence(low, F.greatest(low, high))).alias("bin"))
    met = wanted.join(some, ["file", "bin"]).filter((F.col("at") >= F.col("first")) & (F.col("at") < F.col("last")))
    # each bin's tokens are joined where they meet; a range then joins its bins
    part = met.groupBy("file", "id", "bin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), " ").alias("part"))
    whole = part.groupBy("file", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin", "part"))), lambda x: x["part"]), " ").alias("text"))
    return ranges.join(whole, ["file", "id"], "left").withColumn("text", F.coalesce("text", F.lit("")))
