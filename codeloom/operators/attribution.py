"""Attribution: calls and accesses to blocks, comments to symbols, values along chains of references."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_along(rows: DataFrame, key: str, to: str, value: str) -> DataFrame:
    """(key, value): each row's value, or else the first one along its references.

    References are followed by doubling, so that a chain of n takes log2(n)
    rounds; a chain without a value, or into a cycle without one, has null.
    """
    now = rows.select(F.col(key).alias("id"), F.col(to).alias("to"), F.col(value).alias("value")).checkpoint()
    for _ in range(now.count().bit_length() + 1):
        if now.filter("value is null and to is not null").isEmpty():
            break
        far = now.select(F.col("id").alias("mid"), F.col("to").alias("far"), F.col("value").alias("far_value"))
        now = now.join(far, F.col("to") == F.col("mid"), "left").select("id", F.when(F.col("value").isNull(), F.col("far")).alias("to"), F.coalesce("value", "far_value").alias("value")).checkpoint()
    return now.select(F.col("id").alias(key), F.col("value").alias(value))


def merged_attributes(rows: DataFrame, key: str, to: str, attrs: str) -> DataFrame:
    """Each row's map of attributes, filled up with those of the row that it refers to; its own win."""
    other = rows.select(F.col(key).alias("__key"), F.col(attrs).alias("__attrs"))
    out = rows.join(other, F.col(to) == F.col("__key"), "left")
    lacking = F.map_filter(F.coalesce("__attrs", F.create_map().cast(rows.schema[attrs].dataType)), lambda k, v: ~F.map_contains_key(F.col(attrs), k))
    return out.withColumn(attrs, F.map_concat(F.col(attrs), lacking)).select(rows.columns)


def unique_match(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``left`` with the ``value`` of the one row of ``right`` that has its keys; where either side has several, null."""
    one = right.groupBy(*keys).agg(F.first(value).alias("__value"), F.count("*").alias("__n")).filter("__n = 1").drop("__n")
    alone = left.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n = 1").drop("__n")
    return left.join(alone.join(one, keys), keys, "left").withColumnRenamed("__value", value)


#: Pairs that a task makes, about.
PAIRS = 5_000_000


def pairs(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """(a, b): ordered pairs of different members of each group, as the siblings of an overloaded name.

    The result has as many rows as there are pairs; groups are meant to be small
    (``overload_groups`` counts siblings without making pairs).  Tasks are as many
    as the pairs ask for, and the left side of a large group is dealt out to several.
    """
    a, b = (rows.select(*group, F.col(key).alias(c)) for c in "ab")
    sizes = rows.groupBy(*group).agg(F.count("*").alias("__n"))
    made = sizes.agg(F.sum(F.col("__n").cast("double") * F.col("__n")), F.max("__n")).first()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((made[0] or 0) / PAIRS))
    if (made[1] or 0) ** 2 <= PAIRS:
        # a number of tasks that is asked for is kept, however few bytes go in
        return a.repartition(tasks, *group).join(b.repartition(tasks, *group).hint("merge"), group).filter("a <> b").select("a", "b")
    large = sizes.withColumn("__cuts", F.ceil(F.col("__n").cast("double") * F.col("__n") / PAIRS).cast("int")).filter("__cuts > 1").drop("__n")
    a, b = (x.join(large.hint("merge"), group, "left").withColumn("__cuts", F.coalesce("__cuts", F.lit(1))) for x in (a, b))
    a = a.withColumn("__cut", F.pmod(F.xxhash64("a"), F.col("__cuts")).cast("int")).drop("__cuts").repartition(tasks, *group, "__cut")
    b = b.withColumn("__cut", F.explode(F.sequence(F.lit(0), F.col("__cuts") - 1))).drop("__cuts").repartition(tasks, *group, "__cut")
    return a.join(b.hint("merge"), [*group, "__cut"]).filter("a <> b").select("a", "b")


def in_load_order(rows: DataFrame, loaded: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of loaded images, with the place of each in the order of loading."""
    return rows.join(loaded.groupBy(key).agg(F.min(position).alias(position)), key)


def call_sites(calls: DataFrame, sites: DataFrame, keys: list[str], site: str) -> DataFrame:
    """Calls of a trace with all expressions that stand at their place and name their callee."""
    some = sites.groupBy(*keys).agg(F.sort_array(F.collect_set(site)).alias("sites"))
    return calls.join(some, keys)


def in_blocks(places: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Places (first, last: structs of line and column) with the blocks of their file or function that hold either end.

    An equi-join on ``keys``, then the comparison of structs by line and column.
    """
    inside = lambda c: (F.col(c) >= F.col("begin")) & (F.col(c) <= F.col("end"))
    return places.join(blocks, keys).filter(inside("first") | inside("last"))


def scope_ends(lines: DataFrame, part: str, order: str, opens: Column, closes: Column, comment: Column) -> DataFrame:
    """Comments with ``scope_end``: the brace that closes the scope they stand in, or the next comment of that scope if it comes first.

    ``opens`` and ``closes`` count the braces of a line (none or one).  Without
    either the scope reaches to the end of the text: its last line.
    """
    w = W.partitionBy(part).orderBy(order)
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    deep = lines.withColumn("__opens", opens).withColumn("__closes", closes).withColumn("__comment", comment)
    deep = deep.withColumn("__depth", F.sum(step).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("eof", F.max(order).over(W.partitionBy(part)))
    # a closing brace ends the depth that it had just ahead of it
    deep = deep.filter("__closes or __comment").withColumn("level", F.col("__depth") + F.when(F.col("__closes"), 1).otherwise(0))
    after = W.partitionBy(part, "level").orderBy(order).rowsBetween(1, W.unboundedFollowing)
    ends = F.coalesce(F.first(F.col(order)).over(after), F.col("eof"))
    return deep.withColumn("scope_end", ends).filter("__comment").select(*lines.columns, "level", "scope_end")


def propagated(tokens: DataFrame, scopes: DataFrame, comment: str, symbol: str) -> DataFrame:
    """(symbol, word, n): the words of comments, copied to every symbol in the comments' scopes.

    Either side tells a comment's words and symbols once, so that their product
    holds each comment once and is counted without a look at comments.
    """
    words, symbols = (x.select(comment, c).repartition(comment).distinct() for x, c in ((tokens, "word"), (scopes, symbol)))
    return words.join(symbols.hint("merge"), comment).groupBy(symbol, "word").agg(F.count("*").alias("n"))
