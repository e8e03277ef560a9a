"""Graph operators: pointer chasing, closures, typed edges, coverage."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared


def fixpoint(pointers: DataFrame, key: str = "id", to: str = "to") -> DataFrame:
    """(id, root): follow pointers to their ends by doubling; null ends a chain.

    A chain that runs into a cycle has the cycle's smallest node as its root.
    Each row carries the smallest node of the way it has covered, which doubles
    every round; after log2(rows) rounds only ways into cycles still move, and
    what lies behind them is one whole round of their cycle.
    """
    end = F.col(to).isNull() | (F.col(to) == F.col(key))
    now = pointers.select(F.col(key).alias("id"), F.coalesce(to, key).alias("to"), F.col(key).alias("low"), end.alias("done")).checkpoint()
    for _ in range(now.count().bit_length() + 1):
        if now.filter("not done").isEmpty():
            break
        far = now.select(F.col("id").alias("mid"), F.col("to").alias("far"), F.col("low").alias("far_low"), F.col("done").alias("far_done"))
        step = now.join(far, F.col("to") == F.col("mid"), "left")
        go = ~F.col("done") & F.col("mid").isNotNull()  # a pointer to an id that is not there ends its chain
        now = step.select(
            "id", F.when(go, F.col("far")).otherwise(F.col("to")).alias("to"), F.when(go, F.least("low", "far_low")).otherwise(F.col("low")).alias("low"), F.when(go, F.col("far_done")).otherwise(F.lit(True)).alias("done"),
        ).checkpoint()
    cycles = now.filter("not done").select(F.col("id").alias("mid"), F.col("low").alias("cycle"))
    return now.join(cycles, (F.col("to") == F.col("mid")) & ~F.col("done"), "left").select("id", F.coalesce("cycle", "to").alias("root"))


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(root, node, level) reachable from ``start`` (root, and node where it is another): semi-naive, each node at its least level.

    Fronts are stored: a checkpoint keeps what its plan knew of its columns, which doubles with every level.
    """
    node = "node" if "node" in start.columns else "root"
    edges = shared.stored(edges.select("src", "dst").distinct(), "edges")
    front = seen = shared.stored(start.select("root", F.col(node).alias("node"), F.lit(0).alias("level")).distinct(), "front")
    for k in itertools.count(1):  # nodes that were seen do not come again, so fronts run out
        new = front.join(edges, front.node == edges.src).select("root", F.col("dst").alias("node")).distinct()
        front = shared.stored(new.join(seen, ["root", "node"], "left_anti").withColumn("level", F.lit(k)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)  # a union of stored fronts repeats no work
        if k % 8 == 0:  # and few parts keep its scans few
            seen = shared.stored(seen.repartition("root", "node"), "seen")
    return seen


def dynamic_only(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Edges seen at run time that the program text does not show (virtual calls)."""
    return dynamic.select("src", "dst").distinct().join(static.select("src", "dst"), ["src", "dst"], "left_anti")


def dot(edges: DataFrame, label: str | None = None) -> DataFrame:
    """Edges as lines of the DOT language, each once."""
    line = F.format_string('"%s"->"%s"[label="%s"]', "src", "dst", label) if label else F.format_string('"%s"->"%s"', "src", "dst")
    return edges.select(line.alias("line")).distinct()


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """What one node's edges lead to."""
    return edges.filter(F.col("src") == node).select("dst").distinct()
