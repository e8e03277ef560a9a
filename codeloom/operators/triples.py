"""Entities and properties: unpivoted facts, star lookups, attribute tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLES = "s string, ns string, p string, o string"


def unpivot(df: DataFrame, key: Column, ns: str, properties: dict[str, Column]) -> DataFrame:
    """One row (s, ns, p, o) for each property that an entity has, in a single pass."""
    pairs = F.array(*(F.struct(F.lit(p).alias("p"), c.cast("string").alias("o")) for p, c in properties.items()))
    rows = df.select(key.cast("string").alias("s"), F.lit(ns).alias("ns"), F.explode(pairs).alias("x"))
    return rows.select("s", "ns", "x.p", "x.o").filter("o is not null")


def merge(*graphs: DataFrame) -> DataFrame:
    """Union of graphs as sets of triples; absent operands are None."""
    return reduce(DataFrame.unionByName, [g for g in graphs if g is not None]).distinct()


def with_value(triples: DataFrame, value: str) -> DataFrame:
    """Triples whose object is ``value`` under any property."""
    return triples.filter(F.col("o") == value)


def having(triples: DataFrame, *properties: str) -> DataFrame:
    """Entities that have all these properties."""
    some = triples.filter(F.col("p").isin(*properties)).groupBy("s").agg(F.count_distinct("p").alias("n"))
    return some.filter(F.col("n") == len(set(properties))).select("s")


def wide(triples: DataFrame, properties: list[str]) -> DataFrame:
    """One row an entity: a sorted array of the values of each property."""
    return triples.filter(F.col("p").isin(properties)).groupBy("s").agg(*(F.sort_array(F.collect_set(F.when(F.col("p") == p, F.col("o")))).alias(p) for p in properties))


def children(symbols: DataFrame, parent: str, key: str = "s", up: str = "lex_parent_id", name: str = "spelling") -> DataFrame:
    """Symbols whose lexical parent is called ``parent``: a filter on the parents, then one equi-join."""
    of = symbols.filter(F.col(name) == parent).select(F.col(key).alias("parent_key"))
    return symbols.join(of, F.col(up) == F.col("parent_key"), "left_semi")
