"""Writers: triples as Turtle lines, graphs as DOT, token lists, answers as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import dot


def _quoted(value: Column) -> Column:
    for plain, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        value = F.replace(value, F.lit(plain), F.lit(mark))
    return F.concat(F.lit('"'), value, F.lit('"'))


def turtle(triples: DataFrame, base: str) -> DataFrame:
    """(value): a statement a line.  ``triples``: s, ns, p, o and, where they have one, o_ns: the class of a linked entity."""
    link = F.concat(F.lit(f"<{base}"), F.col("o_ns"), F.lit("#"), F.col("o"), F.lit(">")) if "o_ns" in triples.columns else F.lit(None).cast("string")
    return triples.filter("o is not null").select(F.concat(F.lit(f"<{base}"), "ns", F.lit("#"), "s", F.lit(f"> <{base}properties#"), "p", F.lit("> "), F.coalesce(link, _quoted(F.col("o"))), F.lit(" .")).alias("value"))


def write_turtle(triples: DataFrame, path: str, base: str) -> None:
    turtle(triples, base).write.text(path)


def write_triples(triples: DataFrame, path: str) -> None:
    """Parquet by property, so that a question reads those it asks for."""
    triples.repartition("p", F.pmod(F.xxhash64("s"), F.lit(64))).write.partitionBy("p").parquet(path)


def write_dot(edges: DataFrame, path: str, label: str | None = None) -> None:
    """The edges' lines; a reader puts them between ``digraph G{`` and ``}``."""
    dot(edges, label).write.text(path)


def answer_column(labels: dict[str, str]) -> Column:
    """A row as lines ``label: value``, in the labels' order, without those that are null."""
    line = lambda c, t: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{t}: "), F.col(c).cast("string")))
    return F.concat_ws("\n", *(line(c, t) for c, t in labels.items()))


def answer(rows: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(value): each row as labelled lines."""
    return rows.select(answer_column(labels).alias("value"))
