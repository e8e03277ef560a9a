"""Tab-separated linkage tables; a line that begins with # is a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import address

#: Columns by kind of table (fixed values of the format).
COLUMNS = {
    "calls": ["filename", "location", "funcname", "callnodeid", "callexpr"],
    "offset": ["filename", "function", "offset", "varname", "varid", "vartype", "varsize", "parentid"],
    "address": ["address", "varname", "varid", "vartype", "varsize", "parentid", "varclass", "varcontainer"],
}


def _fields(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"))


def parse(lines: DataFrame, kind: str) -> DataFrame:
    """Rows of a table with a fixed number of fields; absent ones are null, as is ``None``."""
    field = lambda i: F.nullif(F.trim(F.get("f", F.lit(i))), F.lit("None"))
    return _fields(lines).select(*(field(i).alias(c) for i, c in enumerate(COLUMNS[kind])))


def parse_signatures(lines: DataFrame) -> DataFrame:
    """(filename, funcnodeid, funcname, nargs, argtypes, rettype): as many types as the line has between count and result."""
    f = _fields(lines).filter(F.size("f") >= 5)
    g = lambda i: F.get("f", F.lit(i))
    return f.select(g(0).alias("filename"), g(1).alias("funcnodeid"), g(2).alias("funcname"), g(3).try_cast("int").alias("nargs"), F.slice("f", 5, F.size("f") - 5).alias("argtypes"), F.element_at("f", -1).alias("rettype"))


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    lines = spark.read.text(path)
    return parse_signatures(lines) if kind == "funcargs" else parse(lines, kind)


def relocated(table: DataFrame, load: Column) -> DataFrame:
    """Addresses at run time: an image's load address plus the address in its file."""
    return table.withColumn("at", load + address(F.col("address")))


def filled(table: DataFrame, symbols: DataFrame) -> DataFrame:
    """Addresses of -1 from the symbol table (varname, address); rows that neither has go."""
    known = symbols.select("varname", F.col("address").alias("known")).dropDuplicates(["varname"])
    out = table.join(known, "varname", "left").withColumn("address", F.when(F.col("address") == "-1", F.col("known")).otherwise(F.col("address")))
    return out.filter("address is not null").select(*table.columns)


def remapped(table: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """Id columns through (id, new); ids without a new one stay, empty ids go."""
    out = table
    for c in columns:
        m = ids.select(F.col("id").alias(c), F.col("new").alias("__new"))
        out = out.filter(F.col(c) != "").join(m, c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
    return out.select(*table.columns)
