"""Build logs: directory changes, compiler and archiver commands, dependency edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import last_seen

_SOURCE = r"\.(c|cc|cpp|cxx|C)$"
_OBJECT = r"\.(o|a|so)(\.[0-9.]+)?$"


def normalise(path: Column) -> Column:
    """A path without ``.``, ``..`` and doubled slashes."""
    # a leading dot, which is dropped at the end, keeps the array from being empty
    up = lambda acc: F.when(~F.element_at(acc, -1).isin(".", ".."), F.slice(acc, 1, F.size(acc) - 1)).when(path.startswith("/"), acc).otherwise(F.concat(acc, F.array(F.lit(".."))))
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x)))
    parts = F.aggregate(F.split(path, "/"), F.array(F.lit(".")), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(F.filter(parts, lambda x: x != "."), "/"))


def commands(lines: DataFrame) -> DataFrame:
    """(log, line, dir, tool, target, inputs) of each compiler, linker or archiver call.

    ``lines``: log, line (number in the log), value.  ``cd`` and ``Entering
    directory`` set the directory of what follows; paths are taken relative to it.
    """
    at = last_seen(lines, "log", "line", F.coalesce(*(F.nullif(F.regexp_extract("value", p, 1), F.lit("")) for p in (r"Entering directory [`'](.*?)'", r"^cd (\S+)"))))
    words = F.filter(F.split(F.regexp_replace("value", r"^cd \S+ && ", ""), r"\s+"), lambda x: x != "")
    tool = F.regexp_extract(F.get(F.col("words"), F.lit(0)), r"(?:^|/)(gcc|g\+\+|cc|c\+\+|clang|clang\+\+|ar)(?:-[0-9.]+)?$", 1)
    some = at.withColumn("words", words).withColumn("tool", tool).filter("tool <> ''")
    full = lambda x: normalise(F.when(x.startswith("/") | F.col("current").isNull(), x).otherwise(F.concat(F.col("current"), F.lit("/"), x)))
    after = F.array_position("words", "-o")
    named = F.filter(F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda x: ~x.startswith("-") & (x.rlike(_SOURCE) | x.rlike(_OBJECT)))
    target = F.when(F.col("tool") == "ar", F.get("files", F.lit(0))).when(after > 0, F.get("words", after.cast("int")))
    out = some.withColumn("files", named).withColumn("target", target).filter("target is not null")
    out = out.withColumn("inputs", F.filter("files", lambda x: x != F.col("target")))
    return out.select("log", "line", F.col("current").alias("dir"), "tool", full(F.col("target")).alias("target"), F.transform("inputs", full).alias("inputs"))


def edges(calls: DataFrame) -> DataFrame:
    """(src, dst, kind): what each target is made of; kind by the target's ending: OBJ, AR, SO, EXE."""
    kind = F.when(F.col("target").rlike(r"\.o$"), "OBJ").when(F.col("target").rlike(r"\.a$"), "AR").when(F.col("target").rlike(r"\.so(\.[0-9.]+)?$"), "SO").otherwise("EXE")
    return calls.select(F.col("target").alias("src"), F.explode("inputs").alias("dst"), kind.alias("kind")).distinct()
