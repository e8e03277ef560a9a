"""Reader of run-time trace dumps: a record type and key-value pairs a line.

The whole parse is one SQL projection over the text lines.  Three values are of
several words: the call expressions of a CALL, from the first bracket that stands
alone to the last; the inputs of the header, up to RUNID; and the locks held at
an access, as many pairs of ADDRESS and TYPE behind SYNCS as it says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GLUE = "\u0002"
#: SYNCS, a number, and pairs of the two keys of a lock in either order.
_LOCKS = r"(?<= )SYNCS (\d+)((?: (?:ADDRESS|TYPE) \S+ (?:ADDRESS|TYPE) \S+)+)"
LOCK = "struct<address:string,type:string>"


def _glued(line: Column, pattern: str) -> Column:
    """``line`` with the spaces of what ``pattern`` finds made one word."""
    found = F.regexp_extract(line, pattern, 0)
    return F.when(found == "", line).otherwise(F.replace(line, found, F.replace(found, F.lit(" "), F.lit(_GLUE))))


def _lock_words(line: Column) -> Column:
    """The words of the locks that SYNCS counts: four a lock."""
    n = F.coalesce(F.regexp_extract(line, _LOCKS, 1).try_cast("int"), F.lit(0))
    words = F.split(F.trim(F.regexp_extract(line, _LOCKS, 2)), " ")
    return F.slice(words, 1, F.greatest(F.least(4 * n, F.size(words)), F.lit(0)))


def _locks(words: Column) -> Column:
    def one(i: Column) -> Column:
        a, b = F.get(words, 4 * i + 1), F.get(words, 4 * i + 3)
        turned = F.get(words, 4 * i) == "TYPE"
        return F.struct(F.when(turned, b).otherwise(a).alias("address"), F.when(turned, a).otherwise(b).alias("type"))

    n = F.floor(F.size(words) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast(f"array<{LOCK}>"))


def _pairs(words: Column) -> Column:
    """Keys and values by turns as a map; of a repeated key the last counts."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(2))
    found = F.array_sort(F.transform(at, lambda i: F.struct(F.get(words, i).alias("key"), i.alias("i"), F.replace(F.coalesce(F.get(words, i + 1), F.lit("")), F.lit(_GLUE), F.lit(" ")).alias("value"))))
    # sorted by key and place: the last of each key stays
    last = F.transform(F.array(found), lambda p: F.filter(p, lambda x, i: x["key"] != F.coalesce(F.get(p, i + 1)["key"], F.lit(""))))
    return F.when(F.size(words) > 0, F.map_from_entries(F.transform(F.element_at(last, 1), lambda x: F.struct(x["key"], x["value"])))).otherwise(F.create_map().cast("map<string,string>"))


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """rectype, attrs and the usual keys: run, seq (from ``TS``; the header has its RUNID as run), thread (THREADID or TID), offset (either spelling).

    ``locks``: address and type of each lock held at an access, in order;
    ``inputs``: the words of INP.  Empty lines are left out; a key without a value has an empty one.
    """
    some = lines.select(F.trim(F.regexp_replace(column, r"\s+", " ")).alias("line")).filter("line <> ''")
    some = some.select(F.when(F.startswith("line", F.lit("CALL ")), _glued(F.col("line"), r"(?<= )\[(?: .*)? \](?= |$)")).otherwise(_glued(F.col("line"), r"(?<= INP ).*?(?= RUNID )")).alias("line"))
    some = some.select("line", _lock_words(F.col("line")).alias("held"))
    held = F.array_join("held", " ")
    some = some.select(F.split(F.when(held == "", F.col("line")).otherwise(F.replace("line", F.concat(F.lit(" "), held), F.lit(""))), " ").alias("words"), _locks(F.col("held")).alias("locks"))
    out = some.select(F.get("words", F.lit(0)).alias("rectype"), _pairs(F.slice("words", 2, F.size("words"))).alias("attrs"), "locks")
    ts = F.try_element_at("attrs", F.lit("TS"))
    key = lambda *names: F.coalesce(*(F.try_element_at("attrs", F.lit(n)) for n in names))
    return out.select(
        "rectype", "attrs", F.coalesce(F.regexp_extract(ts, r"^(.*)_\d+$", 1), key("RUNID")).alias("run"), F.regexp_extract(ts, r"(\d+)$", 1).try_cast("long").alias("seq"),
        key("THREADID", "TID").alias("thread"), key("VAROFFSET", "OFFSET").alias("offset"), "locks", F.coalesce(F.filter(F.split(key("INP"), " "), lambda w: w != ""), F.array().cast("array<string>")).alias("inputs"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))
