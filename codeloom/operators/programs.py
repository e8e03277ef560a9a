"""Small operators on programs: executables, entries, extents of functions, identifiers, bridges by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import shared
from ..functions import names
from ..sources.syntax import attribute
from .windows import running


def executables(edges: DataFrame) -> DataFrame:
    """(path): what is built (src) and has no extension."""
    return edges.select(F.col("src").alias("path")).distinct().filter(~names.basename(F.col("path")).rlike(r"[^.].*\.|^[^.]+\."))


def with_start(edges: DataFrame, entry: str) -> DataFrame:
    """Block edges (src, dst) with one from EXEC_START to the entry of the program, ahead of which constructors of globals run."""
    return edges.select("src", "dst").unionByName(edges.sparkSession.createDataFrame([("EXEC_START#0", entry)], "src string, dst string"))


def inverse(facts: DataFrame, turned: dict[str, str]) -> DataFrame:
    """Facts (s, p, o) with each of the properties ``turned`` the other way round too, under its other name."""
    table = F.create_map(*(F.lit(x) for pair in turned.items() for x in pair))
    back = facts.filter(F.col("p").isin(*turned)).select(F.col("o").alias("s"), table[F.col("p")].alias("p"), F.col("s").alias("o"))
    return facts.select("s", "p", "o").unionByName(back)


def seen_before(files: DataFrame, unit: str, file: str) -> DataFrame:
    """``files`` with ``known_as``: the file's name, with _1 behind it where an earlier unit has one of that name."""
    name = names.basename(F.col(file))
    first = F.min(unit).over(W.partitionBy(name))
    return files.withColumn("known_as", F.when(first < F.col(unit), F.concat(name, F.lit("_1"))).otherwise(name))


def numbered(records: DataFrame) -> DataFrame:
    """Trace records with ``seqno``: their place in their run, blocks ahead of what is in them."""
    return running(records, ["run"], ["unit", "nth"], seqno=F.lit(1))


def extents(nodes: DataFrame) -> DataFrame:
    """(linkage_name, id, file, begin, end) of defined functions; of several definitions the first of the text."""
    own = nodes.filter(attribute("isDef").isNotNull() & (attribute("linkage_name") != ""))
    place = F.struct(attribute("id").alias("id"), attribute("file").alias("file"), names.position(attribute("range.start")).alias("begin"), names.position(attribute("range.end")).alias("end"))
    return own.groupBy(attribute("linkage_name").alias("linkage_name")).agg(F.min_by(place, F.struct("unit", "node")).alias("x")).select("linkage_name", "x.*")


def identifiers(nodes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(unit, id, symbol, kind, begin, end, type, tokens, domains) of spelled nodes with a file.

    ``tokens`` are the name's words in lower case, ``domains`` what the vocabulary (word, domain) says of them.
    """
    own = nodes.filter(attribute("spelling").isNotNull() & attribute("file").isNotNull() & attribute("range.start").isNotNull())
    rows = own.select(
        "unit", "node", attribute("id").alias("id"), attribute("spelling").alias("symbol"), F.col("tag").alias("kind"), names.position(attribute("range.start"))["line"].alias("begin"), names.position(attribute("range.end"))["line"].alias("end"),
        attribute("type").alias("type"), F.transform(names.segment(attribute("spelling")), F.lower).alias("tokens"),
    )
    rows = shared.stored(rows, "identifiers")  # texts are parsed once
    said = rows.select("unit", "node", F.explode(F.array_distinct("tokens")).alias("word")).join(vocabulary.select(F.lower("word").alias("word"), "domain"), "word")
    said = said.groupBy("unit", "node").agg(F.array_sort(F.collect_set(F.concat_ws(" : ", "word", "domain"))).alias("domains"))
    return rows.join(said, ["unit", "node"], "left").withColumn("domains", F.coalesce("domains", F.array().cast("array<string>"))).drop("node")


def vocabulary(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word, domain) of lines ``word,domain``; of one word alone the domain is empty.  In lower case, each once."""
    parts = F.split(column, ",", 2)
    return lines.select(F.lower(F.trim(parts[0])).alias("word"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("domain")).filter("word <> ''").distinct()


def callees_by_token(tokens: DataFrame, spelled: DataFrame, calls: DataFrame) -> DataFrame:
    """(token, id): functions called, in the trace, by functions whose symbols have a comment's token.

    ``tokens``: s, token.  ``spelled``: s, name.  ``calls``: caller_name, callee_name.
    """
    pairs = calls.select("caller_name", "callee_name").distinct()
    callers = tokens.join(spelled, "s").select("token", F.col("name").alias("caller_name")).distinct()
    return callers.join(pairs, "caller_name").join(spelled.select(F.col("s").alias("id"), F.col("name").alias("callee_name")), "callee_name").select("token", "id").distinct()


def shared_words(comments: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """(key, words): domain words that a comment shares with the symbols in its scope; both tables: key, words (array)."""
    said = symbols.select(key, F.explode("words").alias("w")).groupBy(key).agg(F.collect_set("w").alias("of_symbols"))
    return comments.join(said, key).select(key, F.array_sort(F.array_intersect("words", "of_symbols")).alias("words"))


def pointer_writes(writes: DataFrame, targets: DataFrame) -> DataFrame:
    """Writes through pointers with what they then point at: both carry thread, ins and seq; ``targets`` also value and pointee.

    The value seen after an instruction belongs to the last write of that thread
    and instruction ahead of it.  ``pointee`` is NULL for the value 0.
    """
    both = writes.select("thread", "ins", "seq", F.struct(F.col("seq").alias("at"), *(c for c in writes.columns if c not in ("thread", "ins", "seq"))).alias("write"), F.lit(None).cast(targets.schema["pointee"].dataType).alias("pointee"), F.lit(None).cast(targets.schema["value"].dataType).alias("value"))
    both = both.unionByName(targets.select("thread", "ins", "seq", F.lit(None).cast(both.schema["write"].dataType).alias("write"), "pointee", "value"))
    last = F.last("write", ignorenulls=True).over(W.partitionBy("thread", "ins").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    told = both.withColumn("before", last).filter("write is null and before is not null")
    return told.select("thread", "ins", "seq", "before.*", F.when(F.col("value") == 0, "NULL").otherwise(F.col("pointee")).alias("pointee"))


def changed_files(text: Column) -> Column:
    """The files that a patch names in its headers, each once, in order."""
    heads = F.filter(F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^(\+\+\+|---)")), lambda x: F.trim(F.substring(x, 4, 1_000_000))), lambda x: x.rlike("^[ab]/"))
    return F.array_sort(F.array_distinct(F.transform(heads, lambda x: F.substring(x, 3, 1_000_000))))


def concept_words(text: Column, stopwords: list[str]) -> Column:
    """The words of a concept: lower case, hyphens as spaces, without stop words."""
    return F.filter(F.split(F.lower(F.replace(F.trim(text), F.lit("-"), F.lit(" "))), " +"), lambda x: (x != "") & ~x.isin(stopwords))


def shortened(path: Column, project: str) -> Column:
    """What follows the project's folder in a path; a path without it is below ``build``."""
    parts = F.split(path, "/")
    at = F.array_position(parts, project)
    rest = F.array_join(F.slice(parts, (at + 1).cast("int"), F.greatest(F.size(parts), F.lit(1))), "/")
    return F.when(at > 0, rest).when(path.startswith("/"), path).otherwise(F.concat(F.lit("build/"), path))


def local_name(uri: Column) -> Column:
    """What stands behind the # of a name."""
    return F.substring_index(uri, "#", -1)


def own_code(path: Column, extensions: list[str]) -> Column:
    """Whether a path is of the program's own text: one of the extensions, and not below /usr."""
    return ~path.startswith("/usr") & F.lower(F.substring_index(path, ".", -1)).isin(extensions) & path.contains(".")
