"""Program text by lines: code without comments, depth of braces, and the scopes of comments.

A line begins in code or within a comment.  What a line makes of either start is
found by patterns alone; which start it has follows from the last line before it
that ends the same way from both, and from the lines between that change the
state.  So lines are counted in ranges, and no file is one task's.

Strings hold no comments and no braces; they end on their line.  Raw strings and
continued lines are read as plain ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import following, running

_STRING = r'"(?:\\.|[^"\\])*+"|' + r"'(?:\\.|[^'\\])*+'"
_CLOSED = rf"({_STRING})|//.*|/\*.*?\*/"
_ANY = _CLOSED + r"|/\*.*$"


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text) of each line, from 1 on.  ``files``: path, value (a whole text); null has no lines."""
    some = files.filter("value is not null").select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return some.select("path", (F.col("line") + 1).alias("line"), "text")


def _behind(text: Column) -> Column:
    """What stands behind the end of the comment in which the line begins; null where it does not end."""
    return F.when(text.contains("*/"), F.regexp_replace(text, r"^.*?\*/", ""))


def _opens(text: Column) -> Column:
    """Whether a line that begins in code ends within a comment."""
    return F.regexp_replace(text, _CLOSED, "").contains("/*")


def code(of: DataFrame) -> DataFrame:
    """Lines with ``code`` (text without comments), ``begins_in`` (a comment), and the depth of braces ``before`` and ``after`` each."""
    text = F.col("text")
    told = of.withColumn("__code", _opens(text)).withColumn("__comment", F.coalesce(_opens(_behind(text)), F.lit(True)))
    told = told.withColumn("__turn", F.col("__code") & ~F.col("__comment")).withColumn("__back", -F.col("line"))
    told = running(told, ["path"], ["line"], __turns=F.col("__turn").cast("int"))
    settles = F.when(F.col("__code") == F.col("__comment"), F.struct(F.col("__code").alias("ends"), F.col("__turns").alias("turns")))
    told = following(told, ["path"], ["__back"], settles, "__last")
    turns = F.col("__turns") - F.col("__turn").cast("int") - F.coalesce("__last.turns", F.lit(0))
    begins = F.coalesce("__last.ends", F.lit(False)) != (turns % 2 == 1)
    told = told.withColumn("begins_in", begins)
    plain = F.regexp_replace(F.when(F.col("begins_in"), F.coalesce(_behind(text), F.lit(""))).otherwise(text), _ANY, "$1")
    told = told.withColumn("code", plain)
    bare = F.regexp_replace("code", _STRING, "")
    step = F.regexp_count(bare, F.lit(r"\{")) - F.regexp_count(bare, F.lit(r"\}"))
    told = running(told.withColumn("step", step), ["path"], ["line"], after=F.col("step"))
    return told.select(*of.columns, "code", "begins_in", (F.col("after") - F.col("step")).alias("before"), "after")


def without_comments(files: DataFrame) -> DataFrame:
    """(path, value): texts without their comments; lines stay where they are."""
    some = code(lines(files)).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "code"))).alias("all"))
    return some.select("path", F.array_join(F.transform("all", lambda x: x["code"]), "\n").alias("value"))


def closing(of: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (path, id, line, depth) with ``closed``: the first line from ``line`` on with a brace that brings the depth to ``depth``, or null."""
    bare = F.regexp_replace("code", _STRING, "")
    braces = of.select("path", "line", F.posexplode(F.regexp_extract_all(bare, F.lit(r"[{}]"), F.lit(0))).alias("nth", "brace"))
    braces = running(braces, ["path"], ["line", "nth"], depth=F.when(F.col("brace") == "{", 1).otherwise(-1)).filter("brace = '}'")
    rows = braces.select("path", "line", F.lit(1).alias("kind"), "depth", F.lit(None).cast("long").alias("id"))
    rows = rows.unionByName(asked.select("path", "line", F.lit(0).alias("kind"), F.col("depth").cast("long"), F.col("id").cast("long")))
    found = following(rows, ["path", "depth"], ["line", "kind"], F.when(F.col("kind") == 1, F.col("line")), "closed").filter("kind = 0")
    return found.select("path", "id", F.col("closed").cast("int"))


def scopes(of: DataFrame, comments: DataFrame) -> DataFrame:
    """(path, nth, begin, end, rule): the lines that each comment is about.

    ``of``: lines as :func:`code` gives them.  ``comments``: path, nth, first, last.

    inline: beside code that does not end in a brace, its own lines.  Comments that
    follow each other with nothing but empty lines between have one scope, from the
    first one on; what decides is the next line that is not empty.  end: none, the
    last line.  include: an include, to the last line.  block: it ends in an opening
    brace, or the one behind it begins with one, to where that closes.  next:
    else, to where the braces around it close, or ahead of the next comment.
    """
    shown = of.withColumn("content", F.trim("code"))
    told = following(shown, ["path"], ["line"], F.when(F.trim("text") != "", F.struct("line", "content", "before", "after")), "nx").select("path", "line", "content", "nx")
    # lines of code are small as files: none of these tables, which grow with the files, is to be broadcast
    told = told.hint("merge")
    whole = of.groupBy("path").agg(F.max("line").alias("eof")).hint("merge")
    c = comments.select("path", "nth", "first", "last").join(told.select("path", F.col("line").alias("first"), F.col("content").alias("beside")), ["path", "first"])
    c = c.join(told.select("path", F.col("line").alias("last"), "nx"), ["path", "last"]).join(whole, "path")
    inline = (F.col("beside") != "") & ~F.col("beside").endswith("{")
    c = c.withColumn("inline", inline)
    # the comment ahead: one joins it that is alone on the next line behind it
    c = c.withColumn("__back", -F.col("nth"))
    c = following(c, ["path"], ["__back"], F.struct(F.col("nx.line").alias("next"), "inline"), "ahead")
    joins = F.coalesce((F.col("beside") == "") & ~F.col("ahead.inline") & (F.col("ahead.next") == F.col("first")), F.lit(False))
    c = running(c.withColumn("fresh", ~joins), ["path"], ["nth"], grp=(~joins).cast("int"))
    # the next comment that is no part of the group
    c = following(c, ["path"], ["nth"], F.when(F.col("fresh"), F.col("first")), "later")
    groups = c.groupBy("path", "grp").agg(F.min("first").alias("begin"), F.max_by("nx", "nth").alias("nx"), F.max_by("later", "nth").alias("later"))
    nn = told.select("path", F.col("line").alias("at"), F.col("nx").alias("nn"))
    groups = groups.withColumn("at", F.col("nx.line")).join(nn, ["path", "at"], "left").withColumn("id", F.col("grp"))
    one, two = F.col("nx.content").endswith("{"), F.coalesce(F.col("nn.content").startswith("{"), F.lit(False))
    include = F.col("nx.content").startswith("#include")
    rule = F.when(F.col("nx").isNull(), "end").when(include, "include").when(one | two, "block").otherwise("next")
    groups = groups.withColumn("rule", rule)
    line = F.when(one, F.col("nx.line") + 1).when(two, F.col("nn.line") + 1).otherwise(F.col("nx.line"))
    depth = F.when(one, F.col("nx.after") - 1).when(two, F.col("nn.after") - 1).otherwise(F.col("nx.before") - 1)
    closed = closing(of, groups.filter("rule in ('block', 'next')").select("path", "id", line.alias("line"), depth.alias("depth")))
    groups = groups.join(closed.hint("merge"), ["path", "id"], "left").hint("merge")
    out = c.drop("nx", "later").join(groups.select("path", "grp", "begin", "rule", "closed", "later"), ["path", "grp"])
    end = F.when(F.col("rule") == "next", F.least(F.coalesce("closed", "eof"), F.col("later") - 1)).when(F.col("rule") == "block", F.coalesce("closed", "eof")).otherwise(F.col("eof"))
    return out.select(
        "path", "nth", F.when(F.col("inline"), F.col("first")).when(F.col("rule") == "end", F.col("eof")).otherwise(F.col("begin")).alias("begin"),
        F.when(F.col("inline"), F.col("last")).otherwise(end).alias("end"), F.when(F.col("inline"), "inline").otherwise(F.col("rule")).alias("rule"),
    )
