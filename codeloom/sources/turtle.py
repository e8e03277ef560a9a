"""Reader of Turtle: statements of one line, as the writer makes them, and predicate lists.

A statement is ``<s> <p> object [; <p> object ...] .`` with prefixed names or full
addresses; an object is an address, a prefixed name or a quoted string with
escapes.  Statements may run over several lines; they end with a dot before a
line's end.  Each file must fit in a task; facts are exchanged as many files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TERM = r'<[^>]*>|"(?:[^"\\]|\\.)*"(?:\^\^\S+|@[A-Za-z-]+)?|[A-Za-z_][\w-]*:[^\s;,.]*|\ba\b|[;,.]'


def _plain(term: Column) -> Column:
    """The value of a quoted string."""
    body = F.regexp_extract(term, r'^"((?s:.*))"', 1)
    for mark, plain in (("\\\\", "\u0001"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\u0001", "\\")):
        body = F.replace(body, F.lit(mark), F.lit(plain))
    return body


def parse(lines: DataFrame, base: str, prefixes: dict[str, str] | None = None, column: str = "value") -> DataFrame:
    """(s, ns, p, o, o_ns): ``ns#s`` behind ``base`` is the subject, ``o_ns`` the class of a linked object (null: a value).

    ``lines``: one or more whole statements a row (a line, or a whole text).
    A statement that is cut short has no row; comments and prefix lines none.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(column), r"(?m)^\s*(?:#|@prefix|PREFIX|@base).*$", ""), r"[\r\n]+", " ")
    for name, full in (prefixes or {}).items():
        text = F.regexp_replace(text, rf"(?<=^|\s){name}:([\w%-]+)", f"<{full}$1>")
    terms = F.regexp_extract_all(text, F.lit(_TERM), 0)
    zero = F.expr("named_struct('s', cast(null as string), 'p', cast(null as string), 'out', cast(array() as array<struct<s:string,p:string,o:string>>))")

    def step(acc: Column, x: Column) -> Column:
        # a dot ends the statement, a semicolon the predicate; a comma lets another object follow
        state = lambda s, p, out: F.struct(s.alias("s"), p.alias("p"), out.alias("out"))
        none = F.lit(None).cast("string")
        more = F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["p"].alias("p"), x.alias("o"))))
        return (
            F.when(x == ".", state(none, none, acc["out"])).when(x == ";", state(acc["s"], none, acc["out"])).when(x == ",", acc)
            .when(acc["s"].isNull(), state(x, none, acc["out"])).when(acc["p"].isNull(), state(acc["s"], x, acc["out"])).otherwise(state(acc["s"], acc["p"], more))
        )

    # each statement by itself, so that a long text costs no more than its statements
    told = lines.select(terms.alias("terms")).filter(F.size("terms") > 0)
    dots = F.concat(F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: F.get("terms", i) == "."), F.array(F.size("terms")))
    told = told.select("terms", dots.alias("dots"))
    ahead = lambda k: F.coalesce(F.get("dots", k - 1), F.lit(-1))
    told = told.select(F.explode(F.transform("dots", lambda d, k: F.slice("terms", ahead(k) + 2, d - ahead(k) - 1))).alias("terms"))
    rows = told.select(F.explode(F.aggregate("terms", zero, step, lambda acc: acc["out"])).alias("t")).select("t.*")
    entity = rf"^<\Q{base}\E([^#>]*)#([^>]*)>$"
    part = lambda c, i: F.nullif(F.regexp_extract(c, entity, i), F.lit(""))
    link = part("o", 1)
    return rows.select(part("s", 2).alias("s"), part("s", 1).alias("ns"), F.regexp_extract("p", r"[#/:]([^#/:>]*)>?$", 1).alias("p"), F.when(F.col("o").startswith('"'), _plain(F.col("o"))).otherwise(F.coalesce(part("o", 2), "o")).alias("o"), link.alias("o_ns")).filter("s is not null")


def read(spark: SparkSession, path: str, base: str, prefixes: dict[str, str] | None = None, whole: bool = False) -> DataFrame:
    """Facts of Turtle files: a statement a line, or (``whole``) statements over several lines, a file a row."""
    return parse(spark.read.text(path, wholetext=whole), base, prefixes)
