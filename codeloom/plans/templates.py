"""Question templates: each is a lazy DataFrame over one body of knowledge.

- ``symbols``: s, is_a, spelling, file, parent and any further attributes, one row a symbol;
- ``tokens``: s, token, kind (``name`` or ``comment``), one row a token of a symbol;
- ``accesses``: seq, thread, kind (READ, WRITE, CALL), var_id, var_name, func_name, sync, lock.

Small sides are filters on ``symbols``; Catalyst decides on broadcasts.  Nothing
is capped: callers that show a few rows order and limit the result themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import shared
from ..operators import relevance, triples

#: Attributes that name a file, a parent or the entity itself are not asked for by value.
KEYS = ("s", "ns")


@dataclass(frozen=True)
class Knowledge:
    symbols: DataFrame
    tokens: DataFrame
    accesses: DataFrame

    def attributes(self) -> list[str]:
        return [c for c in self.symbols.columns if c not in KEYS]

    def facts(self, names: list[str] | None = None) -> DataFrame:
        """(s, p, o) of the symbols, in one pass."""
        return triples.unpivot(self.symbols, F.col("s"), "symbol", {c: F.col(c) for c in names or self.attributes()}).drop("ns")


def _where(**values: str | list[str] | None) -> Column:
    """Equality with a value, or membership in a list; None asks nothing."""
    tests = [F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v for c, v in values.items() if v is not None]
    return reduce(and_, tests, F.lit(True))


def _any_value(k: Knowledge, value: str) -> Column:
    return F.coalesce(reduce(or_, [F.col(c) == value for c in k.attributes()]), F.lit(False))


def _named(k: Knowledge, spelling: str) -> DataFrame:
    return k.symbols.filter(F.col("spelling") == spelling)


def _tagged(k: Knowledge, token: str, kind: str = "comment") -> DataFrame:
    return k.tokens.filter((F.col("token") == token) & (F.col("kind") == kind)).select("s").distinct()


def _of_symbols(k: Knowledge, symbols: DataFrame) -> DataFrame:
    """Accesses with the symbol that they touch."""
    return k.accesses.join(symbols.select(F.col("s").alias("var_id"), "spelling", "file"), "var_id")


def children_with(k: Knowledge, parent: str, tags: list[str], **values: str) -> DataFrame:
    """Children of a symbol, of these tags and with these values."""
    return triples.children(k.symbols, parent, up="parent").filter(_where(is_a=tags, **values)).select("s", "spelling")


def synchronised_in_file(k: Knowledge, file: str, token: str | None = None, **values: str) -> DataFrame:
    """Synchronised accesses, by name, to symbols of a file with these values [and a comment token]."""
    of = k.symbols.filter(_where(file=file, **values))
    if token:
        of = of.join(_tagged(k, token), "s", "left_semi")
    return k.accesses.filter("sync <> 'ASYNC'").join(of.select("s", F.col("spelling").alias("var_name")), "var_name").select("seq", "s")


def names_with(k: Knowledge, file: str | None, tags: list[str], **values: str) -> DataFrame:
    """T2 (and, without a value, T17): distinct names of these tags [in a file] [with these values]."""
    return k.symbols.filter(_where(file=file, is_a=tags, **values)).select("spelling").distinct()


def attributes_of(k: Knowledge, spelling: str, names: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """Each [asked] attribute of a symbol [of these tags] with the set of its values."""
    some = Knowledge(_named(k, spelling).filter(_where(is_a=tags)), k.tokens, k.accesses)
    return some.facts(names).groupBy("p").agg(F.sort_array(F.collect_set("o")).alias("values"))


def children_with_token(k: Knowledge, parent: str, tags: list[str], token: str) -> DataFrame:
    """T4: children of a symbol that a comment gives this token, with their parent."""
    some = triples.children(k.symbols, parent, up="parent").filter(_where(is_a=tags))
    return some.join(_tagged(k, token), "s", "left_semi").select("parent", "s", "spelling")


def accesses_of(k: Knowledge, spelling: str, file: str | None = None, kinds: tuple[str, ...] = ("READ", "WRITE")) -> DataFrame:
    """The accesses of a variable [of a file], numbered in order."""
    w = W.partitionBy("var_id").orderBy("seq")
    some = _of_symbols(k, _named(k, spelling).filter(_where(file=file))).filter(F.col("kind").isin(*kinds))
    return some.select("seq", "var_id", "kind", F.row_number().over(w).alias("nth"))


def synchronised_functions(k: Knowledge, file: str, var_names: list[str] | None = None) -> DataFrame:
    """Synchronised accesses in functions of a file [to these variables]."""
    of = k.symbols.filter(_where(file=file)).select("s", F.col("spelling").alias("func_name"))
    return k.accesses.filter((F.col("sync") != "ASYNC") & _where(var_name=var_names)).join(of, "func_name").select("seq", "s")


def accesses_between(k: Knowledge, names: list[str]) -> DataFrame:
    """Accesses to one of these names in the function of another, whichever is which."""
    return k.accesses.filter(F.col("var_name").isin(names) & F.col("func_name").isin(names) & (F.col("var_name") != F.col("func_name"))).select("seq", "var_name", "func_name", "kind")


def accesses_inside(k: Knowledge, function: str) -> DataFrame:
    """T8 with several words: all accesses inside a function."""
    return _of_symbols(k, k.symbols).filter(F.col("func_name") == function).select("seq", "var_id", "spelling", "kind")


def accesses_by_token(k: Knowledge, token: str, tags: list[str] | None = None) -> DataFrame:
    """Accesses to variables that a comment gives this token."""
    of = k.symbols.filter(_where(is_a=tags)).join(_tagged(k, token), "s", "left_semi")
    return _of_symbols(k, of).filter(F.col("kind").isin("READ", "WRITE")).select("seq", "var_id", "kind")


def locked_variables(k: Knowledge, lock: str = "MUTEX", token: str | None = None) -> DataFrame:
    """Variables that are accessed under a lock [and have a comment token]."""
    out = k.symbols.join(k.accesses.filter(F.col("lock") == lock).select(F.col("var_id").alias("s")), "s", "left_semi")
    return (out.join(_tagged(k, token), "s", "left_semi") if token else out).select("s", "spelling")


def in_files(k: Knowledge, tags: list[str], files: list[str]) -> DataFrame:
    """Entities of these tags in these files."""
    return k.symbols.filter(_where(is_a=tags, file=files)).select("s", "spelling", "file")


def relatives(k: Knowledge, spelling: str, tags: list[str]) -> DataFrame:
    """The parents of a symbol and its children, of these tags."""
    me = _named(k, spelling)
    ups = k.symbols.join(me.select(F.col("parent").alias("s")), "s", "left_semi").withColumn("side", F.lit("parent"))
    downs = triples.children(k.symbols, spelling, up="parent").withColumn("side", F.lit("child"))
    return ups.unionByName(downs).filter(_where(is_a=tags)).select("side", "s", "spelling")


def with_value_or(k: Knowledge, tags: list[str], first: str, second: str, value: str) -> DataFrame:
    """Entities of each tag whose ``first`` is the value; of a tag without any, those whose ``second`` is."""
    some = k.symbols.filter(_where(is_a=tags)).withColumn("rank", F.when(F.col(first) == value, 1).when(F.col(second) == value, 2)).filter("rank is not null")
    best = some.groupBy("is_a").agg(F.min("rank").alias("rank"))
    return some.join(best, ["is_a", "rank"], "left_semi").select("s", "is_a", "spelling")


def by_token(k: Knowledge, token: str, similar: DataFrame, tags: list[str] | None = None, file: str | None = None) -> DataFrame:
    """Entities by the first bucket that has them.

    1: a comment has the token; 2: the name has it in its best file; 3: a comment
    has a similar token; 4: the name has a similar one.  ``similar``: column token.
    """
    asked = F.col("token") == token
    near = k.tokens.join(similar.select("token").distinct(), "token", "left_semi").filter(~asked)
    buckets = [k.tokens.filter(asked & (F.col("kind") == "comment")), by_name_token(k, token), near.filter("kind = 'comment'"), near.filter("kind = 'name'")]
    ranked = relevance.first_bucket(*(b.select("s") for b in buckets), key="s")
    return k.symbols.filter(_where(is_a=tags, file=file)).join(ranked, "s").select("s", "spelling", "bucket")


def by_name_token(k: Knowledge, token: str) -> DataFrame:
    """Symbols whose name has a token, in the file where the token weighs most.

    A token's weight is relative to its whole file, so all name tokens are counted.
    """
    named = k.tokens.filter("kind = 'name'").join(k.symbols.select("s", "spelling", "file"), "s")
    best = relevance.best_file(relevance.term_weights(named.select("token", "file"))).filter(F.col("token") == token).select("token", "file")
    return named.filter(F.col("token") == token).join(best, ["token", "file"]).select("s", "spelling", "file").distinct()


def with_attributes(k: Knowledge, names: list[str], file: str | None = None) -> DataFrame:
    """Entities that have all these attributes [in a file]."""
    return k.symbols.filter(_where(file=file) & reduce(and_, [F.col(c).isNotNull() for c in names])).select("s", "spelling")


def with_any_value(k: Knowledge, value: str, file: str | None = None) -> DataFrame:
    """Entities with a value under any attribute [in a file]."""
    return k.symbols.filter(_where(file=file) & _any_value(k, value)).select("s", "spelling")


def by_concept(k: Knowledge, concepts: DataFrame) -> DataFrame:
    """Entities by the tokens of related concepts (column token): of comments, else, where no comment has one, of names.

    Up to ``relevance.COMMON`` concepts are looked up where the tokens lie; what is found is stored, as it is asked twice.
    """
    asked = shared.stored(concepts.select("token").distinct(), "concepts")
    asked = F.broadcast(asked) if asked.count() <= relevance.COMMON else asked
    some = shared.stored(k.tokens.join(asked, "token", "left_semi").select("s", "kind"), "hits").withColumn("rank", F.when(F.col("kind") == "comment", 1).otherwise(2))
    best = some.agg(F.min("rank").alias("rank"))
    ids = some.join(F.broadcast(best), "rank", "left_semi").select("s").distinct()
    return k.symbols.join(ids, "s", "left_semi").select("s", "spelling")
