"""Questions bound by a cascade: exact phrases, beginnings of tokens, similar tokens; then conflicts of kinds.

All questions are bound at once.  A word that begins a token is found by equality
with the token's beginnings, so that no question meets a whole dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import shared
from ..functions.stems import with_stems
from .binding import phrases

NAME, COMMENT = "name_token", "comment_token"


def _beginnings(tokens: DataFrame, column: str) -> DataFrame:
    """``tokens`` with ``begins``: each of the column's beginnings of two characters and more, in lower case."""
    long = tokens.filter(F.length(column) > 1)
    return long.withColumn("__n", F.explode(F.sequence(F.lit(2), F.length(column)))).withColumn("begins", F.expr(f"lower(left({column}, __n))")).drop("__n")


def _asked(words: DataFrame, key: list[str]) -> DataFrame:
    """(key, phrase, look): phrases and, where they differ, their stems, as what to look for."""
    both = F.explode(F.array_distinct(F.array("phrase", "stem")))
    return words.select(*key, "phrase", both.alias("look"))


def _without(rows: DataFrame, key: list[str], some: DataFrame) -> DataFrame:
    # keys of questions are as many as these: the hint keeps them from being broadcast
    return rows.join(some.select(*key).distinct().hint("merge"), key, "left_anti")


def candidates(words: DataFrame, key: list[str], dictionary: DataFrame, names: DataFrame, comments: DataFrame, similar_names: DataFrame, similar_comments: DataFrame) -> DataFrame:
    """(key, phrase, kind, token, how): all that the phrases of questions may mean.

    exact: a phrase of the dictionary.  prefix: in questions without a symbol, names
    that a phrase or its stem begins; in all questions, comment tokens that a phrase
    begins.  similar: in questions with neither symbol nor name, the name whose
    similar token a phrase or its stem begins; in questions without comment token,
    the comment token that has the phrase or its stem as a whole word of a
    similar token; of several the one of the highest score, then the first in
    order.  related: what is similar to a comment token so found, unless it has the same stem.
    """
    own = lambda df, kind, how: df.select(*key, "phrase", F.lit(kind).alias("kind"), "token", F.lit(how).alias("how"))
    # what is found is little beside the words, and is looked at again and again
    exact = shared.stored(words.select(*key, "phrase").join(dictionary.select("phrase", "kind").distinct(), "phrase").select(*key, "phrase", "kind", F.col("phrase").alias("token"), F.lit("exact").alias("how")), "exact")
    asked = _asked(words, key)
    best = F.min_by("token", F.struct((-F.col("score")).alias("less"), "token")).alias("token")

    # words meet tokens first and lose the questions that are settled then, so that no question without a token is shuffled
    symbols = exact.filter("kind = 'symbol'")
    met = own(asked.join(_beginnings(names.select("token"), "token"), F.col("look") == F.col("begins")), NAME, "prefix").distinct()
    by_name = shared.stored(_without(met, key, symbols), "by_name")
    met = asked.join(_beginnings(similar_names, "similar"), F.col("look") == F.col("begins")).groupBy(*key, "phrase").agg(best)
    by_name = by_name.unionByName(own(_without(_without(met, key, symbols), key, by_name), NAME, "similar"))

    direct = shared.stored(own(words.join(_beginnings(comments.select("token"), "token"), F.col("phrase") == F.col("begins")), COMMENT, "prefix").distinct(), "direct")
    whole = similar_comments.withColumn("word", F.explode(F.split(F.lower("similar"), r"\W+"))).filter("word <> ''")
    met = asked.join(whole, F.col("look") == F.col("word")).groupBy(*key, "phrase").agg(best)
    found = direct.unionByName(shared.stored(own(_without(met, key, direct), COMMENT, "similar"), "similar"))
    stems = with_stems(with_stems(similar_comments.select("token", "similar").distinct(), "token", "token_stem"), "similar", "similar_stem")
    further = found.select(*key, "phrase", "token").join(stems.filter("token_stem <> similar_stem"), "token")
    related = own(further.select(*key, "phrase", F.col("similar").alias("token")).distinct(), COMMENT, "related")
    related = _without(related, [*key, "phrase", "token"], found)
    return exact.unionByName(by_name).unionByName(found).unionByName(related)


def settled(found: DataFrame, key: list[str]) -> DataFrame:
    """``found`` without the kinds that lose, and with ``conflict``: the phrase may be a name as well.

    Of one phrase, values, common words, symbols and attributes win over comment
    tokens, values and static attributes over names.  A phrase that is left as a
    comment token and as a name counts as the former, which is a conflict to tell of.
    """
    w = W.partitionBy(*key, "phrase")
    has = lambda *kinds: F.max(F.col("kind").isin(*kinds)).over(w)
    told = found.withColumn("__c", has(COMMENT) & ~has("values", "common_word", "symbol", "static_attribute"))
    told = told.withColumn("__n", has(NAME) & ~has("values")).withColumn("conflict", F.col("__c") & F.col("__n"))
    told = told.withColumn("__n", F.col("__n") & ~F.col("conflict") & ~has("static_attribute")).withColumn("__c", F.col("__c") & ~has("dynamic_attribute"))
    kept = F.when(F.col("kind") == COMMENT, F.col("__c")).when(F.col("kind") == NAME, F.col("__n")).otherwise(F.lit(True))
    return told.filter(kept).drop("__c", "__n")


def placed(found: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """``found`` with the places (start, end) of its phrases; a phrase inside a longer one that means something goes."""
    at = words.select(*key, "phrase", "start", "end").join(found.hint("merge"), [*key, "phrase"])
    w = W.partitionBy(*key).orderBy("start")
    told = at.withColumn("__before", F.max("end").over(w.rangeBetween(W.unboundedPreceding, -1))).withColumn("__here", F.max("end").over(W.partitionBy(*key, "start")))
    return told.filter((F.col("__here") == F.col("end")) & (F.col("__before").isNull() | (F.col("__before") < F.col("end")))).drop("__before", "__here")


def bind(questions: DataFrame, key: list[str], dictionary: DataFrame, names: DataFrame, comments: DataFrame, similar_names: DataFrame, similar_comments: DataFrame, column: str = "text", most: int = 3, stopwords: list[str] = ()) -> DataFrame:
    """(key, phrase, start, end, kind, token, how, conflict): what each question names.

    ``dictionary``: phrase (lower case), kind.  ``names`` and ``comments``: token.
    ``similar_names`` and ``similar_comments``: token, similar, score.
    """
    words = shared.stored(with_stems(phrases(questions, key, column, most, stopwords), "phrase"), "words")
    once = shared.stored(words.select(*key, "phrase", "stem").distinct(), "once")
    found = candidates(once, key, dictionary, names, comments, similar_names, similar_comments)
    return placed(settled(found, key), words, key)


def abstract(words: Column, found: Column) -> Column:
    """A question's words with its phrases replaced by <<kind>>, by their places: ``found`` is an array of (start, end, kind)."""

    def shown(word: Column, i: Column) -> Column:
        here = F.get(F.filter(found, lambda x: x["start"] == i + 1), F.lit(0))
        inside = F.exists(found, lambda x: (x["start"] <= i) & (i + 1 < x["end"]))
        return F.when(here.isNotNull(), F.concat(F.lit("<<"), here["kind"], F.lit(">>"))).when(~inside, word)

    return F.array_join(F.array_compact(F.transform(words, shown)), " ")
