"""Which words of comments and names are kept as tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags of function words, numbers and comparisons (Penn treebank), and words that questions use themselves.
REJECTED_TAGS = ["CC", "CD", "DT", "EX", "JJR", "JJS", "PRP", "PRP$", "$", "RB", "RBR", "RBS", "RP", "WDT", "WP$", "WP", "WRB", "MD"]
QUESTION_WORDS = ["definition", "definitions", "update", "updates", "sequence", "sequences", "associated", "involved", "accessed", "invokes", "invoke", "are", "list"]
_MARKS = r"""[=,.;:#?*!&$'"()\[\]\\/+]"""


def plain(token: Column) -> Column:
    """Lower case, without hyphens at its ends and without punctuation."""
    return F.regexp_replace(F.lower(F.regexp_replace(token, "^-+|-+$", "")), _MARKS, "")


def _long_enough(rows: DataFrame) -> DataFrame:
    return rows.filter((F.length("token") > 2) & ~F.col("token").rlike(r"^\d+$") & ~F.col("token").isin(QUESTION_WORDS))


def _tagged(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows with ``tag`` of the lexicon (word, tag), else null; a word of several tags has the first in order."""
    one = lexicon.groupBy(F.lower("word").alias("token")).agg(F.min("tag").alias("tag"))
    return rows.join(one, "token", "left")


def prefixes(phrases: DataFrame, phrase: str) -> DataFrame:
    """(token): every beginning of the phrases, in lower case; so a join by equality finds what a token begins."""
    ends = F.explode(F.sequence(F.lit(1), F.length(phrase)))
    return phrases.filter(F.length(phrase) > 0).select(F.lower(phrase).alias("p"), ends.alias("n")).select(F.expr("left(p, n)").alias("token")).distinct()


def _allowed(rows: DataFrame, known: DataFrame | None, stopwords: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens of more than two characters that are no number, no stop word, no beginning of a known phrase and of no rejected tag."""
    some = _long_enough(rows).join(stopwords.select(F.lower("word").alias("token")).distinct(), "token", "left_anti")
    if known is not None:
        some = some.join(known, "token", "left_anti")
    return _tagged(some, lexicon).filter(F.col("tag").isNull() | ~F.col("tag").isin(REJECTED_TAGS))


def comment_tokens(comments: DataFrame, key: str, text: str, catalogue: DataFrame, stopwords: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(key, token), each once: the words of comments that say what they are about.

    Left out are stop words, numbers, words of two characters or fewer, words that a
    phrase of the ``catalogue`` (phrase) begins with, words that questions use, and
    those whose tag in the ``lexicon`` (word, tag) is rejected.  An adjective (JJ)
    stays only if it is hyphenated, and then as its parts, which are looked at alike.
    """
    known = prefixes(catalogue, "phrase")
    words = comments.select(F.col(key).alias("key"), F.explode(F.split(text, r"\s+")).alias("word"))
    words = words.join(stopwords.select("word").distinct(), "word", "left_anti").select("key", plain(F.col("word")).alias("token"))
    some = _allowed(words, known, stopwords, lexicon)
    whole = some.filter(F.col("tag").isNull() | (F.col("tag") != "JJ")).select("key", "token")
    parts = some.filter((F.col("tag") == "JJ") & F.col("token").contains("-")).select("key", F.explode(F.split("token", "-")).alias("token"))
    parts = _allowed(parts, known, stopwords, lexicon).filter(F.col("tag").isNull() | (F.col("tag") != "JJ")).select("key", "token")
    return whole.unionByName(parts).distinct().withColumnRenamed("key", key)


def name_tokens(names: DataFrame, key: str, spelling: str, pieces: Column, stopwords: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(key, token), each once: every spelling itself, and those of its ``pieces`` that are words to look for.

    Pieces keep their case.  They pass the tests of comments but for the catalogue; no piece is split again.
    """
    own = names.select(F.col(key).alias("key"), F.col(spelling).alias("token"))
    cut = names.select(F.col(key).alias("key"), F.explode(pieces).alias("piece")).select("key", F.regexp_replace("piece", _MARKS, "").alias("piece"), F.lower(F.regexp_replace("piece", _MARKS, "")).alias("token"))
    some = cut.filter((F.length("token") > 2) & ~F.col("piece").isin([*QUESTION_WORDS, "many"])).join(stopwords.select(F.col("word").alias("piece")).distinct(), "piece", "left_anti")
    some = _tagged(some, lexicon).filter(F.col("tag").isNull() | (~F.col("tag").isin([*REJECTED_TAGS, "JJ"])) | ((F.col("tag") == "JJ") & F.col("piece").contains("-")))
    return own.unionByName(some.select("key", F.col("piece").alias("token"))).distinct().withColumnRenamed("key", key)
