"""Word stems by Porter's rules of 1980, worked out once for each distinct word."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The suffixes of the published algorithm's steps 2 to 4, and what stands for them.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel behind a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last of them not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, rules: dict[str, str]) -> str:
    """The longest suffix of ``rules`` that the word has, replaced if what is ahead of it has a measure."""
    for k in range(min(7, len(word)), 1, -1):
        if word[-k:] in rules:
            return word[:-k] + rules[word[-k:]] if _measure(word[:-k]) > 0 else word
    return word


def porter(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            ahead = word[: -len(end)]
            if word.endswith(end) and "v" in _shape(ahead):
                word = ahead
                if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short(word)):
                    word += "e"
                elif word[-2:-1] == word[-1:] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_2), STEP_3)
    for end in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(end):
            ahead = word[: -len(end)]
            if _measure(ahead) > 1 and (end != "ion" or ahead[-1:] in ("s", "t")):
                word = ahead
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def with_stems(rows: DataFrame, column: str, name: str = "stem") -> DataFrame:
    """``rows`` with the stem of a column\'s words; null has null.  Each distinct word is worked out once and joined back.

    Words often come of exploded texts, whose size the planner takes for that of
    the texts; the hint keeps them from being broadcast for it.
    """

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        return words.map(lambda w: porter(w.lower()))

    made = rows.select(column).filter(F.col(column).isNotNull()).distinct().withColumn(name, stem(column))
    return rows.join(made.hint("merge"), column, "left")
