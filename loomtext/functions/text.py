"""Text analysis as Column expressions; only stemming leaves the JVM, and it reads distinct words alone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"

#: Fixed values, by the word-break classes of Unicode: what may stand between two letters, and between two digits.
MID_LETTER = "'‘’․﹒＇．:.··״‧︓﹕："
MID_NUMBER = "'‘’․﹒＇．.,;;։،؍٬߸⁄︐︔﹐﹔，；"


def word_pattern(script: str = "Is", once: str = "+") -> str:
    """Words by the word-break rules, as a pattern: letters with single marks between them, digits with theirs, both side by side,
    underscores that join; katakana as runs; ideographs and hiragana one by one. Marks and format signs stay with what they follow.

    script: what stands before the name of a script. once: the sign of possessive repetition, "" where there is none; with it
    words of any length are read without recursion.
    """
    han, hiragana, katakana = (rf"\p{{{script}{x}}}" for x in ("Han", "Hiragana", "Katakana"))
    more, some = f"*{once}", f"+{once}"
    extend = rf"[\p{{M}}\p{{Cf}}]{more}"
    letters = rf"(?:(?:[^\P{{L}}{han}{hiragana}{katakana}]|\p{{Nl}}){extend}){some}"
    digits = rf"(?:\p{{Nd}}{extend}){some}"
    word = rf"{letters}(?:[{MID_LETTER}]{extend}{letters}){more}"
    number = rf"{digits}(?:[{MID_NUMBER}]{extend}{digits}){more}"
    part = rf"(?:(?:{word}|{number}){some}|(?:[{katakana}ー]{extend}){some})"
    join = rf"(?:\p{{Pc}}{extend})"
    return rf"{join}{more}{part}(?:{join}{some}{part}){more}{join}{more}|[{han}{hiragana}]{extend}"


#: How texts are cut into tokens: runs of letters and digits, or words by the word-break rules.
RULES = {"runs": TOKEN, "words": word_pattern()}

#: The usual English stop list of 33 words.
STOPWORDS = tuple(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)


def strip_possessive(text: Column) -> Column:
    return F.regexp_replace(text, r"['’][sS]\b", "")


def tokens(text: Column, lowercase: bool = True, possessive: bool = False, rule: str = "runs") -> Column:
    """All tokens in order, by one of RULES; a null text has none."""
    text = strip_possessive(text) if possessive else text
    text = F.lower(text) if lowercase else text
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RULES[rule]), F.lit(0))


def positions(found: Column, term: str) -> Column:
    """0-based places of a term in an array of tokens."""
    marked = F.transform(found, lambda t, i: F.when(t == term, i))
    return F.filter(marked, lambda i: i.isNotNull())


def url_depth(url: Column) -> Column:
    return F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit("")))


def is_wikipedia(url: Column) -> Column:
    return url.contains("wikipedia.org").cast("int")


def written_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def read_time(text: Column) -> Column:
    return F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def is_username(text: Column) -> Column:
    return text.rlike(r"^[0-9_a-zA-Z]+$")


def is_email(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$")


def is_doc_id(text: Column) -> Column:
    return text.rlike(r"^[0-9]+$")


def query_parameters(query: Column) -> Column:
    """A query string as a map of name to the array of its decoded values."""
    pairs = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: F.instr(p, "=") > 0)
    decoded = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), F.try_url_decode(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("value")))
    names = F.array_distinct(F.transform(decoded, lambda d: d["name"]))
    values = F.transform(names, lambda n: F.transform(F.filter(decoded, lambda d: d["name"] == n), lambda d: d["value"]))
    return F.map_from_arrays(names, values)


#: Endings of inflected forms, and what stands in their place, in the order in which it is tried; "=" takes one of two like letters.
INFLECTIONS = (("ies", ("ie", "y")), ("es", ("e", "")), ("s", ("",)), ("ied", ("ie", "y")), ("ed", ("e", "", "=")), ("ing", ("e", "", "=")))
LEAST_STEM = 3


def inflected_from(word: str) -> list[str]:
    """What a word may be a form of, the first to be tried first."""
    out = []
    for ending, put in INFLECTIONS:
        if word.endswith(ending) and not (ending == "s" and word.endswith("ss")):
            base = word[: -len(ending)]
            out += [base[:-1] if p == "=" else base + p for p in put if p != "=" or base[-2:-1] == base[-1:] != ""]
    return [w for w in dict.fromkeys(out) if len(w) >= LEAST_STEM]


def _inflected_from(word: Column) -> Column:
    found = []
    for ending, put in INFLECTIONS:
        ends = word.endswith(ending) & ~word.endswith("ss") if ending == "s" else word.endswith(ending)
        base = F.substring(word, F.lit(1), F.length(word) - len(ending))
        last = F.length(base)
        for p in put:
            twice = (last > 1) & (F.substring(base, last, F.lit(1)) == F.substring(base, last - 1, F.lit(1)))
            found.append(F.when(ends & twice, F.substring(base, F.lit(1), last - 1)) if p == "=" else F.when(ends, F.concat(base, F.lit(p))))
    return F.filter(F.array(*found), lambda w: w.isNotNull() & (F.length(w) >= LEAST_STEM))


def dictionary_stems(words: DataFrame, column: str, lexicon: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """word, stem for the distinct words of a column: the first form that a word may come from and that stands in the lexicon (word); the word itself where none does, or where it is in ``keep``."""
    distinct = words.select(F.col(column).alias("word")).filter("word is not null").distinct()
    free = distinct.filter(~F.col("word").isin(*keep)) if keep else distinct
    tried = free.select("word", F.posexplode(_inflected_from(F.col("word"))).alias("place", "form"))
    known = tried.join(lexicon.select(F.col("word").alias("form")).distinct(), "form", "left_semi").groupBy("word").agg(F.min_by("form", "place").alias("form"))
    return distinct.join(known, "word", "left").select("word", F.coalesce("form", "word").alias("stem"))


def stems(words: DataFrame, column: str, stemmer: str = "porter", keep: tuple[str, ...] = ()) -> DataFrame:
    """word, stem for the distinct words of a column. Words in ``keep`` stay as they are; ``none`` keeps all."""
    from loomtext.functions.porter import stem

    distinct = words.select(F.col(column).alias("word")).distinct()
    if stemmer == "none":
        return distinct.withColumn("stem", F.col("word"))
    if stemmer != "porter":
        raise ValueError(f"no stemmer named {stemmer}; dictionary stems need a lexicon")

    @F.pandas_udf("string")
    def stemmed(column: pd.Series) -> pd.Series:
        return column.map(stem)

    free = ~F.col("word").isin(*keep) if keep else F.lit(True)
    return distinct.withColumn("stem", F.when(free, stemmed("word")).otherwise(F.col("word")))
