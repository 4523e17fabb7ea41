"""Text functions, Column to Column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accented letters of Latin-1 and Latin Extended-A with one base letter, by Unicode's own decompositions.
_ACCENTED = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and ord(d[0]) < 128]
_FROM, _TO = "".join(a for a, _ in _ACCENTED), "".join(b for _, b in _ACCENTED)


def let(c: Column, f) -> Column:
    """``f`` of the value of ``c``, which is worked out once however often ``f`` takes it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def fold(c: Column) -> Column:
    """Lower case, without the accents of Latin letters, combining marks U+0300 to U+036F dropped; JVM-side."""
    return F.regexp_replace(F.translate(F.lower(c), _FROM, _TO), "[̀-ͯ]", "")


@F.pandas_udf(T.StringType())
def fold_any(s: pd.Series) -> pd.Series:
    """As fold(), for every script, by full decomposition."""
    low = s.str.lower().str.normalize("NFD")
    return low.str.replace("[̀-ͯ]", "", regex=True)


def fold_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), r"\s+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def ingredient_id(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(fold(c), r"[^a-z0-9\s_]", "")), r"\s+", "_")


def clean_title(c: Column) -> Column:
    """Without what stands in round brackets at the end: from the first opening bracket after the last closed pair on."""
    t = F.trim(c)
    body = F.substring(t, F.lit(1), F.length(t) - 1)  # without the closing bracket
    tail = F.element_at(F.split(body, r"\)"), -1)
    at = F.instr(tail, "(")
    return F.when(t.endswith(")") & (at > 0), F.trim(F.substring(t, F.lit(1), F.length(body) - F.length(tail) + at - 1))).otherwise(t)


def key(c: Column) -> Column:
    """Lower case, punctuation to blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[,;.()]", " "), r"\s+", " "))


def before_alternative(c: Column) -> Column:
    """What stands before a slash, then before the word or; letters keep their case."""
    first = F.when(c.contains("/"), F.trim(F.split_part(c, F.lit("/"), F.lit(1)))).otherwise(c)
    parts = F.split(first, r"(?i)\bor\b")
    return F.when(F.size(parts) > 1, F.trim(parts.getItem(0))).otherwise(first)


def sql_before_alternative(e: str) -> str:
    first = f"(CASE WHEN contains({e}, '/') THEN trim(split_part({e}, '/', 1)) ELSE {e} END)"
    return f"(CASE WHEN regexp_matches({first}, '(?i)\\bor\\b') THEN trim(regexp_split_to_array({first}, '(?i)\\bor\\b')[1]) ELSE {first} END)"


def singular(c: Column) -> Column:
    n = F.length(c)
    return (
        F.when(c.endswith("ies") & (n > 4), F.concat(F.substring(c, F.lit(1), n - 3), F.lit("y")))
        .when(c.endswith("oes") & (n > 4), F.substring(c, F.lit(1), n - 2))
        .when(c.endswith("ves") & (n > 4), F.substring(c, F.lit(1), n - 1))
        .when(c.endswith("s") & ~c.endswith("ss") & (n > 3), F.substring(c, F.lit(1), n - 1))
        .otherwise(c)
    )


def plural(c: Column) -> Column:
    return (
        F.when(c.rlike("[^aeiou]y$"), F.concat(F.substring(c, F.lit(1), F.length(c) - 1), F.lit("ies")))
        .when(c.rlike("(s|sh|ch|x|z)$"), F.concat(c, F.lit("es")))
        .otherwise(F.concat(c, F.lit("s")))
    )


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def phrases(c: Column) -> Column:
    """Every contiguous part of the words: array of (phrase, words, start), start from 0."""
    w = words(c)
    n = F.size(w)
    at = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.struct(k.alias("words"), i.alias("start")))))
    parts = F.transform(at, lambda x: F.struct(F.array_join(F.slice(w, x.start, x.words), " ").alias("phrase"), x.words.alias("words"), (x.start - 1).alias("start")))
    return F.when(n > 0, parts).otherwise(F.array().cast("array<struct<phrase:string,words:int,start:int>>"))


def whole_word(text: Column, word: Column) -> Column:
    """The word stands in the text with no ASCII letter, digit or underscore beside it."""
    edge = r"(?<![A-Za-z0-9_])\Q"
    return F.regexp_count(text, F.concat(F.lit(edge), word, F.lit(r"\E(?![A-Za-z0-9_])"))) > 0


def stem(c: Column) -> Column:
    """A word without its plural ending, as food names are compared."""
    n, cut = F.length(c), lambda k: F.substring(c, F.lit(1), F.length(c) - k)
    return (
        F.when(c.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y"))).when(c.endswith("oes"), cut(2))
        .when(c.endswith("es") & (n > 3), cut(2)).when(c.endswith("s") & ~c.endswith("ss") & (n > 2), cut(1)).otherwise(c)
    )


def lookup_stem(c: Column) -> Column:
    """As stem(), for lookups: ``ies`` of any length."""
    return F.when(c.endswith("ies"), F.concat(F.substring(c, F.lit(1), F.length(c) - 3), F.lit("y"))).otherwise(stem(c))


def portion_singular(c: Column) -> Column:
    """Singular of a food name's word, by endings that keep the stem a word."""
    n, cut = F.length(c), lambda k: F.substring(c, F.lit(1), F.length(c) - k)
    sibilant = c.endswith("ches") | c.endswith("shes") | c.endswith("xes") | c.endswith("zes") | (c.endswith("ses") & (n > 5))
    return (
        F.when(c.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y"))).when(c.endswith("oes") & (n > 4), cut(2)).when(c.endswith("ves") & (n > 5), cut(1))
        .when(sibilant, cut(2)).when(c.endswith("s") & ~c.endswith("ss") & (n > 3), cut(1)).otherwise(c)
    )


def listed_name(c: Column) -> tuple[Column, Column]:
    """(name, other names) of a long listed name: what stands in quotes or in round brackets (3 to 30 letters) is another name, what stands in square ones is left out."""
    plain = F.regexp_replace(F.regexp_replace(c, r"[\[［][^\]］]*[\]］]", ""), "\n", " ")
    name = F.regexp_replace(F.regexp_replace(plain, '"[^"]*"', ""), r"\([^)]*\)", "")
    for pattern, to in ((r"\s*,\s*,", ","), (r",\s*$", ""), (r"^\s*,\s*", ""), (r"\s+", " ")):
        name = F.regexp_replace(name, pattern, to)
    found = F.concat(*[F.regexp_extract_all(plain, F.lit(p), F.lit(1)) for p in ('"([^"]+)"', r"\(([^)]{3,30})\)")])
    others = F.filter(F.transform(found, lambda x: F.lower(F.trim(x))), lambda x: F.length(x) > 2)
    return F.regexp_replace(F.lower(F.trim(name)), r"\*", ""), others
