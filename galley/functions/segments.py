"""Texts dealt into plain stretches and named terms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE = "\ue000", "\ue001"  # of the private use area: no letters of any text
_LETTER = r"[a-zA-ZÀ-ɏ0-9_]"


def quoted(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def whole_term(term: str) -> str:
    """Pattern of a term that no Latin letter, digit or underscore touches, in any case."""
    return f"(?iu)(?<!{_LETTER})({quoted(term)})(?!{_LETTER})"


def glossary_terms(glossary: DataFrame, language: str = "en") -> DataFrame:
    """(text, entry) of every name and alias of a glossary (entry, term, aliases, localized), the longest first.

    Where an entry has names of the language, these count in place of its own. Names of one letter are left out.
    """
    own = F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))
    there = F.col("localized")[language]
    named = F.when(there.isNotNull(), F.concat(F.array(there["term"]), F.coalesce(there["aliases"], F.array().cast("array<string>")))).otherwise(own)
    rows = glossary.select("entry", F.explode(named).alias("text")).select(F.lower("text").alias("text"), "entry")
    return rows.where(F.length("text") >= 2).orderBy(F.length("text").desc(), "text", "entry")


def _apart(terms: list[str]) -> bool:
    """No term can end in another one or stand right beside it: the leftmost longest match is then the same as the longest first.

    Each begins and ends with a letter, and none ends in the words that another begins with.
    """
    letter = re.compile(_LETTER).match
    if not all(letter(t[0]) and letter(t[-1]) for t in terms):
        return False
    low = [t.casefold() for t in terms]
    meet = lambda a, b, k: a[-k:] == b[:k] and not letter(a[-k - 1]) and not letter(b[k])
    return not any(meet(a, b, k) for a in low for b in low for k in range(1, min(len(a), len(b))))


def _mark(text: Column, terms: list[str], kind: str, first: bool) -> Column:
    """Each term, the longest first, put between marks where it is not within marks already."""
    terms = sorted({t for t in terms if t}, key=lambda x: (-len(x), x))
    free = f"(?![^{_OPEN}{_CLOSE}]*+{_CLOSE})"
    if terms and _apart(terms):  # one pass; before the first nothing is marked
        return F.regexp_replace(text, _any_term(terms) + ("" if first else free), f"{_OPEN}{kind}$1{_CLOSE}")
    for term in terms:
        text = F.regexp_replace(text, whole_term(term) + free, f"{_OPEN}{kind}$1{_CLOSE}")
    return text


def _any_term(terms: list[str]) -> str:
    return f"(?iu)(?<!{_LETTER})({'|'.join(map(quoted, terms))})(?!{_LETTER})"


def segments(text: Column, *groups: tuple[str, list[str]]) -> Column:
    """array of (text, kind): stretches of the groups' terms, in this order, and ``plain`` ones between them.

    Most texts hold no term: one search tells, and only the others are marked.
    """
    marked = text = F.coalesce(text, F.lit(""))
    for i, (kind, terms) in enumerate(groups):
        marked = _mark(marked, terms, kind[0], i == 0)
    kinds = F.create_map(*[F.lit(x) for kind, _ in groups for x in (kind[0], kind)])
    parts = F.filter(F.split(F.regexp_replace(marked, f"({_OPEN}[^{_CLOSE}]*){_CLOSE}", f"{_CLOSE}$1{_CLOSE}"), _CLOSE), lambda x: x != "")
    named = lambda x: F.when(x.startswith(_OPEN), F.struct(F.substring(x, F.lit(3), F.length(x)).alias("text"), kinds[F.substring(x, 2, 1)].alias("kind"))).otherwise(F.struct(x.alias("text"), F.lit("plain").alias("kind")))
    some = text.rlike(f"[{_OPEN}{_CLOSE}]|" + _any_term(sorted({t for _, terms in groups for t in terms if t}, key=lambda x: (-len(x), x))))
    plain = F.filter(F.array(F.struct(text.alias("text"), F.lit("plain").alias("kind"))), lambda x: x["text"] != "")
    return F.when(some, F.transform(parts, named)).otherwise(plain)
