"""Words that name a food: stems, and what is left without words for forms, colours and preparation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions import text

# Words that don't say which food it is.
STOP_WORDS = [
    # preparation
    "raw", "cooked", "fresh", "dried", "ground", "whole", "large", "small", "medium", "thin", "thick", "light", "heavy", "hot", "cold", "sweet",
    "sour", "spicy", "organic", "plain", "instant", "frozen", "canned", "sliced", "chopped", "minced", "crushed", "smoked", "roasted", "fried",
    "boiled", "baked", "grilled", "steamed", "braised", "sauteed", "boneless", "skinless", "unsalted", "salted", "enriched", "refined",
    "virgin", "extra", "all", "purpose", "new", "old", "young", "softened", "pureed", "wild", "dry", "liquid", "low", "fat", "free",
    "reduced", "nonfat", "full", "half", "mini", "baby", "jumbo", "flaky", "crispy", "crunchy", "creamy", "smooth",
    "pure", "natural", "regular", "classic", "traditional", "homemade", "style", "type", "kind", "mix", "mixed", "blend", "blended",
    # colours
    "red", "green", "yellow", "white", "black", "dark", "brown",
    # articles and prepositions
    "de", "of", "and", "or", "with", "in", "for", "the", "a", "an",
    # forms and units
    "clove", "cloves", "clov", "leaf", "leaves", "leav", "sprig", "sprigs", "slice", "slices", "slic", "cube", "cubes", "piece", "pieces", "piec",
    "noodle", "noodles", "strip", "strips", "sheet", "sheets", "stalk", "stalks", "bunch", "bunches", "fillet", "filet", "fillets", "filets",
    # methods
    "compote", "coulis",
]
# Words that endings alone would not bring to their stem.
STEMS = {"tomatoe": "tomato", "potatoe": "potato", "berrie": "berry", "stock": "broth", "jelly": "jam", "sausages": "sausage"}


def word_stem(c: Column) -> Column:
    """The stem of a lower-case word: by the table, else without its plural ending."""
    known = F.when(c == next(iter(STEMS)), STEMS[next(iter(STEMS))])
    for word, stem in list(STEMS.items())[1:]:
        known = known.when(c == word, stem)
    return known.otherwise(text.stem(c))


def key_words(c: Column) -> Column:
    """Stems, longer than two letters, of the words that name a food."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    found = F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), lambda x: ~F.array_contains(stop, x))
    return F.filter(F.transform(found, word_stem), lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x))


_ENDING = (
    "CASE WHEN x LIKE '%ies' AND length(x) > 4 THEN left(x, length(x) - 3) || 'y' WHEN x LIKE '%oes' THEN left(x, length(x) - 2) "
    "WHEN x LIKE '%es' AND length(x) > 3 THEN left(x, length(x) - 2) WHEN x LIKE '%s' AND x NOT LIKE '%ss' AND length(x) > 2 THEN left(x, length(x) - 1) ELSE x END"
)
SQL_STEM = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STEMS.items()) + f" ELSE {_ENDING} END"


def sql_key_words(e: str) -> str:
    listed = "[" + ", ".join(f"'{x}'" for x in STOP_WORDS) + "]"
    return f"list_filter(list_transform(list_filter(regexp_extract_all(lower({e}), '[a-z]+'), lambda x: NOT list_contains({listed}, x)), lambda x: {SQL_STEM}), lambda x: length(x) > 2 AND NOT list_contains({listed}, x))"
