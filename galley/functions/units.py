"""Units, quantities and weights, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley import dims
from galley.functions.text import singular, words


def _literal(v) -> str:
    return "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else f"{float(v)!r}D"


def listed(values) -> Column:
    """A fixed list of strings as one constant array."""
    return F.expr("array(" + ", ".join(map(_literal, values)) + ")")


def lookup(table: dict, c: Column) -> Column:
    """A fixed table as one constant map, read at ``c``."""
    return F.element_at(F.expr("map(" + ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in table.items()) + ")"), c)


def round_half_up(c: Column, unit: float = 1.0) -> Column:
    """The nearest multiple of ``unit``, halves up."""
    return F.floor(c / unit + 0.5) * unit


def rounded(c: Column, digits: int) -> Column:
    """Halves up, by floor: the same in every engine."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def sql_rounded(e: str, digits: int) -> str:
    return f"(floor(({e}) * {10**digits}e0 + 0.5) / {10**digits}e0)"


def first_of(table: dict, test) -> Column:
    """The value of the first entry, longest keys first, whose key passes ``test``: one constant array, no join."""
    entries = F.expr("array(" + ", ".join(f"named_struct('k', {_literal(k)}, 'v', {_literal(v)})" for k, v in sorted(table.items(), key=lambda x: -len(x[0]))) + ")")
    return F.get(F.filter(entries, lambda x: test(x.k)), F.lit(0)).v


def longest_part(table: dict, c: Column) -> Column:
    """The value of the longest key that the text contains; of equally long ones the first."""
    return first_of(table, lambda k: F.contains(c, k))


def normal_unit(unit: Column) -> Column:
    """One spelling for each unit; adjectives before it do not count."""
    w = words(F.lower(F.trim(unit)))
    core = F.filter(w, lambda x: ~F.array_contains(listed(dims.UNIT_ADJECTIVES), x))
    core = F.when(F.size(core) > 0, core).otherwise(w)
    whole = F.array_join(core, " ")
    return F.when(F.size(w) == 0, "").otherwise(
        F.when(w.getItem(0).isin(dims.MASS_AND_VOLUME_UNITS), w.getItem(0)).otherwise(
            F.coalesce(lookup(dims.UNIT_ALIASES, whole), lookup(dims.UNIT_ALIASES, F.get(core, F.lit(0))), lookup(dims.UNIT_ALIASES, F.get(core, F.size(core) - 1)), whole)
        )
    )


def density(name: Column) -> Column:
    return F.coalesce(longest_part(dims.DENSITIES, F.lower(F.trim(name))), F.lit(1.0))


def piece_grams(name: Column) -> Column:
    """Of one piece: the name, its singular, else the longest known name among its words."""
    n = F.lower(F.trim(name))
    known = {k: float(v) for k, v in dims.PIECE_GRAMS.items()}
    part = first_of(known, lambda k: F.regexp_count(n, F.concat(F.lit(r"\b"), k, F.lit(r"\b"))) > 0)
    return F.coalesce(lookup(known, n), lookup(known, singular(n)), part)


def portion_grams(name: Column, unit: Column) -> Column:
    """Of one spoon or cup: the name, its singular, its words from the right, else the longest known part."""
    n = F.lower(F.trim(name))
    known = sorted(((k, u, v) for k, x in dims.PORTION_GRAMS.items() for u, v in x.items()), key=lambda x: -len(x[0]))
    entries = F.expr("array(" + ", ".join(f"named_struct('k', {_literal(k)}, 'u', {_literal(u)}, 'v', {_literal(v)})" for k, u, v in known) + ")")
    mine = F.filter(entries, lambda x: (x.u == unit) & F.contains(n, x.k))
    pick = lambda test: F.get(F.filter(mine, test), F.lit(0)).v
    by_word = F.array_max(F.transform(F.filter(mine, lambda x: F.array_contains(words(n), x.k)), lambda x: F.struct(F.array_position(words(n), x.k).alias("at"), x.v.alias("v"))))
    one = F.get(F.filter(entries, lambda x: (x.u == unit) & (x.k == singular(n))), F.lit(0)).v
    return F.coalesce(pick(lambda x: x.k == n), one, by_word.v, pick(lambda x: F.lit(True)))


VOLUME_UNITS = ("ml", "l", "cl", "dl", "cup", "tbsp", "tsp", "cs", "cc")


def with_unit_grams(df: DataFrame, name: str, unit: str, out: str) -> DataFrame:
    """Adds ``out``: grams of one unit of the name, or null. Meant for distinct (name, unit) pairs.

    Each lookup is a column of its own, so that later ones read it instead of repeating it.
    """
    n, u = F.col(name), F.col("__unit")
    staged = df.withColumn("__unit", normal_unit(F.col(unit))).withColumns({"__piece": piece_grams(n), "__portion": portion_grams(n, u), "__density": density(n), "__of_unit": lookup(dims.UNIT_GRAMS, u)})
    cascade = F.coalesce(
        F.when(u.isin(dims.PIECE_LIKE_UNITS), F.col("__piece")),
        F.col("__portion"),
        F.when(u.isin(*VOLUME_UNITS) & (F.col("__density") != 1.0), F.col("__of_unit") * F.col("__density")),
        F.col("__of_unit"),
        lookup(dims.DEFAULT_UNIT_GRAMS, u),
    )
    found = F.when(F.col(unit).isNull(), F.col("__piece")).otherwise(F.when(u.isin("g", "kg", "oz", "lb"), F.col("__of_unit")).otherwise(cascade))
    return staged.withColumn(out, found).drop("__unit", "__piece", "__portion", "__density", "__of_unit")


def liquid(name: Column, soup: Column) -> Column:
    """The kind of a cooking liquid, or null."""
    has = lambda parts: F.exists(listed(parts), lambda p: F.contains(name, p))
    return (
        F.when(has(dims.DISCARDED), "discard")
        .when(has(dims.ALCOHOL), "alcohol")
        .when(has(["broth", "stock", "bouillon", "fond"]), F.when(soup, "soup_broth").otherwise("braising"))
        .when(has(dims.CONFIT_FATS), "confit_fat")
        .when(has([*dims.FRYING_OILS, "oil"]), "frying_oil")
    )


def soup(title: Column) -> Column:
    return F.exists(listed(dims.SOUPS), lambda p: F.contains(F.lower(F.coalesce(title, F.lit(""))), p))


def negligible(name: Column, unit: Column) -> Column:
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    return F.array_contains(listed(dims.NEGLIGIBLE), name) | (F.array_contains(listed(dims.HERBS), name) & ((u == "") | F.array_contains(listed(dims.SMALL_HERB_UNITS), normal_unit(u))))


def broken_fraction(unit: Column) -> tuple[Column, Column]:
    """(divisor, unit) of a unit like ``/2 cup``; nulls otherwise."""
    head, rest = F.split_part(unit, F.lit(" "), F.lit(1)), F.trim(F.regexp_replace(unit, "^[^ ]*", ""))
    divisor = F.when(head.startswith("/"), F.substring(head, 2, 99).try_cast("int"))
    found = divisor.isNotNull() & (rest != "")
    return F.when(found, divisor.cast("double")), F.when(found, rest)


#: Words that stand for no quantity.
NO_QUANTITY = ("null", "none", "", "unspecified", "to taste", "as needed", "optional")


def _number(c: Column) -> Column:
    """Digits with at most one point; null for anything else."""
    return F.when(c.rlike("^[0-9]*[.]?[0-9]*$") & c.rlike("[0-9]"), c.cast("double"))


def text_quantity(c: Column) -> Column:
    """A number as people write it: ``3.5``, ``~4``, ``2-3`` and ``2 to 3`` (their mean), ``1/2``, ``1 1/2``; null for the rest."""
    s = F.lower(F.trim(c))
    ends = F.split(s, " *(to|-|–|—) *")
    mean = F.when(F.size(ends) == 2, rounded((_number(F.get(ends, F.lit(0))) + _number(F.get(ends, F.lit(1)))) / 2, 2))
    about = _number(F.trim(F.regexp_replace(s, "^[~≈≃]", "")))
    over = F.split(F.element_at(F.split(s, " +"), -1), "/")
    whole = F.when(F.size(F.split(s, " +")) == 1, 0.0).when(F.size(F.split(s, " +")) == 2, _number(F.get(F.split(s, " +"), F.lit(0))))
    part = F.when(F.size(over) == 2, rounded(whole + F.try_divide(_number(F.get(over, F.lit(0))), _number(F.get(over, F.lit(1)))), 3))
    return F.when(s.isin(*NO_QUANTITY), None).otherwise(F.coalesce(mean, about, part))


def sql_number(e: str) -> str:
    return f"(CASE WHEN regexp_matches({e}, '^[0-9]*[.]?[0-9]*$') AND regexp_matches({e}, '[0-9]') THEN TRY_CAST({e} AS DOUBLE) END)"


def sql_text_quantity(e: str) -> str:
    s, n = f"lower(trim({e}))", sql_number
    ends, words = f"regexp_split_to_array({s}, ' *(to|-|–|—) *')", f"regexp_split_to_array({s}, ' +')"
    over = f"string_split({words}[-1], '/')"
    whole = f"(CASE len({words}) WHEN 1 THEN 0e0 WHEN 2 THEN {n(words + '[1]')} END)"
    ratio = f"({n(over + '[1]')} / nullif({n(over + '[2]')}, 0))"
    return (
        f"CASE WHEN {s} IN ({', '.join(repr(w) for w in NO_QUANTITY)}) THEN NULL ELSE coalesce(CASE WHEN len({ends}) = 2 THEN {sql_rounded(f'({n(ends + chr(91) + chr(49) + chr(93))} + {n(ends + chr(91) + chr(50) + chr(93))}) / 2', 2)} END, "
        f"{n(f'trim(regexp_replace({s}, {chr(39)}^[~≈≃]{chr(39)}, {chr(39)}{chr(39)}))')}, CASE WHEN len({over}) = 2 THEN {sql_rounded(f'{whole} + {ratio}', 3)} END) END"
    )
