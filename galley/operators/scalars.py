"""Text, number and time functions over the adapters' columns, each against SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley import dims
from galley.functions import foodwords, text, time
from galley.functions.units import broken_fraction, lookup, round_half_up, rounded, sql_rounded, sql_text_quantity, text_quantity
from galley.plans.adapters import view, with_views
from galley.plans.catalog import Catalog

catalog = Catalog()



def texts(spark, sf_dir):
    """Raw values, titles, urls and whole documents, keyed by (src, i)."""
    return view(spark, sf_dir, "texts")


def on_texts(name: str, c: Callable[[], Column], sql: str, where: str = "true") -> None:
    catalog.add(name, lambda s, d: texts(s, d).where(where).select("src", "i", c().alias("value")), with_views(f"SELECT src, i, {sql} AS value FROM texts WHERE {where}"))


def on(name: str, source: str, keys: str, c: Callable[[], Column], sql: str, where: str = "true") -> None:
    """A function of a view's columns, with the view's keys."""
    listed = keys.split(", ")
    catalog.add(name, lambda s, d: view(s, d, source).where(where).select(*listed, c().alias("value")), with_views(f"SELECT {keys}, {sql} AS value FROM {source} WHERE {where}"))


t = lambda: F.col("t")
m = lambda: F.col("minutes")
FOLD = "strip_accents(lower({}))".format


def _num(e: str, pattern: str, group: int = 1) -> str:
    return f"TRY_CAST(nullif(regexp_extract({e}, '{pattern}', {group}), '') AS DOUBLE)"


#: Queries of short values: whole documents are no names or numbers.
SHORT = "src <> 'document'"

# --- text ---
on_texts("STR-1_accent_fold", lambda: text.fold(t()), FOLD("t"))
on_texts("STR-2_fold_name", lambda: text.fold_name(t()), f"trim(regexp_replace({FOLD('t')}, '\\s+', ' ', 'g'))")
on_texts("STR-3_slugify", lambda: text.slug(t()), f"regexp_replace(regexp_replace({FOLD('t')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")
on_texts("STR-5_ingredient_id", lambda: text.ingredient_id(t()), f"regexp_replace(trim(regexp_replace({FOLD('t')}, '[^a-z0-9\\s_]', '', 'g')), '\\s+', '_', 'g')")
on_texts("STR-6_title_cleanup", lambda: text.clean_title(t()), "trim(regexp_replace(trim(t), ' *[(][^)]*[)]$', ''))")
on("STR-7_title_cleanup_script", "recipes", "rid", lambda: text.clean_title(F.col("title")), "trim(regexp_replace(trim(title), ' *[(][^)]*[)]$', ''))")
on_texts("STR-8_key_normalise", lambda: text.key(t()), "trim(regexp_replace(regexp_replace(lower(t), '[,;.()]', ' ', 'g'), '\\s+', ' ', 'g'))")
on_texts("STR-11_query_preprocess", lambda: text.before_alternative(t()), text.sql_before_alternative("t"), SHORT)
from galley.operators.nutrition import sql_singular  # noqa: E402

on_texts("STR-12_depluralise", lambda: text.singular(F.lower(t())), f"(SELECT {sql_singular('x')} FROM (SELECT lower(t) AS x))", SHORT)
on_texts("STR-14_pluralise", lambda: text.plural(t()), "CASE WHEN regexp_matches(t, '[^aeiou]y$') THEN t[:-2] || 'ies' WHEN regexp_matches(t, '(s|sh|ch|x|z)$') THEN t || 'es' ELSE t || 's' END", SHORT)
on_texts("STR-26_language_header", lambda: F.regexp_extract(t(), r"LANGUAGE:\s*([a-z]{2})", 1), "regexp_extract(t, 'LANGUAGE:\\s*([a-z]{2})', 1)")
on_texts("STR-31_readable_url_name", lambda: F.regexp_extract(t(), r"/([^/]+?)(?:\.[a-z]+)?/?$", 1), "regexp_extract(t, '/([^/]+?)(?:\\.[a-z]+)?/?$', 1)", SHORT)
on_texts("STR-32_unit_key", lambda: F.coalesce(lookup(dims.UNIT_ALIASES, F.lower(t())), t()), "coalesce(CASE lower(t) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.UNIT_ALIASES.items()) + " END, t)", SHORT)
on("STR-33_correction_key", "ingredients", "rid, pos", lambda: F.concat_ws(":", F.lit("ingredient"), F.col("pos").cast("string"), "name"), "concat_ws(':', 'ingredient', CAST(pos AS VARCHAR), name)")
on("STR-37_category_info", "ingredients", "rid, pos", lambda: F.when(F.col("category").isin("produce", "herb", "dairy", "egg", "grain", "legume"), F.col("category")).otherwise("other"), "CASE WHEN category IN ('produce', 'herb', 'dairy', 'egg', 'grain', 'legume') THEN category ELSE 'other' END")
on_texts("STR-38_cache_key", lambda: F.lower(F.trim(t())), "lower(trim(t))")
on("STR-34_page_context", "pages", "page_id", lambda: F.regexp_extract("html", r"<title>([^<]*)</title>", 1), "regexp_extract(html, '<title>([^<]*)</title>', 1)")
_among = lambda words: r"(^|[^\p{L}\p{N}])(" + words + r")($|[^\p{L}\p{N}])"
_french = _among("de|du|des|le|la|les|au|aux|et|avec|pour") + "|[éèêçàùœ]"
on_texts("STR-20_french_detect", lambda: F.lower(t()).rlike(_french), f"regexp_matches(lower(t), '{_french}')")
_english = _among("the|of|and|with|fresh|chopped|red|cup|chicken|wine|flour")
on_texts("STR-21_english_detect", lambda: F.lower(t()).rlike(_english), f"regexp_matches(lower(t), '{_english}')")
catalog.add(
    "STR-4_unique_slug",
    lambda s, d: view(s, d, "recipes").withColumn("base", text.slug(F.col("title"))).select("rid", F.expr("case when row_number() over (partition by base order by rid) = 1 then base else concat(base, '-', row_number() over (partition by base order by rid)) end").alias("value")),
    with_views(f"SELECT rid, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS value FROM (SELECT rid, base, row_number() OVER (PARTITION BY base ORDER BY rid) AS n FROM (SELECT rid, regexp_replace(regexp_replace({FOLD('title')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM recipes))"),
)
catalog.add(
    "STR-40_recipe_text",
    lambda s, d: view(s, d, "ingredients").groupBy("rid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: F.concat(F.lit("- "), x["name"])), "\n").alias("value")),
    with_views("SELECT rid, string_agg('- ' || name, chr(10) ORDER BY pos) AS value FROM ingredients GROUP BY rid"),
)
catalog.add(
    "STR-10_key_words",
    lambda s, d: texts(s, d).select("src", "i", F.array_join(foodwords.key_words(t()), " ").alias("value")),
    with_views(f"SELECT src, i, array_to_string({foodwords.sql_key_words('t')}, ' ') AS value FROM texts"),
)
_word_sql = {
    "STR-9_word_stem": foodwords.SQL_STEM,
    "STR-13_depluralise_usda": "CASE WHEN x LIKE '%ies' AND length(x) > 4 THEN x[:-4] || 'y' WHEN x LIKE '%oes' AND length(x) > 4 THEN x[:-3] WHEN x LIKE '%ves' AND length(x) > 5 THEN x[:-2] "
    "WHEN x LIKE '%ches' OR x LIKE '%shes' OR x LIKE '%xes' OR x LIKE '%zes' OR (x LIKE '%ses' AND length(x) > 5) THEN x[:-3] WHEN x LIKE '%s' AND x NOT LIKE '%ss' AND length(x) > 3 THEN x[:-2] ELSE x END",
    "STR-15_lookup_stem": "CASE WHEN x LIKE '%ies' THEN x[:-4] || 'y' WHEN x LIKE '%oes' THEN x[:-3] WHEN x LIKE '%es' AND length(x) > 3 THEN x[:-3] WHEN x LIKE '%s' AND x NOT LIKE '%ss' AND length(x) > 2 THEN x[:-2] ELSE x END",
}
for _name, _f in (("STR-9_word_stem", foodwords.word_stem), ("STR-13_depluralise_usda", text.portion_singular), ("STR-15_lookup_stem", text.lookup_stem)):
    # the distinct words of all texts, by first letters of the Latin alphabet
    catalog.add(
        _name,
        lambda s, d, f=_f: texts(s, d).select(F.explode(F.regexp_extract_all(F.lower("t"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct().select("word", f(F.col("word")).alias("value")),
        with_views(f"SELECT x AS word, {re.sub(r'x\[:-(\d)\]', lambda m: f'left(x, length(x) - {int(m[1]) - 1})', _word_sql[_name])} AS value FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(t), '[a-z]+')) AS x FROM texts)"),
    )

# --- numbers ---
_div = lambda: broken_fraction(t())[0]
_rest = lambda: broken_fraction(t())[1]
on_texts("NUM-5_broken_fraction", lambda: F.when(_div().isNotNull(), F.concat(F.round(1 / _div(), 4).cast("string"), F.lit(" "), _rest())),
         f"CASE WHEN regexp_matches(t, '^/[0-9]+ +[^ ]') THEN CAST(round(1 / {_num('t', '^/([0-9]+)')}, 4) AS VARCHAR) || ' ' || trim(regexp_replace(t, '^[^ ]*', '')) END", SHORT)
on_texts("NUM-7_type_coercion", lambda: text_quantity(t()), sql_text_quantity("t"), SHORT)
on_texts("NUM-8_quantity_coercion", lambda: text_quantity(t()), sql_text_quantity("t"), SHORT)
on_texts("NUM-9_servings_coercion", lambda: F.when(text_quantity(t()).isNotNull(), F.greatest(F.lit(1), F.bround(text_quantity(t())).cast("int"))), f"CASE WHEN {sql_text_quantity('t')} IS NOT NULL THEN greatest(1, CAST(round_even({sql_text_quantity('t')}, 0) AS INTEGER)) END", SHORT)
_c = lambda: F.replace(F.trim(t()), F.lit(","), F.lit("."))
_plain = lambda c: F.when(c.rlike("^[+-]?[0-9]+([.][0-9]*)?$"), c.try_cast("double"))
_plain_sql = lambda e: f"CASE WHEN regexp_matches({e}, '^[+-]?[0-9]+([.][0-9]*)?$') THEN TRY_CAST({e} AS DOUBLE) END"
on_texts(
    "NUM-10_ciqual_value",
    lambda: F.when(t().isin("-", "N", ""), None).when(t() == "traces", 0.0).when(_c().rlike(r"^< *[0-9.]+$"), F.regexp_extract(_c(), r"^< *([0-9.]+)$", 1).try_cast("double") / 2).otherwise(_plain(_c())),
    "CASE WHEN t IN ('-', 'N', '') THEN NULL WHEN t = 'traces' THEN 0e0 WHEN regexp_matches(replace(trim(t), ',', '.'), '^< *[0-9.]+$') THEN TRY_CAST(regexp_extract(replace(trim(t), ',', '.'), '^< *([0-9.]+)$', 1) AS DOUBLE) / 2 ELSE " + _plain_sql("replace(trim(t), ',', '.')") + " END", SHORT,
)
on_texts(
    "NUM-11_mext_value",
    lambda: F.when(t().isin("Tr", "(0)", "(Tr)"), 0.0).when(t().isin("-", ""), None).otherwise(_plain(F.regexp_replace(t(), r"^\((.*)\)$", "$1"))),
    "CASE WHEN t IN ('Tr', '(0)', '(Tr)') THEN 0e0 WHEN t IN ('-', '') THEN NULL ELSE " + _plain_sql("regexp_replace(t, '^\\((.*)\\)$', '\\1')") + " END", SHORT,
)
_basic = {"g": 1.0, "kg": 1000.0, "ml": 1.0, "l": 1000.0, "cl": 10.0, "dl": 100.0, "cup": 240.0, "tbsp": 15.0, "tsp": 5.0, "oz": 28.35}
on("NUM-12_basic_grams", "ingredients", "rid, pos", lambda: rounded(F.col("quantity") * lookup(_basic, F.col("unit")), 4), sql_rounded("quantity * CASE unit " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in _basic.items()) + " END", 4))
P = lambda: F.col("protein")
C = lambda: F.col("carbs")
A = lambda: F.col("fat")
K = lambda: F.col("kcal")
_tot = lambda: P() * 4 + C() * 4 + A() * 9
on("NUM-13_macro_pct", "foods", "id", lambda: F.when(_tot() == 0, 0.33).otherwise(rounded(P() * 4 / _tot(), 6)), f"CASE WHEN protein * 4 + carbs * 4 + fat * 9 = 0 THEN 0.33e0 ELSE {sql_rounded('protein * 4 / (protein * 4 + carbs * 4 + fat * 9)', 6)} END")
_dev = lambda x, f, ideal: F.pow(F.abs(x * f / _tot() - ideal), 2)
on("NUM-14_macro_balance", "foods", "id", lambda: F.when(_tot() > 0, rounded(F.greatest(F.lit(0.0), 3 - (_dev(P(), 4, 0.15) + _dev(C(), 4, 0.5) + _dev(A(), 9, 0.37)) * 100), 5)),
   "CASE WHEN protein * 4 + carbs * 4 + fat * 9 > 0 THEN " + sql_rounded("greatest(0e0, 3 - (" + " + ".join(f"pow(abs({x} * {f} / (protein * 4 + carbs * 4 + fat * 9) - {i}e0), 2)" for x, f, i in (("protein", 4, 0.15), ("carbs", 4, 0.5), ("fat", 9, 0.37))) + ") * 100)", 5) + " END")
on("NUM-15_calorie_score", "foods", "id", lambda: rounded(F.when(K() <= 0, 0.0).when(K().between(300, 800), F.greatest(F.lit(0.0), 2 - F.abs(K() - 550) / 550 * 2)).when(K() < 300, F.greatest(F.lit(-2.0), -((300 - K()) / 300) * 2)).otherwise(F.greatest(F.lit(-2.0), -((K() - 800) / 800) * 2)), 6),
   sql_rounded("CASE WHEN kcal <= 0 THEN 0e0 WHEN kcal BETWEEN 300 AND 800 THEN greatest(0e0, 2 - abs(kcal - 550) / 550 * 2) WHEN kcal < 300 THEN greatest(-2e0, -((300 - kcal) / 300) * 2) ELSE greatest(-2e0, -((kcal - 800) / 800) * 2) END", 6))
on("NUM-16_macro_status", "foods", "id", lambda: F.when(P() < 10, "low").when(P() > 20, "high").otherwise("ok"), "CASE WHEN protein < 10 THEN 'low' WHEN protein > 20 THEN 'high' ELSE 'ok' END")
on("NUM-17_daily_value", "foods", "id", lambda: F.floor(P() * 100 / 50 + 0.5), "CAST(floor(protein * 100 / 50 + 0.5) AS BIGINT)")
on("NUM-18_calorie_rounding", "foods", "id", lambda: round_half_up(K(), 10.0), "floor(kcal / 10e0 + 0.5) * 10e0")
on("NUM-37_weight_cache_key", "ingredients", "rid, pos", lambda: F.concat_ws("|", F.coalesce(F.lower("unit"), F.lit("")), F.lower(F.trim("name"))), "coalesce(lower(unit), '') || '|' || lower(trim(name))")
on("NUM-36_servings_multiplier", "recipes", "rid", lambda: F.lit(6) / F.col("servings"), "CAST(6 AS DOUBLE) / servings")
#: Exponents by which amounts of a group follow the servings.
SCALING = {"spices": 0.8, "seasoning": 0.8, "yeast": 0.9}
_group = lambda: F.when(F.col("category") == "spice", "spices").when(F.col("category") == "condiment", "seasoning").when(F.col("name") == "flour", "yeast")
_scaled_sql = "quantity * pow(2e0, CASE WHEN category IN ('spice', 'condiment') THEN 0.8e0 WHEN name = 'flour' THEN 0.9e0 ELSE 1e0 END)"
on("NUM-21_servings_scaling", "ingredients", "rid, pos", lambda: rounded(F.col("quantity") * F.pow(F.lit(2.0), F.coalesce(lookup(SCALING, _group()), F.lit(1.0))), 4), sql_rounded(_scaled_sql, 4))
on("NUM-38_detail_format", "foods", "id", lambda: F.when(F.col("fiber") == 0, "—").when(F.col("fiber") < 0.1, "<0.1").otherwise(F.format_string("%.1f", "fiber")), "CASE WHEN fiber = 0 THEN '—' WHEN fiber < 0.1 THEN '<0.1' ELSE printf('%.1f', fiber) END")

# --- time ---
on_texts("DAT-1_iso_minutes", lambda: rounded(time.iso_minutes(t()), 6), f"CASE WHEN {time.sql_is_iso('t')} THEN {sql_rounded(time.sql_marked_minutes('t'), 6)} END")
on_texts("DAT-4_iso_validity", lambda: time.is_iso(t()), time.sql_is_iso("t"))
on_texts("DAT-7_page_iso", lambda: rounded(time.marked_minutes(F.upper(t())), 6), sql_rounded(time.sql_marked_minutes("upper(t)"), 6), SHORT)
_shown_sql = f"0e0 + coalesce({_num('t', '([0-9]+)h')}, 0) * 60e0 + coalesce({_num('t', '([0-9]+)min')}, 0) + coalesce({_num('t', '([0-9]+)[ \\t]*s')}, 0) * (1 / 60e0)"
on_texts("DAT-6_page_time", lambda: rounded(time.shown_minutes(t()), 6), sql_rounded(f"CASE WHEN coalesce(t, '') = '' THEN 0e0 WHEN starts_with(upper(t), 'PT') THEN {time.sql_marked_minutes('upper(t)')} ELSE {_shown_sql} END", 6), SHORT)
_m5 = "CAST(floor(total_minutes * 23 / 5e0 + 0.5) * 5 AS BIGINT)"
on("DAT-10_full_format", "recipes", "rid", lambda: time.long(F.col("total_minutes") * 23),
   f"(SELECT CASE WHEN m = 0 THEN '0 min' ELSE concat_ws(' ', CASE WHEN m // 1440 = 1 THEN '1 day' WHEN m // 1440 > 1 THEN (m // 1440) || ' days' END, CASE WHEN m % 1440 // 60 = 1 THEN '1 hour' WHEN m % 1440 // 60 > 1 THEN (m % 1440 // 60) || ' hours' END, CASE WHEN m % 60 > 0 THEN (m % 60) || ' min' END) END FROM (SELECT {_m5} AS m))")
_iso_out = lambda e: f"CASE WHEN {e} <= 0 THEN 'PT0M' WHEN {e} // 60 > 0 AND {e} % 60 > 0 THEN 'PT' || ({e} // 60) || 'H' || ({e} % 60) || 'M' WHEN {e} // 60 > 0 THEN 'PT' || ({e} // 60) || 'H' ELSE 'PT' || ({e} % 60) || 'M' END"
on("DAT-2_minutes_iso", "recipes", "rid", lambda: time.minutes_iso(F.col("total_minutes")), _iso_out("total_minutes"))
on("DAT-3_minutes_iso_rounded", "steps", "rid, pos", lambda: time.minutes_iso(F.bround(m() / 3)), f"(SELECT {_iso_out('x')} FROM (SELECT CAST(round_even(minutes / 3, 0) AS BIGINT) AS x))", "minutes is not null")
on("DAT-8_round_to_five", "steps", "rid, pos", lambda: round_half_up(F.coalesce(m(), F.lit(0.0)), 5.0), "floor(coalesce(minutes, 0) / 5e0 + 0.5) * 5e0")
on("DAT-9_compact_format", "recipes", "rid", lambda: time.compact(F.col("total_minutes") * 17), "CASE WHEN total_minutes <= 0 THEN '0 min' ELSE concat_ws(' ', CASE WHEN total_minutes * 17 // 1440 > 0 THEN (total_minutes * 17 // 1440) || 'j' END, CASE WHEN total_minutes * 17 % 1440 // 60 > 0 THEN (total_minutes * 17 % 1440 // 60) || CASE WHEN total_minutes * 17 % 1440 // 60 > 1 THEN ' hours' ELSE ' hour' END END, CASE WHEN total_minutes * 17 % 60 > 0 THEN (total_minutes * 17 % 60) || ' min' END) END")
on("DAT-11_remaining_format", "recipes", "rid", lambda: F.concat(F.lit("~"), time.short(F.col("total_minutes"))), "'~' || CASE WHEN total_minutes // 60 <= 0 THEN (total_minutes % 60) || ' min' WHEN total_minutes % 60 = 0 THEN (total_minutes // 60) || 'h' ELSE (total_minutes // 60) || 'h' || lpad(CAST(total_minutes % 60 AS VARCHAR), 2, '0') END")
on("DAT-12_timer_display", "recipes", "rid", lambda: time.clock(F.col("total_minutes") * 60 + 7), "(SELECT CASE WHEN s // 3600 > 0 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s % 3600 // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') FROM (SELECT total_minutes * 60 + 7 AS s))")
on("DAT-15_duration_format", "recipes", "rid", lambda: time.clock_full(F.col("total_minutes") * 13), "(SELECT (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') FROM (SELECT total_minutes * 13 AS s))")
on("DAT-14_season_of_month", "recipes", "rid", lambda: time.season(F.col("month")), "CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring' WHEN month IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END")
on("DAT-16_form_minutes_iso", "recipes", "rid", lambda: F.when(F.col("total_minutes") > 0, time.minutes_iso(F.col("total_minutes"))), f"CASE WHEN total_minutes > 0 THEN {_iso_out('total_minutes')} END")
on("DAT-17_form_minutes_format", "recipes", "rid", lambda: time.short(F.col("total_minutes")), "CASE WHEN total_minutes // 60 <= 0 THEN (total_minutes % 60) || ' min' WHEN total_minutes % 60 = 0 THEN (total_minutes // 60) || 'h' ELSE (total_minutes // 60) || 'h' || lpad(CAST(total_minutes % 60 AS VARCHAR), 2, '0') END")
on("DAT-13_temperature_format", "recipes", "rid", lambda: F.concat((F.col("total_minutes") + 40).cast("string"), F.lit("°C")), "(total_minutes + 40) || '°C'")

# --- predicates ---
on("FLT-10_range_check", "foods", "id", lambda: K().between(0, 902) & (P() >= 0) & (A() >= 0) & (C() >= 0), "kcal BETWEEN 0 AND 902 AND protein >= 0 AND fat >= 0 AND carbs >= 0")
on("FLT-11_atwater_check", "foods", "id", lambda: F.when(K() <= 0, (P() == 0) & (A() == 0) & (C() == 0)).otherwise(F.abs(_tot() - K()) / F.greatest(K(), F.lit(1.0)) < 0.2), "CASE WHEN kcal <= 0 THEN protein = 0 AND fat = 0 AND carbs = 0 ELSE abs(protein * 4 + carbs * 4 + fat * 9 - kcal) / greatest(kcal, 1) < 0.2e0 END")
#: Beginnings and whole names that are no food.
NO_FOOD_STARTS = ["[", "additional ", "optional ", "anything ", "your choice", "your favorite"]
NO_FOOD = [
    "add-ins", "toppings", "garnish", "seasoning to taste", "to taste", "for garnish", "for serving", "for frying", "for greasing", "as needed",
    "of your choice", "desired", "accompaniments", "sides",
]
_low = lambda: F.lower(t())
on_texts("FLT-9_garbage_name", lambda: (F.length(t()) < 3) | _low().isin(NO_FOOD) | F.exists(F.array(*[F.lit(x) for x in NO_FOOD_STARTS]), lambda x: F.startswith(_low(), x)),
         f"length(t) < 3 OR lower(t) IN ({', '.join(repr(x) for x in NO_FOOD)}) OR " + " OR ".join(f"starts_with(lower(t), '{x}')" for x in NO_FOOD_STARTS), SHORT)
#: Sauces with known values, prepared mixtures, and endings of such.
KNOWN_SAUCES = [
    "soy sauce", "hot sauce", "tomato sauce", "fish sauce", "worcestershire sauce", "barbecue sauce", "bbq sauce", "hoisin sauce", "teriyaki sauce", "sriracha sauce", "oyster sauce",
    "chili sauce", "chili garlic sauce", "adobo sauce", "marinara sauce", "pizza sauce", "cranberry sauce", "applesauce", "enchilada sauce", "buffalo sauce", "ponzu sauce",
    "light soy sauce", "dark soy sauce", "sweet soy sauce", "reduced-sodium soy sauce", "tamari soy sauce", "sriracha hot sauce", "hot chili sauce",
]
MIXTURES = [
    "vinaigrette", "dressing", "marinade", "glaze", "rub", "aioli", "remoulade", "hollandaise", "béchamel", "bechamel", "beurre blanc", "chimichurri", "gremolata", "salsa verde",
    "compound butter", "herb butter", "garlic butter",
]
MIXTURE_ENDS = [" sauce", " dressing", " vinaigrette", " marinade", " glaze", " rub", " relish", " chutney"]
_name = lambda: F.trim(F.lower(t()))
_listed_sql = lambda xs: ", ".join("'" + x + "'" for x in xs)
on_texts("FLT-8_composite", lambda: ~_name().isin(KNOWN_SAUCES) & (_name().isin(MIXTURES) | F.exists(F.array(*[F.lit(x) for x in MIXTURE_ENDS]), lambda x: F.endswith(_name(), x))),
         f"trim(lower(t)) NOT IN ({_listed_sql(KNOWN_SAUCES)}) AND (trim(lower(t)) IN ({_listed_sql(MIXTURES)}) OR " + " OR ".join(f"ends_with(trim(lower(t)), '{x}')" for x in MIXTURE_ENDS) + ")", SHORT)
_path = lambda: F.regexp_extract(t(), r"^https?://[^/]+(/[^?#]*)", 1)
on_texts("FLT-16_url_preclass", lambda: F.when(_path() == "", "none").when(_path().rlike(r"\.(jpg|png|css|js|svg)$"), "drop").when(_path().rlike("/(category|tag|author)/"), "drop").when(_path().rlike("/(recette|recipe)s?/"), "recipe").otherwise("ambiguous"),
         "(SELECT CASE WHEN p = '' THEN 'none' WHEN regexp_matches(p, '\\.(jpg|png|css|js|svg)$') THEN 'drop' WHEN regexp_matches(p, '/(category|tag|author)/') THEN 'drop' WHEN regexp_matches(p, '/(recette|recipe)s?/') THEN 'recipe' ELSE 'ambiguous' END FROM (SELECT regexp_extract(t, '^https?://[^/]+(/[^?#]*)', 1) AS p))")
on("FLT-17_sitemap_url", "pages", "page_id", lambda: F.lower("url").endswith(".xml") | F.contains(F.lower("url"), F.lit("sitemap")), "ends_with(lower(url), '.xml') OR contains(lower(url), 'sitemap')")
on("FLT-21_balanced", "foods", "id", lambda: F.when(K() > 0, (P() * 4 / K() * 100).between(15, 35) & (C() * 4 / K() * 100).between(40, 65) & (A() * 9 / K() * 100).between(20, 35)), "CASE WHEN kcal > 0 THEN protein * 4 / kcal * 100 BETWEEN 15 AND 35 AND carbs * 4 / kcal * 100 BETWEEN 40 AND 65 AND fat * 9 / kcal * 100 BETWEEN 20 AND 35 END")
on("FLT-18_whole_word", "ingredients", "rid, pos", lambda: text.whole_word(F.col("name"), F.lit("oil")), "regexp_matches(name, '(^|[^A-Za-z0-9_])oil($|[^A-Za-z0-9_])')")
on_texts("FLT-20_time_mention", lambda: F.lower(t()).rlike(r"\d+\s*(h|min|minutes?|heures?|hours?)\b"), "regexp_matches(lower(t), '\\d+\\s*(h|min|minutes?|heures?|hours?)\\b')")

QUERIES, SQL = catalog.queries, catalog.sql
