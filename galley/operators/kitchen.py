"""What a reader of recipes meets: privacy, nutrition as shown, columns of ingredients; and repairs of parsed lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import text
from galley.functions.units import lookup, rounded, sql_rounded
from galley.operators.names import _FORMS, PARSED_UNITS, _shown
from galley.operators.nutrition import DETAILS_SQL, PROFILES_SQL, details_of, profiles_of
from galley.plans.adapters import view, with_views
from galley.plans.catalog import Catalog
from galley.tables import table

catalog = Catalog()


def add(name: str, f, sql: str) -> None:
    catalog.add(name, f, with_views(sql))


def _quoted(items) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


def _case(e: str, pairs: dict) -> str:
    """SQL for the value of ``e`` in a table, or null."""
    return f"CASE {e} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in pairs.items()) + " END"


def _case_of(e: str, values: list[str]) -> str:
    """SQL for the value at ``e`` modulo the length of a list."""
    return f"CASE {e} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


# --- privacy ---
def is_private(author: Column, config: dict[str, list[str]]) -> Column:
    """Whether one recipe is hidden. A list that is present counts even when empty: an empty ``public`` hides all.

    Words of the lists are compared as they are with the author in lower case; no author matches nothing.
    """
    named = lambda words: F.coalesce(reduce(Column.__or__, [(author != "") & F.contains(F.lower(author), F.lit(w)) for w in words], F.lit(False)), F.lit(False))
    if "public" in config:
        return ~named(config["public"])
    return named(config["private"]) if "private" in config else F.lit(False)


_CONFIGS = {"shown": {"public": ["0001", "0005"]}, "empty": {"public": []}, "hidden": {"private": ["0007"]}, "open": {}}
add(
    "FLT-4_single_privacy",
    lambda s, d: view(s, d, "recipes").select("rid", *[is_private(F.col("author"), c).alias(n) for n, c in _CONFIGS.items()]),
    """SELECT rid, NOT (contains(a, '0001') OR contains(a, '0005')) AS shown, true AS empty, contains(a, '0007') AS hidden, false AS open
      FROM (SELECT rid, lower(coalesce(author, '')) AS a FROM recipes)""",
)

# --- nutrition as shown ---
_SHOWN = {"calories": "kcal", "protein": "protein", "fat": "fat", "carbs": "carbs", "fiber": "fiber", "sugar": "sugar", "saturated_fat": "sat_fat"}


def shown_nutrition(profiles: DataFrame) -> DataFrame:
    """(rid, nutrients, confidence): nothing where the confidence is none; missing nutrients are 0, a missing confidence is low."""
    known = F.coalesce(F.col("confidence"), F.lit("low")) != "none"
    return profiles.select("rid", *[F.when(known, F.coalesce(c, F.lit(0.0))).alias(n) for n, c in _SHOWN.items()], F.when(known, F.coalesce("confidence", F.lit("low"))).alias("confidence"))


add(
    "PRJ-17_shown_nutrition",
    lambda s, d: shown_nutrition(profiles_of(s, d)),
    f"{PROFILES_SQL} SELECT rid, {', '.join(f'''CASE WHEN confidence <> 'none' THEN coalesce({c}, 0.0) END AS {n}''' for n, c in _SHOWN.items())}, nullif(confidence, 'none') AS confidence FROM profiles",
)


def detail_totals(details: DataFrame, recipes: DataFrame) -> DataFrame:
    """(rid, calories a serving, shares of the energy): fat takes what protein and carbohydrates leave of 100."""
    sums = details.where("status = 'resolved'").groupBy("rid").agg(*[F.sum(f"c_{n}").alias(n) for n in ("kcal", "protein", "carbs", "fat")])
    energy = F.col("protein") * 4 + F.col("carbs") * 4 + F.col("fat") * 9
    share = lambda n: F.floor(F.col(n) * 400.0 / F.when(energy == 0, 1).otherwise(energy) + 0.5)
    out = sums.join(recipes.select("rid", "servings"), "rid")
    out = out.select("rid", rounded(F.col("kcal") / 10.0 / F.col("servings"), 1).alias("calories"), share("protein").alias("pct_protein"), share("carbs").alias("pct_carbs"))
    return out.withColumn("pct_fat", 100 - F.col("pct_protein") - F.col("pct_carbs"))


_share_sql = lambda n: f"CAST(floor({n} * 400e0 / CASE WHEN e = 0 THEN 1 ELSE e END + 0.5) AS BIGINT)"
add(
    "AGG-48_detail_totals",
    lambda s, d: detail_totals(details_of(s, d), view(s, d, "recipes")),
    f"""{DETAILS_SQL}, t AS (SELECT rid, sum(c_kcal) AS kcal, sum(c_protein) AS protein, sum(c_carbs) AS carbs, sum(c_fat) AS fat FROM details WHERE status = 'resolved' GROUP BY rid),
      u AS (SELECT *, protein * 4 + carbs * 4 + fat * 9 AS e FROM t JOIN recipes USING (rid))
      SELECT rid, {sql_rounded("kcal / 10e0 / servings", 1)} AS calories, {_share_sql("protein")} AS pct_protein, {_share_sql("carbs")} AS pct_carbs, 100 - {_share_sql("protein")} - {_share_sql("carbs")} AS pct_fat FROM u""",
)


# --- columns of ingredients ---
def balanced_columns(ingredients: DataFrame) -> DataFrame:
    """(rid, category, column): the largest group first, each to the column of three that holds least; ties to the first.

    Groups of equal size come as they stand in the recipe. What is folded in one row are a recipe's categories.
    """
    groups = ingredients.groupBy("rid", "category").agg(F.count("*").cast("int").alias("n"), F.min("pos").alias("pos"))
    groups = groups.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "pos", "category"))).alias("groups"))
    start = F.struct(F.array(*[F.lit(0)] * 3).alias("held"), F.array().cast("array<struct<category:string,column:int>>").alias("out"))

    def place(done: Column, group: Column) -> Column:
        at = (F.array_position(done.held, F.array_min(done.held)) - 1).cast("int")
        held = F.transform(done.held, lambda n, i: F.when(i == at, n - group.less).otherwise(n))
        return F.struct(held.alias("held"), F.concat(done.out, F.array(F.struct(group.category.alias("category"), at.alias("column")))).alias("out"))

    return groups.select("rid", F.inline(F.aggregate("groups", start, place).getField("out")))


add(
    "WIN-18_balanced_columns",
    lambda s, d: balanced_columns(view(s, d, "ingredients")),
    """WITH RECURSIVE g AS (SELECT rid, category, count(*) AS n, row_number() OVER (PARTITION BY rid ORDER BY count(*) DESC, min(pos)) AS k FROM ingredients GROUP BY rid, category),
      p AS (SELECT DISTINCT rid, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, CAST(NULL AS VARCHAR) AS category, 0 AS col FROM g
        UNION ALL SELECT rid, k, a + CASE col WHEN 0 THEN n ELSE 0 END, b + CASE col WHEN 1 THEN n ELSE 0 END, c + CASE col WHEN 2 THEN n ELSE 0 END, category, col
          FROM (SELECT g.rid, g.k, g.n, g.category, a, b, c, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS col FROM p JOIN g ON g.rid = p.rid AND g.k = p.k + 1))
      SELECT rid, category, col AS "column" FROM p WHERE k > 0""",
)


# --- references and fills ---
def named_ingredients(refs: DataFrame, ingredients: DataFrame) -> DataFrame:
    """(rid, ref, pos): the ingredient of the same recipe that a reference names, or null.

    Equal names first (underscores are blanks), else the shortest name that holds the reference as whole words
    or stands so in it; ties to the first. What a recipe names and refers to is gathered once and compared inside
    its arrays; between blanks, a part of the words is a part of the text.
    """
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    words = lambda c: spaced(F.trim(F.regexp_replace(c, r"\s+", " ")))
    r, n = F.trim(F.translate(F.lower("ref"), "_", " ")), F.lower(F.trim("name"))
    asked = refs.groupBy("rid").agg(F.collect_set(F.struct("ref", spaced(F.nullif(r, F.lit(""))).alias("r"), words(r).alias("words"))).alias("asked"))
    names = ingredients.where(n != "").groupBy("rid").agg(F.collect_list(F.struct("pos", spaced(n).alias("n"), words(n).alias("words"))).alias("names"))
    alike = lambda x: F.filter("names", lambda y: y["words"].contains(x["r"]) | x["words"].contains(y["n"]))
    best = lambda x: F.array_min(F.transform(alike(x), lambda y: F.struct(x["r"] != y["n"], F.length(y["n"]), y["pos"].alias("pos"))))["pos"]
    return asked.join(names, "rid", "left").select("rid", F.inline(F.transform("asked", lambda x: F.struct(x["ref"].alias("ref"), best(x).alias("pos")))))


_REFS = """SELECT DISTINCT rid, CASE pos % 3 WHEN 0 THEN replace(name, ' ', '_') WHEN 1 THEN regexp_replace(name, '^.* ', '') ELSE concat('Chopped ', name) END AS ref FROM ingredients WHERE name <> ''
  UNION SELECT rid, produces AS ref FROM steps WHERE pos = 1"""


def _refs(s, d) -> DataFrame:
    ref = F.when(F.col("pos") % 3 == 0, F.translate("name", " ", "_")).when(F.col("pos") % 3 == 1, F.regexp_replace("name", "^.* ", "")).otherwise(F.concat(F.lit("Chopped "), "name"))
    both = F.array(F.when(F.col("name") != "", ref), F.when(F.col("pos") == 1, F.col("produces")))
    return view(s, d, "named_steps").select("rid", F.explode(both).alias("ref")).where("ref is not null")


_holds = "regexp_matches({0}, '(^|[^a-z0-9_])' || {1} || '($|[^a-z0-9_])')".format
add(
    "JOI-21_name_lookup",
    lambda s, d: named_ingredients(_refs(s, d), view(s, d, "ingredients")),
    f"""WITH refs AS ({_REFS}), r AS (SELECT rid, ref, trim(replace(lower(ref), '_', ' ')) AS r FROM refs), n AS (SELECT rid, pos, lower(trim(name)) AS n FROM ingredients WHERE name <> ''),
      c AS (SELECT rid, ref, pos, row_number() OVER (PARTITION BY rid, ref ORDER BY r <> n, length(n), pos) AS k FROM r JOIN n USING (rid) WHERE {_holds('n', 'r')} OR {_holds('r', 'n')})
      SELECT r.rid, r.ref, c.pos FROM r LEFT JOIN c ON c.rid = r.rid AND c.ref = r.ref AND c.k = 1""",
)


def filled_minerals(foods: DataFrame, minerals: DataFrame) -> DataFrame:
    """``foods`` with the calcium of ``minerals`` (id, calcium; one row an id) where they have none."""
    return foods.join(minerals.select("id", F.col("calcium").alias("found")), "id", "left").withColumn("calcium", F.coalesce("calcium", "found")).drop("found")


add(
    "JOI-19_mineral_fill",
    lambda s, d: filled_minerals(view(s, d, "foods"), table(s, d, "part").where("p_partkey % 4 > 0").groupBy(F.col("p_partkey").alias("id")).agg(F.max("p_size").cast("double").alias("calcium"))).select("id", "calcium"),
    "SELECT id, coalesce(calcium, found) AS calcium FROM foods LEFT JOIN (SELECT p_partkey AS id, CAST(max(p_size) AS DOUBLE) AS found FROM part WHERE p_partkey % 4 > 0 GROUP BY p_partkey) USING (id)",
)

# --- parsed quantities ---
#: Units that a parsed line may have, plurals that the table of short names lacks, and what size words do.
PLAIN_UNITS = [
    "pinch", "handful", "dash", "splash", "sprig", "bunch", "slice", "piece", "clove", "leaf", "stalk", "head", "drop", "dollop", "knob", "strip", "sheet", "stick", "wedge", "ear", "bulb",
    "grating", "segment", "scoop", "cup", "tbsp", "tsp", "g", "kg", "ml", "l", "cl", "dl", "oz", "lb", "can",
]
PLURALS = {"drops": "drop", "dollops": "dollop", "splashes": "splash", "dashes": "dash", "gratings": "grating", "grinds": "grind", "segments": "segment", "scoops": "scoop", "thin slices": "slice", "thin slice": "slice"}
SIZES = {"scant": 0.85, "heaping": 1.25, "heaped": 1.0, "generous": 1.25, "big": 1.5, "small": 0.75, "large": 1.5, "level": 1.0, "rounded": 1.15, "tiny": 0.5, "good": 1.15}
ALONE = {"scant": (0.85, "tsp"), "heaping": (1.25, "tbsp"), "heaped": (1.25, "tbsp"), "generous": (1.25, "tbsp"), "tiny": (0.5, "tsp"), "good": (1.25, "tbsp")}
_ALONE_Q, _ALONE_U = ({k: v[i] for k, v in ALONE.items()} for i in (0, 1))


def mended_quantity(quantity: Column, unit: Column) -> Column:
    """(quantity, unit, source, modifier) of a parsed line: size words scale, stand for a unit alone, and units without a number mean one."""
    plain = text.let(F.lower(F.trim(unit)), lambda x: F.coalesce(lookup(PLURALS, x), x))
    words = lambda x: F.struct(x.alias("low"), F.split_part(x, F.lit(" "), F.lit(1)).alias("head"), F.trim(F.regexp_replace(x, "^[^ ]* ?", "")).alias("rest"))

    def judged(x: Column) -> Column:
        real = F.coalesce(lookup(PARSED_UNITS, x["rest"]), lookup(PLURALS, x["rest"]), x["rest"])
        short = F.coalesce(lookup(PARSED_UNITS, x["low"]), x["low"])
        return F.struct(
            x["low"].alias("low"), x["head"].alias("head"), real.alias("real"), short.alias("short"), (x["head"].isin(*SIZES) & (real.isin(*PLAIN_UNITS) | x["rest"].isin(*PARSED_UNITS))).alias("sized"),
            (x["low"].isin(*ALONE) & quantity.isNull()).alias("alone"), (quantity.isNull() & short.isin(*PLAIN_UNITS)).alias("one"),
        )

    def mended(x: Column) -> Column:
        low, head, real, short, sized, alone, one = (x[n] for n in ("low", "head", "real", "short", "sized", "alone", "one"))
        return F.struct(
            F.when(sized, rounded(F.coalesce(quantity, F.lit(1.0)) * lookup(SIZES, head), 2)).when(alone, lookup(_ALONE_Q, low)).when(one, F.lit(1.0)).otherwise(quantity).alias("quantity"),
            F.when(sized, real).when(alone, lookup(_ALONE_U, low)).when(short != low, short).when(one, short).otherwise(unit).alias("unit"),
            F.when(sized | alone | one, "inferred").alias("source"), F.when(sized, head).when(alone, low).alias("modifier"),
        )

    return text.let(text.let(text.let(plain, words), judged), mended)


_said = lambda: F.when(F.col("pos") % 5 == 0, F.concat(F.lit("Heaping "), "unit")).when(F.col("pos") % 5 == 1, F.concat("unit", F.lit("s"))).when(F.col("pos") % 5 == 2, "scant").when(F.col("pos") % 5 == 3, "thin slices").otherwise(F.col("unit"))
add(
    "NUM-4_mended_quantity",
    lambda s, d: view(s, d, "ingredients").select("rid", "pos", mended_quantity(F.col("quantity"), _said()).alias("m")).select("rid", "pos", "m.*"),
    f"""WITH a AS (SELECT rid, pos, quantity, CASE pos % 5 WHEN 0 THEN 'Heaping ' || unit WHEN 1 THEN unit || 's' WHEN 2 THEN 'scant' WHEN 3 THEN 'thin slices' ELSE unit END AS said FROM ingredients),
      b AS (SELECT *, coalesce({_case('lower(trim(said))', PLURALS)}, lower(trim(said))) AS low FROM a), c AS (SELECT *, split_part(low, ' ', 1) AS head, trim(regexp_replace(low, '^[^ ]* ?', '')) AS rest FROM b),
      e AS (SELECT *, coalesce({_case('rest', PARSED_UNITS)}, {_case('rest', PLURALS)}, rest) AS whole, coalesce({_case('low', PARSED_UNITS)}, low) AS short FROM c),
      f AS (SELECT *, coalesce(head IN {_quoted(SIZES)} AND (whole IN {_quoted(PLAIN_UNITS)} OR rest IN {_quoted(PARSED_UNITS)}), false) AS sized,
        coalesce(low IN {_quoted(ALONE)} AND quantity IS NULL, false) AS alone, coalesce(short IN {_quoted(PLAIN_UNITS)} AND quantity IS NULL, false) AS single FROM e)
      SELECT rid, pos, CASE WHEN sized THEN {sql_rounded(f"coalesce(quantity, 1) * CAST({_case('head', SIZES)} AS DOUBLE)", 2)} WHEN alone THEN CAST({_case('low', _ALONE_Q)} AS DOUBLE) WHEN single THEN 1.0 ELSE quantity END AS quantity,
        CASE WHEN sized THEN whole WHEN alone THEN {_case('low', _ALONE_U)} WHEN short <> low OR single THEN short ELSE said END AS unit,
        CASE WHEN sized OR alone OR single THEN 'inferred' END AS source, CASE WHEN sized THEN head WHEN alone THEN low END AS modifier FROM f""",
)

# --- forms of a name ---
#: Words that say how a food was treated, not which food it is.
TREATED = [
    "raw", "cooked", "boiled", "fresh", "dried", "frozen", "canned", "peeled", "unpeeled", "unprepared", "prepared", "drained", "salted", "unsalted", "whole", "ground", "powdered", "pure",
    "from cow's milk", "from sheep's milk", "from goat's milk",
]
_TREATED = r"\b(" + "|".join(TREATED) + r")\b"


def name_forms(name: Column) -> Column:
    """The sorted forms of more than two letters under which a listed name may be met.

    They are the name, the name without words of treatment, either with its first part last, and what words
    of treatment leave of those. Null gives no form.
    """
    plain = lambda c: F.btrim(F.regexp_replace(F.regexp_replace(c, _TREATED, ""), r"\s+", " "), F.lit(" ,"))

    def first_last(c: Column) -> Column:
        parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
        return F.when(F.size(parts) > 1, F.regexp_replace(F.concat_ws(" ", F.slice(parts, 2, F.size(parts)), parts[0]), r"\s+", " "))

    low = F.regexp_replace(F.lower(F.trim(name)), r"'s\b", "")
    base = F.btrim(F.regexp_replace(plain(low), r"\s*,\s*", ", "), F.lit(", "))
    forms = F.array(low, base, first_last(low), first_last(base))
    return F.array_sort(F.array_distinct(F.filter(F.concat(forms, F.transform(forms, plain)), lambda x: F.length(x) > 2)))


_plain_sql = lambda e: "trim(regexp_replace(regexp_replace({}, '{}', '', 'g'), '\\s+', ' ', 'g'), ' ,')".format(e, _TREATED.replace("'", "''"))
_parts_sql = lambda e: f"list_filter(list_transform(string_split({e}, ','), lambda x: trim(x)), lambda x: x <> '')"
add(
    "SET-5_name_forms",
    lambda s, d: _shown(s, d).select("id", F.array_join(name_forms(F.col("shown")), "|").alias("forms")),
    f"""WITH a AS (SELECT id, lower(name || ', ' || {_case_of("id", _FORMS)}) AS low FROM foods), b AS (SELECT *, trim(regexp_replace({_plain_sql("low")}, '\\s*,\\s*', ', ', 'g'), ', ') AS base FROM a),
      c AS (SELECT *, {_parts_sql("low")} AS p, {_parts_sql("base")} AS q FROM b),
      e AS (SELECT id, [low, base, CASE WHEN len(p) > 1 THEN array_to_string(p[2:], ' ') || ' ' || p[1] END, CASE WHEN len(q) > 1 THEN array_to_string(q[2:], ' ') || ' ' || q[1] END] AS forms FROM c)
      SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_concat(forms, list_transform(forms, lambda x: {_plain_sql("x")})), lambda x: length(x) > 2))), '|') AS forms FROM e""",
)

# --- errors ---
#: Words of a message (m), an error's type (t) or its trace (s) that name the stage; the first stage wins.
STAGES = [
    ("pass2_validation", "m", ["validation"]), ("llm_rate_limit", "m", ["rate limit", "429", "quota", "insufficient"]), ("llm_timeout", "m", ["timeout", "timed out", "connect"]),
    ("llm_api_error", "m", ["api", "openai", "openrouter", "500", "502", "503"]), ("recipe_rejected", "m", ["rejected", "not_a_recipe"]), ("pass1_preformat", "s", ["preformat"]),
    ("pass2_dag", "s", ["pass 2", "dag", "instructor"]), ("enrichment", "s", ["enrich", "nutrition"]), ("scraping", "s", ["scrape", "httpx", "web_scraper"]),
]


def error_stage(kind: Column, message: Column, trace: Column) -> Column:
    """The stage in which an import failed."""
    read = {"m": F.lower(F.coalesce(message, F.lit(""))), "s": F.lower(F.coalesce(trace, F.lit("")))}
    has = lambda c, words: reduce(Column.__or__, [F.contains(read[c], F.lit(w)) for w in words])
    typed = F.when(F.contains(F.coalesce(kind, F.lit("")), F.lit("ValidationError")), STAGES[0][0])
    return F.coalesce(typed, *[F.when(has(c, words), stage) for stage, c, words in STAGES], F.lit("unknown"))


_MESSAGES = ["Validation of steps", "HTTP 429", "read timed out", "status 503", "page rejected", "no text", "no text", "no text", "no text", "no text", "no text"]
_TRACES = ["", "", "", "", "", "in preformat()", "pass 2 of generate()", "in enrich_recipe()", "httpx.get", "", ""]
_at = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % len(xs) + 1).cast("int"))
add(
    "AGG-57_error_stages",
    lambda s, d: view(s, d, "progress").where("status = 'error'").groupBy(error_stage(F.when(F.col("event_id") % 11 == 10, "ValidationError"), _at(_MESSAGES), _at(_TRACES)).alias("stage")).agg(F.count("*").alias("n")),
    f"""SELECT CASE WHEN event_id % 11 = 10 THEN 'pass2_validation' {' '.join("WHEN " + " OR ".join(f"contains({c}, '{w}')" for w in words) + f" THEN '{stage}'" for stage, c, words in STAGES)} ELSE 'unknown' END AS stage, count(*) AS n
      FROM (SELECT event_id, lower({_case_of("event_id", _MESSAGES)}) AS m, lower({_case_of("event_id", _TRACES)}) AS s FROM progress WHERE status = 'error') GROUP BY 1""",
)

QUERIES, SQL = catalog.queries, catalog.sql
