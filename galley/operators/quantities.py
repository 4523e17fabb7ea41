"""Shown quantities, repairs of broken ones, references between steps and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions import display as dp
from galley.functions.units import broken_fraction, rounded, sql_rounded
from galley.operators.audit import edges
from galley.operators.nutrition import PROFILES_SQL, profiles_of
from galley.plans.adapters import view, with_views
from galley.plans.catalog import Catalog

catalog = Catalog()


def add(name: str, f, sql: str | None = None) -> None:
    catalog.add(name, f, sql and with_views(sql))


_near = lambda p: "list_min([" + ", ".join(f"{{'d': abs({x}e0 - {p}), 'x': {x}e0}}" for x in dp.FRACTIONS) + "]).x"
_fraction = lambda v: f"CASE WHEN {v} - floor({v}) = 0 THEN {v} ELSE floor({v}) + {_near(f'({v} - floor({v}))')} END"
_show = lambda v: f"CASE WHEN {v} - floor({v}) = 0 THEN CAST(CAST(floor({v}) AS BIGINT) AS VARCHAR) ELSE CASE WHEN floor({v}) = 0 THEN '' ELSE CAST(CAST(floor({v}) AS BIGINT) AS VARCHAR) END || list_min([" + ", ".join(f"{{'d': abs({x}e0 - ({v} - floor({v}))), 'i': {i}, 's': '{s}'}}" for i, (x, s) in enumerate([(1.0, "1"), *dp.FRACTIONS.items()])) + "]).s END"
_half = lambda e, u: f"floor({e} / {u}e0 + 0.5) * {u}e0"
_grams = lambda g: f"CASE WHEN {g} < 20 THEN {_half(g, 1)} WHEN {g} < 100 THEN {_half(g, 5)} ELSE {_half(g, 10)} END"
_ml = lambda m: f"CASE WHEN {m} >= 1000 THEN floor({m} / 100 + 0.5) / 10 WHEN {m} >= 500 THEN {_half(m, 25)} WHEN {m} >= 100 THEN {_half(m, 10)} WHEN {m} >= 15 THEN {_half(m, 5)} ELSE {_half(m, 1)} END"
_metric_w = lambda g: f"CASE WHEN {g} >= 1000 THEN floor({g} / 100 + 0.5) / 10 ELSE {_grams(g)} END"
_imp_w = lambda g: f"CASE WHEN {g} >= 907 THEN floor({g} / (453.6e0 / 4) + 0.5) / 4 ELSE floor({g} / (28.35e0 / 2) + 0.5) / 2 END"
_imp_v = lambda m: f"CASE WHEN {m} / 240 >= 0.2e0 THEN {_fraction(f'({m} / 240)')} WHEN {m} / 15 >= 0.5e0 THEN floor({m} / 15 * 2 + 0.5) / 2 ELSE {_fraction(f'({m} / 5)')} END"

for _name, _f, _sql in (
    ("NUM-22_gram_rounding", lambda: dp.round_grams(F.col("kcal")), _grams("kcal")),
    ("NUM-23_fraction_rounding", lambda: rounded(dp.round_fraction(F.col("kcal") / 8), 6), sql_rounded(_fraction("(kcal / 8)"), 6)),
    ("NUM-24_fraction_display", lambda: dp.show_fraction(F.col("kcal") / 8), _show("(kcal / 8)")),
    ("NUM-27_ml_rounding", lambda: dp.round_ml(F.col("kcal") * 2).quantity, _ml("(kcal * 2)")),
    ("NUM-28_metric_weight", lambda: dp.round_metric_weight(F.col("kcal") * 2).quantity, _metric_w("(kcal * 2)")),
    ("NUM-29_imperial_weight", lambda: dp.round_imperial_weight(F.col("kcal") * 2).quantity, _imp_w("(kcal * 2)")),
    ("NUM-30_imperial_volume", lambda: rounded(dp.round_imperial_volume(F.col("kcal")).quantity, 6), sql_rounded(_imp_v("kcal"), 6)),
):
    add(_name, lambda s, d, f=_f: view(s, d, "foods").select("id", f().alias("value")), f"SELECT id, {_sql} AS value FROM foods")

_case = lambda t: "CASE unit " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in t.items()) + " END"
_IMP = "coalesce(unit IN (" + ", ".join(f"'{x}'" for x in dp.IMPERIAL) + "), false)"
_BOTH = f"c AS (SELECT *, quantity * {_case(dp.TO_G)} AS g, quantity * {_case(dp.TO_ML)} AS ml, {_IMP} AS imp FROM ingredients)"
for _system, _move, _w, _wu, _v, _vu in (
    ("metric", "imp", _metric_w("g"), "CASE WHEN g >= 1000 THEN 'kg' ELSE 'g' END", _ml("ml"), "CASE WHEN ml >= 1000 THEN 'l' ELSE 'ml' END"),
    ("imperial", "NOT imp", _imp_w("g"), "CASE WHEN g >= 907 THEN 'lb' ELSE 'oz' END", _imp_v("ml"), "CASE WHEN ml / 240 >= 0.2e0 THEN 'cup' WHEN ml / 15 >= 0.5e0 THEN 'tbsp' ELSE 'tsp' END"),
):
    add(f"NUM-25_to_{_system}", lambda s, d, y=_system: view(s, d, "ingredients").select("rid", "pos", dp.convert(F.col("quantity"), F.col("unit"), y).alias("c")).select("rid", "pos", rounded(F.col("c.quantity"), 6).alias("quantity"), F.col("c.unit").alias("unit")),
        f"WITH {_BOTH} SELECT rid, pos, {sql_rounded(f'CASE WHEN {_move} AND g IS NOT NULL THEN {_w} WHEN {_move} AND ml IS NOT NULL THEN {_v} ELSE quantity END', 6)} AS quantity, CASE WHEN {_move} AND g IS NOT NULL THEN {_wu} WHEN {_move} AND ml IS NOT NULL THEN {_vu} ELSE unit END AS unit FROM c")
add("NUM-31_converted_format", lambda s, d: view(s, d, "ingredients").where("unit in ('cup', 'tbsp', 'tsp')").select("rid", "pos", F.when(F.coalesce(F.col("quantity"), F.lit(0.0)) == 0, "-").otherwise(F.concat(dp.show_fraction(F.col("quantity") / 4), F.lit(" "), "unit")).alias("value")),
    f"SELECT rid, pos, CASE WHEN coalesce(quantity, 0) = 0 THEN '-' ELSE {_show('(quantity / 4)')} || ' ' || unit END AS value FROM ingredients WHERE unit IN ('cup', 'tbsp', 'tsp')")
add("NUM-34_amount_unit", lambda s, d: view(s, d, "ingredients").withColumn("a", F.col("quantity") * 40).select("rid", "pos", F.when((F.col("a") >= 1000) & F.col("unit").isin("g", "ml"), rounded(F.col("a") / 1000, 2)).otherwise(rounded(F.col("a"), 2)).alias("amount"), F.when((F.col("a") >= 1000) & (F.col("unit") == "g"), "kg").when((F.col("a") >= 1000) & (F.col("unit") == "ml"), "l").otherwise(F.col("unit")).alias("unit")),
    f"SELECT rid, pos, CASE WHEN quantity * 40 >= 1000 AND unit IN ('g', 'ml') THEN {sql_rounded('quantity * 40 / 1000', 2)} ELSE {sql_rounded('quantity * 40', 2)} END AS amount, CASE WHEN quantity * 40 >= 1000 AND unit = 'g' THEN 'kg' WHEN quantity * 40 >= 1000 AND unit = 'ml' THEN 'l' ELSE unit END AS unit FROM ingredients")

#: The largest plausible quantity of a unit.
PLAUSIBLE = {"cup": 20.0, "cups": 20.0, "tbsp": 50.0, "tsp": 100.0, "cs": 50.0, "cc": 100.0, "piece": 50.0, "pieces": 50.0, "slice": 50.0, "slices": 50.0}


def repaired(ingredients: DataFrame) -> DataFrame:
    """Quantities and units after the repairs of broken fractions: ``/2 cup``, ``1 tablespoon plus 1 teaspoon`` in a name, too much of a small unit."""
    from galley.functions.units import lookup

    unit = F.coalesce("unit", F.lit(""))
    divisor, cut = broken_fraction(unit)
    # two amounts joined by plus: each a number and a spoon
    amounts = F.split(F.lower("name"), " plus ")
    of = lambda i, spoon: F.regexp_extract(F.get(amounts, F.lit(i)), f"^([0-9]+) {spoon}", 1).try_cast("double")
    spoons = F.when(F.size(amounts) == 2, of(0, "(tablespoons?|tbsp)$") * 3 + of(1, "(teaspoons?|tsp) "))
    much = F.col("quantity") > lookup(PLAUSIBLE, F.lower(F.trim(unit)))
    return ingredients.withColumns({"divisor": divisor, "cut": cut, "spoons": spoons}).select(
        "rid", "pos",
        F.when(F.col("divisor").isNotNull(), rounded(F.greatest(F.coalesce("quantity", F.lit(1.0)), F.lit(1.0)) / F.col("divisor"), 4)).when(F.col("spoons").isNotNull(), F.col("spoons")).when(much, None).otherwise(F.col("quantity")).alias("quantity"),
        F.when(F.col("divisor").isNotNull(), F.col("cut")).when(F.col("spoons").isNotNull(), "tsp").otherwise(F.col("unit")).alias("unit"),
    )


add("NUM-6_fraction_repair", lambda s, d: repaired(view(s, d, "ingredients")), f"""SELECT rid, pos, CASE WHEN regexp_matches(unit, '^/\\d+\\s+.+') THEN {sql_rounded("greatest(coalesce(quantity, 1), 1) / CAST(regexp_extract(unit, '^/(\\d+)', 1) AS DOUBLE)", 4)}
    WHEN quantity > CASE lower(trim(unit)) {" ".join(f"WHEN '{k}' THEN {v}e0" for k, v in PLAUSIBLE.items())} END THEN NULL ELSE quantity END AS quantity,
    CASE WHEN regexp_matches(unit, '^/\\d+\\s+.+') THEN trim(regexp_extract(unit, '^/(\\d+)\\s+(.+)', 2)) ELSE unit END AS unit FROM ingredients""")  # fmt: skip


def schedule(steps: DataFrame) -> DataFrame:
    """Start and end of every step: after what it uses, and after the last step of its lane.

    Active steps share one lane, passive ones have their sub-recipe's. The order in which lanes fill matters, so
    each recipe's rows are folded in order of position; a missing duration counts three minutes.
    """
    uses = edges(steps).groupBy("rid", "pos").agg(F.collect_set("to_pos").alias("uses"))
    lane = F.when(F.col("passive"), F.col("sub_recipe")).otherwise("you").alias("lane")
    rows = steps.join(uses, ["rid", "pos"], "left").select("rid", F.struct("pos", F.coalesce("minutes", F.lit(3.0)).alias("m"), lane, F.coalesce("uses", F.array().cast("array<int>")).alias("uses")).alias("x"))
    rows = rows.groupBy("rid").agg(F.sort_array(F.collect_list("x")).alias("rows"))
    state = "named_struct('ends', cast(map() as map<int,double>), 'lanes', cast(map() as map<string,double>), 'out', cast(array() as array<struct<pos:int,lane:string,start:double,end:double>>))"
    fold = f"""aggregate(rows, {state}, (acc, x) -> transform(
        array(greatest(0D, coalesce(acc.lanes[x.lane], 0D), coalesce(array_max(transform(x.uses, u -> acc.ends[u])), 0D))),
        start -> named_struct(
            'ends', map_concat(acc.ends, map(x.pos, start + x.m)),
            'lanes', map_concat(map_filter(acc.lanes, (k, v) -> k <> x.lane), map(x.lane, start + x.m)),
            'out', concat(acc.out, array(named_struct('pos', x.pos, 'lane', x.lane, 'start', start, 'end', start + x.m)))
        ))[0])"""
    return rows.select("rid", F.explode(F.expr(fold)["out"]).alias("x")).select("rid", "x.pos", "x.lane", "x.start", "x.end")


add("GRF-2_schedule", lambda s, d: schedule(view(s, d, "steps")))


def resolved(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """Each reference's id: itself, else without its number, else with another number up to 5."""
    base = F.regexp_extract("ref", r"^(.+?)_\d+$", 1)
    asked = refs.withColumn("tries", F.when(base == "", F.array("ref")).otherwise(F.concat(F.array(F.col("ref"), base), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda n: F.concat(base, F.lit("_"), n.cast("string"))))))
    found = asked.select("rid", "ref", F.posexplode("tries").alias("n", "id")).join(ids.select("rid", "id").distinct(), ["rid", "id"])
    best = found.groupBy("rid", "ref").agg(F.min_by("id", "n").alias("id"))
    return refs.distinct().join(best, ["rid", "ref"], "left")


def _ids(s, d):
    return view(s, d, "ingredients").where("name <> ''").select("rid", F.replace("name", F.lit(" "), F.lit("_")).alias("id"))


def _refs(s, d):
    return view(s, d, "ingredients").where("name <> ''").select("rid", F.concat(F.replace("name", F.lit(" "), F.lit("_")), F.when(F.col("pos") % 2 == 0, "_3").otherwise(F.when(F.col("pos") == 3, "x").otherwise(""))).alias("ref")).distinct()


for _id in ("JOI-20_reference_resolution", "JOI-22_suffix_strip"):
    add(_id, lambda s, d: resolved(_refs(s, d), _ids(s, d)), """WITH ids AS (SELECT DISTINCT rid, replace(name, ' ', '_') AS id FROM ingredients WHERE name <> ''),
      refs AS (SELECT DISTINCT rid, replace(name, ' ', '_') || CASE WHEN pos % 2 = 0 THEN '_3' WHEN pos = 3 THEN 'x' ELSE '' END AS ref FROM ingredients WHERE name <> '')
      SELECT r.rid, r.ref, coalesce(a.id, b.id) AS id FROM refs r LEFT JOIN ids a ON a.rid = r.rid AND a.id = r.ref LEFT JOIN ids b ON b.rid = r.rid AND b.id = regexp_extract(r.ref, '^(.+?)_\\d+$', 1)""")  # fmt: skip
add("PRJ-2_slim_nutrition", lambda s, d: profiles_of(s, d).select("rid", "kcal", "protein", "fat", "carbs", "fiber", "confidence"), f"{PROFILES_SQL} SELECT rid, kcal, protein, fat, carbs, fiber, confidence FROM profiles")
add("PRJ-15_analysis_nutrition", lambda s, d: profiles_of(s, d).where("confidence <> 'none'").select("rid", "kcal", "protein"), f"{PROFILES_SQL} SELECT rid, kcal, protein FROM profiles WHERE confidence <> 'none'")
add("FLT-23_high_confidence", lambda s, d: profiles_of(s, d).where("confidence = 'high'").select("rid"), f"{PROFILES_SQL} SELECT rid FROM profiles WHERE confidence = 'high'")
add("FLT-7_planner_filter", lambda s, d: profiles_of(s, d).join(view(s, d, "recipes").where("recipe_type not in ('base', 'dessert', 'drink', 'appetizer')").select("rid"), "rid", "left_semi").where("confidence = 'high'").select("rid"), f"{PROFILES_SQL} SELECT rid FROM profiles JOIN recipes USING (rid) WHERE confidence = 'high' AND recipe_type NOT IN ('base', 'dessert', 'drink', 'appetizer')")
add("AGG-50_macro_bars", lambda s, d: profiles_of(s, d).where("kcal > 0").select("rid", F.floor(F.col("protein") * 4 / F.col("kcal") * 100 + 0.5).alias("pct")), f"{PROFILES_SQL} SELECT rid, CAST(floor(protein * 4 / kcal * 100 + 0.5) AS BIGINT) AS pct FROM profiles WHERE kcal > 0")
add("AGG-40_recipe_ingredients", lambda s, d: view(s, d, "ingredients").where("name <> ''").groupBy("rid", "name", "category").agg(F.count("*").alias("n")), "SELECT rid, name, category, count(*) AS n FROM ingredients WHERE name <> '' GROUP BY ALL")
add("AGG-54_sub_recipe_stats", lambda s, d: view(s, d, "steps").groupBy("rid", "sub_recipe").agg(F.count("*").alias("n"), F.count_if("passive").alias("passive")), "SELECT rid, sub_recipe, count(*) AS n, count(*) FILTER (WHERE passive) AS passive FROM steps GROUP BY ALL")
add("NST-3_sitemap_locs", lambda s, d: view(s, d, "recipes").where("source_url is not null").select("rid", F.concat(F.lit("<urlset><url><loc> "), "source_url", F.lit(" </loc></url></urlset>")).alias("x")).select("rid", F.trim(F.get(F.regexp_extract_all("x", F.lit("<loc>([^<]*)</loc>"), F.lit(1)), F.lit(0))).alias("loc")), "SELECT rid, source_url AS loc FROM recipes WHERE source_url IS NOT NULL")
add("NST-7_sse_events", lambda s, d: view(s, d, "events").select("event_id", F.from_json("props", "struct<k:bigint>").k.alias("k")), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")

QUERIES, SQL = catalog.queries, catalog.sql
