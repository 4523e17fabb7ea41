"""Loaders of nested documents, lookups by tiers, comparisons, pantry and the greedy meal plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galley import dims
from galley.functions import text, time
from galley.functions.units import piece_grams, rounded, sql_rounded
from galley.operators.audit import _SCORE, first_score
from galley.operators.nutrition import DETAILS_SQL, NAMES_SQL, PROFILES_SQL, details_of, profiles_of, sql_singular
from galley.plans.adapters import view, with_views
from galley.plans.catalog import Catalog

catalog = Catalog()


def add(name: str, f, sql: str | None = None) -> None:
    catalog.add(name, f, sql and with_views(sql))


# --- nested documents ---
def cache_entries(docs: DataFrame) -> DataFrame:
    """Entries of JSON objects by key; keys that begin with an underscore describe the file."""
    m = F.map_filter(F.from_json("doc", "map<string,struct<kcal:double,not_found:boolean>>"), lambda k, v: ~k.startswith("_"))
    return docs.select(F.explode(m).alias("key", "v")).select("key", "v.kcal", F.coalesce("v.not_found", F.lit(False)).alias("not_found"))


def _cache_docs(s, d):
    entry = F.struct(F.col("kcal"), (F.col("kcal") > 800).alias("not_found"))
    return view(s, d, "foods").where("id % 3 = 0").select(F.to_json(F.map_from_arrays(F.array(F.concat(F.lit("food-"), F.col("id").cast("string")), F.lit("_meta")), F.array(entry, entry))).alias("doc"))


_CACHE = "SELECT 'food-' || id AS key, kcal, kcal > 800 AS not_found FROM foods WHERE id % 3 = 0"
for _id in ("SRC-10_nutrition_cache", "SRC-28_match_cache", "SRC-29_weight_cache", "SRC-30_quantity_cache"):
    add(_id, lambda s, d: cache_entries(_cache_docs(s, d)), _CACHE)
add("SRC-14_nested_portions", lambda s, d: view(s, d, "foods").select("id", F.posexplode(F.array(F.struct(F.lit("cup").alias("unit"), (F.col("kcal") * 4).alias("g"), F.lit(2.0).alias("n")), F.struct(F.lit("tbsp").alias("unit"), F.col("fat").alias("g"), F.lit(1.0).alias("n")), F.struct(F.lit("cup").alias("unit"), F.lit(1.0).alias("g"), F.lit(1.0).alias("n")))).alias("k", "p"))
    .select("id", "k", "p.unit", (F.col("p.g") / F.col("p.n")).alias("g")).where("g > 0 and g <= 5000").groupBy("id", "unit").agg(F.min_by("g", "k").alias("grams")),
    "SELECT id, unit, arg_min(g, k) AS grams FROM (SELECT id, 0 AS k, 'cup' AS unit, kcal * 4 / 2 AS g FROM foods UNION ALL SELECT id, 1, 'tbsp', fat FROM foods UNION ALL SELECT id, 2, 'cup', 1e0 FROM foods) WHERE g > 0 AND g <= 5000 GROUP BY id, unit")


def crawl(spark, links: DataFrame, root: int, depth: int = 2) -> DataFrame:
    """Pages within ``depth`` links of the root, each with its least depth, by a recursive query."""
    return spark.sql("""WITH RECURSIVE seen(page, depth) AS (
        SELECT CAST({root} AS BIGINT), 0 UNION ALL SELECT l.to_page, depth + 1 FROM seen JOIN {links} l ON l.page = seen.page WHERE depth < {depth}
      ) SELECT page, min(depth) AS depth FROM seen GROUP BY page""", links=links, root=root, depth=depth)  # fmt: skip


add("SRC-19_crawl", lambda s, d: crawl(s, view(s, d, "recipes").selectExpr("rid as page", "rid * 3 % 1009 as to_page").union(view(s, d, "recipes").selectExpr("rid as page", "rid * 7 % 1013 as to_page")), 5, 3),
    """WITH RECURSIVE links AS (SELECT rid AS page, rid * 3 % 1009 AS to_page FROM recipes UNION ALL SELECT rid, rid * 7 % 1013 FROM recipes),
      seen(page, depth) AS (SELECT CAST(5 AS BIGINT), 0 UNION ALL SELECT l.to_page, depth + 1 FROM seen JOIN links l ON l.page = seen.page WHERE depth < 3) SELECT page, min(depth) AS depth FROM seen GROUP BY page""")  # fmt: skip
add("SRC-24_summaries", lambda s, d: view(s, d, "recipes").select("slug", "title"), "SELECT slug, title FROM recipes")
add("SRC-32_exists_by_slug", lambda s, d: view(s, d, "recipes").where("rid % 5 = 1").select("slug").join(view(s, d, "recipes").where("rid % 3 = 1").select("slug"), "slug", "left_semi"), "SELECT slug FROM recipes WHERE rid % 5 = 1 AND rid % 3 = 1")
add("SRC-31_reference_index", lambda s, d: view(s, d, "foods").groupBy(F.lower("name").alias("key")).agg(F.max("id").alias("id")), "SELECT lower(name) AS key, max(id) AS id FROM foods GROUP BY 1")
add("JOI-27_exists_by_url", lambda s, d: (lambda known: view(s, d, "recipes").where("source_url is not null").select("rid", "source_url").join(known, "source_url", "left").select("rid", F.coalesce("known", F.lit(False)).alias("known")))(view(s, d, "recipes").where("source_url is not null and rid % 4 = 0").select("source_url", F.lit(True).alias("known")).distinct()),
    "SELECT rid, source_url IN (SELECT source_url FROM recipes WHERE source_url IS NOT NULL AND rid % 4 = 0) AS known FROM recipes WHERE source_url IS NOT NULL")

# --- projections and text ---
add("PRJ-3_detail", lambda s, d: view(s, d, "recipes").select("slug", "title", "total_minutes", "author"), "SELECT slug, title, total_minutes, author FROM recipes")
add("PRJ-5_food_result", lambda s, d: view(s, d, "foods").select("id", F.col("kcal").alias("energy_kcal"), F.col("protein").alias("protein_g"), rounded(F.col("kcal") / 900, 3).alias("score")), f"SELECT id, kcal AS energy_kcal, protein AS protein_g, {sql_rounded('kcal / 900', 3)} AS score FROM foods")
add("PRJ-7_amounts", lambda s, d: view(s, d, "ingredients").select("rid", "pos", F.coalesce("quantity", F.lit(0.0)).alias("amount"), F.coalesce("unit", F.lit("")).alias("unit")), "SELECT rid, pos, coalesce(quantity, 0) AS amount, coalesce(unit, '') AS unit FROM ingredients")
add("PRJ-23_embedding_text", lambda s, d: view(s, d, "foods").select("id", F.concat_ws(", ", "name", "source").alias("t")), "SELECT id, name || ', ' || source AS t FROM foods")
add("STR-24_category_rule", lambda s, d: view(s, d, "ingredients").where("category in ('other', 'pantry')").select("name").distinct().select("name", F.when(F.col("name").rlike(r"\b(milk|cream)\b"), "dairy").when(F.col("name").rlike(r"\boil\b"), "oil").when(F.col("name").rlike(r"\b(sugar|honey)\b"), "condiment").alias("category")),
    "SELECT DISTINCT name, CASE WHEN regexp_matches(name, '\\b(milk|cream)\\b') THEN 'dairy' WHEN regexp_matches(name, '\\boil\\b') THEN 'oil' WHEN regexp_matches(name, '\\b(sugar|honey)\\b') THEN 'condiment' END AS category FROM ingredients WHERE category IN ('other', 'pantry')")
add("STR-35_pantry_fold", lambda s, d: view(s, d, "recipes").select("rid", text.fold_name(F.col("title")).alias("t")), "SELECT rid, trim(regexp_replace(strip_accents(lower(title)), '\\s+', ' ', 'g')) AS t FROM recipes")
add("STR-41_season_label", lambda s, d: view(s, d, "recipes").groupBy("author").agg(F.array_sort(F.collect_set(time.season(F.col("month")))).alias("x")).select("author", F.when(F.size("x") == 4, "all").otherwise(F.array_join("x", ", ")).alias("label")),
    "SELECT author, CASE WHEN count(DISTINCT s) = 4 THEN 'all' ELSE string_agg(DISTINCT s, ', ' ORDER BY s) END AS label FROM (SELECT author, CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring' WHEN month IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS s FROM recipes) GROUP BY author")
add("SET-7_plural_aliases", lambda s, d: (lambda n: n.unionByName(n.where("name not like '%s'").select(F.concat("name", F.lit("s")).alias("name")).join(n, "name", "left_anti")))(view(s, d, "foods").select("name").distinct()),
    "WITH n AS (SELECT DISTINCT name FROM foods) SELECT name FROM n UNION ALL SELECT name || 's' FROM n WHERE name NOT LIKE '%s' AND name || 's' NOT IN (SELECT name FROM n)")
add("SET-12_pantry_toggle", lambda s, d: (lambda have, flip: have.join(flip, "name", "left_anti").unionByName(flip.join(have, "name", "left_anti")))(view(s, d, "foods").where("id % 4 = 0").select("name").distinct(), view(s, d, "foods").where("id % 6 = 0").select("name").distinct()),
    "WITH h AS (SELECT DISTINCT name FROM foods WHERE id % 4 = 0), f AS (SELECT DISTINCT name FROM foods WHERE id % 6 = 0) SELECT name FROM h WHERE name NOT IN (SELECT name FROM f) UNION ALL SELECT name FROM f WHERE name NOT IN (SELECT name FROM h)")

# --- lookups by tiers ---
add("JOI-14_default_piece", lambda s, d: view(s, d, "ingredients").where("name <> ''").select("name").distinct().select("name", piece_grams(F.col("name")).alias("grams")), f"{NAMES_SQL} SELECT DISTINCT name, piece AS grams FROM weights WHERE name <> ''")


def portions(names: DataFrame, table: DataFrame) -> DataFrame:
    """Grams of a name and unit from a portion table: by the whole name, then its singular, as equi-joins."""
    n = F.lower(F.trim("name"))
    keys = names.select("name", F.posexplode(F.array(n, text.singular(n))).alias("tier", "key"))
    return keys.join(table, "key").groupBy("name", "unit").agg(F.min_by("grams", "tier").alias("grams"))


_PORTIONS = [(k, u, float(v)) for k, x in dims.PORTION_GRAMS.items() for u, v in x.items()]
add("JOI-10_portion_lookup", lambda s, d: portions(view(s, d, "ingredients").select("name").distinct(), s.createDataFrame(_PORTIONS, "key string, unit string, grams double")),
    f"WITH n AS (SELECT DISTINCT name, lower(trim(name)) AS a, {sql_singular('lower(trim(name))')} AS b FROM ingredients), p(key, unit, grams) AS (VALUES {', '.join(f'''('{k}', '{u}', {v}e0)''' for k, u, v in _PORTIONS)}) SELECT name, unit, arg_min(grams, CASE WHEN key = a THEN 0 ELSE 1 END) AS grams FROM n JOIN p ON key IN (a, b) GROUP BY name, unit")
add("JOI-17_mineral_backfill", lambda s, d: (lambda f: f.where("calcium is null").select("id", "name").join(f.where("calcium is not null").groupBy("name").agg(F.min_by("calcium", "id").alias("calcium")), "name").select("id", "calcium"))(view(s, d, "foods")),
    "SELECT a.id, b.calcium FROM foods a JOIN (SELECT name, arg_min(calcium, id) AS calcium FROM foods WHERE calcium IS NOT NULL GROUP BY name) b USING (name) WHERE a.calcium IS NULL")
add("JOI-24_alias_lookup", lambda s, d: view(s, d, "foods").select(F.explode(F.array("name", F.concat("name", F.lit("s")))).alias("alias"), "id").groupBy("alias").agg(F.min("id").alias("id")), "SELECT alias, min(id) AS id FROM (SELECT name AS alias, id FROM foods UNION ALL SELECT name || 's', id FROM foods) GROUP BY alias")

# --- comparisons and totals ---
add("AGG-19_old_new", lambda s, d: profiles_of(s, d).agg(F.count_if(F.col("kcal") > 700).alias("new"), F.count_if(F.col("kcal") * 1.1 > 700).alias("old")).select("old", "new", F.when(F.col("new") < F.col("old"), "better").when(F.col("new") > F.col("old"), "worse").otherwise("same").alias("mark")),
    f"{PROFILES_SQL} SELECT old, new, CASE WHEN new < old THEN 'better' WHEN new > old THEN 'worse' ELSE 'same' END AS mark FROM (SELECT count(*) FILTER (WHERE kcal * 1.1e0 > 700) AS old, count(*) FILTER (WHERE kcal > 700) AS new FROM profiles)")
add("AGG-25_import_quality", lambda s, d: profiles_of(s, d).join(view(s, d, "recipes").select("rid", "recipe_type"), "rid").agg(F.count_if(F.col("kcal") == 0).alias("zero"), F.count_if(F.col("kcal") > 1500).alias("high"), F.count_if((F.col("recipe_type") == "dessert") & (F.col("kcal") < 200)).alias("thin")),
    f"{PROFILES_SQL} SELECT count(*) FILTER (WHERE kcal = 0) AS zero, count(*) FILTER (WHERE kcal > 1500) AS high, count(*) FILTER (WHERE recipe_type = 'dessert' AND kcal < 200) AS thin FROM profiles JOIN recipes USING (rid)")
add("AGG-29_deviation", lambda s, d: view(s, d, "foods").select("id", F.when(F.col("fat") == 0, F.when(F.col("protein") == 0, None).otherwise(100.0)).otherwise(rounded(F.abs(F.col("protein") - F.col("fat")) / F.col("fat") * 100, 3)).alias("pct")),
    f"SELECT id, CASE WHEN fat = 0 THEN CASE WHEN protein = 0 THEN NULL ELSE 100e0 END ELSE {sql_rounded('abs(protein - fat) / fat * 100', 3)} END AS pct FROM foods")
add("AGG-44_pantry_count", lambda s, d: view(s, d, "ingredients").groupBy("rid").agg(F.count_if(F.col("name").isin("butter", "egg", "rice")).alias("n")), "SELECT rid, count(*) FILTER (WHERE name IN ('butter', 'egg', 'rice')) AS n FROM ingredients GROUP BY rid")
add("AGG-45_plan_coverage", lambda s, d: view(s, d, "planned").groupBy("author").agg(F.count_distinct("name").alias("names"), F.count_distinct(F.when(F.col("name").isin("butter", "egg", "rice"), F.col("name"))).alias("owned")),
    "SELECT author, count(DISTINCT name) AS names, count(DISTINCT name) FILTER (WHERE name IN ('butter', 'egg', 'rice')) AS owned FROM planned GROUP BY author")
add("AGG-49_breakdown", lambda s, d: details_of(s, d).where("status = 'resolved'").groupBy("rid").agg(F.max("c_kcal").alias("most"), F.sum("c_kcal").alias("total")), f"{DETAILS_SQL} SELECT rid, max(c_kcal) AS most, CAST(sum(c_kcal) AS BIGINT) AS total FROM details WHERE status = 'resolved' GROUP BY rid")
add("AGG-61_portion_merge", lambda s, d: (lambda f: f.where("source = 'base'").groupBy("name").agg(F.min("kcal").alias("a")).join(f.where("source = 'ciqual'").groupBy("name").agg(F.min("kcal").alias("b")), "name", "full").select("name", F.coalesce("a", "b").alias("kcal")))(view(s, d, "foods")),
    "SELECT name, coalesce(a, b) AS kcal FROM (SELECT name, min(kcal) FILTER (WHERE source = 'base') AS a, min(kcal) FILTER (WHERE source = 'ciqual') AS b FROM foods WHERE source IN ('base', 'ciqual') GROUP BY name)")
add("WIN-3_seasonal_first", lambda s, d: view(s, d, "recipes").withColumn("n", F.row_number().over(Window.partitionBy("recipe_type").orderBy(F.col("month").isin(6, 7, 8).desc(), F.pmod(F.col("rid") * 16807, F.lit(2147483647)), "rid"))).where("n <= 10").select("recipe_type", "n", "rid"),
    "SELECT recipe_type, CAST(n AS INTEGER) AS n, rid FROM (SELECT recipe_type, rid, row_number() OVER (PARTITION BY recipe_type ORDER BY month IN (6, 7, 8) DESC, rid * 16807 % 2147483647, rid) AS n FROM recipes) WHERE n <= 10")
add("WIN-11_detail_sort", lambda s, d: details_of(s, d).where("status = 'resolved'").withColumn("n", F.row_number().over(Window.partitionBy("rid").orderBy(F.col("c_kcal").desc(), "pos"))).select("rid", "pos", "n"), f"{DETAILS_SQL} SELECT rid, pos, CAST(row_number() OVER (PARTITION BY rid ORDER BY c_kcal DESC, pos) AS INTEGER) AS n FROM details WHERE status = 'resolved'")


def meal_plan(scores: DataFrame, recipes: DataFrame, meals: int = 5) -> DataFrame:
    """Greedy: each round takes the best score given what is chosen: a new type +2, an author again -1.

    A round for each meal, each a top-one over all candidates; only the chosen ones are in the driver.
    """
    spark = scores.sparkSession
    rows = scores.join(recipes.select("rid", "author"), "rid").cache()
    chosen: list = []
    for _ in range(meals):
        kinds, authors, ids = [c.recipe_type for c in chosen], [c.author for c in chosen], [c.rid for c in chosen]
        now = F.col("score") + F.when(~F.col("recipe_type").isin(kinds), 2.0).otherwise(0.0) - F.when(F.col("author").isin(authors), 1.0).otherwise(0.0)
        best = rows.where(~F.col("rid").isin(ids)).withColumn("now", now).orderBy(F.col("now").desc(), "rid").limit(1).collect()
        if not best:
            break
        chosen += best
    rows.unpersist()
    return spark.createDataFrame([(i + 1, c.rid, c.recipe_type, float(c.now)) for i, c in enumerate(chosen)], "meal int, rid long, recipe_type string, score double")


add("WIN-8_meal_plan", lambda s, d: meal_plan(first_score(profiles_of(s, d), view(s, d, "recipes")), view(s, d, "recipes")))
add("WIN-8_first_meal", lambda s, d: meal_plan(first_score(profiles_of(s, d), view(s, d, "recipes")), view(s, d, "recipes"), 1).select("rid"), f"{PROFILES_SQL}, {_SCORE} SELECT rid FROM scores ORDER BY score DESC, rid LIMIT 1")

QUERIES, SQL = catalog.queries, catalog.sql
