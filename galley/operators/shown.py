"""What lists, plans and shopping lists show, and the jobs that rewrite a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions import text, time
from galley.functions.units import rounded, sql_rounded
from galley.operators.nutrition import PROFILES_SQL, profiles_of
from galley.operators.scalars import SHORT, texts
from galley.plans.adapters import view, with_views
from galley.plans.catalog import Catalog

catalog = Catalog()
_PANTRY = ("butter", "egg", "rice")
_OWNED = "name IN ('butter', 'egg', 'rice')"
_FOLDED = "trim(regexp_replace(strip_accents(lower(name)), '\\s+', ' ', 'g'))"


def add(name: str, f, sql: str | None = None) -> None:
    catalog.add(name, f, sql and with_views(sql))


# --- times ---
_number = lambda p: f"coalesce(TRY_CAST(nullif(regexp_extract(x, '{p}', 1), '') AS DOUBLE), 0)"
add("DAT-5_legacy_minutes", lambda s, d: texts(s, d).where(SHORT).select("src", "i", rounded(time.legacy_minutes(F.col("t")), 6).alias("value")),
    f"""SELECT src, i, {sql_rounded(f'''CASE WHEN {time.sql_is_iso("upper(x)")} THEN {time.sql_marked_minutes("upper(x)")}
      WHEN regexp_matches(x, '^\\d+(\\.\\d+)?$') THEN CAST(x AS DOUBLE)
      ELSE {_number("(\\d+(?:\\.\\d+)?)\\s*(?:h|hours?|heures?)(?:[^a-z]|$)")} * 60 + {_number("(\\d+(?:\\.\\d+)?)\\s*(?:m|min|mins|minutes?)(?:[^a-z]|$)")} + {_number("(?:h|heures?)(\\d+)$")} + {_number("(\\d+(?:\\.\\d+)?)\\s*(?:s|sec|secs|seconds?|secondes?)(?:[^a-z]|$)")} * (1 / 60e0) END''', 6)} AS value
      FROM (SELECT src, i, lower(trim(t)) AS x FROM texts WHERE {SHORT})""")  # fmt: skip
_SHORT = "CASE WHEN {m} // 60 <= 0 THEN ({m} % 60) || ' min' WHEN {m} % 60 = 0 THEN ({m} // 60) || 'h' ELSE ({m} // 60) || 'h' || lpad(CAST({m} % 60 AS VARCHAR), 2, '0') END"
add("DAT-18_gantt_format", lambda s, d: view(s, d, "steps").where("minutes is not null").select("rid", "pos", time.short(F.floor(F.col("minutes") * 2.5 + 0.5)).alias("value")),
    f"SELECT rid, pos, {_SHORT.format(m='m')} AS value FROM (SELECT rid, pos, CAST(floor(minutes * 2.5e0 + 0.5) AS BIGINT) AS m FROM steps WHERE minutes IS NOT NULL)")
add("DAT-19_node_format", lambda s, d: view(s, d, "recipes").select("rid", F.concat_ws(" ", F.when(F.col("total_minutes") >= 60, F.concat(F.floor(F.col("total_minutes") / 60).cast("string"), F.lit("h"))), F.when((F.col("total_minutes") % 60 > 0) | (F.col("total_minutes") < 60), F.concat((F.col("total_minutes") % 60).cast("string"), F.lit("min")))).alias("value")),
    "SELECT rid, concat_ws(' ', CASE WHEN total_minutes >= 60 THEN (total_minutes // 60) || 'h' END, CASE WHEN total_minutes % 60 > 0 OR total_minutes < 60 THEN (total_minutes % 60) || 'min' END) AS value FROM recipes")

# --- shares and totals ---
add("AGG-20_percent", lambda s, d: view(s, d, "ingredients").groupBy("rid").agg(F.count("*").alias("n"), F.count("unit").alias("k")).select("rid", F.concat(rounded(F.col("k") * 100 / F.col("n"), 1).cast("decimal(5,1)").cast("string"), F.lit("%")).alias("value")),
    f"SELECT rid, CAST(CAST({sql_rounded('count(unit) * 100 / count(*)', 1)} AS DECIMAL(5, 1)) AS VARCHAR) || '%' AS value FROM ingredients GROUP BY rid")
add("AGG-34_scorecard", lambda s, d: view(s, d, "foods").groupBy("name").agg((F.sum("protein") / F.sum(F.lit(40.0)) * 10).alias("x")).select("name", rounded(F.col("x"), 2).alias("score")), f"SELECT name, {sql_rounded('sum(protein) / sum(40e0) * 10', 2)} AS score FROM foods GROUP BY name")
add("AGG-63_axis_total", lambda s, d: view(s, d, "foods").select("id", (F.col("protein") + F.col("fat") + F.col("carbs") + F.col("fiber") + F.col("sugar")).alias("total")), "SELECT id, protein + fat + carbs + fiber + sugar AS total FROM foods")
add("AGG-64_assertion_counts", lambda s, d: view(s, d, "ingredients").groupBy("rid").agg(F.count_if(F.col("name") == "").alias("errors"), F.count_if(F.col("quantity").isNull()).alias("warnings")), "SELECT rid, count(*) FILTER (WHERE name = '') AS errors, count(*) FILTER (WHERE quantity IS NULL) AS warnings FROM ingredients GROUP BY rid")
_plan_names = lambda s, d: view(s, d, "planned").select("author", "name", "category").distinct()
_PLAN_NAMES = "(SELECT DISTINCT author, name, category FROM planned)"
_author = lambda: F.coalesce("author", F.lit("")).alias("author")
add("AGG-38_plan_nutrition", lambda s, d: profiles_of(s, d).where("kcal is not null").join(view(s, d, "recipes").select("rid", _author()), "rid").groupBy("author").agg(F.count("*").alias("n"), rounded(F.sum(F.col("kcal").cast("decimal(20,1)")).cast("double") / F.count("*"), 0).alias("kcal")),
    f"{PROFILES_SQL} SELECT coalesce(author, '') AS author, count(*) AS n, {sql_rounded('CAST(sum(CAST(p.kcal AS DECIMAL(20, 1))) AS DOUBLE) / count(*)', 0)} AS kcal FROM profiles p JOIN recipes USING (rid) WHERE p.kcal IS NOT NULL GROUP BY 1")
add("AGG-42_shared_with_selected", lambda s, d: view(s, d, "ingredients").where("name <> ''").select("rid", "name").distinct().join(view(s, d, "planned").where("rid = 1").select("name").distinct(), "name", "left_semi").groupBy("rid").agg(F.count("*").alias("shared")),
    "SELECT rid, count(DISTINCT name) AS shared FROM ingredients WHERE name <> '' AND name IN (SELECT name FROM planned WHERE rid = 1) GROUP BY rid")
add("AGG-47_shopping_pantry_count", lambda s, d: _plan_names(s, d).groupBy("author").agg(F.count_if(F.col("name").isin(*_PANTRY)).alias("owned")), f"SELECT author, count(*) FILTER (WHERE {_OWNED}) AS owned FROM {_PLAN_NAMES} GROUP BY author")
add("AGG-65_shopping_total", lambda s, d: _plan_names(s, d).groupBy("author").agg(F.count("*").alias("total")), f"SELECT author, count(*) AS total FROM {_PLAN_NAMES} GROUP BY author")
add("AGG-66_pantry_ratio", lambda s, d: view(s, d, "ingredients").where("name <> ''").groupBy("rid").agg(rounded(F.count_if(F.col("name").isin(*_PANTRY)) / F.count("*"), 4).alias("ratio")), f"SELECT rid, {sql_rounded(f'count(*) FILTER (WHERE {_OWNED}) / count(*)', 4)} AS ratio FROM ingredients WHERE name <> '' GROUP BY rid")

# --- lists ---
add("WIN-4_random_recipe", lambda s, d: view(s, d, "recipes").agg(F.min_by("slug", F.struct(F.pmod(F.col("rid") * 16807, F.lit(2147483647)), "rid")).alias("slug")), "SELECT slug FROM recipes ORDER BY rid * 16807 % 2147483647, rid LIMIT 1")
add("WIN-10_display_reasons", lambda s, d: view(s, d, "ingredients").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "category"))).alias("x")).select("rid", F.array_join(F.slice(F.filter(F.transform("x", lambda x: x.category), lambda c: c != "oil"), 1, 2), ", ").alias("reasons")),
    "SELECT rid, coalesce(string_agg(category, ', ' ORDER BY pos) FILTER (WHERE n <= 2 AND category <> 'oil'), '') AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY rid, category <> 'oil' ORDER BY pos) AS n FROM ingredients) GROUP BY rid")
add("SET-11_english_names", lambda s, d: view(s, d, "ingredients").where("name <> ''").select("rid", "pos", text.fold_name(F.col("name")).alias("name_en")), f"SELECT rid, pos, {_FOLDED} AS name_en FROM ingredients WHERE name <> ''")
add("SET-13_suggested_pantry", lambda s, d: view(s, d, "ingredients").where("category in ('spice', 'oil', 'condiment') and name <> ''").select(F.lower("name").alias("name")).distinct(), "SELECT DISTINCT lower(name) AS name FROM ingredients WHERE category IN ('spice', 'oil', 'condiment') AND name <> ''")
add("FLT-24_english_source", lambda s, d: view(s, d, "documents").select("doc_id", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("english")), "SELECT doc_id, coalesce(lang = 'en', false) AS english FROM documents")
add("FLT-27_pantry_exact", lambda s, d: view(s, d, "ingredients").select("rid", "pos", text.fold_name(F.col("name")).isin(*_PANTRY).alias("owned")), f"SELECT rid, pos, {_FOLDED} IN ('butter', 'egg', 'rice') AS owned FROM ingredients")
add("NUM-19_macro_format", lambda s, d: profiles_of(s, d).where("protein is not null").select("rid", F.concat(F.when(F.col("confidence") == "high", "").otherwise("~"), F.floor(F.col("protein") + 0.5).cast("string")).alias("value")), f"{PROFILES_SQL} SELECT rid, CASE WHEN confidence = 'high' THEN '' ELSE '~' END || CAST(floor(protein + 0.5) AS BIGINT) AS value FROM profiles WHERE protein IS NOT NULL")
add("NUM-35_adjusted_amount", lambda s, d: view(s, d, "ingredients").join(view(s, d, "recipes").select("rid", "servings"), "rid").select("rid", "pos", rounded(F.col("quantity") * 6 / F.col("servings"), 4).alias("amount")), f"SELECT rid, pos, {sql_rounded('quantity * 6 / servings', 4)} AS amount FROM ingredients JOIN recipes USING (rid)")
add("NUM-33_shopping_text", lambda s, d: _plan_names(s, d).groupBy("author", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_set("name")), lambda n: F.concat(F.lit("- "), n)), "\n").alias("lines")),
    f"SELECT author, category, string_agg(DISTINCT '- ' || name, chr(10) ORDER BY '- ' || name) AS lines FROM {_PLAN_NAMES} GROUP BY author, category")
_sub = lambda s, d: view(s, d, "steps").select("rid", "pos", "sub_recipe")
add("PRJ-20_sub_recipe_ingredients", lambda s, d: view(s, d, "ingredients").where("name <> ''").join(_sub(s, d), ["rid", "pos"]).select("rid", "sub_recipe", "pos", "name", "quantity"), "SELECT rid, sub_recipe, pos, name, quantity FROM ingredients JOIN steps USING (rid, pos) WHERE name <> ''")
add("GRF-5_sub_recipe_toggle", lambda s, d: view(s, d, "steps").select("rid", "pos", (F.col("sub_recipe") == "sauce").alias("done")), "SELECT rid, pos, sub_recipe = 'sauce' AS done FROM steps")


# --- rewriting a corpus ---
def upserted(index: DataFrame, changed: DataFrame, key: str = "slug") -> DataFrame:
    """``index`` with the rows of ``changed`` in place of those of the same key, and new ones added."""
    return index.join(changed.select(key), key, "left_anti").unionByName(changed)


_index = lambda s, d: view(s, d, "recipes").where("rid % 2 = 0").select("slug", "title")
add("SNK-4_index_upsert", lambda s, d: upserted(_index(s, d), view(s, d, "recipes").where("rid % 3 = 0").select("slug", F.upper("title").alias("title"))), "SELECT slug, CASE WHEN rid % 3 = 0 THEN upper(title) ELSE title END AS title FROM recipes WHERE rid % 2 = 0 OR rid % 3 = 0")
add("SNK-11_index_delete", lambda s, d: _index(s, d).join(view(s, d, "recipes").where("rid % 3 = 0").select("slug"), "slug", "left_anti"), "SELECT slug, title FROM recipes WHERE rid % 2 = 0 AND rid % 3 <> 0")
add("SNK-17_title_job", lambda s, d: view(s, d, "recipes").agg(F.count("*").alias("read"), F.count_if(text.clean_title(F.col("title")) != F.col("title")).alias("changed")), "SELECT count(*) AS read, count(*) FILTER (WHERE trim(regexp_replace(title, '\\s*\\([^()]*\\)\\s*$', '')) <> title) AS changed FROM recipes")
add("SNK-19_author_patch", lambda s, d: view(s, d, "recipes").select("slug", F.when(F.col("slug") == "recipe-7", "Someone Else").otherwise(F.col("author")).alias("author")), "SELECT slug, CASE WHEN slug = 'recipe-7' THEN 'Someone Else' ELSE author END AS author FROM recipes")
add("SRC-2_url_index", lambda s, d: view(s, d, "recipes").where("source_url is not null").groupBy(F.col("source_url").alias("url")).agg(F.min("slug").alias("slug")), "SELECT source_url AS url, min(slug) AS slug FROM recipes WHERE source_url IS NOT NULL GROUP BY source_url")
add("SRC-35_imported_urls", lambda s, d: view(s, d, "recipes").where("source_url is not null").select(F.col("source_url").alias("url")).distinct(), "SELECT DISTINCT source_url AS url FROM recipes WHERE source_url IS NOT NULL")
add("SRC-27_cache_first", lambda s, d: view(s, d, "ingredients").where("name <> ''").select("name").distinct().join(view(s, d, "foods").where("source = 'base'").groupBy("name").agg(F.min("id").alias("id")), "name", "left"),
    "SELECT name, id FROM (SELECT DISTINCT name FROM ingredients WHERE name <> '') LEFT JOIN (SELECT name, min(id) AS id FROM foods WHERE source = 'base' GROUP BY name) USING (name)")

QUERIES, SQL = catalog.queries, catalog.sql
