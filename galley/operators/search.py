"""Listing, filters, facets, joins to the food index, and set operations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley import dims
from galley.functions import text, time
from galley.functions.units import rounded, sql_rounded
from galley.operators.nutrition import PROFILES_SQL, first_foods, profiles_of
from galley.plans.adapters import view, with_views
from galley.plans.catalog import Catalog

catalog = Catalog()


def add(name: str, f, sql: str) -> None:
    catalog.add(name, f, with_views(sql))


SEASON = "CASE WHEN {0} IN (12, 1, 2) THEN 'winter' WHEN {0} IN (3, 4, 5) THEN 'spring' WHEN {0} IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"
ISO = "CASE WHEN total_minutes <= 0 THEN 'PT0M' WHEN total_minutes // 60 > 0 AND total_minutes % 60 > 0 THEN 'PT' || (total_minutes // 60) || 'H' || (total_minutes % 60) || 'M' WHEN total_minutes // 60 > 0 THEN 'PT' || (total_minutes // 60) || 'H' ELSE 'PT' || total_minutes || 'M' END"

# --- sources and listings ---
RECIPE_JSON = "struct<slug:string,title:string,servings:string,total_minutes:int,source_url:string>"


def recipe_documents(s: SparkSession, d: str) -> DataFrame:
    """Recipes as JSON documents, as they would stand in files; one in 50 is broken."""
    doc = F.to_json(F.struct("slug", "title", F.col("servings").cast("string").alias("servings"), "total_minutes", "source_url"))
    return view(s, d, "recipes").select("rid", F.when(F.col("rid") % 50 == 7, F.concat(F.lit("{"), doc)).otherwise(doc).alias("doc"))


def read_documents(docs: DataFrame) -> DataFrame:
    """Permissive: documents that are not JSON are left out, not an error."""
    parsed = F.from_json("doc", RECIPE_JSON, {"mode": "PERMISSIVE"})
    return docs.withColumn("r", parsed).where(F.col("r.slug").isNotNull()).select("rid", "r.*")


add("SRC-8_skip_bad_json", lambda s, d: recipe_documents(s, d).withColumn("r", F.from_json("doc", RECIPE_JSON)).agg(F.count_if(F.col("r.slug").isNull()).alias("bad"), F.count_if(F.col("r.slug").isNotNull()).alias("good")),
    "SELECT count(*) FILTER (WHERE rid % 50 = 7) AS bad, count(*) FILTER (WHERE rid % 50 <> 7) AS good FROM recipes")
add("SRC-4_point_lookup", lambda s, d: view(s, d, "recipes").where("slug = 'recipe-42'").select("rid", "title"), "SELECT rid, title FROM recipes WHERE slug = 'recipe-42'")
add("SRC-5_url_lookup", lambda s, d: view(s, d, "recipes").where("source_url like '%/r/9'").select("rid", "slug"), "SELECT rid, slug FROM recipes WHERE source_url LIKE '%/r/9'")
add("SRC-6_latest_recipe", lambda s, d: view(s, d, "recipes").agg(F.max_by("slug", F.struct("created", "rid")).alias("slug")), "SELECT slug FROM recipes ORDER BY created DESC, rid DESC LIMIT 1")
add("SRC-7_imported_urls", lambda s, d: view(s, d, "recipes").where("source_url is not null").select("source_url").distinct(), "SELECT DISTINCT source_url FROM recipes WHERE source_url IS NOT NULL")
add("SRC-21_authors", lambda s, d: view(s, d, "recipes").where("author is not null and not contains(lower(author), '7')").select("author").distinct(), "SELECT DISTINCT author FROM recipes WHERE author IS NOT NULL AND NOT contains(lower(author), '7')")
add("SRC-22_vocabulary", lambda s, d: view(s, d, "ingredients").select(F.trim("name").alias("name")).where("length(name) > 2").distinct(), "SELECT DISTINCT trim(name) AS name FROM ingredients WHERE length(trim(name)) > 2")
add("SRC-3_incremental_refresh",
    lambda s, d: view(s, d, "recipes").where("rid % 4 <> 1").select("slug", F.col("created").alias("now")).join(view(s, d, "recipes").where("rid % 3 <> 1").select("slug", F.when(F.col("rid") % 5 == 0, F.expr("created - interval 1 day")).otherwise(F.col("created")).alias("old")), "slug", "full")
    .select("slug", F.when(F.col("now").isNull(), "drop").when(F.col("old").isNull(), "new").when(F.col("now") > F.col("old"), "changed").otherwise("same").alias("action")).where("action <> 'same'"),
    """SELECT coalesce(a.slug, b.slug) AS slug, CASE WHEN a.slug IS NULL THEN 'drop' WHEN b.slug IS NULL THEN 'new' ELSE 'changed' END AS action
       FROM (SELECT slug, created FROM recipes WHERE rid % 4 <> 1) a FULL JOIN (SELECT slug, CASE WHEN rid % 5 = 0 THEN created - INTERVAL 1 DAY ELSE created END AS created FROM recipes WHERE rid % 3 <> 1) b ON a.slug = b.slug
       WHERE a.slug IS NULL OR b.slug IS NULL OR a.created > b.created""")  # fmt: skip


def food_index(foods: DataFrame) -> DataFrame:
    """Sources by priority: ciqual replaces base, mext only fills what neither has; the first of a source stands."""
    rank = F.when(F.col("source") == "ciqual", 0).when(F.col("source") == "base", 1).otherwise(2)
    w = Window.partitionBy("key").orderBy("rank", "id")
    return foods.withColumns({"key": F.lower("name"), "rank": rank}).withColumn("n", F.row_number().over(w)).where("n = 1").select("key", "id", "source", "kcal")


_INDEX = "idx AS (SELECT key, id, source, kcal FROM (SELECT *, lower(name) AS key, row_number() OVER (PARTITION BY lower(name) ORDER BY CASE source WHEN 'ciqual' THEN 0 WHEN 'base' THEN 1 ELSE 2 END, id) AS n FROM foods) WHERE n = 1)"
add("SRC-11_unified_food_index", lambda s, d: food_index(view(s, d, "foods")), f"WITH {_INDEX} SELECT * FROM idx")
add("SRC-12_resolved_overlay", lambda s, d: (lambda i: i.select("key", "id").unionByName(s.createDataFrame([("mystery powder", -1), ("salt", -2)], "key string, id long").join(i, "key", "left_anti")))(food_index(view(s, d, "foods"))),
    f"WITH {_INDEX} SELECT key, id FROM idx UNION ALL SELECT * FROM (VALUES ('mystery powder', -1), ('salt', -2)) v(key, id) WHERE key NOT IN (SELECT key FROM idx)")
add("SRC-26_cache_first", lambda s, d: view(s, d, "ingredients").select(F.lower("name").alias("key")).distinct().join(food_index(view(s, d, "foods")).select("key", "id"), "key", "left").select("key", F.col("id").isNull().alias("not_found")),
    f"WITH {_INDEX} SELECT k.key, id IS NULL AS not_found FROM (SELECT DISTINCT lower(name) AS key FROM ingredients) k LEFT JOIN idx USING (key)")
add("SRC-23_not_found", lambda s, d: view(s, d, "ingredients").select(F.lower("name").alias("key")).where("key <> ''").distinct().join(view(s, d, "foods").select(F.lower("name").alias("key")), "key", "left_anti"),
    "SELECT DISTINCT lower(name) AS key FROM ingredients WHERE name <> '' AND lower(name) NOT IN (SELECT lower(name) FROM foods)")

# --- sinks as table changes ---
add("SNK-9_versioning", lambda s, d: view(s, d, "recipes").select("rid", F.coalesce(F.when(F.col("rid") % 2 == 0, "2.0"), F.lit("1.0")).alias("version")), "SELECT rid, CASE WHEN rid % 2 = 0 THEN '2.0' ELSE '1.0' END AS version FROM recipes")
add("SNK-10_import_report", lambda s, d: view(s, d, "progress").groupBy("status").agg(F.count("*").alias("n")).withColumn("pct", rounded(F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(1))), 2)),
    f"SELECT status, n, {sql_rounded('n * 100 / sum(n) OVER ()', 2)} AS pct FROM (SELECT status, count(*) AS n FROM progress GROUP BY status)")
add("SNK-12_source_counts", lambda s, d: view(s, d, "foods").groupBy("source").agg(F.count("*").alias("n")), "SELECT source, count(*) AS n FROM foods GROUP BY source")

# --- projections ---
add("PRJ-1_summary", lambda s, d: view(s, d, "recipes").select("slug", "title", "author", "servings", "recipe_type", time.minutes_iso(F.col("total_minutes")).alias("total_time")),
    f"SELECT slug, title, author, servings, recipe_type, {ISO} AS total_time FROM recipes")
add("PRJ-4_quick", lambda s, d: view(s, d, "recipes").select("rid", F.expr("total_minutes > 0 and total_minutes <= 30").alias("quick")), "SELECT rid, total_minutes > 0 AND total_minutes <= 30 AS quick FROM recipes")
add("PRJ-6_sub_recipes", lambda s, d: view(s, d, "steps").groupBy("rid", "sub_recipe").agg(F.min("pos").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list("pos")), lambda x: x.cast("string")), ",").alias("steps")),
    "SELECT rid, sub_recipe, min(pos) AS first, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS steps FROM steps GROUP BY rid, sub_recipe")
add("PRJ-8_tools", lambda s, d: view(s, d, "steps").groupBy("rid").agg(F.array_join(F.array_sort(F.collect_set(F.replace("step_type", F.lit("co"), F.lit("-")))), ",").alias("tools")), "SELECT rid, string_agg(DISTINCT replace(step_type, 'co', '-'), ',' ORDER BY replace(step_type, 'co', '-')) AS tools FROM steps GROUP BY rid")
add("PRJ-9_flatten_steps", lambda s, d: view(s, d, "steps").join(view(s, d, "ingredients").select("rid", "pos", "name"), ["rid", "pos"], "left").select("rid", "pos", "produces", "name"), "SELECT rid, pos, produces, name FROM steps LEFT JOIN ingredients USING (rid, pos)")


def step_runs(steps: DataFrame) -> DataFrame:
    """Consecutive steps of one sub-recipe."""
    w = Window.partitionBy("rid").orderBy("pos")
    return steps.withColumn("new", (F.coalesce(F.lag("sub_recipe").over(w), F.lit("")) != F.col("sub_recipe")).cast("int")).withColumn("run", F.sum("new").over(w)).groupBy("rid", "run", "sub_recipe").agg(F.count("*").alias("n"))


add("PRJ-10_step_runs", lambda s, d: step_runs(view(s, d, "steps")),
    "SELECT rid, CAST(run AS BIGINT) AS run, sub_recipe, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY pos) AS run FROM (SELECT *, CASE WHEN lag(sub_recipe) OVER (PARTITION BY rid ORDER BY pos) IS NOT DISTINCT FROM sub_recipe THEN 0 ELSE 1 END AS new FROM steps)) GROUP BY ALL")
add("PRJ-16_recipe_type", lambda s, d: view(s, d, "recipes").groupBy(F.coalesce(F.lower("recipe_type"), F.lit("unknown")).alias("type")).agg(F.count("*").alias("n")), "SELECT coalesce(lower(recipe_type), 'unknown') AS type, count(*) AS n FROM recipes GROUP BY 1")
add("PRJ-24_ingredient_list", lambda s, d: view(s, d, "ingredients").groupBy("rid").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("pos", "name"))), 1, 3), lambda x: x["name"]), ", ").alias("names")),
    "SELECT rid, string_agg(name, ', ' ORDER BY pos) AS names FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY pos) AS n FROM ingredients) WHERE n <= 3 GROUP BY rid")

# --- filters, search and facets ---


def search(terms: str, *columns: str) -> Column:
    """Every term of three letters or more stands in one of the columns, accents aside; no such term: all."""
    wanted = [t for t in terms.lower().split(" ") if len(t) >= 3]
    folded = [text.fold(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    out = F.lit(True)
    for term in wanted:
        out = out & F.greatest(*[F.contains(c, F.lit(term)) for c in folded], F.lit(False))
    return out


add("FLT-2_keyword_search", lambda s, d: view(s, d, "recipes").where(search("ete 12 maison", "title", "author")).select("rid"), "SELECT rid FROM recipes WHERE (contains(strip_accents(lower(title)), 'ete') OR contains(strip_accents(lower(author)), 'ete')) AND (contains(strip_accents(lower(title)), 'maison') OR contains(strip_accents(lower(author)), 'maison'))")
add("FLT-3_visibility", lambda s, d: view(s, d, "recipes").where(~F.exists(F.array(F.lit("000000001"), F.lit("#00000000")), lambda k: F.contains(F.lower("author"), k))).select("rid"), "SELECT rid FROM recipes WHERE NOT (contains(lower(author), '000000001') OR contains(lower(author), '#00000000'))")
add("FLT-5_author_match", lambda s, d: view(s, d, "recipes").select("rid", F.exists(F.array(F.lit("13"), F.lit("77")), lambda k: F.contains(F.lower("author"), k)).alias("match")), "SELECT rid, contains(lower(author), '13') OR contains(lower(author), '77') AS match FROM recipes")


def facet_flags(s: SparkSession, d: str) -> DataFrame:
    """One row per recipe with its facets and whether it passes each filter (season summer, type main course, quick)."""
    n = view(s, d, "ingredients").groupBy("rid").agg(F.count("*").alias("n_ing"))
    r = view(s, d, "recipes").join(n, "rid", "left")
    return r.select("rid", time.season(F.col("month")).alias("season"), "recipe_type", "difficulty", F.expr("total_minutes > 0 and total_minutes <= 30").alias("quick"), (F.coalesce("n_ing", F.lit(0)) < 6).alias("few"))


_FLAGS = f"flags AS (SELECT rid, {SEASON.format('month')} AS season, recipe_type, difficulty, total_minutes > 0 AND total_minutes <= 30 AS quick, coalesce(n_ing, 0) < 6 AS few FROM recipes LEFT JOIN (SELECT rid, count(*) AS n_ing FROM ingredients GROUP BY rid) USING (rid))"
add("FLT-1_faceted_filter", lambda s, d: facet_flags(s, d).where("season = 'summer' and recipe_type = 'main_course' and few").select("rid"), f"WITH {_FLAGS} SELECT rid FROM flags WHERE season = 'summer' AND recipe_type = 'main_course' AND few")


def facets(flags: DataFrame) -> DataFrame:
    """Counts of each facet's values over the rows that pass all other filters, in one pass."""
    season, kind, few = F.col("season") == "summer", F.col("recipe_type") == "main_course", F.col("few")
    rows = F.array(
        F.when(kind & few, F.struct(F.lit("season").alias("facet"), F.col("season").alias("value"))),
        F.when(season & few, F.struct(F.lit("type").alias("facet"), F.col("recipe_type").alias("value"))),
        F.when(season & kind & few, F.struct(F.lit("difficulty").alias("facet"), F.col("difficulty").alias("value"))),
        F.when(season & kind & few & F.col("quick"), F.struct(F.lit("quick").alias("facet"), F.lit("true").alias("value"))),
    )
    return flags.select(F.explode(F.array_compact(rows)).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


add("AGG-3_facet_counts", lambda s, d: facets(facet_flags(s, d)), f"""WITH {_FLAGS} SELECT 'season' AS facet, season AS value, count(*) AS n FROM flags WHERE recipe_type = 'main_course' AND few GROUP BY season
  UNION ALL SELECT 'type', recipe_type, count(*) FROM flags WHERE season = 'summer' AND few GROUP BY recipe_type
  UNION ALL SELECT 'difficulty', difficulty, count(*) FROM flags WHERE season = 'summer' AND recipe_type = 'main_course' AND few GROUP BY difficulty
  UNION ALL SELECT 'quick', 'true', count(*) FROM flags WHERE season = 'summer' AND recipe_type = 'main_course' AND few AND quick HAVING count(*) > 0""")  # fmt: skip
add("FLT-28_available", lambda s, d: view(s, d, "recipes").agg(F.count_if(F.col("difficulty") == "easy").alias("easy"), F.count("*").alias("all")), "SELECT count(*) FILTER (WHERE difficulty = 'easy') AS easy, count(*) AS \"all\" FROM recipes")
add("FLT-15_needs_versioning", lambda s, d: view(s, d, "recipes").where("source_url is null or title is null").select("rid"), "SELECT rid FROM recipes WHERE source_url IS NULL OR title IS NULL")
add("FLT-25_multi_sub_recipe", lambda s, d: view(s, d, "steps").groupBy("rid").agg((F.count_distinct("sub_recipe") > 1).alias("multi")), "SELECT rid, count(DISTINCT sub_recipe) > 1 AS multi FROM steps GROUP BY rid")
add("FLT-6_candidates", lambda s, d: profiles_of(s, d).join(view(s, d, "recipes").select("rid", "recipe_type"), "rid").where("recipe_type = 'main_course' and confidence = 'high'").join(view(s, d, "ingredients").where("contains(lower(name), 'onion')").select("rid"), "rid", "left_anti").select("rid", "kcal"),
    f"{PROFILES_SQL} SELECT rid, kcal FROM profiles JOIN recipes USING (rid) WHERE recipe_type = 'main_course' AND confidence = 'high' AND rid NOT IN (SELECT rid FROM ingredients WHERE contains(lower(name), 'onion'))")

# --- joins ---


def best_phrase(names: DataFrame, keys: DataFrame, right_most: bool = True) -> DataFrame:
    """For each name the key that its longest phrase equals; of equally long ones the right-most (or left-most)."""
    at = F.col("p.start") if right_most else -F.col("p.start")
    found = names.select("name", F.explode(text.phrases(F.lower("name"))).alias("p")).join(keys, F.col("p.phrase") == F.col("key"))
    return found.groupBy("name").agg(F.max_by("key", F.struct("p.words", at.alias("at"))).alias("key"))


_PHRASES = "ph AS (SELECT DISTINCT name, array_to_string(list_slice(w, s, s + k - 1), ' ') AS phrase, k, s FROM (SELECT DISTINCT name, string_split(lower(name), ' ') AS w FROM {src}), unnest(range(1, len(w) + 1)) a(k), unnest(range(1, len(w) - k + 2)) b(s))"
_PREFIXED = "named AS (SELECT DISTINCT CASE WHEN pos % 2 = 0 THEN 'fresh ' || name ELSE name || ' or butter' END AS name FROM ingredients WHERE name <> '')"


def prefixed(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "ingredients").where("name <> ''").select(F.expr("case when pos % 2 = 0 then concat('fresh ', name) else concat(name, ' or butter') end").alias("name")).distinct()


for _id, _right in (("JOI-1_exact_match", True), ("JOI-8_reference_lookup", False)):
    add(_id, lambda s, d, r=_right: best_phrase(prefixed(s, d), first_foods(view(s, d, "foods")).select("key"), r),
        f"WITH {_PREFIXED}, {_PHRASES.format(src='named')}, keys AS (SELECT DISTINCT lower(trim(name)) AS key FROM foods) SELECT name, arg_max(key, k * 1000 {'+' if _right else '-'} s) AS key FROM ph JOIN keys ON phrase = key GROUP BY name")
add("JOI-2_key_index", lambda s, d: first_foods(view(s, d, "foods")).select("key", "id"), "SELECT lower(trim(name)) AS key, min(id) AS id FROM foods GROUP BY 1")


NEAREST_BLOCK = 2048


def _best_of(k: int, least: float):
    """The best k of a block of vectors for each query of a block, by cosine."""

    def run(q: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(f):
            return pd.DataFrame({"q": [], "f": [], "score": []}).astype({"q": "int64", "f": "int64", "score": "float64"})
        a, b = (np.stack([np.asarray(v, np.float64) for v in x["v"]]) for x in (q, f))
        norm = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.floor((a @ b.T) / norm * 1e6 + 0.5) / 1e6
        score[q["id"].to_numpy()[:, None] == f["id"].to_numpy()[None, :]] = -np.inf  # none is its own neighbour
        row, col = np.nonzero(score >= least)
        out = pd.DataFrame({"q": q["id"].to_numpy()[row], "f": f["id"].to_numpy()[col], "score": score[row, col]})
        return out.sort_values(["q", "score", "f"], ascending=[True, False, True]).groupby("q").head(k)

    return run


def nearest(queries: DataFrame, foods: DataFrame, k: int = 10, least: float = 0.75) -> DataFrame:
    """Cosine top k, by scoring every query against every food vector, a block of each in one task.

    A task sends on k rows a query at most. A row is no neighbour of its own id. Rows without a vector take no part; vectors of other lengths never meet.
    """
    shape = lambda df: df.where("embedding is not null and size(embedding) > 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.size("embedding").alias("dim"))
    q, f = shape(queries), shape(foods)
    n_q, n_f = (max(1, -(-df.count() // NEAREST_BLOCK)) for df in (q, f))
    q = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int")).withColumn("fb", F.explode(F.sequence(F.lit(0), F.lit(n_f - 1))))
    f = f.withColumn("fb", F.pmod(F.xxhash64("id"), F.lit(n_f)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    best = q.groupBy("qb", "fb", "dim").cogroup(f.groupBy("qb", "fb", "dim")).applyInPandas(_best_of(k, least), "q long, f long, score double")
    rank = Window.partitionBy("q").orderBy(F.col("score").desc(), "f")
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


add("JOI-3_semantic_nearest", lambda s, d: nearest(view(s, d, "embeddings").where("vec_id % 25 = 0"), view(s, d, "embeddings"), least=0.2),
    f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
      s AS (SELECT q.vec_id AS q, f.vec_id AS f, {sql_rounded("list_sum(list_transform(list_zip(q.v, f.v), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(q.v, lambda x: x * x))) * sqrt(list_sum(list_transform(f.v, lambda x: x * x))))", 6)} AS score
        FROM v q, v f WHERE q.vec_id % 25 = 0 AND q.vec_id <> f.vec_id AND len(q.v) = len(f.v))
      SELECT q, f, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, f) AS rank FROM s WHERE score >= 0.2) WHERE rank <= 10""")  # fmt: skip


def _season_rows() -> list[tuple[str, str, str]]:
    """(name or plural, name, month) of the season table."""
    out = []
    for kind in dims.PRODUCE.values():
        for name, months in kind.items():
            n = name.lower()
            forms = [n, n[:-1] + "ies"] if n.endswith("y") and n[-2:] not in ("ay", "ey", "oy", "uy") else [n, n + "es", n + "s"] if n.endswith("o") else [n, n + "es"] if n.endswith(("s", "sh", "ch", "x", "z")) else [n, n + "s"]
            out += [(f, n, m) for f in forms for m in months]
    return out


_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def season_table(s: SparkSession) -> DataFrame:
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.col("month")).cast("int")
    return s.createDataFrame(_season_rows(), "key string, item string, month string").select("key", "item", time.season(month).alias("season")).distinct()


def recipe_seasons(ingredients: DataFrame, seasons: DataFrame, recipes: DataFrame) -> DataFrame:
    """Seasons that all produce of a recipe shares, else those that half of it has; four seasons or none: all."""
    months = seasons.groupBy("item").agg(F.count_distinct("season").alias("k"))
    produce = ingredients.where("category = 'produce' and name <> ''").select("rid", "name").distinct()
    named = best_phrase(produce.select("name").distinct(), seasons.select("key").distinct())
    year = F.array(*[F.lit(x) for x in dims.STAPLES])
    kept = produce.join(named, "name").join(seasons, "key").where(~F.array_contains(year, F.col("item"))).select("rid", "name", "season").distinct()
    n = kept.groupBy("rid").agg(F.count_distinct("name").alias("n"))
    votes = kept.groupBy("rid", "season").agg(F.count("*").alias("votes")).join(n, "rid")
    w = Window.partitionBy("rid")
    votes = votes.withColumn("common", F.max((F.col("votes") == F.col("n")).cast("int")).over(w)).withColumn("half", F.max((F.col("votes") * 2 >= F.col("n")).cast("int")).over(w))
    kept = votes.where(((F.col("common") == 1) & (F.col("votes") == F.col("n"))) | ((F.col("common") == 0) & ((F.col("votes") * 2 >= F.col("n")) | (F.col("half") == 0))))
    listed = kept.groupBy("rid").agg(F.array_sort(F.collect_set("season")).alias("s"))
    return recipes.select("rid").join(listed, "rid", "left").select("rid", F.when(F.col("s").isNull() | (F.size("s") >= 4), "all").otherwise(F.array_join("s", ",")).alias("seasons"))


_q = lambda x: x.replace("'", "''")
_SEASONS = "st(key, item, season) AS (SELECT DISTINCT * FROM (VALUES " + ", ".join(f"('{_q(k)}', '{_q(i)}', '{['winter', 'winter', 'spring', 'spring', 'spring', 'summer', 'summer', 'summer', 'autumn', 'autumn', 'autumn', 'winter'][_MONTHS.index(m)]}')" for k, i, m in sorted(set(_season_rows()))) + ") v(a, b, c))"
add("JOI-9_season_lookup", lambda s, d: best_phrase(prefixed(s, d), season_table(s).select("key").distinct()),
    f"WITH {_PREFIXED}, {_PHRASES.format(src='named')}, {_SEASONS} SELECT name, arg_max(key, k * 1000 + s) AS key FROM ph JOIN (SELECT DISTINCT key FROM st) ON phrase = key GROUP BY name")
add("AGG-35_seasons", lambda s, d: recipe_seasons(view(s, d, "ingredients"), season_table(s), view(s, d, "recipes")),
    f"""WITH prod AS (SELECT DISTINCT rid, name FROM ingredients WHERE category = 'produce' AND name <> ''), {_PHRASES.format(src='prod')}, {_SEASONS},
      named AS (SELECT name, arg_max(key, k * 1000 + s) AS key FROM ph JOIN (SELECT DISTINCT key FROM st) ON phrase = key GROUP BY name),
      kept AS (SELECT DISTINCT rid, name, season FROM prod JOIN named USING (name) JOIN st USING (key) WHERE item NOT IN ({", ".join(f"'{_q(x)}'" for x in dims.STAPLES)})),
      v AS (SELECT rid, season, count(*) AS votes, any_value(n) AS n FROM kept JOIN (SELECT rid, count(DISTINCT name) AS n FROM kept GROUP BY rid) USING (rid) GROUP BY rid, season),
      w AS (SELECT *, max(CASE WHEN votes = n THEN 1 ELSE 0 END) OVER (PARTITION BY rid) AS common, max(CASE WHEN votes * 2 >= n THEN 1 ELSE 0 END) OVER (PARTITION BY rid) AS half FROM v),
      l AS (SELECT rid, string_agg(season, ',' ORDER BY season) AS s, count(*) AS c FROM w WHERE (common = 1 AND votes = n) OR (common = 0 AND (votes * 2 >= n OR half = 0)) GROUP BY rid)
      SELECT rid, CASE WHEN c IS NULL OR c >= 4 THEN 'all' ELSE s END AS seasons FROM recipes LEFT JOIN l USING (rid)""")  # fmt: skip


def diet_kind(name: Column, category: Column) -> Column:
    """The first list that holds a term of the name, else what the category says."""
    out = None
    for kind, terms in dims.DIET_TERMS.items():
        hit = F.lower(name).rlike(r"\b(" + "|".join(terms) + r")\b")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(F.when(category.isin("meat", "poultry"), "meat").when(category.isin("seafood", "dairy", "egg"), category))


def recipe_diets(ingredients: DataFrame) -> DataFrame:
    """Names are classified once each; optional ingredients set no flag."""
    kinds = ingredients.select("name", "category").distinct().withColumn("kind", F.when(F.col("name") != "", diet_kind(F.col("name"), F.col("category"))))
    flag = lambda *k: F.bool_or(F.coalesce(F.col("kind").isin(*k) & ~F.col("optional"), F.lit(False)))
    flags = ingredients.join(kinds, ["name", "category"]).groupBy("rid").agg(flag("meat").alias("meat"), flag("seafood").alias("fish"), flag("dairy", "egg", "non_vegan_other").alias("animal"))
    base = F.when(F.col("meat") | F.col("fish"), "omnivorous").when(F.col("animal"), "vegetarian,omnivorous").otherwise("vegan,vegetarian,omnivorous")
    return flags.select("rid", F.concat(base, F.when(~F.col("meat") & F.col("fish"), ",pescatarian").otherwise("")).alias("diets"))


_KIND = "CASE WHEN name = '' THEN NULL " + " ".join(f"WHEN regexp_matches(lower(name), '\\b({'|'.join(t)})\\b') THEN '{k}'" for k, t in dims.DIET_TERMS.items()) + " WHEN category IN ('meat', 'poultry') THEN 'meat' WHEN category IN ('seafood', 'dairy', 'egg') THEN category END"
add("AGG-36_diets", lambda s, d: recipe_diets(view(s, d, "ingredients")), f"""WITH k AS (SELECT rid, optional, {_KIND} AS kind FROM ingredients),
  f AS (SELECT rid, bool_or(coalesce(kind = 'meat' AND NOT optional, false)) AS meat, bool_or(coalesce(kind = 'seafood' AND NOT optional, false)) AS fish, bool_or(coalesce(kind IN ('dairy', 'egg', 'non_vegan_other') AND NOT optional, false)) AS animal FROM k GROUP BY rid)
  SELECT rid, CASE WHEN meat OR fish THEN 'omnivorous' WHEN animal THEN 'vegetarian,omnivorous' ELSE 'vegan,vegetarian,omnivorous' END || CASE WHEN NOT meat AND fish THEN ',pescatarian' ELSE '' END AS diets FROM f""")  # fmt: skip
add("JOI-16_curated_list", lambda s, d: view(s, d, "ingredients").select("name", "category").distinct().select("name", "category", F.when(F.col("name") != "", diet_kind(F.col("name"), F.col("category"))).alias("kind")), f"SELECT DISTINCT name, category, {_KIND} AS kind FROM ingredients")
add("JOI-25_first_by_id", lambda s, d: view(s, d, "foods").groupBy("kcal").agg(F.min("id").alias("id")), "SELECT kcal, min(id) AS id FROM foods GROUP BY kcal")
add("JOI-26_url_prefilter", lambda s, d: view(s, d, "recipes").where("rid % 2 = 0 and source_url is not null").select("rid", "source_url").join(view(s, d, "recipes").where("rid % 6 = 0").select("source_url"), "source_url", "left_anti")
    .withColumn("host", F.regexp_extract("source_url", "^https?://([^/]+)", 1)).withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("rid"))).where("n <= 8").select("rid", "host"),
    "SELECT rid, host FROM (SELECT rid, host, row_number() OVER (PARTITION BY host ORDER BY rid) AS n FROM (SELECT rid, regexp_extract(source_url, '^https?://([^/]+)', 1) AS host FROM recipes a WHERE rid % 2 = 0 AND source_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM recipes b WHERE b.rid % 6 = 0 AND b.source_url = a.source_url))) WHERE n <= 8")
add("JOI-28_duplicate_title", lambda s, d: view(s, d, "recipes").groupBy(F.lower(F.trim("title")).alias("title")).agg(F.min("rid").alias("first"), F.count("*").alias("n")).where("n > 1"), "SELECT lower(trim(title)) AS title, min(rid) AS first, count(*) AS n FROM recipes GROUP BY 1 HAVING count(*) > 1")
_PANTRY = ["oil", "butter", "egg", "rice", "tomato"]
_word = lambda a, b: F.concat(F.lit(" "), a, F.lit(" ")).contains(F.concat(F.lit(" "), b, F.lit(" ")))
add("JOI-29_pantry", lambda s, d: view(s, d, "ingredients").where("name <> ''").select("name").distinct().select("name", F.exists(F.array(*[F.lit(p) for p in _PANTRY]), lambda p: _word(F.col("name"), p) | _word(p, F.col("name"))).alias("owned")),
    f"SELECT DISTINCT name, {' OR '.join(f'''contains(' ' || name || ' ', ' {p} ') OR contains(' {p} ', ' ' || name || ' ')''' for p in _PANTRY)} AS owned FROM ingredients WHERE name <> ''")
_owned = lambda: F.exists(F.array(*[F.lit(p) for p in _PANTRY]), lambda p: F.contains(F.col("name"), p) | F.contains(p, F.col("name")))
_OWNED = " OR ".join(f"contains(name, '{p}') OR contains('{p}', name)" for p in _PANTRY)
add("JOI-30_plan_pantry", lambda s, d: view(s, d, "ingredients").where("name <> ''").groupBy("rid").agg(F.count_if(_owned()).alias("owned")), f"SELECT rid, count(*) FILTER (WHERE {_OWNED}) AS owned FROM ingredients WHERE name <> '' GROUP BY rid")
add("AGG-43_pantry_stats", lambda s, d: view(s, d, "ingredients").where("name <> ''").groupBy("rid").agg(F.count_if(_owned()).alias("matched"), F.count("*").alias("total")).withColumn("ratio", rounded(F.col("matched") / F.col("total"), 4)),
    f"SELECT rid, matched, total, {sql_rounded('matched / total', 4)} AS ratio FROM (SELECT rid, count(*) FILTER (WHERE {_OWNED}) AS matched, count(*) AS total FROM ingredients WHERE name <> '' GROUP BY rid)")
add("WIN-2_pantry_sort", lambda s, d: view(s, d, "ingredients").where("name <> ''").groupBy("rid").agg(F.count_if(_owned()).alias("matched"), F.count("*").alias("total")).select("rid", "matched").orderBy(F.col("matched").desc(), (F.col("matched") / F.col("total")).desc(), "rid").limit(20),
    f"SELECT rid, matched FROM (SELECT rid, count(*) FILTER (WHERE {_OWNED}) AS matched, count(*) AS total FROM ingredients WHERE name <> '' GROUP BY rid) ORDER BY matched DESC, matched / total DESC, rid LIMIT 20")
add("WIN-1_low_calorie_sort", lambda s, d: profiles_of(s, d).select("rid", "kcal").orderBy(F.col("kcal").asc_nulls_last(), "rid").limit(50), f"{PROFILES_SQL} SELECT rid, kcal FROM profiles ORDER BY kcal NULLS LAST, rid LIMIT 50")

# --- sets ---
add("SET-1_months_to_seasons", lambda s, d: season_table(s).groupBy("item").agg(F.array_join(F.array_sort(F.collect_set("season")), ",").alias("seasons")), f"WITH {_SEASONS} SELECT item, string_agg(DISTINCT season, ',' ORDER BY season) AS seasons FROM st GROUP BY item")
add("SET-2_season_plurals", lambda s, d: season_table(s).select("key", "item").distinct(), f"WITH {_SEASONS} SELECT DISTINCT key, item FROM st")
add("SET-3_url_union", lambda s, d: view(s, d, "recipes").where("rid % 2 = 0").select("source_url").union(view(s, d, "recipes").where("rid % 3 = 0").select("source_url")).where("source_url is not null").distinct(), "SELECT source_url FROM recipes WHERE rid % 2 = 0 AND source_url IS NOT NULL UNION SELECT source_url FROM recipes WHERE rid % 3 = 0 AND source_url IS NOT NULL")
add("SET-4_links", lambda s, d: view(s, d, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"#]+)'), F.lit(1)))), " ").alias("links")), "SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"#]+)', 1))), ' ') AS links FROM pages")
add("SET-9_custom_items", lambda s, d: view(s, d, "ingredients").select(F.lower("name").alias("name")).distinct().where(~F.col("name").isin(_PANTRY)), f"SELECT DISTINCT lower(name) AS name FROM ingredients WHERE lower(name) NOT IN {tuple(_PANTRY)}")
add("SET-10_name_set", lambda s, d: view(s, d, "ingredients").groupBy("rid").agg(F.array_join(F.array_sort(F.collect_set(text.fold_name(F.col("name")))), "|").alias("names")), "SELECT rid, string_agg(DISTINCT strip_accents(lower(trim(name))), '|' ORDER BY strip_accents(lower(trim(name)))) AS names FROM ingredients GROUP BY rid")
add("NST-2_images", lambda s, d: view(s, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('<img[^>]+src="([^"]+)"'), F.lit(1))).cast("long").alias("n")), "SELECT page_id, CAST(len(regexp_extract_all(html, '<img[^>]+src=\"([^\"]+)\"', 1)) AS BIGINT) AS n FROM pages")
add("NST-4_nutrition_parse", lambda s, d: view(s, d, "foods").select("id", F.concat_ws(", ", F.concat(F.lit("kcal="), F.col("kcal").cast("int").cast("string")), F.concat(F.lit("fat="), F.col("fat").cast("int").cast("string"))).alias("t")).select("id", F.regexp_extract("t", r"kcal=(\d+)", 1).cast("double").alias("kcal"), F.regexp_extract("t", r"fat=(\d+)", 1).cast("double").alias("fat")), "SELECT id, kcal, fat FROM foods")
add("NST-5_fence_strip", lambda s, d: view(s, d, "foods").select("id", F.regexp_replace(F.concat(F.lit("```json\n"), "name", F.lit("\n```")), r"^```(?:json)?\s*|\s*```$", "").alias("value")), "SELECT id, name AS value FROM foods")

QUERIES, SQL = catalog.queries, catalog.sql
