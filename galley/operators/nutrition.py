"""Weights, food lookups and nutrition profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley import dims
from galley.functions import units
from galley.plans.adapters import view, with_views
from galley.plans.catalog import Catalog

catalog = Catalog()
NUTRIENTS = ("kcal", "protein", "fat", "carbs", "fiber", "sugar", "sat_fat", "calcium", "iron")


def first_foods(foods: DataFrame) -> DataFrame:
    """One food for each key: the first writer, by id."""
    rest = [c for c in foods.columns if c not in ("id", "key")]
    return foods.withColumn("key", F.lower(F.trim("name"))).groupBy("key").agg(F.min("id").alias("id"), *[F.min_by(c, "id").alias(c) for c in rest])


def per_name(ingredients: DataFrame) -> DataFrame:
    """(name, unit, unit_g, default_g, piece_g): lookups once for each distinct name and unit, not for each row."""
    name = F.col("name")
    wanted = F.lower(F.trim(name))
    quantity, unit = ({k: v[i] for k, v in dims.DEFAULT_QUANTITIES.items()} for i in (0, 1))
    q = F.coalesce(units.lookup({k: float(v) for k, v in quantity.items()}, wanted), units.longest_part({k: float(v) for k, v in quantity.items()}, wanted))
    u = F.coalesce(units.lookup(unit, wanted), units.longest_part(unit, wanted))
    divisor, cut = units.broken_fraction(F.coalesce("unit", F.lit("")))
    pairs = ingredients.select("name", "unit").distinct()
    pairs = pairs.withColumns({"divisor": divisor, "fixed_unit": F.coalesce(cut, F.col("unit")), "default_q": q, "default_unit": u, "negligible": units.negligible(wanted, F.col("unit"))})
    pairs = units.with_unit_grams(units.with_unit_grams(pairs, "name", "fixed_unit", "unit_g"), "name", "default_unit", "by_default")
    # a name without a default keeps none, though its missing unit alone would mean a piece
    default = F.when(F.col("default_q").isNotNull(), F.col("default_q") * F.col("by_default"))
    pairs = pairs.withColumns({"default_g": default, "piece_g": units.piece_grams(name)}).drop("default_q", "default_unit", "by_default")
    pairs = pairs.withColumn("nu", units.normal_unit(F.coalesce("fixed_unit", F.lit(""))))
    ml = F.when(F.col("nu").isin(*units.VOLUME_UNITS), units.lookup(dims.UNIT_GRAMS, F.col("nu")))
    kinds = {"plain_kind": units.liquid(wanted, F.lit(False)), "soup_kind": units.liquid(wanted, F.lit(True))}
    return pairs.withColumns({"unit_ml": ml} | kinds).drop("nu")


def ingredient_details(ingredients: DataFrame, foods: DataFrame, recipes: DataFrame) -> DataFrame:
    """Each ingredient's status, grams, retention and rounded contributions."""
    key = F.lower(F.trim("name"))
    # names and foods are dimensions: Spark broadcasts them while their size allows, and joins by key beyond it
    rows = ingredients.join(recipes.select("rid", units.soup(F.col("title")).alias("soup")), "rid")
    pair = per_name(ingredients).withColumn("unit_key", F.coalesce("unit", F.lit("\0"))).drop("unit")
    rows = rows.withColumn("unit_key", F.coalesce("unit", F.lit("\0"))).join(pair, ["name", "unit_key"])
    rows = rows.withColumn("key", key).join(first_foods(foods).select("key", "id", *NUTRIENTS), "key", "left")
    fixed_q = F.when(F.col("divisor").isNotNull(), F.greatest(F.coalesce("quantity", F.lit(1.0)), F.lit(1.0)) / F.col("divisor")).otherwise(F.col("quantity"))
    rows = rows.withColumn("fixed_q", fixed_q)
    grams = F.coalesce(F.col("fixed_q") * F.col("unit_g"), F.when(F.col("fixed_q").isNull(), F.coalesce("default_g", "piece_g")))
    implausible = F.col("divisor").isNull() & (F.col("quantity") > 50) & F.lower(F.trim("unit")).isin("cup", "cups", "tbsp", "tsp")
    status = (
        F.when(F.col("name") == "", "no_translation").when(F.col("negligible"), "negligible").when(F.col("id").isNull(), "no_match")
        .when(implausible, "implausible_quantity").when(F.coalesce(F.col("grams"), F.lit(0.0)) <= 0, "no_weight").otherwise("resolved")
    )
    ml = F.when(F.col("unit_ml").isNotNull(), F.coalesce("fixed_q", F.lit(0.0)) * F.col("unit_ml")).otherwise(F.col("grams"))
    kind = F.when(F.col("soup"), F.col("soup_kind")).otherwise(F.col("plain_kind"))
    rows = rows.withColumn("grams", grams).withColumn("status", status).withColumns({"kind": kind, "ml": ml})
    much = F.col("ml") > F.when(F.col("kind").isin("frying_oil", "confit_fat"), 400.0).otherwise(250.0)
    rows = rows.withColumn("retained", F.when(F.col("kind").isNotNull() & much, units.lookup(dims.RETENTION, F.col("kind"))).otherwise(1.0))
    factor = F.col("grams") / 100.0 * F.col("retained")
    shares = {f"c_{n}": F.when(F.col("status") == "resolved", F.floor(F.coalesce(n, F.lit(0.0)) * factor * (100 if n == "iron" else 10) + 0.5)) for n in NUTRIENTS}
    minerals = (F.col("status") == "resolved") & (F.col("calcium").isNotNull() | F.col("iron").isNotNull())
    return rows.withColumns(shares | {"has_minerals": minerals})


def profile_sums() -> list[Column]:
    """What profiles add up over the details of a recipe: whole tenths, so the order of rows does not matter."""
    is_ = lambda s: F.col("status") == s
    return [
        *[F.sum(f"c_{n}").alias(n) for n in NUTRIENTS],
        F.count_if(~is_("negligible")).alias("total"), F.count_if(is_("resolved")).alias("resolved"),
        F.count_if(F.col("status").isin("resolved", "no_weight", "implausible_quantity")).alias("matched"),
        F.count_if(is_("negligible")).alias("negligible"), F.count_if("has_minerals").alias("mineral_rows"),
        F.bool_or(F.coalesce(is_("resolved") & (F.col("retained") < 1.0), F.lit(False))).alias("retention_applied"),
    ]


def profiles(details: DataFrame, recipes: DataFrame) -> DataFrame:
    """Profiles per serving, of the details of each recipe."""
    return profiles_of_sums(details.groupBy("rid").agg(*profile_sums()), recipes)


def profiles_of_sums(sums: DataFrame, recipes: DataFrame) -> DataFrame:
    """Profiles per serving of the sums of recipes, followed by what other columns ``sums`` has."""
    rows = sums.join(recipes.select("rid", "slug", "servings"), "rid")
    ratio = F.col("resolved") / F.col("total")
    confidence = F.when(F.col("total") == 0, "none").when(ratio >= 0.9, "high").when(ratio >= 0.5, "medium").otherwise("low")
    tenth = lambda n, d: units.rounded(F.coalesce(F.col(n), F.lit(0)) / (100.0 if d == 2 else 10.0) / F.col("servings"), d)
    covered = (F.col("resolved") > 0) & (F.col("mineral_rows") / F.col("resolved") >= 0.5)
    return rows.select(
        "rid", "slug", "servings", *[tenth(n, 1).alias(n) for n in NUTRIENTS[:7]],
        F.when(covered, tenth("calcium", 1)).alias("calcium"), F.when(covered, tenth("iron", 2)).alias("iron"),
        confidence.alias("confidence"), "resolved", "matched", "total", "negligible", "retention_applied",
        *[c for c in sums.columns if c not in {"rid", *NUTRIENTS, "total", "resolved", "matched", "negligible", "mineral_rows", "retention_applied"}],
    )


def tags(p: DataFrame) -> Column:
    """Tags of a profile, in their fixed order, joined by blanks to compare."""
    kcal = F.col("kcal")
    pct = lambda n, f: F.col(n) * f / kcal * 100
    balanced = (kcal > 0) & pct("protein", 4).between(15, 35) & pct("carbs", 4).between(40, 65) & pct("fat", 9).between(20, 35)
    all_ = F.array_compact(
        F.array(
            F.when(F.col("protein") > 25, "high-protein"), F.when((kcal > 0) & (kcal < 400), "low-calorie"), F.when(F.col("fiber") > 8, "high-fiber"),
            F.when((kcal > 700) | (F.col("fat") > 40), "indulgent"), F.when(balanced, "balanced"), F.when(F.col("iron") >= 5, "iron-rich"),
            F.when(F.col("calcium") >= 300, "calcium-rich"),
        )
    )
    return F.when(F.col("confidence").isin("none", "low"), F.array().cast("array<string>")).otherwise(all_)


def details_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda n: view(spark, sf_dir, n)
    return ingredient_details(v("ingredients"), v("foods"), v("recipes"))


def profiles_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(details_of(spark, sf_dir), view(spark, sf_dir, "recipes"))


# --- the same in SQL --------------------------------------------------------------------------------------------


def _values(table: dict) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{float(x)!r}e0" for x in (k, v)) + f", {i})" for i, (k, v) in enumerate(table.items()))


def _list(items) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


def sql_singular(c: str) -> str:
    return f"""CASE WHEN ends_with({c}, 'ies') AND length({c}) > 4 THEN {c}[:-4] || 'y' WHEN ends_with({c}, 'oes') AND length({c}) > 4 THEN {c}[:-3]
      WHEN ends_with({c}, 'ves') AND length({c}) > 4 THEN {c}[:-2] WHEN ends_with({c}, 's') AND NOT ends_with({c}, 'ss') AND length({c}) > 3 THEN {c}[:-2] ELSE {c} END"""


#: Tables and per-name lookups of the SQL side.
SQL_NAMES = f"""
  unit_g(k, v, i) AS (VALUES {_values(dims.UNIT_GRAMS)}), piece_g(k, v, i) AS (VALUES {_values(dims.PIECE_GRAMS)}), dens(k, v, i) AS (VALUES {_values(dims.DENSITIES)}),
  alias(k, v, i) AS (VALUES {_values(dims.UNIT_ALIASES)}), dflt(k, v, i) AS (VALUES {_values(dims.DEFAULT_UNIT_GRAMS)}), keep(k, v, i) AS (VALUES {_values(dims.RETENTION)}),
  portion(k, u, v, i) AS (VALUES {", ".join(f"('{k}', '{u}', {float(v)}e0, {i})" for i, (k, x) in enumerate(dims.PORTION_GRAMS.items()) for u, v in x.items())}),
  dq(k, q, u, i) AS (VALUES {", ".join(f"('{k}', {float(q)}e0, '{u}', {i})" for i, (k, (q, u)) in enumerate(dims.DEFAULT_QUANTITIES.items()))}),
  pairs AS (SELECT DISTINCT name, unit FROM ingredients),
  dqs AS (SELECT name, coalesce(max(q) FILTER (WHERE k = name), arg_max(q, length(k) * 1000 - i)) AS q, coalesce(max(u) FILTER (WHERE k = name), arg_max(u, length(k) * 1000 - i)) AS u
    FROM (SELECT DISTINCT lower(trim(name)) AS name FROM pairs) JOIN dq ON contains(name, k) GROUP BY name),
  asked AS (
    SELECT name, unit, TRY_CAST(nullif(regexp_extract(coalesce(unit, ''), '^/(\\d+)\\s+(.+)', 1), '') AS DOUBLE) AS divisor,
      coalesce(nullif(regexp_extract(coalesce(unit, ''), '^/(\\d+)\\s+(.+)', 2), ''), unit) AS u0 FROM pairs),
  wanted AS (SELECT name, u0 AS u FROM asked UNION SELECT a.name, d.u FROM asked a JOIN dqs d ON d.name = lower(trim(a.name))),
  cut AS (SELECT name, u, lower(trim(name)) AS n, list_filter(regexp_split_to_array(lower(trim(coalesce(u, ''))), '\\s+'), lambda x: x <> '') AS w FROM wanted),
  core AS (SELECT *, CASE WHEN len(list_filter(w, lambda x: x NOT IN {_list(dims.UNIT_ADJECTIVES)})) > 0 THEN list_filter(w, lambda x: x NOT IN {_list(dims.UNIT_ADJECTIVES)}) ELSE w END AS c FROM cut),
  normal AS (SELECT core.*, CASE WHEN len(w) = 0 THEN '' WHEN w[1] IN {_list(dims.MASS_AND_VOLUME_UNITS)} THEN w[1]
      ELSE coalesce(a1.v, a2.v, a3.v, array_to_string(c, ' ')) END AS nu
    FROM core LEFT JOIN alias a1 ON a1.k = array_to_string(c, ' ') LEFT JOIN alias a2 ON a2.k = c[1] LEFT JOIN alias a3 ON a3.k = c[-1]),
  single AS (SELECT *, {sql_singular("n")} AS s FROM normal),
  pieces AS (SELECT n, max(p) AS p FROM (
      SELECT n, coalesce((SELECT max(v) FROM piece_g WHERE k = n), (SELECT max(v) FROM piece_g WHERE k = s),
        (SELECT arg_max(v, length(k) * 1000 - i) FROM piece_g WHERE regexp_matches(n, '\\b' || k || '\\b'))) AS p FROM (SELECT DISTINCT n, s FROM single)) GROUP BY n),
  densities AS (SELECT n, coalesce((SELECT arg_max(v, length(k) * 1000 - i) FROM dens WHERE contains(n, k)), 1.0) AS d FROM (SELECT DISTINCT n FROM single)),
  portions AS (SELECT n, nu, coalesce((SELECT max(v) FROM portion WHERE k = n AND portion.u = nu), (SELECT max(v) FROM portion WHERE k = s AND portion.u = nu),
        (SELECT arg_max(v, list_position(string_split(n, ' '), k)) FROM portion WHERE portion.u = nu AND list_contains(string_split(n, ' '), k)),
        (SELECT arg_max(v, length(k) * 1000 - i) FROM portion WHERE portion.u = nu AND contains(n, k))) AS p FROM (SELECT DISTINCT n, s, nu FROM single)),
  weights AS (SELECT s.name, s.u, s.nu, s.n, pieces.p AS piece, CASE WHEN s.u IS NULL THEN pieces.p WHEN s.nu IN ('g', 'kg', 'oz', 'lb') THEN ug.v
      ELSE coalesce(CASE WHEN s.nu IN {_list(dims.PIECE_LIKE_UNITS)} THEN pieces.p END, portions.p,
        CASE WHEN s.nu IN {_list(units.VOLUME_UNITS)} AND d <> 1.0 THEN ug.v * d END, ug.v, df.v) END AS g
    FROM single s LEFT JOIN pieces USING (n) LEFT JOIN densities USING (n) LEFT JOIN portions ON portions.n = s.n AND portions.nu = s.nu
      LEFT JOIN unit_g ug ON ug.k = s.nu LEFT JOIN dflt df ON df.k = s.nu)
"""
_HAS = lambda parts: " OR ".join(f"contains(key, '{p}')" for p in parts)
SQL_DETAILS = f"""
  ff AS (SELECT * EXCLUDE (rn) FROM (SELECT *, lower(trim(name)) AS key, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY id) AS rn FROM foods) WHERE rn = 1),
  base AS (
    SELECT i.*, lower(trim(i.name)) AS key, a.divisor, a.u0, w.nu, f.id AS food, {", ".join("f." + n for n in NUTRIENTS)},
      {" OR ".join(f"contains(lower(r.title), '{p}')" for p in dims.SOUPS)} AS soup,
      CASE WHEN a.divisor IS NOT NULL THEN greatest(coalesce(i.quantity, 1.0), 1.0) / a.divisor ELSE i.quantity END AS fq, w.g AS unit_grams, w.piece,
      d.q * dw.g AS default_g,
      (lower(trim(i.name)) IN {_list(dims.NEGLIGIBLE)} OR (lower(trim(i.name)) IN {_list(dims.HERBS)} AND (coalesce(i.unit, '') = '' OR rw.nu IN {_list(dims.SMALL_HERB_UNITS)}))) AS negl
    FROM ingredients i JOIN recipes r USING (rid) JOIN asked a ON a.name = i.name AND a.unit IS NOT DISTINCT FROM i.unit
      LEFT JOIN weights w ON w.name = i.name AND w.u IS NOT DISTINCT FROM a.u0 LEFT JOIN weights rw ON rw.name = i.name AND rw.u = i.unit
      LEFT JOIN dqs d ON d.name = lower(trim(i.name)) LEFT JOIN weights dw ON dw.name = i.name AND dw.u = d.u LEFT JOIN ff f ON f.key = lower(trim(i.name))),
  weighed AS (SELECT *, coalesce(fq * unit_grams, CASE WHEN fq IS NULL THEN coalesce(default_g, piece) END) AS grams FROM base),
  judged AS (SELECT *, CASE WHEN name = '' THEN 'no_translation' WHEN negl THEN 'negligible' WHEN food IS NULL THEN 'no_match'
      WHEN divisor IS NULL AND quantity > 50 AND lower(trim(unit)) IN ('cup', 'cups', 'tbsp', 'tsp') THEN 'implausible_quantity'
      WHEN coalesce(grams, 0) <= 0 THEN 'no_weight' ELSE 'resolved' END AS status,
      CASE WHEN {_HAS(dims.DISCARDED)} THEN 'discard' WHEN {_HAS(dims.ALCOHOL)} THEN 'alcohol'
        WHEN {_HAS(["broth", "stock", "bouillon", "fond"])} THEN CASE WHEN soup THEN 'soup_broth' ELSE 'braising' END
        WHEN {_HAS(dims.CONFIT_FATS)} THEN 'confit_fat' WHEN contains(key, 'oil') THEN 'frying_oil' END AS kind FROM weighed),
  held AS (SELECT j.*, CASE WHEN kind IS NOT NULL AND CASE WHEN nu IN {_list(units.VOLUME_UNITS)} THEN coalesce(fq, 0) * ug.v ELSE grams END
      > CASE WHEN kind IN ('frying_oil', 'confit_fat') THEN 400.0 ELSE 250.0 END THEN keep.v ELSE 1.0 END AS retained
    FROM judged j LEFT JOIN unit_g ug ON ug.k = nu LEFT JOIN keep ON keep.k = kind),
  details AS (SELECT *, {", ".join(f"CASE WHEN status = 'resolved' THEN CAST(floor(coalesce({n}, 0) * (grams / 100.0 * retained) * {100 if n == 'iron' else 10} + 0.5) AS BIGINT) END AS c_{n}" for n in NUTRIENTS)},
      status = 'resolved' AND (calcium IS NOT NULL OR iron IS NOT NULL) AS has_minerals FROM held)
"""
_T = lambda n, d: units.sql_rounded(f"coalesce({n}, 0) / {100.0 if d == 2 else 10.0} / servings", d)
SQL_PROFILES = f"""
  sums AS (SELECT rid, {", ".join(f"CAST(sum(c_{n}) AS BIGINT) AS {n}" for n in NUTRIENTS)}, count(*) FILTER (WHERE status <> 'negligible') AS total,
      count(*) FILTER (WHERE status = 'resolved') AS resolved, count(*) FILTER (WHERE status IN ('resolved', 'no_weight', 'implausible_quantity')) AS matched,
      count(*) FILTER (WHERE status = 'negligible') AS negligible, count(*) FILTER (WHERE has_minerals) AS mineral_rows,
      bool_or(status = 'resolved' AND retained < 1.0) AS retention_applied FROM details GROUP BY rid),
  profiles AS (SELECT rid, slug, servings, {", ".join(f"{_T(n, 1)} AS {n}" for n in NUTRIENTS[:7])},
      CASE WHEN resolved > 0 AND mineral_rows / resolved >= 0.5 THEN {_T("calcium", 1)} END AS calcium, CASE WHEN resolved > 0 AND mineral_rows / resolved >= 0.5 THEN {_T("iron", 2)} END AS iron,
      CASE WHEN total = 0 THEN 'none' WHEN resolved / total >= 0.9 THEN 'high' WHEN resolved / total >= 0.5 THEN 'medium' ELSE 'low' END AS confidence,
      resolved, matched, total, negligible, retention_applied FROM sums JOIN recipes USING (rid))
"""
NAMES_SQL, DETAILS_SQL = f"WITH {SQL_NAMES}", f"WITH {SQL_NAMES}, {SQL_DETAILS}"
PROFILES_SQL = f"{DETAILS_SQL}, {SQL_PROFILES}"

catalog.add("AGG-1_nutrition_profile", profiles_of, with_views(f"{PROFILES_SQL} SELECT * FROM profiles"))


@catalog.query(
    "AGG-2_nutrition_tags",
    with_views(f"""{PROFILES_SQL} SELECT rid, CASE WHEN confidence IN ('none', 'low') THEN '' ELSE concat_ws(' ', CASE WHEN protein > 25 THEN 'high-protein' END,
      CASE WHEN kcal > 0 AND kcal < 400 THEN 'low-calorie' END, CASE WHEN fiber > 8 THEN 'high-fiber' END, CASE WHEN kcal > 700 OR fat > 40 THEN 'indulgent' END,
      CASE WHEN kcal > 0 AND protein * 4 / kcal * 100 BETWEEN 15 AND 35 AND carbs * 4 / kcal * 100 BETWEEN 40 AND 65 AND fat * 9 / kcal * 100 BETWEEN 20 AND 35 THEN 'balanced' END,
      CASE WHEN iron >= 5 THEN 'iron-rich' END, CASE WHEN calcium >= 300 THEN 'calcium-rich' END) END AS tags FROM profiles"""),
)
def nutrition_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profiles_of(spark, sf_dir)
    return p.select("rid", F.array_join(tags(p), " ").alias("tags"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "ingredients").select("name", "unit").distinct()


catalog.add(
    "NUM-1_estimate_grams",
    lambda s, d: view(s, d, "ingredients").alias("i").join(units.with_unit_grams(_pairs(s, d), "name", "unit", "g").alias("g"), F.expr("i.name = g.name and i.unit <=> g.unit"))
    .select("rid", "pos", F.round(F.col("quantity") * F.col("g"), 6).alias("grams")),
    with_views(f"{NAMES_SQL}, u AS (SELECT *, unit AS uu FROM ingredients), nw AS (SELECT DISTINCT name AS nm, unit AS uu FROM u) "
               "SELECT rid, pos, round(quantity * g, 6) AS grams FROM u LEFT JOIN weights w ON w.name = u.name AND w.u IS NOT DISTINCT FROM u.unit").replace(
                   "SELECT name, u0 AS u FROM asked UNION", "SELECT name, u0 AS u FROM asked UNION SELECT name, unit FROM asked UNION"),
)
catalog.add(
    "NUM-2_unit_normalise",
    lambda s, d: _pairs(s, d).where("unit is not null").select("unit").distinct().select("unit", units.normal_unit(F.col("unit")).alias("normal")),
    with_views(f"{NAMES_SQL} SELECT DISTINCT u AS unit, nu AS normal FROM weights WHERE u IN (SELECT unit FROM pairs)").replace(
        "SELECT name, u0 AS u FROM asked UNION", "SELECT name, unit AS u FROM asked UNION"),
)
catalog.add(
    "JOI-12_piece_weight",
    lambda s, d: _pairs(s, d).select("name").distinct().select("name", units.piece_grams(F.col("name")).alias("grams")),
    with_views(f"{NAMES_SQL} SELECT DISTINCT name, piece AS grams FROM weights"),
)
catalog.add(
    "JOI-13_liquid_density",
    lambda s, d: _pairs(s, d).select("name").distinct().select("name", units.density(F.col("name")).alias("density")),
    with_views(f"{NAMES_SQL} SELECT DISTINCT name, d AS density FROM pairs JOIN densities ON n = lower(trim(name))"),
)
catalog.add(
    "JOI-11_common_portion",
    lambda s, d: _pairs(s, d).select("name").distinct().select("name", *[units.portion_grams(F.col("name"), F.lit(u)).alias(u) for u in ("cup", "tbsp", "tsp")]),
    with_views(f"""{NAMES_SQL}, nn AS (SELECT DISTINCT name, lower(trim(name)) AS n, {sql_singular("lower(trim(name))")} AS s FROM pairs)
      SELECT name, {", ".join(f'''coalesce((SELECT max(v) FROM portion WHERE k = n AND portion.u = '{u}'), (SELECT max(v) FROM portion WHERE k = s AND portion.u = '{u}'),
        (SELECT arg_max(v, list_position(string_split(n, ' '), k)) FROM portion WHERE portion.u = '{u}' AND list_contains(string_split(n, ' '), k)),
        (SELECT arg_max(v, length(k) * 1000 - i) FROM portion WHERE portion.u = '{u}' AND contains(n, k))) AS {u}''' for u in ("cup", "tbsp", "tsp"))} FROM nn"""),
)
catalog.add(
    "JOI-15_default_quantity",
    lambda s, d: per_name(view(s, d, "ingredients")).select("name", F.round("default_g", 6).alias("grams")).distinct(),
    with_views(f"{NAMES_SQL} SELECT DISTINCT p.name, round(q * g, 6) AS grams FROM pairs p LEFT JOIN dqs d ON d.name = lower(trim(p.name)) LEFT JOIN weights w ON w.name = p.name AND w.u = d.u"),
)
catalog.add(
    "FLT-22_negligible",
    lambda s, d: view(s, d, "ingredients").where(units.negligible(F.lower(F.trim("name")), F.col("unit"))).groupBy("name").agg(F.count("*").alias("n")),
    with_views(f"{DETAILS_SQL} SELECT name, count(*) AS n FROM details WHERE negl GROUP BY name").replace(
        "SELECT name, u0 AS u FROM asked UNION", "SELECT name, u0 AS u FROM asked UNION SELECT name, unit FROM asked UNION"),
)
catalog.add(
    "STR-22_liquid_class",
    lambda s, d: _pairs(s, d).select("name").distinct().select("name", units.liquid(F.lower("name"), F.lit(True)).alias("kind")),
    with_views(f"""SELECT DISTINCT name, CASE WHEN {_HAS(dims.DISCARDED)} THEN 'discard' WHEN {_HAS(dims.ALCOHOL)} THEN 'alcohol' WHEN {_HAS(["broth", "stock", "bouillon", "fond"])} THEN 'soup_broth'
      WHEN {_HAS(dims.CONFIT_FATS)} THEN 'confit_fat' WHEN contains(key, 'oil') THEN 'frying_oil' END AS kind FROM (SELECT name, lower(name) AS key FROM ingredients)"""),
)
catalog.add(
    "STR-23_soup_test",
    lambda s, d: view(s, d, "recipes").groupBy(units.soup(F.col("title")).alias("soup")).agg(F.count("*").alias("n")),
    with_views(f"""SELECT {" OR ".join(f"contains(lower(title), '{p}')" for p in dims.SOUPS)} AS soup, count(*) AS n FROM recipes GROUP BY 1"""),
)
catalog.add(
    "AGG-24_macro_ratios",
    lambda s, d: profiles_of(s, d).select("rid", *[F.when(F.col("kcal") > 0, units.rounded(F.col(n) * f / F.col("kcal") * 100, 3)).alias(f"pct_{n}") for n, f in (("fat", 9), ("protein", 4), ("carbs", 4))]),
    with_views(f"{PROFILES_SQL} SELECT rid, " + ", ".join(f"CASE WHEN kcal > 0 THEN {units.sql_rounded(f'{n} * {f} / kcal * 100', 3)} END AS pct_{n}" for n, f in (("fat", 9), ("protein", 4), ("carbs", 4))) + " FROM profiles"),
)
catalog.add(
    "FLT-13_no_match",
    lambda s, d: details_of(s, d).where("status = 'no_match'").select("rid").distinct(),
    with_views(f"{DETAILS_SQL} SELECT DISTINCT rid FROM details WHERE status = 'no_match'"),
)
catalog.add(
    "FLT-12_outliers",
    lambda s, d: profiles_of(s, d).where("kcal > 1500 or kcal = 0").select("rid", "kcal"),
    with_views(f"{PROFILES_SQL} SELECT rid, kcal FROM profiles WHERE kcal > 1500 OR kcal = 0"),
)
catalog.add(
    "FLT-14_suspect_servings",
    lambda s, d: profiles_of(s, d).where("servings = 1 and kcal > 800").select("rid", "kcal"),
    with_views(f"{PROFILES_SQL} SELECT rid, kcal FROM profiles WHERE servings = 1 AND kcal > 800"),
)


@catalog.query(
    "PRJ-13_servings_fix",
    with_views(f"""{PROFILES_SQL}, f AS (SELECT p.rid, p.servings, kcal, recipe_type, (servings <= 2 AND kcal > CASE WHEN recipe_type = 'main_course' THEN 2000 ELSE 1500 END) OR kcal > 3000 AS wrong
      FROM profiles p JOIN recipes r USING (rid, servings)), g AS (SELECT *, CASE WHEN wrong THEN CAST(least(greatest(4, floor(kcal * servings / 500 + 0.5)), 4 * servings) AS BIGINT) ELSE servings END AS fixed FROM f)
      SELECT rid, CAST(fixed AS BIGINT) AS fixed, {units.sql_rounded("kcal * servings / fixed", 1)} AS kcal FROM g"""),
)
def servings_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Servings that make a portion implausible are corrected, and the profile is rescaled."""
    p = profiles_of(spark, sf_dir).join(view(spark, sf_dir, "recipes").select("rid", "recipe_type"), "rid")
    limit = F.when(F.col("recipe_type") == "main_course", 2000).otherwise(1500)
    wrong = ((F.col("servings") <= 2) & (F.col("kcal") > limit)) | (F.col("kcal") > 3000)
    fixed = F.when(wrong, F.least(F.greatest(F.lit(4.0), F.floor(F.col("kcal") * F.col("servings") / 500 + 0.5).cast("double")), (4 * F.col("servings")).cast("double")).cast("long")).otherwise(F.col("servings").cast("long"))
    return p.select("rid", fixed.alias("fixed"), units.rounded(F.col("kcal") * F.col("servings") / fixed, 1).alias("kcal"))


QUERIES, SQL = catalog.queries, catalog.sql
