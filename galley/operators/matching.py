"""Names matched to foods: a ladder of tiers, lookup keys of listed names, and portions.

Names that are alike are found by the cosine of their sets of three letters. Pairs are joined on the rarest letters
of each name only: two sets whose cosine is high enough share one of these, so no pair is lost and frequent
letters never meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions import foodwords, text
from galley.operators.kitchen import _quoted
from galley.operators.names import _priority_sql, CHANGERS, LIGHT, LIGHT_CEILING, priority, query_words, scratch, valid_words
from galley.operators.scalars import KNOWN_SAUCES, MIXTURE_ENDS, MIXTURES
from galley.plans.adapters import view, with_views
from galley.plans.catalog import Catalog
from galley.tables import computed

catalog = Catalog()
#: Least likeness of a match; of a portion's food, and from which on no judge is needed.
ALIKE, PORTION, SURE = 0.75, 0.80, 0.88
# Words and endings of listed names that don't name the food, and names that others know them by.
LISTED_WORDS = ["raw", "fresh", "mature", "whole", "cooked", "dried", "canned", "frozen", "without salt", "salted", "unsalted", "uncooked", "unprepared", "unenriched", "enriched", "plain"]
LISTED_ENDS = "raw|fresh|mature seeds|mature|without skin|with skin|without salt|with salt added|not further specified|nfs|year round average|includes usda commodity"
OTHER_NAMES = {
    "pak-choi": "bok choy", "pe-tsai": "napa cabbage", "garbanzo": "chickpea", "bengal gram": "chickpea", "broad beans": "fava beans", "cos": "romaine lettuce", "swamp cabbage": "water spinach",
    "garden cress": "cress", "beet": "beetroot", "beets": "beetroot", "agar": "agar-agar", "rutabaga": "swede", "eggplant": "aubergine", "zucchini": "courgette", "scallion": "spring onion", "cilantro": "coriander",
}
# Words of an ingredient that don't choose its portion.
PORTION_WORDS = [
    "fresh", "organic", "raw", "large", "small", "medium", "homemade", "store-bought", "good", "quality", "extra", "virgin", "pure", "natural", "thick", "thin",
    "whole", "ground", "minced", "chopped", "sliced", "diced", "grated", "crushed", "dried", "frozen", "canned", "cooked", "warm", "cold", "hot",
]
# Fixed values of the guards: words that say nothing of the food, dishes, spices, vegetables, plants known for their seeds.
PLAIN = ["raw", "fresh", "dried", "whole", "ground", "cooked", "large", "small", "medium", "organic", "extra", "virgin", "pure", "natural", "store-bought"]
DISHES = ["bread", "cake", "cookie", "cereal", "soup", "candy", "bar", "pudding", "infant", "baby", "babyfood", "pizza", "pie", "muffin", "wafer", "cracker", "sandwich", "burger"]
SPICES = ["pepper", "peppers", "cumin", "cinnamon", "paprika", "turmeric", "cayenne"]
SWEET_PEPPERS = ["sweet", "bell", "banana", "jalapeño", "habanero", "serrano"]
SEEDED = ["cumin", "anise", "fennel", "caraway", "sesame", "poppy", "mustard", "celery"]


def add(name: str, f, sql: str) -> None:
    catalog.add(name, f, with_views(sql))


def _listed(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that all share and read again: what several tiers read is made once."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


# --- names that are alike ---


def letters(c: Column) -> Column:
    """The distinct runs of three letters of a name, with blanks before and behind it."""
    padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def alike(names: DataFrame, index: DataFrame, least: float) -> DataFrame:
    """(name, id, score) of all names and index rows (id, name) whose cosine is ``least`` or more."""
    a = names.select("name").where("name is not null").distinct().select("name", letters(F.col("name")).alias("g"))
    b = index.where("name is not null").select("id", letters(F.col("name")).alias("g"))
    counts = a.select(F.explode("g").alias("w")).unionAll(b.select(F.explode("g").alias("w"))).groupBy("w").agg(F.count("*").alias("n"))

    def rarest(df: DataFrame, key: str) -> DataFrame:
        """Each row's rarest runs: as many as leave less than a partner at ``least`` must share."""
        rows = df.select(key, F.size("g").alias("size"), F.explode("g").alias("w")).join(counts, "w").groupBy(key, "size").agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("r"))
        keep = F.col("size") - F.ceil(F.col("size") * (least * least) - 1e-9) + 1
        return rows.select(key, F.explode(F.slice("r", 1, F.least(keep, F.col("size")).cast("int"))).alias("x")).select(key, "x.w")

    pairs = rarest(a, "name").join(rarest(b, "id"), "w").select("name", "id").distinct()
    both = pairs.join(a, "name").join(b.withColumnRenamed("g", "h"), "id")
    score = F.size(F.array_intersect("g", "h")) / F.sqrt((F.size("g") * F.size("h")).cast("double"))
    return both.select("name", "id", score.alias("score")).where(F.col("score") >= least)


def composite(c: Column) -> Column:
    """A prepared mixture, whose food can't be told from its name; known sauces are foods."""
    name = F.trim(F.lower(c))
    return ~name.isin(*KNOWN_SAUCES) & (name.isin(*MIXTURES) | reduce(lambda x, y: x | y, [name.endswith(e) for e in MIXTURE_ENDS]))


def phrases_by_rank(c: Column) -> Column:
    """The parts of a name to look up, in this order: the whole, then fewer words, of each length the last first."""
    words = text.words(c)
    n = F.size(words)
    shorter = F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.transform(F.sequence(n - k, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(words, i + 1, k), " ")))
    return F.when(n > 0, F.flatten(shorter)).otherwise(F.array().cast("array<string>"))


def match_ladder(names: DataFrame, cache: DataFrame, index: DataFrame, least: float = ALIKE) -> DataFrame:
    """(name, key, tier, id, score) of every distinct name; id is null where it stands for no food.

    cache (key, id; null: known to have none), index (id, name, kcal). Each tier takes what those before left:
    cached names, prepared mixtures (none), a name or part of it that the index holds, the likest of ten that
    passes validation, none. All but cached rows are what the cache lacks, those without a food included.
    """
    rows, index = kept(names.select("name").distinct()), kept(index.select("id", "name", "kcal"))
    rows = kept(rows.where("trim(name) <> ''").withColumn("key", text.key(F.col("name"))).withColumn("mixed", composite(F.col("name"))))
    known = cache.groupBy("key").agg(F.max("id").alias("id"))
    cached = rows.join(known, "key").select("name", "key", F.lit("cache").alias("tier"), "id", F.lit(None).cast("double").alias("score"))
    rows = rows.join(known, "key", "left_anti")
    mixed = rows.where("mixed").select("name", "key", F.lit("composite").alias("tier"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("double").alias("score"))
    rows = rows.where("not mixed")
    keys = index.groupBy(F.lower(F.trim("name")).alias("phrase")).agg(F.min("id").alias("id"))
    parts = rows.select("name", "key", F.posexplode(phrases_by_rank(F.col("key"))).alias("n", "phrase"))
    exact = kept(parts.join(keys, "phrase").groupBy("name", "key").agg(F.min_by("id", "n").alias("id")).select("name", "key", F.lit("exact").alias("tier"), "id", F.lit(1.0).alias("score")))
    rows = kept(rows.join(exact.select("name"), "name", "left_anti"))
    near = alike(rows, index, least).withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.col("score").desc(), "id"))).where("r <= 10")
    # words of names and foods are taken once each, before they are paired
    asked, foods = rows.select("name", query_words(F.col("name")).alias("q")), index.select("id", foodwords.key_words(F.col("name")).alias("m"), "kcal")
    near = near.join(foods, "id").join(asked, "name").where(valid_words(F.col("q"), F.col("m"), F.col("kcal")))
    near = near.groupBy("name").agg(F.min_by(F.struct("id", "score"), "r").alias("x"))
    rest = rows.join(near, "name", "left").select("name", "key", F.when(F.col("x").isNull(), "none").otherwise("semantic").alias("tier"), "x.id", "x.score")
    return cached.unionByName(mixed).unionByName(exact).unionByName(rest)


# --- lookup keys of listed names ---


def many(c: Column) -> Column:
    return F.when(c.endswith("y") & ~c.endswith("ey"), F.concat(F.substring(c, F.lit(1), F.length(c) - 1), F.lit("ies"))).when(c.rlike("(s|sh|ch|x|z)$"), F.concat(c, F.lit("es"))).otherwise(F.concat(c, F.lit("s")))


def with_lookup_keys(listed: DataFrame) -> DataFrame:
    """``listed`` (.., name) with ``keys``: what a listed name ("Peppers, sweet, red, raw") may be asked by; distinct, in no order."""
    own = listed.columns
    one = text.portion_singular
    long = lambda xs, n: F.filter(xs, lambda x: F.length(x) > n)
    both = lambda xs, f: F.concat(xs, F.transform(xs, f))
    others = F.create_map(*[F.lit(x) for pair in OTHER_NAMES.items() for x in pair])
    rows = computed(listed, low_=F.lower(F.trim("name")))
    rows = computed(rows, first_=F.array(F.trim(F.split_part("low_", F.lit(","), F.lit(1)))), short_=F.trim(F.regexp_replace(F.trim(F.regexp_replace("low_", rf",?\s*\b(?:{LISTED_ENDS})\b.*$", "")), ",+$", "")))
    rows = computed(rows, parts_=F.filter(F.transform(F.split("short_", ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.isin(*LISTED_WORDS)), stems_=F.transform("first_", one))
    rows = computed(rows, rest_=F.slice("parts_", 2, 1000), firsts_=both(F.slice("parts_", 1, 1), one))
    rows = computed(rows, after_=F.array_join("rest_", " "))
    # qualifiers, further parts and names in brackets, each as is and as one
    asides = F.transform(F.regexp_extract_all("low_", F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda x: F.trim(x))
    words = F.filter(F.flatten(F.transform("parts_", text.words)), lambda x: (F.length(x) > 3) & ~x.isin(*LISTED_WORDS) & (x != F.get("first_", F.lit(0))))
    rows = computed(rows, asides_=F.concat(long(F.array("after_"), 3), long("rest_", 3), long(asides, 2)), words_=words)
    turned = F.when(F.size("parts_") >= 2, F.transform("firsts_", lambda f: F.concat_ws(" ", "after_", f))).otherwise(F.array().cast("array<string>"))
    rows = computed(rows, words_=long(F.transform("words_", one), 3), turned_=turned)
    rows = computed(rows, keys=F.concat("first_", "stems_", F.transform("stems_", many), "turned_", long(F.array(F.array_join("parts_", " ")), 3), both(F.col("asides_"), one), both(F.col("words_"), many)))
    fresh = F.transform("keys", lambda k: F.when(k.startswith("fresh "), F.substring(k, F.lit(7), F.length(k))).when(F.length(k) > 3, F.concat(F.lit("fresh "), k)))
    rows = computed(rows, keys=F.concat("keys", F.filter(fresh, lambda k: k.isNotNull())))
    rows = computed(rows, keys=F.concat("keys", F.filter(F.transform("keys", lambda k: F.try_element_at(others, k)), lambda k: k.isNotNull())))
    blanks = lambda k: F.trim(F.regexp_replace(F.regexp_replace(k, r"\([^)]*\)", ""), r"\s+", " "))
    return rows.select(*own, long(F.array_distinct(F.transform("keys", blanks)), 2).alias("keys"))


def key_index(listed: DataFrame) -> DataFrame:
    """(key, id, name): of all listed names (id, name) with a key, the one that stands best for it; of equals the smallest id."""
    rows = with_lookup_keys(kept(listed.select("id", "name"))).select("id", "name", F.explode("keys").alias("key"))
    best = F.struct(-priority(F.col("name"), F.col("key")), F.col("id"))
    return kept(rows.groupBy("key").agg(F.min_by(F.struct("id", "name"), best).alias("x")).select("key", "x.id", "x.name"))


# --- portions ---


def portion_words(query: Column) -> Column:
    return F.array_except(text.words(F.regexp_replace(F.lower(query), "[,;.()]", " ")), _listed(PLAIN))


def first_words(listed: Column) -> Column:
    return text.words(F.split_part(F.lower(listed), F.lit(","), F.lit(1)))


def valid_portion(q: Column, own: Column, low: Column) -> Column:
    """Whether a listed food (``own``: words of its first part, ``low``: its name) may stand for a query's words ``q``.

    Its first part shares a word with the query, is no dish that the query isn't, and no namesake.
    """
    cut = lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)
    forms = F.flatten(F.transform(q, lambda w: F.array(w, F.concat(w, F.lit("s")), F.when(w.endswith("s") & ~w.endswith("ss"), cut(w, 1)).otherwise(w), F.when(w.endswith("ies"), F.concat(cut(w, 3), F.lit("y"))).otherwise(w))))
    has = lambda words, xs: F.arrays_overlap(words, _listed(xs))
    dish = has(own, DISHES) & ~has(q, DISHES)
    pepper = has(q, SPICES) & ~has(q, SWEET_PEPPERS) & has(own, ["pepper", "peppers"]) & has(own, SWEET_PEPPERS)
    seed = has(q, SEEDED) & has(own, ["seed", "seeds"]) & ~F.arrays_overlap(forms, F.array_except(own, _listed(["seed", "seeds"])))
    human = F.array_contains(q, "milk") & low.contains("human")
    yeast = F.array_contains(q, "yeast") & (low.contains("extract") | low.contains("spread")) & ~has(q, ["extract", "spread"])
    baking = F.array_contains(q, "baking") & has(q, ["soda", "powder"]) & low.contains("chocolate")
    return F.arrays_overlap(forms, own) & ~(dish | pepper | seed | human | yeast | baking)


def with_tries(names: DataFrame) -> DataFrame:
    """``names`` (.., name) with ``tries``: what each is looked up by, in order: itself, without plain words, its words from the last, its first alternative; each as is, as one and as many."""
    own = names.columns
    bare = lambda ws: F.filter(ws, lambda w: ~w.isin(*PORTION_WORDS))
    filled = lambda xs: F.filter(xs, lambda x: F.coalesce(x, F.lit("")) != "")
    rows = names.withColumn("key_", F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), "[,;.()]+", " "), r"\s+", " ")))
    rows = rows.withColumn("words_", text.words(F.col("key_"))).withColumn("bare_", bare(F.col("words_"))).withColumn("first_", F.when(F.col("key_").contains(" or "), F.trim(F.split_part("key_", F.lit(" or "), F.lit(1)))))
    rows = rows.withColumn("short_", F.coalesce(bare(text.words(F.col("first_"))), F.array().cast("array<string>")))
    single = F.filter(F.reverse(F.when(F.size("bare_") > 0, F.col("bare_")).otherwise(F.col("words_"))), lambda w: F.length(w) >= 3)
    rows = rows.withColumn("tries", F.concat(F.array("key_"), filled(F.array(F.array_join("bare_", " "))), single, filled(F.array("first_", F.array_join("short_", " "), F.try_element_at("short_", F.lit(-1))))))
    rows = rows.withColumn("tries", F.transform("tries", lambda t: F.struct(t.alias("t"), text.portion_singular(t).alias("o"))))
    return rows.select(*own, F.flatten(F.transform("tries", lambda x: F.array(x["t"], x["o"], many(x["o"])))).alias("tries"))


def match_portions(names: DataFrame, keys: DataFrame, listed: DataFrame, least: float = PORTION, sure: float = SURE) -> DataFrame:
    """(name, tier, id, score) of every distinct name: exact by a key, sure or to be judged by likeness, or none."""
    rows, keys, listed = kept(names.select("name").distinct()).where("trim(name) <> ''"), keys.select("key", "id"), kept(listed.select("id", "name"))
    tries = with_tries(rows).select("name", F.posexplode("tries").alias("n", "key"))
    exact = kept(tries.join(keys, "key").groupBy("name").agg(F.min_by("id", "n").alias("id")).select("name", F.lit("exact").alias("tier"), "id", F.lit(1.0).alias("score")))
    rows = kept(rows.join(exact, "name", "left_anti"))
    near = alike(rows, listed, least).withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.col("score").desc(), "id"))).where("r <= 15")
    asked, foods = rows.select("name", portion_words(F.col("name")).alias("q")), listed.select("id", F.lower("name").alias("low"), first_words(F.col("name")).alias("own"))
    near = near.join(foods, "id").join(asked, "name").where(valid_portion(F.col("q"), F.col("own"), F.col("low")))
    near = near.groupBy("name").agg(F.min_by(F.struct("id", "score"), "r").alias("x"))
    tier = F.when(F.col("x").isNull(), "none").when(F.col("x.score") >= sure, "sure").otherwise("judge")
    return exact.unionByName(rows.join(near, "name", "left").select("name", tier.alias("tier"), "x.id", "x.score"))


def final_index(keys: DataFrame, matched: DataFrame) -> DataFrame:
    """(key, id): keys of listed foods, replaced by what names were matched to, and one or many of each key that has no food of its own."""
    own = matched.where("id is not null and tier <> 'judge'").select(F.trim(F.lower("name")).alias("key"), "id").groupBy("key").agg(F.min("id").alias("id"))
    base = keys.select("key", "id").join(own, "key", "left_anti").unionByName(own)
    other = F.when(F.col("key").endswith("s") & ~F.col("key").endswith("ss"), F.substring("key", F.lit(1), F.length("key") - 1)).when(~F.col("key").endswith("s"), F.concat("key", F.lit("s")))
    more = base.select(F.when(F.length("key") > 2, other).alias("other"), "key", "id").where("length(other) > 2").groupBy(F.col("other").alias("key")).agg(F.min_by("id", "key").alias("id"))
    return base.unionByName(more.join(base, "key", "left_anti"))


# --- queries ---
_SQL_KEY = lambda e: f"trim(regexp_replace(regexp_replace(lower({e}), '[,;.()]', ' ', 'g'), '\\s+', ' ', 'g'))"
_GRAMS = lambda e: f"list_distinct(list_transform(range(1, length({e}) + 2), lambda i: substr('  ' || lower({e}) || ' ', i, 3)))"
_COSINE = "len(list_intersect(a.g, b.g)) / sqrt(CAST(len(a.g) * len(b.g) AS DOUBLE))"
_CACHE = f"SELECT DISTINCT {_SQL_KEY('name')} AS key, CASE WHEN length({_SQL_KEY('name')}) % 4 > 0 THEN CAST(length(name) AS BIGINT) END AS id FROM wanted_names WHERE length({_SQL_KEY('name')}) % 6 = 0"


def _cache(s, d) -> DataFrame:
    key = text.key(F.col("name"))
    return kept(view(s, d, "wanted_names")).where(F.length(key) % 6 == 0).select(key.alias("key"), F.when(F.length(key) % 4 > 0, F.length("name").cast("bigint")).alias("id"))


_VALID = f"""len(q) = 0 OR (len(list_filter(q, lambda x: list_contains(m, x))) >= least(len(q), 2) AND NOT list_has_any(list_filter(m, lambda x: NOT list_contains(q, x)), {CHANGERS}) AND NOT (kcal > {LIGHT_CEILING} AND list_has_any(q, {LIGHT})))"""
add("JOI-4_match_ladder", lambda s, d: match_ladder(view(s, d, "wanted_names"), _cache(s, d), view(s, d, "food_index")).withColumn("score", F.floor(F.col("score") * 1_000_000)), f"""WITH cached AS (SELECT key, max(id) AS id FROM ({_CACHE}) GROUP BY key),
  w AS (SELECT name, {_SQL_KEY('name')} AS key FROM wanted_names), ix AS (SELECT * FROM food_index),
  c AS (SELECT w.name, w.key, 'cache' AS tier, c.id, NULL AS score FROM w JOIN cached c ON c.key = w.key), w1 AS (SELECT * FROM w WHERE key NOT IN (SELECT key FROM cached)),
  m AS (SELECT name, key, 'composite' AS tier, CAST(NULL AS BIGINT) AS id, NULL AS score FROM w1 WHERE trim(lower(name)) NOT IN {_quoted(KNOWN_SAUCES)} AND (trim(lower(name)) IN {_quoted(MIXTURES)} OR {" OR ".join(f"ends_with(trim(lower(name)), '{e}')" for e in MIXTURE_ENDS)})),
  w2 AS (SELECT * FROM w1 WHERE name NOT IN (SELECT name FROM m)),
  ph AS (SELECT name, key, k, i, array_to_string(string_split(key, ' ')[i:i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM (SELECT *, len(string_split(key, ' ')) AS n FROM w2)))),
  ex AS (SELECT name, ph.key, 'exact' AS tier, id, 1.0 AS score FROM ph JOIN (SELECT lower(trim(name)) AS phrase, min(id) AS id FROM ix GROUP BY 1) USING (phrase) QUALIFY row_number() OVER (PARTITION BY name ORDER BY k DESC, i DESC) = 1),
  w3 AS (SELECT *, {_GRAMS('name')} AS g, {foodwords.sql_key_words(text.sql_before_alternative('name'))} AS q FROM w2 WHERE name NOT IN (SELECT name FROM ex)),
  nr AS (SELECT a.name, a.q, b.id, b.kcal, b.m, {_COSINE} AS score FROM w3 a JOIN (SELECT *, {_GRAMS('name')} AS g, {foodwords.sql_key_words('name')} AS m FROM ix) b ON {_COSINE} >= {ALIKE}),
  tp AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS r FROM nr QUALIFY r <= 10),
  ok AS (SELECT name, id, score FROM tp WHERE {_VALID} QUALIFY row_number() OVER (PARTITION BY name ORDER BY r) = 1),
  a AS (SELECT * FROM c UNION ALL SELECT * FROM m UNION ALL SELECT * FROM ex UNION ALL SELECT w3.name, key, CASE WHEN ok.id IS NULL THEN 'none' ELSE 'semantic' END, ok.id, ok.score FROM w3 LEFT JOIN ok ON ok.name = w3.name)
  SELECT name, key, tier, id, CAST(floor(score * 1000000) AS BIGINT) AS score FROM a""")  # fmt: skip
_ONE = lambda x: f"CASE WHEN {x} LIKE '%ies' AND length({x}) > 4 THEN left({x}, length({x}) - 3) || 'y' WHEN {x} LIKE '%oes' AND length({x}) > 4 THEN left({x}, length({x}) - 2) WHEN {x} LIKE '%ves' AND length({x}) > 5 THEN left({x}, length({x}) - 1) WHEN {x} LIKE '%ches' OR {x} LIKE '%shes' OR {x} LIKE '%xes' OR {x} LIKE '%zes' OR ({x} LIKE '%ses' AND length({x}) > 5) THEN left({x}, length({x}) - 2) WHEN {x} LIKE '%s' AND {x} NOT LIKE '%ss' AND length({x}) > 3 THEN left({x}, length({x}) - 1) ELSE {x} END"
_MANY = lambda x: f"CASE WHEN {x} LIKE '%y' AND {x} NOT LIKE '%ey' THEN left({x}, length({x}) - 1) || 'ies' WHEN regexp_matches({x}, '(s|sh|ch|x|z)$') THEN {x} || 'es' ELSE {x} || 's' END"
_KEYS = f"""k0 AS (SELECT id, name, lower(trim(name)) AS l FROM listed_foods), k1 AS (SELECT *, trim(split_part(l, ',', 1)) AS p0, trim(regexp_replace(trim(regexp_replace(l, ',?\\s*\\b(?:{LISTED_ENDS})\\b.*$', '')), ',+$', '')) AS sh FROM k0),
  k2 AS (SELECT *, list_filter(list_transform(string_split(sh, ','), lambda p: trim(p)), lambda p: p <> '' AND p NOT IN {_quoted(LISTED_WORDS)}) AS ps FROM k1),
  k3 AS (SELECT *, array_to_string(ps[2:], ' ') AS aft, len(ps) AS np FROM k2),
  r1 AS (SELECT id, name, p0 AS k FROM k3 UNION SELECT id, name, {_ONE('p0')} FROM k3 UNION SELECT id, name, {_MANY('o')} FROM (SELECT *, {_ONE('p0')} AS o FROM k3)
    UNION SELECT id, name, aft || ' ' || ps[1] FROM k3 WHERE np >= 2 UNION SELECT id, name, aft || ' ' || {_ONE('f')} FROM (SELECT *, ps[1] AS f FROM k3) WHERE np >= 2 UNION SELECT id, name, array_to_string(ps, ' ') FROM k3 WHERE length(array_to_string(ps, ' ')) > 3),
  r2 AS (SELECT id, name, aft AS x FROM k3 WHERE length(aft) > 3 UNION SELECT id, name, x FROM (SELECT id, name, unnest(ps[2:]) AS x FROM k3) WHERE length(x) > 3
    UNION SELECT id, name, trim(x) FROM (SELECT id, name, unnest(regexp_extract_all(l, '\\(([^)]+)\\)', 1)) AS x FROM k3) WHERE length(trim(x)) > 2),
  r3 AS (SELECT id, name, {_ONE('x')} AS o FROM (SELECT id, name, p0, unnest(string_split(array_to_string(ps, ' '), ' ')) AS x FROM k3) WHERE length(x) > 3 AND x NOT IN {_quoted(LISTED_WORDS)} AND x <> p0),
  r4 AS (SELECT * FROM r1 UNION SELECT id, name, x FROM r2 UNION SELECT id, name, {_ONE('x')} FROM r2 UNION SELECT id, name, o FROM r3 WHERE length(o) > 3 UNION SELECT id, name, {_MANY('o')} FROM r3 WHERE length(o) > 3),
  r5 AS (SELECT * FROM r4 UNION SELECT id, name, CASE WHEN starts_with(k, 'fresh ') THEN substr(k, 7) ELSE 'fresh ' || k END FROM r4 WHERE starts_with(k, 'fresh ') OR length(k) > 3),
  r6 AS (SELECT * FROM r5 UNION SELECT id, name, CASE k {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in OTHER_NAMES.items())} END FROM r5 WHERE k IN {_quoted(OTHER_NAMES)}),
  keys AS (SELECT DISTINCT * FROM (SELECT id, name, trim(regexp_replace(regexp_replace(k, '\\([^)]*\\)', '', 'g'), '\\s+', ' ', 'g')) AS key FROM r6) WHERE length(key) > 2)"""
add("SET-6_lookup_keys", lambda s, d: with_lookup_keys(view(s, d, "listed_foods")).select("id", "name", F.explode("keys").alias("key")), f"WITH {_KEYS} SELECT id, name, key FROM keys")



def _portion_pairs(s, d) -> DataFrame:
    names, listed = kept(view(s, d, "wanted_names")), kept(view(s, d, "listed_foods").select("id", "name"))
    pairs = alike(names, listed, 0.4).select("name", "id")
    asked = names.select("name", portion_words(F.col("name")).alias("q"))
    foods = listed.select("id", F.lower("name").alias("low"), first_words(F.col("name")).alias("own"))
    return pairs.join(asked, "name").join(foods, "id").select("name", "id", valid_portion(F.col("q"), F.col("own"), F.col("low")).alias("valid"))


_WORDS = lambda e: f"list_filter(regexp_split_to_array({e}, '\\s+'), lambda x: x <> '')"
_ANY = lambda a, xs: f"list_has_any({a}, {xs})"
_CLEAN = "regexp_replace(lower(name), '[,;.()]', ' ', 'g')"
_Q = f"list_distinct(list_filter({_WORDS(_CLEAN)}, lambda x: x NOT IN {_quoted(PLAIN)}))"
_FORMS_OF = "flatten(list_transform(q, lambda w: [w, w || 's', CASE WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END, CASE WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' ELSE w END]))"
_PORTION_OK = f"""list_has_any(f, own) AND NOT ({_ANY('own', DISHES)} AND NOT {_ANY('q', DISHES)}) AND NOT ({_ANY('q', SPICES)} AND NOT {_ANY('q', SWEET_PEPPERS)} AND {_ANY('own', ['pepper', 'peppers'])} AND {_ANY('own', SWEET_PEPPERS)})
  AND NOT ({_ANY('q', SEEDED)} AND {_ANY('own', ['seed', 'seeds'])} AND NOT list_has_any(f, list_filter(own, lambda x: x NOT IN ('seed', 'seeds')))) AND NOT (list_contains(q, 'milk') AND contains(low, 'human'))
  AND NOT (list_contains(q, 'yeast') AND (contains(low, 'extract') OR contains(low, 'spread')) AND NOT {_ANY('q', ['extract', 'spread'])}) AND NOT (list_contains(q, 'baking') AND {_ANY('q', ['soda', 'powder'])} AND contains(low, 'chocolate'))"""
_ASKED = f"a0 AS (SELECT name, {_GRAMS('name')} AS g, {_Q} AS q FROM wanted_names), asked AS (SELECT *, {_FORMS_OF} AS f FROM a0), food AS (SELECT id, {_GRAMS('name')} AS g, lower(name) AS low, {_WORDS('split_part(lower(name), chr(44), 1)')} AS own FROM listed_foods)"
add("JOI-7_portion_validation", _portion_pairs, f"WITH {_ASKED} SELECT a.name, b.id, {_PORTION_OK} AS valid FROM asked a JOIN food b ON {_COSINE} >= 0.4")
_PRIORITY = lambda: _priority_sql.replace("lower(name)", "key").replace("shown", "name")
_INDEX = f"{_KEYS}, ki AS (SELECT key, id, name FROM keys QUALIFY row_number() OVER (PARTITION BY key ORDER BY {_PRIORITY()} DESC, id) = 1)"
add("AGG-62_key_index", lambda s, d: key_index(view(s, d, "listed_foods")), f"WITH {_INDEX} SELECT key, id, name FROM ki")
_BARE = f"NOT IN {_quoted(PORTION_WORDS)}"
_MATCHED = f"""{_INDEX}, {_ASKED}, n0 AS (SELECT name, {_SQL_KEY('name')} AS key FROM wanted_names), n1 AS (SELECT *, string_split(key, ' ') AS ws, list_filter(string_split(key, ' '), lambda w: w {_BARE}) AS bw FROM n0),
  n2 AS (SELECT *, CASE WHEN contains(key, ' or ') THEN trim(split_part(key, ' or ', 1)) ELSE '' END AS alt FROM n1), n3 AS (SELECT *, list_filter(string_split(alt, ' '), lambda w: w {_BARE}) AS aw FROM n2),
  tr AS (SELECT name, list_filter(list_concat([key, array_to_string(bw, ' ')], list_concat(list_filter(list_reverse(CASE WHEN len(bw) > 0 THEN bw ELSE ws END), lambda w: length(w) >= 3), [alt, array_to_string(aw, ' '), aw[len(aw)]])), lambda x: coalesce(x, '') <> '') AS ts FROM n3),
  t1 AS (SELECT name, unnest(range(1, len(ts) + 1)) AS i, unnest(ts) AS t FROM tr), t2 AS (SELECT *, {_ONE('t')} AS o FROM t1),
  t3 AS (SELECT name, i * 3 AS i, t AS key FROM t2 UNION ALL SELECT name, i * 3 + 1, o FROM t2 UNION ALL SELECT name, i * 3 + 2, {_MANY('o')} FROM t2),
  hit AS (SELECT t3.name, ki.id FROM t3 JOIN ki ON ki.key = t3.key QUALIFY row_number() OVER (PARTITION BY t3.name ORDER BY i) = 1),
  near AS (SELECT a.name, a.q, a.f, b.id, b.low, b.own, {_COSINE} AS score FROM asked a JOIN food b ON {_COSINE} >= {PORTION} WHERE a.name NOT IN (SELECT name FROM hit)),
  ten AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS r FROM near QUALIFY r <= 15),
  ok AS (SELECT name, id, score FROM ten WHERE {_PORTION_OK} QUALIFY row_number() OVER (PARTITION BY name ORDER BY r) = 1),
  matched AS (SELECT name, 'exact' AS tier, id, 1.0 AS score FROM hit UNION ALL SELECT n0.name, CASE WHEN ok.id IS NULL THEN 'none' WHEN ok.score >= {SURE} THEN 'sure' ELSE 'judge' END, ok.id, ok.score FROM n0 LEFT JOIN ok ON ok.name = n0.name WHERE n0.name NOT IN (SELECT name FROM hit))"""
_matched = lambda s, d: match_portions(view(s, d, "wanted_names"), key_index(view(s, d, "listed_foods")), view(s, d, "listed_foods"))
add("JOI-6_portion_match", lambda s, d: _matched(s, d).withColumn("score", F.floor(F.col("score") * 1_000_000)), f"WITH {_MATCHED} SELECT name, tier, id, CAST(floor(score * 1000000) AS BIGINT) AS score FROM matched")
def _final(s, d) -> DataFrame:
    keys = key_index(view(s, d, "listed_foods"))
    return final_index(keys, match_portions(view(s, d, "wanted_names"), keys, view(s, d, "listed_foods")))


add("AGG-62_final_index", _final, f"""WITH {_MATCHED}, own AS (SELECT trim(lower(name)) AS key, min(id) AS id FROM matched WHERE id IS NOT NULL AND tier <> 'judge' GROUP BY 1),
  base AS (SELECT key, id FROM ki WHERE key NOT IN (SELECT key FROM own) UNION ALL SELECT key, id FROM own),
  more AS (SELECT CASE WHEN key LIKE '%s' AND key NOT LIKE '%ss' THEN left(key, length(key) - 1) WHEN key NOT LIKE '%s' THEN key || 's' END AS other, key, id FROM base WHERE length(key) > 2)
  SELECT key, id FROM base UNION ALL SELECT other, arg_min(id, key) FROM more WHERE length(other) > 2 AND other NOT IN (SELECT key FROM base) GROUP BY other""")  # fmt: skip

QUERIES, SQL = catalog.queries, catalog.sql
