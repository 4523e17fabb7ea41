"""Recipes held against what else is known of them: the language that names are in, and a second food index.

The audit of languages reads a recipe's ingredients as one array: no join, no shuffle. The check of nutrition looks
each distinct name up once, by phrases, and sums whole thousandths, so that the order of rows does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import text
from galley.operators.kitchen import _quoted
from galley.operators.nutrition import PROFILES_SQL, ingredient_details, profile_sums, profiles_of_sums
from galley.plans.adapters import view, with_views
from galley.plans.catalog import Catalog

catalog = Catalog()

# Words and phrases by which a name is taken for French or English; those with an accent tell by that.
FRENCH = ["huile", "pois", "chiches", "beurre", "ail", "oignon", "poivre", "sel", "poivron", "poivrons", "haricots", "lentilles", "cumin moulu", "moulu", "moulue", "frais",
    "champignons", "champignon", "thym", "romarin", "persil", "menthe", "coriandre", "basilic", "amandes", "noix", "noisettes", "vin blanc", "vin rouge", "bouillon", "volaille", "viande",
    "poisson", "concombre", "concombres", "courgette", "courgettes", "aubergine", "aubergines", "tomate", "tomates", "carotte", "carottes"]
FRENCH_PARTS = ["d'olive", "d'ail", "de tomate", "l'ail", "l'oignon", "l'huile"]
ENGLISH = ["olive oil", "chickpeas", "cumin", "chicken", "garlic", "onion", "pepper", "salt", "butter", "cream", "flour", "sugar", "vinegar", "vegetable oil", "canola oil", "soy sauce"]
ENGLISH_WITHOUT_ACCENT = ["olive"]
ACCENT = "[àâäéèêëïîôùûüç]"
# What is left out of a check, and by how much a macro has to differ, in its own unit.
LEFT_OUT = ["salt", "table salt", "sea salt", "fleur de sel", "coarse salt", "black pepper", "white pepper", "pepper", "peppercorns", "water", "ice", "ice water", "cold water", "hot water",
    "baking soda", "baking powder", "cinnamon", "nutmeg", "paprika", "cumin", "turmeric", "cayenne pepper", "chili powder", "curry powder", "cloves", "allspice", "cardamom", "star anise",
    "oregano", "thyme", "rosemary", "bay leaf", "basil", "fresh basil", "parsley", "fresh parsley", "cilantro", "fresh cilantro", "mint", "fresh mint", "dill", "fresh dill", "chives",
    "fresh chives", "tarragon", "vanilla extract", "vanilla paste", "vanilla bean", "food coloring", "gelatin"]
LEAST = {"kcal": 100, "protein": 10, "fat": 8, "carbs": 15, "fiber": 5}
SHOWN_AS = {"kcal": "calories"}


# --- languages ---
def _any_word(words: list[str]) -> str:
    """A pattern of whole words, whatever script stands beside them; the same in both engines."""
    return rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(words)})($|[^\p{{L}}\p{{N}}_])"


_FRENCH = f"{_any_word(FRENCH)}|{'|'.join(FRENCH_PARTS)}|{ACCENT}|[\\p{{L}}\\p{{N}}_]\\s+d'[\\p{{L}}\\p{{N}}_]"
_ENGLISH, _ENGLISH_PLAIN = _any_word(ENGLISH), _any_word(ENGLISH_WITHOUT_ACCENT)


def likely_french(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.coalesce((F.length(low) > 1) & low.rlike(_FRENCH), F.lit(False))


def likely_english(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.coalesce((F.length(low) > 1) & (low.rlike(_ENGLISH) | (~low.rlike(ACCENT) & low.rlike(_ENGLISH_PLAIN))), F.lit(False))


def language_report(docs: DataFrame, shown: int = 5) -> DataFrame:
    """What languages the names of each recipe of ``docs`` (slug, language, ingredients: name and name_en) are in.

    ``mixed_count`` counts names that look French beside another English one. Empty and null names say nothing.
    """
    names = F.transform(F.coalesce("ingredients", F.array().cast(dict(docs.dtypes)["ingredients"])), lambda x: F.struct(
        x["name"].alias("name"), likely_french(x["name"]).alias("fr"), likely_english(x["name"]).alias("en"),
        F.coalesce((x["name_en"] != "") & (x["name_en"] != x["name"]), F.lit(False)).alias("other")))
    rows = docs.select("slug", F.coalesce(F.lower("language") == "en", F.lit(False)).alias("is_english_source"), names.alias("names"))
    of = lambda test: F.filter("names", test)
    first = lambda test: F.array_join(F.slice(F.transform(of(test), lambda x: x["name"]), 1, shown), " | ")
    french, english = lambda x: x["fr"], lambda x: x["en"]
    rows = rows.select(
        "slug", "is_english_source", F.size("names").alias("ingredient_count"), F.size(of(french)).alias("names_fr_count"), F.size(of(english)).alias("names_en_count"),
        first(french).alias("names_fr"), first(english).alias("names_en"), F.size(of(lambda x: x["fr"] & x["other"])).alias("mixed_count"),
    )
    return rows.withColumns({"has_mixed": F.expr("names_fr_count > 0 and names_en_count > 0"), "has_fr_in_en_source": F.expr("is_english_source and names_fr_count > 0")})


def language_summary(report: DataFrame) -> DataFrame:
    """One row: recipes, those with names of both languages, those of an English source with French names, and their shares in percent (null without recipes)."""
    share = lambda c: F.floor(F.count_if(c) * 1000.0 / F.nullif(F.count("*"), F.lit(0)) + 0.5) / 10.0
    return report.agg(F.count("*").alias("total"), F.count_if("has_mixed").alias("mixed"), share("has_mixed").alias("mixed_pct"),
        F.count_if("has_fr_in_en_source").alias("fr_in_en"), share("has_fr_in_en_source").alias("fr_in_en_pct"))


# --- nutrition against a second index ---
def by_phrases(names: DataFrame, reference: DataFrame) -> DataFrame:
    """``names`` (key) with the row of ``reference`` (found, ...) for the longest run of words that it lists, the leftmost of equals; keys without one are left out.

    Runs of a key are joined by equality, so the work grows with the words of distinct names.
    """
    words = F.filter(F.split("key", r"\s+"), lambda x: x != "")
    starts = F.sequence(F.lit(1), F.size("words"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i, F.size("words")), lambda j: F.struct((i - j).alias("order"), i.alias("start"), F.array_join(F.slice("words", i, j - i + 1), " ").alias("found")))))
    rows = names.select("key").distinct().withColumn("words", words).where("size(words) > 0").select("key", F.inline(runs))
    listed = rows.join(reference, "found")
    rest = F.struct(*[c for c in reference.columns if c != "found"])
    return listed.groupBy("key").agg(F.min_by(rest, F.struct("order", "start", "found")).alias("best")).select("key", "best.*")


def said_key(name: Column) -> Column:
    """A name as it is looked up, or null where it says nothing: empty or in LEFT_OUT."""
    key = F.lower(F.trim(name))
    return F.when((key != "") & ~key.isin(LEFT_OUT), key)


def looked_up(names: DataFrame, reference: DataFrame) -> DataFrame:
    """(key, hit, found_ macros) of the names that ``reference`` lists."""
    return by_phrases(names, reference).select("key", F.lit(True).alias("hit"), *[F.col(n).alias(f"found_{n}") for n in LEAST])


def reference_sums(lines: DataFrame, found: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``lines`` (name, grams) with what was looked up for them, and the sums to add up over the lines of a recipe."""
    rows = lines.withColumn("key", said_key(F.col("name"))).join(found, "key", "left")
    weighed = F.coalesce(F.col("hit") & (F.col("grams") > 0), F.lit(False))
    part = lambda n: F.floor(F.coalesce(f"found_{n}", F.lit(0.0)) * F.col("grams") / 100.0 * 1000 + 0.5)
    counts = [F.count("key").alias("ref_named"), F.count_if("hit").alias("ref_matched"), F.count_if(weighed).alias("ref_weighed")]
    return rows, counts + [F.sum(F.when(weighed, part(n))).alias(f"sum_{n}") for n in LEAST]


def cross_check(stored: DataFrame, lines: DataFrame, reference: DataFrame) -> DataFrame:
    """Verdict on each row of ``stored`` against macros summed anew.

    stored: rid, servings, the macros of LEAST per serving, confidence, resolved, total; all null: no nutrition, verdict error.
    lines: rid, name (English), grams. reference: found (a lower-case name, once), the macros for 100 g.
    A macro that differs by over half (30 %) and by more than LEAST is an error (a warning); fewer than nine in ten
    ingredients weighed is inconclusive. Names that are empty or in LEFT_OUT say nothing.
    """
    names = lines.select(said_key(F.col("name")).alias("key")).where("key is not null")
    rows, sums = reference_sums(lines.select("rid", "name", "grams"), looked_up(names, reference))
    return judged(stored.join(rows.groupBy("rid").agg(*sums), "rid", "left"))


def judged(out: DataFrame) -> DataFrame:
    """The verdicts of cross_check() on rows of ``stored`` with their sums."""
    out = out.withColumns({n: F.coalesce(f"ref_{n}", F.lit(0)) for n in ("named", "matched", "weighed")})
    tenths = {f"ref_{n}": F.floor(F.coalesce(f"sum_{n}", F.lit(0)) / 100.0 / F.coalesce(F.nullif("servings", F.lit(0)), F.lit(1)) + 0.5) for n in LEAST}
    out = out.withColumns(tenths | {f"own_{n}": F.floor(F.coalesce(n, F.lit(0.0)) * 10 + 0.5) for n in LEAST})
    shown = lambda t: F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))
    issue = lambda when, severity, *parts: F.when(when, F.struct(F.lit(severity).alias("severity"), F.concat(*parts).alias("detail")))
    found = []
    for n, least in LEAST.items():
        own, ref = F.col(f"own_{n}"), F.col(f"ref_{n}")
        diff = F.abs(own - ref)
        off = F.when(ref == 0, F.when(own == 0, 0).otherwise(1000)).otherwise(F.floor(diff * 1000.0 / F.nullif(ref, F.lit(0)) + 0.5))
        told = [F.lit(f"{SHOWN_AS.get(n, n)}: "), shown(own), F.lit(" vs ref "), shown(ref), F.lit(" ("), shown(off), F.lit("% deviation, diff="), shown(diff), F.lit(")")]
        far = diff > least * 10
        found.append(F.coalesce(issue(far & (off > 500), "error", *told), issue(far & (off > 300), "warning", *told)))
    found.append(issue(F.col("own_kcal") > 20000, "warning", F.lit("Very high calories per serving: "), shown(F.col("own_kcal")), F.lit(" kcal")))
    few = (F.col("confidence") == "high") & (F.col("total") > 0) & (F.col("resolved") * 2 < F.col("total"))
    found.append(issue(few, "warning", F.lit("Confidence is 'high' but only "), F.col("resolved").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" ingredients resolved")))
    unsure = (F.col("named") > 0) & (F.col("weighed") * 10 < F.col("named") * 9)
    share = F.bround(F.col("weighed") * 100.0 / F.nullif("named", F.lit(0)), 0).cast("int").cast("string")
    found.append(issue(unsure, "warning", F.lit("Only "), F.col("weighed").cast("string"), F.lit("/"), F.col("named").cast("string"), F.lit(" ingredients resolved in reference ("), share, F.lit("%). Need >= 90% for reliable comparison.")))
    missing = F.col("kcal").isNull()
    out = out.withColumn("issues", F.when(missing, F.array().cast("array<struct<severity:string,detail:string>>")).otherwise(F.filter(F.array(*found), lambda x: x.isNotNull())))
    some = lambda severity: F.exists("issues", lambda x: x["severity"] == severity)
    verdict = F.when(missing, "error").when(unsure, "inconclusive").when(some("error"), "fail").when(some("warning"), "warning").otherwise("pass")
    return out.select("rid", verdict.alias("verdict"), "matched", "weighed", "named", *[(F.col(f"ref_{n}") / 10.0).alias(f"ref_{n}") for n in LEAST], F.transform("issues", lambda x: x["detail"]).alias("issues"))


def verdicts(checked: DataFrame) -> DataFrame:
    """(verdict, n, n_issues)."""
    return checked.groupBy("verdict").agg(F.count("*").alias("n"), F.sum(F.size("issues")).alias("n_issues"))


# --- queries ---
def _docs(s, d) -> DataFrame:
    told = view(s, d, "told_ingredients").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "name_en"))).alias("ingredients"))
    return view(s, d, "told_recipes").join(told, "rid", "left").select("slug", "language", "ingredients")


_LOW = "lower(trim(name))"
_REPORT = f"""judged AS (SELECT *, coalesce(length({_LOW}) > 1 AND regexp_matches({_LOW}, '{_FRENCH.replace("'", "''")}'), false) AS fr,
    coalesce(length({_LOW}) > 1 AND (regexp_matches({_LOW}, '{_ENGLISH}') OR (NOT regexp_matches({_LOW}, '{ACCENT}') AND regexp_matches({_LOW}, '{_ENGLISH_PLAIN}'))), false) AS en FROM told_ingredients),
  report AS (SELECT slug, coalesce(lower(any_value(language)) = 'en', false) AS is_english_source, count(j.rid) AS ingredient_count, count(*) FILTER (WHERE fr) AS names_fr_count, count(*) FILTER (WHERE en) AS names_en_count,
    coalesce(array_to_string((list(name ORDER BY pos) FILTER (WHERE fr))[1:5], ' | '), '') AS names_fr, coalesce(array_to_string((list(name ORDER BY pos) FILTER (WHERE en))[1:5], ' | '), '') AS names_en,
    count(*) FILTER (WHERE fr AND name_en <> '' AND name_en <> name) AS mixed_count, names_fr_count > 0 AND names_en_count > 0 AS has_mixed, is_english_source AND names_fr_count > 0 AS has_fr_in_en_source
    FROM told_recipes r LEFT JOIN judged j USING (rid) GROUP BY slug)"""
catalog.add("AGG-26_language_report", lambda s, d: language_report(_docs(s, d)), with_views(f"WITH {_REPORT} SELECT * FROM report"))
_PCT = lambda c: f"floor(count(*) FILTER (WHERE {c}) * 1000.0e0 / nullif(count(*), 0) + 0.5) / 10.0e0"
catalog.add("AGG-27_language_summary", lambda s, d: language_summary(language_report(_docs(s, d))), with_views(
    f"WITH {_REPORT} SELECT count(*) AS total, count(*) FILTER (WHERE has_mixed) AS mixed, {_PCT('has_mixed')} AS mixed_pct, count(*) FILTER (WHERE has_fr_in_en_source) AS fr_in_en, {_PCT('has_fr_in_en_source')} AS fr_in_en_pct FROM report"))


def _checked(s, d) -> DataFrame:
    recipes, ingredients, foods = view(s, d, "recipes"), view(s, d, "ingredients"), view(s, d, "foods")
    told = F.when((F.col("pos") % 3 == 0) & (F.col("name") != ""), F.concat(F.lit("Fresh "), "name", F.lit(" chopped"))).otherwise(F.col("name"))
    # the second index: the last food of each name, where the profile takes the first
    reference = foods.groupBy(F.lower("name").alias("found")).agg(*[F.max_by(n, "id").alias(n) for n in LEAST])
    # one pass over the details adds up both: what the profile is of, and what the second index gives; the view has some
    # hundred names, which are sent to every task, as no task could hold all lines of a name
    names = ingredients.select(told.alias("name")).distinct().select(said_key(F.col("name")).alias("key")).where("key is not null")
    rows, sums = reference_sums(ingredient_details(ingredients, foods, recipes).withColumn("name", told).drop("key"), F.broadcast(looked_up(names, reference)))
    both = profiles_of_sums(rows.groupBy("rid").agg(*profile_sums(), *sums), recipes)
    return judged(recipes.select("rid", "servings").join(both.drop("slug", "servings", "matched"), "rid", "left"))


_SHOWN = lambda t: f"(CAST({t} AS BIGINT) // 10) || '.' || (CAST({t} AS BIGINT) % 10)"
_OFF = lambda n: f"(CASE WHEN ref_{n} = 0 THEN CASE WHEN own_{n} = 0 THEN 0 ELSE 1000 END ELSE floor(abs(own_{n} - ref_{n}) * 1000.0e0 / ref_{n} + 0.5) END)"
_FAR = lambda n, off: f"(abs(own_{n} - ref_{n}) > {LEAST[n] * 10} AND {_OFF(n)} > {off})"
_CHECKED = f"""
  told AS (SELECT rid, grams, lower(trim(CASE WHEN pos % 3 = 0 AND name <> '' THEN 'Fresh ' || name || ' chopped' ELSE name END)) AS key FROM details),
  kept AS (SELECT * FROM told WHERE key <> '' AND key NOT IN {_quoted(LEFT_OUT)}),
  second AS (SELECT lower(name) AS found, {", ".join(f"max_by({n}, id) AS {n}" for n in LEAST)} FROM foods GROUP BY 1),
  ks AS (SELECT DISTINCT key, string_split(key, ' ') AS w FROM kept),
  froms AS (SELECT key, w, unnest(range(1, len(w) + 1)) AS i FROM ks), runs AS (SELECT key, w, i, unnest(range(i, len(w) + 1)) AS j FROM froms),
  named AS (SELECT key, array_to_string(w[i:j], ' ') AS found, row_number() OVER (PARTITION BY key ORDER BY i - j, i) AS k FROM runs WHERE array_to_string(w[i:j], ' ') IN (SELECT found FROM second)),
  hits AS (SELECT kept.*, n.found IS NOT NULL AS hit, n.found IS NOT NULL AND coalesce(grams, 0) > 0 AS ok, {", ".join("second." + n for n in LEAST)} FROM kept LEFT JOIN (SELECT * FROM named WHERE k = 1) n USING (key) LEFT JOIN second ON second.found = n.found),
  added AS (SELECT rid, count(*) AS named, count(*) FILTER (WHERE hit) AS matched, count(*) FILTER (WHERE ok) AS weighed, {", ".join(f"sum(floor(coalesce({n}, 0) * grams / 100.0e0 * 1000 + 0.5)) FILTER (WHERE ok) AS sum_{n}" for n in LEAST)} FROM hits GROUP BY rid),
  held2 AS (SELECT r.rid, p.kcal, p.confidence, p.resolved, p.total, coalesce(a.named, 0) AS named, coalesce(a.matched, 0) AS matched, coalesce(a.weighed, 0) AS weighed,
    {", ".join(f"floor(coalesce(sum_{n}, 0) / 100.0e0 / r.servings + 0.5) AS ref_{n}, floor(coalesce(p.{n}, 0) * 10 + 0.5) AS own_{n}" for n in LEAST)} FROM recipes r LEFT JOIN profiles p USING (rid) LEFT JOIN added a ON a.rid = r.rid),
  said AS (SELECT *, {" OR ".join(_FAR(n, 500) for n in LEAST)} AS bad, named > 0 AND weighed * 10 < named * 9 AS unsure, CASE WHEN kcal IS NULL THEN [] ELSE list_filter([
    {", ".join(f"CASE WHEN {_FAR(n, 300)} THEN '{SHOWN_AS.get(n, n)}: ' || {_SHOWN(f'own_{n}')} || ' vs ref ' || {_SHOWN(f'ref_{n}')} || ' (' || {_SHOWN(_OFF(n))} || '% deviation, diff=' || {_SHOWN(f'abs(own_{n} - ref_{n})')} || ')' END" for n in LEAST)},
    CASE WHEN own_kcal > 20000 THEN 'Very high calories per serving: ' || {_SHOWN('own_kcal')} || ' kcal' END,
    CASE WHEN confidence = 'high' AND total > 0 AND resolved * 2 < total THEN 'Confidence is ''high'' but only ' || resolved || '/' || total || ' ingredients resolved' END,
    CASE WHEN named > 0 AND weighed * 10 < named * 9 THEN 'Only ' || weighed || '/' || named || ' ingredients resolved in reference (' || CAST(round_even(weighed * 100.0e0 / named, 0) AS INTEGER) || '%). Need >= 90% for reliable comparison.' END], lambda x: x IS NOT NULL) END AS issues FROM held2),
  checked AS (SELECT rid, CASE WHEN kcal IS NULL THEN 'error' WHEN unsure THEN 'inconclusive' WHEN bad THEN 'fail' WHEN len(issues) > 0 THEN 'warning' ELSE 'pass' END AS verdict, matched, weighed, named,
    {", ".join(f"ref_{n} / 10.0e0 AS ref_{n}" for n in LEAST)}, issues FROM said)"""
catalog.add("AGG-28_cross_check", lambda s, d: _checked(s, d).withColumn("issues", F.array_join("issues", "; ")), with_views(f"{PROFILES_SQL}, {_CHECKED} SELECT * REPLACE (coalesce(array_to_string(issues, '; '), '') AS issues) FROM checked"))
catalog.add("AGG-31_verdicts", lambda s, d: verdicts(_checked(s, d)), with_views(f"{PROFILES_SQL}, {_CHECKED} SELECT verdict, count(*) AS n, CAST(sum(len(issues)) AS BIGINT) AS n_issues FROM checked GROUP BY verdict"))


# --- listed names ---
_LISTED = r"""SELECT id, CASE id % 6 WHEN 0 THEN concat(name, ', , "Kome ', CAST(id % 9 AS VARCHAR(9)), '", (raw), [', source, ']') WHEN 1 THEN concat(', ', name, '*, (', source, ' food), ') WHEN 2 THEN concat('［x］', upper(name), ' (ab) "no"')
  WHEN 3 THEN concat(name, ', (a remark of more than thirty letters in all)') WHEN 4 THEN concat('"', name, '"') ELSE name END AS raw FROM foods"""


def _listed(s, d) -> DataFrame:
    name, others = text.listed_name(F.col("raw"))
    raw = s.sql("SELECT * FROM (" + _LISTED.replace("FROM foods", "FROM {foods}") + ")", foods=view(s, d, "foods"))
    return raw.select("id", name.alias("name"), F.array_join(others, " | ").alias("others"))


catalog.add("STR-19_listed_names", _listed, with_views(rf"""WITH l AS ({_LISTED}), p AS (SELECT id, replace(regexp_replace(raw, '[\[［][^\]］]*[\]］]', '', 'g'), chr(10), ' ') AS t FROM l),
  c AS (SELECT id, t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '"[^"]*"', '', 'g'), '\([^)]*\)', '', 'g'), '\s*,\s*,', ',', 'g'), ',\s*$', ''), '^\s*,\s*', ''), '\s+', ' ', 'g') AS n FROM p)
  SELECT id, replace(lower(trim(n)), '*', '') AS name, array_to_string(list_filter(list_transform(list_concat(regexp_extract_all(t, '"([^"]+)"', 1), regexp_extract_all(t, '\(([^)]{{3,30}})\)', 1)), lambda x: lower(trim(x))), lambda x: length(x) > 2), ' | ') AS others FROM c"""))

QUERIES, SQL = catalog.queries, catalog.sql
