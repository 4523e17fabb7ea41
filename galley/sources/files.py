"""Readers of recipe files: JSON documents, CSV tables, texts and listings, by any path that Spark can open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECIPE = "struct<slug:string,title:string,servings:string,total_minutes:int,source_url:string>"
RECIPE_FILES = "*.recipe.json"


def _whole(spark: SparkSession, folder: str, names: str) -> DataFrame:
    return spark.read.text(folder, wholetext=True, pathGlobFilter=names, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))


def recipes(spark: SparkSession, folder: str, schema: str = RECIPE, names: str = RECIPE_FILES) -> DataFrame:
    """One row per JSON file that is an object with a slug; broken files are left out."""
    return _whole(spark, folder, names).withColumn("r", F.from_json("doc", schema)).where(F.col("r.slug").isNotNull()).select("path", "r.*")


def bad_files(spark: SparkSession, folder: str, schema: str = RECIPE, names: str = RECIPE_FILES) -> DataFrame:
    """(path) of the files that recipes() leaves out."""
    return _whole(spark, folder, names).where(F.from_json("doc", schema)["slug"].isNull()).select("path")


def strict_recipes(spark: SparkSession, folder: str, schema: str = RECIPE, names: str = RECIPE_FILES) -> DataFrame:
    """As recipes(), ordered by path; a file that is not JSON fails the query."""
    return _whole(spark, folder, names).withColumn("r", F.from_json("doc", schema, {"mode": "FAILFAST"})).select("path", "r.*").orderBy("path")


def listing(spark: SparkSession, folder: str, names: str = "*") -> DataFrame:
    """(path, bytes, modified) of the files; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, action) of what two listings differ in: new, changed (modified later) or drop."""
    rows = now.select("path", F.col("modified").alias("now")).join(before.select("path", F.col("modified").alias("old")), "path", "full")
    action = F.when(F.col("now").isNull(), "drop").when(F.col("old").isNull(), "new").when(F.col("now") > F.col("old"), "changed")
    return rows.select("path", action.alias("action")).where("action is not null")


def text_recipes(spark: SparkSession, folder: str, names: str = "*.txt") -> DataFrame:
    """(path, title, body): the first line that is not blank, and the whole text; blank files are left out."""
    rows = _whole(spark, folder, names).withColumn("body", _stripped(F.regexp_replace("doc", "\r\n?", "\n")))
    lines = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")
    return rows.where(F.size(lines) > 0).select("path", F.trim(lines[0]).alias("title"), "body")


def portions(spark: SparkSession, foods_csv: str, portions_csv: str) -> DataFrame:
    """(id, name, unit, grams) of the portions of listed foods: grams of one, from an amount and its weight; bad rows are left out."""
    foods = spark.read.csv(foods_csv, header=True, schema="id long, name string")
    rows = spark.read.csv(portions_csv, header=True, schema="food_id long, amount double, unit string, grams double")
    good = rows.where("amount > 0 and grams > 0 and trim(unit) <> ''").select(F.col("food_id").alias("id"), F.lower(F.trim("unit")).alias("unit"), (F.col("grams") / F.col("amount")).alias("grams"))
    return foods.where("id is not null and name is not null").join(good, "id")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


_LD_JSON = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""


def json_ld_recipe(html: Column) -> Column:
    """JSON text of the first schema.org Recipe of a page: an object, one of a list, or one of an ``@graph``; null if none."""
    listed = lambda x: F.from_json(x, "array<string>")
    graph = lambda x: F.get_json_object(x, "$.@graph")
    blocks = F.transform(F.regexp_extract_all(html, F.lit(_LD_JSON), F.lit(1)), _stripped)
    items = lambda x: F.coalesce(F.when(x.startswith("["), listed(x)).when(graph(x).isNotNull(), listed(graph(x))).otherwise(F.array(x)), F.array().cast("array<string>"))
    kind = lambda x: F.get_json_object(x, "$.@type")
    is_recipe = lambda x: F.coalesce((kind(x) == "Recipe") | F.array_contains(listed(kind(x)), "Recipe"), F.lit(False))
    return F.get(F.filter(F.flatten(F.transform(blocks, items)), is_recipe), F.lit(0))
