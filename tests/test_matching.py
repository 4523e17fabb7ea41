"""Golden stems, keys, guards and tiers, and likeness against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from galley.functions import foodwords, text
from galley.operators import matching as m


def test_stems_and_key_words(spark):
    words = {"stock": "broth", "stocks": "stock", "tomatoes": "tomato", "potatoe": "potato", "jelly": "jam", "sausages": "sausage", "berries": "berry", "peppers": "pepper", "glass": "glass", "eggs": "egg"}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", foodwords.word_stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in rows} == words
    cases = {"Fresh green beans, chopped": ["bean"], "2 cloves of garlic": ["garlic"], "Extra-virgin olive oil": ["olive", "oil"], "Raw": [], "vegetable stock": ["vegetable", "broth"]}
    rows = spark.createDataFrame([(w,) for w in cases], "w string").select("w", foodwords.key_words(F.col("w")).alias("k")).collect()
    assert {r.w: r.k for r in rows} == cases


def test_before_an_alternative(spark):
    cases = {"Butter/lard": "Butter", "Ditalini or small shell pasta": "Ditalini", "Ditalini OR pasta": "Ditalini", "Orange": "Orange", " Salt": " Salt", "port/wine or x": "port"}
    rows = spark.createDataFrame([(w,) for w in cases], "w string").select("w", text.before_alternative(F.col("w")).alias("v")).collect()
    assert {r.w: r.v for r in rows} == cases


KEYS = {
    "Bananas, raw": {"banana", "bananas", "fresh banana", "fresh bananas"},
    "Cheese, cheddar": {"cheese", "cheeses", "cheddar cheese", "cheddar", "cheddars", "cheese cheddar", "fresh cheese", "fresh cheeses", "fresh cheddar cheese", "fresh cheddar", "fresh cheddars", "fresh cheese cheddar"},
}
SOME = {
    "Peppers, sweet, red, raw": {"sweet red pepper", "sweet red peppers", "peppers sweet red", "sweet", "pepper"},
    "Nuts, cashew nuts, raw": {"cashew nuts", "cashew", "cashews", "nut"},
    "Coriander (cilantro) leaves, raw": {"cilantro", "fresh cilantro", "coriander", "leave"},
    "Cabbage, chinese (pak-choi), raw": {"pak-choi", "bok choy"},
    "Zucchini, includes skin, raw": {"zucchini", "courgette", "includes skin zucchini"},
    "Fresh peas": {"peas", "fresh peas", "pea"},
    "Tomatoes, red, ripe, raw, year round average": {"tomato", "tomatoes", "red ripe tomatoes", "red ripe tomato", "ripe"},
    "Beets": {"beet", "beetroot"},
    "Broad beans, mature seeds": {"fava beans", "broad bean"},
}


def test_lookup_keys(spark):
    names = [*KEYS, *SOME, "", None, ",,", "ox"]
    got = {r.name: r["keys"] for r in m.with_lookup_keys(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    for name, keys in KEYS.items():
        assert set(got[name]) == keys and len(got[name]) == len(keys)
    for name, keys in SOME.items():
        assert keys <= set(got[name]), name
    assert got[""] == [] and got[",,"] == [] and all(len(k) > 2 for n in names if got[n] for k in got[n])


@pytest.mark.parametrize(
    ("query", "listed", "valid"),
    [
        ("onion", "Onions, raw", True), ("onions", "Onion soup", False), ("onion soup", "Soup, onion", True), ("banana", "Bread, banana", False), ("black pepper", "Peppers, sweet, red", True),
        ("black pepper", "Sweet pepper, red", False), ("sweet pepper", "Sweet peppers, red", True), ("cumin seeds", "Sesame seeds", False), ("cumin seeds", "Cumin seeds", True), ("milk", "Milk, human, mature", False),
        ("yeast", "Yeast extract spread", False), ("yeast extract", "Yeast extract", True), ("baking powder", "Baking powder chocolate", False), ("fresh raw", "Fresh raw", False), ("berries", "Berry, blue", True),
    ],
)
def test_portion_guards(spark, query, listed, valid):
    df = spark.createDataFrame([(query, listed)], "q string, l string").select(m.portion_words(F.col("q")).alias("q"), m.first_words(F.col("l")).alias("own"), F.lower("l").alias("low"))
    assert df.select(m.valid_portion(F.col("q"), F.col("own"), F.col("low"))).first()[0] == valid


@pytest.mark.parametrize("least", [0.4, 0.75, 1.0])
def test_alike_loses_no_pair(spark, least):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcde", k=r.randrange(1, 7)))
    names = sorted({" ".join(word() for _ in range(r.randrange(1, 4))) for _ in range(60)})
    index = [(i, r.choice(names)[: r.randrange(1, 14)]) for i in range(60)] + [(99, ""), (100, None)]
    grams = lambda s: {("  " + s.lower() + " ")[i : i + 3] for i in range(len(s) + 1)}
    want = {(a, i) for a in names for i, b in index if b is not None and len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b))) >= least}
    got = m.alike(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(index, "id long, name string"), least)
    rows = [(x["name"], x["id"]) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and want


def test_ladder_takes_each_name_once(spark):
    index = spark.createDataFrame([(1, "green beans", 31.0), (2, "beans", 330.0), (3, "Chicken broth", 15.0), (4, "blueberry pie", 250.0), (5, "blueberry", 57.0), (6, "Tomato", 900.0)], "id long, name string, kcal double")
    cache = spark.createDataFrame([("known", 77), ("missing", None)], "key string, id long")
    names = ["Known", "missing.", "garlic butter", "Fresh green beans", "chickens broth", "blueberrys pie", "chicken brothe", "tomatoe", "zzz", "", None, "Known"]
    got = {r["name"]: (r.tier, r.id) for r in m.match_ladder(spark.createDataFrame([(n,) for n in names], "name string"), cache, index, 0.6).collect()}
    assert got == {
        "Known": ("cache", 77), "missing.": ("cache", None), "garlic butter": ("composite", None), "Fresh green beans": ("exact", 1), "chickens broth": ("semantic", 3), "chicken brothe": ("none", None),
        "blueberrys pie": ("semantic", 4), "tomatoe": ("none", None), "zzz": ("none", None),
    }


def test_portion_tiers_and_final_index(spark):
    listed = spark.createDataFrame([(1, "Bananas, raw"), (2, "Butternut squash, raw"), (3, "Cheese, cheddar"), (4, "Cheese, gouda")], "id long, name string")
    keys = m.key_index(listed)
    assert {r.key: r.id for r in keys.collect()}["cheese"] in (3, 4)
    names = ["2 ripe bananas", "large Banana", "Butternut squash, rawe", "gouda or brie", "qqq"]
    got = {r["name"]: (r.tier, r.id) for r in m.match_portions(spark.createDataFrame([(n,) for n in names], "name string"), keys.where("key not like '%squash%' and key not like '%butternut%'"), listed).collect()}
    assert got == {"2 ripe bananas": ("exact", 1), "large Banana": ("exact", 1), "Butternut squash, rawe": ("sure", 2), "gouda or brie": ("exact", 4), "qqq": ("none", None)}
    matched = spark.createDataFrame([("big melon", "exact", 9), ("banana", "sure", 8), ("x y", "judge", 7), ("none", "none", None)], "name string, tier string, id long")
    final = {r.key: r.id for r in m.final_index(keys, matched).collect()}
    assert (final["big melon"], final["big melons"], final["banana"], final["bananas"]) == (9, 9, 8, 1) and "x y" not in final and len(final) == m.final_index(keys, matched).count()
