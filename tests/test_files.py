"""Readers of files, stored versions, segments of texts: against written files and plain Python."""

import json
import re

import pytest
from galley.functions import text
from galley.functions.segments import glossary_terms, segments
from galley.functions.units import text_quantity
from galley.sinks import store
from galley.sources import files
from pyspark.sql import functions as F


def test_recipe_files(spark, tmp_path):
    good = {"slug": "a", "title": "Été", "servings": "4", "total_minutes": 5, "source_url": None}
    (tmp_path / "b.recipe.json").write_text(json.dumps({**good, "slug": "b"}, indent=2))
    (tmp_path / "a.recipe.json").write_text(json.dumps(good))
    (tmp_path / "other.json").write_text("{}")
    assert [r.slug for r in files.strict_recipes(spark, str(tmp_path)).collect()] == ["a", "b"]
    (tmp_path / "c.recipe.json").write_text("{broken")
    (tmp_path / "d.recipe.json").write_text("")
    assert {r.slug for r in files.recipes(spark, str(tmp_path)).collect()} == {"a", "b"}
    assert {r.path.rsplit("/", 1)[1] for r in files.bad_files(spark, str(tmp_path)).collect()} >= {"c.recipe.json"}
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        files.strict_recipes(spark, str(tmp_path)).collect()
    before = files.listing(spark, str(tmp_path), "*.recipe.json")
    rows = before.collect()
    assert {r.path.rsplit("/", 1)[1]: r.bytes for r in rows}["c.recipe.json"] == 7
    old = spark.createDataFrame([(r.path, r.bytes, r.modified) for r in rows if not r.path.endswith("a.recipe.json")] + [("gone", 1, rows[0].modified)], before.schema)
    assert {(r.path.rsplit("/", 1)[-1], r.action) for r in files.changed(before, old).collect()} == {("a.recipe.json", "new"), ("gone", "drop")}


def test_text_recipes_and_portions(spark, tmp_path):
    (tmp_path / "x.txt").write_text("\r\n  Soup \r\nwater\r\n")
    (tmp_path / "empty.txt").write_text(" \n")
    assert [(r.title, r.body) for r in files.text_recipes(spark, str(tmp_path)).collect()] == [("Soup", "Soup \nwater")]
    (tmp_path / "f.csv").write_text('id,name\n1,"oil, olive"\n2,salt\n,x\n')
    (tmp_path / "p.csv").write_text("food_id,amount,unit,grams\n1,2, Cup ,432\n1,0,cup,5\n2,1,,6\n9,1,cup,1\n")
    got = files.portions(spark, f"{tmp_path}/f.csv", f"{tmp_path}/p.csv").collect()
    assert [(r.id, r.name, r.unit, r.grams) for r in got] == [(1, "oil, olive", "cup", 216.0)]


@pytest.mark.parametrize(
    ("doc", "name"),
    [
        ('{"@type": "Recipe", "name": "a"}', "a"), ('[{"@type": "Thing"}, {"@type": "Recipe", "name": "b"}]', "b"), ('{"@graph": [{"@type": "WebPage"}, {"@type": "Recipe", "name": "c"}]}', "c"),
        ('{"@type": ["Recipe", "Article"], "name": "d"}', "d"), ('{"@type": "Article"}', None), ("{broken", None), ("", None),
    ],
)
def test_json_ld(spark, doc, name):
    html = f"<p>x</p><script>1</script>\n<script type='application/ld+json'>\n{doc}\n</script>"
    got = spark.createDataFrame([(html,)], "html string").select(F.get_json_object(files.json_ld_recipe(F.col("html")), "$.name").alias("n"))
    assert got.first().n == name


def test_store(spark, tmp_path):
    folder = f"{tmp_path}/recipes"
    rows = lambda df: {(r.k, r.v) for r in df.collect()}
    frame = lambda x: spark.createDataFrame(x, "k string, v int")
    with pytest.raises(FileNotFoundError):
        store.current(spark, folder)
    store.save(frame([("a", 1), ("b", 2)]), folder)
    assert rows(store.upsert(spark, folder, frame([("b", 3), ("c", 4), ("c", 4)]), "k")) == {("a", 1), ("b", 3), ("c", 4)}
    assert rows(store.delete(spark, folder, frame([("a", 0)]), "k")) == {("b", 3), ("c", 4)}
    changed = store.rewrite(spark, folder, lambda r: r.withColumn("w", F.col("v") * 2), "k = 'c'")
    assert {(r.k, r.v, r.w) for r in changed.collect()} == {("b", 3, None), ("c", 4, 8)}
    # a version that was never committed is not seen
    changed.write.parquet(f"{folder}/v000009")
    (tmp_path / "recipes/v000009/_SUCCESS").unlink()
    assert len(store.versions(spark, folder)) == 4
    store.vacuum(spark, folder)
    assert len(store.versions(spark, folder)) == 1
    assert store.delete_all(spark, folder).count() == 0


def test_two_writers_lose_no_row(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    folder, both = f"{tmp_path}/table", Barrier(2)
    store.save(spark.createDataFrame([(0, 0)], "k int, v int"), folder)

    def write(me):
        waits = [True]  # both read the same version the first time

        def change(old):
            if waits:
                waits.pop()
                both.wait(60)
            return old.unionByName(spark.createDataFrame([(100 * me + len(store.versions(spark, folder)), me)], "k int, v int"))

        for _ in range(3):
            store.update(spark, folder, change)
            waits[:] = [True]
        return me

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(write, (1, 2))) == [1, 2]
    got = [r.v for r in store.current(spark, folder).collect()]
    assert sorted(got) == [0, 1, 1, 1, 2, 2, 2] and len(store.versions(spark, folder)) == 7
    # what lost a race is gone, and no draft of a version is left
    left = [p.name for p in (tmp_path / "table").iterdir()]
    assert sum(n.startswith("rows-") for n in left) == 7 and all(p.name.lstrip(".").startswith("v") for p in (tmp_path / "table/_versions").iterdir() if not p.name.endswith(".crc"))


def test_a_taken_number_is_not_committed(spark, tmp_path):
    folder = f"{tmp_path}/table"
    store.save(spark.createDataFrame([(1,)], "k int"), folder)
    assert not store._commit(spark, folder, 1, "rows-other") and store.current(spark, folder).count() == 1


def plain_segments(t, groups):
    letter = "[a-zA-ZÀ-ɏ0-9_]"
    parts = [(t, "plain")]
    for kind, terms in groups:
        for term in sorted(set(terms), key=lambda x: (-len(x), x)):
            out = []
            for s, k in parts:
                if k != "plain":
                    out.append((s, k))
                    continue
                for x in re.split(f"(?i)(?<!{letter})({re.escape(term)})(?!{letter})", s):
                    out.append((x, kind if x.lower() == term.lower() else "plain"))
            parts = out
    return [(s, k) for s, k in parts if s]


def test_segments(spark):
    groups = [("ingredient", ["sauté pan", "oil", "a.b"]), ("glossary", ["sauté", "pan", "min", "Flambé"])]
    texts = ["Heat the Sauté pan, then sauté; oil oil.", "flambés FLAMBÉ à", "", "a.b aXb axb", "pan-pan5 min_ min", "\\E (oil)"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", segments(F.col("t"), *groups).alias("s")).collect()
    assert {r.i: [(x.text, x.kind) for x in r.s] for r in got} == {i: plain_segments(t, groups) for i, t in enumerate(texts)}
    loc = "map<string,struct<term:string,aliases:array<string>>>"
    g = spark.createDataFrame([(1, "Sear", ["brown"], None), (2, "Dice", None, {"fr": ("Couper", ["x", "Émincer"])})], f"entry int, term string, aliases array<string>, localized {loc}")
    assert [(r.text, r.entry) for r in glossary_terms(g, "fr").collect()] == [("émincer", 2), ("couper", 2), ("brown", 1), ("sear", 1)]


def test_terms_are_marked_in_one_pass(spark):
    words = ["sauté", "sauté pan", "min", "flambé"]
    one = str(segments(F.col("t"), ("glossary", words))._jc.toString())
    assert one.count("regexp_replace") == 2  # one for all terms, one to deal the text
    # terms that can overlap, or stand side by side, are marked the longest first
    groups = [("glossary", ["red wine", "wine sauce", "abcd", "-x"])]
    texts = ["a red wine sauce", "abcd-x", "abcd -x", "red wine", "wine sauce, Red Wine"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", segments(F.col("t"), *groups).alias("s")).collect()
    assert {r.i: [(x.text, x.kind) for x in r.s] for r in got} == {
        0: [("a red ", "plain"), ("wine sauce", "glossary")], 1: [("abcd", "glossary"), ("-x", "glossary")], 2: [("abcd", "glossary"), (" ", "plain"), ("-x", "glossary")],
        3: [("red wine", "glossary")], 4: [("wine sauce", "glossary"), (", ", "plain"), ("Red Wine", "glossary")],
    }
    long = spark.createDataFrame([("the sauté pan " * 20000,)], "t string").select(F.size(segments(F.col("t"), ("glossary", words))).alias("n")).first()
    assert long.n == 40001


def test_words_and_quantities(spark):
    df = spark.createDataFrame([("berries",), ("potatoes",), ("dishes",), ("olives",), ("glass",), ("pies",), ("boxes",), ("es",)], "w string")
    got = {r.w: (r.a, r.b, r.c) for r in df.select("w", text.stem(F.col("w")).alias("a"), text.portion_singular(F.col("w")).alias("b"), text.lookup_stem(F.col("w")).alias("c")).collect()}
    assert got["berries"] == ("berry",) * 3 and got["potatoes"] == ("potato",) * 3 and got["dishes"] == ("dish",) * 3
    assert got["olives"] == ("oliv", "olive", "oliv") and got["glass"] == ("glass",) * 3 and got["pies"] == ("pi", "pie", "py") and got["boxes"][1] == "box"
    want = {"2-3": 2.5, "2 to 3": 2.5, "~4": 4.0, "1/2": 0.5, "1 1/2": 1.5, " 3.5 ": 3.5, "to taste": None, "4 people": None, "": None, "1/0": None, "-2": None}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", text_quantity(F.col("t")).alias("q")).collect()
    assert {r.t: r.q for r in rows} == want
