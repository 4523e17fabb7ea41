"""Languages of names and the check against a second food index, on small golden cases."""

import pytest

from galley.functions import text
from galley.operators import crosscheck as m

NAMES = "array<struct<name:string,name_en:string>>"


@pytest.mark.parametrize(("name", "french", "english"), [
    ("huile d'olive", True, True), ("Olive Oil", False, True), ("pâte", True, False), ("émincé de bœuf", True, False), ("salsel", False, False), ("black olives", False, False),
    ("olive", False, True), ("olive séchée", True, False), ("pur jus d'orange", True, False), ("d'orange", False, False), ("cumin moulu", True, True), ("CHICKEN legs", False, True),
    ("unsalted", False, False), ("l'ail", True, False), (" a ", False, False), ("", False, False), (None, False, False), ("thymé", True, False),
])
def test_languages_of_names(spark, name, french, english):
    row = spark.createDataFrame([(name,)], "name string").select(m.likely_french(m.F.col("name")).alias("fr"), m.likely_english(m.F.col("name")).alias("en")).first()
    assert (row.fr, row.en) == (french, english)


def test_language_report(spark):
    rows = [
        ("a", "EN", [("huile d'olive", "olive oil"), ("garlic", "garlic"), ("", None), (None, "x")]),
        ("b", "fr", [("beurre", None), ("sel", "")]),
        ("c", None, None),
        ("d", "en", [(f"tomate {i}", f"tomate {i}") for i in range(7)]),
    ]
    report = m.language_report(spark.createDataFrame(rows, f"slug string, language string, ingredients {NAMES}"))
    assert "Exchange" not in report._jdf.queryExecution().executedPlan().toString()
    got = {r.slug: r for r in report.collect()}
    a, b, c, d = (got[x] for x in "abcd")
    assert (a.ingredient_count, a.names_fr_count, a.names_en_count, a.mixed_count, a.has_mixed, a.has_fr_in_en_source) == (4, 1, 2, 1, True, True)
    assert (b.names_fr, b.mixed_count, b.has_mixed, b.has_fr_in_en_source) == ("beurre | sel", 0, False, False)
    assert (c.ingredient_count, c.names_fr, c.is_english_source) == (0, "", False)
    assert (d.names_fr_count, d.names_fr, d.mixed_count) == (7, " | ".join(f"tomate {i}" for i in range(5)), 0)
    assert tuple(m.language_summary(report).first()) == (4, 1, 25.0, 2, 50.0)
    assert tuple(m.language_summary(report.limit(0)).first()) == (0, 0, None, 0, None)


def test_longest_run_of_words_then_leftmost(spark):
    reference = spark.createDataFrame([("olive", 1.0), ("olive oil", 2.0), ("oil", 3.0), ("leek", 4.0)], "found string, kcal double")
    names = spark.createDataFrame([("fresh olive oil",), ("oil leek",), ("stone",), ("olive  oil",), ("",)], "key string")
    assert {r.key: r.kcal for r in m.by_phrases(names, reference).collect()} == {"fresh olive oil": 2.0, "oil leek": 3.0, "olive  oil": 2.0}


def _stored(spark, rows):
    return spark.createDataFrame(rows, "rid long, servings int, kcal double, protein double, fat double, carbs double, fiber double, confidence string, resolved long, total long")


def test_verdicts(spark):
    reference = spark.createDataFrame([("rice", 400.0, 10.0, None, 80.0, 0.0), ("oil", 900.0, 0.0, 100.0, 0.0, 0.0)], "found string, kcal double, protein double, fat double, carbs double, fiber double")
    stored = _stored(spark, [
        (1, 2, 400.0, 10.0, 0.0, 80.0, 0.0, "high", 1, 1),  # as the reference
        (2, 2, 800.0, 10.0, 0.0, 80.0, 0.0, "high", 1, 1),  # twice the energy
        (3, 2, 550.0, 10.0, 0.0, 80.0, 0.0, "high", 1, 1),  # 37.5 % above
        (4, 2, 480.0, 10.0, 0.0, 80.0, 0.0, "high", 1, 3),  # near, but few resolved
        (5, 2, 400.0, 10.0, 0.0, 80.0, 0.0, "low", 1, 8),  # one of eight weighed
        (6, 2, None, None, None, None, None, None, None, None),
        (7, 0, 2100.0, 0.0, 0.0, 0.0, 0.0, "low", 0, 0),  # nothing named: energy against nothing
        (8, None, 0.0, 0.0, 0.0, 0.0, 0.0, "none", 0, 0),
    ])
    lines = [(i, "Rice ", 200.0) for i in (1, 2, 3, 4, 5, 6)] + [(1, "salt", 5.0), (1, "", 5.0), (1, None, 1.0), (5, "oil", None), (5, "oil", 0.0)] + [(5, f"stone {i}", 9.0) for i in range(5)]
    out = m.cross_check(stored, spark.createDataFrame(lines, "rid long, name string, grams double"), reference)
    got = {r.rid: r for r in out.collect()}
    assert {k: r.verdict for k, r in got.items()} == {1: "pass", 2: "fail", 3: "warning", 4: "warning", 5: "inconclusive", 6: "error", 7: "fail", 8: "pass"}
    assert (got[1].matched, got[1].weighed, got[1].named, got[1].ref_kcal, got[1].ref_fat) == (1, 1, 1, 400.0, 0.0)
    assert got[2].issues == ["calories: 800.0 vs ref 400.0 (100.0% deviation, diff=400.0)"]
    assert got[4].issues == ["Confidence is 'high' but only 1/3 ingredients resolved"]
    assert (got[5].matched, got[5].issues) == (3, ["Only 1/8 ingredients resolved in reference (12%). Need >= 90% for reliable comparison."])
    assert got[7].issues == ["calories: 2100.0 vs ref 0.0 (100.0% deviation, diff=2100.0)", "Very high calories per serving: 2100.0 kcal"]
    assert {r.verdict: (r.n, r.n_issues) for r in m.verdicts(out).collect()} == {"pass": (2, 0), "fail": (2, 3), "warning": (2, 2), "inconclusive": (1, 1), "error": (1, 0)}


@pytest.mark.parametrize(("raw", "name", "others"), [
    ('Rice, "Kome", (polished rice), [paddy]', "rice,", ["kome", "polished rice"]), ("Leek", "leek", []), (', Tofu*, (ab), "Momen"', "tofu", ["momen"]), ("［a］Salt\n fine", "salt fine", []), ("", "", []), (None, None, None),
])
def test_listed_names(spark, raw, name, others):
    df = spark.createDataFrame([(raw,)], "raw string")
    a, b = text.listed_name(df.raw)
    assert tuple(df.select(a, b).first()) == (name, others)


def test_details_are_read_once_and_lines_not_dealt_by_name(spark):
    from galley.operators import nutrition

    plan = m._checked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    retained = [line for line in plan.splitlines() if "partial" not in line and "count_if" not in line and "Aggregate [rid" in line]
    assert len(retained) == 1  # one sum over the lines of a recipe
    foods = spark.createDataFrame([(3, " Oil", 1.0), (2, "oil ", None), (5, "leek", 4.0), (4, "Leek", 5.0)], "id long, name string, kcal double")
    first = nutrition.first_foods(foods)
    assert {tuple(r) for r in first.select("key", "id", "kcal").collect()} == {("oil", 2, None), ("leek", 4, 5.0)}
    assert "Window" not in first._jdf.queryExecution().optimizedPlan().toString()  # no task has all foods of a name
