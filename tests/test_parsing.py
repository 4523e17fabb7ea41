"""Golden lines and references."""

import pytest

from galley.operators import parsing

LINES = [
    ("- 250g «champignons de Paris» [250g mushrooms, sliced] {produce}, émincés", dict(name="champignons de Paris", name_en="mushrooms", id="mushrooms", quantity=250.0, unit="g", category="produce", preparation="émincés")),
    ("- 2 tbsp «olive oil» [2 tablespoons olive oil] {oil}", dict(name="olive oil", id="olive_oil", quantity=2.0, unit="tbsp", category="oil", preparation=None, optional=False)),
    ("- 200ml «crème fraîche» [200ml heavy cream] {dairy}", dict(id="heavy_cream", quantity=200.0, unit="ml")),
    ("- «coriandre fraîche» [fresh cilantro] {herb} (optional)", dict(optional=True, notes=None, quantity=None, id="fresh_cilantro")),
    ("- «sel» [salt, to taste] {spice} (à volonté)", dict(name_en="salt", preparation="to taste", optional=True)),
    ("- 6 cloves «garlic» [6 cloves garlic, minced] {produce}, minced", dict(quantity=6.0, unit="clove", name_en="garlic", preparation="minced")),
    ("- 1 1/2 «x» [1 1/2 cups of plain flour] {odd} (tamisée)", dict(quantity=1.5, unit="cup", name_en="plain flour", category="other", notes="tamisée")),
    ("- «safran» [pinch of saffron] {spice}", dict(quantity=1.0, unit="pinch", source="inferred")),
    ("- «lait» [1/2 l whole milk] {dairy} (optionnel), tiède [warm],", dict(quantity=0.5, unit="l", preparation="tiède", optional=True)),
    ("2 «citrons» [2 lemons]", dict(quantity=2.0, unit=None, name_en="lemons", category="other")),
    ("- «œufs»", dict(name_en="œufs", id="oeufs", quantity=None)),
]


def test_golden_lines(spark):
    rows = [(i, line) for i, (line, _) in enumerate(LINES)] + [(90, "Vous pouvez substituer le beurre par de la margarine"), (91, ""), (92, None)]
    got = {r.i: r.asDict() for r in parsing.parsed_lines(spark.createDataFrame(rows, "i int, line string")).collect()}
    assert set(got) == set(range(len(LINES)))  # what is no line gives none
    for i, (line, want) in enumerate(LINES):
        assert {k: got[i][k] for k in want} == want, line


def test_documents(spark):
    salad = """TITLE: Salade César

INGREDIENTS:
**Salade:**
- 1 «laitue romaine» [1 romaine lettuce] {produce}
- 100g «parmesan» [100g parmesan cheese] {dairy}, râpé
Note: on peut garder «rien»
- 100g sans marque

**Sauce:**
- 2 c-à-s «farine» [100g flour] {pantry}
- 50g «farine» [50g flour] {pantry}

INSTRUCTIONS:
1. Laver «la laitue»
"""
    docs = spark.createDataFrame([(1, salad), (2, "TITLE: Test\nINSTRUCTIONS:\n1. Do «something»"), (3, "INGREDIENTS:\n- 1 «a» [1 a]"), (4, None)], "doc int, text string")
    got = sorted((r.doc, r.n, r.id) for r in parsing.parsed_documents(docs).collect())
    assert [x[2] for x in got if x[0] == 1] == ["romaine_lettuce", "parmesan_cheese", "rien", "flour", "flour_1"] and [x[2] for x in got if x[0] > 1] == ["a"]


CASES = [
    # ingredients (id, name, name_en), produced by steps, refs of the last step, what is left
    ([("flour", "Farine", None), ("sugar", "Sucre", None)], ["dry_mix", "dough"], ["flour", "sugar", "dry_mix"], "flour,sugar,dry_mix"),
    ([("salt", "Sel", None), ("flour", "Farine", None)], ["dry_mix"], ["flour", "salt_1"], "flour,salt"),
    ([("salt_1", "Sel", None)], ["x"], ["salt_2"], "salt_1"),
    ([("onions", "oignon", "onions"), ("garlic", "ail", "garlic")], ["base"], ["oignon", "garlic"], "onions,garlic"),
    ([("flour", "Farine", None)], ["x"], ["flor"], ""),
    ([("flour", "Farine", None), ("sugar", "Sucre", None)], ["x"], ["flour", "fake_id", "sugar"], "flour,sugar"),
    ([("onion", "Oignon", None), ("garlic", "Ail", None)], ["x"], ["lemon", "garlic"], "garlic"),
    ([("grana_padano_cheese", "grana padano", None)], ["x"], ["grana_padano"], "grana_padano_cheese"),
    ([("eggplant", "eggplant", None), ("egg_yolk", "egg yolk", None), ("egg", "big egg", None)], ["x"], ["Egg"], "egg"),
    ([("e_acute", "thé", None)], ["x"], ["th"], ""),
]


@pytest.mark.parametrize("earlier", [False, True])
def test_references(spark, earlier):
    refs, steps, ingredients = [], [], []
    for rid, (named, made, asked, _) in enumerate(CASES):
        ingredients += [(rid, p, *x) for p, x in enumerate(named)]
        steps += [(rid, p, m) for p, m in enumerate([*made, "end"], 1)]
        refs += [(rid, len(made) + 1, "uses", k, r) for k, r in enumerate(asked)] + [(rid, len(made) + 1, "requires", 0, "nonexistent"), (rid, 1, "requires", 1, "end"), (rid, 1, "uses", 2, None)]
    got = parsing.corrected_references(
        spark.createDataFrame(refs, "rid int, pos int, kind string, k int, ref string"), spark.createDataFrame(steps, "rid int, pos int, produces string"),
        spark.createDataFrame(ingredients, "rid int, pos int, id string, name string, name_en string"), earlier,
    )
    got = {(r.rid, r.pos): (r.uses, r.requires) for r in got.collect()}
    for rid, (_, made, _, left) in enumerate(CASES):
        assert got[rid, len(made) + 1] == (left, "")
        assert got[rid, 1] == ("", "" if earlier else "end")  # a state of a later step
