"""Golden values of the functions, and stream against batch."""

import pytest
from pyspark.sql import functions as F

from galley.functions import text, time, units


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("text_", "minutes"),
    [("PT30M", 30), ("PT1H", 60), ("PT1H30M", 90), ("PT24H", 1440), ("PT30S", 0.5), ("5min", 5), ("1h30min", 90), ("45 minutes", 45), ("1 hour 15 minutes", 75), ("", 0), (None, 0)],
)
def test_legacy_minutes(spark, text_, minutes):
    assert one(spark, time.legacy_minutes(F.col("t")), t=text_) == pytest.approx(minutes)


@pytest.mark.parametrize(("minutes", "iso"), [(0.0, "PT0M"), (45.0, "PT45M"), (120.0, "PT2H"), (90.0, "PT1H30M"), (125.0, "PT2H5M"), (1440.0, "PT24H")])
def test_minutes_iso(spark, minutes, iso):
    assert one(spark, time.minutes_iso(F.col("m")), m=minutes) == iso


@pytest.mark.parametrize(("minutes", "shown"), [(90.0, "1 hour 30 min"), (60.0, "1 hour"), (30.0, "30 min"), (0.0, "0 min")])
def test_compact(spark, minutes, shown):
    assert one(spark, time.compact(F.col("m")), m=minutes) == shown


GRAMS = [
    (250.0, "g", "flour", 250), (1.5, "kg", "potatoes", 1500), (4.0, "oz", "cheese", 113.4), (2.0, "lb", "beef", 907.2), (100.0, "ml", "some liquid", 100),
    (25.0, "cl", "some liquid", 250), (2.0, "dl", "some liquid", 200), (2.0, "tbsp", "some ingredient", 30), (1.0, "pinch", "cumin", 0.5), (1.0, "zarblfloop", "chicken", None),
    (1.0, None, "xyznoexist", None), (100.0, "ml", "olive oil", 92), (200.0, "ml", "honey", 284), (500.0, "ml", "whole milk", 515), (200.0, "ml", "heavy cream", 198),
    (60.0, "ml", "maple syrup", 79.2), (15.0, "cl", "red wine", 148.5), (400.0, "ml", "coconut milk", 404), (30.0, "ml", "fish sauce", 33), (50.0, "ml", "cognac", 47.5),
    (200.0, "g", "olive oil", 200), (1.0, "kg", "honey", 1000), (1.0, "cup", "vegetable oil", 218),
]


def test_grams(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(GRAMS)], "i int, q double, unit string, name string")
    got = {r.i: r.g for r in units.with_unit_grams(df, "name", "unit", "one").select("i", (F.col("q") * F.col("one")).alias("g")).collect()}
    for i, (*_, want) in enumerate(GRAMS):
        assert got[i] == (want if want is None else pytest.approx(want)), GRAMS[i]


def test_text(spark):
    assert one(spark, text.fold(F.col("t")), t="Pâté ÉTÉ Ñandú") == "pate ete nandu"
    assert one(spark, text.fold_any(F.col("t")), t="Pâté ÉTÉ Ñandú") == "pate ete nandu"
    assert one(spark, text.clean_title(F.col("t")), t="Tarte (facile)") == "Tarte"
    assert one(spark, text.slug(F.col("t")), t="Crème brûlée !") == "creme-brulee"


def test_stream_equals_batch(spark, tmp_path):
    from galley.plans.adapters import view
    from galley.streaming.progress import snapshot

    events = view(spark, "/root/testdata/sf0.001", "progress").select("event_id", "id", "ts", "status", "step")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = snapshot(stream).writeStream.outputMode("complete").format("memory").queryName("snap").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("snap").collect())) == sorted(map(tuple, snapshot(events).collect()))


def test_schedule_shares_the_active_lane(spark):
    from galley.operators.quantities import schedule

    rows = [(1, 1, 10.0, False, "main"), (1, 2, 30.0, True, "main"), (1, 3, None, False, "sauce"), (1, 4, 5.0, True, "sauce")]
    got = schedule(spark.createDataFrame(rows, "rid long, pos int, minutes double, passive boolean, sub_recipe string").withColumn("produces", F.lit("x"))).collect()
    # each step uses the one before and that of half its position
    assert sorted((r.pos, r.lane, r.start, r.end) for r in got) == [(1, "you", 0.0, 10.0), (2, "main", 10.0, 40.0), (3, "you", 40.0, 43.0), (4, "sauce", 43.0, 48.0)]


def test_balanced_columns_equals_the_greedy_rule(spark):
    import random
    from collections import Counter

    from galley.operators.kitchen import balanced_columns

    draw = random.Random(5)
    rows = [(r, p, draw.choice("abcdefg")) for r in range(40) for p in range(draw.randint(1, 15))]
    want = set()
    for rid in {r for r, _, _ in rows}:
        mine = [c for r, _, c in rows if r == rid]
        held = [0, 0, 0]
        for category, n in sorted(Counter(mine).items(), key=lambda x: (-x[1], mine.index(x[0]))):
            at = held.index(min(held))
            held[at] += n
            want.add((rid, category, at))
    assert {tuple(r) for r in balanced_columns(spark.createDataFrame(rows, "rid long, pos int, category string")).collect()} == want


@pytest.mark.parametrize(
    "quantity, unit, want",
    [
        (2.0, "Heaping tablespoons", (2.5, "tbsp", "inferred", "heaping")), (None, "large handful", (1.5, "handful", "inferred", "large")), (None, "scant", (0.85, "tsp", "inferred", "scant")),
        (3.0, "scant", (3.0, "scant", None, None)), (None, "thin slices", (1.0, "slice", "inferred", None)), (2.0, "Cups", (2.0, "cup", None, None)), (None, "Box", (None, "Box", None, None)), (None, None, (None, None, None, None)),
    ],
)
def test_mended_quantity(spark, quantity, unit, want):
    from galley.operators.kitchen import mended_quantity

    df = spark.createDataFrame([(quantity, unit)], "q double, u string")
    assert tuple(df.select(mended_quantity(F.col("q"), F.col("u")).alias("m")).first().m) == want


def test_single_privacy(spark):
    from galley.operators.kitchen import is_private

    df = spark.createDataFrame([("Ann Lee",), ("",), (None,)], "a string")
    hidden = lambda config: [r[0] for r in df.select(is_private(F.col("a"), config)).collect()]
    assert hidden({"public": ["ann"]}) == [False, True, True]
    assert hidden({"public": []}) == [True, True, True]
    assert hidden({"private": ["lee"]}) == [True, False, False]
    assert hidden({"private": ["LEE"]}) == [False, False, False]
    assert hidden({}) == [False, False, False]


def test_named_ingredients(spark):
    from galley.operators.kitchen import named_ingredients

    names = spark.createDataFrame([(1, 1, "Eggplant"), (1, 2, "egg"), (1, 3, "egg white"), (1, 4, "olive oil")], "rid long, pos int, name string")
    refs = spark.createDataFrame([(1, x) for x in ("egg", "olive_oil", "oil", "Beaten egg white", "plant", "")], "rid long, ref string")
    assert {r.ref: r.pos for r in named_ingredients(refs, names).collect()} == {"egg": 2, "olive_oil": 4, "oil": 4, "Beaten egg white": 2, "plant": None, "": None}


@pytest.mark.parametrize(
    ("name", "forms"),
    [
        ("Beans, green, raw", ["beans, green", "beans, green, raw", "green beans", "green raw beans"]), ("Raw", ["raw"]), ("Baker's Yeast", ["baker yeast"]), ("ox", []), (None, []), ("", []),
    ],
)
def test_name_forms(spark, name, forms):
    from galley.operators.kitchen import name_forms

    assert one(spark, name_forms(F.col("n")), n=name) == forms


def test_names_are_looked_up_inside_recipes(spark):
    from galley.operators.kitchen import named_ingredients

    names = [(1, 4, "olive oil"), (1, 2, " Oil"), (1, 3, "oil"), (1, 5, "red  wine"), (1, 6, ""), (1, 7, None), (1, 8, "\t"), (2, 1, "oil")]
    refs = [(1, x) for x in ("OIL", "oil", "olive_oil_spray", "wine", "red__wine", "red_wine", " ", "_", None)] + [(2, "oil"), (2, "oil"), (3, "oil")]
    out = named_ingredients(spark.createDataFrame(refs, "rid long, ref string"), spark.createDataFrame(names, "rid long, pos int, name string"))
    want = {(1, "OIL"): 2, (1, "oil"): 2, (1, "olive_oil_spray"): 2, (1, "wine"): 5, (1, "red__wine"): None, (1, "red_wine"): 5, (1, " "): None, (1, "_"): None, (1, None): None, (2, "oil"): 1, (3, "oil"): None}
    rows = out.collect()
    assert len(rows) == len(want) and {(r.rid, r.ref): r.pos for r in rows} == want
    plan = out._jdf.queryExecution().executedPlan().toString().rpartition("Initial Plan")[2]
    assert plan.count("Exchange hashpartitioning") <= 2  # a recipe's names and references, once each: parts of names are no rows
