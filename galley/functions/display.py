"""Quantities as shown: rounding, fractions, and conversion between unit systems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.units import lookup, round_half_up

#: Millilitres and grams of one display unit.
TO_ML = {"cup": 240.0, "tbsp": 15.0, "tsp": 5.0, "fl oz": 29.57, "pint": 473.0, "quart": 946.0, "gallon": 3785.0, "cl": 10.0, "dl": 100.0, "ml": 1.0, "l": 1000.0, "cs": 15.0, "cc": 5.0}
TO_G = {"oz": 28.35, "lb": 453.6, "g": 1.0, "kg": 1000.0}
IMPERIAL = ["cup", "tbsp", "tsp", "fl oz", "pint", "quart", "gallon", "oz", "lb"]
#: The fractions that are shown, and their signs.
FRACTIONS = {0.25: "¼", 0.33: "⅓", 0.5: "½", 0.66: "⅔", 0.75: "¾"}


#: Fixed values, from the largest amount down: (least, grain, shown for a grain as a ratio, unit).
GRAM_STEPS = [(100, 10.0, (10, 1), "g"), (20, 5.0, (5, 1), "g"), (None, 1.0, (1, 1), "g")]
KILO_STEPS = [(1000, 100.0, (1, 10), "kg"), *GRAM_STEPS]
ML_STEPS = [(1000, 100.0, (1, 10), "l"), (500, 25.0, (25, 1), "ml"), (100, 10.0, (10, 1), "ml"), (15, 5.0, (5, 1), "ml"), (None, 1.0, (1, 1), "ml")]
OUNCE_STEPS = [(907, 453.6 / 4, (1, 4), "lb"), (None, 28.35 / 2, (1, 2), "oz")]


def _ladder(amount: Column, steps: list) -> Column:
    """(quantity, unit) by the first step that the amount reaches: whole grains, half up."""
    rung = [F.struct((F.floor(amount / grain + 0.5) * up / down).cast("double").alias("quantity"), F.lit(unit).alias("unit")) for _, grain, (up, down), unit in steps]
    out = rung[-1]
    for (least, *_), shown in reversed(list(zip(steps, rung, strict=True))[:-1]):
        out = F.when(amount >= least, shown).otherwise(out)
    return out


def round_grams(g: Column) -> Column:
    return _ladder(g, GRAM_STEPS)["quantity"]


def round_ml(ml: Column) -> Column:
    return _ladder(ml, ML_STEPS)


def round_metric_weight(g: Column) -> Column:
    return _ladder(g, KILO_STEPS)


def round_imperial_weight(g: Column) -> Column:
    return _ladder(g, OUNCE_STEPS)


def _nearest(v: Column, *more: tuple[float, str]) -> tuple[Column, Column, Column]:
    """(whole part, rest, the shown fraction nearest to the rest as (value, sign)); ties to the one listed first."""
    whole = F.floor(v)
    choices = [F.struct(F.abs(F.lit(x) - (v - whole)).alias("off"), F.lit(i).alias("i"), F.lit(x).alias("value"), F.lit(sign).alias("sign")) for i, (x, sign) in enumerate([*more, *FRACTIONS.items()])]
    return whole, v - whole, F.array_min(F.array(*choices))


def round_fraction(v: Column) -> Column:
    """The whole part and the nearest shown fraction; there is no rounding up to the next whole."""
    whole, rest, found = _nearest(v)
    return F.when(rest == 0, v).otherwise(whole + found["value"])


def show_fraction(v: Column) -> Column:
    """The whole part and a fraction's sign; a part nearest to one shows as 1."""
    whole, rest, found = _nearest(v, (1.0, "1"))
    head = F.when((whole > 0) | (rest == 0), whole.cast("string")).otherwise("")
    return F.concat(head, F.when(rest == 0, "").otherwise(found["sign"]))


def round_imperial_volume(ml: Column) -> Column:
    tsp = F.struct(round_fraction(ml / 5).alias("quantity"), F.lit("tsp").alias("unit"))
    tbsp = F.struct((round_half_up(ml / 15 * 2) / 2).alias("quantity"), F.lit("tbsp").alias("unit"))
    cup = F.struct(round_fraction(ml / 240).alias("quantity"), F.lit("cup").alias("unit"))
    return F.when(ml >= 48, cup).when(ml >= 7.5, tbsp).otherwise(tsp)


def convert(quantity: Column, unit: Column, system: str) -> Column:
    """(quantity, unit) in the metric or imperial system; weights stay weights, volumes volumes, the rest as it is."""
    g, ml = quantity * lookup(TO_G, unit), quantity * lookup(TO_ML, unit)
    same = F.struct(quantity.alias("quantity"), unit.alias("unit"))
    imperial = F.coalesce(unit.isin(IMPERIAL), F.lit(False))
    move = imperial if system == "metric" else ~imperial
    weight, volume = (round_metric_weight(g), round_ml(ml)) if system == "metric" else (round_imperial_weight(g), round_imperial_volume(ml))
    return F.when(move & g.isNotNull(), weight).when(move & ml.isNotNull(), volume).otherwise(same)
