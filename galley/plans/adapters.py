"""Views that show the TPC-H-like tables as recipes, ingredients, steps, foods and events.

Each view is one SELECT in SQL that Spark and DuckDB read alike. Line items repeat (order, line); one of
each is taken by an order without ties.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from galley.tables import table

#: Ingredient names that the adapters use: (name, category). Three of them have no food (see FOODS_WITHOUT).
NAMES = [
    ("olive oil", "oil"), ("chicken broth", "pantry"), ("salt", "spice"), ("fresh basil", "herb"), ("egg", "egg"), ("flour", "grain"),
    ("honey", "condiment"), ("red wine", "beverage"), ("whole milk", "dairy"), ("onion", "produce"), ("carrots", "produce"), ("shrimp", "seafood"),
    ("butter", "dairy"), ("tomato", "produce"), ("cherry tomato", "produce"), ("soy sauce", "condiment"), ("lentils", "legume"), ("truffle dust", "other"),
    ("chicken breast", "poultry"), ("garlic", "produce"), ("asparagus", "produce"), ("strawberry", "produce"), ("sugar", "pantry"), ("rice", "grain"),
    ("coconut milk", "other"), ("parmesan cheese", "dairy"), ("thyme", "herb"), ("black pepper", "spice"), ("vegetable oil", "oil"), ("mystery powder", "other"),
    ("salmon", "seafood"), ("beef steak", "meat"), ("apple", "produce"), ("walnut", "nuts_seeds"), ("potatoes", "produce"), ("zucchini", "produce"),
    ("heavy cream", "dairy"), ("vinegar", "condiment"), ("maple syrup", "condiment"), ("pumpkin", "produce"),
]
FOODS_WITHOUT = (5, 17, 29)
UNITS = ["g", "kg", "ml", "cl", "cup", "tbsp", "tsp", "oz", None, "piece", "small cloves", "/2 cup", "Tablespoons"]


#: What pick() has written, and how Spark reads it: a constant array takes no code for each of its values.
_PICKED: dict[str, str] = {}


def pick(index: str, values: list) -> str:
    """SQL for the value at an index."""
    show = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    text = f"CASE {index} " + " ".join(f"WHEN {i} THEN {show(v)}" for i, v in enumerate(values)) + " END"
    _PICKED[text] = f"get(array({', '.join(map(show, values))}), CAST({index} AS INTEGER))"
    return text


_NAME = lambda key: pick(f"({key}) % {len(NAMES)}", [n for n, _ in NAMES])
_CATEGORY = lambda key: pick(f"({key}) % {len(NAMES)}", [c for _, c in NAMES])
_TYPES = ["main_course", "dessert", "appetizer", "base", "drink"]

#: Shapes of raw values as scraped: numbers of the row (a, b) stand in durations, quantities, names and headers.
_SHAPES = [
    "concat('PT', a, 'M')", "concat('PT', b, 'H')", "concat('PT', b, 'H', a, 'M')", "concat('PT', a, 'S')", "'PT'", "concat('PT', b, '.5H')", "concat(a, 'min')", "concat(b, 'h', a, 'min')",
    "concat(a, ' minutes')", "concat(b, ' hour ', a, ' minutes')", "''", "a", "concat('P', b, 'D')", "concat(b, 'h05')", "concat(b, ' heures')", "concat(b, '-', a)", "concat(b, ' to ', a)",
    "concat('1/', b)", "concat(a, ' 1/', b)", "concat('~', a)", "concat('~ ', a)", "concat(a, ' people')", "'none'", "concat(a, '.5')", "'to taste'", "'0'", "'-'", "'N'", "'traces'",
    "concat('< 0,', b)", "concat(a, ',', b)", "'Tr'", "concat('(', b, ')')", "concat('(', b, '.2)')", "concat('<', b)", "concat('/', b, ' cup')", "concat('/', b, ' piece')", "'chicken/beef'",
    "'red wine or port'", "'berries'", "'Tomatoes'", "'olives'", "'glass'", "'dishes'", "'boxes'", "'Pâte à crêpes (facile)'", "'Œufs à la coque'", "concat(a, 'g flour')", "concat('LANGUAGE: fr ', a)",
    "'garlic, boneless; (skinless).'", "'for garnish'", "'Optional herbs'", "'[note]'", "'soy sauce'", "'peanut sauce'", "'caesar dressing'", "concat('Bake ', a, ' min, then rest ', b, ' h')", "'flambé the sauté pan'",
]
VIEWS = {
    "texts": f"""SELECT 'raw' AS src, l_orderkey * 8 + l_linenumber AS i, CASE (l_partkey + l_suppkey) % {len(_SHAPES)} {" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_SHAPES))} END AS t
        FROM (SELECT *, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(9)) AS a, CAST(l_linenumber + 1 AS VARCHAR(9)) AS b FROM lines) r
      UNION ALL SELECT 'title', rid, title FROM recipes UNION ALL SELECT 'url', page_id, url FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents""",
    "lines": """SELECT * FROM (
        SELECT l.*, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM lineitem l
    ) x WHERE rn = 1""",
    "foods": f"""SELECT p_partkey AS id, {_NAME("p_partkey")} AS name, CAST((p_partkey * 37) % 900 + CASE WHEN p_partkey % 19 = 0 THEN 400 ELSE 0 END AS DOUBLE) AS kcal,
        CAST((p_partkey * 13) % 40 AS DOUBLE) AS protein, CAST((p_partkey * 7) % 60 AS DOUBLE) AS fat, CAST((p_partkey * 11) % 80 AS DOUBLE) AS carbs,
        CAST((p_partkey * 3) % 12 AS DOUBLE) AS fiber, CAST((p_partkey * 5) % 30 AS DOUBLE) AS sugar, CAST((p_partkey * 2) % 20 AS DOUBLE) AS sat_fat,
        CASE WHEN p_partkey % 3 > 0 THEN CAST((p_partkey * 17) % 400 AS DOUBLE) END AS calcium, CASE WHEN p_partkey % 3 > 0 THEN CAST((p_partkey * 19) % 90 AS DOUBLE) / 10 END AS iron,
        CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'SMALL') THEN 'base' WHEN p_type IN ('MEDIUM', 'LARGE') THEN 'ciqual' ELSE 'mext' END AS source
      FROM part WHERE p_partkey % {len(NAMES)} NOT IN {FOODS_WITHOUT}""",
    "recipes": f"""SELECT o_orderkey AS rid, concat('recipe-', CAST(o_orderkey AS VARCHAR(20))) AS slug,
        CASE WHEN o_orderkey % 5 = 0 THEN concat('Soupe n', CAST(o_orderkey % 97 AS VARCHAR(20))) WHEN o_orderkey % 7 = 0 THEN concat('Pâté été ', CAST(o_orderkey % 97 AS VARCHAR(20)), ' (maison)')
             ELSE concat('Plat ', CAST(o_orderkey % 97 AS VARCHAR(20))) END AS title,
        c_name AS author, CAST(1 + o_custkey % 8 AS INTEGER) AS servings,
        {pick("CAST(substring(o_orderpriority, 1, 1) AS INTEGER) - 1", _TYPES)} AS recipe_type,
        CASE o_orderstatus WHEN 'O' THEN 'easy' WHEN 'F' THEN 'medium' ELSE 'hard' END AS difficulty,
        CAST(extract(month FROM o_orderdate) AS INTEGER) AS month, o_orderdate AS created, CAST((o_orderkey * 7) % 180 AS INTEGER) AS total_minutes,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN concat('https://site', CAST(o_custkey % 9 AS VARCHAR(20)), '.example.com/r/', CAST(o_orderkey AS VARCHAR(20)))
             ELSE concat('http://www.blog', CAST(o_custkey % 5 AS VARCHAR(20)), '.example.org/recettes/', CAST(o_orderkey AS VARCHAR(20)), '.html') END AS source_url
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "ingredients": f"""SELECT l_orderkey AS rid, l_linenumber AS pos, CASE WHEN l_partkey % 23 = 0 THEN '' ELSE {_NAME("l_partkey")} END AS name,
        CASE WHEN l_suppkey % 11 = 0 THEN CAST(NULL AS DOUBLE) ELSE l_quantity END AS quantity,
        {pick(f"(l_partkey + l_linenumber) % {len(UNITS)}", UNITS)} AS unit, {_CATEGORY("l_partkey")} AS category, l_returnflag = 'R' AS optional
      FROM lines""",
    "planned": "SELECT coalesce(author, '') AS author, i.* FROM ingredients i JOIN recipes USING (rid) WHERE name <> ''",
    "steps": """SELECT l_orderkey AS rid, l_linenumber AS pos, CASE WHEN l_partkey % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE l_quantity * 3 END AS minutes,
        l_linestatus = 'O' AS passive, concat('st', CAST(l_linenumber AS VARCHAR(20))) AS produces,
        CASE l_suppkey % 4 WHEN 0 THEN 'prep' WHEN 1 THEN 'combine' WHEN 2 THEN 'cook' ELSE 'rest' END AS step_type,
        CASE WHEN l_suppkey % 3 = 0 THEN 'sauce' ELSE 'main' END AS sub_recipe FROM lines""",
    "named_steps": f"""SELECT l_orderkey AS rid, l_linenumber AS pos, CASE WHEN l_partkey % 23 = 0 THEN '' ELSE {_NAME("l_partkey")} END AS name, concat('st', CAST(l_linenumber AS VARCHAR(20))) AS produces FROM lines""",
    # graphs as the data has them: in a third of the recipes any step may use any state (cycles, later states, missing ones), elsewhere earlier ones (diamonds)
    "graph_steps": """SELECT l_orderkey AS rid, l_linenumber AS pos, concat('s', CAST(l_linenumber AS VARCHAR(9))) AS id, CASE WHEN l_suppkey % 3 = 0 THEN 'sauce' ELSE 'main' END AS sub,
        CASE l_partkey % 6 WHEN 0 THEN 'Preheat the oven' WHEN 1 THEN 'Préchauffer le four' WHEN 2 THEN 'Mix' WHEN 3 THEN 'Bake' WHEN 4 THEN 'Chop' ELSE 'Serve' END AS action,
        CASE WHEN l_partkey % 4 = 0 THEN CAST(NULL AS VARCHAR(20)) WHEN l_partkey % 4 = 1 THEN concat('PT', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(9)), 'M') WHEN l_partkey % 4 = 2 THEN '' ELSE concat(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(9)), 'min') END AS duration,
        l_linestatus = 'O' AS passive, l_returnflag <> 'N' AS done,
        CASE WHEN l_suppkey % 17 = 0 THEN CAST(NULL AS VARCHAR(20)) WHEN l_suppkey % 19 = 0 THEN 'st_1' ELSE concat('st_', CAST(l_linenumber AS VARCHAR(9))) END AS produces FROM lines""",
    "graph_refs": """SELECT * FROM (
        SELECT l_orderkey AS rid, l_linenumber AS pos, 'uses' AS kind, concat('ing_', CAST(l_linenumber AS VARCHAR(9))) AS ref FROM lines
        UNION ALL SELECT l_orderkey, l_linenumber, 'uses', concat('ing_', CAST(l_partkey % 4 + 1 AS VARCHAR(9))) FROM lines
        UNION ALL SELECT l_orderkey, l_linenumber, 'uses', CASE WHEN l_orderkey % 3 = 0 THEN concat('st_', CAST(l_suppkey % 7 + 1 AS VARCHAR(9))) WHEN l_linenumber > 1 THEN concat('st_', CAST(l_suppkey % (l_linenumber - 1) + 1 AS VARCHAR(9))) END FROM lines
        UNION ALL SELECT l_orderkey, l_linenumber, 'requires', CASE WHEN l_orderkey % 3 = 0 AND l_partkey % 2 = 0 THEN concat('st_', CAST(l_partkey % 7 + 1 AS VARCHAR(9))) WHEN l_orderkey % 3 > 0 AND l_linenumber > 2 THEN concat('st_', CAST(l_partkey % (l_linenumber - 1) + 1 AS VARCHAR(9))) END FROM lines
        UNION ALL SELECT l_orderkey, l_linenumber, 'requires', concat('pan_', CAST(l_suppkey % 3 AS VARCHAR(9))) FROM lines
      ) r WHERE ref IS NOT NULL""",
    "graph_ingredients": "SELECT rid, concat('ing_', CAST(pos AS VARCHAR(9))) AS id, name FROM ingredients",
    "graph_recipes": "SELECT rid, concat('st_', CAST(rid % 9 AS VARCHAR(9))) AS final_state FROM recipes",
    # recipe documents with faults: broken and bare ones, wrong values, repeated ids
    "doc_heads": """SELECT rid, slug, rid % 97 = 5 AS broken, rid % 89 = 7 AS bare, CASE WHEN rid % 17 = 0 THEN ' ' ELSE title END AS title, CASE rid % 13 WHEN 0 THEN CAST(NULL AS VARCHAR(9)) WHEN 1 THEN '0' WHEN 2 THEN '60' WHEN 3 THEN 'four' ELSE CAST(servings AS VARCHAR(9)) END AS servings,
        CASE WHEN rid % 11 = 0 THEN 'odd' WHEN rid % 11 = 1 THEN '' ELSE difficulty END AS difficulty, CASE WHEN rid % 10 = 0 THEN 'soup' ELSE recipe_type END AS recipe_type, CASE rid % 7 WHEN 0 THEN '-5' WHEN 1 THEN '2000' WHEN 2 THEN 'PT5M' ELSE CAST(total_minutes AS VARCHAR(9)) END AS total_time,
        CAST(CASE rid % 8 WHEN 0 THEN -1 WHEN 1 THEN 5 WHEN 2 THEN 4000 WHEN 3 THEN NULL ELSE 400 END AS VARCHAR(9)) AS calories, CAST(CASE WHEN rid % 19 = 0 THEN -2 ELSE 20 END AS VARCHAR(9)) AS protein, CAST(CASE WHEN rid % 23 = 0 THEN -3 ELSE 20 END AS VARCHAR(9)) AS fat,
        CAST(CASE WHEN rid % 29 = 0 THEN -4 ELSE 20 END AS VARCHAR(9)) AS carbs, CASE rid % 4 WHEN 0 THEN 'Blog Marmiton' WHEN 1 THEN 'Cookie and Kate' WHEN 2 THEN 'papilles et pupilles' END AS source, concat('st_', CAST(rid % 9 AS VARCHAR(9))) AS final FROM recipes""",
    "doc_ingredients": """SELECT rid, pos, CASE WHEN pos = 6 THEN '' WHEN pos = 5 AND rid % 3 = 0 THEN 'ing_1' ELSE concat('ing_', CAST(pos AS VARCHAR(9))) END AS id, CASE WHEN rid % 5 = 0 AND pos = 2 THEN ' ' ELSE name END AS name,
        CASE (rid + pos) % 9 WHEN 0 THEN '-1' WHEN 1 THEN '0' WHEN 2 THEN 'some' WHEN 3 THEN CAST(NULL AS VARCHAR(9)) ELSE '2' END AS quantity, optional, CASE WHEN (rid + pos) % 12 = 0 THEN 'odd' ELSE category END AS category FROM ingredients""",
    "doc_steps": """SELECT rid, pos, CASE WHEN pos = 4 AND rid % 4 = 0 THEN '' WHEN pos = 3 AND rid % 4 = 1 THEN 's1' ELSE id END AS id, CASE WHEN pos = 2 AND rid % 6 = 0 THEN ' ' ELSE action END AS action, CASE WHEN (rid + pos) % 10 = 0 THEN 'mix' ELSE 'cook' END AS step_type,
        CASE (rid + pos) % 8 WHEN 0 THEN '400' WHEN 1 THEN '-10' WHEN 2 THEN 'hot' WHEN 3 THEN CAST(NULL AS VARCHAR(9)) ELSE '180' END AS temperature, produces FROM graph_steps""",
    "wanted_names": """SELECT DISTINCT CASE pos % 8 WHEN 0 THEN name WHEN 1 THEN concat('Fresh ', name, ', chopped') WHEN 2 THEN concat(name, ' sauce') WHEN 3 THEN concat(name, '/lard') WHEN 4 THEN concat(name, 's')
        WHEN 5 THEN concat('wild ', name, ' or butter') WHEN 6 THEN concat(name, 'ee') ELSE concat('some ', upper(name), ' stock') END AS name FROM ingredients WHERE name <> ''""",
    "food_index": """SELECT name, min(id) AS id, min_by(kcal, id) AS kcal FROM (
        SELECT id, kcal, CASE id % 5 WHEN 0 THEN name WHEN 1 THEN concat(name, ', raw') WHEN 2 THEN concat(name, ' pie') WHEN 3 THEN concat('Whole ', name) ELSE concat(name, 'e') END AS name FROM foods) f GROUP BY name""",
    "listed_foods": f"""SELECT name, min(id) AS id, min_by(unit, id) AS unit, min_by(grams, id) AS grams FROM (
        SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS grams, CASE p_partkey % 3 WHEN 0 THEN 'cup' WHEN 1 THEN 'slice' ELSE 'piece' END AS unit,
          CASE p_partkey % 7 WHEN 0 THEN concat(n, 's, raw') WHEN 1 THEN CASE WHEN position(' ' IN n) > 0 THEN concat(split_part(n, ' ', 2), ', ', split_part(n, ' ', 1), ', salad or cooking') ELSE concat(n, ', table') END
            WHEN 2 THEN concat(n, ' (', c, '), whole, cooked') WHEN 3 THEN concat('Nuts, ', n, ' nuts, raw') WHEN 4 THEN concat(upper(n), ', mature seeds, without salt') WHEN 5 THEN concat(n, ', sweet, fresh berries, NFS') ELSE n END AS name
        FROM (SELECT *, {_NAME("p_partkey")} AS n, {_CATEGORY("p_partkey")} AS c FROM part) p) q GROUP BY name""",
    "preformat_lines": """SELECT rid, pos, CASE WHEN (rid + pos) % 13 = 0 THEN concat('Vous pouvez garder ', name) ELSE concat('- ', coalesce(CAST(CAST(quantity AS INTEGER) AS VARCHAR(9)), ''), coalesce(unit, ''), ' «', name,
        CASE WHEN (rid + pos) % 3 = 0 THEN ' frais' ELSE '' END, '» [',
        CASE (rid + pos) % 8 WHEN 0 THEN concat(CAST(pos AS VARCHAR(9)), ' 1/2 ', coalesce(unit, 'cups'), ' ') WHEN 1 THEN concat('1/', CAST(pos + 1 AS VARCHAR(9)), ' cup ') WHEN 2 THEN 'pinch of ' WHEN 3 THEN '' WHEN 4 THEN concat(coalesce(CAST(CAST(quantity AS INTEGER) AS VARCHAR(9)), ''), 'g ')
          WHEN 5 THEN concat(CAST(pos AS VARCHAR(9)), '.5 tablespoons ') WHEN 6 THEN concat(CAST(pos AS VARCHAR(9)), ' small cloves ') ELSE concat(CAST(pos AS VARCHAR(9)), ' ') END, name,
        CASE WHEN pos % 3 = 0 THEN ', chopped' ELSE '' END, '] {', CASE WHEN rid % 9 = 0 THEN 'odd' ELSE category END, '}', CASE (rid + pos) % 5 WHEN 0 THEN ' (optional)' WHEN 1 THEN ' (bien mûr), émincé' WHEN 2 THEN ' (à volonté), en dés [diced],' WHEN 3 THEN ', haché' ELSE '' END) END AS line
      FROM ingredients WHERE name <> ''""",
    "named_ids": """SELECT rid, pos, concat(replace(name, ' ', '_'), CASE WHEN pos % 3 = 0 THEN concat('_', CAST(pos AS VARCHAR(9))) ELSE '' END) AS id, CASE WHEN pos % 4 = 0 THEN concat('Fresh ', name) WHEN pos % 4 = 1 THEN concat('huile de ', name, '-bio') ELSE concat(name, ' ') END AS name,
        CASE WHEN pos % 5 > 0 THEN name END AS name_en FROM ingredients WHERE name <> ''""",
    "loose_refs": """SELECT rid, pos, CASE WHEN pos % 5 = 0 THEN 'requires' ELSE 'uses' END AS kind, CAST(pos AS INTEGER) AS k, CASE (rid + pos) % 7 WHEN 0 THEN replace(name, ' ', '_') WHEN 1 THEN concat(replace(name, ' ', '_'), '_2') WHEN 2 THEN regexp_replace(name, '^.* ', '')
        WHEN 3 THEN concat('Chopped_', replace(name, ' ', '_')) WHEN 4 THEN concat('st_', CAST(rid % 5 AS VARCHAR(9))) WHEN 5 THEN concat('unknown_', CAST(pos AS VARCHAR(9))) ELSE upper(name) END AS ref FROM ingredients WHERE name <> ''
      UNION ALL SELECT rid, pos, 'requires', 100, concat('st_', CAST((rid + pos) % 8 AS VARCHAR(9)), '_4') FROM ingredients""",
    # commands of imports, a minute of the events in a second
    "commands": """SELECT event_id, user_id AS id, CAST(floor((((extract(day FROM ts) * 24 + extract(hour FROM ts)) * 60 + extract(minute FROM ts)) * 60 + CAST(floor(extract(second FROM ts)) AS INTEGER)) / 60) AS BIGINT) AS tick,
        CASE WHEN event_type = 'signup' THEN 'register' WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'complete' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'error'
             WHEN event_type = 'click' AND event_id % 5 = 0 THEN 'subscribe' WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'unsubscribe' ELSE 'step' END AS command,
        CASE event_id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'text' ELSE 'image' END AS kind,
        CASE event_id % 7 WHEN 0 THEN 'check_existence' WHEN 1 THEN 'scrape_content' WHEN 2 THEN 'structure_recipe' WHEN 3 THEN 'save_recipe' WHEN 4 THEN 'generate_recipe' WHEN 5 THEN 'ocr_extract' ELSE 'structure_recipe' END AS step,
        CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' OR value < 20 THEN 'completed' ELSE 'in_progress' END AS status, CAST(event_id % 101 AS INTEGER) AS progress,
        CASE WHEN event_id % 4 = 1 THEN '' ELSE concat('note ', CAST(event_id % 11 AS VARCHAR(9))) END AS message, concat('queue ', CAST(event_id % 2 AS VARCHAR(9))) AS queue,
        concat('recipe-', CAST(event_id AS VARCHAR(20))) AS slug FROM events""",
    "told_recipes": "SELECT rid, slug, CASE rid % 3 WHEN 0 THEN 'EN' WHEN 1 THEN 'fr' END AS language FROM recipes",
    "told_ingredients": """SELECT rid, pos, CASE (rid + pos) % 7 WHEN 0 THEN concat('Crème de ', name) WHEN 1 THEN concat('Huile d', chr(39), 'olive') WHEN 2 THEN concat(name, ' frais') WHEN 3 THEN concat('pur jus d', chr(39), name) WHEN 4 THEN '' ELSE name END AS name,
        CASE pos % 4 WHEN 0 THEN CAST(NULL AS VARCHAR(9)) WHEN 1 THEN concat('Fresh ', name, ' chopped') ELSE name END AS name_en FROM ingredients""",
    "progress": """SELECT event_id, user_id AS id, ts, value, event_type,
        CASE event_type WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'completed' ELSE 'in_progress' END AS status,
        CAST(event_id % 4 AS INTEGER) AS step FROM events""",
}
#: What a step refers to, as in graph_refs, by kind.
_REFS = {
    "uses": ["concat('ing_', CAST(l_linenumber AS VARCHAR(9)))", "concat('ing_', CAST(l_partkey % 4 + 1 AS VARCHAR(9)))",
        "CASE WHEN l_orderkey % 3 = 0 THEN concat('st_', CAST(l_suppkey % 7 + 1 AS VARCHAR(9))) WHEN l_linenumber > 1 THEN concat('st_', CAST(l_suppkey % (l_linenumber - 1) + 1 AS VARCHAR(9))) END"],
    "requires": ["CASE WHEN l_orderkey % 3 = 0 AND l_partkey % 2 = 0 THEN concat('st_', CAST(l_partkey % 7 + 1 AS VARCHAR(9))) WHEN l_orderkey % 3 > 0 AND l_linenumber > 2 THEN concat('st_', CAST(l_partkey % (l_linenumber - 1) + 1 AS VARCHAR(9))) END",
        "concat('pan_', CAST(l_suppkey % 3 AS VARCHAR(9)))"],
}


def _over(name: str, rows: str, *columns: str) -> str:
    """The view ``name``, which reads another row by row, over ``rows`` instead and with further columns of them."""
    return f"{', '.join((VIEWS[name].rpartition(' FROM ')[0], *columns))} FROM ({rows}) r"


def _struct(*names: str) -> str:
    return f"named_struct({', '.join(f"'{n}', {n}" for n in names)})"


def _document_lines() -> str:
    """A line's ingredient (doc_ingredients), step (doc_steps) and references (graph_refs) side by side: they need no join and are dealt once."""
    line = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    rows = _over("doc_ingredients", _over("ingredients", "SELECT * FROM lines", *line), *line)
    rows = f"SELECT {_struct('id', 'name', 'quantity', 'optional', 'category')} AS ingredient, {', '.join(f'array({", ".join(refs)}) AS {kind}' for kind, refs in _REFS.items())}, {', '.join(line)} FROM ({rows}) r"
    rows = _over("doc_steps", _over("graph_steps", rows, "ingredient", *_REFS), "ingredient", *_REFS)
    return f"SELECT rid, pos, ingredient, {_struct('id', 'action', 'step_type', 'temperature', 'produces')} AS step, {', '.join(_REFS)} FROM ({rows}) r"


#: The same rows as Spark reads them: line items are dealt by order once, before they are sorted, so that what groups by recipe needs no
#: other shuffle; what a line item gives several rows for is read once.
SPARK_VIEWS = VIEWS | {
    "lines": VIEWS["lines"].replace("FROM lineitem l", "FROM (SELECT /*+ REPARTITION(l_orderkey) */ * FROM lineitem) l"),
    "graph_refs": f"""SELECT * FROM (SELECT l_orderkey AS rid, l_linenumber AS pos, inline(array({", ".join(f"named_struct('kind', '{kind}', 'ref', {x})" for kind, refs in _REFS.items() for x in refs)})) FROM lines) r
        WHERE ref IS NOT NULL""",
    "loose_refs": """SELECT rid, pos, inline(CASE WHEN name <> '' THEN array(first, other) ELSE array(other) END) FROM (SELECT rid, pos, name, named_struct('kind', kind, 'k', k, 'ref', ref) AS first,
        named_struct('kind', 'requires', 'k', 100, 'ref', concat('st_', CAST((rid + pos) % 8 AS VARCHAR(9)), '_4')) AS other FROM ("""
        + VIEWS["loose_refs"].partition(" FROM ingredients WHERE")[0].replace("SELECT rid, pos,", "SELECT rid, pos, name,") + " FROM ingredients) r) x",
    "doc_heads": VIEWS["doc_heads"].replace("FROM recipes", "FROM (" + VIEWS["recipes"].replace("FROM orders", "FROM (SELECT /*+ REPARTITION(o_orderkey) */ * FROM orders") + ") o) r"),
    "doc_lines": _document_lines(),
    "planned": VIEWS["planned"].replace("JOIN recipes", "JOIN (SELECT /*+ REPARTITION(rid) */ * FROM recipes) r"),
}
#: Views whose tables are dealt into tasks by their number of rows, where merged partitions take rows up to 64 MB, and any number of rows once all
#: of them are that full. A task that writes for more than 200 others keeps its rows in memory (Spark's bypassMergeThreshold): up to 200 tasks
#: take FEW_ROWS each, then they fill up to MANY_ROWS before there are more.
DEALT_BY_ROWS = ("planned",)
FEW_ROWS, MANY_ROWS = 250_000, 1_500_000
BASE = ("lineitem", "part", "orders", "customer", "events", "nation", "documents", "pages", "labels", "embeddings", "conversations")


def _needed(text: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", text)]


def _order(text: str, done: list[str], known: dict[str, str]) -> list[str]:
    for n in _needed(text, known):
        if n not in done:
            _order(known[n], done, known)
            done.append(n)
    return done


def with_views(sql: str, known: dict[str, str] = VIEWS) -> str:
    """``sql`` with the views that it reads as common table expressions; it may begin with its own WITH."""
    views = _order(sql, [], known)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    head = "WITH " + (own[1] or "" if own else "")
    listed = ",\n".join(f"{n} AS ({known[n]})" for n in views)
    rest = sql[own.end() :] if own else sql
    if not views:
        return sql
    return f"{head}{listed}" + (",\n" + rest if own else "\n" + rest)


def tasks_for(rows: int) -> int:
    """Into how many tasks that many rows are dealt."""
    return max(min(-(-rows // FEW_ROWS), 200), -(-rows // MANY_ROWS))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, as a DataFrame."""
    if name not in SPARK_VIEWS:
        return table(spark, sf_dir, name)
    text = with_views(f"SELECT * FROM {name}", SPARK_VIEWS)
    for case, read in _PICKED.items():
        text = text.replace(case, read)
    text = text.replace("{", "{{").replace("}", "}}")
    frames = {n: table(spark, sf_dir, n) for n in _needed(text, BASE)}
    if name in DEALT_BY_ROWS:
        tasks = max(spark.sparkContext.defaultParallelism, tasks_for(sum(df.count() for df in frames.values())))
        text = text.replace("REPARTITION(", f"REPARTITION({tasks}, ")
    for n in frames:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **frames)
