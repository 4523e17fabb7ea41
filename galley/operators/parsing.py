"""Lines of preformatted recipes, and the references of steps to what the lines and other steps name.

A line reads ``- 250g «champignons» [250g mushrooms, sliced] {produce} (frais), émincés``: the name in its language,
the line in English, a category, notes and a preparation. Quantity, unit and name come from the English part by a
grammar: number (whole, decimal, fraction, whole and fraction), unit, ``of``, name, comma, preparation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions import text
from galley.functions.units import lookup
from galley.operators.kitchen import ALONE, PLAIN_UNITS, PLURALS, SIZES, _case, _quoted, mended_quantity
from galley.operators.names import PARSED_UNITS
from galley.operators.scalars import FOLD
from galley.plans.adapters import view, with_views
from galley.plans.catalog import Catalog
from galley.tables import computed

catalog = Catalog()
# Categories of ingredients, and words in brackets that say that an ingredient can be left out.
CATEGORIES = ["meat", "poultry", "seafood", "produce", "dairy", "egg", "grain", "legume", "nuts_seeds", "oil", "herb", "pantry", "spice", "condiment", "beverage", "other"]
LIGATURES = {"œ": "oe", "æ": "ae", "ß": "ss"}
OPTIONAL = ["optionnel", "optional", "à volonté"]

_UNITS = "|".join(sorted({*PARSED_UNITS, *PARSED_UNITS.values(), *PLAIN_UNITS, *PLURALS, *(f"{s} {u}" for s in SIZES for u in (*PARSED_UNITS, *PLAIN_UNITS))}, key=lambda u: (-len(u), u)))
NUMBER = r"^([0-9]+ +[0-9]+/[0-9]+|[0-9]+/[0-9]+|[0-9]+(?:[.][0-9]+)?)"
COUNTED = rf"(?i)^({_UNITS})(?: +of)? +"
UNCOUNTED = rf"(?i)^({_UNITS}) +of +"
SECTION = r"(?s)(?:^|\n)INGREDIENTS:[ \t\r\f]*\n(.*?)(?:\n(?:INSTRUCTIONS|TOOLS|NOTES):|$)"
_MARKS = {"name": "«([^»]+)»", "category": "[{]([A-Za-z0-9_]+)[}]", "english": r"\[([^\]]+)\]", "bracketed": r"\(([^)]+)\)"}
_AFTER = rf"[}}]\s*(?:\((?:{'|'.join(OPTIONAL)})\)\s*)?,\s*(.+)$"


def add(name: str, f, sql: str) -> None:
    catalog.add(name, f, with_views(sql))


def number(c: Column) -> Column:
    """The value of ``2``, ``0.5``, ``1/2`` and ``1 1/2``; null for others and for a division by 0."""
    parts = F.transform(F.split(F.trim(c), " +"), lambda p: F.when(p.contains("/"), F.try_divide(F.split_part(p, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(p, F.lit("/"), F.lit(2)).try_cast("double"))).otherwise(p.try_cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def one_of(words: list[str]) -> str:
    """A pattern of any of these words, the longest that fits first, as an alternation of them; each letter is looked at once."""
    heads: dict[str, list[str]] = {}
    for w in filter(None, words):
        heads.setdefault(w[0], []).append(w[1:])
    rest = "|".join(c + one_of(tails) for c, tails in heads.items())
    return f"(?:{rest})" + "?" * ("" in words) if heads else ""


_ANY_UNIT = one_of(sorted({u.lower() for u in _UNITS.split("|")}))
COUNTED_UNIT, UNCOUNTED_UNIT = (p.replace(_UNITS, _ANY_UNIT) for p in (COUNTED, UNCOUNTED))


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def english(c: Column) -> Column:
    """(quantity, unit, name, preparation) of an English line."""
    line = F.trim(c)
    told = F.struct(F.regexp_extract(line, NUMBER, 1).alias("said"), F.trim(F.regexp_replace(line, NUMBER, "")).alias("rest"))

    def split(x: Column) -> Column:
        said, rest = x["said"], x["rest"]
        unit = F.when(said != "", F.regexp_extract(rest, COUNTED_UNIT, 1)).otherwise(F.regexp_extract(rest, UNCOUNTED_UNIT, 1))
        bare = F.when(said != "", F.regexp_replace(rest, COUNTED_UNIT, "")).otherwise(F.regexp_replace(rest, UNCOUNTED_UNIT, ""))
        return F.struct(said.alias("said"), F.lower(F.nullif(unit, F.lit(""))).alias("low"), bare.alias("bare"))

    def parts(x: Column) -> Column:
        name = F.nullif(F.trim(F.split_part(x["bare"], F.lit(","), F.lit(1))), F.lit(""))
        after = F.nullif(F.trim(F.regexp_replace(x["bare"], "^[^,]*,?", "")), F.lit(""))
        short = F.coalesce(lookup(PARSED_UNITS, x["low"]), x["low"])
        return F.struct(F.when(x["said"] != "", number(x["said"])).alias("quantity"), short.alias("unit"), name.alias("name"), after.alias("preparation"))

    return text.let(text.let(told, split), parts)


def make_id(c: Column) -> Column:
    """Lower case without accents and signs, ligatures spelt out, blanks as underscores."""
    spelt = F.lower(c)
    for one, two in LIGATURES.items():
        spelt = F.replace(spelt, F.lit(one), F.lit(two))
    return F.regexp_replace(F.regexp_replace(F.trim(text.fold(spelt)), r"[^a-z0-9\s]", ""), r"\s+", "_")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (.., line) that name something in «», with id, name, name_en, quantity, unit, category, preparation, notes, optional and source."""
    keys = [c for c in lines.columns if c != "line"]
    rows = lines.withColumn("line", F.regexp_replace(F.trim("line"), "^- ", "")).withColumn("name", F.regexp_extract("line", _MARKS["name"], 1)).where("name <> ''")
    rows = computed(computed(rows, line=F.col("line"), given=_found(F.col("line"), _MARKS["english"])), e=english(F.col("given")))
    note = F.get(F.filter(F.regexp_extract_all("line", F.lit(_MARKS["bracketed"]), F.lit(1)), lambda n: ~F.lower(n).isin(*OPTIONAL)), F.lit(0))
    own = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract("line", _AFTER, 1), r"\[[^\]]+\]", "")), ",+$", ""))
    category = text.let(_found(F.col("line"), _MARKS["category"]), lambda x: F.when(x.isin(*CATEGORIES), x).otherwise("other"))
    rows = computed(
        rows, name=F.trim("name"), name_en=F.coalesce("e.name", "given", F.trim("name")), m=mended_quantity(F.col("e.quantity"), F.col("e.unit")), note=note, category=category,
        preparation=F.coalesce(F.nullif(own, F.lit("")), F.col("e.preparation")), optional=F.lower("line").rlike("|".join(rf"\({o}\)" for o in OPTIONAL)),
    )
    notes = F.when(F.col("m.modifier").isNotNull(), F.concat_ws("; ", "m.modifier", "note")).otherwise(F.col("note"))
    return rows.select(*keys, make_id(F.col("name_en")).alias("id"), "name", "name_en", "m.quantity", "m.unit", "category", "preparation", notes.alias("notes"), "optional", F.col("m.source").alias("source"))


def parsed_documents(docs: DataFrame) -> DataFrame:
    """The parsed lines of the INGREDIENTS section of each ``docs`` (doc, text), in order ``n``; ids that repeat get _1, _2 and so on."""
    section = F.split(F.regexp_extract("text", SECTION, 1), "\n")
    lines = docs.select("doc", F.posexplode(section).alias("n", "line")).withColumn("line", F.trim("line"))
    marked = (F.col("line").contains("«") & F.col("line").contains("»")) | F.col("line").rlike("^(- |[0-9])")
    rows = parsed_lines(lines.where(marked & ~F.col("line").startswith("**")))
    again = F.row_number().over(Window.partitionBy("doc", "id").orderBy("n")) - 1
    return rows.withColumn("again", again).withColumn("id", F.when(F.col("again") > 0, F.concat("id", F.lit("_"), F.col("again").cast("string"))).otherwise(F.col("id"))).drop("again")


def corrected_references(refs: DataFrame, steps: DataFrame, ingredients: DataFrame, earlier: bool = False) -> DataFrame:
    """(rid, pos, uses, requires): each step's references as ids that exist, in their order; others are dropped.

    refs (rid, pos, kind, k, ref), steps (rid, pos, produces), ingredients (rid, pos, id, name, name_en). A
    reference is an id itself, or one that differs in its number only, or names an ingredient: as a whole, else
    the shortest name that holds it, or stands in it, as whole words. ``uses`` means ingredients and states,
    ``requires`` states. With ``earlier`` a step sees only states that steps before it produce.

    A recipe's names and states are gathered once, and its steps are corrected in one pass over them.
    """
    both = F.explode(F.filter(F.array(F.struct((F.col("pos") * 2).alias("o"), F.col("name").alias("name")), F.struct((F.col("pos") * 2 + 1).alias("o"), F.col("name_en").alias("name"))), lambda x: F.coalesce(x["name"], F.lit("")) != ""))
    names = ingredients.select("rid", "id", both.alias("x")).groupBy("rid", "x.name").agg(F.min("x.o").alias("o"), F.max_by("id", "x.o").alias("id"))
    names = names.withColumn("n", F.lower(F.trim("name"))).where("n <> ''")
    names = names.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("o", "n", "id"))).alias("names"))
    ids = ingredients.groupBy("rid").agg(F.collect_set("id").alias("ids"))
    made = steps.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", F.nullif("produces", F.lit("")).alias("s")))).alias("made"))
    asked = refs.where("ref is not null").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "k", "kind", "ref"))).alias("refs"))
    rows = made.join(asked, "rid", "left").join(ids, "rid", "left").join(names, "rid", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    rows = rows.select("rid", "made", none("refs", "array<struct<pos:int,k:int,kind:string,ref:string>>"), none("ids", "array<string>"), none("names", "array<struct<o:int,n:string,id:string>>"))
    rows = computed(rows, **{c: F.col(c) for c in ("refs", "ids", "names")})
    edge = r"[\p{L}\p{N}_]"

    def holds(whole: Column, part: Column) -> Column:
        # few names hold another at all, and a pattern of its own is dear
        return whole.contains(part) & (F.regexp_count(whole, F.concat(F.lit(rf"(?<!{edge})\Q"), part, F.lit(rf"\E(?!{edge})"))) > 0)

    def by_number(base: Column, valid: Column) -> Column:
        tries = F.concat(F.array(base), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda n: F.concat(base, F.lit("_"), n.cast("string"))))
        return F.when(base != "", F.get(F.filter(tries, lambda x: F.array_contains(valid, x)), F.lit(0)))

    def by_name(r: Column) -> Column:
        equal = F.get(F.filter("names", lambda x: x["n"] == r), F.lit(0))["id"]
        near = F.array_min(F.transform(F.filter("names", lambda x: holds(x["n"], r) | holds(r, x["n"])), lambda x: F.struct(F.length(x["n"]).alias("l"), x["o"].alias("o"), x["id"].alias("id"))))["id"]
        return F.when(r != "", F.coalesce(equal, near))

    def found(ref: Column, valid: Column) -> Column:
        number = text.let(F.regexp_extract(ref, r"^(.+?)_\d+$", 1), lambda base: by_number(base, valid))
        return F.when(F.array_contains(valid, ref), ref).otherwise(F.coalesce(number, text.let(F.trim(F.translate(F.lower(ref), "_", " ")), by_name)))

    def kept(step: Column, kind: str) -> Column:
        states = F.transform(F.filter("made", lambda x: x["s"].isNotNull() & ((x["pos"] < step["pos"]) if earlier else F.lit(True))), lambda x: x["s"])
        own = F.filter("refs", lambda x: (x["pos"] == step["pos"]) & (x["kind"] == kind))
        ids = lambda valid: F.array_join(F.filter(F.transform(own, lambda x: found(x["ref"], valid)), lambda x: x.isNotNull()), ",")
        return text.let(F.concat("ids", states) if kind == "uses" else states, ids)

    rows = rows.select("rid", F.inline(F.transform("made", lambda st: F.struct(st["pos"].alias("pos"), kept(st, "uses").alias("uses"), kept(st, "requires").alias("requires")))))
    return rows


# --- queries ---
_ID = lambda e: f"regexp_replace(regexp_replace(trim({FOLD(f"replace(replace(replace(lower({e}), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss')")}), '[^a-z0-9\\s]', '', 'g'), '\\s+', '_', 'g')"
_ALONE_Q, _ALONE_U = ({k: v[i] for k, v in ALONE.items()} for i in (0, 1))
_VALUE = lambda e: f"(CASE WHEN strpos({e}, '/') > 0 THEN TRY_CAST(split_part({e}, '/', 1) AS DOUBLE) / nullif(TRY_CAST(split_part({e}, '/', 2) AS DOUBLE), 0) ELSE TRY_CAST({e} AS DOUBLE) END)"
_PARSED = f"""l0 AS (SELECT * REPLACE (regexp_replace(trim(line), '^- ', '') AS line) FROM raw_lines),
  l1 AS (SELECT *, regexp_extract(line, '{_MARKS["name"]}', 1) AS name, nullif(regexp_extract(line, '{_MARKS["english"]}', 1), '') AS given, regexp_extract(line, '{_MARKS["category"]}', 1) AS cat,
    list_filter(regexp_extract_all(line, '{_MARKS["bracketed"]}', 1), lambda n: lower(n) NOT IN {_quoted(OPTIONAL)})[1] AS note,
    nullif(trim(regexp_replace(trim(regexp_replace(regexp_extract(line, '{_AFTER}', 1), '\\[[^\\]]+\\]', '', 'g')), ',+$', '')), '') AS own FROM l0),
  l2 AS (SELECT *, regexp_extract(trim(given), '{NUMBER}', 1) AS said, trim(regexp_replace(trim(given), '{NUMBER}', '')) AS rest FROM l1 WHERE name <> ''),
  l3 AS (SELECT *, nullif(lower(CASE WHEN said <> '' THEN regexp_extract(rest, '{COUNTED}', 1) ELSE regexp_extract(rest, '{UNCOUNTED}', 1) END), '') AS u,
    CASE WHEN said <> '' THEN regexp_replace(rest, '{COUNTED}', '') ELSE regexp_replace(rest, '{UNCOUNTED}', '') END AS bare,
    CASE WHEN said <> '' THEN coalesce({_VALUE("split_part(said, ' ', 1)")}, NULL) + CASE WHEN strpos(said, ' ') > 0 THEN {_VALUE("regexp_replace(said, '^.* ', '')")} ELSE 0 END END AS q FROM l2),
  l4 AS (SELECT *, coalesce({_case("u", PARSED_UNITS)}, u) AS unit0 FROM l3),
  l5 AS (SELECT *, coalesce({_case("lower(trim(unit0))", PLURALS)}, lower(trim(unit0))) AS low FROM l4),
  l6 AS (SELECT *, split_part(low, ' ', 1) AS head, trim(regexp_replace(low, '^[^ ]* ?', '')) AS tail FROM l5),
  l7 AS (SELECT *, coalesce({_case("tail", PARSED_UNITS)}, {_case("tail", PLURALS)}, tail) AS whole, coalesce({_case("low", PARSED_UNITS)}, low) AS short FROM l6),
  l8 AS (SELECT *, coalesce(head IN {_quoted(SIZES)} AND (whole IN {_quoted(PLAIN_UNITS)} OR tail IN {_quoted(PARSED_UNITS)}), false) AS sized, coalesce(low IN {_quoted(ALONE)} AND q IS NULL, false) AS alone,
    coalesce(short IN {_quoted(PLAIN_UNITS)} AND q IS NULL, false) AS single FROM l7),
  l9 AS (SELECT *, coalesce(nullif(trim(split_part(bare, ',', 1)), ''), given, trim(name)) AS name_en, CASE WHEN sized THEN head WHEN alone THEN low END AS modifier FROM l8),
  parsed AS (SELECT * EXCLUDE (name, unit0), trim(name) AS name, {_ID("name_en")} AS id, CASE WHEN sized THEN floor(coalesce(q, 1) * CAST({_case("head", SIZES)} AS DOUBLE) * 100 + 0.5) / 100 WHEN alone THEN CAST({_case("low", _ALONE_Q)} AS DOUBLE) WHEN single THEN 1.0 ELSE q END AS quantity,
    CASE WHEN sized THEN whole WHEN alone THEN {_case("low", _ALONE_U)} WHEN short <> low OR single THEN short ELSE unit0 END AS unit, CASE WHEN cat IN {_quoted(CATEGORIES)} THEN cat ELSE 'other' END AS category,
    coalesce(own, nullif(trim(regexp_replace(bare, '^[^,]*,?', '')), '')) AS preparation, CASE WHEN modifier IS NULL THEN note ELSE concat_ws('; ', modifier, note) END AS notes,
    regexp_matches(lower(line), '{"|".join(f"[(]{o}[)]" for o in OPTIONAL)}') AS optional, CASE WHEN sized OR alone OR single THEN 'inferred' END AS source FROM l9)"""
_PARTS = "name, name_en, quantity, unit, category, preparation, notes, optional, source"
add("STR-25_preformat_lines", lambda s, d: parsed_lines(view(s, d, "preformat_lines")), f"WITH raw_lines AS (SELECT * FROM preformat_lines), {_PARSED} SELECT rid, pos, id, {_PARTS} FROM parsed")


def _documents(s, d) -> DataFrame:
    rows = view(s, d, "preformat_lines").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    body = F.concat(F.lit("TITLE: x\n\nINGREDIENTS:\n**Base:**\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.when(F.col("rid") % 2 == 0, "\nINSTRUCTIONS:\n1. «x» [1 y] {oil}").otherwise(""))
    return rows.select(F.col("rid").alias("doc"), F.when(F.col("rid") % 10 == 3, F.lit("INSTRUCTIONS:\nnone")).otherwise(body).alias("text"))


add("STR-25_preformat_documents", lambda s, d: parsed_documents(_documents(s, d)), f"""WITH raw_lines AS (SELECT rid, pos, line FROM preformat_lines WHERE rid % 10 <> 3), {_PARSED},
  p AS (SELECT *, row_number() OVER (PARTITION BY rid, id ORDER BY pos) - 1 AS again FROM parsed), n AS (SELECT rid, pos, row_number() OVER (PARTITION BY rid ORDER BY pos) AS n FROM preformat_lines)
  SELECT p.rid AS doc, CAST(n.n AS INTEGER) AS n, CASE WHEN again > 0 THEN concat(p.id, '_', again) ELSE p.id END AS id, {_PARTS} FROM p JOIN n ON n.rid = p.rid AND n.pos = p.pos""")  # fmt: skip

_padded = lambda e: f"(' ' || regexp_replace({e}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' ')"
_holds = lambda a, b: f"(contains({a}, {b}) AND contains({_padded(a)}, {_padded(b)}))"


def _corrected(earlier: str) -> str:
    return f"""WITH nm0 AS (SELECT rid, id, pos * 2 AS o, name FROM named_ids WHERE coalesce(name, '') <> '' UNION ALL SELECT rid, id, pos * 2 + 1, name_en FROM named_ids WHERE coalesce(name_en, '') <> ''),
  nm AS (SELECT rid, lower(trim(name)) AS n, min(o) AS o, arg_max(id, o) AS id FROM nm0 GROUP BY rid, name),
  st AS (SELECT rid, pos, produces AS s FROM graph_steps WHERE coalesce(produces, '') <> ''),
  r AS (SELECT *, regexp_extract(ref, '^(.+?)_[0-9]+$', 1) AS base, trim(replace(lower(ref), '_', ' ')) AS r FROM loose_refs WHERE ref IS NOT NULL),
  v AS (SELECT DISTINCT r.rid, r.pos, r.k, r.kind, r.ref, s.s AS id FROM r JOIN st s ON s.rid = r.rid {earlier} UNION SELECT r.rid, r.pos, r.k, r.kind, r.ref, i.id FROM r JOIN named_ids i ON i.rid = r.rid AND r.kind = 'uses'),
  t AS (SELECT v.rid, v.pos, v.k, v.kind, v.ref, v.id, CASE WHEN v.id = r.ref THEN 0 WHEN r.base <> '' AND v.id = r.base THEN 1 WHEN r.base <> '' THEN list_position([r.base || '_1', r.base || '_2', r.base || '_3', r.base || '_4', r.base || '_5'], v.id) + 1 END AS rank, 0 AS l, 0 AS o
    FROM v JOIN r USING (rid, pos, k, kind, ref)
    UNION ALL SELECT r.rid, r.pos, r.k, r.kind, r.ref, nm.id, CASE WHEN nm.n = r.r THEN 10 ELSE 11 END, CASE WHEN nm.n = r.r THEN 0 ELSE length(nm.n) END, nm.o FROM r JOIN nm ON nm.rid = r.rid AND nm.n <> '' AND r.r <> '' AND ({_holds('nm.n', 'r.r')} OR {_holds('r.r', 'nm.n')})),
  b AS (SELECT * FROM t WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rid, pos, k, kind, ref ORDER BY rank, l, o) = 1)
  SELECT s.rid, s.pos, coalesce(string_agg(b.id, ',' ORDER BY b.k, b.ref) FILTER (WHERE b.kind = 'uses'), '') AS uses, coalesce(string_agg(b.id, ',' ORDER BY b.k, b.ref) FILTER (WHERE b.kind = 'requires'), '') AS requires
  FROM graph_steps s LEFT JOIN b ON b.rid = s.rid AND b.pos = s.pos GROUP BY s.rid, s.pos"""


_of = lambda s, d: (view(s, d, "loose_refs"), view(s, d, "graph_steps"), view(s, d, "named_ids"))
add("JOI-23_step_references", lambda s, d: corrected_references(*_of(s, d)), _corrected(""))
add("JOI-23_step_references_in_order", lambda s, d: corrected_references(*_of(s, d), earlier=True), _corrected("AND s.pos < r.pos"))

QUERIES, SQL = catalog.queries, catalog.sql
