"""Graphs of steps, states, ingredients and tools.

A step uses ingredients and states, requires tools or states, and produces a state. A recipe's graph is a
document: it is gathered once by recipe, and what runs to a fixpoint (peeling, longest paths, ancestors) runs
inside its arrays, as many rounds as it has steps, without another shuffle.

Frames: steps (rid, pos, id, sub, action, duration, passive, done, produces), refs (rid, pos, kind 'uses' or
'requires', ref), ingredients (rid, id, name), recipes (rid, final_state).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import time
from galley.functions.units import rounded, sql_rounded
from galley.plans.adapters import view, with_views
from galley.plans.catalog import Catalog
from galley.tables import computed

catalog = Catalog()
# Words of steps that only ready the equipment, minutes of a step without a duration.
EQUIPMENT = ["preheat", "préchauffer", "allumer", "préparer le four"]
UNTIMED = 5.0


def add(name: str, f, sql: str) -> None:
    catalog.add(name, f, with_views(sql))


def step_minutes(duration: Column, action: Column) -> Column:
    """Minutes of a step: as written, else 0 for readying equipment and five for the rest."""
    readies = F.lower(F.coalesce(action, F.lit(""))).rlike("|".join(EQUIPMENT))
    return F.when(F.coalesce(duration, F.lit("")) != "", time.legacy_minutes(duration)).when(readies, 0.0).otherwise(UNTIMED)


def networks(steps: DataFrame, refs: DataFrame, ingredients: DataFrame, within: list[str], first: bool = False) -> DataFrame:
    """Steps of each group ``within`` in order of position, as an array ``nodes``, with the places of their predecessors.

    A step precedes another that refers to the state it produces; where several produce a state the last
    counts, or the ``first``. Refs to ingredients, to itself and to states that nothing produces are none.
    """
    none = F.array().cast("array<string>")
    known = ingredients.groupBy("rid").agg(F.collect_set("id").alias("known"))
    asked = refs.where("ref is not null").groupBy("rid").agg(F.collect_set(F.struct("pos", "ref")).alias("asked"))
    step = F.struct("pos", "id", step_minutes(F.col("duration"), F.col("action")).alias("m"), F.coalesce("passive", F.lit(False)).alias("passive"), F.coalesce("done", F.lit(False)).alias("done"), F.nullif("produces", F.lit("")).alias("produces"))
    rows = steps.groupBy(*within).agg(F.sort_array(F.collect_list(step)).alias("rows")).join(asked, "rid", "left").join(known, "rid", "left")
    rows = computed(rows, asked=F.filter("asked", lambda x: ~F.array_contains(F.coalesce("known", none), x["ref"])))
    refs_of = lambda x: F.coalesce(F.transform(F.filter("asked", lambda r: r["pos"] == x["pos"]), lambda r: r["ref"]), none)
    rows = computed(rows, rows=F.transform("rows", lambda x: x.withField("refs", refs_of(x))))
    made = F.transform("rows", lambda x: x["produces"])
    rows = computed(rows.select(*within, "rows", (made if first else F.reverse(made)).alias("made")), rows=F.col("rows"), made=F.col("made"))
    at = lambda ref: F.array_position("made", ref).cast("int")
    place = (lambda ref: at(ref) - 1) if first else (lambda ref: F.size("rows") - at(ref))
    own = lambda x, i: F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(x["refs"], lambda r: at(r) > 0), place), lambda p: p != i)))
    return rows.select(*within, "made", F.transform("rows", lambda x, i: F.struct(x["pos"].alias("pos"), x["id"].alias("id"), x["m"].alias("m"), x["passive"].alias("passive"), x["done"].alias("done"), own(x, i).alias("before"))).alias("nodes"))


def peeled(networks: DataFrame) -> DataFrame:
    """``networks`` with ``free``: whether each step can be reached by always taking one whose predecessors were taken; a cycle keeps itself and what follows it."""
    none = F.transform("nodes", lambda x: F.lit(False))
    again = lambda free: F.transform("nodes", lambda x, i: F.get(free, i) | F.forall(x["before"], lambda p: F.get(free, p)))
    return computed(networks, free=F.aggregate("nodes", none, lambda free, _: again(free)))


def acyclicity(networks: DataFrame) -> DataFrame:
    """(rid, steps, taken, kept, acyclic): kept are the positions that a cycle keeps from being taken."""
    kept = F.filter(F.transform("nodes", lambda x, i: F.when(~F.get("free", i), x["pos"])), lambda p: p.isNotNull())
    rows = peeled(networks).select("rid", F.size("nodes").alias("steps"), kept.alias("kept"))
    return rows.select("rid", "steps", (F.col("steps") - F.size("kept")).alias("taken"), F.concat_ws(",", F.transform("kept", lambda p: p.cast("string"))).alias("kept"), (F.size("kept") == 0).alias("acyclic"))


def critical_times(networks: DataFrame, recipes: DataFrame) -> DataFrame:
    """(rid, total, active, passive, total_iso, active_iso, passive_iso) along the critical path.

    The path ends at the step that produces the final state, or else where the earliest finish is the latest, of
    equals the first. It goes back over the predecessor that finishes last, of equals the first. In a recipe with a
    cycle only predecessors that stand earlier count. A recipe without steps takes no time.
    """
    rows = computed(peeled(networks), free=F.forall("free", lambda f: f))
    before = lambda x, i: F.when(F.col("free"), x["before"]).otherwise(F.filter(x["before"], lambda p: p < i))
    rows = rows.withColumn("nodes", F.transform("nodes", lambda x, i: F.struct(x["m"].alias("m"), x["passive"].alias("passive"), before(x, i).alias("before"))))
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("a"), F.lit(0.0).alias("p"))

    def after(times: Column, x: Column) -> Column:
        last = F.aggregate(x["before"], zero, lambda best, p: F.when(F.get(times, p)["t"] > best["t"], F.get(times, p)).otherwise(best))
        active, passive = F.when(x["passive"], 0.0).otherwise(x["m"]), F.when(x["passive"], x["m"]).otherwise(0.0)
        return F.transform(F.array(last), lambda b: F.struct((b["t"] + x["m"]).alias("t"), (b["a"] + active).alias("a"), (b["p"] + passive).alias("p")))[0]

    times = F.aggregate("nodes", F.transform("nodes", lambda x: zero), lambda t, _: F.transform("nodes", lambda x: after(t, x)))
    rows = rows.select("rid", "made", times.alias("times")).join(recipes.select("rid", "final_state"), "rid", "right")
    place = F.array_position("made", F.nullif("final_state", F.lit("")))
    latest = F.array_max(F.transform("times", lambda x, i: F.struct(x["t"].alias("t"), (-i).alias("i"), x["a"].alias("a"), x["p"].alias("p"))))
    end = F.when(place > 0, F.get("times", (F.size("made") - place).cast("int"))).otherwise(F.struct(latest["t"].alias("t"), latest["a"].alias("a"), latest["p"].alias("p")))
    rows = rows.select("rid", F.when(F.col("times").isNull(), zero).otherwise(end).alias("e"))
    iso = [time.minutes_iso(F.col(f"e.{c}")).alias(n) for c, n in (("t", "total_iso"), ("a", "active_iso"), ("p", "passive_iso"))]
    return rows.select("rid", *[rounded(F.col(f"e.{c}"), 1).alias(n) for c, n in (("t", "total"), ("a", "active"), ("p", "passive"))], *iso)


def back_completion(networks: DataFrame) -> DataFrame:
    """(rid, sub, pos, done) after the last step of each sub-recipe is ticked off: it and all that it rests on are done too."""
    last = F.array(F.size("nodes") - 1)
    rests = lambda seen: F.array_distinct(F.concat(seen, F.flatten(F.transform(seen, lambda p: F.get("nodes", p)["before"]))))
    rows = computed(networks, seen=F.aggregate("nodes", last, lambda seen, _: rests(seen)))
    done = F.transform("nodes", lambda x, i: F.struct(x["pos"].alias("pos"), (x["done"] | F.array_contains("seen", i)).alias("done")))
    return rows.select("rid", "sub", F.inline(done))


def consumers(steps: DataFrame, refs: DataFrame, ingredients: DataFrame) -> DataFrame:
    """(rid, sub, kind, item, done) of each use of an ingredient, a state that the sub-recipe produces, or a tool."""
    made = steps.groupBy("rid").agg(F.collect_list(F.struct("pos", "sub", F.coalesce("done", F.lit(False)).alias("done"), F.nullif("produces", F.lit("")).alias("produces"))).alias("steps"))
    asked = refs.groupBy("rid").agg(F.collect_list(F.struct("pos", "kind", "ref")).alias("asked"))
    known = ingredients.groupBy("rid").agg(F.collect_set("id").alias("known"))
    rows = asked.join(made, "rid").join(known, "rid", "left")
    of = lambda r: F.transform(F.filter("steps", lambda x: x["pos"] == r["pos"]), lambda x: F.struct(x["sub"].alias("sub"), r["kind"].alias("kind"), r["ref"].alias("item"), x["done"].alias("done")))
    uses = rows.select("rid", "steps", "known", F.explode(F.flatten(F.transform("asked", of))).alias("u"))
    own = F.exists("steps", lambda x: (x["sub"] == F.col("u.sub")) & (x["produces"] == F.col("u.item")))
    kind = F.when((F.col("u.kind") == "uses") & F.array_contains("known", F.col("u.item")), "ingredient").when(own, "state").when(F.col("u.kind") == "requires", "tool")
    return computed(uses.select("rid", "u.sub", kind.alias("kind"), "u.item", "u.done"), kind=F.col("kind")).select("rid", "sub", "kind", "item", "done").where("kind is not null")


def unused_items(uses: DataFrame) -> DataFrame:
    """(rid, kind, sub, item) that no step needs any more; tools and states are of the recipe, with an empty ``sub``.

    An item that a completed step rests on, by any number of steps, is needed until all steps that take it are
    done. If they are, one of them is that completed step: so whether every taker is done decides alone.
    """
    free = uses.groupBy("rid", "sub", "kind", "item").agg(F.bool_and("done").alias("free")).where("free")
    return free.select("rid", "kind", F.when(F.col("kind") == "ingredient", F.col("sub")).otherwise("").alias("sub"), "item").distinct()


def unused_flags(uses: DataFrame) -> DataFrame:
    """(rid, kind, sub, item, unused) of each ingredient of a sub-recipe and each tool of a recipe."""
    free = uses.where("kind <> 'state'").groupBy("rid", "sub", "kind", "item").agg(F.bool_and("done").alias("free"))
    told = F.col("free") & F.col("item").isNotNull() & F.col("sub").isNotNull()
    return free.groupBy("rid", "kind", F.when(F.col("kind") == "ingredient", F.col("sub")).otherwise("").alias("sub"), "item").agg(F.bool_or(told).alias("unused"))


def unified_edges(steps: DataFrame, refs: DataFrame, ingredients: DataFrame) -> DataFrame:
    """(rid, source, target, type): ingredients and states into steps, steps into the states that they produce."""
    known = ingredients.select("rid", F.col("id").alias("ref")).distinct().withColumn("known", F.lit(True))
    uses = refs.where("kind = 'uses'").join(known, ["rid", "ref"], "left").join(steps.select("rid", "pos", "id"), ["rid", "pos"])
    into = uses.select("rid", F.concat(F.when(F.col("known"), "ing-").otherwise("state-"), "ref").alias("source"), F.concat(F.lit("step-"), "id").alias("target"), F.when(F.col("known"), "ingredient").otherwise("state").alias("type"))
    out = steps.where(F.coalesce("produces", F.lit("")) != "").select("rid", F.concat(F.lit("step-"), "id").alias("source"), F.concat(F.lit("state-"), "produces").alias("target"), F.lit("state").alias("type"))
    return into.unionByName(out)


def unified_nodes(steps: DataFrame, refs: DataFrame, ingredients: DataFrame) -> DataFrame:
    """(rid, node, type, label, grp, final): steps, listed ingredients and every state met; final nodes are targets only.

    A state stands with the sub-recipe that produces it, of several with the one that begins last. Each frame is
    gathered by recipe once; a recipe's edges are two arrays, what they come from and what they go to.
    """
    none, strings = lambda c, like: F.coalesce(c, F.array().cast(like)), "array<string>"
    made = steps.groupBy("rid").agg(F.collect_list(F.struct("pos", F.concat(F.lit("step-"), "id").alias("node"), "action", "sub", F.concat(F.lit("state-"), F.nullif("produces", F.lit(""))).alias("state"))).alias("steps"))
    listed = ingredients.groupBy("rid").agg(F.collect_list(F.struct(F.concat(F.lit("ing-"), "id").alias("node"), "id", "name")).alias("listed"))
    used = refs.where("kind = 'uses'").groupBy("rid").agg(F.collect_set(F.struct("pos", "ref")).alias("used"))
    rows = made.join(used, "rid", "left").join(listed, "rid", "full")
    lists = {n: none(F.col(n), dict(rows.dtypes)[n]) for n in ("steps", "listed", "used")}
    rows = computed(rows, **lists, known=none(F.transform("listed", lambda x: x["id"]), strings))
    taken = F.filter("used", lambda u: F.exists("steps", lambda x: x["pos"] == u["pos"]))
    sources = F.transform(taken, lambda u: F.concat(F.when(F.coalesce(F.array_contains("known", u["ref"]), F.lit(False)), "ing-").otherwise("state-"), u["ref"]))
    makers = F.transform(F.filter("steps", lambda x: x["state"].isNotNull()), lambda x: x["node"])
    takers = F.transform(F.filter("steps", lambda x: F.exists("used", lambda u: x["pos"] == u["pos"])), lambda x: x["node"])
    begins = lambda x: F.array_min(F.transform(F.filter("steps", lambda y: y["sub"] == x["sub"]), lambda y: y["pos"]))
    rows = computed(
        rows, sources=F.array_compact(F.concat(sources, makers)), targets=F.array_compact(F.concat(takers, F.transform("steps", lambda x: x["state"]))),
        stands=F.transform(F.filter("steps", lambda x: x["state"].isNotNull() & x["sub"].isNotNull()), lambda x: F.struct(begins(x).alias("begins"), x["sub"].alias("sub"), x["state"].alias("state"))),
    )
    ends = lambda node: F.coalesce(F.col("rid").isNotNull() & F.array_contains("targets", node) & ~F.array_contains("sources", node), F.lit(False))
    node = lambda node, kind, label, grp: F.struct(node.alias("node"), F.lit(kind).alias("type"), label.alias("label"), grp.alias("grp"), ends(node).alias("final"))
    grp = lambda n: F.array_max(F.filter("stands", lambda y: (y["state"] == n) & y["begins"].isNotNull() & F.col("rid").isNotNull()))["sub"]
    states = F.array_distinct(F.filter(F.concat("sources", "targets"), lambda n: n.startswith("state-")))
    nodes = F.concat(
        F.transform(states, lambda n: node(n, "state", F.replace(F.substring(n, 7, 1000), F.lit("_"), F.lit(" ")), grp(n))),
        F.transform("steps", lambda x: node(x["node"], "action", x["action"], x["sub"])), F.transform("listed", lambda x: node(x["node"], "ingredient", x["name"], F.lit("__ingredients__"))),
    )
    return rows.select("rid", F.inline(nodes))


def _frames(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return view(s, d, "graph_steps"), view(s, d, "graph_refs"), view(s, d, "graph_ingredients")


_TIMED = f"""timed AS (SELECT *, CASE WHEN coalesce(duration, '') <> '' THEN CAST(regexp_extract(duration, '([0-9]+)', 1) AS DOUBLE)
    WHEN regexp_matches(lower(action), '{"|".join(EQUIPMENT)}') THEN 0e0 ELSE 5e0 END AS m FROM graph_steps)"""
_BEFORE = """made AS (SELECT rid, produces, max(pos) AS pos FROM graph_steps WHERE coalesce(produces, '') <> '' GROUP BY rid, produces),
  before AS (SELECT DISTINCT r.rid, r.pos, m.pos AS prev FROM graph_refs r JOIN made m ON m.rid = r.rid AND m.produces = r.ref
    WHERE r.pos <> m.pos AND NOT EXISTS (SELECT 1 FROM graph_ingredients g WHERE g.rid = r.rid AND g.id = r.ref)),
  reach(rid, a, b) AS (SELECT rid, prev, pos FROM before UNION SELECT r.rid, r.a, e.pos FROM reach r JOIN before e ON e.rid = r.rid AND e.prev = r.b)"""
add("GRF-6_acyclicity", lambda s, d: acyclicity(networks(*_frames(s, d), ["rid"])), f"""WITH RECURSIVE {_BEFORE},
  kept AS (SELECT DISTINCT k.rid, k.pos FROM (SELECT rid, a AS pos FROM reach WHERE a = b UNION ALL SELECT r.rid, r.b FROM reach r JOIN reach c ON c.rid = r.rid AND c.a = r.a AND c.a = c.b) k)
  SELECT s.rid, CAST(count(*) AS INTEGER) AS steps, CAST(count(*) - count(k.pos) AS INTEGER) AS taken, coalesce(string_agg(CAST(k.pos AS VARCHAR), ',' ORDER BY k.pos), '') AS kept, count(k.pos) = 0 AS acyclic
  FROM graph_steps s LEFT JOIN kept k ON k.rid = s.rid AND k.pos = s.pos GROUP BY s.rid""")  # fmt: skip
_ISO = lambda e: f"CASE WHEN {e} <= 0 THEN 'PT0M' ELSE concat('PT', CASE WHEN round_even({e}, 0) >= 60 THEN concat(CAST(CAST(round_even({e}, 0) AS BIGINT) // 60 AS VARCHAR), 'H') ELSE '' END, CASE WHEN CAST(round_even({e}, 0) AS BIGINT) % 60 > 0 OR round_even({e}, 0) < 60 THEN concat(CAST(CAST(round_even({e}, 0) AS BIGINT) % 60 AS VARCHAR), 'M') ELSE '' END) END"
add("GRF-1_critical_times", lambda s, d: critical_times(networks(*_frames(s, d), ["rid"]), view(s, d, "graph_recipes")), f"""WITH RECURSIVE {_BEFORE}, {_TIMED},
  counted AS (SELECT * FROM before e WHERE e.prev < e.pos OR NOT EXISTS (SELECT 1 FROM reach c WHERE c.rid = e.rid AND c.a = c.b)),
  chain(rid, pos, t, a, path) AS (
    SELECT rid, pos, m, CASE WHEN passive THEN 0e0 ELSE m END, CAST([] AS INTEGER[]) FROM timed
    UNION ALL SELECT c.rid, e.pos, c.t + s.m, c.a + CASE WHEN s.passive THEN 0e0 ELSE s.m END, list_prepend(CAST(e.prev AS INTEGER), c.path) FROM chain c JOIN counted e ON e.rid = c.rid AND e.prev = c.pos JOIN timed s ON s.rid = e.rid AND s.pos = e.pos),
  best AS (SELECT rid, pos, t, a FROM chain QUALIFY row_number() OVER (PARTITION BY rid, pos ORDER BY t DESC, path, a) = 1),
  ends AS (SELECT r.rid, b.t, b.a FROM graph_recipes r LEFT JOIN made m ON m.rid = r.rid AND m.produces = r.final_state LEFT JOIN best b ON b.rid = r.rid AND b.pos = coalesce(m.pos, b.pos)
    QUALIFY row_number() OVER (PARTITION BY r.rid ORDER BY b.t DESC, b.pos) = 1),
  e AS (SELECT rid, coalesce(t, 0e0) AS t, coalesce(a, 0e0) AS a, coalesce(t - a, 0e0) AS p FROM ends)
  SELECT rid, {sql_rounded("t", 1)} AS total, {sql_rounded("a", 1)} AS active, {sql_rounded("p", 1)} AS passive, {_ISO("t")} AS total_iso, {_ISO("a")} AS active_iso, {_ISO("p")} AS passive_iso FROM e""")  # fmt: skip
add("GRF-4_back_completion", lambda s, d: back_completion(networks(*_frames(s, d), ["rid", "sub"], first=True)), """WITH RECURSIVE
  made AS (SELECT rid, sub, produces, min(pos) AS pos FROM graph_steps WHERE coalesce(produces, '') <> '' GROUP BY rid, sub, produces),
  before AS (SELECT DISTINCT s.rid, s.sub, s.pos, m.pos AS prev FROM graph_refs r JOIN graph_steps s ON s.rid = r.rid AND s.pos = r.pos JOIN made m ON m.rid = s.rid AND m.sub = s.sub AND m.produces = r.ref
    WHERE NOT EXISTS (SELECT 1 FROM graph_ingredients g WHERE g.rid = r.rid AND g.id = r.ref)),
  up(rid, sub, pos) AS (SELECT rid, sub, max(pos) FROM graph_steps GROUP BY rid, sub UNION SELECT u.rid, u.sub, e.prev FROM up u JOIN before e ON e.rid = u.rid AND e.sub = u.sub AND e.pos = u.pos)
  SELECT s.rid, s.sub, s.pos, s.done OR u.pos IS NOT NULL AS done FROM graph_steps s LEFT JOIN up u ON u.rid = s.rid AND u.sub = s.sub AND u.pos = s.pos""")  # fmt: skip
# what completed steps rest on, step by step, and of that what has no taker left to do
_UNUSED = """known AS (SELECT DISTINCT rid, id FROM graph_ingredients),
  made AS (SELECT DISTINCT rid, sub, produces FROM graph_steps WHERE coalesce(produces, '') <> ''),
  node AS (SELECT r.rid, s.sub, s.pos, s.done, CASE WHEN r.kind = 'uses' AND k.id IS NOT NULL THEN 'ingredient' WHEN m.produces IS NOT NULL OR r.kind = 'uses' THEN 'state' ELSE 'tool' END AS kind, r.ref, m.produces IS NOT NULL AS own
    FROM graph_refs r JOIN graph_steps s ON s.rid = r.rid AND s.pos = r.pos LEFT JOIN known k ON k.rid = r.rid AND k.id = r.ref LEFT JOIN made m ON m.rid = r.rid AND m.sub = s.sub AND m.produces = r.ref),
  seen(rid, sub, pos) AS (SELECT rid, sub, pos FROM graph_steps WHERE done
    UNION SELECT x.rid, x.sub, s.pos FROM seen x JOIN node n ON n.rid = x.rid AND n.sub = x.sub AND n.pos = x.pos AND n.kind = 'state' JOIN graph_steps s ON s.rid = n.rid AND s.sub = n.sub AND s.produces = n.ref),
  unused AS (SELECT DISTINCT n.rid, n.kind, CASE WHEN n.kind = 'ingredient' THEN n.sub ELSE '' END AS sub, n.ref AS item FROM seen x JOIN node n ON n.rid = x.rid AND n.sub = x.sub AND n.pos = x.pos
    WHERE (n.kind <> 'state' OR n.own) AND NOT EXISTS (SELECT 1 FROM node t WHERE t.rid = n.rid AND t.sub = n.sub AND t.kind = n.kind AND t.ref = n.ref AND NOT t.done))"""
add("SET-8_unused_items", lambda s, d: unused_items(consumers(*_frames(s, d))), f"WITH RECURSIVE {_UNUSED} SELECT rid, kind, sub, item FROM unused")
add("FLT-29_unused_flags", lambda s, d: unused_flags(consumers(*_frames(s, d))), f"""WITH RECURSIVE {_UNUSED}
  SELECT n.*, u.item IS NOT NULL AS unused FROM (SELECT DISTINCT rid, kind, CASE WHEN kind = 'ingredient' THEN sub ELSE '' END AS sub, ref AS item FROM node WHERE kind <> 'state') n
  LEFT JOIN unused u ON u.rid = n.rid AND u.kind = n.kind AND u.sub = n.sub AND u.item = n.item""")  # fmt: skip
_LINKS = """links AS (
    SELECT r.rid, CASE WHEN k.id IS NOT NULL THEN 'ing-' || r.ref ELSE 'state-' || r.ref END AS source, 'step-' || s.id AS target, CASE WHEN k.id IS NOT NULL THEN 'ingredient' ELSE 'state' END AS type
    FROM graph_refs r JOIN graph_steps s ON s.rid = r.rid AND s.pos = r.pos LEFT JOIN graph_ingredients k ON k.rid = r.rid AND k.id = r.ref WHERE r.kind = 'uses'
    UNION ALL SELECT rid, 'step-' || id, 'state-' || produces, 'state' FROM graph_steps WHERE coalesce(produces, '') <> '')"""
add("GRF-3_unified_edges", lambda s, d: unified_edges(*_frames(s, d)), f"WITH {_LINKS} SELECT rid, source, target, type FROM links")
add("GRF-3_unified_nodes", lambda s, d: unified_nodes(*_frames(s, d)), f"""WITH {_LINKS},
  nodes AS (SELECT rid, 'step-' || id AS node, 'action' AS type, action AS label, sub AS grp FROM graph_steps UNION ALL SELECT rid, 'ing-' || id, 'ingredient', name, '__ingredients__' FROM graph_ingredients
    UNION ALL SELECT DISTINCT x.rid, x.n, 'state', replace(substr(x.n, 7), '_', ' '), (SELECT arg_max(p.sub, (SELECT min(q.pos) FROM graph_steps q WHERE q.rid = p.rid AND q.sub = p.sub)) FROM graph_steps p WHERE p.rid = x.rid AND 'state-' || p.produces = x.n)
      FROM (SELECT rid, source AS n FROM links UNION SELECT rid, target FROM links) x WHERE starts_with(x.n, 'state-'))
  SELECT n.*, EXISTS (SELECT 1 FROM links l WHERE l.rid = n.rid AND l.target = n.node) AND NOT EXISTS (SELECT 1 FROM links l WHERE l.rid = n.rid AND l.source = n.node) AS final FROM nodes n""")  # fmt: skip

QUERIES, SQL = catalog.queries, catalog.sql
