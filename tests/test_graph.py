"""Graphs of steps: known recipes, and random ones (diamonds, cycles, missing states) against plain versions."""

import random

import pytest

from galley.operators import audit, graph

STEPS = "rid int, pos int, id string, sub string, action string, duration string, passive boolean, done boolean, produces string"


def frames(spark, steps, refs, ingredients, recipes):
    return (
        spark.createDataFrame(steps, STEPS), spark.createDataFrame(refs, "rid int, pos int, kind string, ref string"),
        spark.createDataFrame(ingredients, "rid int, id string, name string"), spark.createDataFrame(recipes, "rid int, final_state string"),
    )


def recipe(rid, final, *steps):
    """Steps as (action, duration, passive, uses, requires, produces)."""
    rows = [(rid, p, f"s{p}", "main", a, t, passive, False, made) for p, (a, t, passive, _, _, made) in enumerate(steps, 1)]
    refs = [(rid, p, kind, r) for p, s in enumerate(steps, 1) for kind, names in (("uses", s[3]), ("requires", s[4])) for r in names]
    return rows, refs, [(rid, final)]


KNOWN = [
    (recipe(1, "cooled", ("Mix", "PT5M", False, ["flour"], [], "batter"), ("Bake", "PT30M", True, ["batter"], [], "cake"), ("Cool", "PT10M", True, ["cake"], [], "cooled")), (45, 5, 40, "PT45M")),
    (recipe(2, "dish", ("Season", "PT5M", False, [], [], "a"), ("Cook", "PT20M", True, ["a"], [], "b"), ("Chop", "PT10M", False, [], [], "c"), ("Sauce", "PT15M", False, ["c"], [], "d"), ("Assemble", "PT5M", False, ["b", "d"], [], "dish")), (30, None, None, "PT30M")),
    (recipe(3, "salad", ("Chop", None, False, [], [], "x"), ("Serve", None, False, ["x"], [], "salad")), (10, 10, 0, "PT10M")),
    (recipe(4, "bread", ("Preheat the oven to 200°C", None, False, [], [], "oven"), ("Shape", "PT10M", False, [], [], "loaf"), ("Bake", "PT25M", True, ["loaf"], ["oven"], "bread")), (35, 10, 25, "PT35M")),
    (recipe(5, "", ("Mix", "PT10M", False, [], [], "m"), ("Bake", "PT45M", True, ["m"], [], "k"), ("Cool", "PT24H", True, ["k"], [], "z")), (1495, 10, 1485, "PT24H55M")),
    # a cycle: only what stands earlier counts
    (recipe(6, "", ("Mix", "PT10M", False, ["z"], [], "x"), ("Bake", "PT45M", True, ["x"], [], "z")), (55, 10, 45, "PT55M")),
    (recipe(7, "gone"), (0, 0, 0, "PT0M")),
]


def test_known_times(spark):
    steps, refs, recipes = ([x for r, _ in KNOWN for x in r[i]] for i in range(3))
    f = frames(spark, steps, refs, [(1, "flour", "flour")], recipes)
    got = {r.rid: r for r in graph.critical_times(graph.networks(*f[:3], ["rid"]), f[3]).collect()}
    for rid, (_, (total, active, passive, iso)) in enumerate(KNOWN, 1):
        assert (got[rid].total, got[rid].total_iso) == (total, iso)
        if active is not None:
            assert (got[rid].active, got[rid].passive) == (active, passive)


def made_up(seed, n=60):
    r = random.Random(seed)
    steps, refs, ingredients, recipes = [], [], [], []
    for rid in range(n):
        m = r.randrange(1, 9)
        back = r.random() < 0.5  # else any step may use any state
        for p in range(1, m + 1):
            steps.append((rid, p, f"s{p}", r.choice("ab"), r.choice(["Mix", "PREHEAT", None]), r.choice([None, "", "PT7M", "PT3M", "4min", "PT0M"]), r.choice([True, False, None]), r.choice([True, False, None]), r.choice([f"x{p}", f"x{p}", "x1", "", None])))
            for _ in range(r.randrange(4)):
                refs.append((rid, p, r.choice(["uses", "requires"]), f"x{r.randrange(1, max(2, p)) if back else r.randrange(1, m + 2)}"))
            refs.append((rid, p, "uses", f"i{r.randrange(3)}"))
            refs.append((rid, p, "requires", r.choice(["pan", "pot"])))
        ingredients += [(rid, f"i{k}", f"name {k}") for k in range(2)] + ([(rid, "x2", "odd")] if r.random() < 0.2 else [])
        recipes.append((rid, r.choice([None, "", "x1", f"x{m}", "none"])))
    return steps, refs, ingredients, recipes


def plain_before(steps, refs, ingredients, rid):
    mine = sorted(s for s in steps if s[0] == rid)
    made = {s[8]: s[1] for s in mine if s[8]}
    known = {i for q, i, _ in ingredients if q == rid}
    return mine, made, {s[1]: {made[x] for q, p, _, x in refs if q == rid and p == s[1] and x in made and x not in known and made[x] != s[1]} for s in mine}


def plain_taken(before):
    taken = set()
    while now := {p for p, b in before.items() if p not in taken and b <= taken}:
        taken |= now
    return taken


@pytest.fixture(scope="module", params=[1, 2])
def data(request, spark):
    raw = made_up(request.param)
    return raw, frames(spark, *raw)


def test_peeling(data):
    raw, f = data
    got = {r.rid: (r.steps, r.taken, r.kept, r.acyclic) for r in graph.acyclicity(graph.networks(*f[:3], ["rid"])).collect()}
    for rid in {s[0] for s in raw[0]}:
        mine, _, before = plain_before(*raw[:3], rid)
        kept = sorted(set(before) - plain_taken(before))
        assert got[rid] == (len(mine), len(mine) - len(kept), ",".join(map(str, kept)), not kept)
    assert {g[3] for g in got.values()} == {True, False}


def test_times(data):
    raw, f = data
    got = {r.rid: (r.total, r.active, r.passive) for r in graph.critical_times(graph.networks(*f[:3], ["rid"]), f[3]).collect()}
    minutes = {"PT7M": 7, "PT3M": 3, "4min": 4, "PT0M": 0}
    for rid, final in raw[3]:
        mine, made, before = plain_before(*raw[:3], rid)
        if len(plain_taken(before)) < len(mine):
            before = {p: {q for q in b if q < p} for p, b in before.items()}
        length = {s[1]: minutes[s[5]] if s[5] else (0 if s[4] == "PREHEAT" else 5) for s in mine}
        quiet = {s[1]: bool(s[6]) for s in mine}
        finish, over = {}, {}

        def done(p):
            if p not in finish:
                best = max(((done(q), -q) for q in before[p]), default=(0, 0))
                over[p] = -best[1] if best[0] > 0 else None
                finish[p] = best[0] + length[p]
            return finish[p]

        end = made[final] if final in made else max(before, key=lambda p: (done(p), -p))
        sums, at = [0, 0], end
        total = done(end)
        while at:
            sums[quiet[at]] += length[at]
            at = over[at]
        assert got[rid] == (total, *sums), rid


def test_unused(data):
    raw, f = data
    uses = graph.consumers(*f[:3])
    got = {tuple(r) for r in graph.unused_items(uses).collect()}
    want = set()
    for rid, sub in {(s[0], s[3]) for s in raw[0]}:
        mine = [s for s in raw[0] if s[0] == rid and s[3] == sub]
        known = {i for q, i, _ in raw[2] if q == rid}
        made = {s[8] for s in mine if s[8]}
        takes = {}
        for s in mine:
            for q, p, kind, x in raw[1]:
                if q == rid and p == s[1]:
                    node = ("ingredient", x) if kind == "uses" and x in known else ("state", x) if kind == "uses" or x in made else ("tool", x)
                    takes.setdefault(s[1], set()).add(node)
        for s in mine:
            if not s[7]:
                continue
            seen, stack = set(), [s[1]]
            while stack:
                now = stack.pop()
                if now in seen:
                    continue
                seen.add(now)
                if isinstance(now, int):
                    stack += takes.get(now, ())
                    continue
                stack += [t[1] for t in mine if now[0] == "state" and t[8] == now[1]]
                if all(t[7] for t in mine if now in takes.get(t[1], ())) and (now[0] != "state" or now[1] in made):
                    want.add((rid, now[0], sub if now[0] == "ingredient" else "", now[1]))
    assert got == want and {w[1] for w in want} == {"ingredient", "state", "tool"}
    flags = {(r.rid, r.kind, r.sub, r.item): r.unused for r in graph.unused_flags(uses).collect()}
    assert {k for k, v in flags.items() if v} == {w for w in want if w[1] != "state"} and False in flags.values()


def test_back_completion_of_a_diamond(spark):
    steps = [(1, p, f"s{p}", "a", "Mix", None, False, False, made) for p, made in ((1, "x"), (2, "l"), (3, "r"), (4, "other"), (5, "end"))]
    refs = [(1, 2, "uses", "x"), (1, 3, "uses", "x"), (1, 5, "uses", "l"), (1, 5, "requires", "r"), (1, 1, "uses", "end")]
    f = frames(spark, steps, refs, [], [(1, None)])
    got = graph.back_completion(graph.networks(*f[:3], ["rid", "sub"], first=True)).collect()
    assert {r.pos for r in got if r.done} == {1, 2, 3, 5} and len(got) == 5


def test_unified_graph(spark):
    steps = [(1, 1, "s1", "a", "Mix", None, False, False, "wet_mix"), (1, 2, "s2", "b", "Bake", None, False, False, "cake")]
    refs = [(1, 1, "uses", "flour"), (1, 1, "uses", "ghost"), (1, 2, "uses", "wet_mix"), (1, 2, "requires", "pan")]
    f = frames(spark, steps, refs, [(1, "flour", "Flour")], [(1, None)])
    nodes = {r.node: (r.type, r.label, r.grp, r.final) for r in graph.unified_nodes(*f[:3]).collect()}
    assert nodes == {
        "step-s1": ("action", "Mix", "a", False), "step-s2": ("action", "Bake", "b", False), "ing-flour": ("ingredient", "Flour", "__ingredients__", False),
        "state-ghost": ("state", "ghost", None, False), "state-wet_mix": ("state", "wet mix", "a", False), "state-cake": ("state", "cake", "b", True),
    }
    edges = {(r.source, r.target, r.type) for r in graph.unified_edges(*f[:3]).collect()}
    assert edges == {("ing-flour", "step-s1", "ingredient"), ("state-ghost", "step-s1", "state"), ("step-s1", "state-wet_mix", "state"), ("state-wet_mix", "step-s2", "state"), ("step-s2", "state-cake", "state")}


def test_unified_nodes_gather_each_frame_once(spark):
    steps = [(1, 1, "s1", "a", "Mix", None, False, False, "x"), (1, 2, "s2", "b", "Bake", None, False, False, "x"), (1, 3, None, None, None, None, False, False, ""), (None, 1, "s1", "a", "Mix", None, False, False, "y"), (3, 1, "s1", "a", "Mix", None, None, None, None)]
    refs = [(1, 1, "uses", None), (1, 2, "uses", "x"), (1, 9, "uses", "far"), (1, 1, "uses", "egg"), (2, 1, "uses", "alone"), (3, 1, "requires", "pan")]
    out = graph.unified_nodes(*frames(spark, steps, refs, [(1, "egg", "Egg"), (1, "egg", "Egg"), (1, None, "odd"), (4, "leek", "Leek")], [(1, None)])[:3])
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([
        (1, "state-x", "state", "x", "b", False), (1, "step-s1", "action", "Mix", "a", False), (1, "step-s2", "action", "Bake", "b", False), (1, None, "action", None, None, False),
        (1, "ing-egg", "ingredient", "Egg", "__ingredients__", False), (1, "ing-egg", "ingredient", "Egg", "__ingredients__", False), (1, None, "ingredient", "odd", "__ingredients__", False),
        (None, "state-y", "state", "y", None, False), (None, "step-s1", "action", "Mix", "a", False), (3, "step-s1", "action", "Mix", "a", False), (4, "ing-leek", "ingredient", "Leek", "__ingredients__", False),
    ], key=repr)
    assert out._jdf.queryExecution().executedPlan().toString().rpartition("Initial Plan")[2].count("Exchange hashpartitioning") <= 3


def test_ancestors_of_any_number_of_recipes(spark):
    rows = [(rid, p) for rid in range(40) for p in range(1, 9) if p != 3] + [(90, 5), (91, 2), (91, 2)]
    spark.conf.set("spark.sql.cteRecursionRowLimit", 100)  # a recursive query has such a limit for all recipes together
    try:
        got = {r.rid: r.n for r in audit.ancestors(spark.createDataFrame(rows, "rid int, pos int")).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got == {rid: 7 for rid in range(40)} | {90: 1, 91: 1}
