"""Chat formatting against a plain version: branching trees, ties, absent parents, long chains, exact round trips."""

import hashlib
import random

from galley.llm import op3_chat_formatting as m

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def plain_paths(rows, branches):
    out = {}
    for tree in {r[0] for r in rows}:
        nodes = {r[1]: r for r in rows if r[0] == tree}
        parent = {n: (r[2] if r[2] in nodes and r[2] != n else None) for n, r in nodes.items()}
        paths = []
        for leaf in set(nodes) - set(parent.values()):
            path, n = [], leaf
            while n is not None:
                path.append(n)
                n = parent[n]
            paths.append((-sum(nodes[n][5] or 0.0 for n in path), leaf, path[::-1]))
        for i, (_, _, path) in enumerate(sorted(paths)[:branches]):
            out[tree, i + 1] = [(nodes[n][3] or "", nodes[n][4] or "") for n in path]
    return out


def test_branches_and_round_trip(spark):
    r = random.Random(2)
    bits = ["<|im_end|>", "\n", "\\b", "\\l", "\\", "<|im_start|>assistant", "é", "日", "\U0001f600", "", " word "]
    say = lambda: r.choice([None, "", *["".join(r.choices(bits, k=4)) for _ in range(5)]])
    rows = []
    for tree in range(12):
        for n in range(r.randint(1, 25)):
            parent = r.choice([None, n, 999, *([r.randrange(n)] * 8 if n else [])])
            rows.append((tree, n, parent, r.choice(["user", "assistant", None, "tool\nx"]), say(), r.choice([None, 0.0, 1.0, 2.0])))
    rows += [(50, i, i - 1 if i else None, "assistant" if i % 2 else "user", "t%d" % i, 1.0) for i in range(60)]  # a long chain
    rows += [(51, i, 0 if i else None, "user", "same", 1.0) for i in range(200)]  # a hub with ties
    df = spark.createDataFrame(rows, SCHEMA)
    got = m.read_back(m.format_paths(m.best_paths(df, 3))).collect()
    want = plain_paths(rows, 3)
    assert {(x.tree, x.branch): [(t.role, t.text) for t in x.turns] for x in got} == want
    for x in got:
        turns = want[x.tree, x.branch]
        assert x.masked == "".join(t for role, t in turns if role == "assistant")
        # no control string but those of the template
        assert x.formatted.count("<|im_start|>") == x.formatted.count("<|im_end|>\n") == x.formatted.count("<|") // 2 == len(turns)


def test_query_on_edges(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", None), (2, 5, None, ""), (3, 0, "assistant", "x" * 100_000 + "é"), (None, 0, "user", "lost"), (4, None, "user", "no turn")]
    spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, tree string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in m.op3_chat_formatting(spark, str(tmp_path)).collect()}
    hexed = lambda *turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    said = m.PLANTED[0][3]
    want = {-1: [("user", said), ("assistant", said)], 1: [("user", ""), ("user", ""), ("assistant", "b")], 2: [("", "")], 3: [("assistant", rows[4][3])], 4: [("user", "no turn")]}
    assert set(got) == set(want)
    for k, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256) == (len(turns), hexed(*turns))
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty_table(spark, tmp_path):
    assert m.read_back(m.format_paths(m.best_paths(spark.createDataFrame([], SCHEMA)))).count() == 0
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in m.op3_chat_formatting(spark, str(tmp_path)).collect()] == [-1]


def test_circles_have_no_path(spark):
    rows = [(1, 0, None, "user", "a", 1.0), (1, 1, 0, "assistant", "b", 1.0), (1, 2, 3, "user", "c", 9.0), (1, 3, 2, "user", "d", 9.0), (1, 4, 3, "user", "e", 9.0), (2, 5, 6, "user", "f", 1.0), (2, 6, 5, "user", "g", 1.0), (3, 7, 7, "user", "h", 1.0)]
    got = m.best_paths(spark.createDataFrame(rows, SCHEMA), 5).collect()
    assert sorted((r.tree, r.branch, r.pos, r.node) for r in got) == [(1, 1, 1, 0), (1, 1, 2, 1), (3, 1, 1, 7)]
