"""HyperMinHash near-dedup against brute force over all pairs."""

import random
import re

from galley.llm.op5_hyperminhash import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, num, den):
    def low(t):
        return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b) and root(i) != root(j):
                comp[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def corpus(n=160, seed=3):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["Été", "ÀÉ", "Straße", "日本", "a b"]
    rows, i = [], 0
    for _ in range(n // 8):
        base = [r.choice(vocab) for _ in range(r.choice([3, 9, 30, 120]))]
        for _ in range(8):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, r.choice([" ", "\n", "\t"]).join(w if r.random() < 0.5 else [x.upper() if x.isascii() else x for x in w])))
            i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, " \n\t "), (i + 3, "one"), (i + 4, "One"), (i + 5, "one two"), (i + 6, "x " * 30_000)]


def test_components_equal_brute_force(spark):
    for k, num in ((3, 85), (5, 80)):
        rows = corpus()
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, k, num, 100).collect()}
        assert got == brute(rows, k, num, 100)


def test_blocks_give_the_same_components(spark, monkeypatch):
    from galley.llm import op5_hyperminhash as m

    monkeypatch.setattr(m, "BLOCK_ROWS", 3)
    rows = corpus(64, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, 3, 85, 100).collect()}
    assert got == brute(rows, 3, 85, 100)


def test_empty_table_repeated_rows_and_clashing_columns(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f g h", "x"), (1, "a b c d e f g h", "x"), (2, "A B c d e f g h", None), (None, "q", "z")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component string").withColumnRenamed("component", "cluster")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False)]
