"""The filter audit against documents filtered one order at a time, and its SQL."""

import random
import re
from itertools import permutations

import duckdb
import pytest
from galley.llm import op13_filter_audit as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(docs):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, _ in docs:
        t = t or ""
        w = WORD.findall(t)
        out.append([len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]])
    return out


def brute(docs, labels):
    bad = fails(docs)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, sums = {}, {}
    for part in {s or "" for _, _, s in docs}:
        mine = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        for order in permutations(range(5)):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [k for k in left if bad[k][f]]
                kept = [k for k in left if not bad[k][f]]
                failing = [k for k in mine if bad[k][f]]
                ids = [docs[k][0] for k in gone]
                out[part, "".join("ABCDE"[j] for j in order), step] = [
                    len(kept), len(gone), len(failing) - len(gone), sum(sum(bad[k]) == 1 for k in failing), sum(i in good for i in ids), sum(i in toxic for i in ids)
                ]
                sums[part, f] = sums.get((part, f), 0) + len(gone)
                left = kept
    return {(*k, *v, sums[k[0], "ABCDE".index(k[1][k[2] - 1])]) for k, v in out.items()}


def corpus(seed=3, n=150):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Ärger", "日本", "😀"]
    docs = []
    for i in range(n):
        t = " ".join(r.choices(words[: r.choice([5, 40, 303])], k=r.choice([0, 1, 49, 50, 51, 80]))).replace(" ", r.choice([" ", "\t", "\n", "\x0b "]))
        t += r.choice(["", "", "#", " |", "ABC DEF", " x y"])
        docs.append((i, t.upper() if r.random() < 0.1 else t, r.choice(["a", "a", "b", "", None])))
    docs += [(n + i, docs[r.randrange(n)][1], "a") for i in range(60)]  # copies
    docs += [(500, None, None), (501, "", "b"), (500, None, "a"), (None, docs[0][1], "a"), (None, None, None), (502, "z " * 30_000, "b"), (-5, docs[3][1], "c"), (-5, docs[3][1], "c")]
    labels = [(r.randrange(-5, n + 60), r.choice([0, 1, None]), r.choice([0, 0, 1, None])) for _ in range(120)] + [(None, 1, 1), (3, 1, 0), (3, 0, 1), (9999, 1, 1)]
    r.shuffle(docs)
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame([(*x, "x", 1) for x in docs], "doc_id long, text string, source string, mask string, n int").repartition(5)
    return d, spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")


@pytest.fixture(scope="module")
def both(spark):
    docs, labels = corpus()
    d, lab = frames(spark, docs, labels)
    return docs, labels, [tuple(x) for x in m.filter_audit(d, lab).collect()]


def test_equals_one_order_at_a_time(both):
    docs, labels, got = both
    assert len(got) == len(set(got)) == 600 * 4 and set(got) == brute(docs, labels)


def test_sql_says_the_same(both, tmp_path):
    import pandas as pd

    docs, labels, got = both
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    assert set(con.sql(m.SQL).fetchall()) == set(got)


def test_polynomial_by_hand():
    # 4 documents fail A alone, 2 fail A and B, 1 fails C, D and E, 3 fail nothing
    poly = m.removal_polynomial({0: 3, 1: 4, 3: 2, 28: 1})
    assert [m.corner(poly, on) for on in (0, 1, 2, 3, 4, 31)] == [0, 6, 2, 6, 1, 7]
    values = [m.shapley(poly, i) for i in range(5)]
    assert [v * 120 for v in values] == [600, 120, 40, 40, 40] and sum(values) == 7


def test_empty_tables(spark):
    d, lab = frames(spark, [], [])
    assert m.filter_audit(d, lab).collect() == []
    d, _ = frames(spark, [(1, "a", "s")], [])
    rows = m.filter_audit(d, lab).collect()
    assert len(rows) == 600 and {r.good_lost for r in rows} == {0}
