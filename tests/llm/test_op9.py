"""Greedy string tiling against a plain version, and planted passages."""

import random

from galley.llm.op9_string_tiling import LEAST, THRESHOLD, contaminated


def plain(doc, item, least):
    """Textbook greedy string tiling over all pairs of positions."""
    doc, item = doc.lower().split(), item.lower().split()
    least = min(least, len(item)) or 1
    md, mi, covered = set(), set(), 0
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in mi and j + n not in md:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return covered
        n, i, j = best
        mi |= set(range(i, i + n))
        md |= set(range(j, j + n))
        covered += n


def test_equals_the_plain_version(spark):
    r = random.Random(2)
    vocab = list("abcdefgh")
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 4, 30, 80])))) for i in range(25)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 8, 12])))) for i in range(12)]
    docs += [(30, " ".join(["x y", items[-1][1], "z", items[-2][1].upper()]))]
    got = {}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for row in contaminated(d, b, 2, 0.01).collect():
        got[row.doc_id, row.item_id] = row.covered_words
    want = {(i, j): c for i, t in docs for j, u in items if u.split() and (c := plain(t, u, 2)) and c >= 0.01 * len(u.split())}
    assert got == want
    blocks = {(x.doc_id, x.item_id): x.covered_words for x in contaminated(d, b, 2, 0.01, block_words=10).collect()}
    assert blocks == want


def test_reordered_passages_and_clean_documents(spark):
    r = random.Random(4)
    vocab = ["v%d" % i for i in range(500)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(40))) for i in range(20)]
    clean = [(100 + i, " ".join(r.choice(vocab) for _ in range(300))) for i in range(50)]
    w = items[3][1].split()
    moved = " ".join([*w[20:30], "and", *w[0:10], *w[30:40], *w[10:20]])
    docs = clean + [(1, "x " * 50 + items[7][1] + " y" * 9), (2, moved), (3, None), (4, ""), (None, items[7][1]), (5, "q " * 60_000 + items[9][1])]
    df = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, coverage int")
    bench = spark.createDataFrame(items + [(50, None), (51, ""), (None, "x")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in contaminated(df, bench).collect()}
    assert set(got) == {(1, 7), (2, 3), (5, 9)}
    assert got[2, 3].coverage == 1.0 and got[2, 3].n_tiles == 4
    assert LEAST == 5 and THRESHOLD == 0.5
    assert contaminated(df.limit(0), bench).count() == 0
    assert contaminated(df, bench.limit(0)).count() == 0
