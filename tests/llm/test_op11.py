"""Hard negatives against brute force: ties, repeated rows, odd lengths, huge components, several blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from galley.llm import op11_hard_negatives as m

LONG = 2**63 - 1


def score(a, b):
    return max(-LONG, min(LONG, sum(x * y for x, y in zip(a, b, strict=True))))


def brute(rows, every=10):
    out = []
    anchors = {}
    for k, (i, lab, v) in enumerate(rows):
        if i % every == 0:
            anchors.setdefault((i, lab, tuple(v)), k)
    for k in anchors.values():
        i, lab, v = rows[k]
        others = [(-score(v, w), j, b) for n, (j, b, w) in enumerate(rows) if n != k and len(w) == len(v)]
        same = sorted(x[:2] for x in others if x[2] == lab)[:5]
        for s, p in same:
            inside = sorted((t, j) for t, j, b in others if b != lab and 80 * -s <= 100 * -t <= 100 * -s)[:5]
            out += [(i, p, r, j, -s, -t) for r, (t, j) in enumerate(inside, 1)]
    return sorted(out)


def found(spark, rows, every=10):
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "id long, label long, vec array<long>, residual double").repartition(3)
    return sorted(tuple(r) for r in m.hard_negatives(df, every).collect())


@pytest.mark.parametrize("block", [1024, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "PAIRS", 40)
    r = random.Random(5)
    rows = [(i, r.randrange(3), [r.randint(-300, 300) for _ in range(5)]) for i in range(90)]
    rows += [(100 + i, i % 2, [7, 1, 0, 2, 3]) for i in range(40)]  # a third of all alike
    rows += [(200 + i, i % 2, [i, 2]) for i in range(12)] + [(220, 1, []), (221, 1, []), (222, 0, [])]
    rows += [rows[0], rows[0], (0, 2, [1, 2, 3, 4, 5]), (11, 0, [9, 9, 9, 9, 9])]  # ids that repeat
    got = found(spark, rows)
    assert got == brute(rows) and len({g[0] for g in got}) > 8


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.integers(-400, 400, (300, 7))
    books = m.fit(pa.table({"vec": pa.array(x[:200].tolist(), pa.list_(pa.int64()))}))
    batch = pa.RecordBatch.from_pydict({"id": np.arange(300), "label": np.zeros(300, np.int64), "vec": pa.array(x.tolist(), pa.list_(pa.int64()))})
    (coded,) = m._encode(books)(iter([batch]))
    codes = np.frombuffer(b"".join(coded["codes"].to_pylist()), np.uint8).reshape(300, -1)
    block = m.Block(np.arange(20), x[:20], np.zeros(20), books)
    low, high = block.bounds(np.arange(20), codes, coded["residual"].to_numpy())
    true = x @ x[:20].T
    assert (low <= true).all() and (true <= high).all()
    assert np.median((high - low) / np.abs(true).mean()) < 1  # and say something


def test_huge_components(spark):
    big = 2**62
    rows = [(0, 1, [big, 1]), (1, 1, [big, 2]), (2, 1, [2, 3]), (3, 2, [big, -5]), (4, 2, [1, 1]), (5, 2, [2, 3]), (6, 2, [-big, 0])]
    assert found(spark, rows) == brute(rows) != []


def test_a_longer_vector_than_any_fitted(spark, monkeypatch):
    monkeypatch.setattr(m, "SAMPLE", 2)
    rows = [(i, i % 2, [i, 3, -i] + [5] * (i % 3 * 4)) for i in range(30)]
    assert found(spark, rows) == brute(rows) != []


def test_rows_that_take_no_part(spark):
    rows = [(7, 9, [0.5, -0.001]), (1, None, [1.0]), (None, 1, [1.0]), (2, 1, None), (3, 1, [float("nan")]), (4, 1, [None]), (5, 1, [float("inf")]), (6, 1, [1e30])]
    df = spark.createDataFrame([(a, b, c, 0) for a, b, c in rows], "vec_id long, label int, embedding array<float>, vec int")
    got = {r.id: (r.label, r.vec) for r in m.labelled(df).collect()}
    assert got == {7: (0, [128, -1]), 6: (1, [LONG])}
    assert m.hard_negatives(m.labelled(df.limit(0))).collect() == []
