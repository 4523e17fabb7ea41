"""Exact top-k against brute force: ties, repeated ids, small blocks, vectors that take no part."""

import random

import pytest
from galley.llm import op2_exact_topk as m


def brute(queries, candidates, k):
    out = set()
    for q, a in queries:
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in candidates if c != q and len(a) == len(b))
        out |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])}
    return out


def found(spark, queries, candidates, k=5):
    frame = lambda x: spark.createDataFrame(x, "id long, vec array<long>")
    return [tuple(r) for r in m.top_k(frame(queries), frame(candidates), k).collect()]


@pytest.mark.parametrize("blocks", [(1024, 8192), (3, 7)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(m, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(m, "CANDIDATE_BLOCK", blocks[1])
    r = random.Random(1)
    rows = [(i, [r.randint(-300, 300) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, [1, 1, 1, 1]) for i in range(40)]  # a third of all alike
    rows += [(200, [5, 5]), (201, [6, 6]), (202, [7, 7, 7])]
    queries = [x for x in rows if x[0] % 10 == 0] + [rows[61]]
    got = found(spark, queries, rows)
    assert len(got) == len(set(got)) and set(got) == brute(queries, rows, 5)


def test_ties_fill_the_last_rank_by_id(spark, monkeypatch):
    monkeypatch.setattr(m, "CANDIDATE_BLOCK", 16)
    rows = [(i, [2, 3]) for i in range(200)]
    assert set(found(spark, [(7, [2, 3])], rows)) == {(7, i + 1, i, 13) for i in range(5)}


def test_edges(spark):
    assert found(spark, [], [(1, [1])]) == [] and found(spark, [(1, [1])], []) == []
    assert set(found(spark, [(1, [2]), (None, [1]), (3, None), (4, []), (5, [None])], [(1, [9]), (1, [8]), (2, [4]), (6, None), (7, [None])])) == {(1, 1, 2, 8)}
    # a query row that repeats is one query; candidates that repeat an id count each
    assert sorted(found(spark, [(1, [2]), (1, [2])], [(2, [4]), (2, [4]), (3, [-1])])) == [(1, 1, 2, 8), (1, 2, 2, 8), (1, 3, 3, -2)]
    big = 2**30
    assert found(spark, [(1, [big])], [(2, [big - 1]), (3, [big])], 1) == [(1, 1, 3, big * big)]


def test_outliers_saturate_and_refuse_nothing(spark):
    rows = [(1, [2**30, 3]), (2, [2**40, 5]), (3, [4, 5]), (4, [-(2**63), 2**63 - 1]), (5, [2**40, 9]), (6, [6, 7])]
    held = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    expected = set()
    for q in (1, 2, 3, 4):
        scored = sorted((-held(sum(x * y for x, y in zip(dict(rows)[q], v, strict=True))), i) for i, v in rows if i != q)
        expected |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:3], 1)}
    assert set(found(spark, rows[:4], rows, 3)) == expected


def test_components_are_floored_as_doubles(spark):
    rows = [(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, None), (5, [None, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "vec_id long, embedding array<float>, vec long")
    assert [(r.id, r.vec) for r in m.quantized(df).collect()] == [(1, [128, -1])]
