"""The field's recurrences against enumeration, its gradient against differences, and held-out accuracy."""

import itertools
import zlib

import numpy as np
from galley.llm import op6_crf_language_id as m


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(1)
    e, a, s = r.normal(size=(9, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    first = np.array([0, 4, 5])
    gamma, moved = m.forward_backward(e, first, a, s)
    want, moves = np.zeros((9, 3)), np.zeros((3, 3))
    for lo, hi in ((0, 4), (4, 5), (5, 9)):
        total, g, x = 0.0, np.zeros((hi - lo, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=hi - lo):
            p = np.exp(s[path[0]] + sum(e[lo + i, y] for i, y in enumerate(path)) + sum(a[i, j] for i, j in zip(path, path[1:])))
            total += p
            for i, y in enumerate(path):
                g[i, y] += p
            for i, j in zip(path, path[1:]):
                x[i, j] += p
        want[lo:hi] = g / total
        moves += x / total
    assert np.allclose(gamma, want) and np.allclose(moved, moves)


def test_held_out_accuracy_and_defined_results(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    got = m.op6_crf_language_id(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) > 0.97 * len(tested)

    model = m.fit([("en", "the cat and the dog " * 9), ("fr", "le chat et les chiens " * 9)])
    rows = [(1, None, 5.0), (2, "", 5.0), (3, "123 €…", 5.0), (4, "the dog", 5.0), (5, "les chats " * 40_000, 5.0), (4, "the dog", 5.0), (None, "et le chat", 5.0)]
    out = m.predict(spark.createDataFrame(rows, "doc_id long, text string, score double"), model)
    assert out.columns == ["doc_id", "lang_pred", "score"]
    assert sorted(((r.doc_id, r.lang_pred) for r in out.collect()), key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "fr"), (None, "fr")], key=str)
    assert m.predict(spark.createDataFrame(rows[:0], "doc_id long, text string"), m.fit([])).count() == 0
    assert [r.lang_pred for r in m.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), m.fit([])).collect()] == ["und"]


def test_switched_text_is_split():
    model = m.fit([("en", "the cat and the dog with that house " * 9), ("fr", "le chat et les chiens avec cette maison " * 9)])
    w = m._word_arrays(["the dog and the house " * 3 + "les chiens et la maison " * 2])
    best = model.posteriors(w).argmax(axis=1)
    assert best[:15].mean() < 0.1 and best[15:].mean() > 0.9


def test_no_language_is_left_out(spark):
    rows = [(i, f"w{i % 90}a w{i % 90}b w{i % 90}c " * 5, f"l{i % 90:02}") for i in range(360)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = m.training_rows(docs, sampled=200)
    assert len(taken) == 180 and len({x for x, _ in taken}) == 90
    assert len(m.training_rows(docs)) == 360 and len(m.training_rows(docs, sampled=5)) == 90
    got = m.predict(docs.where("doc_id < 90"), m.fit(m.training_rows(docs))).collect()
    assert sum(r.lang_pred == f"l{r.doc_id % 90:02}" for r in got) > 85
