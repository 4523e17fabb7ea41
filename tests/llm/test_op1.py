"""Substring dedup against brute force over all windows and paragraph pairs."""

import random

import pytest
from galley.llm.op1_substring_dedup import LEAST, WINDOW, remove_passages, repeated_passages


def corpus(seed=5):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(3000)] + ["É", "日本"]
    text = lambda n: " ".join(r.choice(vocab) + ("\n" if r.random() < 0.02 else "") for _ in range(n))
    passages = [text(n) for n in (51, 60, 90, 180)]
    rows = [(i, text(r.choice([5, 40, 200, 900]))) for i in range(60)]
    planted = set()
    for j, p in enumerate(passages):
        for i in r.sample(range(60), 4 + j):
            w = rows[i][1].split(" ")
            at = r.randrange(len(w) + 1)
            rows[i] = (i, " ".join([*w[:at], p, *w[at:]]))
            planted.add(i)
    para = [r.choice(vocab) for _ in range(120)]
    for i in (70, 71, 72):
        edited = list(para)
        if i > 70:
            edited[r.randrange(20, 100)] = "edited%d" % i
        rows.append((i, text(30) + "\n" + " ".join(edited) + "\n" + text(30)))
        planted.add(i)
    rows += [(80, None), (81, ""), (82, " \n "), (83, "short line\nshort line"), (84, "short line"), (85, "z%d " * 3)]
    return rows, planted


def windows(rows):
    seen = {}
    for i, t in rows:
        w = (t or "").lower().split()
        for j in range(len(w) - WINDOW + 1):
            seen.setdefault(tuple(w[j : j + WINDOW]), set()).add(i)
    return {i for docs in seen.values() if len(docs) > 1 for i in docs}


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rows, planted = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = repeated_passages(df)
    found = runs.collect()
    named = {r.doc_id for r in found} | {r.kept_doc_id for r in found}
    assert windows(rows) <= planted
    assert named == planted
    assert all(r.n_words >= min(WINDOW, LEAST) for r in found)
    after = {r.doc_id: r.text for r in remove_passages(df, runs).collect()}
    before = dict(rows)
    touched = {r.doc_id for r in found}
    assert {i for i in before if before[i] != after[i]} == touched
    # what is left repeats no passage of 51 words, and what stays keeps its order
    left = [(i, t) for i, t in after.items()]
    seen = {}
    for i, t in left:
        w = (t or "").split()
        for j in range(len(w) - 50):
            seen.setdefault(tuple(w[j : j + 51]), set()).add(i)
    assert not [d for d in seen.values() if len(d) > 1]


def test_edges(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join("t%d" % i for i in range(30_000))
    df = spark.createDataFrame([(1, long, 1), (2, long, 2), (2, long, 2), (None, long, 3)], "doc_id long, text string, key long")
    runs = repeated_passages(df).collect()
    assert [(r.doc_id, r.kept_doc_id) for r in runs] == [(2, 1)]
    assert runs[0].n_words > 29_000


@pytest.mark.parametrize("n", [1, 23, 24, 50, 51])
def test_short_texts(spark, n):
    t = " ".join("s%d" % i for i in range(n))
    got = repeated_passages(spark.createDataFrame([(1, t), (2, t)], "doc_id long, text string")).count()
    assert got == (1 if n >= WINDOW else 0)


def test_alike_paragraphs_among_hundreds_of_template_strangers(spark):
    # strangers fill three places of a template of 120 words and are alike at 0.785, pairs at 0.81
    r = random.Random(11)
    template = ["t%d" % i for i in range(120)]

    def filled():
        w = list(template)
        for at in (3, 20, 37):
            w[at] = "own%d" % r.randrange(10**9)
        return w

    rows, pairs = [(i, " ".join(filled())) for i in range(300)], set()
    for i in range(300, 360, 2):
        w = filled()
        v = list(w)
        for at in (60, 61, 90, 119):
            v[at] = "edited%d_%d" % (i, at)
        rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
        pairs.add((i, i + 1))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(jaccard(*p) >= 0.8 for p in pairs)
    alike = [jaccard(a, b) for a in range(0, 300, 9) for b in range(a)]
    assert 0.6 < min(alike) and max(alike) < 0.8
    runs = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = {x.doc_id for x in runs if (x.start_word, x.n_words) == (0, 120)}
    assert whole <= {b for _, b in pairs}
    assert len(whole) >= 0.9 * len(pairs)


def shown(spark, rows):
    """(rows found, texts after removal), held against brute force: what a row removes still stands in the document it names."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = repeated_passages(df)
    found, after = runs.collect(), {r.doc_id: r.text.split() for r in remove_passages(df, runs).collect()}
    for r in found:
        passage, left = dict(rows)[r.doc_id].split()[r.start_word : r.start_word + r.n_words], after[r.kept_doc_id]
        assert any(left[i : i + len(passage)] == passage for i in range(len(left) - len(passage) + 1)), r
    return found, after


@pytest.mark.parametrize("n", [51, 80, 200])
def test_a_shared_passage_is_removed_whole(spark, n):
    r = random.Random(n)
    own = lambda k: ["o%d" % r.randrange(10**9) for _ in range(k)]
    rows, bodies = [], {}
    for i in range(0, 20, 2):
        passage, bodies[i + 1] = own(n), own(70)
        rows.append((i, " ".join([*own(40), *passage, *own(90)])))
        rows.append((i + 1, " ".join([*bodies[i + 1][:33], *passage, *bodies[i + 1][33:]])))
    found, after = shown(spark, rows)
    assert {(x.doc_id, x.start_word, x.n_words, x.kept_doc_id) for x in found} == {(i, 33, n, i - 1) for i in bodies}
    assert all(after[i] == bodies[i] for i in bodies)


def test_every_removed_passage_stays_where_its_row_says(spark):
    r = random.Random(8)
    own = lambda k: ["o%d" % r.randrange(10**9) for _ in range(k)]
    line, passage, p, q = own(700), own(60), own(90), own(90)
    rows = [(0, line), (1, [*line[:300], *passage, *line[300:]]), (2, [*own(40), *passage, *own(40)])]
    # 5 and 9 share all of p and q with each other, and a part of them with 3 and with 4
    rows += [(3, [*own(30), *p[20:], *own(50)]), (4, [*own(30), *q[:70], *own(50)]), (5, [*own(35), *p, *q, *own(35)]), (9, [*own(45), *p, *q, *own(45)])]
    rows += [(10, ["z"] * 100), (11, [*own(40), *["z"] * 150]), (12, own(60) * 3), (13, own(30))]
    rows += [(14, [*rows[9][1], *own(40)])]
    before = [(i, " ".join(w)) for i, w in rows]
    df = spark.createDataFrame(before, "doc_id long, text string")
    runs = repeated_passages(df)
    found, after = runs.collect(), {x.doc_id: " ".join(x.text.split()) for x in remove_passages(df, runs).collect()}
    assert (1, 0, 760, 0) in {(x.doc_id, x.start_word, x.n_words, x.kept_doc_id) for x in found}
    assert " ".join(passage) in after[2]
    for x in found:
        if x.doc_id != 1:  # alike to 0, not equal
            w = dict(rows)[x.doc_id][x.start_word : x.start_word + x.n_words]
            assert " ".join(w) in after[x.kept_doc_id], x
    kept = set(" ".join(after.values()).split())
    assert {w for i, words in rows for w in words} <= kept


def test_a_row_that_repeats_an_id_with_a_shorter_text(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "x y"), (2, None), (1, "")], "doc_id long, text string")
    runs = spark.createDataFrame([(1, 1, 3), (1, 1, 50), (2, 0, 4)], "doc_id long, start_word long, n_words long")
    assert sorted(map(str, ((r.doc_id, r.text) for r in remove_passages(docs, runs).collect()))) == sorted(map(str, [(1, "a "), (1, "x "), (2, None), (1, "")]))
