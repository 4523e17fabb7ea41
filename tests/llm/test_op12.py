"""Repeated windows against brute force: copies, edges, periodic and long texts, frequent seeds, repeated ids."""

import hashlib
import random

import numpy as np
import pytest
from galley.llm import op12_suffix_dedup as m
from galley.llm import words


def brute(rows, length):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, kept)}"""
    docs = sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda x: (x[0], hashlib.sha256(x[1].encode()).hexdigest()))
    seen, out = set(), {}
    for i, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out[i, t] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    for i, t in rows:
        if i is None:
            out[i, t or ""] = (len((t or "").encode()), 0, 0, (t or "").encode())
    return out


def check(spark, rows, length=20, seed=7, parts=4):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, spans int, seed string").repartition(parts)
    got = sorted((r.doc_id if r.doc_id is not None else -99, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in m.without_repeats(df, length, seed).collect())
    want = brute(rows, length)
    assert got == sorted((i if i is not None else -99, *want[i, t or ""]) for i, t in rows)
    for r in m.without_repeats(df, length, seed).collect():
        assert r.n_removed == sum(s.size for s in r.spans) and r.n_spans == len(r.spans)
    return want


def corpus(seed=1):
    r = random.Random(seed)
    words_ = ["alpha", "beta", "gämma", "日本語", "δ", "epsilon", "zeta 😀", "eta"] + [f"w{i}" for i in range(200)]
    line = "this common line is in a third of all of them"
    rows = []
    for i in range(120):
        t = " ".join(r.choices(words_, k=r.choice([0, 1, 3, 30, 60])))
        if i % 3 == 0:
            t += r.choice("abcdefgh") * r.randrange(3) + line + str(r.random())
        rows.append((i * 7 % 1000, t))
    for i in range(40):  # near and exact copies
        t = rows[r.randrange(120)][1]
        cut = r.randrange(len(t) + 1)
        rows.append((2000 + i, t[:cut] + r.choice(["", "", "#", " new words "]) + t[cut:]))
    return rows + [(3000, "ab" * 200), (3001, "a" * 300), (3002, "xab" + "ab" * 50), (3003, "a" * 19), (3004, None), (3005, ""), (-4, rows[5][1]), (None, rows[3][1]), (None, None)]


def test_equals_brute_force(spark):
    want = check(spark, corpus())
    assert sum(v[1] for v in want.values()) > 3000


def test_frequent_seeds_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "FREQUENT", 5)
    monkeypatch.setattr(m, "SAMPLED", 1)
    monkeypatch.setattr(m, "PACK", 500)
    monkeypatch.setattr(m, "INDEX", 300)
    check(spark, corpus(2), parts=2)


def test_repeated_ids(spark):
    t = "one text of more than twenty bytes, and "
    rows = [(1, t + "a"), (1, t + "a"), (1, t + "b" * 30), (2, t + "a"), (2, "short"), (0, t + "zz")]
    check(spark, rows)


def test_production_parameters_and_long_texts(spark):
    r = random.Random(4)
    long = "".join(r.choices("abcdefghij \n", k=words.SLICE + 5000))
    passage = "".join(r.choices("klmnop ", k=180))
    rows = [(1, long), (2, "x" + long[1000:3000] + "y" + long[words.SLICE - 150 : words.SLICE + 150]), (3, passage), (4, "left " + passage[:99] + "!" + passage[80:] + " right"), (5, long)]
    check(spark, rows, 100, 32)


@pytest.mark.parametrize("seed", range(6))
def test_short_ends_equal_shared_prefixes(seed):
    rng = np.random.default_rng(seed)
    text = np.append(rng.integers(1, 2 + seed % 3 + 1, 400).astype(np.uint16), 0)
    text[100:180] = text[20:100]
    length = [1, 5, 12, 40, 64, 100][seed]
    order = m.suffix_order(text, length)
    raw = [tuple(text[p : p + length].tolist()) for p in order]
    assert raw == sorted(raw)
    assert m.short_ends(text, order, length).tolist() == [True] + [a != b for a, b in zip(raw, raw[1:])]


def test_empty_table(spark):
    assert m.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
