"""Logistic mixing: bit by bit in plain Python, as a distribution, and on held-out texts; the base by counting."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from galley.llm import op4_logistic_mixing as m

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    return docs, m.op4_logistic_mixing(spark, SF).collect()


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ")


def test_base_counts_and_held_out_bits(scored):
    docs, rows = scored
    out = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    count, end = Counter(), 0
    for i, t in docs.items():
        if i not in out:
            count.update(w for w in words(t) if w)
            end += 1
    n, v = sum(count.values()) + end, len(count) + 1
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        c = [count[w] for w in words(docs[r.doc_id]) if w] + [end]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in out, len(c), sum(x > 0 for x in c), n)
        assert math.isclose(r.base_score, sum(math.log10((x + 1) / (n + v + 1)) for x in c), rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    size = sum(len(docs[r.doc_id].encode()) + 1 for r in held)
    assert -sum(r.score for r in held) / math.log10(2) / size < 2.6
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)


def test_scores_equal_a_plain_version_and_are_a_distribution(spark):
    texts = [(i, "the cat sat on the mat and the cat ran " * 3 + str(i)) for i in range(40)]
    mixer, sums = m.train(spark.createDataFrame(texts, "doc_id long, text string"))
    counts = {(r.kind, r.key): r.n for r in sums.collect()}
    joined = b"\0".join(t.encode() for _, t in texts) + b"\0"
    assert sum(n for (k, _), n in counts.items() if k == m.GRAM) == len(joined)  # every byte of every training text
    ones = sum(bin(x).count("1") for x in joined)
    assert abs(float(mixer.counts[1].astype(float).sum()) - 6 * ones) < 0.01 * 6 * ones  # float16 rounds large counts
    with np.errstate(over="ignore"):
        whole = np.uint64(0x6361746361) << np.uint64(8) | np.arange(256, dtype=np.uint64)
        assert np.allclose((2.0 ** -mixer.cost(whole).astype(float)).sum(axis=0), 1, atol=1e-5)
        for text in (b"", b"the cat", "the mät \x00 sat on".encode() * 90):
            bits, keys, first = mixer.texts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            coded, blocks, total = text + b"\0", [], []
            place = 0  # in the chunk
            for i in range(len(coded)):
                history = (b"\0" * m.ORDERS + coded)[i + 1 : i + 1 + m.ORDERS]
                gram = np.array([int.from_bytes(history, "big")], np.uint64)
                if place == 0:
                    total.append(0.0)
                if place % m.BLOCK == 0:
                    blocks.append([0.0, 0.0, len(total) - 1])
                cost = mixer.cost(gram)[0]
                blocks[-1][0] += float(cost[0])
                blocks[-1][1] += float(cost[1])
                place = 0 if int(m.mix(gram)[0]) % 2**m.CHUNK_BITS == 0 else place + 1
            for i, (x, y, chunk) in enumerate(blocks):
                before = blocks[max(0, i - m.MEMORY) : i]
                share = 1 / (1 + 2 ** (sum(z[0] for z in before) - sum(z[1] for z in before)))
                share = min(max(share, 1 / 64), 63 / 64)
                total[chunk] -= math.log2(share * 2**-x + (1 - share) * 2**-y)
            assert len(keys) == len(total) and list(first) == [0, len(total)]
            assert np.allclose(bits, total, rtol=1e-6)


def test_a_text_that_occurs_twice_is_scored_apart(spark):
    rnd = np.random.default_rng(3)
    vocab = ["".join(rnd.choice(list("abcdefghij"), 6)) for _ in range(400)]
    texts = [(i, " ".join(rnd.choice(vocab, 300)), i % 7 == 2) for i in range(200)]
    texts += [(1000 + i, texts[i][1], False) for i in (0, 2, 9)]  # 2 and 9 are held out
    df = spark.createDataFrame(texts, "doc_id long, text string, held_out boolean")
    rate = {r.doc_id: r.bits_per_byte for r in m.score(df, df.where("not held_out").select("doc_id", "text")).collect()}
    twice = {0, 1000, 2, 9}
    assert max(rate[i] for i in twice) < 0.5 * min(x for i, x in rate.items() if i not in twice | {1002, 1009})
    assert rate[1002] > 2 * rate[2]  # the only copy that was learned from doesn't count for itself


@pytest.mark.parametrize("n", [599, 600, 601])
def test_no_size_changes_what_is_learned(spark, n):
    df = spark.createDataFrame([(i, "aaab %d" % i) for i in range(n)], "doc_id long, text string")
    _, sums = m.train(df)
    assert sums.where(f"kind = {m.TOKEN}").agg({"n": "sum"}).first()[0] == 3 * n


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "one two two"), (3, "one two two"), (None, "x " * 50_000)]
    df = spark.createDataFrame([(a, b, False) for a, b in rows], "doc_id long, text string, held_out boolean").selectExpr("doc_id", "coalesce(text, '') text", "held_out")
    got = m.score(df, df.select("doc_id", "text")).collect()
    assert sorted((r.n_tokens, r.n_known) for r in got) == [(1, 1), (1, 1), (4, 4), (4, 4), (50_001, 50_001)]
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    none = m.score(df, df.select("doc_id", "text").limit(0)).collect()
    assert {r.n_known for r in none} == {0} and {r.train_tokens for r in none} == {0}


def test_settings_of_the_cluster_change_no_score(spark, monkeypatch):
    monkeypatch.setattr(m, "FOLD", 4000)  # several parts
    rnd = np.random.default_rng(8)
    vocab = ["".join(rnd.choice(list("abcdefghijklmnop"), rnd.integers(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(i, " ".join(rnd.choice(vocab, 60)), i % 7 == 2) for i in range(300)], "doc_id long, text string, held_out boolean").repartition(5)
    got, held = [], {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for parts, rows in ((4, 10_000), (9, 2_000)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            got.append({r.doc_id: r.score for r in m.score(df, df.where("not held_out").select("doc_id", "text")).collect()})
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert set(got[0]) == set(got[1]) and all(math.isclose(got[0][i], got[1][i], rel_tol=1e-9) for i in got[0])
