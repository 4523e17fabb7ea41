"""Byte-level BPE against the tiktoken library, and the exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from galley.llm import op10_byte_bpe as m

TEXTS = [None, "", " ", "  \n\n  x", "Hello world, it's 1234 o'clock", "naïve Straße 日本語 \U0001f600\U0001f600", "<|endoftext|> <|im_start|>", "a" * 5000, "thththththth" * 50, "x" * 300 + " y", "\x00\x01 tab\tend", "antidisestablishmentarianism " * 40]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = m.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(4, TEXTS[4])], "doc_id long, text string")
    for r in m.encode(df).collect():
        text = TEXTS[r.doc_id] or ""
        assert r.token_ids == reference.encode_ordinary(text)
        assert r.n_tokens == len(r.token_ids)
        assert bytes(r.decoded) == text.encode()


def test_digests_and_clashing_columns(spark, reference):
    df = spark.createDataFrame([(1, "some text here", 9, "z")], "doc_id long, text string, n_tokens long, w string")
    r = m.encode(df, digest=True).first()
    ids = reference.encode_ordinary("some text here")
    assert (r.n_tokens, r.w) == (len(ids), "z")
    assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert r.decoded_sha256 == hashlib.sha256(b"some text here").hexdigest()
    assert m.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_the_library(spark, reference):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in m.op10_byte_bpe(spark, sf).collect():
        ids = np.array(reference.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def coded(codec, texts):
    """Ids and decoded text of each text, all of them in one slice."""
    raw = [t.encode() for t in texts]
    out = codec.texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [(np.frombuffer(i, "<u4").tolist(), d.decode()) for i, d in out]


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, r"\S+|\s+", r"[a-z ]{1,3}|[^a-z ]"])
def test_cuts_at_spaces_change_nothing(pattern):
    import tiktoken

    ranks = m.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(5)
    odd = [" "] * 12 + list("\t\n\x0b\x1c\x1f\x85\xa0\u1680\u2003\u2028\u3000\u200b\u0301'.,-19abstdmlvreAZ\xaa\xdf\xe0\xe9\u0416\u07ff\u0800\u6f22\U0001f600\x00\x7f")
    texts = ["", " ", "a", " a", "a ", "a  b", "a b", "é é", " \u3000 x", *("".join(draw.choices(odd, k=draw.randrange(40))) for _ in range(3000)), " ", ""]
    codec = m.Codec(ranks, pattern)
    assert coded(codec, texts) == [(library.encode_ordinary(t), t) for t in texts]
    assert coded(codec, ["", ""]) == [([], "")] * 2


def test_known_words_at_hand_are_not_encoded_again(reference, monkeypatch):
    monkeypatch.setattr(m, "KEPT_WORDS", 3)
    codec, seen = m.Codec(m.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN), []
    contract = codec._contract
    monkeypatch.setattr(codec, "_contract", lambda words: [seen.extend(words), contract(words)][1])
    codec.learn(["zqxa", "zqxb"])
    codec.learn(["zqxb", "zqxc", "zqxd"])  # more than are kept: zqxa is forgotten
    assert sorted(seen) == [b"zqxa", b"zqxb", b"zqxc", b"zqxd"]
    assert coded(codec, ["zqxb zqxa"]) == [(reference.encode_ordinary("zqxb zqxa"), "zqxb zqxa")]


def test_repeated_pieces_are_cut_once(reference):
    codec, read = m.Codec(m.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN), []
    pattern = codec.pattern

    class Counted:
        def findall(self, text):
            read.append(len(text))
            return pattern.findall(text)

    codec.pattern = Counted()
    texts = ["It's 12 fields, it's 12 fields. " * 200] * 50
    assert coded(codec, texts) == [(reference.encode_ordinary(texts[0]), texts[0])] * 50
    assert sum(read) < 100
