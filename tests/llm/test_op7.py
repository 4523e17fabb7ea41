"""Offset-mapped token counts against tokens counted one by one."""

import public_tokenizers
from galley.llm.op7_token_counts import section_tokens
from galley.llm.op10_byte_bpe import read_ranks

TEXTS = [None, "", "\n", "a\n\nb\n", "one line", "Étage\n  \n\n 日本語\n\U0001f600 x", "\n\n\n\n\n\nword", "x" * 40_000 + "\n" + "y " * 3000]


def plain(encoder, text):
    raw, out, at = (text or "").encode(), [], 0
    owner, s = [], 0
    for b in raw:
        owner.append(s)
        s += b == 10
    n = s + (not raw.endswith(b"\n"))
    counts = [[0, 0] for _ in range(max(n, 1))]
    for t in encoder.encode_ordinary(text or ""):
        size = len(encoder.decode_single_token_bytes(t))
        mine = owner[at : at + size]
        best = max(sorted(set(mine)), key=mine.count)
        counts[best][0] += 1
        counts[best][1] += len(set(mine)) > 1
        at += size
    return counts


def test_counts(spark):
    import tiktoken

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3])]
    got = {}
    for r in section_tokens(spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, section int")).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.n_tokens, r.n_crossing, r.n_chars))
    for i, t in enumerate(TEXTS):
        found = sorted(set(got[i]))
        assert [[n, c] for _, n, c, _ in found] == plain(encoder, t)
        assert sum(c for *_, c in found) == len(t or "")
        assert sum(n for _, n, *_ in found) == len(encoder.encode_ordinary(t or ""))
    assert len(got[3]) == 2 * len(set(got[3]))
    assert section_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
