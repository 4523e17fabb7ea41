"""Each stage of the pipeline on its own input, and the whole."""

import random

import corpus_pipeline as p
from galley.llm.op10_byte_bpe import read_ranks


def test_stages(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    r = random.Random(8)
    en, fr = ["the", "and", "of", "with", "house", "that", *("wh%dth" % i for i in range(300))], ["le", "et", "les", "avec", "maison", "qui", *("eau%dé" % i for i in range(300))]
    say = lambda v, n: " ".join(r.choice(v) for _ in range(n))
    rows = [(i, say(en if i % 2 else fr, 120), "en" if i % 2 else "fr", "s", 0) for i in range(60)]
    copy, passage, item = rows[1][1], say(en, 70), say(en, 40)
    rows += [(100, copy, "en", "s", 0), (101, copy.replace("the", "the", 1) + " x", "en", "s", 0)]
    rows += [(110 + i, say(en, 40 + i) + " " + passage + " " + say(en, 30), "en", "s", 0) for i in range(3)]
    rows += [(120, say(fr, 50) + " " + item + " " + say(fr, 50), "fr", "s", 0), (130, "123 456", "en", "s", 0), (131, None, None, None, None), (132, "", "en", "s", 0), (None, say(en, 50), "en", "s", 0)]
    rows = [(a, b, c, d, len(b) if b is not None else None) for a, b, c, d, _ in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: {x.doc_id for x in df.collect()}
    everything = {a for a, *_ in rows}

    first = p.materialize(p.language_id(spark, docs, str(tmp_path)))
    assert first.columns == docs.columns and ids(first) == everything - {130, 131, 132, None}
    second = p.materialize(p.near_dedup(spark, first, str(tmp_path)))
    assert second.columns == docs.columns and ids(second) == ids(first) - {100, 101}
    third = p.materialize(p.substring_dedup(spark, second, str(tmp_path)))
    before, after = {x.doc_id: x.text for x in second.collect()}, {x.doc_id: x for x in third.collect()}
    assert set(before) == set(after) and third.columns == docs.columns
    assert {i for i in before if before[i] != after[i].text} == {111, 112}
    assert passage in after[110].text and all(len(x.text) == x.n_chars for x in after.values())
    fourth = p.materialize(p.decontamination(spark, third, str(tmp_path)))
    assert ids(fourth) == set(after) - {120}
    last = p.byte_bpe(spark, fourth, str(tmp_path)).collect()
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {x.doc_id for x in last} == ids(fourth)
    assert all(x.token_ids == encoder.encode_ordinary(after[x.doc_id].text) and x.text == after[x.doc_id].text for x in last)
    assert ids(p.run(spark, str(tmp_path))) == ids(fourth)
