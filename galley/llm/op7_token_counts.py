"""Token counts by offset-mapped attribution.

Each whole document is encoded once. Tokens and sections both become spans of the text: a token's span
comes from its bytes, a section is a paragraph (up to and with its line feed). Spans are interval-joined by
binary search within the task, and each token counts once:

    a token belongs to the section that holds most of its bytes; of two with equally many, to the earlier.

So the counts of a document's sections add up to its own count, which separate encodings of the sections
would not. A field's count is that of the sections from its first to its last.

Defined results: a null or empty text has one section of no tokens; sections are numbered from 0; equal rows
give equal rows; special tokens do not exist. Columns of the input besides key and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.op10_byte_bpe import read_ranks
from galley.llm.words import slices
from galley.tables import importable, table


def attribute(token_end: np.ndarray, section_end: np.ndarray) -> np.ndarray:
    """The section of each token; both tile the same bytes, given by their ends in order."""
    if not len(token_end):
        return np.zeros(0, np.int64)
    start = np.append(0, token_end[:-1])
    first = np.searchsorted(section_end, start, "right")
    last = np.searchsorted(section_end, token_end - 1, "right")
    out = first.copy()
    for i in np.flatnonzero(last > first):  # the few that cross a boundary
        bounds = np.concatenate([[start[i]], section_end[first[i] : last[i]], [token_end[i]]])
        out[i] = first[i] + int(np.argmax(np.diff(bounds)))
    return out


_encoders: dict[str, tuple] = {}


def _encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    if pattern not in _encoders:
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        _encoders[pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _encoders[pattern]


def _counted(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = _encoder(ranks.value, pattern)
        for batch in batches:
            for data, offsets, row in slices(batch["text"]):
                counts, chars, crossing, sections = [], [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    raw = data[a:b]
                    ids = np.asarray(encoder.encode_to_numpy(raw.tobytes().decode(), allowed_special=set(), disallowed_special=()))
                    ends = np.flatnonzero(raw == 10) + 1
                    ends = ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))
                    token_end = np.cumsum(size[ids])
                    at = attribute(token_end, ends)
                    begin = np.append(0, ends[:-1])
                    lead = np.append(0, np.cumsum((raw & 0xC0) != 0x80))  # code points before each byte
                    first = np.searchsorted(ends, np.append(0, token_end[:-1])[: len(ids)], "right")
                    crosses = ends[np.minimum(first, len(ends) - 1)] < token_end
                    counts.append(np.bincount(at, minlength=len(ends)))
                    crossing.append(np.bincount(at, crosses, minlength=len(ends)).astype(np.int64))
                    chars.append(lead[ends] - lead[begin])
                    sections.append(len(ends))
                ids = batch["doc_id"].slice(row, len(sections)).take(pa.array(np.repeat(np.arange(len(sections)), sections)))
                number = np.concatenate([np.arange(n) for n in sections])
                columns = [ids, *(pa.array(np.asarray(x, np.int64)) for x in (number, np.concatenate(chars), np.concatenate(counts), np.concatenate(crossing)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "section", "n_chars", "n_tokens", "n_crossing"])

    return run


def section_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, section, n_chars, n_tokens, n_crossing): n_crossing counts its tokens that reach into another section."""
    import public_tokenizers

    spark = docs.sparkSession
    importable(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_counted(ranks, pattern or public_tokenizers.PATTERN), "doc_id bigint, section bigint, n_chars bigint, n_tokens bigint, n_crossing bigint")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))
