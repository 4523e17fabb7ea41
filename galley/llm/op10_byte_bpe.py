"""Byte-level BPE encoding and decoding by DuckDB recursive queries within each partition.

A text is cut by the tokenizer's pattern into words; what of a slice of texts repeats between two spaces is
cut once. The distinct words of a slice that are not tokens themselves become rows (word, position, token,
next token); a recursive query joins them with the merge table, takes each word's leftmost pair of minimum
rank and contracts it, until no word has a pair left. The ids of a word are its rows in order, and an ordered
join with the vocabulary decodes ids to bytes. Encoded words are kept for the task's next texts; beyond a
number of entries only those of the texts at hand are, among them the frequent ones. This saves work and
changes no result.

Spark deals out the texts, one slice of a few MB is in work at a time, and a lost task is repeated from its
input. The vocabulary is one file of fixed size (0.5 MB), read by the driver and sent to the executors.

Defined results: a null text counts as empty and has no tokens; equal rows give equal rows; a word of more
than LONG bytes is merged by a heap instead, with the same rule, as contracting one pair a round takes as
many rounds as it has bytes. No special tokens exist: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galley.llm.words import slices, text_buffers
from galley.tables import importable, table

LONG = 256
WORDS_AT_ONCE = 25_000
KEPT_WORDS = 250_000
_SOLID = np.zeros(256, bool)  # bytes that are a character and no white space
_SOLID[0x21:0x7F] = True
_PAIR = np.zeros(256, bool)  # first bytes of two that are a character and no white space
_PAIR[0xC3:0xE0] = True

#: One row for each byte of a word that is not contracted into its right neighbour: a contracted pair takes
#: the right one's place, so only rows of the same word change. x: rank, left place and right place in one.
ENCODE = """
WITH RECURSIVE s(it, w, pos, tok, nxt, npos) AS (
  SELECT 0, w, pos, tok, nxt, npos FROM bytes_of_words
  UNION ALL
  SELECT s.it + 1, s.w, s.pos,
    CAST(CASE WHEN s.pos = b.rp THEN b.rank ELSE s.tok END AS INTEGER),
    CAST(CASE WHEN s.npos = b.p THEN b.rank ELSE s.nxt END AS INTEGER),
    CAST(CASE WHEN s.npos = b.p THEN b.rp ELSE s.npos END AS INTEGER)
  FROM s JOIN (
    SELECT w, x >> 46 AS rank, (x >> 23) & 8388607 AS p, x & 8388607 AS rp
    FROM (SELECT s.w, min((CAST(m.rank AS BIGINT) << 46) | (CAST(s.pos AS BIGINT) << 23) | s.npos) AS x
          FROM s JOIN merges m ON m.pair = CAST(s.tok AS BIGINT) * 4294967296 + s.nxt GROUP BY s.w)
  ) b ON s.w = b.w
  WHERE s.pos <> b.p
), ends AS (SELECT w, max(it) AS it FROM s GROUP BY w)
SELECT w, tok FROM s JOIN ends USING (w, it) ORDER BY w, pos
"""
DECODE = "SELECT v.bytes FROM tokens t JOIN vocabulary v USING (id) ORDER BY t.pos"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token to rank of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges(ranks: dict[bytes, int]) -> tuple[np.ndarray, ...]:
    """(left, right, rank): the pairs of tokens that make a token."""
    pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return tuple(np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3


def between_spaces(data: np.ndarray) -> np.ndarray:
    """Where no match of public_tokenizers.PATTERN crosses: spaces after one and before another solid character.

    A match has a space behind its first character only in a run of white space, and such a run begins here;
    nothing looks back, and what looks ahead stands before the other end of its run.
    """
    p = np.flatnonzero(data == 32)
    p = p[(p > 1) & (p < len(data) - 1)]
    a, b, c = data[p - 2], data[p - 1], data[p + 1]
    return p[(_SOLID[b] | _PAIR[a] & (b >= 128)) & (_SOLID[c] | _PAIR[c])]


def _array(data: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The values data[at[i]:at[i + 1]], without a copy."""
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])


class Codec:
    """Encodes and decodes words in DuckDB; one per task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: tuple[np.ndarray, ...] | None = None):
        import duckdb
        import public_tokenizers
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.spaced = pattern == public_tokenizers.PATTERN
        self.known: dict[str, tuple[bytes, bytes]] = {}  # a word's ids, and the bytes that they decode to
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute("SET memory_limit = '300MB'")
        left, right, rank = merges(ranks) if pairs is None else pairs
        self.table("m", {"pair": (left << 32) + right, "rank": rank.astype(np.int32)})
        self.table("v", {"id": np.fromiter(ranks.values(), np.int32, len(ranks)), "bytes": pa.array(list(ranks), pa.binary())})
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")

    def table(self, name: str, columns: dict) -> None:
        self.db.register(name, pa.table(columns))

    def _long(self, word: bytes) -> list[int]:
        tok = self.byte[np.frombuffer(word, np.uint8)].tolist()
        part = [bytes([b]) for b in word]
        after, before = [*range(1, len(tok)), -1], [-1, *range(len(tok) - 1)]
        heap = [(r, i, part[i], part[i + 1]) for i in range(len(tok) - 1) if (r := self.ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or part[i] != a or part[j] != b:
                continue  # one of the two has been contracted since
            part[i], tok[i], part[j] = a + b, r, b""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (s := self.ranks.get(part[x] + part[y])) is not None:
                    heapq.heappush(heap, (s, x, part[x], part[y]))
        out, i = [], 0
        while i >= 0:
            out.append(tok[i])
            i = after[i]
        return out

    def learn(self, words: list[str]) -> None:
        """Encode and decode what of the distinct ``words`` is not known yet."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known = {w: self.known[w] for w in words if w in self.known}
        for at in range(0, len(new), WORDS_AT_ONCE):
            chunk = new[at : at + WORDS_AT_ONCE]
            raw = [w.encode() for w in chunk]
            ready = {i: [r] for i, x in enumerate(raw) if (r := self.ranks.get(x)) is not None}
            ready |= {i: self._long(x) for i, x in enumerate(raw) if len(x) > LONG and i not in ready}
            rest = [i for i in range(len(raw)) if i not in ready]
            packed: list[bytes] = [b""] * len(raw)
            for i, ids in ready.items():
                packed[i] = np.array(ids, "<u4").tobytes()
            if rest:
                for i, ids in zip(rest, self._contract([raw[i] for i in rest]), strict=True):
                    packed[i] = ids
            self.known.update(zip(chunk, zip(packed, self._expand(packed), strict=True), strict=True))

    def _contract(self, words: list[bytes]) -> list[bytes]:
        size = np.array([len(w) for w in words])
        w = np.repeat(np.arange(len(words)), size)
        pos = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        last = pos == size[w] - 1
        nxt = np.where(last, -1, np.append(tok[1:], -1))
        self.table("bytes_of_words", {"w": w.astype(np.int32), "pos": pos.astype(np.int32), "tok": tok.astype(np.int32), "nxt": nxt.astype(np.int32), "npos": np.where(last, 8388607, pos + 1).astype(np.int32)})
        found = self.db.sql(ENCODE).to_arrow_table()
        ids = found["tok"].to_numpy().astype("<u4").tobytes()
        cut = (4 * np.searchsorted(found["w"].to_numpy(), np.arange(len(words) + 1))).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _expand(self, packed: list[bytes]) -> list[bytes]:
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
        self.table("tokens", {"pos": np.arange(len(ids), dtype=np.int32), "id": ids})
        data, offsets = text_buffers(self.db.sql(DECODE).to_arrow_table()["bytes"])
        data, cut = data.tobytes(), offsets[np.cumsum([0, *(len(x) // 4 for x in packed)])].tolist()
        return [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def close(self) -> None:
        """Leave nothing behind in a worker that goes on to other tasks."""
        self.known.clear()
        self.db.close()

    def words(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(the words of ``pieces``, where those of each piece begin and the last ones end)."""
        data, at = text_buffers(pieces)
        # pieces that meet where no match crosses are cut in one call
        apart = at[~np.isin(at, between_spaces(data))] if self.spaced else at
        together = _array(data, apart, pa.large_string())
        cut = list(map(self.pattern.findall, together.to_numpy(zero_copy_only=False)))
        words = pa.array(list(chain.from_iterable(cut)), pa.large_string())
        return words, np.searchsorted(text_buffers(words)[1], at) if self.spaced else np.cumsum([0, *map(len, cut)])

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, the bytes that they decode to) of each text data[offsets[i]:offsets[i + 1]]."""
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        if self.spaced:
            edge[between_spaces(data)] = True
        start = np.flatnonzero(edge)
        pieces = _array(data, start, pa.large_string()).dictionary_encode()
        words, of_piece = self.words(pieces.dictionary)
        words = words.dictionary_encode()
        own = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(own)
        found, of_text = [self.known[w] for w in own], np.searchsorted(start, offsets)
        out = []
        for j in (0, 1):
            got, end = text_buffers(pa.array([x[j] for x in found], pa.large_binary()).take(words.indices))
            got, end = text_buffers(_array(got, end[of_piece], pa.large_binary()).take(pieces.indices))
            out.append((got.tobytes(), end[of_text].tolist()))
        (ids, a), (raw, b) = out
        for i in range(len(offsets) - 1):
            yield ids[a[i] : a[i + 1]], raw[b[i] : b[i + 1]]


def _coded(sent, pattern: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pairs = sent.value
        codec = Codec(ranks, pattern, pairs)
        for batch in batches:
            rest = batch.schema.names[:-1]
            for data, offsets, row in slices(batch.column(len(rest)), 2 << 20):
                part = batch.slice(row, len(offsets) - 1)
                out = list(codec.texts(data, offsets))
                n = pa.array([len(i) // 4 for i, _ in out], pa.int64())
                if digest:
                    more = [n, *(pa.array([hashlib.sha256(x[j]).hexdigest() for x in out], pa.string()) for j in (0, 1))]
                else:
                    ids = [np.frombuffer(i, "<u4").astype(np.int64) for i, _ in out]
                    more = [n, pa.array(ids, pa.list_(pa.int64())), pa.array([d for _, d in out], pa.binary())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "token_ids", "decoded"]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(rest))), *more], names=[*rest, *names])
        codec.close()

    return run


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, digest: bool = False) -> DataFrame:
    """The other columns of ``docs`` with n_tokens, token_ids and decoded, or with the digests of both.

    ``path``: a .tiktoken file that the driver can read; ``pattern``: its words. Columns of ``docs`` that
    have a result's name are replaced.
    """
    import public_tokenizers

    spark = docs.sparkSession
    importable(spark)
    ranks = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    sent = spark.sparkContext.broadcast((ranks, merges(ranks)))
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "token_ids", "decoded"]
    rest = docs.drop(text, *names)
    types = [T.LongType(), T.StringType(), T.StringType()] if digest else [T.LongType(), T.ArrayType(T.LongType()), T.BinaryType()]
    schema = T.StructType([*rest.schema.fields, *(T.StructField(n, t) for n, t in zip(names, types, strict=True))])
    return docs.select(*[F.col(f"`{c}`") for c in rest.columns], F.col(text).cast("string").alias("__text")).mapInArrow(
        _coded(sent, pattern or public_tokenizers.PATTERN, digest), schema
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
