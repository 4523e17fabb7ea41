"""Benchmark decontamination by greedy string tiling.

Rolling (Karp-Rabin) hashes of every LEAST consecutive words of the benchmark are the seeds. Each document's
rolling hashes are joined with them; consecutive hits on one diagonal are a match. For every (document,
item) with a hit the longest match of unmarked words is marked on both sides, again and again until none of
LEAST words is left: the tiles. Their share of the item's words is its coverage, which reordered passages
keep. An item that a document covers to THRESHOLD contaminates it.

Seeds are broadcast, in blocks of a bounded number: a larger benchmark makes more passes over the documents,
each with one block of items. A document's tiles against one item are found in the task that reads it.

Defined results: null and empty texts match nothing, nor does an empty item; an item of fewer than LEAST words
matches where all of its words stand in a row; repeated rows of documents give repeated results; of items
with one id the text that sorts first is taken; rows with a null id take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.words import words
from galley.tables import importable, table

LEAST = 5
THRESHOLD = 0.5
#: Items whose seeds are broadcast at once, by their words together.
BLOCK_WORDS = 2_000_000


def tiles(doc_at: np.ndarray, item_at: np.ndarray, length: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(document word, item word, words) of greedy tiles from the hits of ``least`` words (or ``length``).

    Longest first; equal lengths go to the earlier place in the item, then in the document. A match that
    earlier tiles have cut goes back with what is left of it.
    """
    diagonal = doc_at - item_at
    order = np.lexsort((doc_at, diagonal))
    d, x, n = diagonal[order], doc_at[order], length[order]
    cut = np.flatnonzero((d[1:] != d[:-1]) | (x[1:] != x[:-1] + 1)) + 1
    runs = zip(np.append(0, cut).tolist(), np.append(cut, len(x)).tolist(), strict=True)
    heap = [(-int(b - a - 1 + n[b - 1]), int(x[a] - d[a]), int(x[a])) for a, b in runs]
    heapq.heapify(heap)
    doc_marked: set[int] = set()
    item_marked: set[int] = set()
    out = []
    while heap:
        size, item, doc = heapq.heappop(heap)
        size = -size
        free = [i for i in range(size) if doc + i not in doc_marked and item + i not in item_marked]
        if len(free) == size:
            doc_marked.update(range(doc, doc + size))
            item_marked.update(range(item, item + size))
            out.append((doc, item, size))
            continue
        for i, at in enumerate(free):  # the free stretches of this match
            if i and free[i - 1] == at - 1:
                continue
            end = i
            while end + 1 < len(free) and free[end + 1] == free[end] + 1:
                end += 1
            if end - i + 1 >= least:
                heapq.heappush(heap, (-(end - i + 1), item + at, doc + at))
    return out


class Seeds:
    """Sorted rolling hashes of a block of items."""

    def __init__(self, ids: list[int], texts: list[str], least: int):
        self.least, self.items, self.size = least, np.array(ids, np.int64), np.zeros(len(ids), np.int64)
        found: dict[int, list] = {}
        for w in words(pa.array(texts, pa.string())):
            size = np.diff(w.first)
            self.size[w.row : w.row + len(w)] = size
            with np.errstate(over="ignore"):
                for k in {least, *(int(n) for n in np.unique(size) if 0 < n < least)}:
                    h, ok = w.shingles(k)
                    item = np.repeat(np.arange(len(w)), size)
                    ok = ok & ((size[item] == k) if k < least else True)
                    at = np.flatnonzero(ok)
                    found.setdefault(k, []).append((h[at], item[at] + w.row, at - w.first[item[at]]))
        self.by_length = {}
        for k, parts in found.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.by_length[k] = (h[order], item[order], at[order])

    def hits(self, w) -> tuple[np.ndarray, ...]:
        """(document word, item, item word, words) of every hit."""
        out = []
        for k, (h, item, at) in self.by_length.items():
            if not len(h):
                continue
            own, ok = w.shingles(k)
            a = np.searchsorted(h, own)
            where = np.flatnonzero(ok & (h[np.minimum(a, len(h) - 1)] == own))
            a = a[where]
            n = np.searchsorted(h, own[where], "right") - a
            pick = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(where, n), item[pick], at[pick], np.full(len(pick), k)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _matched(block, least: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(*block.value, least)
        for batch in batches:
            ids, out = batch["doc_id"].to_numpy(zero_copy_only=False), []
            for w in words(batch["text"]):
                with np.errstate(over="ignore"):
                    doc_at, item, item_at, length = seeds.hits(w)
                if not len(doc_at):
                    continue
                text = np.searchsorted(w.first, doc_at, "right") - 1
                order = np.lexsort((item, text))
                doc_at, item, item_at, length, text = (x[order] for x in (doc_at, item, item_at, length, text))
                cut = np.flatnonzero((text[1:] != text[:-1]) | (item[1:] != item[:-1])) + 1
                for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(text)).tolist(), strict=True):
                    i, size = text[a], int(seeds.size[item[a]])
                    # fewer distinct words hit than the threshold asks for: no tiling can reach it
                    most = len(np.unique(np.concatenate([item_at[a:b] + j for j in range(min(least, size))])))
                    if most < threshold * size:
                        continue
                    got = tiles(doc_at[a:b] - w.first[i], item_at[a:b], length[a:b], min(least, size))
                    covered = sum(n for _, _, n in got)
                    if covered >= threshold * size:
                        out.append((int(ids[w.row + i]), int(seeds.items[item[a]]), len(got), covered, size, covered / size))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            types = [pa.int64()] * 5 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "n_tiles", "covered_words", "item_words", "coverage"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered_words, item_words, coverage) of every contaminated document and item."""
    spark = docs.sparkSession
    importable(spark)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text")).orderBy("item_id")
    schema = "doc_id long, item_id long, n_tiles long, covered_words long, item_words long, coverage double"
    found, ids, block, size = None, [], [], 0

    def add(found: DataFrame | None) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, block))
        part = texts.mapInArrow(_matched(sent, least, threshold), schema)
        return part if found is None else found.unionByName(part)

    for row in items.toLocalIterator():  # a block of items at a time is in the driver
        ids.append(int(row.item_id))
        block.append(row.text)
        size += len(row.text.split())
        if size >= block_words:
            found, ids, block, size = add(found), [], [], 0
    return add(found) if ids or found is None else found


def op9_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
