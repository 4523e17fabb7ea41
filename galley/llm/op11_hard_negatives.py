"""Hard-negative mining by product quantisation with stored residual norms.

1. Codebooks (256 centres for every two components) are fitted on at most SAMPLE rows; every row is indexed: its
   codes, and the norm of what its codes leave. The index is written once and never moves.
2. Anchors go to the index a block of bounded size at a time. A block's lookup tables give each row an
   approximate score; by Cauchy and Schwarz the true one is off by at most |anchor| * |residual|. Rows whose
   bound can't reach what is already found are left out, the rest are scored exactly in integers. A task keeps
   the first rows of each anchor, and only those are shuffled: positives first.
3. Each positive opens a window of scores. In a second pass rows of other labels whose bounds meet a window are
   scored exactly, and the first ones of each window are kept.

Nothing is approximate in the result: a bound only says which rows need not be scored, with a margin for the
rounding of floats. Ties go to the smaller vec_id.

Defined results: rows with a null vec_id or label, a null vector, or a null or non-finite component take no part.
Vectors of different lengths never meet; empty vectors meet each other with score 0. Only the anchor's own row is
not its positive: further rows with its id and other content, or equal to it, are rows like any other. Equal anchors
count once; anchors that share an id and differ return their rows under that id, each its own. An anchor without
positives, or a window without rows, returns none. Components and scores saturate at the range of a long.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.llm.common import discard, empty, materialize
from galley.llm.words import lean
from galley.tables import table

#: Rows that the codebooks are fitted on, at most; components to a code, centres of a codebook, rounds of k-means.
SAMPLE, SUB, CENTRES, ROUNDS = 8192, 2, 256, 6
#: Anchors of a block and bytes of their vectors, at most; pairs that are estimated at once.
BLOCK, BLOCK_BYTES, PAIRS = 1024, 16 << 20, 1 << 19
#: Share of the norms that the rounding of floats may add to a bound.
MARGIN = 1e-9
LONG = 2**63 - 1
POSITIVES = NEGATIVES = 5

INDEXED = "id bigint, label bigint, vec array<bigint>, codes binary, residual double"


def labelled(embeddings: DataFrame) -> DataFrame:
    """(id, label, vec) of the rows that take part: relabelled where the id is divisible by 7, floor(256 * x)."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad))
    label = F.col("label").cast("long")
    return rows.select(
        F.col("vec_id").cast("long").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vec"),
    )


def by_length(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as int64) for each length of vector."""
    vec = batch["vec"]
    vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    sizes = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        flat = (vec if len(rows) == len(sizes) else vec.take(pa.array(rows))).flatten().to_numpy(zero_copy_only=False)
        yield rows, flat.reshape(len(rows), int(d)).astype(np.int64)


def padded(x: np.ndarray, width: int) -> np.ndarray:
    """Rows as float64 of ``width`` components: cut, or filled with zeros."""
    out = np.zeros((len(x), width))
    out[:, : min(width, x.shape[1])] = x[:, :width]
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((centres**2).sum(axis=1) - 2 * (x[i : i + 4096] @ centres.T), axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def fit(sample: pa.Table) -> np.ndarray:
    """Codebooks, (parts, CENTRES, SUB), by k-means on the sample's rows; shorter rows are filled with zeros."""
    groups = [x for _, x in by_length(sample)]
    width = -(-max((x.shape[1] for x in groups), default=0) // SUB) * SUB
    x = np.concatenate([padded(g, width) for g in groups]) if groups else np.zeros((0, 0))
    books = np.zeros((width // SUB, CENTRES, SUB))
    rng = np.random.default_rng(0)
    for m in range(width // SUB if len(x) else 0):
        part = x[:, m * SUB : (m + 1) * SUB]
        c = part[rng.permutation(len(part))[np.arange(CENTRES) % len(part)]].copy()
        for _ in range(ROUNDS):
            k = nearest(part, c)
            n = np.bincount(k, minlength=CENTRES)
            for d in range(SUB):
                c[:, d] = np.where(n > 0, np.bincount(k, part[:, d], CENTRES) / np.maximum(n, 1), c[:, d])
        books[m] = c
    return books


def _encode(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in by_length(batch):
                floats = x.astype(np.float64)
                short = padded(x, len(books) * SUB)
                codes = np.zeros((len(x), len(books)), np.uint8)
                for m, book in enumerate(books):
                    codes[:, m] = nearest(short[:, m * SUB : (m + 1) * SUB], book)
                left = short - books[np.arange(len(books)), codes].reshape(len(x), -1)
                left = np.concatenate([left, floats[:, left.shape[1] :]], axis=1)  # components beyond the codebooks are left whole
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch[c].take(pa.array(rows)) for c in ("id", "label", "vec")),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(np.sqrt((left**2).sum(axis=1))),
                    ],
                    names=["id", "label", "vec", "codes", "residual"],
                )

    return run


def exact(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows q[a] and x[b], held to the range of a long."""
    out = np.zeros(len(a), np.int64)
    if not len(a) or not q.shape[1]:
        return out
    most = max(abs(int(q.max())), abs(int(q.min()))) * max(abs(int(x.max())), abs(int(x.min()))) * q.shape[1]
    if most <= LONG:
        step = max(1, (4 << 20) // (8 * q.shape[1]))
        for i in range(0, len(a), step):
            out[i : i + step] = np.einsum("ij,ij->i", q[a[i : i + step]], x[b[i : i + step]])
        return out
    for i, (u, v) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        out[i] = max(-LONG, min(LONG, sum(s * t for s, t in zip(q[u].tolist(), x[v].tolist(), strict=True))))
    return out


class Block:
    """Anchors of one length with their lookup tables: what a task needs to bound scores of indexed rows."""

    def __init__(self, at: np.ndarray, vecs: np.ndarray, labels: np.ndarray, books: np.ndarray):
        self.at, self.vecs, self.labels = at, vecs, labels
        q = padded(vecs, len(books) * SUB).reshape(len(vecs), len(books), SUB)
        self.tables = np.einsum("amd,mcd->mca", q, books)  # (part, centre, anchor)
        self.norms = np.sqrt((vecs.astype(np.float64) ** 2).sum(axis=1))
        self.spans = np.abs(self.tables).max(axis=1, initial=0).sum(axis=0)  # no estimate is larger

    def bounds(self, some: np.ndarray, codes: np.ndarray, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score of each row with each of ``some`` anchors, (rows, anchors)."""
        score = np.zeros((len(codes), len(some)))
        for m in range(codes.shape[1]):
            score += self.tables[m][:, some][codes[:, m]]
        off = residual[:, None] * (self.norms[some] * (1 + MARGIN)) + (self.spans[some] * MARGIN + 1e-6)
        return np.clip(score - off, -(2.0**63), 2.0**63), np.clip(score + off, -(2.0**63), 2.0**63)  # as scores are


def first(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each key's first ``k`` rows: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, key))
    ranked = key[order]
    return order[np.arange(len(order)) - np.searchsorted(ranked, ranked) < k]


def kth(key: np.ndarray, score: np.ndarray, n: int, k: int, least: float) -> np.ndarray:
    """The kth largest score of each key below ``n``; ``least`` where there are fewer."""
    out = np.full(n, least)
    order = np.lexsort((-score, key))
    ranked = key[order]
    rank = np.arange(len(order)) - np.searchsorted(ranked, ranked)
    out[ranked[rank == k - 1]] = score[order[rank == k - 1]]
    return out


def _blocks(anchors: pa.Table, books: np.ndarray) -> dict[int, Block]:
    labels = anchors["label"].to_numpy()
    return {x.shape[1]: Block(rows, x, labels[rows], books) for rows, x in by_length(anchors)}


def _chunks(batch: pa.RecordBatch, blocks: dict[int, Block]) -> Iterator[tuple]:
    """(block, ids, labels, vectors, codes, residuals) of few enough rows of one length at a time."""
    ids, labels, residual = (batch[c].to_numpy(zero_copy_only=False) for c in ("id", "label", "residual"))
    for rows, x in by_length(batch):
        if (block := blocks.get(x.shape[1])) is None:
            continue
        codes = np.frombuffer(b"".join(batch["codes"].take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
        step = max(1, PAIRS // len(block.at))
        for i in range(0, len(rows), step):
            r = rows[i : i + step]
            yield block, ids[r], labels[r], x[i : i + step], codes[i : i + step], residual[r]


def _positives(sent, k: int):
    """(aid, id, score, own) of each anchor's first ``k + 1`` rows of its label in a task, its own row among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, books = sent.value
        blocks = _blocks(anchors, books)
        aids, anchor_ids = anchors["aid"].to_numpy(), anchors["id"].to_numpy()
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]  # anchor, score, id, own
        for batch in batches:
            for block, ids, labels, x, codes, residual in _chunks(batch, blocks):
                least = kth(best[0], best[1], len(aids), k + 1, -np.inf)[block.at]
                found = []
                for label in np.unique(labels):
                    some, mine = np.flatnonzero(block.labels == label), np.flatnonzero(labels == label)
                    if not len(some):
                        continue
                    low, high = block.bounds(some, codes[mine], residual[mine])
                    need = least[some]
                    if len(mine) > k:  # the least that k + 1 rows of this chunk surely reach
                        need = np.maximum(need, np.partition(low, len(mine) - k - 1, axis=0)[len(mine) - k - 1])
                    b, a = np.nonzero(high >= need)
                    found.append((some[a], mine[b]))
                if found:
                    a, b = (np.concatenate(f) for f in zip(*found, strict=True))
                    own = (ids[b] == anchor_ids[block.at[a]]) & (block.vecs[a] == x[b]).all(axis=1)
                    new = [block.at[a], exact(block.vecs, x, a, b), ids[b], own]
                    best = [np.concatenate(p) for p in zip(best, new, strict=True)]
                    keep = first(best[0], best[1], best[2], k + 1)
                    best = [p[keep] for p in best]
        yield pa.RecordBatch.from_arrays([pa.array(aids[best[0]]), pa.array(best[2]), pa.array(best[1]), pa.array(best[3])], names=["aid", "id", "score", "own"])

    return run


def _negatives(sent, k: int):
    """(aid, nth, id, score): of each window, the nth of its anchor, a task's first ``k`` rows of another label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, books = sent.value
        blocks = _blocks(anchors, books)
        aids = anchors["aid"].to_numpy()
        highs = anchors["scores"].to_pylist()
        width = max(map(len, highs))
        # a window holds the scores from 80 % of the positive's, rounded up, to its own; of no window: none
        lo, hi = np.full((len(aids), width), np.inf), np.full((len(aids), width), -np.inf)
        low_at, high_at = np.full((len(aids), width), LONG, np.int64), np.full((len(aids), width), -LONG, np.int64)
        for i, scores in enumerate(highs):
            for j, s in enumerate(scores):
                low_at[i, j], high_at[i, j] = -(-80 * s // 100), s
                lo[i, j], hi[i, j] = low_at[i, j], s
        best = [np.zeros(0, np.int64)] * 3  # window, score, id
        for batch in batches:
            for block, ids, labels, x, codes, residual in _chunks(batch, blocks):
                reach = kth(best[0], best[1], lo.size, k, -np.inf).reshape(lo.shape)[block.at]
                low, high = block.bounds(np.arange(len(block.at)), codes, residual)
                meets = np.zeros(low.shape, bool)
                for j in range(width):
                    meets |= (high >= np.maximum(lo[block.at, j], reach[:, j]) * (1 - MARGIN) - 1) & (low <= hi[block.at, j] * (1 + MARGIN) + 1)
                b, a = np.nonzero(meets & (labels[:, None] != block.labels[None, :]))
                score, at = exact(block.vecs, x, a, b), block.at[a]
                new = []
                for j in range(width):
                    inside = np.flatnonzero((score >= low_at[at, j]) & (score <= high_at[at, j]))
                    new.append((at[inside] * width + j, score[inside], ids[b[inside]]))
                best = [np.concatenate([p, *q]) for p, q in zip(best, zip(*new, strict=True), strict=True)]
                keep = first(*best, k)
                best = [p[keep] for p in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(aids[best[0] // width]), pa.array((best[0] % width).astype(np.int32)), pa.array(best[2]), pa.array(best[1])], names=["aid", "nth", "id", "score"]
        )

    return run


def _by_block(index: DataFrame, anchors: DataFrame, books: np.ndarray, run, schema: str, label: str) -> DataFrame:
    """What ``run`` finds in the index, for a bounded block of anchors at a time."""
    spark = index.sparkSession
    n, size = anchors.agg(F.count("*"), F.coalesce(F.sum(8 * F.size("vec")), F.lit(0))).first()
    count = max(-(-n // BLOCK), -(-size // BLOCK_BYTES))
    found = None
    for k in range(count):
        block = anchors.where(F.pmod(F.xxhash64("aid"), F.lit(count)) == k).toArrow()
        if not block.num_rows:
            continue
        sent = spark.sparkContext.broadcast((block, books))
        part = materialize(index.mapInArrow(lean(run(sent)), schema), label)
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    return empty(spark, schema) if found is None else found


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``rows``: id, label, vec array<bigint>.

    Anchors are the rows whose id is divisible by ``every``; positives their first other rows of the same label;
    negatives the first rows of other labels with 80 * positive score <= 100 * score <= 100 * positive score.
    """
    spark = rows.sparkSession
    rows = rows.select("id", "label", "vec")
    sample = rows.withColumn("h", F.xxhash64("id")).orderBy("h", "id", "label").limit(SAMPLE).select("vec").toArrow()
    books = fit(sample)
    index = materialize(rows.mapInArrow(lean(_encode(books)), INDEXED), "index")
    anchors = index.where(F.col("id") % every == 0).select("id", "label", "vec").distinct()
    anchors = materialize(anchors.withColumn("aid", F.monotonically_increasing_id()), "anchors")
    near = _by_block(index, anchors, books, lambda sent: _positives(sent, positives), "aid bigint, id bigint, score bigint, own boolean", "positives")
    by = Window.partitionBy("aid").orderBy(F.col("score").desc(), "id", F.col("own").desc())
    ranked = near.withColumn("r", F.row_number().over(by)).where(F.col("r") <= positives + 1)
    own = F.min(F.when(F.col("own"), F.col("r"))).over(Window.partitionBy("aid"))
    ranked = ranked.withColumn("own_r", F.coalesce(own, F.lit(positives + 2))).where(F.col("r") != F.col("own_r"))
    nth = (F.col("r") - 1 - (F.col("r") > F.col("own_r")).cast("int")).alias("nth")
    near = materialize(ranked.select("aid", nth, F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).where(F.col("nth") < positives), "near")
    windows = near.groupBy("aid").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    windows = materialize(anchors.join(windows, "aid"), "windows")
    met = _by_block(index, windows, books, lambda sent: _negatives(sent, negatives), "aid bigint, nth int, id bigint, score bigint", "negatives")
    by = Window.partitionBy("aid", "nth").orderBy(F.col("score").desc(), "id")
    met = met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    discard(index)
    return (
        met.join(near, ["aid", "nth"]).join(anchors.select("aid", F.col("id").alias("anchor_id")), "aid")
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(labelled(table(spark, sf_dir, "embeddings")))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
