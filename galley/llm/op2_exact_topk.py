"""Exact top-k search: distributed histogram selection.

Every (query, candidate) pair is scored block by block, and only histograms leave a block. Round by round
the histograms of all blocks are summed per query, the bin that holds the query's kth score is found, and
the next round divides that bin further, until bins are single scores. A last pass keeps what reaches the
kth value, and ties at it go to the smaller id. Blocks hold a bounded number of vectors, so neither the
queries nor the candidates need fit in one task; a block's histogram stops at its own kth best score,
below which no global kth score of that query can lie, so it has at most k bins.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part; pairs
of different lengths are not scored; a query never meets its own row; with fewer than k candidates all are
returned. Rows that repeat an id count as one vector each as candidates but never match that id's query.
Scores are exact integers; components and scores saturate at the range of a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.llm.common import materialize
from galley.tables import table

QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
BITS = 10  # a round's bins for each query: 2^BITS
LONG = 2**63 - 1


def _matrix(vectors: pd.Series, bound: int) -> np.ndarray:
    """Rows as float64 where products stay exact in it, else as int64."""
    m = np.stack([np.asarray(v, np.int64) for v in vectors])
    return m.astype(np.float64) if bound < 2**53 else m


def _scores(q: pd.DataFrame, c: pd.DataFrame, bound: int) -> np.ndarray:
    a, b = _matrix(q["vec"], bound), _matrix(c["vec"], bound)
    scores = (a @ b.T).astype(np.int64)
    if bound > LONG:  # pairs whose product may leave the range of a long: exact integers, then held to it
        most = [np.abs(m.astype(np.float64)).max(axis=1) for m in (a, b)]
        for i, j in np.argwhere(np.outer(*most) * a.shape[1] > LONG * (1 - 1e-9)).tolist():
            scores[i, j] = max(-LONG, min(LONG, sum(x * y for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True))))
    scores[q["id"].to_numpy()[:, None] == c["id"].to_numpy()[None, :]] = np.iinfo(np.int64).min  # not a query's own row
    return scores


def _histograms(q: pd.DataFrame, c: pd.DataFrame, shift: int, k: int, bound: int) -> pd.DataFrame:
    """(id, bin, n): for each query the bins within its last bin, the best first, until k are counted."""
    if not len(q) or not len(c):
        return pd.DataFrame({"id": [], "bin": [], "n": []}).astype("int64")
    scores, (lo, hi) = _scores(q, c, bound), (q["lo"].to_numpy()[:, None], q["hi"].to_numpy()[:, None])
    scores = np.where((scores >= lo) & (scores <= hi), scores, np.iinfo(np.int64).min)
    n, some = scores.shape[1], min(k, scores.shape[1])
    best = np.partition(scores, n - some, axis=1)[:, n - some :]
    rows = np.nonzero(best > np.iinfo(np.int64).min)
    # all of a bin's scores count, not only those among the k best: the bin at the edge is counted whole
    edge = np.where(best.min(axis=1) > np.iinfo(np.int64).min, best.min(axis=1) >> shift, np.iinfo(np.int64).min >> shift)
    keep = np.nonzero((scores > np.iinfo(np.int64).min) & ((scores >> shift) >= edge[:, None])) if len(rows[0]) else rows
    found = pd.DataFrame({"id": q["id"].to_numpy()[keep[0]], "bin": scores[keep] >> shift})
    return found.groupby(["id", "bin"], sort=False).size().rename("n").reset_index().astype("int64")


def _reaching(q: pd.DataFrame, c: pd.DataFrame, k: int, bound: int) -> pd.DataFrame:
    """(query_id, vec_id, score) of what reaches the kth score; of each query the first k of the block, so that ties send on no more."""
    if not len(q) or not len(c):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    scores = _scores(q, c, bound)
    rows, cols = np.nonzero((scores >= q["lo"].to_numpy()[:, None]) & (scores > np.iinfo(np.int64).min))
    ids, score = c["id"].to_numpy()[cols], scores[rows, cols]
    order = np.lexsort((ids, -score, rows))
    rows, ids, score = rows[order], ids[order], score[order]
    first = np.searchsorted(rows, rows)
    kept = np.arange(len(rows)) - first < k
    return pd.DataFrame({"query_id": q["id"].to_numpy()[rows[kept]], "vec_id": ids[kept], "score": score[kept]})


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` largest integer inner products.

    Both inputs: id long, vec array<bigint>. Query ids are taken once each.
    """
    whole = F.col("id").isNotNull() & (F.coalesce(F.size("vec"), F.lit(0)) > 0) & ~F.exists("vec", lambda x: x.isNull())
    queries = queries.where(whole).groupBy("id").agg(F.min("vec").alias("vec"))
    candidates = candidates.where(whole).select("id", "vec")
    # one query block and one candidate block meet in one task; how many there are follows the inputs
    n_q, n_c = queries.count(), candidates.count()
    n_qb, n_cb = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n_c // CANDIDATE_BLOCK))
    # the negative of the least long is no long
    size = F.transform("vec", lambda x: F.abs(F.greatest(x, F.lit(-LONG))))
    most = lambda df: df.agg(F.max(F.array_max(size)), F.max(F.size("vec"))).first()
    (a, dims), (b, _) = most(queries), most(candidates)
    bound = max(1, int(a or 0) * int(b or 0) * int(dims or 1))
    span = min(bound, LONG)
    candidates = materialize(
        candidates.select("id", "vec", F.size("vec").alias("dim"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_cb)).alias("cb"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1)))),
        "candidates",
    )
    block = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(n_qb)).cast("int")
    # [lo, hi] holds the kth score; need: which of the scores in it, from above, that is
    state = queries.select("id", "vec", F.size("vec").alias("dim"), block.alias("qb"), F.lit(-span).cast("long").alias("lo"), F.lit(span).cast("long").alias("hi"), F.lit(k).cast("long").alias("need"))

    def met(state: DataFrame, f, schema: str) -> DataFrame:
        left = state.withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cb - 1).cast("long"))))
        return left.groupBy("qb", "cb", "dim").cogroup(candidates.groupBy("qb", "cb", "dim")).applyInPandas(f, schema)

    shift = max(0, (2 * span).bit_length() - BITS)  # each round is materialized before the next changes it
    while True:
        bins = met(state, lambda q, c: _histograms(q, c, shift, k, bound), "id long, bin long, n long")
        bins = bins.groupBy("id", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("id").orderBy(F.col("bin").desc())
        bins = bins.withColumn("upto", F.sum("n").over(above)).join(state.select("id", "need"), "id")
        # the bin that holds the kth score; where there are too few, none does and all from the lowest bin on are kept
        at = bins.groupBy("id").agg(
            F.max(F.when(F.col("upto") >= F.col("need"), F.struct("bin", (F.col("need") - F.col("upto") + F.col("n")).alias("need")))).alias("at")
        )
        width = 1 << shift
        found = at.select("id", (F.col("at.bin") * width).alias("low"), F.col("at.need").alias("left"))
        state = materialize(
            state.join(found, "id", "left").select(
                "id", "vec", "dim", "qb",
                F.greatest(F.coalesce("low", "lo"), "lo").alias("lo"),
                F.least(F.coalesce(F.col("low") + (width - 1), F.col("hi")), "hi").alias("hi"),
                F.coalesce("left", "need").alias("need"),
            ),
            "state",
        )
        if shift == 0:
            break
        shift = max(0, shift - BITS)
    found = met(state, lambda q, c: _reaching(q, c, k, bound), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantized(embeddings: DataFrame) -> DataFrame:
    """(id, vec): floor(256 * x) of each component; vectors with a null or non-finite component are left out."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad))
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vec"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where(F.col("id") % 50 == 0), rows, 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
