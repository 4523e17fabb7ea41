"""MinHash near-dedup by HyperMinHash.

1. Each document's distinct word shingles are hashed once; exact copies (equal sets) fold into one class.
2. Each class gets a HyperMinHash sketch: per bucket of the hash space the smallest hash, kept as its count
   of leading zeros and ten bits of mantissa (16 bits together).
3. Bands of compressed registers are the join keys. A bucket of a band links its members to one of them
   only, never all pairs; what the collision-corrected Jaccard estimate finds far from alike is unlinked.
   Connected components of these links are clusters of candidates.
4. Within a cluster full shingle sets are compared exactly, a class at a time against all others that
   are not yet in its component, until one component is left or every class was compared. Clusters too
   large for a task are cut into blocks, and each pair of blocks is one task; a last round of connected
   components joins their findings. Every confirmed link is by full sets.

At the production parameters (25 bands of 5 registers) a pair at the threshold 0.85 shares no band with a
chance of 4e-7. The 3-word shingles and 0.85 are the query's contract; the pipeline uses five words, 0.8.

Defined results: null or empty texts, and those of white space, have no shingles and are linked with nothing;
equal rows are copies; among copies and groups the smallest doc_id stands for the component. Rows with a
null doc_id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import connected_components, discard, materialize
from galley.llm.words import groups, lean, mix, words
from galley.tables import table

BUCKETS = 128
BANDS, ROWS = 25, 5
MANTISSA = 10
#: Links within a band's bucket that are estimated less alike than this are dropped; far below any threshold.
LEAST_ESTIMATE = 0.35
#: Classes and bytes of text that one task compares.
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20


def sketch(distinct: np.ndarray) -> np.ndarray:
    """uint16 registers of sorted distinct hashes; 0 where a bucket has none."""
    p = BUCKETS.bit_length() - 1
    bounds = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - p)
    first = np.searchsorted(distinct, bounds)
    there = np.concatenate([first[1:], [len(distinct)]]) > first
    out = np.zeros(BUCKETS, np.uint16)
    if there.any():
        low = distinct[first[there]] << np.uint64(p)
        # leading zeros from the float exponent; a float rounds up at most to the next power, which stays consistent
        zeros = np.minimum(63 - np.frexp(low.astype(np.float64))[1] + 1, 62 - MANTISSA)
        after = (low << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
        out[there] = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA) | after).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers.

    Registers of different sets agree by chance with about 2^-(mantissa + 1.6) (two equal counts of leading
    zeros: 1/3), which is taken off; buckets empty on both sides say nothing.
    """
    filled = (a > 0) | (b > 0)
    n = np.maximum(filled.sum(axis=1), 1)
    same = ((a == b) & filled).sum(axis=1) / n
    chance = 2.0**-MANTISSA / 3
    return np.clip((same - chance) / (1 - chance), 0, 1)


def _bands(registers: np.ndarray) -> np.ndarray:
    """BANDS keys, 0 where all of a band's registers are empty."""
    r = registers[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.zeros(BANDS, np.uint64)
    for j in range(ROWS):
        key = key * np.uint64(0x100000001B3) + r[:, j]
    key = mix(key * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64))
    return np.where((r > 0).any(axis=1), key, np.uint64(0))


SHINGLED = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, sketch binary, bands array<bigint>, bytes bigint"


def shingled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"]
            for w in words(batch["text"]):
                n, f1, f2, sketches, bands = [], [], [], [], []
                with np.errstate(over="ignore"):
                    for s in w.sets(k):
                        n.append(len(s))
                        f1.append(np.add.reduce(mix(s)) if len(s) else np.uint64(0))
                        f2.append(np.bitwise_xor.reduce(mix(s + np.uint64(77))) if len(s) else np.uint64(0))
                        r = sketch(s)
                        sketches.append(r.tobytes())
                        bands.append(_bands(r).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(w.row, len(w)),
                        pa.array(n, pa.int64()),
                        pa.array(np.array(f1, np.uint64).view(np.int64)),
                        pa.array(np.array(f2, np.uint64).view(np.int64)),
                        pa.array(sketches, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(bands))),
                        pa.array(np.diff(w.offsets)),
                    ],
                    names=["doc_id", "n_shingles", "f1", "f2", "sketch", "bands", "bytes"],
                )

    return run


def _alike(least: float):
    """Keeps (a, b) whose sketches are estimated at ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("sketch_a", "sketch_b"))
            keep = pa.array(estimate(x, y) >= least)
            yield batch.select(["a", "b"]).filter(keep)

    return run


def links_within(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with den * intersection >= num * union, all pairs considered.

    A leader at a time is compared with every set outside its component; pairs within a component are
    connected already. Positions of the sets.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel() if size.sum() else np.zeros(0, np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    flag = np.zeros(ids.max(initial=-1) + 1, bool)
    label, found, parts = np.arange(m), [], m
    for i in range(m):
        if parts == 1:
            break
        if not size[i]:
            continue
        own = ids[start[i] : start[i + 1]]
        flag[own] = True
        # sets of a size that can reach the threshold, outside this component
        others = np.flatnonzero((label != label[i]) & (size * den >= num * size[i]) & (size * num <= den * size[i]))
        if len(others):
            if len(others) * 4 > m:
                both = np.add.reduceat(np.append(flag[ids], False), start[:-1], dtype=np.int64)[others]
            else:
                both = np.array([np.count_nonzero(flag[ids[start[j] : start[j + 1]]]) for j in others])
            for j in others[den * both >= num * (size[i] + size[others] - both)].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    found.append((i, j))
                    parts -= 1
        flag[own] = False
    return found


def _linked(k: int, num: int, den: int):
    """Spanning links (a, b) of each (cluster, part)'s classes, by their full texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["cluster", "part"]):
            ids, sets = group["doc_id"].to_numpy(), []
            with np.errstate(over="ignore"):
                for w in words(group["text"]):
                    sets += list(w.sets(k))
            order = sorted(range(len(sets)), key=lambda i: ids[i])
            pairs = links_within([sets[i] for i in order], num, den)
            a, b = (np.array([ids[order[p[x]]] for p in pairs], np.int64) for x in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; ``docs`` has doc_id and text.

    Documents are linked where den * |intersection| >= num * |union| of their k-word shingle sets.
    """
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialize(texts.mapInArrow(lean(shingled(k)), SHINGLED), "sets")
    # exact copies: one class for each set, named by its smallest document; without shingles each alone
    some = sets.where("n_shingles > 0")
    classes = materialize(some.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("class")), "classes")
    first = classes.select(F.col("class").alias("doc_id"))
    # sets that differ reach the threshold only with enough shingles: u - 1 of u in common
    least = next(u for u in range(1, 10**6) if den * (u - 1) >= num * u) - 1
    reps = sets.where(F.col("n_shingles") >= least).join(first, "doc_id", "left_semi").select("doc_id", "sketch", "bands", "bytes").dropDuplicates(["doc_id"])
    reps = materialize(reps, "reps")
    whole, sets = sets, materialize(sets.select("doc_id", "n_shingles", "f1", "f2"), "sizes")
    discard(whole)  # sketches and bands are with the classes now
    keys = reps.select("doc_id", F.explode("bands").alias("key")).where("key <> 0")
    # the leader of a bucket: not always the smallest, so that different bands have different leaders
    lead = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("doc_id", "key").alias("h"), "doc_id")).alias("lead"))
    lead = lead.where("n > 1").select("key", F.col("lead.doc_id").alias("a"))
    star = keys.join(lead, "key").where(F.col("a") != F.col("doc_id")).select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct()
    of = lambda c: reps.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    near = star.join(of("a"), "a").join(of("b"), "b").mapInArrow(lean(_alike(LEAST_ESTIMATE)), "a bigint, b bigint")
    found = materialize(connected_components(near), "clusters")
    clusters = found.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    sized = clusters.join(reps.select("doc_id", "bytes"), "doc_id")
    blocks = sized.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    with_block = clusters.join(blocks, "cluster").withColumn("block", mine)
    # one part for each pair of blocks: numbered low * blocks + high
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    parts = with_block.withColumn("other", other).where((F.col("blocks") == 1) | (F.col("other") != F.col("block")))
    parts = parts.select("doc_id", "cluster", "blocks", (F.least("block", "other").cast("long") * F.col("blocks") + F.greatest("block", "other")).alias("part"))
    bodies = texts.join(clusters.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).join(parts, "doc_id")
    grouped = bodies.select("cluster", "part", "doc_id", "text").repartition("cluster", "part").sortWithinPartitions("cluster", "part")
    links = materialize(grouped.mapInArrow(lean(_linked(k, num, den)), "a bigint, b bigint"), "links")
    discard(reps, found)
    near = connected_components(links).select(F.col("node").alias("class"), "component")
    classes = classes.join(near, "class", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "class").alias("component"))
    return sets.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2", "n_shingles"], "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        (F.coalesce("component", "doc_id") == F.col("doc_id")).alias("kept"),
    )


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)
