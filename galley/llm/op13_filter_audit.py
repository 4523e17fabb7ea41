"""Filter interaction audit: what five filters remove together, in every order, and each one's Shapley value.

1. A scan gives each document a mask of the filters that it fails, and a digest of its text.
2. The smallest id of every digest is found by a partial aggregation; a row is the first of its text where
   (digest, id) meets that table, so copies of one text, however many, never meet in one task.
3. Documents are counted by (part, mask): at most 32 rows a part.
4. From a part's counts its removal polynomial is formed, multilinear in the five filters: at a corner (each
   filter on or off) it is the number of documents removed by those that are on. Corners give what every order
   keeps and removes at each step. A filter's Shapley value is the integral, along the diagonal, of the
   polynomial's partial derivative; exact rationals, times 120, are the removals summed over all 120 orders.

Filters: A under 50 words; B under 65 distinct words in 100; C over 5 of ``[A-Z]`` in 100 code points; D any of
``[#$%&*|]``; E identical to the text of a smaller doc_id of the table.

Defined results: a null text is empty (so null and empty texts are copies of each other); a null source is the
part of the empty string; rows with a null doc_id are never copies nor the first of a text, and have no label;
rows that repeat an id and text are each the first where the id is the smallest; where labels repeat an id, one
row that says 1 is enough. Other columns are not read. An empty table has no parts and so no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import materialize
from galley.tables import table

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
AUDITED = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask of A to D, digest) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    upper = F.length("text") - F.length(F.translate("text", LETTERS, ""))
    fails = [n < 50, distinct.cast("long") * 100 < n.cast("long") * 65, upper.cast("long") * 100 > F.length("text").cast("long") * 5, F.col("text").rlike("[#$%&*|]")]
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail."""
    rows = materialize(masked(docs), "masked")
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    told = rows.join(firsts, ["digest", "doc_id"], "left").join(said, "doc_id", "left")
    told = told.select("part", (F.col("mask") + F.when(copy, F.lit(1 << 4)).otherwise(F.lit(0))).alias("mask"), "good", "toxic")
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c)
    return told.groupBy("part", "mask").agg(F.count("*").alias("n"), one("good"), one("toxic"))


def removal_polynomial(counts: dict[int, int]) -> list[int]:
    """Coefficients, by the set of filters in a monomial, of the number of documents removed.

    A document that fails the filters of a mask is removed unless all of these are off: 1 - prod(1 - x_i). So
    the monomial of a set counts the documents that fail all of it, with the sign of its size.
    """
    failing = [sum(n for mask, n in counts.items() if mask & s == s) for s in range(ALL + 1)]
    return [0] + [(-1) ** (s.bit_count() + 1) * failing[s] for s in range(1, ALL + 1)]


def corner(poly: list[int], on: int) -> int:
    """Documents removed where exactly the filters of ``on`` are applied."""
    return sum(c for s, c in enumerate(poly) if s & on == s)


def shapley(poly: list[int], i: int) -> Fraction:
    """The integral over 0..1 of the partial derivative by filter ``i``, all variables alike."""
    along = [Fraction(0)] * len(FILTERS)  # the derivative's coefficients on the diagonal, by power
    for s, c in enumerate(poly):
        if s >> i & 1:
            along[s.bit_count() - 1] += c
    return sum((c / (power + 1) for power, c in enumerate(along)), Fraction(0))


def audit_rows(part: str, counts: list[dict]) -> Iterator[tuple]:
    """The 600 rows of a part; counts: mask, n, good, toxic."""
    polys = {c: removal_polynomial({r["mask"]: r[c] for r in counts}) for c in ("n", "good", "toxic")}
    removed = {c: [corner(p, on) for on in range(ALL + 1)] for c, p in polys.items()}
    values = [shapley(polys["n"], i) * 120 for i in range(len(FILTERS))]
    total, by = sum(r["n"] for r in counts), removed["n"]
    for order in permutations(range(len(FILTERS))):
        on = 0
        for step, i in enumerate(order, 1):
            before, on = on, on | 1 << i
            here = {c: removed[c][on] - removed[c][before] for c in removed}
            yield (
                part, "".join(FILTERS[j] for j in order), step, total - by[on], here["n"], by[1 << i] - here["n"],
                by[ALL] - by[ALL ^ 1 << i], here["good"], here["toxic"], int(values[i]),
            )


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in AUDITED.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    for batch in batches:
        for r in batch.to_pylist():
            rows = list(audit_rows(r["part"], r["counts"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step; ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic."""
    parts = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    return parts.mapInArrow(_audited, AUDITED)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
      len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
      regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)
    ] AS fails
  FROM d LEFT JOIN l USING (doc_id)
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, unnest([1, 2, 3, 4, 5]) AS step
  FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5
), e AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, n, good, toxic, fails[ascii(substr(filter_order, step, 1)) - 64] AS own,
    len(list_filter(range(1, step), lambda j: fails[ascii(substr(filter_order, CAST(j AS BIGINT), 1)) - 64])) > 0 AS before, len(list_filter(fails, lambda b: b)) AS failed
  FROM g, o
), a AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN NOT own AND NOT before THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT before THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN own AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN own AND NOT before THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT before THEN toxic ELSE 0 END) AS toxic_lost
  FROM e GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM a
"""
