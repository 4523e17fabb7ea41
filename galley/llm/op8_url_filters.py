"""URL filters: a trie over reversed host labels and path segments, broadcast, longest match first.

The trie's first levels are the host's labels from the right (``com``, ``example``), so a rule on a host
also stands on the way to all of its subdomains; below a host's node hang the rules' paths, cut after
each ``/``. A lookup walks the labels, then the path, and keeps the longest rule seen.

Defined results: a null url, or one without ``://``, has an empty host and path; no rule fits it and it
gets the default verdict. Of two rules with the same host and path the blocking one stands. Longest is:
most host labels, then the longest path. Rows repeat as they do in the input.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.tables import table

#: As the contract of the query states them: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A list of more rules than this is not broadcast but joined.
MAX_BROADCAST_RULES = 1_000_000


class Trie:
    """Rules by reversed host labels, then by path segments; a segment keeps its closing slash."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(("h", label), {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            ends = node.setdefault("ends", {})  # rule ends within a segment: its beginning, "" for a closing slash
            if ends.get(rest, ("allow",))[0] != "block":
                ends[rest] = (verdict, host + path)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule: (verdict, rule)."""
        node, found, segments = self.root, None, path.split("/")
        nodes = [node]
        for label in reversed(host.split(".")) if host else ():
            node = node.get(("h", label))
            if node is None:
                break
            nodes.append(node)
        for node in reversed(nodes):  # the longest host first
            at, n = node, 0
            while True:
                for rest, rule in sorted(at.get("ends", {}).items(), key=lambda x: len(x[0])):
                    if segments[n].startswith(rest):
                        found = rule
                at = at.get(("p", segments[n])) if n + 1 < len(segments) else None
                if at is None:
                    break
                n += 1
            if found:
                return found
        return None


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Columns host and path of a url column, both empty without ``://``."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def _judged(batches: Iterator[pa.RecordBatch], rules, default: str) -> Iterator[pa.RecordBatch]:
    trie = Trie(rules.value)
    for batch in batches:
        found = [trie.match(h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
        rule = pa.array([f and f[1] for f in found], pa.string())
        verdict = pa.array([f[0] if f else default for f in found], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])


def filter_urls(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", max_broadcast: int = MAX_BROADCAST_RULES
) -> DataFrame:
    """(key, host, path, rule, verdict) of every row of ``pages``.

    ``rules`` has the string columns verdict, host and path. Its rows are counted: up to ``max_broadcast``
    they go to the executors as one trie, beyond it each url is joined by its host's suffixes.
    """
    spark = pages.sparkSession
    host, path = split_url(F.coalesce(F.col(url), F.lit("")))
    urls = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    listed = rules.select("verdict", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    few = [tuple(r) for r in listed.limit(max_broadcast + 1).collect()]  # bounded: one row over the limit at most
    if len(few) <= max_broadcast:
        trie = spark.sparkContext.broadcast(few)
        schema = f"{key} {dict(urls.dtypes)[key]}, host string, path string, rule string, verdict string"
        return urls.mapInArrow(lambda batches: _judged(batches, trie, default), schema)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    distinct = urls.select("host", "path").distinct()
    fits = (
        distinct.withColumn("suffix", F.explode(F.array_distinct(F.concat(suffixes, F.array(F.lit(""))))))
        .join(listed.select("verdict", F.col("host").alias("suffix"), F.col("path").alias("start")), "suffix")
        .where(F.col("path").startswith(F.col("start")))
    )
    order = F.struct(F.when(F.col("suffix") == "", 0).otherwise(F.size(F.split("suffix", r"\."))), F.length("start"), F.col("verdict") == "block")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("verdict", F.concat("suffix", "start").alias("rule")), order).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(after, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, host, path) AS (VALUES {", ".join(map(str, RULES))}
), f AS (
  SELECT p.page_id, p.host, p.path, r.verdict, r.host || r.path AS rule,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""
