"""Raw documents to token ids: language ID, near-dedup, substring dedup, decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of ``documents``. Each works on all that its
predecessor kept, and what it decides takes effect:

1. language ID drops documents without a language: no letter, or no language with LEAST_SHARE of the words;
2. near-dedup (5-word shingles, Jaccard 0.8 or more) keeps one document of each group, that of the smallest id;
3. substring dedup cuts repeated passages from all documents but the first, and drops what has no word left;
4. decontamination drops documents that hold half of a benchmark item or more;
5. encoding adds the token ids, and the text as it is decoded from them.

Rows without a doc_id can't be followed and go with the first stage. Rows that repeat an id are copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import materialize
from galley.llm.op1_substring_dedup import remove_passages, repeated_passages
from galley.llm.op5_hyperminhash import near_duplicates
from galley.llm.op6_crf_language_id import fit, predict, training_rows
from galley.llm.op9_string_tiling import contaminated
from galley.llm.op10_byte_bpe import encode
from galley.tables import table

LEAST_SHARE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(training_rows(docs))
    # what predict() adds must not replace columns of these names
    own = {c: f"__own_{c}" for c in docs.columns if c in ("lang_pred", "score")}
    found = predict(docs.where("doc_id is not null").withColumnsRenamed(own), model, keep_text=True)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_duplicates(docs, k=5, num=80, den=100).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    runs = materialize(repeated_passages(docs), "runs")
    cut = remove_passages(docs.withColumn("__before", F.col("text")), runs)
    changed = cut.withColumn("n_chars", F.when(F.col("text") != F.col("__before"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.where(r"text rlike '[^\\x20\\x09-\\x0D]'").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = encode(docs)
    return coded.select("doc_id", F.col("decoded").cast("string").alias("text"), "lang", "source", "n_chars", "n_tokens", "token_ids")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]
#: SQL can't express the learned and hashed stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
