"""The corpus pipeline: quality rules, near duplicates, decontamination, PII, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and reads it again as the next stage's docs. All stages but the last return the columns they got.

Documents are named by doc_id: a decision on it holds for all rows that repeat it, also if their texts differ, and of those that
stay the near-duplicate stage keeps one. Rows with a null doc_id
can't be named, so no filter removes them; their text is pseudonymised and encoded like any other. Null and empty texts fail the base
rules of the first stage. No documents give no rows, no labels or no benchmark items leave their stages without effect beyond the
base rules. Further columns are kept, whatever their names; where they have the names of the last stage's own, these get underscores.

Pseudonyms depend on the session's key (pii.session_key): set spark.stakeweave.pseudonyms.key to link them between runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakeweave.llm import decontaminate, jaccard, pieces, pii, quality
from stakeweave.llm.common import stored, table


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the documents in gone(doc_id)."""
    return docs.join(stored(gone.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct(), "gone"), "doc_id", "left_anti").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    return without(docs, quality.judged(docs, table(spark, sf_dir, "labels")).filter("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component (shingles of five words, Jaccard 0.8 or more) stays, once."""
    kept = without(docs, jaccard.jaccard_components(docs, k=5, percent=80).filter("component_id != doc_id"))
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        kept = stored(kept, "kept")
        first = kept.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in kept.columns if c not in ("doc_id", "text")])).alias("row"))
        kept = kept.filter("doc_id is null").unionByName(first.select("doc_id", "row.*").select(kept.columns))
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or paraphrased, go."""
    return without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same format; n_chars follows the text."""
    return pii.pseudonymised(docs, pii.session_key(spark)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """input_ids and n_tokens in place of the text."""
    return pieces.encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
