"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, pii, simhash, toxicity
from tidemark.llm.common import table
from tidemark.session import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents judged toxic go. The chain is fitted on the labelled documents among its input."""
    model = toxicity.train(docs, toxicity.labels_of(spark, sf_dir))
    return toxicity.drop_toxic(docs, model).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of every component the document with the smallest id stays."""
    return simhash.keep_one(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: every span is replaced by its kind; n_chars is counted again where the text changed."""
    new = docs.withColumn("__new", pii.redacted_column("text"))
    n_chars = F.when(F.col("__new").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("__new").cast("long"))
    return new.withColumn("n_chars", n_chars).withColumn("text", F.col("__new")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token ids of every text, with digests of ids and decoded bytes."""
    return bpe.digests(bpe.encode_decode(docs, keep=("doc_id", "lang", "source", "n_chars")))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("byte_bpe", encode),
]

#: Classifier, fingerprints and BPE are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage but the last is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
