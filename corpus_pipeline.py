"""The corpus pipeline: five stages applied to ``documents`` one after the other.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and returns the columns it was given, whatever they are; the last one returns
the packed pieces.  ``run`` writes each result to the shared checkpoint folder
and reads it back, so a lost executor costs a task, not the pipeline.

Defined cases: null and empty texts pass through every stage as empty texts;
repeated rows are copies, of which the near-duplicate stage keeps one; an empty
table stays empty; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import decontaminate, order_minhash, packing, pii, quality_rules
from runledger.llm.common import read, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    found = quality_rules.classify(docs, read(spark, sf_dir, "labels"))
    return found.where(F.col("predicted") == 1).select("rec.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return order_minhash.near_duplicates(docs).where("kept").select("rec.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = decontaminate.hits(docs, read(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select("rec.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    out = pii.redact(pii.find_spans(docs))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    import public_tokenizers  # the vocabulary files; the other stages do without

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Models, sketches and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
