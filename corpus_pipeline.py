"""Documents to training sequences in five stages.

Each stage reads the table the one before wrote, works on all of it and keeps
the columns of documents; the last returns packed pieces. Stage tables lie under
the folder of spark.checkpoint.dir, so a lost executor costs tasks, not stages.

Defined results of the stages: null and empty texts have too few words for the
quality rules and go there; a stage that meets one all the same keeps it, and
packing makes a piece of its end mark alone. Texts are read whole, however long.
Null ids are rows like others: of equal texts the smallest id stays and nulls come
last; if a row with a null id holds a test item, all rows with a null id go. Rows
that repeat in every column count as copies, one of them stays. Of equal secrets
or seeds all count. Empty tables give empty tables, and columns beside those of
documents pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from playframe.llm import contamination, minhash, packing, quality, secrets
from playframe.llm.common import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the smallest id."""
    return minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return contamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become a mark; the documents stay. Texts are scanned
    into the ledger, a new one or that which the session names."""
    return secrets.redact(docs, secrets.Ledger(spark).update(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: packing follows no SQL form; tests/llm/test_pipeline.py holds it against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    last = None
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(last)
        last = docs
    return docs
