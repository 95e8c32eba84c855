"""A corpus pipeline of five of the operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All stages but the last return the columns of ``documents``; mixing
adds ``mix_order`` and ``mix_phase``, which the last stage puts out with the source:
a reader that takes the rows by ``mix_order`` has the mixture, and phase 0 is the
part in which the target weights hold.  No document is dropped for the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recallgrid.llm import bpe, jaccard, mixing, secrets, toxicity
from recallgrid.llm._common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.filter_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return secrets.redact_secrets(docs, secrets.train(secrets.labelled_findings()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are put in the order of the mixture and carry it; every document stays."""
    return mixing.mix_documents(docs, order_col="mix_order", phase_col="mix_phase")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with its source and place in the mixture."""
    return bpe.encode_documents(docs, keep=tuple(c for c in ("source", "mix_order", "mix_phase") if c in docs.columns))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("bpe", encode)]
#: The first stage fits a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
