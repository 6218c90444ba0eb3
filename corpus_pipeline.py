"""The corpus pipeline: documents in, packed sequences out. Each stage works on all that the one before kept.

1. quality classifier: documents with a score below 0.7 go.
2. quality rules: documents that fail the base rules or a certified cutoff of their language go.
3. near-duplicates: of each group linked at a similarity of 0.8 over five-word shingles the smallest id stays.
4. secret scan: secrets in texts are replaced by a mark, ``n_chars`` becomes the new length; no document goes.
5. packing: the texts' tokens are laid into sequences of 4096.

A stage takes (spark, docs, sf_dir), with ``docs`` in the columns of ``documents``, and returns those columns, the last one a row for each piece. Labels are read
from ``sf_dir``. Null texts are empty, and so are rejected early; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pactframe.llm import mil, minhash, packing, quality_rules, secrets
from pactframe.llm.common import saved, table
from pactframe.llm.queries import vocabulary


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mil.keep(docs, table(spark, sf_dir, "labels"), cutoff=0.7)


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep(docs, percent=80, size=5)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, path_col="source", length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), length=4096, end_id=2)


STAGES = [("quality classifier", classified), ("quality rules", ruled), ("near-duplicates", deduplicated), ("secret scan", redacted), ("packing", packed)]

#: Trained models and tokenizers can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
