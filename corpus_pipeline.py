"""The corpus pipeline: language, exact copies, near copies, mixing, packing.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as
the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact_dedup, language_id, mixing, packing, simhash_dedup
from quire.llm._common import documents, materialise

STAGES = [
    ("language", lambda spark, docs, sf_dir: language_id.recognised(docs)),
    ("exact_dedup", lambda spark, docs, sf_dir: exact_dedup.kept_documents(docs)),
    ("near_dedup", lambda spark, docs, sf_dir: simhash_dedup.representatives(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.mixed_documents(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.pack(docs)),
]

#: The stages' models, fingerprints and tokens have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
