"""The corpus pipeline: rejected documents, near copies and benchmark leaks go, secrets are masked, and the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared folder
and reads them back as the next stage's documents. All stages but the last return the columns of docs.

Edge cases. Text null, empty or of fewer than 20 words: rejected by the quality rules, as are texts that mostly repeat themselves. Null or repeated
ids: each row is judged by itself; of rows with one text one stays. No labels: the quality rules' base limits alone. No benchmark: nothing
is a leak. Extra columns are kept up to the last stage. Empty documents: no rows. Very long texts: whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm import leaks, near_copies, packing, quality, secrets
from parley.llm.common import saved, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", good_quality),
    ("near-dedup", one_of_each),
    ("decontamination", without_leaks),
    ("secret scan", masked_secrets),
    ("packing", packed),
]

#: Near copies, learned automata and optimal buckets are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
