"""A corpus pipeline: toxicity, exact dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written and read again as the
next stage's ``docs``. All but the last give the columns of documents: toxic documents go, of
equal texts the one with the largest doc_id stays, of near-duplicates the one with the smallest,
personal data is masked, and what is left is packed into sequences.

Defined results: a null or empty text is kept by the first stage, is equal to all other empty ones
for the second (one stays, null text or not), stays null through masking, and is packed as its
closing id alone. Very long texts are read whole by every stage and cut into pieces only by packing.
Ties (equal doc_id among equal texts or near-duplicates) are settled by the row's place in its file,
so one row of a group stays; repeated rows are equal texts. An empty table passes through as an empty
one. Extra columns are carried along by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import exact_dedup, packing, pii, simhash, toxicity
from panelwright.llm.common import materialize, table


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs)


def distinct_prints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", civil), ("exact_dedup", distinct_texts), ("simhash", distinct_prints), ("pii", masked), ("packing", packed)]
#: No stage but exact dedup can be said in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
