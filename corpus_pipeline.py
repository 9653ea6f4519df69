"""The corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.

Cases: a null text counts as empty in every stage; it is scored like an empty text, and of all empty
texts one row stays. Rows without an id are scored and packed like others; of equal or near texts a
row with an id is preferred (in drop_copies the largest id, in drop_near_copies the smallest). Rows
that repeat an id count as rows of their own. Texts are read whole, however long. An empty table goes
through all stages and gives an empty result. Other columns are carried along and never read, but
for n_chars, which follows a redacted text, so names that operators use inside can't clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, exact_dedup, jaccard, packing, pii, quality


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity the one with the smallest id stays."""
    return jaccard.keep_one(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the names of their kinds."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", drop_poor),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", hide_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{common.scratch(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: SQL can express neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
