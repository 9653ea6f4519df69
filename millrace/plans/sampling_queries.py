"""Samples and seeded orders; those of generators have no SQL, so they have no oracle."""

from pyspark.sql import functions as F

from millrace.operators import sampling
from millrace.operators.ordering import running


def reservoir_sample(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id")
    return sampling.reservoir(d, "source", "doc_id", 15, 20260725).select("source", "doc_id", "sample_ord")


def hash_sample(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", F.octet_length("text").alias("n_bytes"))
    return sampling.by_hash(d, "source", "doc_id", 15, 7)


def sft_epoch_order(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
    return sampling.epoch_orders(spark, n, 2, 11)


def buffer_order(spark, sf_dir):
    """When each document leaves its source's shuffle buffer of 256 rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id")
    ranked = running(docs, ["doc_id"], by=["source"], rank="position").drop("before")
    return sampling.shuffle_buffer(ranked, "position", "source", 256, 7).select("source", "doc_id", "position", "out_order")


QUERIES = {f.__name__: f for f in (reservoir_sample, hash_sample, sft_epoch_order, buffer_order)}
ORACLES = {
    "hash_sample": "SELECT source, doc_id, CAST(strlen(text) AS INTEGER) AS n_bytes, CAST(row_number() OVER (PARTITION BY source ORDER BY md5('7:' || source || ':' || doc_id), doc_id) - 1 AS INTEGER) AS sample_ord FROM documents QUALIFY sample_ord < 15",
}
