"""Corpus totals."""

from pyspark.sql import functions as F

from millrace.functions.text import strip


def corpus_token_totals(spark, sf_dir):
    """Documents and byte tokens (with an end token) of each source; blank texts don't count."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", strip("text").alias("t"))
    return (
        docs.where("t <> ''")
        .groupBy("source")
        .agg(F.count("*").alias("documents"), F.sum(F.octet_length("t") + 1).cast("long").alias("tokens"))
    )


QUERIES = {"corpus_token_totals": corpus_token_totals}
ORACLES = {
    "corpus_token_totals": """
        SELECT source, count(*) AS documents, CAST(sum(strlen(t) + 1) AS BIGINT) AS tokens
        FROM (SELECT source, regexp_replace(text, '^[\\s\\x1c-\\x1f\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+|[\\s\\x1c-\\x1f\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '', 'g') AS t FROM documents)
        WHERE t <> '' GROUP BY source"""
}
