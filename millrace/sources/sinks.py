"""Sinks: sampled corpora with their manifest, metric logs, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources import storage


def write_sample(sample: DataFrame, path: str, manifest: str, per_file: DataFrame) -> dict:
    """JSON lines of text and source_file in order of file and place, and a manifest of counts written last.

    per_file: source_file, valid_documents, invalid_records, sample_bytes; one row a file.
    """
    sample.orderBy("source_file", "sample_ord").select("text", "source_file").write.mode("overwrite").json(path)
    files = [r.asDict() for r in per_file.orderBy("source_file").collect()]
    totals = {k: sum(f[k] or 0 for f in files) for k in ("valid_documents", "invalid_records", "sample_bytes")}
    return report(manifest, {"files": files, **totals})


def report(path: str, value: dict) -> dict:
    """A JSON report, put in place whole."""
    storage.write_text(path, json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True))
    return value


def append_metrics(rows: DataFrame, path: str, phase: str) -> None:
    """Append metric records, stamped with their phase; null fields stay out."""
    rows.withColumn("_dashboard_phase", F.lit(phase)).write.mode("append").json(path)
