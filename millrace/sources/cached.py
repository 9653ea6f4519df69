"""Derived tables that are kept under the identity of what they were made from."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.hashing import canonical_digest
from millrace.sources import storage


def keyed_table(spark: SparkSession, path: str, key: dict, build, rows: int | None = None, rebuild: bool = False) -> tuple[DataFrame, bool]:
    """The table under path if it was made under the same key (and has so many rows); else what build() gives, written there. Whether it was reused."""
    mark, digest = f"{path}/key.json", canonical_digest(key)
    saved = None if rebuild else storage.read_text(mark)
    if saved is not None and json.loads(saved).get("key") == digest:
        df = spark.read.parquet(f"{path}/table")
        if rows is None or df.count() == rows:
            return df, True
    storage.remove(mark)
    build().write.mode("overwrite").parquet(f"{path}/table")
    storage.write_text(mark, json.dumps({"key": digest}))
    return spark.read.parquet(f"{path}/table"), False
