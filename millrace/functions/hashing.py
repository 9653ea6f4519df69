"""Fingerprints and identities."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ordering import running


def fingerprint(*cols: str) -> Column:
    """SHA-256 of the canonical JSON (keys sorted) of the named columns."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


#: Fingerprints that are joined to one text at most.
FOLD = 1 << 16


def combined(df: DataFrame, order: str, mark: str, by: list[str], fold: int = FOLD) -> DataFrame:
    """SHA-256 of each group's fingerprints joined by line ends, in order (ties by fingerprint).

    Of a group of over ``fold`` fingerprints, runs of so many are folded first, then the runs' digests (one alone stays itself), level by level, so that no
    task holds more than one run. The digest depends on the rows and their order, not on how they are partitioned.
    """
    rows = running(df.select(*by, F.col(order).alias("_o"), F.col(mark).alias("_m")), ["_o", "_m"], by=by, rank="_at", before="_none").select(*by, "_at", "_m", F.lit(1).cast("long").alias("_n"))
    most = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    first = True
    while first or most > 1:
        runs = F.floor(F.col("_at") / fold).cast("long").alias("_at")
        marks = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_m"))), lambda x: x["_m"])
        rows = rows.select(*by, runs.alias("_run"), "_at", "_m", "_n").groupBy(*by, "_run").agg(F.when((F.count("*") == 1) & F.lit(not first), F.first("_m")).otherwise(F.sha2(F.array_join(marks, "\n"), 256)).alias("_m"), F.sum("_n").alias("_n")).withColumnRenamed("_run", "_at")
        most, first = -(-most // fold), False
    return rows.select(*by, F.col("_m").alias("fingerprint"), F.col("_n").alias("tasks"))


def canonical_digest(value) -> str:
    """SHA-256 of a driver-side value's canonical JSON."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def stable_seed(seed: int, path: str) -> int:
    """A seed for each path: the seed, exclusive-or the first eight bytes of the path's SHA-256."""
    return seed ^ int.from_bytes(hashlib.sha256(path.encode()).digest()[:8], "little")


def same_identity(saved: dict | None, now: dict, override: bool = False) -> None:
    """Fail if a run continues under another identity."""
    if saved is not None and saved != now and not override:
        changed = sorted(k for k in {*saved, *now} if saved.get(k) != now.get(k))
        raise ValueError(f"run identity changed: {', '.join(changed)}")


def file_sha256(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, sha256 of whole files, worked out by the executors; each must fit a row."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def streamed_sha256(path: str) -> str:
    """SHA-256 of one file of any size, read in pieces on the driver."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def cache_key(tokenizer_json: str, suffix: str, files: list[tuple[str, int, int]]) -> str:
    """20 hex digits for a tokenizer, a purpose and files (path, bytes, time of change)."""
    return canonical_digest(["encoded-cache", tokenizer_json, suffix, [list(f) for f in files]])[:20]


def id_bytes(ids: Column) -> Column:
    """An array of ids as little-endian 32-bit integers, one after another."""
    swapped = lambda x: F.concat(*(F.substring(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"), i, 2) for i in (7, 5, 3, 1)))
    return F.unhex(F.array_join(F.transform(ids, swapped), ""))


def dataset_identity(examples: DataFrame, order: str, ids: list[str], by: list[str]) -> DataFrame:
    """SHA-256 of each group's examples in order: of the digests of the 32-bit bytes of their id columns."""
    mark = F.sha2(F.concat(*map(id_bytes, map(F.col, ids))), 256)
    return combined(examples.select(*by, order, mark.alias("mark")), order, "mark", by)


def run_identities(corpora: list[dict], tokenizer_sha256: str, files: dict[str, str], settings: dict) -> dict:
    """What a run must agree on to be continued: corpora and their builds, tokenizer, file digests, settings."""
    return {
        "corpora": [{k: c.get(k) for k in ("name", "path", "build_fingerprint", "documents", "tokens")} for c in sorted(corpora, key=lambda c: c["name"])],
        "tokenizer_sha256": tokenizer_sha256.lower(), "files": dict(sorted(files.items())), "settings": canonical_digest(settings),
    }
