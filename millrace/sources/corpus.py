"""Encoded corpora: Parquet shards with a metadata file that is written last and marks completion."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import shards, storage
from millrace.sources.files import pretrain_records

VERSION = 2


def _metadata(name: str, vocab_size: int, tokenizer_sha256: str, eos_id: int, build: str, documents: int, tokens: int, files: list[str]) -> dict:
    return {
        "format_version": VERSION, "name": name, "dtype": "uint16" if vocab_size <= 65535 else "uint32", "vocab_size": vocab_size, "tokenizer_sha256": tokenizer_sha256, "eos_id": eos_id,
        "documents": documents, "tokens": tokens, "shards": len(files), "shard_files": files, "build_fingerprint": build, "complete": True,
    }


def _shards(path: str, ending: str = "") -> list[str]:
    return [n for n in storage.names_in(f"{path}/shards") if not n.startswith(("_", ".")) and n.endswith(ending)]


def write_corpus(encoded: DataFrame, path: str, name: str, vocab_size: int, tokenizer_sha256: str, eos_id: int, fresh: bool = False) -> dict:
    """Write ids and lengths as shards, then corpus.json. encoded: ids, n_tokens and an order column doc_ord.

    A folder that holds a finished corpus of other inputs is refused unless fresh; stale shards go with the overwrite.
    """
    marker = f"{path}/corpus.json"
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    mark = encoded.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")).alias("s")).first()
    build = hashlib.sha256(json.dumps([name, vocab_size, tokenizer_sha256, eos_id, mark.n, str(mark.s)]).encode()).hexdigest()
    saved = storage.read_text(marker)
    if saved is not None and not fresh:
        old = json.loads(saved)
        if old.get("build_fingerprint") != build:
            raise ValueError(f"{path} holds a corpus of other inputs; rerun with fresh=True")
        return old
    storage.remove(marker)
    encoded.write.mode("overwrite").parquet(f"{path}/shards")
    spark = encoded.sparkSession
    total = spark.read.parquet(f"{path}/shards").agg(F.count("*").alias("d"), F.sum("n_tokens").alias("t")).first()
    meta = _metadata(name, vocab_size, tokenizer_sha256, eos_id, build, total.d, total.t or 0, _shards(path, ".parquet"))
    storage.write_text(marker, json.dumps(meta, ensure_ascii=False, indent=1))
    return meta


def build_corpus(spark: SparkSession, files: list[storage.File], path: str, encode: Callable[[DataFrame], DataFrame], name: str, vocab_size: int, tokenizer_sha256: str, eos_id: int, fresh: bool = False) -> dict:
    """Encode files of JSON lines and Parquet as a corpus, a task a file, going on from what an earlier run has finished.

    encode: ids and n_tokens of rows (task, text). Only files without a shard are read, and an unchanged rerun reads none. A file that differs from
    the one that its shard was made of is an error unless fresh; shards of files that are gone are deleted; corpus.json is written last.
    """
    if not files:
        raise ValueError("no input files")
    identity = {"tokenizer_sha256": tokenizer_sha256, "eos_id": eos_id, "vocab_size": vocab_size, "format_version": VERSION}
    tasks = shards.file_tasks(files, identity)
    names = spark.createDataFrame(list(storage.uris([f.path for f in files]).items()), "file string, task string")  # a row a file

    def encoded(own: list[str]) -> DataFrame:
        return encode(pretrain_records(spark, own).withColumn("file", storage.plain(F.col("file"))).join(F.broadcast(names), "file").select("task", "text")).select("task", "ids", "n_tokens")

    shards.write_tasks(spark, tasks, path, encoded, in_place=True, fresh=fresh, totals=("n_tokens",), first=lambda: storage.remove(f"{path}/corpus.json"))
    done = shards.task_rows(path)
    full = [f"part={e['part']}" for e in done if e["rows"]]
    meta = _metadata(name, vocab_size, tokenizer_sha256, eos_id, shards.combined_fingerprint(tasks), sum(e["rows"] for e in done), sum(e["totals"]["n_tokens"] for e in done), full)
    storage.write_text(f"{path}/corpus.json", json.dumps(meta, ensure_ascii=False, indent=1))
    return meta


def check_metadata(meta: dict | None, vocab_size: int | None = None, tokenizer_sha256: str | None = None) -> None:
    """Fail on metadata that a loader must not trust."""
    if meta is None:
        raise ValueError("no corpus.json")
    if meta.get("complete") is not True:
        raise ValueError("the corpus is not marked complete")
    if vocab_size is not None and meta.get("vocab_size") != vocab_size:
        raise ValueError("vocabulary size mismatch")
    if meta.get("format_version", 1) >= 2 and not meta.get("build_fingerprint"):
        raise ValueError("no build fingerprint")
    if tokenizer_sha256 and meta.get("tokenizer_sha256", "").lower() != tokenizer_sha256.lower():
        raise ValueError("tokenizer fingerprint mismatch")
    if meta.get("dtype") not in ("uint16", "uint32"):
        raise ValueError("missing or bad dtype")
    files = meta.get("shard_files")
    if not isinstance(files, list) or len(set(files)) != len(files) or any("/" in f or f in ("", ".", "..") for f in files):
        raise ValueError("invalid shard files")
    if meta.get("shards") != len(files):
        raise ValueError("bad shard count")


def read_corpus(spark: SparkSession, path: str, vocab_size: int | None = None, tokenizer_sha256: str | None = None) -> DataFrame:
    """A complete corpus: metadata, shard set, totals, lengths and ids are checked first."""
    saved = storage.read_text(f"{path}/corpus.json")
    if saved is None:
        raise ValueError("no corpus.json")
    try:
        meta = json.loads(saved)
    except json.JSONDecodeError:
        raise ValueError("corpus.json is not valid JSON") from None
    check_metadata(meta, vocab_size, tokenizer_sha256)
    there = set(_shards(path))
    if there != set(meta["shard_files"]):
        missing, extra = sorted(set(meta["shard_files"]) - there), sorted(there - set(meta["shard_files"]))
        raise ValueError(f"shard set does not match: missing {missing}, extra {extra}")
    df = spark.read.parquet(f"{path}/shards").drop("part") if there else spark.createDataFrame([], "ids array<int>, n_tokens int")
    t = df.agg(
        F.count("*").alias("d"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t"), F.sum((F.size("ids") != F.col("n_tokens")).cast("int")).alias("bad"),
        F.max(F.array_max("ids")).alias("top"), F.min(F.array_min("ids")).alias("low"),
    ).first()
    if (t.d, t.t) != (meta["documents"], meta["tokens"]):
        raise ValueError("declared totals differ from the shards")
    if t.bad:
        raise ValueError("lengths differ from the ids")
    if t.d and (t.low < 0 or t.top >= meta["vocab_size"]):
        raise ValueError("ids outside the vocabulary")
    return df


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys of only one side: missing or extra."""
    a, b = expected.select(key).distinct().withColumn("_a", F.lit(1)), actual.select(key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full_outer").where("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_b").isNull(), "missing").otherwise("extra").alias("status"))


def resume_plan(tasks: DataFrame, saved: DataFrame) -> DataFrame:
    """For each task whether its saved output can be used: reuse, mismatch or absent."""
    old = saved.select("task", F.col("fingerprint").alias("_old"))
    return tasks.join(old, "task", "left").select("task", F.when(F.col("_old").isNull(), "absent").when(F.col("_old") == F.col("fingerprint"), "reuse").otherwise("mismatch").alias("action"))
