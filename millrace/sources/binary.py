"""Corpora of flat binary shards: ids one after another in ``part-*.bin``, document lengths in ``part-*.bin.lengths.npy`` beside it.

A shard is read by ranges of bytes, each a task of its own: a task takes the documents that begin in its range. The files must lie
on a file system that all executors see under the same path (they are mapped, not streamed).
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.sources import storage

RANGE_BYTES = 64 << 20
#: Ids of one batch that goes to Spark.
BATCH_IDS = 1 << 20
_SCHEMA = "shard int, doc long, ids array<long>, n_tokens long"


def _lengths(path: str) -> np.ndarray:
    """Lengths of a shard's documents, mapped; checked against the shard's size by ``totals``."""
    own = f"{path}.lengths.npy"
    if not os.path.exists(own):
        raise FileNotFoundError(f"missing document lengths: {own}")
    out = np.load(own, mmap_mode="r")
    if out.ndim != 1:
        raise ValueError(f"{own} must have one dimension")
    return out


class Range(InputPartition):
    def __init__(self, shard: int, path: str, begin: int, end: int):
        self.shard, self.path, self.begin, self.end = shard, path, begin, end


class ShardReader(DataSourceReader):
    """shard, doc (place in the shard), ids, n_tokens. begin and end of a range count ids."""

    def __init__(self, options: dict):
        self.paths, self.dtype, self.step = json.loads(options["paths"]), np.dtype(options["dtype"]), int(options["step"])

    def partitions(self) -> list[Range]:
        out = []
        for i, p in enumerate(self.paths):
            n = os.path.getsize(p) // self.dtype.itemsize
            out += [Range(i, p, a, min(a + self.step, n) if a + self.step < n else n + 1) for a in range(0, max(n, 1), self.step)]
        return out

    def read(self, part: Range):
        ends = np.cumsum(_lengths(part.path), dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
        lo, hi = np.searchsorted(begins, [part.begin, part.end])  # documents without ids begin where the next one does
        ids = np.memmap(part.path, self.dtype, "r") if os.path.getsize(part.path) else np.zeros(0, self.dtype)
        while lo < hi:
            z = min(hi, max(lo + 1, int(np.searchsorted(ends, begins[lo] + BATCH_IDS, side="right"))))
            values = pa.array(np.asarray(ids[begins[lo] : ends[z - 1]], np.int64))
            offsets = pa.array(np.append(begins[lo:z], ends[z - 1]) - begins[lo], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(z - lo, part.shard, np.int32)), pa.array(np.arange(lo, z)), pa.ListArray.from_arrays(offsets, values), pa.array(ends[lo:z] - begins[lo:z])], names=["shard", "doc", "ids", "n_tokens"])
            lo = z


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binary_shards"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options)


def totals(spark: SparkSession, paths: list[str], dtype: str) -> list[tuple[int, int]]:
    """Documents and ids of each shard; a shard whose lengths don't add up to its ids is an error. A row a shard."""

    def run(batches):
        for b in batches:
            rows = []
            for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lengths, size = _lengths(p), os.path.getsize(p)
                tokens = int(lengths.sum(dtype=np.uint64))
                if tokens * np.dtype(dtype).itemsize != size:
                    raise ValueError(f"corrupt shard {p}: lengths add up to {tokens} ids, the file has {size / np.dtype(dtype).itemsize:g}")
                rows.append((i, len(lengths), tokens))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3, names=["shard", "documents", "tokens"])

    listed = spark.createDataFrame(list(enumerate(paths)), "shard long, path string").repartition(min(len(paths), 1024))
    return [(r.documents, r.tokens) for r in sorted(listed.mapInArrow(run, "shard long, documents long, tokens long").collect())]


def _declared(path: str, vocab_size: int, tokenizer_sha256: str | None) -> tuple[dict, list[str]]:
    """Metadata of a folder and its shards, after all checks that need no shard."""
    saved = storage.read_text(f"{path}/corpus.json")
    if saved is None:
        raise ValueError(f"{path} has no corpus.json; its build may be incomplete")
    try:
        meta = json.loads(saved)
        assert isinstance(meta, dict)
    except (ValueError, AssertionError):
        raise ValueError(f"invalid corpus metadata under {path}") from None
    whole = lambda k: isinstance(meta.get(k), int) and not isinstance(meta[k], bool)
    if meta.get("complete") is not True:
        raise ValueError(f"{path} is not marked complete")
    if not whole("vocab_size") or meta["vocab_size"] != vocab_size:
        raise ValueError(f"vocabulary mismatch: {meta.get('vocab_size')} and {vocab_size}")
    mark = meta.get("tokenizer_sha256")
    if meta.get("format_version", 1) >= 2 and not isinstance(mark, str):
        raise ValueError("no tokenizer_sha256 in the metadata")
    if tokenizer_sha256 is not None and isinstance(mark, str) and mark.lower() != tokenizer_sha256.lower():
        raise ValueError("tokenizer fingerprint mismatch")
    if "dtype" not in meta:
        raise ValueError("no dtype in the metadata")
    files = meta.get("shard_files")
    if files is None:
        if not whole("shards") or meta["shards"] <= 0:
            raise ValueError("no valid shard count in the metadata")
        files = [f"part-{i:06d}.bin" for i in range(meta["shards"])]
    if not isinstance(files, list) or not files or not all(isinstance(f, str) and "/" not in f for f in files) or len(set(files)) < len(files):
        raise ValueError("invalid shard_files in the metadata")
    there = {n for n in storage.names_in(path) if n.endswith(".bin")}
    if there != set(files):
        raise ValueError(f"shard set does not match: missing {sorted(set(files) - there)[:5]}, extra {sorted(there - set(files))[:5]}")
    return meta, files


def read_binary(spark: SparkSession, path: str, vocab_size: int, tokenizer_sha256: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """shard, doc, ids, n_tokens of a folder of shards with a complete corpus.json, or of one .bin file without any."""
    path, meta = storage.shown(path), {}
    if storage.is_folder(path):
        meta, files = _declared(path, vocab_size, tokenizer_sha256)
        paths = [f"{path}/{f}" for f in files]
    else:
        paths = [path]
    dtype = meta.get("dtype", "uint16" if vocab_size <= 65535 else "uint32")
    if dtype not in ("uint16", "uint32"):
        raise ValueError(f"unsupported dtype {dtype!r}")
    found = totals(spark, paths, dtype)
    if meta:
        for field, actual in (("documents", sum(d for d, _ in found)), ("tokens", sum(t for _, t in found)), ("shards", len(paths))):
            if meta.get(field) != actual:
                raise ValueError(f"metadata mismatch for {field}: declared {meta.get(field)}, found {actual}")
    spark.dataSource.register(ShardSource)
    step = max(1, range_bytes // np.dtype(dtype).itemsize)
    return spark.read.format("binary_shards").options(paths=json.dumps(paths), dtype=dtype, step=str(step)).load()
