"""Encoded tasks as shards that a later run goes on from.

A task is one input file (or any other unit) with a fingerprint. Every task's rows lie in a folder of their own, named by
its place and the run that wrote it; ``tasks.json`` lists the folders that count and is put in place after their data. A run reads
and writes only tasks without a folder of the same fingerprint, in waves that are committed one by one, so an
interrupted run goes on after its last wave. What the list doesn't name (tasks that are gone, changed or empty, or a run that
died) is deleted by the next commit and never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.hashing import canonical_digest
from millrace.sources import storage

#: Bytes of input for one wave.
WAVE_BYTES = 1 << 40


class Task(NamedTuple):
    name: str
    fingerprint: str
    size: int = 0


def file_tasks(files: list[storage.File], identity: dict) -> list[Task]:
    """A task for each file: its fingerprint covers path, size, time of the last change and what the rows are made with."""
    return [Task(f.path, canonical_digest({"build": identity, "path": f.path, "source_size": f.size, "source_modified": f.modified}), f.size) for f in files]


def _saved(path: str) -> dict:
    return json.loads(storage.read_text(f"{path}/tasks.json") or '{"tasks": [], "schema": null}')


def _commit(path: str, entries: list[dict], schema: str | None) -> None:
    storage.write_text(f"{path}/tasks.json", json.dumps({"tasks": entries, "schema": schema}))
    kept = {f"part={e['part']}" for e in entries if e["rows"]}
    for name in storage.names_in(f"{path}/shards"):
        if name not in kept:
            storage.remove(f"{path}/shards/{name}")


def _waves(todo: list[tuple[int, Task]], most: int):
    wave, size = [], 0
    for i, t in todo:
        if wave and size + t.size > most:
            yield wave
            wave, size = [], 0
        wave.append((i, t))
        size += t.size
    if wave:
        yield wave


def write_tasks(spark: SparkSession, tasks: list[Task], path: str, encoded: Callable[[list[str]], DataFrame], in_place: bool = False, fresh: bool = False, wave_bytes: int = WAVE_BYTES, totals: tuple[str, ...] = (), first: Callable[[], None] = lambda: None) -> int:
    """Bring the shards under path in line with tasks; how many tasks were written.

    encoded(names): the rows to write of these tasks, with a column task. in_place: a saved task of another fingerprint at the
    same place is an error unless fresh, which begins anew. totals: columns whose sums are listed with each task; first: called before
    the first change.
    """
    saved = _saved(path)
    if fresh:
        saved = {"tasks": [], "schema": None}
    elif in_place:
        for i, (t, old) in enumerate(zip(tasks, saved["tasks"])):
            if (t.name, t.fingerprint) != (old["task"], old["fingerprint"]):
                raise ValueError(f"task {i} ({t.name}) no longer matches its shard; rerun with --fresh")
    by = {(e["task"], e["fingerprint"]): e for e in saved["tasks"]}
    schema = saved["schema"]
    todo = [(i, t) for i, t in enumerate(tasks) if (t.name, t.fingerprint) not in by]
    listed = lambda: [by[t.name, t.fingerprint] for t in tasks if (t.name, t.fingerprint) in by]
    if todo or listed() != saved["tasks"] or fresh:
        first()
    for wave in _waves(todo, wave_bytes):
        run = uuid.uuid4().hex[:12]
        part = {t.name: f"{i:06d}-{run}" for i, t in wave}
        names = spark.createDataFrame(list(part.items()), "task string, part string")  # a row a task
        rows = encoded(list(part)).join(F.broadcast(names), "task").drop("task")
        rows.write.partitionBy("part").option("partitionOverwriteMode", "static").mode("append").parquet(f"{path}/shards")
        schema = T.StructType([f for f in rows.schema if f.name != "part"]).json()
        there = set(storage.names_in(f"{path}/shards"))
        full = [p for p in part.values() if f"part={p}" in there]
        sums = read_parts(spark, path, full, schema).groupBy("part").agg(F.count("*").alias("rows"), *(F.sum(c).cast("long").alias(f"total_{c}") for c in totals))
        counts = {r.part: r for r in sums.collect()}  # a row a task, from no column but those of totals
        for i, t in wave:
            by[t.name, t.fingerprint] = {"task": t.name, "fingerprint": t.fingerprint, "part": (p := part[t.name]), "rows": counts[p].rows if p in counts else 0, "totals": {c: (counts[p][f"total_{c}"] or 0) if p in counts else 0 for c in totals}}
        _commit(path, listed(), schema)
    if not todo and (listed() != saved["tasks"] or fresh):
        _commit(path, listed(), schema)
    return len(todo)


def read_parts(spark: SparkSession, path: str, parts: list[str], schema: str) -> DataFrame:
    own = T.StructType.fromJson(json.loads(schema))
    full = T.StructType([*own.fields, T.StructField("part", T.StringType())])
    if not parts:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{path}/shards").parquet(*(f"{path}/shards/part={p}" for p in parts))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all listed tasks, with part; folders that the list doesn't name are not read."""
    saved = _saved(path)
    if saved["schema"] is None:
        raise ValueError(f"no shards under {path}")
    return read_parts(spark, path, [e["part"] for e in saved["tasks"] if e["rows"]], saved["schema"])


def task_rows(path: str) -> list[dict]:
    """task, fingerprint, part and rows of each listed task, in order."""
    return _saved(path)["tasks"]


def combined_fingerprint(tasks: list[Task]) -> str:
    """One digest over the fingerprints of all tasks, in order."""
    return hashlib.sha256("\n".join(t.fingerprint for t in tasks).encode("ascii")).hexdigest()
