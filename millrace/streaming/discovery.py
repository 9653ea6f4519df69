"""Finding newly completed corpora while a run goes on, and the state a run resumes from."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import storage

STATE_VERSION = 4


def complete_corpora(root: str, known: set[str], weight: float = 1.0, val_docs: int = 0) -> list[dict]:
    """Folders under root with a complete marker that aren't known yet; unreadable markers are passed over."""
    out = []
    for name in storage.names_in(root):
        path = storage.shown(f"{root}/{name}")
        if path in known:
            continue
        try:
            meta = json.loads(storage.read_text(f"{path}/corpus.json") or "null")
        except ValueError:
            continue
        if isinstance(meta, dict) and meta.get("complete") is True:
            out.append({"name": f"auto-{name}-{hashlib.sha256(path.encode()).hexdigest()[:10]}", "path": path, "weight": weight, "val_docs": val_docs})
    return out


def watch(spark: SparkSession, root: str, apply, seconds: float = 600, known: set[str] | None = None, checkpoint: str | None = None):
    """A query that lists markers again at each trigger and hands new corpora to ``apply``.

    Markers may be rewritten in place, which a file source would not see, so a clock drives the listing. With a
    checkpoint folder, the clock and the corpora that were handed over outlive a restart.
    """
    seen = set() if known is None else known
    if checkpoint:
        seen.update(json.loads(storage.read_text(f"{checkpoint}/known.json") or "[]"))

    def step(_: DataFrame, __: int) -> None:
        new = complete_corpora(root, seen)
        if new:
            apply(new)
            seen.update(c["path"] for c in new)
            if checkpoint:
                storage.write_text(f"{checkpoint}/known.json", json.dumps(sorted(seen)))

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    out = clock.writeStream.foreachBatch(step).trigger(processingTime=f"{seconds} seconds")
    return (out.option("checkpointLocation", f"{checkpoint}/clock") if checkpoint else out).start()


def stop_when(query, seconds: float, asked=lambda: False, poll: float = 0.2) -> str:
    """Stop a query after so many seconds or when asked, between two batches, so that its checkpoint is whole; why."""
    end, why = time.monotonic() + seconds, "time"
    while query.isActive and time.monotonic() < end:
        if asked():
            why = "asked"
            break
        time.sleep(min(poll, max(0.0, end - time.monotonic())))
    while query.isActive and query.status["isTriggerActive"]:
        time.sleep(poll)
    query.stop()
    return why


def late_heads(progress: DataFrame, late: list[str], factors: dict[str, int]) -> dict[str, int]:
    """Start tags of late corpora: the least progress of those already running, so that none takes over the mixture.

    progress: corpus, emitted (predictions so far); one row a corpus.
    """
    now = [r.emitted * factors[r.corpus] for r in progress.collect() if r.corpus not in late]
    least = min(now, default=0)
    return {c: least // factors[c] * factors[c] for c in late}


def save_state(path: str, state: dict) -> None:
    storage.write_text(path, json.dumps(state | {"version": STATE_VERSION}, sort_keys=True))


def load_state(path: str) -> dict:
    """A saved state. Version 2 and files without one knew one corpus list and no late corpora; later ones are refused."""
    state = json.loads(storage.read_text(path))
    version = state.get("version", 1)
    if version in (1, 2):
        return {"late": [], "handed_off": 0} | state | {"version": STATE_VERSION}
    if version != STATE_VERSION:
        raise ValueError(f"state of version {version}")
    return state


def check_state(state: dict, buffer: int) -> None:
    """Fail if a state was saved under another shuffle buffer."""
    if state.get("buffer", buffer) != buffer:
        raise ValueError("the shuffle buffer has another size than the saved state")


def emitted(batches: DataFrame) -> DataFrame:
    """Predictions and documents that each corpus has given so far."""
    return batches.groupBy("corpus").agg(F.sum("predictions").alias("emitted"), F.countDistinct("doc_id").alias("documents"))
