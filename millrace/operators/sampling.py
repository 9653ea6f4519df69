"""Samples and orders: by hash, by replayed reservoirs, by NumPy's generators."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import stable_seed
from millrace.operators.ordering import running


def by_hash(df: DataFrame, by: str, key: str, count: int, seed: int = 0) -> DataFrame:
    """count rows of each group, in the order of a hash: the distribution of a reservoir, whatever the row order."""
    w = Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", F.lit(seed), by, key)), key)
    return df.withColumn("sample_ord", F.row_number().over(w) - 1).where(F.col("sample_ord") < count)


def reservoir_ranks(n: int, count: int, seed: int, path: str) -> list[int]:
    """Which of n rows a seeded reservoir of that size ends with, in its final shuffled order."""
    rng = random.Random(stable_seed(seed, path))
    held = list(range(min(n, count)))
    for rank in range(count, n):
        at = rng.randrange(rank + 1)
        if at < count:
            held[at] = rank
    rng.shuffle(held)
    return held


def reservoir(df: DataFrame, by: str, order: str, count: int, seed: int) -> DataFrame:
    """The rows that a sequential reservoir over each group keeps, with their place in the sample.

    The draws depend on the group's size alone, so they are replayed over ranks; rows are joined to them.
    """
    ranked = running(df, [order], by=[by]).drop("before")
    sizes = df.groupBy(by).agg(F.count("*").alias("n"))

    def draw(frames):
        for f in frames:
            rows = [(g, r, i) for g, n in zip(f[by], f["n"]) for i, r in enumerate(reservoir_ranks(int(n), count, seed, str(g)))]
            yield __import__("pandas").DataFrame(rows, columns=[by, "rank", "sample_ord"])

    kept = sizes.mapInPandas(draw, f"{by} {dict(df.dtypes)[by]}, rank long, sample_ord int")
    return ranked.join(kept, [by, "rank"])


def shuffled(df: DataFrame, position: str, key: str, buffer: int, seed: int) -> DataFrame:
    """df with out_order, whose ascending order is a local shuffle: a row is put off by less than ``buffer`` places, by a hash of its key.

    A buffer of at most 1 leaves the order. Any row order gives the same result, so nothing has to be replayed.
    """
    if buffer <= 1:
        return df.withColumn("out_order", F.col(position).cast("long"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.withColumn("out_order", F.col(position) + F.pmod(h, F.lit(buffer)))


def draws(seed: int, begin: int, sizes: np.ndarray) -> np.ndarray:
    """The buffer's draws from step ``begin`` on, each below its size; a draw depends on seed and step only."""
    with np.errstate(over="ignore"):
        x = (np.arange(begin, begin + len(sizes), dtype=np.uint64) + np.uint64(seed % 2**64) * np.uint64(0xD1342543DE82EF95)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ x >> np.uint64(32)) % sizes.astype(np.uint64)).astype(np.int64)


def buffered(n: int, buffer: int, seed: int, begin: int, end: int) -> list[int]:
    """When each of the rows begin to end (of n) leaves a shuffle buffer, without replaying what came before them.

    The buffer is a list that is filled up behind and gives the row at a drawn place. Of rows before and behind the block only
    their number in the list matters, so a block is replayed from the step at which its first row comes in to that at which its last one leaves.
    """
    step = max(0, begin - buffer + 1)
    older, own, newer, came, out, left = begin - step, [], 0, begin, [0] * (end - begin), end - begin
    while left:
        for place in draws(seed, step, np.minimum(buffer, n - np.arange(step, min(n, step + 4096)))).tolist():
            while older + len(own) + newer < buffer and came < n:
                if came < end:
                    own.append(came)
                else:
                    newer += 1
                came += 1
            if place < older:
                older -= 1
            elif place < older + len(own):
                out[own.pop(place - older) - begin] = step
                left -= 1
            else:
                newer -= 1
            step += 1
            if not left:
                break
    return out


def shuffle_buffer(df: DataFrame, position: str, by: str, buffer: int, seed: int, block: int = 1 << 18) -> DataFrame:
    """df with out_order: when its row leaves a shuffle buffer of so many rows, for each group apart. position: 0-based and gapless in a group.

    Only numbers are shuffled, in blocks of positions that are replayed apart; rows are joined to them last. A buffer of at most 1 keeps the order.
    """
    import pyarrow as pa

    sizes = df.groupBy(by).agg(F.count("*").alias("n"))
    blocks = sizes.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long")))).repartition(by, "begin")
    own = F.when(F.col(by).isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(seed), by))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                n, begin, mark = (b.column(k)[i].as_py() for k in (1, 2, 3))
                end = min(n, begin + block)
                order = buffered(n, max(1, buffer), mark, begin, end)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * (end - begin), b.schema.field(0).type), pa.array(np.arange(begin, end)), pa.array(order, pa.int64())], names=["_by", "_at", "out_order"])

    kind = dict(df.dtypes)[by]
    orders = blocks.select(by, "n", "begin", own.alias("mark")).mapInArrow(run, f"_by {kind}, _at long, out_order long")
    return df.join(orders, df[by].eqNullSafe(orders["_by"]) & (df[position] == orders["_at"])).drop("_by", "_at")


def hash_epochs(examples: DataFrame, key: str, epochs: int, seed: int) -> DataFrame:
    """examples once an epoch, with epoch and mark, whose order is that epoch's permutation; for any number of rows."""
    every = examples.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return every.withColumn("mark", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.col(key).cast("string"))))


def val_positions(n: int, wanted: int, seed: int, offset: int = 991) -> list[int]:
    """Validation examples of a supervised set (a preference set has offset 0): drawn without replacement, at least one example stays for training."""
    k = min(max(0, wanted), max(0, n - 1))
    return sorted(np.random.default_rng(seed + offset).choice(n, k, replace=False).tolist()) if k else []


def epoch_orders(spark: SparkSession, n: int, epochs: int, seed: int) -> DataFrame:
    """epoch, position, example: a new permutation each epoch. One driver-side array of n at a time."""
    frames = [spark.createDataFrame(list(enumerate(np.random.default_rng(seed + e).permutation(n).tolist())), "position long, example long").withColumn("epoch", F.lit(e)) for e in range(epochs)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select("epoch", "position", "example")
