"""What the operators of this subpackage share: table access, shared scratch tables, hashing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import checkpoint_folder

#: Bytes of a table's files for one bucket of a packed exchange.
BUCKET_BYTES = 32 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """How many partitions the session shuffles to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets(df: DataFrame) -> int:
    """How many buckets a table's packed exchange has: the session's partitions, or more where the table's files are large."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    leaves = df.inputFiles()  # without files the planner's size is a guess
    return max(parts(df.sparkSession), -(-size // BUCKET_BYTES) if leaves else 1)


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where a local session names none."""
    return checkpoint_folder(spark)


def written(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut and a lost executor loses nothing."""
    spark = spark or df.sparkSession
    path = f"{scratch(spark)}/millrace-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` made, once everything still needed of it has been written too."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0].rpartition("/")[0]) if df.inputFiles() else None
    if path and path.getName().startswith("millrace-"):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def train_fold(doc_id, held: int) -> F.Column:
    """True where crc32(doc_id as text) mod 5 is ``held``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == held


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True) + MIX * np.uint64(2 * seed + 1)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def to_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def drop_shuffles(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that shuffle files of jobs that are over leave the executors' disks."""
    import gc
    import time

    for _ in range(2):  # what the first pass frees lets go of more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
