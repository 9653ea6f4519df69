"""Ranks and prefix sums over a whole table without a single-partition window.

Rows are range-partitioned by the order; windows run inside partitions, and the partitions' totals
(one row for each partition and group) are summed up and joined back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, order: list, value: Column | None = None, by: list[str] | None = None, rank: str = "rank", before: str = "before", partitions: int | None = None) -> DataFrame:
    """Adds the 0-based rank of each row in its group and the sum of value over the rows before it."""
    by = by or []
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*by, *order]
    dealt = df.withColumn("_v", (F.lit(0) if value is None else value).cast("long")).repartitionByRange(n, *keys).withColumn("_p", F.spark_partition_id())
    # range bounds are sampled, so rows and totals must come from one and the same exchange
    dealt = dealt.persist()
    inside = Window.partitionBy("_p", *by).orderBy(*order)
    rows = dealt.withColumn("_r", F.row_number().over(inside) - 1).withColumn("_b", F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    totals = dealt.groupBy("_p", *by).agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", *(F.col(c).alias(f"_by_{c}") for c in by), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_on"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_os")).withColumnRenamed("_p", "_op")
    on = F.col("_p") == F.col("_op")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = rows.join(offsets, on)
    return out.select(*df.columns, (F.col("_r") + F.col("_on")).cast("long").alias(rank), (F.coalesce("_b", F.lit(0)) + F.col("_os")).cast("long").alias(before))


def prefix_budget(df: DataFrame, order: list, size: Column, most: int, count: int | None = None) -> DataFrame:
    """The longest prefix whose sizes fit; the first row that would exceed it ends it."""
    out = running(df, order, size, rank="_rank", before="_before").where(F.col("_before") + size <= most)
    # sizes are not negative, so what fits after an overflow would have to fit before it: only zero sizes can
    if count is not None:
        out = out.where(F.col("_rank") < count)
    return out.drop("_rank", "_before")


def shard_of(ranks: DataFrame, documents: list[int], rank: str = "rank") -> DataFrame:
    """ranks with shard and row: the shard in which a rank over all documents lies, and its place there. documents: of each shard, in order."""
    ends = np.cumsum(np.asarray(documents, np.int64))  # eight bytes a shard go to each task, and a rank is looked up by halving
    total = int(ends[-1]) if len(ends) else 0

    @F.pandas_udf("shard long, row long")
    def find(r: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(ends, r.to_numpy(), side="right")
        return pd.DataFrame({"shard": at, "row": r.to_numpy() - np.concatenate([[0], ends])[at]})

    found = ranks.where((F.col(rank) >= 0) & (F.col(rank) < total)).withColumn("_found", find(F.col(rank).cast("long")))
    return found.withColumns({"shard": F.col("_found.shard"), "row": F.col("_found.row")}).drop("_found")
