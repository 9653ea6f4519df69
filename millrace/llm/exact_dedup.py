"""Exact dedup by a tree merge of sorted digest runs.

Every partition sorts the digests of its rows into one run (digest, kept id, count).
Then runs are exchanged in binomial rounds: in round r a node swaps with the nodes whose
number differs in the r-th group of bits only, so that each run's digests move towards
the node that owns them, and every node merges what it got (an external, spilling merge
by Spark's sorter, then one pass that folds equal neighbours). A digest occurs at most
once in a run, so however many copies a text has, a node gets one entry from each run.
After the last round each node holds the finished groups of its share of the digests;
no node ever holds more than that share.

A fold is verified: SHA-256 equality must agree with the byte length and a second,
independent 64-bit hash, or the job fails.

Cases: a null text counts as empty; a null id is kept only where no row of its
text has another; among repeated
rows with one id and text exactly one row is kept; an empty table gives an empty result;
other columns are ignored by ``groups``, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common

_NULL = np.iinfo(np.int64).min
_RUN = "node long, digest binary, n_bytes long, check long, keep_id long, n long"


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_bytes, check of every row's text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("check"),
    )


def _fold(largest: bool, mask: int, keep_bits: int):
    """Fold neighbours with equal digests and name the node of the next round."""
    pick = np.maximum if largest else np.minimum

    def emit(raw, size, check, keep, n, node):
        head = raw.reshape(-1, 32)[:, :8].copy().view(">u8").ravel().astype(np.int64)
        target = head & keep_bits
        return pa.RecordBatch.from_arrays(
            [
                pa.array((node & ~mask) | (target & mask)),
                pa.Array.from_buffers(pa.binary(), len(node), [None, pa.py_buffer(np.arange(0, 32 * len(node) + 1, 32, dtype=np.int32)), pa.py_buffer(raw.tobytes())]),
                pa.array(size), pa.array(check), pa.array(keep), pa.array(n),
            ],
            names=["node", "digest", "n_bytes", "check", "keep_id", "n"],
        )

    def fold(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {k: batch.column(k) for k in batch.schema.names}
            raw = np.frombuffer(b"".join(col["digest"].to_pylist()), np.uint8)
            now = [raw] + [col[k].to_numpy(zero_copy_only=False) for k in ("n_bytes", "check", "keep_id", "n", "node")]
            if held:
                now = [np.concatenate(x) for x in zip(held, now)]
            raw, size, check, keep, n, node = now
            key = raw.view("V32")
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            same = np.ones(len(key), bool)
            same[new] = False
            at = np.flatnonzero(same)
            if (size[at] != size[at - 1]).any() or (check[at] != check[at - 1]).any():
                raise ValueError("two texts share a SHA-256 digest but differ")
            out = [key[new].view(np.uint8), size[new], check[new], pick.reduceat(keep, new), np.add.reduceat(n, new), node[new]]
            held = [out[0][-32:]] + [x[-1:] for x in out[1:]]
            if len(new) > 1:
                yield emit(out[0][:-32], *(x[:-1] for x in out[1:]))
        if held:
            yield emit(*held)

    return fold


def groups(sigs: DataFrame, keep: str = "smallest", radix_bits: int = 3) -> DataFrame:
    """digest, keep_id, group_size of every distinct text, by the tree merge over ``signatures``."""
    largest = keep == "largest"
    none = int(_NULL) if largest else -int(_NULL) - 1  # stands for a null id: loses against any other
    levels = max(1, (common.parts(sigs.sparkSession) - 1).bit_length())
    whole = (1 << levels) - 1
    rows = sigs.select(
        (F.spark_partition_id() % (whole + 1)).cast("long").alias("node"),
        "digest", "n_bytes", "check",
        F.coalesce("doc_id", F.lit(none)).alias("keep_id"),
        F.lit(1).cast("long").alias("n"),
    )
    shifts = list(range(0, levels, radix_bits))
    masks = [((1 << min(radix_bits, levels - s)) - 1) << s for s in shifts]
    # leaf runs, already addressed to the nodes of the first round
    runs = rows.sortWithinPartitions("node", "digest").mapInArrow(_fold(largest, masks[0], whole), _RUN)
    for later in [*masks[1:], 0]:
        runs = runs.repartition(whole + 1, "node").sortWithinPartitions("node", "digest").mapInArrow(_fold(largest, later, whole), _RUN)
    return runs.select("digest", F.when(F.col("keep_id") != none, F.col("keep_id")).alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    sigs = common.written(signatures(docs))
    many = groups(sigs, keep).where("group_size > 1")
    copy = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("check"))
    return (
        sigs.withColumn("copy", copy).join(many, "digest", "left")
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (F.when(F.col("group_size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of docs that ``exact_dedup`` keeps, with all their columns."""
    key = lambda i, sha: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), sha)
    flags = exact_dedup(docs, keep).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("_key"))
    own = docs.withColumn("_key", key(F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    # rows that repeat id and text: one of them stays; the text moves once, by the key of both steps
    copy = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(1)))
    return own.join(flags, "_key", "left_semi").withColumn("_copy", copy).where("_copy = 1").select(docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"), keep="largest")


ORACLE = """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
