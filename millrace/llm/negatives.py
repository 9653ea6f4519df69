"""Hard negatives by exact inner products over buckets of vectors sorted by norm.

Index: vectors become integers (floor of SCALE times each component), are range-partitioned by length of vector and
falling norm (ties by id and row, so no value is too common) into shards of about SHARD_BYTES, and cut into buckets of
at most BUCKET vectors and BUCKET_BYTES. A bucket knows its largest norm m; by Cauchy-Schwarz no vector in it has a
score above |a| m with anchor a.

Positives: an anchor first meets the bucket it lies in, which bounds its k-th positive from below; buckets with
|a| m below the bound of every anchor of a group are not sent to that group, and within a task buckets come by falling
norm while the running k-th score rises. Negatives: each positive of score p opens a window [ceil(low p / 100), p]; a bucket
counts only where |a| m reaches some window's lower limit or, once a window is full, its running k-th score.
Groups of anchors are runs in the order of norms, so that anchors of a group need about the same buckets. Sent to every
Python worker: one largest norm for each shard and length of vector.

Cases: rows without an id or label, and vectors that are null or hold null or non-finite components, take no part;
vectors of different lengths are never compared; rows that repeat an id are rows of their own, each an
anchor, positive or negative (so only an anchor's own row is left out); ties go to the smaller id, then to the earlier row of the index; a window of a
negative score is empty, as 80 p > 100 p; anchors without positives or negatives give no rows; an empty table gives an
empty result; other columns are not read. Scores are exact while they fit 63 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.topk import products

SCALE = 256.0
BUCKET = 2048
BUCKET_BYTES = 1 << 20
SHARD_BYTES = 32 << 20
ANCHORS = 256
#: Anchor blocks (of at most BUCKET_BYTES each) that one task holds at most.
GROUP = 16
SLACK = 1e-9
LEAST = np.iinfo(np.int64).min
_BUCKETS = "shard int, dim int, top double, first long, ids binary, labels binary, ints binary"
_ASKED = "dim int, need double, ids binary, rows binary, labels binary, ints binary, limits binary"


def _numbers(column, i: int, dtype=np.int64) -> np.ndarray:
    """The numbers in the i-th binary value, without a copy."""
    return np.frombuffer(column[i].as_buffer(), dtype)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(1)) if x.size else np.zeros(len(x))


def needed(size: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The norm that a vector needs at least to reach each limit with anchors of these norms, less a slack."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(limit > 0, np.where(size > 0, limit / size, np.inf), 0.0) * (1 - SLACK)


def first_k(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id and row."""
    if len(ids) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[-k])
        return near[np.lexsort((rows[near], ids[near], -scores[near]))[:k]]
    return np.lexsort((rows, ids, -scores))[:k]


class NormIndex:
    """Vectors sorted by norm in buckets, written to the shared folder. vectors: vec_id, label, embedding."""

    def __init__(self, vectors: DataFrame, scale: float = SCALE):
        self.spark = vectors.sparkSession
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
        good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

        def key(batches):
            for b in batches:
                values = np.floor(scale * b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
                ends = np.cumsum(pc.list_value_length(b.column("embedding")).to_numpy(zero_copy_only=False).astype(np.int64))
                own = np.split(values, ends[:-1]) if len(ends) else []
                size = np.array([np.sqrt(float((v.astype(np.float64) ** 2).sum())) for v in own])
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([len(v) for v in own], pa.int32()), pa.array(size, pa.float64()), pa.array([v.tobytes() for v in own], pa.binary())], names=["vec_id", "label", "dim", "norm", "ints"])

        def cut(batches):
            """Buckets of one length of vector, filled across batches; rows are numbered in the order of the shard."""
            held, count = None, 0
            for b in [*batches, None]:
                if b is not None:
                    now = pa.Table.from_batches([b])
                    held = now if held is None else pa.concat_tables([held, now])
                if held is None:
                    return
                dims = held["dim"].to_numpy()
                edges, done = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), held.num_rows], 0
                for a, z in zip(edges[:-1], edges[1:]):
                    most = max(1, min(BUCKET, BUCKET_BYTES // (8 * int(dims[a]) + 1)))
                    for s in range(a, z, most):
                        e = min(s + most, z)
                        if b is not None and e == held.num_rows:
                            break
                        part = held.slice(s, e - s)
                        shard = part["shard"][0].as_py()
                        yield pa.RecordBatch.from_pydict({
                            "shard": pa.array([shard], pa.int32()), "dim": pa.array([int(dims[a])], pa.int32()), "top": [float(part["norm"].to_numpy().max())], "first": [(shard << 40) + count],
                            "ids": [part["vec_id"].to_numpy().astype(np.int64).tobytes()], "labels": [part["label"].to_numpy().astype(np.int64).tobytes()], "ints": [b"".join(part["ints"].to_pylist())],
                        })
                        count, done = count + e - s, e
                held = held.slice(done)

        total = good.agg(F.sum(8 * F.size("embedding") + 16)).first()[0] or 0
        shards = max(common.parts(self.spark), -(-total // SHARD_BYTES))
        order = ["dim", F.desc("norm"), "vec_id", "label", "at"]
        keyed = good.mapInArrow(key, "vec_id long, label long, dim int, norm double, ints binary").withColumn("at", F.monotonically_increasing_id())
        dealt = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).drop("at").withColumn("shard", F.spark_partition_id())
        self.buckets = common.written(dealt.mapInArrow(cut, _BUCKETS))

    def anchors(self, every: int, k: int) -> DataFrame:
        """Blocks of the rows whose id is divisible by every, with a lower limit on each one's k-th positive from its own bucket."""

        def run(batches):
            held, kind = [], None

            def block():
                ids, rows, labels, x, limits = (np.concatenate([h[j] for h in held]) for j in range(5))
                need = float(needed(norms(x), limits).min())
                held.clear()
                return pa.RecordBatch.from_pydict({"dim": pa.array([kind], pa.int32()), "need": [need], "ids": [ids.tobytes()], "rows": [rows.tobytes()], "labels": [labels.tobytes()], "ints": [x.tobytes()], "limits": [limits.tobytes()]})

            for b in batches:
                for r in range(b.num_rows):
                    ids, labels, dim = _numbers(b["ids"], r), _numbers(b["labels"], r), b["dim"][r].as_py()
                    x, rows = _numbers(b["ints"], r).reshape(len(ids), dim), b["first"][r].as_py() + np.arange(len(ids))
                    mine, most = np.flatnonzero(ids % every == 0), max(1, min(ANCHORS, BUCKET_BYTES // (8 * dim + 1)))
                    for a in range(0, len(mine), most):
                        at = mine[a : a + most]
                        scores = products(x[at], x)
                        scores[(labels[at][:, None] != labels) | (at[:, None] == np.arange(len(ids)))] = LEAST
                        limits = np.partition(scores, len(ids) - k, 1)[:, -k] if len(ids) >= k else np.full(len(at), LEAST)
                        if held and (kind != dim or sum(len(h[0]) for h in held) + len(at) > most):
                            yield block()
                        kind = dim
                        held.append((ids[at], rows[at], labels[at], x[at], limits))
            if held:
                yield block()

        return common.written(self.buckets.mapInArrow(run, _ASKED).withColumn("number", F.monotonically_increasing_id()))

    def meetings(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Anchor blocks and buckets by shard and group of anchor blocks; buckets whose norm is too small for a whole group stay where they are."""
        task = F.shiftright("number", 33)
        counts = asked.groupBy(task.alias("task")).count().orderBy("task").collect()  # a row a task
        ends = np.cumsum([0, *(r["count"] for r in counts)]).tolist()
        begins = self.spark.createDataFrame([(r.task, n) for r, n in zip(counts, ends)], "task long, begin long")
        tops = self.buckets.groupBy("dim", "shard").agg(F.max("top").alias("top")).collect()  # a row a shard and length
        of: dict[int, list] = {}
        for r in tops:
            of.setdefault(r.dim, []).append((r.top, r.shard))
        plan = self.spark.createDataFrame([(d, [float(t) for t, _ in sorted(v)], [s for _, s in sorted(v)]) for d, v in of.items()], "dim int, tops array<double>, shards array<int>")
        own = asked.withColumn("task", task).join(F.broadcast(begins), "task").join(F.broadcast(plan), "dim")
        admitted = F.filter(F.arrays_zip("tops", "shards"), lambda t: t["tops"] >= F.col("need"))
        part = F.floor((F.col("begin") + F.col("number") - F.shiftleft("task", 33)) / GROUP)
        left = own.select(F.explode(admitted.getField("shards")).alias("shard"), part.alias("part"), *asked.columns)
        asks = left.groupBy("shard", "part", "dim").agg(F.min("need").alias("need"))
        right = self.buckets.join(asks, ["shard", "dim"]).where(F.col("top") >= F.col("need"))
        return left, right.select("shard", (F.col("part") + 0).alias("part"), *self.buckets.columns[1:])  # a column of its own

    def _met(self, asked: DataFrame, meet, schema: str) -> DataFrame:
        left, right = self.meetings(asked)
        return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(meet, schema)

    def positives(self, asked: DataFrame, k: int) -> DataFrame:
        """number, i, rank, vec_id, row, score: the k best rows of the same label of each anchor (block number, place i)."""

        def meet(q: pa.Table, x: pa.Table) -> pa.Table:
            order = np.argsort(-x["top"].to_numpy(), kind="stable").tolist()
            out: list[list] = [[], [], [], [], []]
            for r in range(q.num_rows):
                rows, labels, limits, dim = _numbers(q["rows"], r), _numbers(q["labels"], r), _numbers(q["limits"], r).copy(), q["dim"][r].as_py()
                v = _numbers(q["ints"], r).reshape(len(rows), dim)
                size, found = norms(v), [tuple(np.zeros(0, np.int64) for _ in range(3))] * len(rows)
                for b in order:
                    live = np.flatnonzero(needed(size, limits) <= x["top"][b].as_py()) if x["dim"][b].as_py() == dim else ()
                    if not len(live):
                        continue
                    ids, own = _numbers(x["ids"], b), x["first"][b].as_py()
                    others = own + np.arange(len(ids))
                    scores = products(v[live], _numbers(x["ints"], b).reshape(len(ids), dim))
                    hits = (scores >= limits[live][:, None]) & (_numbers(x["labels"], b) == labels[live][:, None]) & (others != rows[live][:, None])
                    for j in np.flatnonzero(hits.any(1)).tolist():
                        i, h = live[j], hits[j]
                        new = [np.r_[a, c] for a, c in zip(found[i], (ids[h], others[h], scores[j][h]))]
                        at = first_k(*new, k)
                        found[i] = tuple(c[at] for c in new)
                        if len(at) == k:
                            limits[i] = max(limits[i], found[i][2][-1])
                number = q["number"][r].as_py()
                for i, f in enumerate(found):
                    for o, c in zip(out, (np.full(len(f[0]), number), np.full(len(f[0]), i), *f)):
                        o.append(c)
            return _table(out, ["number", "i", "vec_id", "row", "score"])

        met = self._met(asked, meet, "number long, i long, vec_id long, row long, score long")
        return met.withColumn("rank", F.row_number().over(Window.partitionBy("number", "i").orderBy(F.desc("score"), "vec_id", "row"))).where(F.col("rank") <= k)

    def mine(self, every: int, low: int, k_positive: int = 5, k_negative: int = 5) -> DataFrame:
        """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: each window's first k_negative rows of another label."""
        asked = self.anchors(every, k_positive)
        positives = self.positives(asked, k_positive).groupBy("number").agg(F.sort_array(F.collect_list(F.struct("i", "rank", "vec_id", "score"))).alias("found"))  # at most anchors x k

        def windows(batches):
            """Anchor blocks with ids and scores of their positives (a score of -1: no window)."""
            for b in batches:
                for r in range(b.num_rows):
                    ids, dim = _numbers(b["ids"], r), b["dim"][r].as_py()
                    pos, score = np.zeros((len(ids), k_positive), np.int64), np.full((len(ids), k_positive), -1, np.int64)
                    for f in b["found"][r].as_py():
                        pos[f["i"], f["rank"] - 1], score[f["i"], f["rank"] - 1] = f["vec_id"], max(f["score"], -1)
                    lowest = np.where(score >= 0, -((-low * score) // 100), np.iinfo(np.int64).max).min(1)
                    size = norms(_numbers(b["ints"], r).reshape(len(ids), dim))
                    keep = (score >= 0).any(1)
                    if keep.any():
                        need = float(needed(size, lowest)[keep].min())
                        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([need]), *(b[c].slice(r, 1) for c in ("ids", "labels", "ints")), pa.array([pos.tobytes()]), pa.array([score.tobytes()]), b["number"].slice(r, 1)], names=names)

        names = ["dim", "need", "ids", "labels", "ints", "positives", "scores", "number"]
        opened = common.written(asked.join(positives, "number").select("dim", "ids", "labels", "ints", "found", "number").mapInArrow(windows, "dim int, need double, ids binary, labels binary, ints binary, positives binary, scores binary, number long"))

        def meet(q: pa.Table, x: pa.Table) -> pa.Table:
            order = np.argsort(-x["top"].to_numpy(), kind="stable").tolist()
            out: list[list] = [[] for _ in range(9)]
            for r in range(q.num_rows):
                ids, labels, dim = _numbers(q["ids"], r), _numbers(q["labels"], r), q["dim"][r].as_py()
                v, pos = _numbers(q["ints"], r).reshape(len(ids), dim), _numbers(q["positives"], r).reshape(len(ids), -1)
                high = _numbers(q["scores"], r).reshape(len(ids), -1)
                size, nothing = norms(v), np.iinfo(np.int64).max
                limits = np.where(high >= 0, -((-low * high) // 100), nothing)
                found: dict = {}
                for b in order:
                    live = np.flatnonzero(needed(size, limits.min(1)) <= x["top"][b].as_py()) if x["dim"][b].as_py() == dim else ()
                    if not len(live):
                        continue
                    others, first = _numbers(x["ids"], b), x["first"][b].as_py()
                    scores = products(v[live], _numbers(x["ints"], b).reshape(len(others), dim))
                    hits = (scores >= limits[live].min(1)[:, None]) & (scores <= high[live].max(1)[:, None]) & (_numbers(x["labels"], b) != labels[live][:, None])
                    for j in np.flatnonzero(hits.any(1)).tolist():
                        i, h = live[j], np.flatnonzero(hits[j])
                        s = scores[j][h]
                        for w in range(high.shape[1]):
                            own = (s >= limits[i, w]) & (s <= high[i, w])
                            if not own.any():
                                continue
                            new = [others[h[own]], first + h[own], s[own]]
                            if (i, w) in found:
                                new = [np.r_[a, c] for a, c in zip(found[i, w], new)]
                            at = first_k(*new, k_negative)
                            found[i, w] = [c[at] for c in new]
                            if len(at) == k_negative:
                                limits[i, w] = max(limits[i, w], found[i, w][2][-1])
                number = q["number"][r].as_py()
                for (i, w), f in found.items():
                    for o, c in zip(out, (*(np.full(len(f[0]), c) for c in (number, i, w, ids[i], pos[i, w], high[i, w])), *f)):
                        o.append(c)
            return _table(out, ["number", "i", "w", "anchor_id", "positive_id", "positive_score", "negative_id", "row", "negative_score"])

        met = self._met(opened, meet, "number long, i long, w long, anchor_id long, positive_id long, positive_score long, negative_id long, row long, negative_score long")
        rank = F.row_number().over(Window.partitionBy("number", "i", "w").orderBy(F.desc("negative_score"), "negative_id", "row"))
        return met.withColumn("rank", rank).where(F.col("rank") <= k_negative).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _table(parts: list[list], names: list[str]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(np.concatenate(p).astype(np.int64) if p else np.zeros(0, np.int64)) for p in parts], names=names)


def relabelled(vec_id: Column, label: Column) -> Column:
    """The label, moved on by one of ten where the id is divisible by 7."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def op12(spark, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", relabelled(F.col("vec_id"), F.col("label")).alias("label"), "embedding")
    return NormIndex(rows).mine(every=100, low=80)


ORACLE = """
    WITH v AS (
        SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT a.r AS ar, a.vec_id AS anchor_id, v.r AS r, v.vec_id AS vec_id, a.label = v.label AS same, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
        FROM v AS a JOIN v ON a.r <> v.r AND len(a.e) = len(v.e) WHERE a.vec_id % 100 = 0),
    p AS (SELECT ar, anchor_id, r AS pr, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) <= 5)
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.ar, pr ORDER BY s.score DESC, s.vec_id, s.r) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
    FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score QUALIFY rank <= 5"""
