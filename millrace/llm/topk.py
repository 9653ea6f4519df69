"""Exact top-k by integer inner product over a pivot-distance index.

Index: every vector is keyed by its nearest pivot and its distance to it, range-partitioned by
that key (ties by id, so no value is too common) and cut into blocks of at most BLOCK vectors
of one pivot, sorted by distance: a block is an annulus around its pivot. Pivots are picked
farthest-first from a hash sample of PIVOT_SAMPLE vectors; every row is indexed.

Search: a query first meets the block it lies in, which gives a lower bound tau on its k-th
score. For an annulus [lo, hi] around p whose largest norm is m, the triangle inequality gives

    |q - x| >= g = max(0, lo - |q - p|, |q - p| - hi)
    <q, x> <= min((|q|^2 + m^2 - g^2) / 2, <q, p> + |q| * hi)

so shards and then blocks whose bound is below tau are left out; the others are expanded in
the order of their bounds while tau rises. Bounds carry a relative slack, scores are exact
integers. Queries travel in blocks, and only to the shards their bounds admit; index blocks only
to the groups of queries that ask for their shard. What is sent to Python workers of every task
is one interval per shard and pivot: a row for SHARD_BYTES of vectors, plus partitions and pivots. A task holds a shard and a group of
query blocks, both bounded in bytes, whatever the length of the vectors.

Cases: vectors that are null, or hold null or non-finite components, and rows without an id
take no part; vectors of different lengths are never compared; rows that repeat an id are all
candidates, none of them for a query of that id (the SQL joins by id alike), and an id queries once, with the row that
comes first in the index; ties go to the smaller id; fewer than k candidates give fewer rows; an empty
table gives an empty result; other columns are not read. Scores are exact as long as
they fit 63 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common

PIVOTS = 24
PIVOT_SAMPLE = 512
BLOCK = 2048
QUERY_BLOCK = 256
#: Query blocks that one task holds at most.
QUERY_GROUP = 64
#: Bytes of integers that a block, or a block of queries, holds at most (one vector at least), and that a shard is meant to hold.
BLOCK_BYTES = 1 << 20
SHARD_BYTES = 32 << 20
SLACK = 1e-9
_KEYED = "vec_id long, dim int, pivot int, dist double, ints binary"
_BLOCKS = "shard int, dim int, pivot int, lo double, hi double, norm double, n int, ids binary, ints binary"
_QUERIES = "dim int, ids binary, ints binary, taus binary, shards array<int>"


def _integers(column) -> list[np.ndarray]:
    """floor(1024 * x) of each list, as int64."""
    flat = np.floor(1024.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integer matrices; by BLAS where doubles hold every partial sum."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def choose_pivots(sample: list[np.ndarray], count: int = PIVOTS) -> dict[int, np.ndarray]:
    """Farthest-first pivots of each vector length in the sample."""
    out = {}
    for dim in {len(v) for v in sample}:
        x = np.array([v for v in sample if len(v) == dim], np.float64)
        picked, near = [0], np.full(len(x), np.inf)
        while len(picked) < min(count, len(x)):
            near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(1))
            if near.max() == 0:
                break
            picked.append(int(near.argmax()))
        out[dim] = x[picked]
    return out


def _pivots_of(pivots: dict, dim: int) -> np.ndarray:
    return pivots.get(dim, np.zeros((1, dim)))


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)))


def bounds(q: np.ndarray, p: np.ndarray, lo, hi, norm) -> np.ndarray:
    """For each query an upper bound on its score in an annulus [lo, hi] of pivot p."""
    q = q.astype(np.float64)
    size = np.sqrt((q**2).sum(1))
    far = _distances(q, p[None])[:, 0]
    gap = np.maximum(0, np.maximum(lo - far, far - hi) - SLACK * (far + hi))
    near = (size**2 + norm**2 - gap**2) / 2
    wide = q @ p + size * hi
    scale = size**2 + norm**2 + hi**2 + 1
    return np.minimum(near, wide) + SLACK * scale


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[-k]
        ids, scores = ids[keep], scores[keep]
    o = np.lexsort((ids, -scores))[:k]
    return ids[o], scores[o]


class TopK:
    """The index over one table of vectors, written to the shared folder."""

    def __init__(self, vectors: DataFrame):
        self.spark = vectors.sparkSession
        good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
            F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        )
        sample = good.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(PIVOT_SAMPLE).select("embedding").collect()
        self.pivots = pivots = choose_pivots([np.floor(1024.0 * np.array(r.embedding, np.float64)) for r in sample])

        def key(batches):
            for b in batches:
                vectors = _integers(b.column("embedding"))
                pivot, dist = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
                dims = np.array([len(v) for v in vectors], np.int32)
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    d = _distances(np.array([vectors[i] for i in at]).reshape(len(at), dim), _pivots_of(pivots, dim))
                    pivot[at] = d.argmin(1)
                    dist[at] = d.min(1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(dims), pa.array(pivot), pa.array(dist), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["vec_id", "dim", "pivot", "dist", "ints"])

        def block(batches):
            held = None
            for b in [*batches, None]:
                if b is not None:
                    now = pa.Table.from_batches([b])
                    held = now if held is None else pa.concat_tables([held, now])
                if held is None:
                    return
                kind = held["dim"].to_numpy().astype(np.int64) << 32 | held["pivot"].to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), held.num_rows]
                done = 0
                for a, z in zip(edges[:-1], edges[1:]):
                    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * held["dim"][a].as_py() + 1)))
                    for s in range(a, z, most):
                        e = min(s + most, z)
                        if b is not None and e == held.num_rows:
                            break
                        part = held.slice(s, e - s)
                        raw = b"".join(part["ints"].to_pylist())
                        x = np.frombuffer(raw, np.int64).reshape(e - s, -1).astype(np.float64)
                        dist = part["dist"].to_numpy()
                        yield pa.RecordBatch.from_pydict({
                            "shard": pa.array([part["shard"][0].as_py()], pa.int32()), "dim": pa.array([part["dim"][0].as_py()], pa.int32()), "pivot": pa.array([part["pivot"][0].as_py()], pa.int32()),
                            "lo": [float(dist.min())], "hi": [float(dist.max())], "norm": [float(np.sqrt((x**2).sum(1).max()) if x.size else 0.0)], "n": pa.array([e - s], pa.int32()),
                            "ids": [part["vec_id"].to_numpy().astype(np.int64).tobytes()], "ints": [raw],
                        })
                        done = e
                held = held.slice(done)

        keyed = good.mapInArrow(key, _KEYED)
        total = good.agg(F.sum(8 * F.size("embedding") + 16)).first()[0] or 0
        shards = max(common.parts(self.spark), -(-total // SHARD_BYTES))
        dealt = keyed.repartitionByRange(shards, "dim", "pivot", "dist", "vec_id").sortWithinPartitions("dim", "pivot", "dist", "vec_id", "ints")
        self.blocks = common.written(dealt.select("*", F.spark_partition_id().alias("shard")).mapInArrow(block, _BLOCKS))

    def meetings(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Query blocks and index blocks by shard and group of queries.

        A group is a run of QUERY_GROUP query blocks in index order, which lie near each other; an index block goes
        to the groups that ask for its shard and to no others.
        """
        task = F.shiftright("number", 33)
        counts = asked.groupBy(task.alias("task")).count().orderBy("task").collect()  # a row a task
        ends = np.cumsum([0, *(r["count"] for r in counts)]).tolist()
        begins = self.spark.createDataFrame([(r.task, n) for r, n in zip(counts, ends)], "task long, begin long")
        own = asked.withColumn("task", task).join(F.broadcast(begins), "task")
        part = F.floor((F.col("begin") + F.col("number") - F.shiftleft("task", 33)) / QUERY_GROUP)
        left = own.select(F.explode("shards").alias("shard"), part.alias("part"), "number", "dim", "ids", "ints", "taus")
        right = self.blocks.join(left.select("shard", "part").distinct(), "shard")
        return left, right.select("shard", (F.col("part") + 0).alias("part"), "dim", "pivot", "lo", "hi", "norm", "n", "ids", "ints")

    def search(self, every: int, k: int = 10) -> DataFrame:
        """query_id, rank, vec_id, score: the k best of each vector whose id is divisible by every."""
        pivots = self.pivots
        # one interval per shard and pivot: at most partitions + pivots rows
        plan = self.blocks.groupBy("shard", "dim", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("norm").alias("norm")).collect()
        intervals = sorted((r.dim, r.shard, r.pivot, r.lo, r.hi, r.norm) for r in plan)

        def queries(batches):
            """Blocks of queries of one pivot, filled across index blocks."""
            held, kind = [], None

            def flush():
                ids, x, taus = (np.concatenate([h[k] for h in held]) for k in range(3))
                dim = kind[0]
                shards = {s for own, s, p, lo, hi, norm in intervals if own == dim and (bounds(x, _pivots_of(pivots, dim)[p], lo, hi, norm) >= taus).any()}
                held.clear()
                return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": [ids.tobytes()], "ints": [x.tobytes()], "taus": [taus.astype(np.int64).tobytes()], "shards": pa.array([sorted(shards)], pa.list_(pa.int32()))})

            for r in (row for b in batches for row in b.to_pylist()):
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ints"], np.int64).reshape(r["n"], -1)
                mine, most = np.flatnonzero(ids % every == 0), max(1, min(QUERY_BLOCK, BLOCK_BYTES // (8 * r["dim"] + 1)))
                for a in range(0, len(mine), most):
                    at = mine[a : a + most]
                    scores = products(x[at], x)
                    scores[ids[at][:, None] == ids] = np.iinfo(np.int64).min
                    taus = np.partition(scores, len(ids) - k, 1)[:, -k] if len(ids) > k else np.full(len(at), np.iinfo(np.int64).min)
                    if held and (kind != (r["dim"], r["pivot"]) or sum(len(h[0]) for h in held) + len(at) > most):
                        yield flush()
                    kind = r["dim"], r["pivot"]
                    held.append((ids[at], x[at], taus))
            if held:
                yield flush()

        asked = common.written(self.blocks.mapInArrow(queries, _QUERIES).withColumn("number", F.monotonically_increasing_id()))
        left, right = self.meetings(asked)

        def meet(q, x):
            rows = x.drop_columns(["ids", "ints"]).to_pylist()
            for i, a in enumerate(rows):  # vectors stay where they are
                a["ids"] = np.frombuffer(x["ids"][i].as_buffer(), np.int64)
                a["ints"] = np.frombuffer(x["ints"][i].as_buffer(), np.int64).reshape(a["n"], -1)
            out_q, out_i, out_s, out_k = [], [], [], []
            for r in q.to_pylist():
                ids, taus = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["taus"], np.int64).copy()
                v = np.frombuffer(r["ints"], np.int64).reshape(len(ids), -1)
                found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
                annuli = [(bounds(v, _pivots_of(pivots, a["dim"])[a["pivot"]], a["lo"], a["hi"], a["norm"]), a) for a in rows if a["dim"] == r["dim"]]
                for bound, a in sorted(annuli, key=lambda t: -float(t[0].max())):
                    live = np.flatnonzero(bound >= taus)
                    if not len(live):
                        continue
                    scores = products(v[live], a["ints"])
                    hits = (scores >= taus[live][:, None]) & (a["ids"] != ids[live][:, None])
                    for j in np.flatnonzero(hits.any(1)).tolist():
                        i = live[j]
                        found[i] = best(np.r_[found[i][0], a["ids"][hits[j]]], np.r_[found[i][1], scores[j][hits[j]]], k)
                        if len(found[i][0]) == k:
                            taus[i] = max(taus[i], found[i][1][-1])
                for i, (vec, score) in enumerate(found):
                    out_q.append(np.full(len(vec), ids[i]))
                    out_i.append(vec)
                    out_s.append(score)
                    out_k.append(np.full(len(vec), r["number"] * (QUERY_BLOCK + 1) + i))
            join = lambda p: pa.array(np.concatenate(p).astype(np.int64) if p else np.zeros(0, np.int64))
            return pa.Table.from_arrays([join(out_q), join(out_i), join(out_s), join(out_k)], names=["query_id", "vec_id", "score", "row"])

        met = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(meet, "query_id long, vec_id long, score long, row long")
        one = Window.partitionBy("query_id")
        order = one.orderBy(F.desc("score"), "vec_id")
        return met.withColumn("first", F.min("row").over(one)).where("row = first").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    return TopK(common.table(spark, sf_dir, "embeddings")).search(every=100, k=10)


ORACLE = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
        FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 10"""
