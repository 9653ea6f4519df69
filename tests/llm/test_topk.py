import numpy as np

from millrace.llm import topk


def brute(rows, every, k):
    good = [(i, np.floor(1024.0 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    out = []
    for q, a in good:
        if q % every == 0:
            found = sorted((-int(a @ b), i) for i, b in good if i != q and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 8).tolist()) for i in range(600)]
    rows += [(600 + i, [0.5] * 8) for i in range(300)]  # one very common vector
    rows += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (3000, [1.0, 2.0]), (3001, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.TopK(df).search(20, 10).collect())
    assert got == brute(rows, 20, 10)


def test_few_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (1, [0.5, 0.5], 2)], "vec_id long, embedding array<double>, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.TopK(df).search(20, 10).collect())
    assert got == [(0, 1, 1, 1024 * 512), (0, 2, 1, 1024 * 512)]
    assert topk.TopK(df.limit(0)).search(20).count() == 0


def test_index_blocks_go_only_where_bounds_admit(spark, monkeypatch):
    """Clusters that are far apart: the exchanged index rows are those of the admitted (shard, group) pairs."""
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_GROUP", 1)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(5)
    centres = np.eye(8) * 40
    df = spark.createDataFrame([(i, (centres[i % 8] + rng.normal(0, 0.1, 8)).tolist()) for i in range(1600)], "vec_id long, embedding array<double>")
    index, seen, own = topk.TopK(df), [], topk.TopK.meetings

    def meetings(self, asked):
        left, right = own(self, asked)
        pairs = {(r.shard, r.part) for r in left.select("shard", "part").collect()}
        per_shard = {r.shard: r["count"] for r in self.blocks.groupBy("shard").count().collect()}
        seen.append((right.count(), sum(per_shard[s] for s, _ in pairs), sum(per_shard.values()) * len({p for _, p in pairs})))
        return left, right

    monkeypatch.setattr(topk.TopK, "meetings", meetings)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in index.search(20, 10).collect())
    assert got == brute(rows, 20, 10)
    moved, admitted, every = seen[0]
    assert moved == admitted < every


def test_wide_vectors_stay_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(topk, "SHARD_BYTES", 1 << 16)
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, rng.normal(0, 1, 768).tolist()) for i in range(120)], "vec_id long, embedding array<double>")
    index = topk.TopK(df)
    assert max(len(r.ints) for r in index.blocks.collect()) <= 1 << 14
    assert max(r["count"] for r in index.blocks.groupBy("shard").count().collect()) * (1 << 14) <= 4 << 16
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in index.search(20, 10).collect()) == brute([(r.vec_id, r.embedding) for r in df.collect()], 20, 10)
