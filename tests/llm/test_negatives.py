import numpy as np

from millrace.llm import negatives


def brute(rows, every=20, low=80):
    """rows: id, label, vector, in any order; equal ids are rows of their own."""
    good = [(i, c, np.floor(256.0 * np.array(v, np.float64)).astype(np.int64)) for i, c, v in rows if i is not None and c is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    out = []
    for n, (a, label, x) in enumerate(good):
        if a % every:
            continue
        scored = [(-int(x @ y), i, c) for m, (i, c, y) in enumerate(good) if m != n and len(y) == len(x)]
        for s, p, _ in sorted(t for t in scored if t[2] == label)[:5]:
            inside = sorted((t, i) for t, i, c in scored if c != label and low * -s <= 100 * -t <= 100 * -s)[:5]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(inside)]
    return sorted(out)


def found(df, every=20):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in negatives.NormIndex(df).mine(every, 80).collect())


SCHEMA = "vec_id long, label int, embedding array<float>"


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BUCKET", 32)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    monkeypatch.setattr(negatives, "GROUP", 2)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(4)), (rng.normal(0, 1, 6) * rng.choice([0.01, 1, 5])).tolist()) for i in range(500)]
    rows += [(500 + i, i % 2, [0.5] * 6) for i in range(200)]  # one very common vector
    rows += [(2000, 1, None), (2020, None, [1.0] * 6), (2040, 1, [None] * 6), (2060, 1, [float("nan")] * 6), (2080, 1, [float("inf")] + [0.0] * 5), (None, 1, [1.0] * 6)]
    rows += [(3000, 1, [1.0, 2.0]), (3001, 1, [0.5, 0.5]), (3002, 2, [0.45, 0.5]), (4000, 1, []), (4001, 2, []), (5000, 0, [0.0] * 6), (6000, 3, [-9.0] * 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    rows = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    assert found(df) == brute(rows)


def test_small_norms_are_not_sent(spark, monkeypatch):
    """Most vectors are far too short for any window: their buckets meet no group."""
    monkeypatch.setattr(negatives, "BUCKET", 16)
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, (rng.normal(0, 1, 8) * (10 if i % 20 == 0 else 1e-2)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    sent, own = [], negatives.NormIndex.meetings

    def meetings(self, asked):
        left, right = own(self, asked)
        sent.append((right.count(), self.buckets.count() * left.select("part").distinct().count()))
        return left, right

    monkeypatch.setattr(negatives.NormIndex, "meetings", meetings)
    assert found(df) == brute([(r.vec_id, r.label, r.embedding) for r in df.collect()])
    assert sent[1][0] < sent[1][1] / 2


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 2, [0.9, 0.1]), (1, 2, [0.9, 0.1]), (2, 2, [0.1, 0.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", score int")
    assert found(df) == brute(rows)
    assert found(df.limit(0)) == []


def test_no_window_for_negative_scores(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 2, [-0.9, 0.0]), (3, 2, [0.0, 1.0])]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows) == []


def test_wide_vectors_stay_in_bounded_buckets(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BUCKET_BYTES", 1 << 14)
    monkeypatch.setattr(negatives, "SHARD_BYTES", 1 << 16)
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, i % 2, rng.normal(0, 1, 768).tolist()) for i in range(120)], SCHEMA)
    index = negatives.NormIndex(df)
    assert max(len(r.ints) for r in index.buckets.collect()) <= 1 << 14
    assert max(r["count"] for r in index.buckets.groupBy("shard").count().collect()) * (1 << 14) <= 4 << 16
    assert found(df) == brute([(r.vec_id, r.label, r.embedding) for r in df.collect()])
