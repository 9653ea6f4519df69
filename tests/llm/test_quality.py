import numpy as np
import pytest

from millrace.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in quality.op4(spark, SF).collect()}


def test_held_out_accuracy(spark, scored):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in scored.values() if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id] for r in held])
    s = np.array([r.score for r in held])
    auc = (s[y == 1][:, None] > s[y == 0]).mean()
    assert auc > 0.97 and ((s >= 0.3) == y).mean() > 0.95


def test_every_row_is_scored_once(spark, scored):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(scored) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored.values())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "x" * 100_000, 2)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, None), (9, 0), (2, 5)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).count() == 4
    assert quality.score(docs.limit(0), model).count() == 0
    kept = quality.keep_good(docs, (np.zeros(quality.BUCKETS, np.float32), -5.0))
    assert kept.columns == docs.columns and kept.count() == 0
    assert quality.fit(docs, labels.limit(0))[1] == 0.0


def test_repetition_marks():
    assert quality.tokens("a a a\nb c\nb c") == ["a", quality._SAME, quality._SAME, "b", "c", quality._LINE]


def test_scores_against_buckets(spark):
    """A plain scorer: the mean weight of the buckets of all tokens, through the logistic function."""
    rng = np.random.default_rng(5)
    weights, bias = rng.normal(0, 3, quality.BUCKETS).astype(np.float32), 0.25
    rows = [(i, r.text) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect())] + [(1000, None), (1001, ""), (1002, "a a\nb c\nb c"), (1003, "é\u4e2d " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(df, (weights, bias)).collect()}
    for i, text in rows:
        own = [b for t in quality.tokens(text or "") for b in quality.buckets(t)]
        z = bias + (float(weights[own].astype(np.float64).mean()) if own else 0.0)
        want = 1 / (1 + np.exp(-z))
        assert got[i][0] == pytest.approx(want, abs=1e-9) and got[i][1] == (got[i][0] >= quality.THRESHOLD)
    kept = {r.doc_id for r in quality.keep_good(df, (weights, bias)).collect()}
    assert kept == {i for i, (s, p) in got.items() if p}


def test_training_against_plain_steps():
    """A plain softmax over averaged vectors, one row at a time in each step's sums, gives the trainer's weights."""
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(2)), np.unique(rng.integers(0, 50, 12)).astype(np.int32)) for _ in range(40)]
    rows = [(y, b, rng.integers(1, 4, len(b)).astype(np.float32)) for y, b in rows]
    weights, bias = quality.train(rows, epochs=2, rate=1.0, seed=3)
    rng = np.random.default_rng(3)
    vectors = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (quality.BUCKETS, quality.DIM)).astype(np.float32).astype(np.float64)
    layer, biases = rng.normal(0, 0.5, (quality.DIM, 2)).astype(np.float32).astype(np.float64), np.zeros(2)
    step = 0
    for _ in range(2):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), 16):
            part, now = [rows[i] for i in order[a : a + 16]], 1 - step / 6
            step += 1
            d_layer, d_bias, d_vectors = np.zeros_like(layer), np.zeros(2), {}
            for y, ids, n in part:
                share = n / n.sum()
                mean = sum(s * vectors[b] for s, b in zip(share, ids))
                e = np.exp(mean @ layer + biases)
                error = (e / e.sum() - np.eye(2)[y]) / len(part)
                d_layer += np.outer(mean, error)
                d_bias += error
                for s, b in zip(share, ids):
                    d_vectors[b] = d_vectors.get(b, 0) + s * (layer @ error)
            layer, biases = layer - now * 0.25 * d_layer, biases - now * 0.05 * d_bias
            for b, g in d_vectors.items():
                vectors[b] -= now * 16 * g
    assert np.allclose(weights, vectors @ (layer[:, 1] - layer[:, 0]), atol=1e-3) and bias == pytest.approx(biases[1] - biases[0], abs=1e-4)
