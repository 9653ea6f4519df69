import hashlib
import random

import pytest

from millrace.llm import suffix

L = suffix.LENGTH


def brute(rows):
    """Removed bytes by looking every window up in the order of the documents."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - L + 1):
            w = raw[i : i + L]
            if w in seen:
                gone[i : i + L] = b"\1" * L
            seen.add(w)
        runs = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.setdefault(doc_id, []).append((len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(got, rows):
    want = brute(rows)
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(suffix.op1(spark, sf).collect(), rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_made_repeats(spark, seed, monkeypatch):
    rng = random.Random(seed)
    if seed > 1:
        monkeypatch.setattr(suffix, "BATCH_BYTES", 3000)
        monkeypatch.setattr(suffix, "LOCAL_PHRASES", 2)
    if seed == 3:
        monkeypatch.setattr(suffix, "INDEX_PHRASES", 1)
        monkeypatch.setattr(suffix, "STRETCH", 900)
        suffix._CACHE.clear()
    word = lambda: "".join(rng.choices("abcdé ", k=rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40) for _ in range(6)] + ["ab" * 200, "x" * 500, "abcdefg" * 60]
    rows = []
    for i in range(120):
        t = text(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            t += rng.choice([p, p[a:], p[:a], p[:a] + "#" + p[a:]]) + text(rng.randrange(3))
        rows.append((i * 7 % 120, t))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (300, passages[0] + text(4) + passages[0]), (301, None), (302, ""), (303, "a" * 99), (304, "q" * 100), (305, "q" * 101)]
    check(suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), rows)
    suffix._CACHE.clear()


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, "z" * 300, 1), (1, "z" * 300, 2), (None, "z" * 300, 3)], "doc_id long, text string, uid int").coalesce(1)
    assert sorted(r.n_removed for r in suffix.remove_repeats(df).collect()) == [299, 300, 300]
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_one_file_read_by_several_tasks(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passages = [text(150) for _ in range(20)]
    rows = [(i, text(300) + rng.choice(passages) + text(50)) for i in range(1200)]
    hadoop, size = spark.sparkContext._jsc.hadoopConfiguration(), spark.conf.get("spark.sql.files.maxPartitionBytes")
    hadoop.setInt("parquet.block.size", 50_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert suffix.common.written(docs).rdd.getNumPartitions() > 2
        check(suffix.remove_repeats(docs).collect(), rows)
    finally:
        hadoop.unset("parquet.block.size")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.mark.parametrize("index", [20_000, 1])
def test_null_and_large_ids_at_branching_anchors(spark, monkeypatch, index):
    monkeypatch.setattr(suffix, "INDEX_PHRASES", index)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, f"{word()} {passage[rng.randrange(40):-rng.randrange(1, 40)]} {word()}") for i in [None, 5, 9, 2**60 + 1, 2**60, 2**53 + 1, 2**53, 2**62]]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    check(suffix.remove_repeats(df).collect(), rows)
