import json
import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing, schedule
from millrace.operators import batches, bpe, metrics, mixing
from millrace.operators.ordering import prefix_budget, running
from millrace.sources import corpus, files
from millrace.streaming import discovery


def test_running_sums_over_partitions(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("k"), (F.col("id") % 3).alias("g"), (F.col("id") % 5).alias("v"))
    got = running(df, ["k"], F.col("v"), by=["g"], partitions=7).collect()
    for g in range(3):
        total = 0
        for i, r in enumerate(sorted((r for r in got if r.g == g), key=lambda r: r.k)):
            assert (r["rank"], r.before) == (i, total)
            total += r.v
    rows = prefix_budget(spark.createDataFrame([(1, 5), (2, 4), (3, 3), (4, 0)], "i int, n int"), ["i"], F.col("n"), 10).collect()
    assert sorted(r.i for r in rows) == [1, 2]


@pytest.mark.parametrize("n,val,seed", [(6, 2, 3), (50, 20, 47), (3, 9, 5), (1, 1, 0)])
def test_split_and_permutation(spark, n, val, seed):
    docs = spark.range(n).select(F.lit("c").alias("corpus"), F.col("id").alias("doc_id"), F.lit(5).cast("long").alias("n_tokens"))
    rows = mixing.split(docs, [{"name": "c", "weight": 1}], ["doc_id"], val, seed).collect()
    v = min(val, n - 1)
    assert {r.doc_id for r in rows if r.is_val} == {(seed % n + i) % n for i in range(v)}
    t = n - v
    m = mixing.multiplier(t, seed)
    order = [r.train_rank for r in sorted((r for r in rows if not r.is_val), key=lambda r: r.position)]
    assert order == [(m * c + seed % t) % t for c in range(t)] and math.gcd(m, t) == 1


def test_packed_batches_cover_every_prediction(spark):
    docs = spark.createDataFrame([("a", i, 3 + i % 40) for i in range(60)] + [("b", 100 + i, 90) for i in range(10)], "corpus string, doc_id long, n_tokens long")
    plan = [{"name": "a", "weight": 1}, {"name": "b", "weight": 1}]
    train = mixing.split(docs, plan, ["doc_id"], 0, 7)
    parts = mixing.pieces(train, 32)
    rows = mixing.packed(mixing.tagged(parts, plan), 128).collect()
    by, seen = {}, set()
    for r in rows:
        by.setdefault(r.microbatch, []).append((r.slot, r.predictions))
        own = {(r.doc_id, r.offset + i) for i in range(r.predictions)}
        assert not own & seen and r.predictions <= 32
        seen |= own
    for cells in by.values():
        at = 0
        for slot, k in sorted(cells):
            assert slot == at
            at += k
        assert at == 128
    exact = mixing.pack_exact(train, plan, 128, 32).collect()
    first = {c: sum(r.predictions for r in exact if r.corpus == c and r.microbatch == 0) for c in "ab"}
    assert abs(first["a"] - first["b"]) <= 32


def plain_queue(rows, plan, budget, longest, given=None, heads=None):
    """One fold over all documents: the corpus that has given least by its weight gives its next piece, ties to the earlier one."""
    scale, names = mixing.integer_weights(plan), [c["name"] for c in plan]
    queues = {c: [(d, n) for _, d, n in sorted((p, d, n) for k, d, n, p in rows if k == c and n >= 2)] for c in names}
    at, given, heads, out, total = dict.fromkeys(names, 0), dict.fromkeys(names, 0) | (given or {}), dict.fromkeys(names, 0) | (heads or {}), [], 0
    for c, used in given.items():
        while queues[c] and used >= queues[c][0][1] - 1:
            used -= queues[c].pop(0)[1] - 1
        at[c] = used
    while any(queues.values()):
        c = min((k for k in names if queues[k]), key=lambda k: (heads[k] + given[k] * scale[k], names.index(k)))
        doc, n = queues[c][0]
        k = min(longest, budget - total % budget, n - 1 - at[c])
        out.append((c, doc, at[c], k, total // budget, total % budget))
        given[c], total, at[c] = given[c] + k, total + k, at[c] + k
        if at[c] == n - 1:
            queues[c].pop(0)
            at[c] = 0
    return sorted(r for r in out if r[4] < total // budget)


@pytest.mark.parametrize("chunk,warm", [(300, 0), (300, 100), (2000, None), (1 << 22, None)])
def test_queue_in_stretches_is_the_queue(spark, chunk, warm):
    import random

    rng = random.Random(chunk)
    plan = [{"name": "a", "weight": 0.5}, {"name": "b", "weight": 0.3}, {"name": "c", "weight": 1.7}, {"name": "none", "weight": 1}]
    rows = [("a", i, rng.choice([0, 1, 2, 5, 40]), i) for i in range(300)] + [("b", 1000 + i, rng.randint(2, 300), 50 - i) for i in range(30)] + [("c", 2000, 3000, 0), ("c", 2001, 7, 1)]
    df = spark.createDataFrame(rows, "corpus string, doc_id long, n_tokens long, position long")
    got = sorted(tuple(r) for r in mixing.pack_exact(df, plan, 128, 32, chunk, warm).collect())
    assert got == plain_queue(rows, plan, 128, 32)
    assert mixing.pack_exact(df.limit(0), plan, 128, 32, chunk, warm).count() == 0
    # after five batches were handed over: the same batches again, or others of another size with a corpus that came late
    state = {c: sum(r[3] for r in got if r[0] == c and r[4] < 5) for c in "abc"}
    on = lambda df, plan, budget, **how: sorted(tuple(r) for r in mixing.pack_exact(df, plan, budget, 32, chunk, warm, given=state, **how).collect())
    assert on(df, plan, 128) == sorted((*r[:4], r[4] - 5, r[5]) for r in got if r[4] >= 5)
    more = [*plan[:3], {"name": "none", "weight": 2.5}]
    rows += [("none", 5000 + i, 20 + i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "corpus string, doc_id long, n_tokens long, position long")
    scale = mixing.integer_weights(more)
    head = max(state[c] * scale[c] for c in "abc")
    assert on(df, more, 96, heads={"none": head}) == plain_queue(rows, more, 96, 32, state, {"none": head})


def test_masks_and_padding(spark):
    df = spark.createDataFrame([([("user", "hi"), ("assistant", "yé")],)], "m array<struct<role:string,content:string>>")
    x = df.select(batches.sft_messages(F.col("m")).alias("x")).first().x
    text = "<|user|>\nhi\n<|assistant|>\nyé\n".encode()
    assert x.ids == [*text, 256] and sum(x["mask"]) == len("yé\n".encode()) + 1
    flat = spark.range(1).select(batches.sft_flat(F.lit("p"), F.lit("r ")).alias("x")).first().x
    assert flat.ids == [*"<|user|>\np\n<|assistant|>\nr".encode(), 256] and flat["mask"].count(True) == 2
    pairs = spark.createDataFrame([(0, "long prompt " * 100, "response", 16), (1, "short", "response", 128)], "example long, p string, r string, w int")
    one = pairs.where("w = 16").select(batches.dpo_example(F.col("p"), F.col("r"), 16).alias("e")).first().e
    two = pairs.where("w = 128").select(batches.dpo_example(F.col("p"), F.col("r"), 128).alias("e")).first().e
    assert one is None and any(y != -100 for y in two.labels)


def test_metrics(spark):
    log = spark.createDataFrame([(0, 0, "p", 1.0), (0, 1, "p", 5.0), (1, 2, "p", 4.0), (1, 3, "q", None), (0, 4, "p", 5.0)], "run int, ord int, phase string, tokens double")
    assert sorted(r.ord for r in metrics.handed_over(log).collect()) == [0, 2, 3]
    assert sorted(r.ord for r in metrics.latest(log, "ord").collect()) == [0, 2, 3, 4]
    lr = spark.range(30).select(schedule.cosine_lr(F.col("id"), 20, 5, 1.0, 0.1).alias("x")).collect()
    assert abs(lr[4].x - 1) < 1e-12 and lr[25].x == 0.1 and abs(lr[5].x - 1) < 1e-12
    assert schedule.target_tokens(5, budget=10, price_per_hour=1, tokens_per_second=1) == 34200
    with pytest.raises(ValueError):
        schedule.target_tokens(5, budget=1)


def test_bpe_training(spark):
    df = spark.createDataFrame([("low low low lower newest newest",)], "text string")
    assert bpe.train(df, 2)[0] == ("6C", "6F")


def test_corpus_round_trip_and_refusals(spark, tmp_path):
    df = spark.createDataFrame([(0, [1, 2, 3], 3), (1, [4, 2], 2)], "doc_ord int, ids array<int>, n_tokens int")
    path = str(tmp_path / "c")
    meta = corpus.write_corpus(df, path, "c", 1000, "aa", 2)
    assert (meta["documents"], meta["tokens"]) == (2, 5) and corpus.write_corpus(df, path, "c", 1000, "aa", 2) == meta
    assert corpus.read_corpus(spark, path, 1000, "AA").count() == 2
    with pytest.raises(ValueError, match="fingerprint mismatch"):
        corpus.read_corpus(spark, path, 1000, "bb")
    with pytest.raises(ValueError, match="fresh"):
        corpus.write_corpus(df.limit(1), path, "c", 1000, "aa", 2)
    with pytest.raises(ValueError, match="no corpus.json"):
        corpus.read_corpus(spark, str(tmp_path / "none"))
    assert [c["path"] for c in discovery.complete_corpora(str(tmp_path), set())] == [str((tmp_path / "c").resolve())]
    marker = tmp_path / "c" / "corpus.json"
    marker.write_text(json.dumps(meta | {"complete": False}))
    with pytest.raises(ValueError, match="not marked complete"):
        corpus.read_corpus(spark, path)
    marker.write_text(json.dumps(meta | {"shard_files": [*meta["shard_files"], "x.parquet"], "shards": meta["shards"] + 1}))
    with pytest.raises(ValueError, match="shard set does not match"):
        corpus.read_corpus(spark, path)
    assert discovery.complete_corpora(str(tmp_path), {str((tmp_path / "c").resolve())}) == []


def test_reading_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'\xef\xbb\xbf{"text": "x"}\n\n{"loss": 1.5, "tokens": 3}\n')
    (tmp_path / "b.jsonl").write_bytes('{"text": "中文"}\n'.encode("gb18030"))
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n[1]\nnope\n')
    assert [files.encoding_of(str(tmp_path / x)) for x in ("a.jsonl", "b.jsonl")] == ["utf-8-sig", "gb18030"]
    paths = files.input_files(str(tmp_path), exclude=("bad*",))
    assert files.json_lines(spark, paths).count() == 3
    assert files.json_lines(spark, [str(tmp_path / "bad.jsonl")], strict=False).count() == 1
    with pytest.raises(Exception, match="not a JSON object"):
        files.json_lines(spark, [str(tmp_path / "bad.jsonl")]).select("record").collect()
    assert [r.loss for r in files.metric_log(spark, [str(tmp_path / "a.jsonl")], "train").orderBy("tokens").collect()] == [None, 1.5]
    (tmp_path / "m.yaml").write_text("files:\n  - a.jsonl\n  - path: b.jsonl\n")
    assert len(files.resolve(str(tmp_path / "m.yaml"))) == 2
    with pytest.raises(ValueError, match="twice"):
        files.mixture([{"name": "a"}, {"name": "a"}])
    assert hashing.canonical_digest({"b": 1, "a": 2}) == hashing.canonical_digest({"a": 2, "b": 1})


def test_samples(spark, tmp_path):
    from millrace.operators import sampling
    from millrace.sources import sinks

    df = spark.range(100).select((F.col("id") % 2).cast("string").alias("f"), F.col("id").alias("k"), F.col("id").cast("string").alias("text"))
    got = sampling.reservoir(df, "f", "k", 7, 3)
    rows = got.collect()
    for g in "01":
        mine = sorted((r for r in rows if r.f == g), key=lambda r: r.sample_ord)
        assert [(r.k - int(g)) // 2 for r in mine] == sampling.reservoir_ranks(50, 7, 3, g)
    assert len(set(sampling.val_positions(10, 20, 1))) == 9 and sampling.val_positions(5, 0, 1) == []
    sample = got.select("text", F.col("f").alias("source_file"), "sample_ord")
    stats = sample.groupBy("source_file").agg(F.count("*").alias("valid_documents"), F.lit(0).alias("invalid_records"), F.sum(F.octet_length("text")).alias("sample_bytes"))
    assert sinks.write_sample(sample, str(tmp_path / "s"), str(tmp_path / "m.json"), stats)["valid_documents"] == 14
    assert spark.read.json(str(tmp_path / "s")).count() == 14


def test_the_library_stands_without_its_optional_part():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "millrace"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), p


def test_packed_batches_of_the_whole_table(spark):
    import hashlib

    from millrace.plans import mixing_queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: [*r.text.encode(), 256] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    cells = {}
    for r in mixing_queries.pack_microbatches(spark, sf).collect():
        cells.setdefault(r.microbatch, []).append((r.slot, r.doc_id, r.offset, r.predictions))
    digest = lambda x: hashlib.sha256("".join(f"{i:03X}" for i in x).encode()).hexdigest()
    want = []
    for b, own in cells.items():
        x, y = ([i for _, d, a, k in sorted(own) for i in texts[d][a + s : a + s + k]] for s in (0, 1))
        places = ",".join(str(i) for *_, k in sorted(own) for i in range(k))
        want.append((b, len(x), digest(x), digest(y), hashlib.sha256(places.encode()).hexdigest()))
    got = mixing_queries.packed_batches(spark, sf).collect()
    assert len(want) > 8 and sorted(map(tuple, got)) == sorted(want)


def test_bpe_pairs_of_all_pre_tokens(spark, tmp_path):
    from collections import Counter

    import regex

    from millrace.plans import metric_queries

    texts = ["Größe: 12 Äpfel, ça coûte 3,50 €!", "¿Qué  tal?\n\nit's 2024", "Größe"]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for t in texts:
        for w in regex.findall(bpe.PATTERN.removeprefix("(?U)"), t):
            raw = w.encode()
            want.update((f"{a:02X}", f"{b:02X}") for a, b in zip(raw, raw[1:]))
    assert {(r.a, r.b): r["count"] for r in metric_queries.bpe_pair_counts_bytes(spark, str(tmp_path)).collect()} == want
