import hashlib
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing
from millrace.operators import batches, bpe, metrics, mixing, ordering, sampling
from millrace.sources import cached, config, corpus, files, shards, storage
from millrace.streaming import discovery


def test_blank_lines_and_errors_with_line_numbers(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text('{"text": "x"}\n\t\n　\n\n {"text": "y"} \n', encoding="utf-8")
    b.write_text('﻿{"text": "z"}\n[1]\n{"text": ""}\n', encoding="utf-8")
    assert files.json_lines(spark, [str(a)]).count() == 2
    files.bad_line(spark, [str(a)])
    with pytest.raises(ValueError, match=r"b\.jsonl:2: "):
        files.bad_line(spark, [str(a), str(b)])
    with pytest.raises(Exception, match="not a JSON object"):
        files.json_lines(spark, [str(b)]).collect()
    counts = {r.file.rsplit("/", 1)[1]: (r.valid, r.invalid) for r in files.record_counts(spark, [str(a), str(b)]).collect()}
    assert counts == {"a.jsonl": (2, 0), "b.jsonl": (1, 2)}
    text = lambda n: [r.line for r in files.json_lines(spark, [str(a), str(b)], strict=False, max_records=n).collect()]
    assert text(1) == ['{"text": "x"}'] and len(text(3)) == 3 and len(text(4)) == 3  # the fourth is read, but no record


def test_gb18030_is_split_and_decoded(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_bytes("".join(f'{{"text": "汉字{i}㐀"}}\r\n' for i in range(3000)).encode("gb18030"))
    assert files.encoding_of(str(p)) == "gb18030"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = files.json_lines(spark, [str(p)]).select(F.try_variant_get("record", "$.text", "string").alias("t")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.t for r in got) == sorted(f"汉字{i}㐀" for i in range(3000))


def test_wide_encodings_are_read_whole(spark, tmp_path):
    for name in ("utf-16", "utf-32", "utf-8-sig", "gb18030"):
        (tmp_path / f"{name}.jsonl").write_bytes("".join(f'{{"text": "汉字 ä {i}"}}\n' for i in range(50)).encode(name))
    paths = files.input_files(str(tmp_path))
    assert [files.encoding_of(p) for p in paths] == ["gb18030", "utf-16", "utf-32", "utf-8-sig"]
    got = files.json_lines(spark, paths).select(F.try_variant_get("record", "$.text", "string").alias("t")).collect()
    assert sorted(r.t for r in got) == sorted([f"汉字 ä {i}" for i in range(50)] * 4)


def test_sampler_needs_files(spark, tmp_path):
    with pytest.raises(ValueError, match="no JSON-lines files"):
        files.sample_files(str(tmp_path))


def test_manifest_with_relative_paths(tmp_path):
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"val_docs_per_corpus": 5, "corpora": [{"path": "one", "weight": 2}, {"name": "b", "path": "/abs/two", "val_docs": 3}]}))
    got = config.read_mixture(str(m), 7)
    assert [(c["name"], c["path"], c["weight"], c["val_docs"], c["seed"]) for c in got] == [("one", str(tmp_path / "one"), 2, 5, 7), ("b", "/abs/two", 1.0, 3, 1016)]
    m.write_text("{}")
    with pytest.raises(ValueError, match="no corpora"):
        config.read_mixture(str(m), 7)
    running = [{"name": "a", "path": "/a"}]
    assert config.merge_mixture(running, [{"name": "a", "path": "/a"}, {"name": "c", "path": "/c"}]) == [*running, {"name": "c", "path": "/c"}]
    for bad in ({"name": "a", "path": "/other"}, {"name": "x", "path": "/a"}):
        with pytest.raises(ValueError):
            config.merge_mixture(running, [bad])


def test_configuration_checks(tmp_path):
    y = tmp_path / "c.json"
    y.write_text('{"project": {"out": "o"}, "smoke": {"out": "s"}}')
    c = config.load_config(str(y))
    assert config.settings(c) == {"project": {"out": "o"}, "project.out": "o", "smoke": {"out": "s"}, "smoke.out": "s"}
    assert (config.project_file(c, "out", "d"), config.project_file(c, "out", "d", smoke=True), config.project_file(c, "z", "d")) == ("o", "s", "d")
    with pytest.raises(ValueError, match="smoke"):
        config.check_keys(c, {"project"})
    shape = dict.fromkeys(config.SIZES, 4) | {"n_head": 4, "n_kv_head": 2, "n_embd": 32, "expert_hidden_size": 16, "shared_expert_hidden_size": 48}
    config.check_model(shape)
    for change, told in (
        ({"n_embd": 7}, "multiple of n_head"), ({"n_kv_head": 3}, "multiple of n_kv_head"), ({"top_k": 2}, "top_k"), ({"dropout": 1.0}, "dropout"), ({"n_layer": 0}, "n_layer"), ({"n_head": 32, "n_kv_head": 1}, "even"), ({"n_expert": None}, "n_expert"),
        ({"expert_hidden_size": 8}, "expert_hidden_size must be a multiple of 16"), ({"router_gemm_precision": "half"}, "float32, bfloat16"), ({"te_grouped_linear_backend": "x"}, "legacy, ops"), ({"linear_cross_entropy_backend": "x"}, "liger"), ({"linear_cross_entropy_chunk_size": 0}, "chunk_size"),
    ):
        with pytest.raises(ValueError, match=told):
            config.check_model(shape | change)
    config.check_special_ids({"<pad>": 0}, {"<pad>": 0})
    with pytest.raises(ValueError, match="<eos>"):
        config.check_special_ids({"<pad>": 0}, {"<pad>": 0, "<eos>": 2})


def test_keyed_tables(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(5)

    path = str(tmp_path / "t")
    assert [cached.keyed_table(spark, path, k, build, rows=5)[1] for k in ({"a": 1}, {"a": 1}, {"a": 2})] == [False, True, False]
    assert cached.keyed_table(spark, path, {"a": 2}, build, rows=6)[1] is False
    assert cached.keyed_table(spark, path, {"a": 2}, build, rebuild=True)[1] is False and len(made) == 4


def test_only_changed_tasks_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "task string, x int")
    path, asked = str(tmp_path / "out"), []

    def run(marks, **how):
        def encoded(names):
            asked.append(sorted(names))
            return rows.where(rows.task.isin(names) & (rows.x > 0)).selectExpr("task", f"x + {marks.get('add', 0)} AS x")

        tasks = [shards.Task(k, v) for k, v in marks.items() if k != "add"]
        return shards.write_tasks(spark, tasks, path, encoded, totals=("x",), **how)

    read = lambda: sorted(r.x for r in shards.read_tasks(spark, path).collect())
    folders = lambda: [n for n in storage.names_in(f"{path}/shards") if n.startswith("part=")]
    assert run({"a": "1", "b": "1"}) == 2 and read() == [1, 2, 3]
    assert run({"a": "1", "b": "1"}) == 0 and run({"a": "1", "b": "2", "add": 10}) == 1 and read() == [1, 2, 13]
    assert asked == [["a", "b"], ["b"]] and [e["totals"]["x"] for e in shards.task_rows(path)] == [3, 13]
    # a task that wrote rows and has none now, one that is gone, and one that comes in between
    assert run({"a": "1", "c": "1"}) == 1 and read() == [1, 2] and len(folders()) == 1
    assert run({"c": "1", "a": "1"}) == 0 and [e["task"] for e in shards.task_rows(path)] == ["c", "a"]
    # what a run that died has left is neither read nor kept
    rows.withColumnRenamed("task", "part").write.partitionBy("part").mode("append").parquet(f"{path}/shards")
    assert read() == [1, 2] and run({"a": "1"}) == 0 and len(folders()) == 1
    with pytest.raises(ValueError, match="rerun with --fresh"):
        run({"b": "1", "a": "1"}, in_place=True)
    assert run({"b": "1", "a": "1"}, in_place=True, fresh=True) == 2 and read() == [1, 2, 3]
    assert run({}) == 0 and read() == []


def test_waves_commit_one_by_one(spark, tmp_path):
    """A run that dies in its second wave leaves the first one for the next run."""
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "task string, x int")
    tasks, asked = [shards.Task(k, "1", 10) for k in "abc"], []

    def encoded(names, dies=False):
        asked.append(sorted(names))
        if dies and "b" in names:
            raise RuntimeError("lost")
        return rows.where(rows.task.isin(names))

    path = str(tmp_path / "out")
    with pytest.raises(RuntimeError):
        shards.write_tasks(spark, tasks, path, lambda names: encoded(names, True), wave_bytes=10)
    assert [r.x for r in shards.read_tasks(spark, path).collect()] == [1]
    assert shards.write_tasks(spark, tasks, path, encoded, wave_bytes=20) == 2 and asked == [["a"], ["b"], ["b", "c"]]
    assert sorted(r.x for r in shards.read_tasks(spark, path).collect()) == [1, 2, 3]


def test_build_scenarios(spark, tmp_path):
    """Fresh build, unchanged rerun, an earlier file, fresh again, a file less, refusals of the loader."""
    source, out = tmp_path / "in put", str(tmp_path / "out")
    source.mkdir()
    reads = []

    def put(name, *texts):
        (source / name).write_text("".join(json.dumps({"text": t}) + "\n" for t in texts))

    def encode(rows):
        reads.append(sorted({r.task.rpartition("/")[2] for r in rows.collect()}))
        ids = F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: i)
        return rows.select("task", ids.alias("ids"), F.length("text").alias("n_tokens"))

    build = lambda fresh=False: corpus.build_corpus(spark, files.listed(str(source)), out, encode, "c", 1000, "aa", 2, fresh)
    put("b.jsonl", "beta document", " ", "more")
    first = build(fresh=True)
    assert (first["documents"], first["tokens"], first["complete"]) == (2, 17, True)
    assert build() == first and reads == [["b.jsonl"]]
    put("a.jsonl", "alpha document")
    with pytest.raises(ValueError, match="rerun with --fresh"):
        build()
    assert build(fresh=True)["documents"] == 3 and corpus.read_corpus(spark, out, 1000, "aa").count() == 3
    (source / "b.jsonl").unlink()
    last = build()
    assert len(last["shard_files"]) == 1 and last["shard_files"][0].startswith("part=000000-") and corpus.read_corpus(spark, out).count() == 1 and len(reads) == 2
    spark.createDataFrame([("x", 1)], "text string, y int").coalesce(1).write.parquet(str(tmp_path / "p"))
    next((tmp_path / "p").glob("*.parquet")).rename(source / "c.parquet")
    assert build()["documents"] == 2 and reads[-1] == ["c.parquet"]
    marker = Path(out) / "corpus.json"
    kept = marker.read_text()
    for text, match in ((None, "no corpus.json"), (json.dumps(json.loads(kept) | {"complete": False}), "not marked complete")):
        marker.unlink() if text is None else marker.write_text(text)
        with pytest.raises(ValueError, match=match):
            corpus.read_corpus(spark, out)
    marker.write_text(kept)
    (Path(out) / "shards" / "part=999999-x").mkdir()
    with pytest.raises(ValueError, match="shard set does not match"):
        corpus.read_corpus(spark, out)
    (source / "d.jsonl.gz").write_bytes(b"")
    with pytest.raises(ValueError, match="gzip"):
        build()
    (source / "d.jsonl.gz").unlink()
    put("d.jsonl", "x")
    (source / "d.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        build()
    assert files.listed("file://" + str(source))[0].path == str(source / "a.jsonl") and files.input_files(str(tmp_path / "none")) == []


def test_first_lines_move_no_line(spark, tmp_path):
    lines = {"a": ["1", "", "2", "3"], "b": [], "c": [str(i) for i in range(4, 60)], "d": ["z"] * 5}
    for name, own in lines.items():
        (tmp_path / f"{name}.txt").write_text("\n".join(own) + "\n")
    (tmp_path / "bb.txt").write_bytes("é\n\nü\n".encode("utf-16"))
    order = ["1", "2", "3", "é", "ü", *lines["c"], *lines["d"]]
    paths = files.input_files(str(tmp_path), ("*.txt",))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16b")
    try:
        for n in (0, 1, 3, 4, 5, 6, 20, 61, 62, 66, 100):
            df = files.first_lines(spark, paths, n)
            assert sorted(r.line for r in df.collect()) == sorted(order[:n]), n
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tokenizer_file_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(1, "low lower lowest é 12 "), (2, "low low new"), (3, None), (4, " ")], "id int, text string")
    merges = bpe.train(docs, 6)
    path = str(tmp_path / "t.json")
    bpe.save(merges, ["<|pad|>", "<|eos|>"], path)
    own = Tokenizer.from_file(path)
    assert own.get_vocab_size() == 2 + 256 + len(merges) and own.decode(own.encode("low é<|eos|>x").ids, skip_special_tokens=False) == "low é<|eos|>x"
    assert own.encode("a<|eos|>").ids[-1] == bpe.token_id(path, "<|eos|>") == 1
    assert len(own.encode("low").ids) == 1
    with pytest.raises(ValueError, match="no token"):
        bpe.token_id(path, "<|no|>")
    assert bpe.token_id(path, "<|no|>", 7) == 7
    out = bpe.decode(bpe.encode(docs, path, 1), path, 1)
    assert {r.id: (r.decoded, r.ids[-1]) for r in out.collect()} == {1: ("low lower lowest é 12", 1), 2: ("low low new", 1)}
    qa = bpe.quality(bpe.encode(docs, path, 1), 3, ["id"]).where("id = 2").first()
    assert qa.unknown == 0 and 1 < qa.bytes_per_token <= 11


def test_file_digests_and_identities(spark, tmp_path):
    p = tmp_path / "f"
    p.write_bytes(b"abc")
    want = hashlib.sha256(b"abc").hexdigest()
    assert hashing.streamed_sha256(str(p)) == want == hashing.file_sha256(spark, [str(p)]).first().sha256
    key = hashing.cache_key("{}", "sft:2", [("f", 3, 1)])
    assert len(key) == 20 and key != hashing.cache_key("{}", "sft:2", [("f", 3, 2)])
    ids = [1, -100, 70000]
    row = spark.createDataFrame([(ids,)], "ids array<int>").select(hashing.id_bytes(F.col("ids")).alias("b")).first()
    assert bytes(row.b) == np.array(ids, "<i4").tobytes()
    one = hashing.run_identities([{"name": "a", "path": "/a"}], "AA", {"x": want}, {"s": 1})
    assert one == hashing.run_identities([{"path": "/a", "name": "a"}], "aa", {"x": want}, {"s": 1})
    with pytest.raises(ValueError, match="settings"):
        hashing.same_identity(one, hashing.run_identities([{"name": "a", "path": "/a"}], "aa", {"x": want}, {"s": 2}))


def test_shuffle_buffer_displaces_less_than_its_size(spark):
    df = spark.range(500).withColumnRenamed("id", "position").withColumn("key", F.col("position"))
    order = [r.position for r in sampling.shuffled(df, "position", "key", 16, 3).orderBy("out_order", "position").collect()]
    assert sorted(order) == list(range(500)) and order != list(range(500)) and max(abs(i - p) for i, p in enumerate(order)) < 16
    assert sampling.shuffled(df, "position", "key", 1, 3).where("out_order <> position").count() == 0


def test_preference_split_seed():
    assert sampling.val_positions(50, 5, 1, offset=0) == sorted(np.random.default_rng(1).choice(50, 5, replace=False).tolist())


def test_supervised_packing_against_a_queue(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 40, 60))]
    got = mixing.sft_packed(spark.createDataFrame(rows, "example int, n_tokens int"), ["example"], 32, 10).orderBy("microbatch", "slot").collect()
    want, batch, slot = [], 0, 0
    for i, n in rows:
        at = 0
        while at < n - 1:
            k = min(10, 32 - slot, n - 1 - at)
            want.append((batch, slot, i, at, k))
            at, slot = at + k, slot + k
            if slot == 32:
                batch, slot = batch + 1, 0
    assert [(r.microbatch, r.slot, r.example, r.offset, r.predictions) for r in got] == [w for w in want if w[0] < batch]


def test_validation_rounds(spark):
    val = spark.createDataFrame([("a", 1), ("a", 4), ("b", 3)], "corpus string, n_tokens int")
    assert mixing.rounds_for(val, 11) == 3
    with pytest.raises(ValueError, match="validation"):
        mixing.rounds_for(val.where("n_tokens < 2"), 11)


def test_shards_of_ranks(spark):
    got = ordering.shard_of(spark.range(-1, 8).withColumnRenamed("id", "rank"), [2, 0, 4]).orderBy("rank").collect()
    assert [(r.rank, r.shard, r.row) for r in got] == [(0, 0, 0), (1, 0, 1), (2, 2, 0), (3, 2, 1), (4, 2, 2), (5, 2, 3)]


def test_sequence_log_prob_and_sizes(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0], [-100, 5, 6])], "x array<double>, y array<int>")
    assert df.select(metrics.sequence_log_prob(F.col("x"), F.col("y")).alias("p")).first().p == -6.0
    shape = {"vocab_size": 32768, "n_layer": 28, "n_head": 8, "n_kv_head": 4, "n_embd": 1024, "n_expert": 8, "expert_hidden_size": 2240, "shared_expert_hidden_size": 416, "top_k": 1}
    got = metrics.parameter_counts(shape)
    assert (got["total"], got["active"]) == (1_699_111_936, 350_381_056)


def test_state_of_older_versions(tmp_path):
    p = tmp_path / "s.json"
    for old in ({"version": 2, "emitted": 3}, {"emitted": 3}):
        p.write_text(json.dumps(old))
        assert discovery.load_state(str(p)) == {"version": 4, "emitted": 3, "late": [], "handed_off": 0}
    p.write_text('{"version": 9}')
    with pytest.raises(ValueError, match="version 9"):
        discovery.load_state(str(p))
    discovery.check_state({"buffer": 8}, 8)
    with pytest.raises(ValueError, match="shuffle buffer"):
        discovery.check_state({"buffer": 8}, 16)


def test_watch_outlives_a_restart_and_stops_between_batches(spark, tmp_path):
    root, seen = tmp_path / "root", []
    for name in ("a", "b"):
        (root / name).mkdir(parents=True)
        (root / name / "corpus.json").write_text('{"complete": true}')
        query = discovery.watch(spark, str(root), lambda new: seen.extend(c["name"].split("-")[1] for c in new), seconds=0.3, checkpoint=str(tmp_path / "mark"))
        assert discovery.stop_when(query, 60, asked=lambda: len(seen) > (name == "b")) == "asked"
        assert not query.isActive
    assert seen == ["a", "b"]


def test_committed_batches_only(spark):
    df = spark.createDataFrame([(0, "a", 5), (1, "a", 3), (2, "b", 4)], "microbatch long, corpus string, predictions long")
    assert [(r.corpus, r.emitted) for r in mixing.committed(df, 2).collect()] == [("a", 8)]


def test_command_line(spark, tmp_path):
    from millrace.__main__ import main

    root = tmp_path / "in"
    root.mkdir()
    (root / "a.jsonl").write_text("".join(json.dumps({"text": f"some words and number {i}"}) + "\n" for i in range(30)))
    t = str(tmp_path / "t.json")
    assert main(["tokenizer", "--input", str(root), "--output", t, "--vocab-size", "266"])["vocab_size"] == 266
    with pytest.raises(ValueError, match="merges"):
        main(["tokenizer", "--input", str(root), "--output", t + "2", "--vocab-size", "400"])
    meta = main(["build", "--input", str(root), "--output", str(tmp_path / "out"), "--tokenizer", t, "--name", "x"])
    assert (meta["documents"], meta["vocab_size"], meta["complete"]) == (30, 266, True)
    (root / "b.jsonl").write_text("broken\n")
    for command in (["tokenizer", "--vocab-size", "266", "--output", t + "3"], ["build", "--output", str(tmp_path / "out"), "--tokenizer", t, "--name", "x"]):
        with pytest.raises(Exception, match="not a JSON object"):
            main([command[0], "--input", str(root), *command[1:]])
    assert main(["build", "--input", str(root), "--exclude", "b.*", "--output", str(tmp_path / "out"), "--tokenizer", t, "--name", "x"])["documents"] == 30
    totals = main(["sample", "--input", str(root), "--output", str(tmp_path / "s"), "--manifest", str(tmp_path / "m.json"), "--samples-per-file", "4"])
    assert (totals["valid_documents"], totals["invalid_records"]) == (30, 1)
    assert spark.read.json(str(tmp_path / "s")).count() == 4
    (probe,) = main(["qa", "--tokenizer", t, "--text", "some é words"])["probes"]
    assert probe["exact"] and probe["tokens"] > 3


def test_folded_fingerprints(spark):
    rows = [("a", i * 7 % 1000, f"m{i}") for i in range(1000)] + [("b", 5, "x"), ("b", 5, "a"), (None, 1, "z")]
    df = spark.createDataFrame(rows, "g string, o int, m string")

    def plain(marks, fold, first=True):
        sha = lambda part: part[0] if len(part) == 1 and not first else hashlib.sha256("\n".join(part).encode()).hexdigest()
        marks = [sha(marks[i : i + fold]) for i in range(0, len(marks), fold)]
        return marks[0] if len(marks) == 1 else plain(marks, fold, False)

    for fold in (1 << 16, 1000, 999, 10, 3):
        want = {g: (plain([m for k, _, m in sorted(rows, key=lambda r: r[1:]) if k == g], fold), sum(k == g for k, _, _ in rows)) for g in ("a", "b", None)}
        got = {r.g: (r.fingerprint, r.tasks) for r in hashing.combined(df.repartition(5), "o", "m", ["g"], fold).collect()}
        assert got == want, fold
        assert got == {r.g: (r.fingerprint, r.tasks) for r in hashing.combined(df.coalesce(1), "o", "m", ["g"], fold).collect()}


def test_many_shards_are_searched_by_halving(spark):
    sizes = [i % 3 for i in range(100_000)]
    ends = np.cumsum(sizes)
    ranks = [0, 1, 2, 50_000, int(ends[-1]) - 1]
    got = {r["rank"]: (r.shard, r["row"]) for r in ordering.shard_of(spark.createDataFrame([(r,) for r in [*ranks, -1, int(ends[-1])]], "rank long"), sizes).collect()}
    assert got == {r: ((s := int(np.searchsorted(ends, r, side="right"))), r - int(ends[s - 1] if s else 0)) for r in ranks}


@pytest.mark.parametrize("buffer", [0, 1, 2, 7, 64, 1000])
def test_shuffle_buffer_is_a_buffer(spark, buffer):
    sizes = {"a": 500, "b": 3, None: 40}
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g string, at long")
    marks = {r.g: r.m for r in df.select("g", F.when(F.col("g").isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(7), "g")).alias("m")).distinct().collect()}
    want = {}
    for g, n in sizes.items():
        rows, held, out = iter(range(n)), [], []
        while len(out) < n:
            while len(held) < max(1, buffer) and (r := next(rows, None)) is not None:
                held.append(r)
            out.append(held.pop(int(sampling.draws(marks[g], len(out), np.array([len(held)]))[0])))
        want |= {(g, r): t for t, r in enumerate(out)}
    for block in (13, 1 << 18):
        assert {(r.g, r["at"]): r.out_order for r in sampling.shuffle_buffer(df, "at", "g", buffer, 7, block).collect()} == want
    assert buffer < 2 or any(r[1] != t for r, t in want.items())
