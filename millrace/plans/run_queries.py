"""Encoding round trips, written records, caches, supervised packing, run state and sizes."""

import uuid

from pyspark.sql import functions as F

from millrace.functions import hashing
from millrace.operators import batches, bpe, metrics, mixing, sampling
from millrace.operators.ordering import running, shard_of
from millrace.plans import mixing_queries, record_queries
from millrace.session import checkpoint_folder
from millrace.sources import cached, files, shards

EOS = 50256
# The shape of the reference-size model.
SHAPE = {"vocab_size": 32768, "n_head": 8, "n_kv_head": 4, "n_embd": 1024, "n_expert": 8, "expert_hidden_size": 2240, "shared_expert_hidden_size": 416, "top_k": 1}


def _folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/query-{uuid.uuid4().hex}"


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_round_trip(spark, sf_dir):
    """Every document encoded (composed, stripped, the end id behind) and decoded again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = bpe.decode(bpe.encode(docs, _tokenizer(), EOS).drop("text"), _tokenizer(), EOS)
    return out.select("doc_id", (F.element_at("ids", -1) == EOS).alias("ends"), (F.size("ids") == F.col("n_tokens")).alias("counted"), F.octet_length("decoded").alias("n_bytes"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _lines(spark, sf_dir):
    """Documents as JSON lines, some of them broken, blank or without text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    line = F.when(F.col("doc_id") % 7 == 0, "not json").when(F.col("doc_id") % 11 == 0, "\t　").when(F.col("doc_id") % 13 == 0, '{"text": " "}').otherwise(F.to_json(F.struct("doc_id", "text")))
    return d.select("source", "doc_id", line.alias("line"))


def jsonl_counts(spark, sf_dir):
    """Valid and invalid records of written JSON lines, counted and not raised."""
    folder = _folder(spark)
    _lines(spark, sf_dir).select("source", "line").write.partitionBy("source").text(folder)
    counts = files.record_counts(spark, files.input_files(folder, ("*.txt",)))
    return counts.groupBy(F.regexp_extract("file", "source=([^/]+)", 1).alias("source")).agg(F.sum("valid").alias("valid"), F.sum("invalid").alias("invalid"))


def jsonl_limited(spark, sf_dir):
    """Records among the first 150 that are read, in the order of files and lines."""
    folder = _folder(spark)
    _lines(spark, sf_dir).orderBy("doc_id").select("line").write.text(folder)
    rows = files.json_lines(spark, files.input_files(folder, ("*.txt",)), strict=False, max_records=150)
    return rows.select(F.try_variant_get("record", "$.doc_id", "long").alias("doc_id"), F.try_variant_get("record", "$.text", "string").alias("text"))


def encoded_lines(spark, sf_dir):
    """Digests of all texts, read again from JSON lines in two encodings: UTF-8 files are cut, UTF-16 files are not."""
    folder = _folder(spark)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for i, name in enumerate(("UTF-8", "UTF-16")):
        d.where(F.pmod("doc_id", F.lit(2)) == i).write.option("encoding", name).option("lineSep", "\n").json(f"{folder}/{name}")
    rows = files.json_lines(spark, files.input_files(folder, ("*.json",)))
    return rows.select(F.try_variant_get("record", "$.doc_id", "long").alias("doc_id"), F.sha2(F.try_variant_get("record", "$.text", "string"), 256).alias("text_sha256"))


def sft_cache(spark, sf_dir):
    """Encoded conversations from a keyed table, the second time without encoding."""
    folder, key = _folder(spark), {"purpose": "sft", "eos": batches.EOS, "files": [f"{sf_dir}/conversations.parquet"]}
    build = lambda: record_queries.sft_mask_lengths(spark, sf_dir)
    cached.keyed_table(spark, folder, key, build)
    df, reused = cached.keyed_table(spark, folder, key, build)
    return df.withColumn("reused", F.lit(reused))


def sft_total_tokens(spark, sf_dir):
    return record_queries.sft_mask_lengths(spark, sf_dir).agg(F.sum(F.greatest(F.col("n_ids") - 1, F.lit(0))).cast("long").alias("tokens"), F.count("*").alias("examples"))


def sft_packed_epochs(spark, sf_dir):
    """Two epochs of conversations, each in an order of its own, in full microbatches."""
    examples = record_queries.sft_mask_lengths(spark, sf_dir).select("conv_id", F.col("n_ids").alias("n_tokens"))
    out = mixing.sft_packed(sampling.hash_epochs(examples, "conv_id", 2, 11), ["epoch", "mark"], 4096, 1024)
    return out.select("microbatch", "epoch", "conv_id", "slot", "offset", "predictions")


def reference_margins(spark, sf_dir):
    """Margins of preference pairs against reference log-probabilities that are kept in a keyed table."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    labels = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.when((i + F.col("vec_id")) % 3 == 0, -100).otherwise(i.cast("int")))
    side = lambda a: metrics.sequence_log_prob(F.transform(F.slice("embedding", a, 8), lambda x: x.cast("double")), labels)
    pairs = e.select(F.col("vec_id").alias("example"), side(1).alias("chosen"), side(9).alias("rejected"))
    reference, _ = cached.keyed_table(spark, _folder(spark), {"model": "reference", "rows": sf_dir}, lambda: pairs)
    policy = pairs.select("example", (F.col("chosen") / 2).alias("chosen"), (F.col("rejected") / 2).alias("rejected"))
    out = metrics.with_reference(policy, reference)
    return out.select("example", F.round((F.col("chosen") - F.col("rejected")) - (F.col("ref_chosen") - F.col("ref_rejected")), 5).alias("margin"))


def dataset_identities(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", batches.byte_ids(F.col("text")).alias("ids"))
    return hashing.dataset_identity(talk, "turn", ["ids", "ids"], ["conv_id"])


def shuffle_buffer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id")
    ranked = running(docs, ["doc_id"], by=["source"], rank="position").drop("before")
    return sampling.shuffled(ranked, "position", "doc_id", 64, 7)


def step_losses(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.floor(F.col("event_id") / 8).cast("long").alias("step"), F.col("value").alias("lm_loss"), (F.col("event_id") % 5).alias("supervised"), (F.col("event_id") % 5 + 3).alias("valid"), (F.col("user_id") % 10 / 10).alias("router_aux"), (F.col("user_id") % 7 / 7).alias("router_z"))
    out = metrics.step_loss(rows.where("lm_loss IS NOT NULL"), 0.01, 0.001)
    return out.select("step", F.round("lm", 6).alias("lm"), F.round("router", 8).alias("router"))


def shard_lookup(spark, sf_dir):
    """For every rank over all documents the shard (source) it lies in, and its row there."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [r["count"] for r in d.groupBy("source").count().orderBy("source").collect()]  # a row a shard
    return shard_of(spark.range(sum(sizes)).select(F.col("id").alias("rank")), sizes).select("rank", F.col("shard").cast("long").alias("shard"), F.col("row").cast("long").alias("row"))


def committed_cursor(spark, sf_dir):
    return mixing.committed(mixing_queries._packed(spark, sf_dir), 5)


def metric_histories(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    one = e.where("event_id % 2 = 0").select("event_id", F.col("value").alias("loss"))
    two = e.where("event_id % 2 = 1").select("event_id", F.col("value").alias("val_loss"))
    return metrics.histories(one, two).select("event_id", "loss", "val_loss")


def model_sizes(spark, sf_dir):
    """Weights by component of models with as many layers as each part's size."""
    sizes = metrics.parameter_counts(SHAPE | {"n_layer": F.col("n_layer")})
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").cast("long").alias("n_layer"))
    return parts.select("p_partkey", "n_layer", *(F.lit(v).cast("long").alias(k) for k, v in sizes.items()))


def resumed_tasks(spark, sf_dir):
    """Texts by task (source) after three runs: the first writes all; before the second one task is gone, one has become empty and one text of another
    was edited; the third finds nothing to do. How many tasks each run wrote, too."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("task"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = [r.task for r in d.groupBy("task").count().orderBy("task").collect()]  # a row a task
    place = {n: i for i, n in enumerate(names)}
    at = F.create_map(*(F.lit(x) for kv in place.items() for x in kv))[F.col("task")] if place else F.lit(0)
    later = d.where((at != 0) & (at != 1)).withColumn("text", F.when((at == 2) & (F.col("doc_id") % 10 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    folder, written = _folder(spark), []
    for df, own in ((d, names), (later, names[1:]), (later, names[1:])):
        # every text counts, in any order: a sum of digests
        digests = df.groupBy("task").agg(F.sum(F.conv(F.substring(F.sha2(F.concat_ws(":", "doc_id", "text"), 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))
        marks = {r.task: r.digest for r in digests.collect()}
        tasks = [shards.Task(n, marks.get(n, "empty")) for n in own]
        written.append(shards.write_tasks(spark, tasks, folder, lambda todo, df=df: df.where(F.col("task").isin(todo))))
    part = {e["part"]: e["task"] for e in shards.task_rows(folder)}
    parts = spark.createDataFrame(list(part.items()), "part string, task string")
    rows = shards.read_tasks(spark, folder).join(F.broadcast(parts), "part")
    runs = [F.lit(n).cast("long").alias(f"run_{i}") for i, n in enumerate(written)]
    return rows.groupBy("task").agg(F.count("*").alias("documents"), F.count_if(F.col("text").endswith("!")).alias("edited")).select("task", "documents", "edited", *runs)


_WS = record_queries.WS
_KIND = f"""SELECT source, doc_id, text, CASE WHEN doc_id % 7 = 0 THEN 'bad' WHEN doc_id % 11 = 0 THEN 'blank' WHEN doc_id % 13 = 0 THEN 'empty'
            WHEN coalesce(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g'), '') = '' THEN 'empty' ELSE 'good' END AS kind FROM documents"""
_LAYERS = "SELECT p_partkey, i AS n_layer, 32768 * 1024 AS embedding, i * (2 * 1024 * 1024 + 2 * 1024 * 512) AS attention, i * 8 * 3 * 1024 * 2240 AS routed_experts, i * 3 * 1024 * 416 AS shared_experts, i * 1024 * 8 AS routers, (2 * i + 1) * 1024 AS norms FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS i FROM part)"
_IDS = record_queries.ORACLES["sft_mask_lengths"]
ORACLES = {
    "encode_round_trip": f"""
        SELECT doc_id, TRUE AS ends, TRUE AS counted, CAST(strlen(t) AS INTEGER) AS n_bytes, sha256(t) AS decoded_sha256
        FROM (SELECT doc_id, nfc_normalize(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')) AS t FROM documents) WHERE t <> ''""",
    "jsonl_counts": f"SELECT source, count(*) FILTER (kind = 'good') AS valid, count(*) FILTER (kind IN ('bad', 'empty')) AS invalid FROM ({_KIND}) GROUP BY source HAVING count(*) FILTER (kind <> 'blank') > 0",
    "jsonl_limited": f"SELECT CASE WHEN doc_id % 13 <> 0 THEN doc_id END AS doc_id, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE text END AS text FROM (SELECT * FROM ({_KIND}) WHERE kind <> 'blank' ORDER BY doc_id LIMIT 150) WHERE kind <> 'bad'",
    "encoded_lines": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents",
    "sft_cache": f"SELECT *, TRUE AS reused FROM ({_IDS})",
    "sft_total_tokens": f"SELECT CAST(sum(greatest(n_ids - 1, 0)) AS BIGINT) AS tokens, count(*) AS examples FROM ({_IDS})",
    "sft_packed_epochs": f"""
        WITH s AS (SELECT conv_id, n_ids - 1 AS k, epoch, md5('11:' || epoch || ':' || conv_id) AS mark FROM ({_IDS}), range(0, 2) AS e(epoch) WHERE n_ids >= 2),
        p AS (SELECT *, CAST(coalesce(sum(k) OVER (ORDER BY epoch, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS z0 FROM s),
        b AS (SELECT *, greatest(z0, m * 4096) AS x, least(z0 + k, (m + 1) * 4096) AS y FROM (SELECT *, unnest(range(z0 // 4096, (z0 + k - 1) // 4096 + 1)) AS m FROM p)),
        c AS (SELECT *, unnest(range(x, y, 1024)) AS z FROM b)
        SELECT m AS microbatch, CAST(epoch AS INTEGER) AS epoch, conv_id, z - m * 4096 AS slot, z - z0 AS "offset", CAST(least(1024, y - z) AS BIGINT) AS predictions FROM c QUALIFY sum(least(1024, y - z)) OVER (PARTITION BY m) = 4096""",
    "reference_margins": """
        SELECT vec_id AS example, round(-0.5 * (c - r), 5) AS margin FROM (
            SELECT vec_id, -list_sum([CASE WHEN (i + vec_id) % 3 = 0 THEN 0 ELSE CAST(embedding[i] AS DOUBLE) END for i in range(1, 9)]) AS c, -list_sum([CASE WHEN (i + vec_id) % 3 = 0 THEN 0 ELSE CAST(embedding[i + 8] AS DOUBLE) END for i in range(1, 9)]) AS r FROM embeddings)""",
    "dataset_identities": """
        SELECT conv_id, sha256(string_agg(sha256(unhex(h || h)), chr(10) ORDER BY turn)) AS fingerprint, count(*) AS tasks
        FROM (SELECT conv_id, turn, regexp_replace(hex(encode(text)), '(..)', '\\1000000', 'g') AS h FROM conversations) GROUP BY conv_id""",
    "shuffle_buffer": "SELECT source, doc_id, position, position + CAST('0x' || substr(md5('7:' || doc_id), 1, 8) AS BIGINT) % 64 AS out_order FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position FROM documents)",
    "step_losses": """
        SELECT event_id // 8 AS step, round(sum(value * (event_id % 5)) / greatest(1, sum(event_id % 5)), 6) AS lm,
               round(sum((0.01 * (user_id % 10 / 10) + 0.001 * (user_id % 7 / 7)) * (event_id % 5 + 3)) / greatest(1, sum(event_id % 5 + 3)), 8) AS router
        FROM events WHERE value IS NOT NULL GROUP BY event_id // 8""",
    "shard_lookup": "SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS rank, dense_rank() OVER (ORDER BY source) - 1 AS shard, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row FROM documents",
    "committed_cursor": mixing_queries._SPLIT + "SELECT corpus, CAST(sum(predictions) AS BIGINT) AS emitted FROM pk WHERE microbatch < 5 GROUP BY corpus",
    "metric_histories": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS loss, CASE WHEN event_id % 2 = 1 THEN value END AS val_loss FROM events",
    "model_sizes": f"SELECT * EXCLUDE (t), t AS total, t - n_layer * 7 * 3 * 1024 * 2240 AS active FROM (SELECT *, embedding + attention + routed_experts + shared_experts + routers + norms AS t FROM ({_LAYERS}))",
    "resumed_tasks": """
        WITH p AS (SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS place, doc_id, coalesce(text, '') AS text FROM documents)
        SELECT source AS task, count(*) AS documents, count(*) FILTER (text LIKE '%!' OR (place = 2 AND doc_id % 10 = 0)) AS edited,
               (SELECT count(DISTINCT source) FROM documents) AS run_0, 2 AS run_1, 0 AS run_2
        FROM p WHERE place > 1 GROUP BY source, place""",
}
QUERIES = {
    f.__name__: f
    for f in (
        encode_round_trip, jsonl_counts, jsonl_limited, encoded_lines, sft_cache, sft_total_tokens, sft_packed_epochs, reference_margins, dataset_identities, shuffle_buffer,
        step_losses, shard_lookup, committed_cursor, metric_histories, model_sizes, resumed_tasks,
    )
}
