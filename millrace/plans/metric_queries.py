"""Metrics, metric logs, schedules, identities and corpus checks."""

import json
import uuid

from pyspark.sql import functions as F

from millrace.functions import hashing, schedule
from millrace.operators import bpe, metrics
from millrace.operators.ordering import running
from millrace.session import checkpoint_folder
from millrace.sources import corpus, storage
from millrace.streaming import discovery


def _log(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("ord"), F.col("event_type").alias("phase"), (F.col("user_id") % 4).alias("run"), F.when(F.col("event_id") % 11 != 0, F.floor(F.col("event_id") / 3).cast("double")).alias("tokens"), F.col("event_id").cast("double").alias("step"), F.col("value").alias("loss"))


def metric_latest(spark, sf_dir):
    return metrics.latest(_log(spark, sf_dir), "ord").select("ord", "phase", "tokens", "loss")


def history_cutoff(spark, sf_dir):
    return metrics.handed_over(_log(spark, sf_dir)).select("ord", "run", "tokens")


def metric_axis(spark, sf_dir):
    return metrics.axis(_log(spark, sf_dir), ["ord"]).select("ord", "place", "x")


def phase_boundaries(spark, sf_dir):
    return metrics.phase_changes(metrics.axis(_log(spark, sf_dir), ["ord"])).select("ord", "phase", "x")


def weighted_eval_loss(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("n", F.col("ord") % 7)
    mean = metrics.weighted_mean(F.col("loss"), F.col("n"))
    return log.groupBy("phase").agg(mean.alias("m")).select("phase", F.round("m", 6).alias("loss"), F.round(metrics.perplexity(F.col("m") / 100), 6).alias("ppl"))


def packed_flops(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.groupBy("lang").agg(metrics.packed_flops(F.col("n_chars"), 350_381_056, 28, 1024).alias("flops"))


def timing_stats(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL").select("event_type", "event_id", "value")
    stats = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.expr("percentile(value, 0.5)").alias("median"), F.count("*").alias("n"))
    ranked = running(e, ["value", "event_id"], by=["event_type"])
    out = ranked.join(stats, "event_type").where(F.col("rank") == F.greatest(F.floor(F.col("n") * 0.95), F.lit(1)) - 1)
    return out.select("event_type", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.col("value").alias("p95"))


def _logits(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", "label", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 8).alias("logits"))


def dpo_loss(spark, sf_dir):
    x = _logits(spark, sf_dir).select("label", *(F.element_at("logits", i + 1).alias(c) for i, c in enumerate(("chosen", "rejected", "ref_chosen", "ref_rejected"))))
    return metrics.dpo_stats(x, 0.1, ["label"]).select("label", F.round("loss", 6).alias("loss"), F.round("reward_accuracy", 6).alias("reward_accuracy"), "pairs")


def router_load(spark, sf_dir):
    s = metrics.router_stats(_logits(spark, sf_dir), 8, ["label"])
    return s.select("label", "expert", "tokens", F.round("fraction", 6).alias("fraction"), F.round("mean_prob", 6).alias("mean_prob"), F.round("z_loss", 5).alias("z_loss"), F.round("token_entropy", 6).alias("token_entropy"))


def router_summary(spark, sf_dir):
    s = metrics.router_summary(metrics.router_stats(_logits(spark, sf_dir), 8, ["label"]), 8, ["label"])
    return s.select("label", F.round("load_cv", 6).alias("load_cv"), F.round("load_entropy", 6).alias("load_entropy"), F.round("aux_loss", 6).alias("aux_loss"))


def layer_summary(spark, sf_dir):
    """Mean and worst over groups of the balance loss."""
    s = metrics.router_summary(metrics.router_stats(_logits(spark, sf_dir), 8, ["label"]), 8, ["label"])
    return s.agg(F.round(F.avg("aux_loss"), 6).alias("mean_aux"), F.round(F.max("aux_loss"), 6).alias("worst_aux"), F.count("*").alias("layers"))


def top_k_logits(spark, sf_dir):
    x = _logits(spark, sf_dir).select("vec_id", metrics.top_k(F.col("logits"), 3).alias("t"))
    return x.select("vec_id", F.size(F.filter("t", lambda v: v > float("-inf"))).alias("kept"), F.round(F.array_min(F.filter("t", lambda v: v > float("-inf"))), 6).alias("edge"))


def cosine_schedule(spark, sf_dir):
    """The learning rate at the step of every event."""
    s = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 1200).alias("step"))
    return s.select("event_id", "step", F.round(schedule.cosine_lr(F.col("step"), 1000, 100, 3e-4, 3e-5) * 1e4, 8).alias("lr"))


def sequence_schedule(spark, sf_dir):
    """The sequence length at the progress of every event."""
    s = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 101 / 100).alias("progress"))
    return s.select("event_id", "progress", schedule.scheduled(F.col("progress"), [{"until": 0.3, "seq": 512}, {"until": 0.6}, {"until": 0.9, "seq": 2048}], "seq", 256).alias("seq"))


def fingerprints(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", hashing.fingerprint("doc_id", "lang", "source").alias("fingerprint"))


def combined_fingerprints(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", hashing.fingerprint("doc_id", "lang", "source").alias("mark"))
    return hashing.combined(d, "doc_id", "mark", ["source"])


def corpus_reconcile(spark, sf_dir):
    d, lab = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return corpus.reconcile(d, lab, "doc_id")


def resume_check(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tasks = d.select(F.col("doc_id").alias("task"), F.sha2("text", 256).alias("fingerprint"))
    saved = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("task"), F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.sha2("text", 256)).alias("fingerprint"))
    return corpus.resume_plan(tasks, saved)


def duplicate_texts(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


def sampler_manifest(spark, sf_dir):
    """A hash-ordered sample of 20 documents a source, with the totals of sources and of all."""
    from pyspark.sql import Window

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", F.octet_length("text").alias("bytes"))
    w = Window.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string")))
    own = d.withColumn("r", F.row_number().over(w)).where("r <= 20")
    valid = d.rollup("source").agg(F.count("*").alias("valid_documents"))
    kept = own.rollup("source").agg(F.count("*").alias("sample_documents"), F.sum("bytes").cast("long").alias("sample_bytes"))
    return valid.join(kept, valid["source"].eqNullSafe(kept["source"])).select(F.coalesce(valid["source"], F.lit("all")).alias("source"), "valid_documents", "sample_documents", "sample_bytes")


def checkpoint_retention(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'")
    return metrics.newest(e.select(F.col("event_id").alias("step")), 5)


def bpe_pair_counts(spark, sf_dir):
    """One round of pair counting over ASCII words."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.pair_counts(bpe.word_counts(d, pattern="[A-Za-z]+"))


def bpe_pair_counts_bytes(spark, sf_dir):
    """One round of pair counting over all byte-level pre-tokens."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.pair_counts(bpe.word_counts(d))


def bpe_merges(spark, sf_dir):
    """All merges of a vocabulary of 32,768 tokens, seven of them special, with the token that each makes."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(i, a, b) for i, (a, b) in enumerate(bpe.train(d, 32768 - 256 - 7))]  # no more than the vocabulary
    return spark.createDataFrame(rows, "rank int, a string, b string").withColumn("token", F.concat("a", "b"))


def corpus_discovery(spark, sf_dir):
    """Sources whose corpora are complete and not known yet, from their markers."""
    folder = f"{checkpoint_folder(spark)}/discovery-{uuid.uuid4().hex}"
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in d.groupBy("source").agg(F.count("*").alias("documents"), (F.min("doc_id") % 2 == 0).alias("complete")).collect():  # a row a corpus
        storage.write_text(f"{folder}/{r.source}/corpus.json", json.dumps({"documents": r.documents, "complete": r.complete}))
    known = {storage.shown(f"{folder}/{s}") for s in ("src0", "src4")}
    found = [c["path"].rpartition("/")[2] for c in discovery.complete_corpora(folder, known)]
    return d.where(F.col("source").isin(found)).groupBy("source").agg(F.count("*").alias("documents"))


_LOG = "WITH l AS (SELECT event_id AS ord, event_type AS phase, user_id % 4 AS run, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id // 3 AS DOUBLE) END AS tokens, CAST(event_id AS DOUBLE) AS step, value AS loss FROM events)"
_AX = _LOG + ", a AS (SELECT *, row_number() OVER (ORDER BY coalesce(tokens, step), ord) - 1 AS place FROM l), x AS (SELECT *, coalesce(nullif(tokens, 0), nullif(step, 0), CAST(place + 1 AS DOUBLE)) AS x FROM a)"
_LG = "WITH g AS (SELECT vec_id, label, list_transform(embedding[1:8], lambda v: CAST(v AS DOUBLE) * 8) AS g FROM embeddings)"
_RT = _LG + """, t AS (SELECT *, list_max(g) AS top, list_sum(list_transform(g, lambda v: exp(v - list_max(g)))) AS s FROM g),
    p AS (SELECT label, vec_id, list_position(g, top) - 1 AS e, (ln(s) + top) * (ln(s) + top) AS z, list_transform(g, lambda v: exp(v - top) / s) AS p FROM t),
    h AS (SELECT *, -list_sum(list_transform(p, lambda q: q * ln(greatest(q, 1e-30)))) AS h FROM p),
    u AS (SELECT label, e, z, h, unnest(range(0, 8)) AS expert, unnest(p) AS q FROM h),
    r AS (SELECT label, CAST(expert AS INTEGER) AS expert, CAST(sum(CASE WHEN e = expert THEN 1 ELSE 0 END) AS BIGINT) AS tokens, sum(CASE WHEN e = expert THEN 1 ELSE 0 END) / count(*) AS fraction, avg(q) AS mean_prob, avg(z) AS z_loss, avg(h) AS token_entropy FROM u GROUP BY label, expert),
    y AS (SELECT label, stddev_pop(tokens) / avg(tokens) AS load_cv, -sum(CASE WHEN fraction > 0 THEN fraction * ln(fraction) ELSE 0 END) AS load_entropy, sum(fraction * mean_prob) * 8 AS aux_loss FROM r GROUP BY label)"""
_FP = "sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}')"

ORACLES = {
    "metric_latest": _LOG + " SELECT ord, phase, tokens, loss FROM l QUALIFY tokens IS NULL OR row_number() OVER (PARTITION BY phase, tokens ORDER BY ord DESC) = 1",
    "history_cutoff": _LOG + ", f AS (SELECT run, arg_min(tokens, ord) FILTER (tokens IS NOT NULL) AS first FROM l GROUP BY run) SELECT ord, l.run, tokens FROM l WHERE tokens IS NULL OR tokens < coalesce((SELECT min(first) FROM f WHERE f.run > l.run), 1e300)",
    "metric_axis": _AX + " SELECT ord, place, x FROM x",
    "phase_boundaries": _AX + " SELECT ord, phase, x FROM x QUALIFY phase <> lag(phase) OVER (ORDER BY place)",
    "weighted_eval_loss": "SELECT event_type AS phase, round(m, 6) AS loss, round(exp(least(m / 100, 20)), 6) AS ppl FROM (SELECT event_type, sum(value * (event_id % 7)) / greatest(sum(event_id % 7), 1) AS m FROM events GROUP BY event_type)",
    "packed_flops": "SELECT lang, 6.0::DOUBLE * 350381056 * sum(n_chars) + 6.0::DOUBLE * 28 * 1024 * sum(n_chars * n_chars) AS flops FROM documents GROUP BY lang",
    "timing_stats": "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, list_sort(list(value))[greatest(CAST(floor(count(*) * 0.95) AS BIGINT), 1)] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "dpo_loss": _LG + " SELECT label, round(avg(ln(1 + exp(-abs(x))) + greatest(-x, 0)), 6) AS loss, round(avg(CASE WHEN x > 0 THEN 1 ELSE 0 END), 6) AS reward_accuracy, count(*) AS pairs FROM (SELECT label, 0.1 * ((g[1] - g[2]) - (g[3] - g[4])) AS x FROM g) GROUP BY label",
    "router_load": _RT + " SELECT label, expert, tokens, round(fraction, 6) AS fraction, round(mean_prob, 6) AS mean_prob, round(z_loss, 5) AS z_loss, round(token_entropy, 6) AS token_entropy FROM r",
    "router_summary": _RT + " SELECT label, round(load_cv, 6) AS load_cv, round(load_entropy, 6) AS load_entropy, round(aux_loss, 6) AS aux_loss FROM y",
    "layer_summary": _RT + " SELECT round(avg(aux_loss), 6) AS mean_aux, round(max(aux_loss), 6) AS worst_aux, count(*) AS layers FROM y",
    "top_k_logits": _LG + " SELECT vec_id, CAST(len(list_filter(g, lambda v: v >= list_reverse_sort(g)[3])) AS INTEGER) AS kept, round(list_reverse_sort(g)[3], 6) AS edge FROM g",
    "cosine_schedule": "SELECT event_id, step, round(1e4 * CASE WHEN step < 100 THEN 3e-4 * (step + 1) / 100.0 WHEN step >= 1000 THEN 3e-5 ELSE 3e-5 + 0.5 * (1 + cos(pi() * ((step - 100) / 900.0))) * (3e-4 - 3e-5) END, 8) AS lr FROM (SELECT event_id, event_id % 1200 AS step FROM events)",
    "sequence_schedule": "SELECT event_id, i / 100 AS progress, CASE WHEN i / 100 < 0.6 THEN 512 ELSE 2048 END AS seq FROM (SELECT event_id, event_id % 101 AS i FROM events)",
    "fingerprints": f"SELECT doc_id, {_FP} AS fingerprint FROM documents",
    "combined_fingerprints": f"SELECT source, sha256(string_agg({_FP}, chr(10) ORDER BY doc_id)) AS fingerprint, count(*) AS tasks FROM documents GROUP BY source",
    "corpus_reconcile": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS status FROM (SELECT doc_id FROM documents WHERE lang = 'en') d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
    "resume_check": "SELECT doc_id AS task, CASE WHEN doc_id % 3 = 0 THEN 'absent' WHEN doc_id % 5 = 0 THEN 'mismatch' ELSE 'reuse' END AS action FROM documents",
    "duplicate_texts": "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1",
    "sampler_manifest": """
        WITH d AS (SELECT source, strlen(text) AS bytes, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) AS r FROM documents)
        SELECT coalesce(source, 'all') AS source, count(*) AS valid_documents, count(*) FILTER (r <= 20) AS sample_documents, CAST(sum(bytes) FILTER (r <= 20) AS BIGINT) AS sample_bytes FROM d GROUP BY ROLLUP (source)""",
    "checkpoint_retention": "SELECT event_id AS step FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 5",
    "bpe_pair_counts": """
        WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents), c AS (SELECT w, count(*) AS f FROM w GROUP BY w),
        p AS (SELECT f, w, unnest(range(1, length(w))) AS i FROM c WHERE length(w) > 1)
        SELECT hex(w[i]) AS a, hex(w[i + 1]) AS b, CAST(sum(f) AS BIGINT) AS count FROM p GROUP BY ALL""",
    "corpus_discovery": "SELECT source, count(*) AS documents FROM documents WHERE source NOT IN ('src0', 'src4') GROUP BY source HAVING min(doc_id) % 2 = 0",
}
QUERIES = {
    f.__name__: f
    for f in (
        metric_latest, history_cutoff, metric_axis, phase_boundaries, weighted_eval_loss, packed_flops, timing_stats, dpo_loss, router_load, router_summary, layer_summary, top_k_logits,
        cosine_schedule, sequence_schedule, fingerprints, combined_fingerprints, corpus_reconcile, resume_check, duplicate_texts, sampler_manifest, checkpoint_retention, bpe_pair_counts, bpe_pair_counts_bytes, bpe_merges, corpus_discovery,
    )
}
