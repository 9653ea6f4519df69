"""Documents of four languages as four corpora: splits, orders, mixing, packing."""

from pyspark.sql import functions as F

from millrace.operators import mixing
from millrace.operators.ordering import prefix_budget, running
from millrace.streaming.discovery import late_heads

CORPORA = [{"name": "de", "weight": 0.4}, {"name": "en", "weight": 0.3}, {"name": "es", "weight": 0.2}, {"name": "fr", "weight": 0.1}]
VAL, SEED, LONGEST, BUDGET = 20, 7, 256, 4096
LATE = ["fr"]


def _docs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("lang").alias("corpus"), "doc_id", (F.octet_length("text") + 1).cast("long").alias("n_tokens"))


def _split(spark, sf_dir):
    return mixing.split(_docs(spark, sf_dir), CORPORA, ["doc_id"], VAL, SEED)


def _pieces(spark, sf_dir):
    return mixing.pieces(_split(spark, sf_dir).where("NOT is_val"), LONGEST).select("corpus", "corpus_ord", "doc_id", "position", "piece", "start", "k")


def doc_offsets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", (F.octet_length("text") + 1).cast("long").alias("n_tokens"))
    return running(docs, ["doc_id"], F.col("n_tokens"), by=["source"], before="offset")


def global_rank(spark, sf_dir):
    return running(_docs(spark, sf_dir), ["corpus", "doc_id"], F.col("n_tokens"))


def prefix_byte_budget(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length("text").alias("n_bytes"))
    return prefix_budget(docs, ["doc_id"], F.col("n_bytes"), 1_000_000, 400)


def val_split(spark, sf_dir):
    return _split(spark, sf_dir).select("corpus", "doc_id", "rank", "is_val")


def affine_order(spark, sf_dir):
    return _split(spark, sf_dir).where("NOT is_val").select("corpus", "doc_id", "train_rank", "position")


def split_totals(spark, sf_dir):
    p = F.greatest(F.col("n_tokens") - 1, F.lit(0))
    return _split(spark, sf_dir).groupBy("corpus").agg(
        F.count("*").alias("documents"), F.sum(F.col("is_val").cast("long")).alias("val_documents"),
        F.sum(F.when(F.col("is_val"), 0).otherwise(p)).cast("long").alias("train_prediction_tokens"),
    )


def start_tag_mix(spark, sf_dir):
    return mixing.tagged(_pieces(spark, sf_dir), CORPORA).select("corpus", "doc_id", "piece", "k", "tag")


def late_corpus_tags(spark, sf_dir):
    """Tags where one corpus comes late: it begins at the least progress of the others, here 500 predictions a document."""
    progress = _docs(spark, sf_dir).groupBy("corpus").agg((F.count("*") * 500).alias("emitted"))
    heads = late_heads(progress, LATE, mixing.integer_weights(CORPORA))
    return mixing.tagged(_pieces(spark, sf_dir), CORPORA, heads).select("corpus", "doc_id", "piece", "k", "tag")


def _packed(spark, sf_dir):
    return mixing.packed(mixing.tagged(_pieces(spark, sf_dir), CORPORA), BUDGET)


def pack_microbatches(spark, sf_dir):
    return _packed(spark, sf_dir).select("microbatch", "corpus", "doc_id", "slot", "offset", "predictions")


def batch_boundaries(spark, sf_dir):
    return mixing.boundaries(_packed(spark, sf_dir), BUDGET).select("microbatch", F.array_join(F.transform("cu_seqlens", lambda x: x.cast("string")), ",").alias("cu_seqlens"), "max_seqlen", "valid_len")


def emitted_tokens(spark, sf_dir):
    return _packed(spark, sf_dir).groupBy("corpus").agg(F.sum("predictions").cast("long").alias("emitted"), F.countDistinct("doc_id").alias("documents"))


def step_groups(spark, sf_dir):
    """Microbatches of each optimizer step, and the work of attention in it."""
    b = _packed(spark, sf_dir).withColumn("step", F.floor(F.col("microbatch") / 3).cast("long"))
    return b.groupBy("step").agg(F.countDistinct("microbatch").alias("microbatches"), F.sum("predictions").cast("long").alias("tokens"), F.sum(F.col("predictions") * F.col("predictions")).cast("long").alias("squares"))


def val_stream(spark, sf_dir):
    return mixing.cyclic(_split(spark, sf_dir).where("is_val"), 3).select("corpus", "doc_id", "round")


def pack_exact_balance(spark, sf_dir):
    return mixing.pack_exact(_split(spark, sf_dir).where("NOT is_val"), CORPORA, BUDGET, LONGEST)


def resumed_batches(spark, sf_dir):
    """The exact queue's batches from the sixth on, and whether a run that goes on from what five batches had given makes the same pieces."""
    docs = _split(spark, sf_dir).where("NOT is_val").select("corpus", "doc_id", "n_tokens", "position")
    whole = mixing.pack_exact(docs, CORPORA, BUDGET, LONGEST)
    given = {r.corpus: r.emitted for r in mixing.committed(whole, 5).collect()}  # a row a corpus
    later = mixing.pack_exact(docs, CORPORA, BUDGET, LONGEST, given=given).withColumn("microbatch", F.col("microbatch") + 5)
    both = whole.where("microbatch >= 5").join(later.withColumn("again", F.lit(True)), ["corpus", "doc_id", "offset", "predictions", "microbatch", "slot"], "full_outer")
    return both.groupBy("microbatch").agg(F.sum("predictions").alias("predictions"), F.bool_and(F.coalesce("again", F.lit(False))).alias("same"))


def packed_batches(spark, sf_dir):
    """Every whole batch with byte ids, joined last: its counts, and digests of inputs and targets (three hex digits an id) and of positions."""
    from millrace.operators.batches import byte_ids

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = docs.select("doc_id", F.concat(byte_ids(F.col("text")), F.array(F.lit(256))).alias("ids"))
    b = mixing.build(_packed(spark, sf_dir), ids, ["doc_id"])
    digest = lambda c: F.sha2(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), 3, "0")), ""), 256)
    positions = F.sha2(F.array_join(F.transform("position_ids", lambda x: x.cast("string")), ","), 256)
    return b.select("microbatch", F.size("input_ids").alias("n_inputs"), digest("input_ids").alias("inputs_sha256"), digest("targets").alias("targets_sha256"), positions.alias("positions_sha256"))


_SPLIT = f"""
    WITH d AS (
        SELECT lang AS corpus, doc_id, CAST(strlen(text) + 1 AS BIGINT) AS n_tokens, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n,
               CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS ord, CASE lang WHEN 'de' THEN 15 WHEN 'en' THEN 20 WHEN 'es' THEN 30 ELSE 60 END AS factor
        FROM documents),
    s AS (SELECT *, {SEED} + 1009 * ord AS seed, least({VAL}, n - 1) AS v, n - least({VAL}, n - 1) AS t FROM d),
    f AS (SELECT *, ((rank - seed) % n + n) % n < v AS is_val FROM s),
    tr AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY rank) - 1 AS train_rank FROM f WHERE NOT is_val),
    m AS (SELECT corpus, any_value(t) AS t, any_value(seed) AS seed, arg_min(c, k) AS m FROM (
            SELECT corpus, t, seed, k, CASE WHEN (2 * seed + 1 + 2 * k) % t = 0 THEN 1 ELSE (2 * seed + 1 + 2 * k) % t END AS c FROM (SELECT DISTINCT corpus, t, seed FROM s), range(0, 400) AS r(k))
          WHERE gcd(c, t) = 1 GROUP BY corpus),
    o AS (SELECT corpus, c AS position, (m * c + seed % t) % t AS train_rank FROM (SELECT *, unnest(range(0, t)) AS c FROM m)),
    p AS (SELECT tr.*, o.position FROM tr JOIN o ON tr.corpus = o.corpus AND tr.train_rank = o.train_rank),
    pc AS (SELECT *, piece * {LONGEST} AS start, least({LONGEST}, n_tokens - 1 - piece * {LONGEST}) AS k FROM (SELECT *, unnest(range(0, (n_tokens - 2) // {LONGEST} + 1)) AS piece FROM p WHERE n_tokens >= 2)),
    tg AS (SELECT *, CAST(coalesce(sum(k) OVER (PARTITION BY corpus ORDER BY position, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) * factor AS tag FROM pc),
    pl AS (SELECT *, CAST(coalesce(sum(k) OVER (ORDER BY tag, ord, position, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM tg),
    mb AS (SELECT *, greatest(pos, b * {BUDGET}) AS x, least(pos + k, (b + 1) * {BUDGET}) AS y FROM (SELECT *, unnest(range(pos // {BUDGET}, (pos + k - 1) // {BUDGET} + 1)) AS b FROM pl)),
    pk AS (SELECT b AS microbatch, corpus, doc_id, x - b * {BUDGET} AS slot, start + x - pos AS "offset", y - x AS predictions FROM mb QUALIFY sum(y - x) OVER (PARTITION BY b) = {BUDGET})
"""

ORACLES = {
    "resumed_batches": _SPLIT + f"SELECT microbatch, CAST({BUDGET} AS BIGINT) AS predictions, TRUE AS same FROM (SELECT unnest(range(5, CAST((SELECT sum(n_tokens - 1) FROM p WHERE n_tokens >= 2) AS BIGINT) // {BUDGET})) AS microbatch)",
    "doc_offsets": 'SELECT source, doc_id, CAST(strlen(text) + 1 AS BIGINT) AS n_tokens, row_number() OVER w - 1 AS rank, CAST(coalesce(sum(strlen(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)',
    "global_rank": "SELECT lang AS corpus, doc_id, CAST(strlen(text) + 1 AS BIGINT) AS n_tokens, row_number() OVER w - 1 AS rank, CAST(coalesce(sum(strlen(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM documents WINDOW w AS (ORDER BY lang, doc_id)",
    "prefix_byte_budget": "SELECT doc_id, CAST(n AS INTEGER) AS n_bytes FROM (SELECT doc_id, strlen(text) AS n, sum(strlen(text)) OVER (ORDER BY doc_id) AS s, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE s <= 1000000 AND r <= 400",
    "val_split": _SPLIT + "SELECT corpus, doc_id, rank, is_val FROM f",
    "affine_order": _SPLIT + "SELECT corpus, doc_id, train_rank, position FROM p",
    "split_totals": _SPLIT + "SELECT corpus, count(*) AS documents, CAST(sum(CASE WHEN is_val THEN 1 ELSE 0 END) AS BIGINT) AS val_documents, CAST(sum(CASE WHEN is_val THEN 0 ELSE greatest(n_tokens - 1, 0) END) AS BIGINT) AS train_prediction_tokens FROM f GROUP BY corpus",
    "start_tag_mix": _SPLIT + "SELECT corpus, doc_id, piece, k, tag FROM tg",
    "late_corpus_tags": _SPLIT + "SELECT corpus, doc_id, piece, k, tag + CASE corpus WHEN 'fr' THEN (SELECT min(500 * n * factor) // 60 * 60 FROM (SELECT DISTINCT corpus, n, factor FROM d) WHERE corpus <> 'fr') ELSE 0 END AS tag FROM tg",
    "pack_microbatches": _SPLIT + "SELECT * FROM pk",
    "batch_boundaries": _SPLIT + f"SELECT microbatch, string_agg(slot, ',' ORDER BY slot) || ',{BUDGET}' AS cu_seqlens, max(predictions) AS max_seqlen, CAST(sum(predictions) AS BIGINT) AS valid_len FROM pk GROUP BY microbatch",
    "emitted_tokens": _SPLIT + "SELECT corpus, CAST(sum(predictions) AS BIGINT) AS emitted, count(DISTINCT doc_id) AS documents FROM pk GROUP BY corpus",
    "step_groups": _SPLIT + "SELECT microbatch // 3 AS step, count(DISTINCT microbatch) AS microbatches, CAST(sum(predictions) AS BIGINT) AS tokens, CAST(sum(predictions * predictions) AS BIGINT) AS squares FROM pk GROUP BY microbatch // 3",
    "val_stream": _SPLIT + "SELECT corpus, doc_id, CAST(unnest(range(0, 3)) AS INTEGER) AS round FROM f WHERE is_val AND n_tokens >= 2",
    "packed_batches": _SPLIT + """
        , h AS (SELECT doc_id, regexp_replace(hex(encode(text)), '(..)', '0\\1', 'g') || '100' AS h FROM documents),
        x AS (SELECT microbatch, slot, predictions, substr(h, 3 * "offset" + 1, 3 * predictions) AS i, substr(h, 3 * "offset" + 4, 3 * predictions) AS t FROM pk JOIN h ON pk.doc_id = h.doc_id)
        SELECT microbatch, CAST(sum(predictions) AS INTEGER) AS n_inputs, sha256(string_agg(i, '' ORDER BY slot)) AS inputs_sha256, sha256(string_agg(t, '' ORDER BY slot)) AS targets_sha256,
               sha256(string_agg(array_to_string(range(0, predictions), ','), ',' ORDER BY slot)) AS positions_sha256 FROM x GROUP BY microbatch""",
}
QUERIES = {
    f.__name__: f
    for f in (doc_offsets, global_rank, prefix_byte_budget, val_split, affine_order, split_totals, start_tag_mix, late_corpus_tags, pack_microbatches, batch_boundaries, emitted_tokens, step_groups, val_stream, packed_batches, pack_exact_balance, resumed_batches)
}
