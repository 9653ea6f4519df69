"""Conversations: canonical text, supervised and preference examples."""

from pyspark.sql import functions as F

from millrace.functions import records
from millrace.operators import batches
from millrace.operators.ordering import running

# White space at the ends of a text, for RE2.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _records(spark, sf_dir):
    """conv_id, v: each conversation as one JSON record, read as a variant."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = talk.groupBy("conv_id").agg(turns.alias("t"))
    messages = F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    rejected = F.slice(messages, 1, 2)
    return rows.select("conv_id", F.parse_json(F.to_json(F.struct(messages.alias("messages")))).alias("v"), F.parse_json(F.to_json(F.struct(messages.alias("chosen"), rejected.alias("rejected")))).alias("d"))


def render_conversations(spark, sf_dir):
    return _records(spark, sf_dir).select("conv_id", records.pretrain_text(F.col("v")).alias("text"))


def sft_pairs(spark, sf_dir):
    return _records(spark, sf_dir).select("conv_id", records.sft_pair(F.col("v")).alias("p")).select("conv_id", "p.prompt", "p.response")


def format_prompts(spark, sf_dir):
    pairs = sft_pairs(spark, sf_dir).where("prompt IS NOT NULL AND response IS NOT NULL")
    prefix, full = records.format_sft(F.col("prompt"), F.col("response"))
    return pairs.select("conv_id", prefix.alias("prefix"), full.alias("full"))


def sft_mask_lengths(spark, sf_dir):
    x = batches.sft_messages(F.col("m"))
    rows = _records(spark, sf_dir).select("conv_id", records.normalize(records.conversation(F.col("v"))).alias("m")).select("conv_id", x.alias("x"))
    return rows.where(batches.usable(F.col("x"))).select("conv_id", F.size("x.ids").alias("n_ids"), F.size(F.filter("x.mask", lambda b: b)).alias("n_supervised"))


def _shown(ids, width: int):
    """A digest of ids, each in so many hex digits."""
    return F.sha2(F.lower(F.array_join(F.transform(ids, lambda x: F.lpad(F.hex(x.cast("long")), width, "0")), "")), 256)


def sft_ids(spark, sf_dir):
    """Digests of all ids (three hex digits each) and of the mask of each conversation."""
    x = batches.sft_messages(F.col("m"))
    rows = _records(spark, sf_dir).select("conv_id", records.normalize(records.conversation(F.col("v"))).alias("m")).select("conv_id", x.alias("x")).where(batches.usable(F.col("x")))
    mask = F.array_join(F.transform("x.mask", lambda b: F.when(b, "1").otherwise("0")), "")
    return rows.select("conv_id", _shown(F.col("x.ids"), 3).alias("ids_sha256"), F.sha2(mask, 256).alias("mask_sha256"))


def next_token_labels(spark, sf_dir):
    """Inputs and masked labels of each conversation, as counts."""
    x = batches.sft_messages(F.col("m"))
    rows = _records(spark, sf_dir).select("conv_id", records.normalize(records.conversation(F.col("v"))).alias("m")).select("conv_id", x.alias("x")).where(batches.usable(F.col("x")))
    inputs, labels = batches.shifted(F.col("x")["ids"], F.col("x")["mask"])
    rows = rows.select("conv_id", inputs.alias("inputs"), labels.alias("labels"))
    return rows.select("conv_id", F.size("inputs").alias("n_inputs"), F.size("labels").alias("n_labels"), F.size(F.filter("labels", lambda y: y == batches.IGNORE)).alias("n_ignored"), F.element_at("labels", -1).alias("last_label"))


def _triplets(spark, sf_dir):
    return _records(spark, sf_dir).select("conv_id", records.dpo_triplet(F.col("d")).alias("t")).select("conv_id", "t.prompt", "t.chosen", "t.rejected").where("prompt IS NOT NULL AND chosen IS NOT NULL AND rejected IS NOT NULL")


def dpo_pairs(spark, sf_dir):
    return _triplets(spark, sf_dir)


def _examples(spark, sf_dir):
    side = lambda c: batches.dpo_example(F.col("prompt"), F.col(c), 1024)
    return _triplets(spark, sf_dir).select("conv_id", side("chosen").alias("chosen"), side("rejected").alias("rejected")).where("chosen IS NOT NULL AND rejected IS NOT NULL")


def dpo_windows(spark, sf_dir):
    size = lambda c: [F.size(f"{c}.inputs").alias(f"{c}_inputs"), F.size(F.filter(f"{c}.labels", lambda y: y != batches.IGNORE)).alias(f"{c}_supervised")]
    return _examples(spark, sf_dir).select("conv_id", *size("chosen"), *size("rejected"))


def dpo_ids(spark, sf_dir):
    """Digests of the inputs and of the labels that aren't ignored, of both sides of each pair."""
    shown = lambda c: [_shown(F.col(f"{c}.inputs"), 2).alias(f"{c}_inputs"), _shown(F.filter(f"{c}.labels", lambda y: y != batches.IGNORE), 2).alias(f"{c}_labels")]
    return _examples(spark, sf_dir).select("conv_id", *shown("chosen"), *shown("rejected"))


def padded_pairs(spark, sf_dir):
    ranked = running(_examples(spark, sf_dir), ["conv_id"], rank="example")
    out = batches.collate(ranked, 4)
    real = F.aggregate("labels", F.lit(0), lambda a, r: a + F.size(F.filter(r, lambda y: y != batches.IGNORE)))
    return out.select("batch", "width", F.size("inputs").alias("n_rows"), F.coalesce(F.element_at("cu_seqlens", -1), F.lit(0)).alias("tokens"), real.alias("supervised"))


_TALK = f"""
    WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    r AS (SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn) AS text FROM c GROUP BY conv_id),
    last AS (SELECT conv_id, max(i) FILTER (role = 'assistant') AS at, max(i) FILTER (role = 'assistant' AND i <= 2) AS at2 FROM c GROUP BY conv_id),
    pair AS (
        SELECT l.conv_id, CASE WHEN l.at IS NOT NULL THEN coalesce(string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn) FILTER (c.i < l.at), '') END AS prompt,
               max(text) FILTER (c.i = l.at) AS response, max(text) FILTER (c.i = l.at2) AS rejected
        FROM last l JOIN c ON l.conv_id = c.conv_id GROUP BY l.conv_id, l.at),
    fmt AS (
        SELECT conv_id, prompt, response, rejected, CASE WHEN contains(prompt, '<|user|>') OR contains(prompt, '<|system|>') OR contains(prompt, '<|developer|>') OR contains(prompt, '<|tool|>') OR contains(prompt, '<|observation|>') OR contains(prompt, '<|function|>')
               THEN '' ELSE '<|user|>' || chr(10) END || regexp_replace(prompt, '{WS}+$', '') || chr(10) || '<|assistant|>' || chr(10) AS prefix FROM pair WHERE prompt IS NOT NULL AND response IS NOT NULL),
    win AS (
        SELECT conv_id, h, least(h + c, 1025) AS nc, least(h + r, 1025) AS nr FROM (
            SELECT conv_id, strlen(prefix) AS h, strlen(regexp_replace(response, '{WS}+$', '')) + 7 AS c, strlen(regexp_replace(rejected, '{WS}+$', '')) + 7 AS r FROM fmt WHERE rejected IS NOT NULL)
        WHERE h < least(h + c, 1025) AND h < least(h + r, 1025))
"""

ORACLES = {
    "render_conversations": _TALK + "SELECT conv_id, text FROM r",
    "sft_pairs": _TALK + "SELECT conv_id, prompt, response FROM pair",
    "format_prompts": _TALK + f"SELECT conv_id, prefix, prefix || regexp_replace(response, '{WS}+$', '') || '<|eos|>' AS \"full\" FROM fmt",
    "sft_mask_lengths": """
        SELECT conv_id, CAST(sum(strlen(role) + 5 + strlen(text) + 1 + CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS INTEGER) AS n_ids,
               CAST(sum(CASE WHEN role = 'assistant' THEN strlen(text) + 2 ELSE 0 END) AS INTEGER) AS n_supervised
        FROM conversations GROUP BY conv_id HAVING sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) > 0""",
    "sft_ids": """
        SELECT conv_id, sha256(string_agg(regexp_replace(lower(hex(encode('<|' || role || '|>' || chr(10) || text || chr(10)))), '(..)', '0\\1', 'g') || CASE WHEN role = 'assistant' THEN '100' ELSE '' END, '' ORDER BY turn)) AS ids_sha256,
               sha256(string_agg(repeat('0', strlen(role) + 5) || repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, strlen(text) + 1) || CASE WHEN role = 'assistant' THEN '1' ELSE '' END, '' ORDER BY turn)) AS mask_sha256
        FROM conversations GROUP BY conv_id HAVING sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) > 0""",
    "next_token_labels": """
        SELECT conv_id, n - 1 AS n_inputs, n - 1 AS n_labels, n - 1 - s AS n_ignored, CASE WHEN last = 'assistant' THEN 256 ELSE -100 END AS last_label FROM (
            SELECT conv_id, CAST(sum(strlen(role) + 5 + strlen(text) + 1 + CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS INTEGER) AS n,
                   CAST(sum(CASE WHEN role = 'assistant' THEN strlen(text) + 2 ELSE 0 END) AS INTEGER) AS s, arg_max(role, turn) AS last
            FROM conversations GROUP BY conv_id) WHERE s > 0""",
    "dpo_pairs": _TALK + "SELECT conv_id, prompt, response AS chosen, rejected FROM pair WHERE prompt IS NOT NULL AND response IS NOT NULL AND rejected IS NOT NULL",
    "dpo_windows": _TALK + "SELECT conv_id, CAST(nc - 1 AS INTEGER) AS chosen_inputs, CAST(nc - h AS INTEGER) AS chosen_supervised, CAST(nr - 1 AS INTEGER) AS rejected_inputs, CAST(nr - h AS INTEGER) AS rejected_supervised FROM win",
    "dpo_ids": _TALK + f""",
        x AS (SELECT conv_id, h, nc, nr, lower(hex(encode(prefix || regexp_replace(response, '{WS}+$', '') || '<|eos|>'))) AS c, lower(hex(encode(prefix || regexp_replace(rejected, '{WS}+$', '') || '<|eos|>'))) AS r FROM win JOIN fmt USING (conv_id))
        SELECT conv_id, sha256(substr(c, 1, 2 * (nc - 1))) AS chosen_inputs, sha256(substr(c, 2 * h + 1, 2 * (nc - h))) AS chosen_labels, sha256(substr(r, 1, 2 * (nr - 1))) AS rejected_inputs, sha256(substr(r, 2 * h + 1, 2 * (nr - h))) AS rejected_labels FROM x""",
    "padded_pairs": _TALK + """,
        n AS (SELECT (row_number() OVER (ORDER BY conv_id) - 1) // 4 AS batch, * FROM win),
        b AS (SELECT batch, CAST(2 * count(*) AS INTEGER) AS n_rows, greatest(max(nc), max(nr)) - 1 AS longest, least(min(nc), min(nr)) - 1 AS shortest, sum(nc + nr - 2) AS total, sum(nc + nr - 2 * h) AS s FROM n GROUP BY batch),
        w AS (SELECT *, CASE WHEN n_rows = 2 AND longest = shortest THEN longest ELSE (longest + 15) // 16 * 16 END AS width FROM b)
        SELECT batch, CAST(width AS INTEGER) AS width, n_rows, CAST(CASE WHEN shortest < width THEN total ELSE 0 END AS INTEGER) AS tokens, CAST(s AS INTEGER) AS supervised FROM w""",
}
QUERIES = {f.__name__: f for f in (render_conversations, sft_pairs, format_prompts, sft_mask_lengths, sft_ids, next_token_labels, dpo_pairs, dpo_windows, dpo_ids, padded_pairs)}
