"""Evaluation metrics and the merging of metric logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c) -> Column:
    """The number, or NULL where it is missing, NaN or infinite."""
    x = F.col(c).cast("double") if isinstance(c, str) else c
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))


def packed_flops(lengths: Column, active: int, layers: int, width: int) -> Column:
    """6 * active weights * tokens, and 6 * layers * width * squared lengths for causal attention."""
    return 6.0 * active * F.sum(lengths) + 6.0 * layers * width * F.sum(lengths * lengths)


def dpo_stats(df: DataFrame, beta: float, by: list[str]) -> DataFrame:
    """Mean of -log sigmoid(beta * margin) and the share of positive margins. df: chosen, rejected, ref_chosen, ref_rejected."""
    x = F.lit(beta) * ((F.col("chosen") - F.col("rejected")) - (F.col("ref_chosen") - F.col("ref_rejected")))
    loss = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
    return df.withColumn("_x", x).withColumn("_l", loss).groupBy(*by).agg(F.avg("_l").alias("loss"), F.avg((F.col("_x") > 0).cast("int")).alias("reward_accuracy"), F.count("*").alias("pairs"))


def softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def router_stats(df: DataFrame, experts: int, by: list[str]) -> DataFrame:
    """Load and confidence of a top-1 router over a table of logits: an expert a row."""
    p = df.withColumn("p", softmax(F.col("logits"))).withColumn("e", F.array_position("logits", F.array_max("logits")) - 1)
    lse = F.log(F.aggregate(F.transform("logits", lambda x: F.exp(x - F.array_max("logits"))), F.lit(0.0), lambda a, x: a + x)) + F.array_max("logits")
    entropy = -F.aggregate("p", F.lit(0.0), lambda a, x: a + x * F.log(F.greatest(x, F.lit(1e-30))))
    p = p.withColumn("z", lse * lse).withColumn("h", entropy)
    # one row for each expert and token, summed before the exchange
    long = p.select(*by, "e", "z", "h", F.posexplode("p").alias("expert", "q")).where(F.col("expert") < experts)
    out = long.groupBy(*by, "expert").agg(
        F.sum((F.col("e") == F.col("expert")).cast("long")).alias("tokens"), F.count("*").alias("n"), F.avg("q").alias("mean_prob"), F.avg("z").alias("z_loss"), F.avg("h").alias("token_entropy")
    )
    return out.withColumn("fraction", F.col("tokens") / F.col("n"))


def router_summary(stats: DataFrame, experts: int, by: list[str]) -> DataFrame:
    """Variation of the load, entropy of the load, balance loss of each group."""
    f = F.col("fraction")
    return stats.groupBy(*by).agg(
        (F.stddev_pop("tokens") / F.avg("tokens")).alias("load_cv"),
        (-F.sum(F.when(f > 0, f * F.log(f)).otherwise(0.0))).alias("load_entropy"),
        (F.sum(f * F.col("mean_prob")) * experts).alias("aux_loss"), F.max("z_loss").alias("z_loss"),
    )


def top_k(logits: Column, k: int) -> Column:
    """The logits with everything below the k-th largest at minus infinity."""
    edge = F.element_at(F.sort_array(logits, False), F.least(F.lit(k), F.size(logits)))
    return F.transform(logits, lambda x: F.when(x >= edge, x).otherwise(F.lit(float("-inf"))))


# --- logs


def latest(log: DataFrame, order: str, phase: str = "phase", tokens: str = "tokens") -> DataFrame:
    """The last record of each phase and token count; records without a finite count all stay."""
    keyed = log.withColumn("_t", finite(tokens))
    last = Window.partitionBy(phase, "_t").orderBy(F.desc(order))
    return keyed.where("_t IS NOT NULL").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n").unionByName(keyed.where("_t IS NULL")).drop("_t")


def handed_over(log: DataFrame, run: str = "run", order: str = "ord", tokens: str = "tokens") -> DataFrame:
    """Records of each run up to where a later run begins; records without a finite count all stay."""
    firsts = log.where(finite(tokens).isNotNull()).groupBy(run).agg(F.min_by(finite(tokens), order).alias("_first"))
    later = Window.orderBy(run).rowsBetween(1, Window.unboundedFollowing)  # one row a run
    cut = firsts.withColumn("_cut", F.min("_first").over(later)).select(run, "_cut")
    return log.join(F.broadcast(cut), run, "left").where(finite(tokens).isNull() | F.col("_cut").isNull() | (finite(tokens) < F.col("_cut"))).drop("_cut")


def axis(log: DataFrame, order: list, tokens: str = "tokens", step: str = "step") -> DataFrame:
    """Records in order with their x: tokens, else step, else place; a zero counts as missing."""
    from millrace.operators.ordering import running

    key = F.coalesce(finite(tokens), finite(step), F.lit(float("inf")))
    rows = running(log.withColumn("_key", key), ["_key", *order], rank="place").drop("before", "_key")
    return rows.withColumn("x", F.coalesce(F.nullif(finite(tokens), F.lit(0.0)), F.nullif(finite(step), F.lit(0.0)), (F.col("place") + 1).cast("double")))


def phase_changes(log: DataFrame, place: str = "place", phase: str = "phase") -> DataFrame:
    """Records whose phase differs from the record before: a join by place instead of one window over all."""
    before = log.select((F.col(place) + 1).alias(place), F.col(phase).alias("_p"))
    return log.join(before, place).where(~F.col(phase).eqNullSafe(F.col("_p"))).drop("_p")


def newest(checkpoints: DataFrame, keep: int, order: str = "step") -> DataFrame:
    """The checkpoints that retention keeps."""
    return checkpoints.orderBy(F.desc(order)).limit(keep)


def step_loss(microbatches: DataFrame, aux: float, z: float) -> DataFrame:
    """Loss of each optimizer step: token losses weigh by supervised tokens, router terms by all packed ones.

    microbatches: step, lm_loss, supervised, valid, router_aux, router_z.
    """
    lm = F.sum(F.col("lm_loss") * F.col("supervised")) / F.greatest(F.lit(1), F.sum("supervised"))
    router = F.sum((aux * F.col("router_aux") + z * F.col("router_z")) * F.col("valid")) / F.greatest(F.lit(1), F.sum("valid"))
    return microbatches.groupBy("step").agg(lm.alias("lm"), router.alias("router")).withColumn("loss", F.col("lm") + F.col("router"))


def sequence_log_prob(losses: Column, labels: Column, ignore: int = -100) -> Column:
    """Log-probability of a sequence: minus the sum of the token losses whose label counts."""
    told = F.filter(F.arrays_zip(losses.alias("x"), labels.alias("y")), lambda t: t["y"] != ignore)
    return -F.aggregate(told, F.lit(0.0), lambda a, t: a + t["x"])


def with_reference(policy: DataFrame, reference: DataFrame) -> DataFrame:
    """Pairs with the log-probabilities of the fixed reference model, by example. Both: example, chosen, rejected."""
    own = reference.select("example", F.col("chosen").alias("ref_chosen"), F.col("rejected").alias("ref_rejected"))
    return policy.join(own, "example")


def histories(*logs: DataFrame) -> DataFrame:
    """Metric logs one after another; columns that one doesn't have are null there."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def parameter_counts(m: dict) -> dict[str, Column]:
    """Weights of a decoder with grouped attention, routed and shared gated experts. m: Columns or numbers by configuration key.

    Without biases; the head is tied to the embedding.
    """
    head = m["n_embd"] / m["n_head"]
    attention = 2 * m["n_embd"] * m["n_embd"] + 2 * m["n_embd"] * m["n_kv_head"] * head
    expert, shared = 3 * m["n_embd"] * m["expert_hidden_size"], 3 * m["n_embd"] * m["shared_expert_hidden_size"]
    out = {
        "embedding": m["vocab_size"] * m["n_embd"], "attention": m["n_layer"] * attention, "routed_experts": m["n_layer"] * m["n_expert"] * expert,
        "shared_experts": m["n_layer"] * shared, "routers": m["n_layer"] * m["n_embd"] * m["n_expert"], "norms": (2 * m["n_layer"] + 1) * m["n_embd"],
    }
    total = sum(out.values())
    return out | {"total": total, "active": total - m["n_layer"] * (m["n_expert"] - m["top_k"]) * expert}
