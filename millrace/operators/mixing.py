"""Splits, permutations, weighted mixing and packing over document lengths.

Everything here works on one row a document or piece; token ids are joined when a batch is built.
"""

from __future__ import annotations

import math
import uuid
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordering import running
from millrace.session import checkpoint_folder

SEED_STEP = 1009


def val_count(n, wanted: int):
    return F.least(F.greatest(F.lit(wanted), F.lit(0)), F.greatest(n - 1, F.lit(0)))


def is_val(rank: Column, n: Column, seed: Column, wanted: int) -> Column:
    """Whether a rank lies in the cyclic validation window that begins at seed mod n."""
    return F.pmod(rank - seed, n) < val_count(n, wanted)


def multiplier(n: int, seed: int) -> int:
    """The first number coprime to n among every second one from 2 * seed + 1."""
    if n <= 1:
        return 1
    m = (2 * seed + 1) % n or 1
    while math.gcd(m, n) != 1:
        m = (m + 2) % n or 1
    return m


def split(docs: DataFrame, corpora: list[dict], order: list[str], val_docs: int, seed: int) -> DataFrame:
    """docs with corpus_ord, weight, rank, n, is_val, train_rank, position.

    corpora: name, weight (and val_docs) of each corpus, in order; docs has a column corpus. position is
    where a training document comes in its corpus's no-replacement order.
    """
    spark = docs.sparkSession
    names = spark.createDataFrame([(c["name"], i, float(c.get("weight", 1)), seed + SEED_STEP * i, int(c.get("val_docs", val_docs))) for i, c in enumerate(corpora)], "corpus string, corpus_ord int, weight double, seed long, wanted int")
    # counts of corpora: as many rows as the manifest has
    sizes = {r.corpus: r.n for r in docs.groupBy("corpus").agg(F.count("*").alias("n")).collect()}
    plan = []
    for i, c in enumerate(corpora):
        n, s = sizes.get(c["name"], 0), seed + SEED_STEP * i
        t = n - min(max(0, int(c.get("val_docs", val_docs))), max(0, n - 1))
        m = multiplier(t, s)
        plan.append((c["name"], n, max(t, 1), pow(m, -1, t) if t > 1 else 0, s % t if t else 0))
    steps = spark.createDataFrame(plan, "corpus string, n long, t long, inverse long, shift long")
    ranked = running(docs, order, by=["corpus"]).drop("before")
    out = ranked.join(F.broadcast(names.join(steps, "corpus")), "corpus").withColumn("is_val", F.pmod(F.col("rank") - F.col("seed"), F.col("n")) < F.least(F.greatest("wanted", F.lit(0)), F.greatest(F.col("n") - 1, F.lit(0))))
    # validation ranks before this one: the window wraps around at most once
    start, v = F.pmod("seed", "n"), F.col("n") - F.col("t")
    end = start + v
    beyond = F.greatest(F.col("rank") - start, F.lit(0))
    inside = F.when(end > F.col("n"), F.least(F.col("rank"), end - F.col("n")) + beyond).otherwise(F.least(beyond, v))
    out = out.withColumn("train_rank", F.when(~F.col("is_val"), F.col("rank") - inside))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    place = F.pmod(exact("inverse") * F.pmod(exact("train_rank") - exact("shift"), exact("t")), exact("t")).cast("long")
    return out.withColumn("position", F.when(~F.col("is_val"), place)).drop("wanted", "inverse", "shift", "seed", "t")


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """Documents cut into pieces of at most ``longest`` predictions; neighbours share one token."""
    p = F.col("n_tokens") - 1
    cut = docs.where("n_tokens >= 2").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((p - 1) / longest).cast("long"))))
    return cut.withColumn("start", F.col("piece") * longest).withColumn("k", F.least(F.lit(longest).cast("long"), p - F.col("start")))


def integer_weights(corpora: list[dict]) -> dict[str, int]:
    """For each corpus how often its progress counts, so that tags are exact integers: common multiple over weight."""
    w = {c["name"]: Fraction(str(c["weight"])) for c in corpora}
    top = math.lcm(*(x.numerator for x in w.values()))
    scaled = {k: Fraction(top) / v for k, v in w.items()}
    bottom = math.lcm(*(x.denominator for x in scaled.values()))
    return {k: int(v * bottom) for k, v in scaled.items()}


def tagged(parts: DataFrame, corpora: list[dict], late: dict[str, int] | None = None) -> DataFrame:
    """Pieces with their start tag: predictions of the corpus before, over its weight; late corpora begin at a tag of their own."""
    scale = integer_weights(corpora)
    factors = parts.sparkSession.createDataFrame([(k, v, int((late or {}).get(k, 0))) for k, v in scale.items()], "corpus string, factor long, head long")
    ordered = running(parts, ["position", "piece"], F.col("k"), by=["corpus"], rank="_rank").drop("_rank")
    return ordered.join(F.broadcast(factors), "corpus").withColumn("tag", (F.col("before") * F.col("factor") + F.col("head")).cast("long")).drop("factor", "head")


def packed(parts: DataFrame, budget: int, partial: bool = False) -> DataFrame:
    """Pieces in tag order, cut at multiples of budget: microbatch, slot, offset in the document, predictions.

    A last batch that isn't full goes, unless ``partial`` (supervised training uses it up).
    """
    placed = running(parts.drop("before"), ["tag", "corpus_ord", "position", "piece"], F.col("k"), rank="_rank", before="at").drop("_rank")
    spread = placed.withColumn("microbatch", F.explode(F.sequence(F.floor(F.col("at") / budget).cast("long"), F.floor((F.col("at") + F.col("k") - 1) / budget).cast("long"))))
    begin = F.greatest(F.col("at"), F.col("microbatch") * budget)
    end = F.least(F.col("at") + F.col("k"), (F.col("microbatch") + 1) * budget)
    out = spread.withColumn("slot", begin - F.col("microbatch") * budget).withColumn("predictions", end - begin).withColumn("offset", F.col("start") + begin - F.col("at"))
    full = F.sum("predictions").over(Window.partitionBy("microbatch"))  # at most budget rows a group
    return out.withColumn("_full", full).where((F.col("_full") == budget) | F.lit(partial)).drop("_full", "at", "k", "start", "piece")


def boundaries(batches: DataFrame, budget: int) -> DataFrame:
    """cu_seqlens, longest piece and valid length of each microbatch."""
    starts = F.array_sort(F.collect_list("slot"))
    return batches.groupBy("microbatch").agg(F.concat(starts, F.array(F.lit(budget).cast("long"))).alias("cu_seqlens"), F.max("predictions").alias("max_seqlen"), F.sum("predictions").alias("valid_len"))


def build(batches: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    """input_ids, targets, position_ids of each microbatch: ids are joined last. ids: key, ids (array)."""
    cut = batches.join(ids, key).select(
        "microbatch", "slot",
        F.slice("ids", F.col("offset").cast("int") + 1, F.col("predictions").cast("int")).alias("x"),
        F.slice("ids", F.col("offset").cast("int") + 2, F.col("predictions").cast("int")).alias("y"),
        F.sequence(F.lit(0).cast("long"), F.col("predictions") - 1).alias("p"),
    )
    rows = F.array_sort(F.collect_list(F.struct("slot", "x", "y", "p")))
    flat = lambda f: F.flatten(F.transform("rows", lambda r: r[f]))
    return cut.groupBy("microbatch").agg(rows.alias("rows")).select("microbatch", flat("x").alias("input_ids"), flat("y").alias("targets"), flat("p").alias("position_ids"))


def cyclic(val: DataFrame, rounds: int) -> DataFrame:
    """A validation stream that begins again: each document once a round, in rank order."""
    return val.where("n_tokens >= 2").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))


def rounds_for(val: DataFrame, predictions: int) -> int:
    """How often a validation stream must begin again to give so many predictions; an error if no document has any."""
    total = val.where("n_tokens >= 2").agg(F.sum(F.col("n_tokens") - 1)).first()[0]
    if not total:
        raise ValueError("no validation document has two tokens")
    return -(-predictions // total)


def sft_packed(stream: DataFrame, order: list[str], budget: int, longest: int) -> DataFrame:
    """Examples one after another in microbatches of ``budget`` predictions; a cut example goes on in the next one.

    stream: the columns of order, example, n_tokens (at least 2 to count). Gives microbatch, slot, example, offset,
    predictions (at most ``longest``); a last batch that isn't full goes.
    """
    k = (F.col("n_tokens") - 1).cast("long")
    placed = running(stream.where("n_tokens >= 2").withColumn("k", k), order, F.col("k"), rank="_rank", before="at").drop("_rank")
    last = F.floor((F.col("at") + F.col("k") - 1) / budget)
    spread = placed.withColumn("microbatch", F.explode(F.sequence(F.floor(F.col("at") / budget).cast("long"), last.cast("long"))))
    begin = F.greatest(F.col("at"), F.col("microbatch") * budget)
    end = F.least(F.col("at") + F.col("k"), (F.col("microbatch") + 1) * budget)
    spread = spread.withColumn("_begin", begin).withColumn("_end", end)
    spread = spread.withColumn("_begin", F.explode(F.sequence(F.col("_begin"), F.col("_end") - 1, F.lit(longest).cast("long"))))
    out = spread.withColumn("predictions", F.least(F.lit(longest).cast("long"), F.col("_end") - F.col("_begin")))
    out = out.withColumn("slot", F.col("_begin") - F.col("microbatch") * budget).withColumn("offset", F.col("_begin") - F.col("at"))
    full = F.sum("predictions").over(Window.partitionBy("microbatch"))  # at most budget rows a group
    return out.withColumn("_full", full).where(F.col("_full") == budget).drop("_full", "_begin", "_end", "at", "k")


def committed(batches: DataFrame, handed_off: int) -> DataFrame:
    """What each corpus has given in the microbatches that were handed off; those prepared ahead of them don't count."""
    return batches.where(F.col("microbatch") < handed_off).groupBy("corpus").agg(F.sum("predictions").cast("long").alias("emitted"))


def _replay(docs: dict[str, list], done: dict[str, int], scale: dict[str, int], heads: dict[str, int], marks: list[int], base: int, budget: int, longest: int) -> tuple[list, list[dict]]:
    """The queue from the predictions that each corpus has given: pieces (start tag, corpus, doc, offset, predictions, at), and what
    had been given when the least tag reached each mark. docs: (first prediction in the corpus, predictions, doc) in order; base: what had been
    given before the first batch.

    A corpus's place follows from what it has given, and the place in the batches from the sum of it: there is no other state.
    """
    queues = {c: [d for d in reversed(rows) if d[0] + d[1] > done[c]] for c, rows in docs.items()}
    at, out, states, waiting = sum(done.values()) - base, [], [], list(marks)
    tag = lambda c: heads[c] + done[c] * scale[c]
    while True:
        live = [c for c in queues if queues[c]]
        least = min(map(tag, live), default=math.inf)
        while waiting and least >= waiting[0]:
            states.append(dict(done))
            waiting.pop(0)
        if not waiting:
            return out, states
        c = next(c for c in live if tag(c) == least)
        begin, k, doc = queues[c][-1]
        n = min(longest, budget - at % budget, begin + k - done[c])
        out.append((least, c, doc, done[c] - begin, n, at))
        done[c] += n
        at += n
        if done[c] == begin + k:
            queues[c].pop()


def pack_exact(parts_of: DataFrame, corpora: list[dict], budget: int, longest: int, chunk: int = 1 << 22, warm: int | None = None, given: dict[str, int] | None = None, heads: dict[str, int] | None = None) -> DataFrame:
    """The queue itself, piece by piece, over lengths only: corpus, doc_id, offset, predictions, microbatch, slot. Equal to one fold over all documents.

    Start tags never fall, so the queue is cut at multiples of a tag into stretches of about ``chunk`` predictions, which tasks replay
    apart. A stretch doesn't know where its first pieces begin, as that depends on all cuts before: it starts ``warm`` predictions earlier at
    the begin of documents, by when it has nearly always met the true course, and reports what each corpus had given at both ends. The driver
    compares these (a row a stretch and corpus); stretches whose begin isn't their forerunner's end are replayed from there until all ends meet. Every round
    makes one more stretch certain at least, and ties go to the earlier corpus, so the result doesn't depend on how it was cut.

    given: what each corpus has given in batches that were handed over (``committed``); the queue goes on there, with batch 0. Batches
    prepared beyond them are forgotten, so the next ones may have another budget or length, or further corpora. heads: the tags at which corpora
    that came later begin.
    """
    import pandas as pd

    spark = parts_of.sparkSession
    scale, names = integer_weights(corpora), [c["name"] for c in corpora]
    per = max(1, chunk * math.prod(scale.values()) // sum(math.prod(scale.values()) // v for v in scale.values()))  # tags of a stretch
    lead = per * (warm if warm is not None else max(8 * budget, chunk // 16)) // chunk
    start = {n: (given or {}).get(n, 0) for n in names}
    begin_at = {n: (heads or {}).get(n, 0) for n in names}
    docs = running(parts_of.where("n_tokens >= 2").select("corpus", "doc_id", "position", (F.col("n_tokens") - 1).cast("long").alias("k")), ["position"], F.col("k"), by=["corpus"], rank="_rank").drop("_rank", "position")
    totals = {n: 0 for n in names} | {r.corpus: r.k for r in docs.groupBy("corpus").agg(F.sum("k").alias("k")).collect()}  # a row a corpus
    live = [n for n in names if start[n] < totals[n]]
    if not live:
        return spark.createDataFrame([], "corpus string, doc_id long, offset long, predictions long, microbatch long, slot long")
    factors = spark.createDataFrame([(k, v, begin_at[k], start[k]) for k, v in scale.items()], "corpus string, factor long, head long, given long")
    left = docs.join(F.broadcast(factors), "corpus").where(F.col("before") + F.col("k") > F.col("given"))  # documents that were used up are over
    first = F.floor(F.greatest(F.col("head") + F.col("before") * F.col("factor") - 1, F.lit(0)) / per)
    last = F.floor((F.col("head") + (F.col("before") + F.col("k")) * F.col("factor") - 1 + lead) / per)
    placed = left.withColumn("stretch", F.explode(F.sequence(first.cast("long"), last.cast("long")))).drop("factor", "head", "given")
    initial = min(begin_at[n] + start[n] * scale[n] for n in live) // per
    ends = max(begin_at[n] + totals[n] * scale[n] for n in live)
    placed = placed.where((F.col("stretch") < -(-ends // per)) & (F.col("stretch") >= initial))
    folder = f"{checkpoint_folder(spark)}/queue-{uuid.uuid4().hex}"
    placed.write.option("compression", "zstd").parquet(f"{folder}/placed")
    placed = spark.read.schema(placed.schema).parquet(f"{folder}/placed")
    fields = "stretch long, corpus string, doc_id long, offset long, predictions long, microbatch long, slot long, given array<long>"

    def replay(known: dict[int, list[int]]):
        def fold(rows: pd.DataFrame) -> pd.DataFrame:
            i = int(rows.stretch.iloc[0])
            own = {c: sorted(map(tuple, rows.loc[rows.corpus == c, ["before", "k", "doc_id"]].values.tolist())) for c in names}
            marks = [i * per, (i + 1) * per]
            if i in known:
                done = dict(zip(names, known[i]))
            else:  # from the begin of the documents that are under way at the earlier tag; a corpus without any is over
                done = {c: max(start[c], own[c][0][0]) if own[c] else start[c] if begin_at[c] + start[c] * scale[c] >= marks[1] else totals[c] for c in names}
            pieces, states = _replay(own, done, scale, begin_at, marks, sum(start.values()), budget, longest)
            out = [(i, c, d, o, n, at // budget, at % budget, None) for tag, c, d, o, n, at in pieces if tag >= marks[0]]
            out += [(i, None, None, None, None, None, None, [s[c] for c in names]) for s in states]
            return pd.DataFrame(out, columns=[f.split()[0] for f in fields.split(", ")]).astype({c: "Int64" for c in ("doc_id", "offset", "predictions", "microbatch", "slot")})

        return fold

    known: dict[int, list[int]] = {initial: [start[c] for c in names]}
    found, runs, todo = {}, {}, None
    while todo is None or todo:
        turn = max(runs.values(), default=-1) + 1
        rows = placed if todo is None else placed.where(F.col("stretch").isin(todo))
        # rows of documents that end before the stretch's own lead are not there, so a task holds about chunk predictions of each corpus at most
        rows.groupBy("stretch").applyInPandas(replay(known), fields).write.option("compression", "zstd").parquet(f"{folder}/turn-{turn}")
        states = spark.read.schema(fields).parquet(f"{folder}/turn-{turn}").where("given IS NOT NULL").select("stretch", "given").collect()
        for i in {r.stretch for r in states}:
            found[i] = sorted(r.given for r in states if r.stretch == i)  # what was given at the begin and at the end
            runs[i] = turn
        order = sorted(found)  # stretches without a document, between a corpus's end and a later one's head, are not there
        todo = [i for h, i in zip(order, order[1:]) if found[i][0] != found[h][1]]
        known |= {i: found[h][1] for h, i in zip(order, order[1:]) if i in todo}
    which = spark.createDataFrame(list(runs.items()), "stretch long, turn int")
    pieces = None
    for turn in sorted(set(runs.values())):
        part = spark.read.schema(fields).parquet(f"{folder}/turn-{turn}").withColumn("turn", F.lit(turn))
        pieces = part if pieces is None else pieces.unionByName(part)
    full = (sum(totals.values()) - sum(start.values())) // budget
    return pieces.where("given IS NULL").join(F.broadcast(which), ["stretch", "turn"]).where(F.col("microbatch") < full).select("corpus", "doc_id", "offset", "predictions", "microbatch", "slot")
