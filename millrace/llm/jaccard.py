"""N-gram Jaccard join with multiple global orders.

A document is the set of its distinct five-word shingles (64-bit hashes). Two sets with a
Jaccard similarity of t or more share a token among the first n - ceil(t n) + 1 of each, in
any one global order of all tokens. Several orders are used: all put rarer tokens first
(by the exact number of documents, in powers of two) and break ties by differently mixed
hashes. A pair is a candidate under the first order only if it shares a prefix token there,
and is verified only if it shares prefix tokens under the other orders too.

Frequencies come from one packed exchange: each batch of documents sends every bucket of the
token space the hashes that only one of its documents has, and once, with a count, those that
several have, so a token never weighs more than once a batch. The bucket answers which
tokens other documents share, and how many. A document with more unshared tokens than t allows
has no link and goes no further; what is left of the others are their shared tokens.

Equal sets collapse to one node. Links are found in rounds of stars: in each prefix group one
node is the centre and the others are verified against it only (first the node with the most
widespread tokens, then others by hash). Nodes that a round joins into a component need no more
pairs with each other; after STAR_ROUNDS rounds every pair of a prefix group that still lies in
two components is verified, so that components are exact without all pairs of a group of copies.
A pair is formed only where the places of the token leave enough tokens to come, and in the
last round only at its first common prefix token.

Cases: a null or empty text, or one without words, is the empty set and its own component; with
fewer than five words the whole sequence is one shingle; ids that repeat are rows of their own
with the component of their set; a null id never names a component unless no member has
an id; an empty table gives an empty result; only doc_id and text are read, so other
columns can't clash.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

WORDS = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
ORDERS = 3
STAR_ROUNDS = 3
#: Rows of nodes that every task may have at hand, so that tokens and postings of others aren't moved.
NAMED = 1_000_000
#: Shingles and documents of a batch at most (the last document may exceed the first).
BATCH_TOKENS = 1_000_000
BATCH_DOCS = 50_000
CACHE_ENTRIES = 400_000
_BASE = np.uint64(0xD6E8FEB86659FD93)
_SENT = "bucket int, kind int, batch long, a binary, b binary, c binary, d binary"
_ANSWER = "kind int, batch long, a binary, b binary, c binary, d binary, e binary, f binary"
_PROFILE = "doc_id long, n long, s1 long, s2 long, mass double, tokens array<long>, " + ", ".join(f"p{k} array<long>" for k in range(ORDERS))


class _Words(dict):
    def __missing__(self, word):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str | None, known: dict, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, split), np.uint64, len(split))
    width = min(words, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _BASE + h[k : len(h) - width + 1 + k]
    return np.unique(common.mix64(out, width))


def need(n):
    """Shared shingles that a set of n has with any set it links to, at least."""
    return -(-PERCENT * n // 100)


def _send(buckets: int):
    """Each batch's tokens to their buckets, and its own table by way of one of them."""

    def pack(batch, ids, sets):
        n = np.array([len(s) for s in sets], np.int64)
        tok = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), n)
        own, inverse, count = np.unique(tok, return_inverse=True, return_counts=True)
        one = count[inverse] == 1
        many = own[count > 1]
        with np.errstate(over="ignore"):
            s1 = [int(common.mix64(s, 11).sum().view(np.int64)) if len(s) else 0 for s in sets]
            s2 = [int(np.bitwise_xor.reduce(common.mix64(s, 12)).view(np.int64)) if len(s) else 0 for s in sets]
        csr = (doc[~one].astype(np.uint16), np.searchsorted(many, tok[~one]).astype(np.uint32))
        rows = {k: [] for k in ("bucket", "kind", "batch", "a", "b", "c", "d")}

        def row(*values):
            for k, v in zip(rows, values):
                rows[k].append(v)

        row(batch % buckets, 1, batch, pickle.dumps((ids, n, s1, s2, many, csr)), None, None, None)
        at = (tok[one] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        t, d = tok[one][order], doc[one][order].astype(np.uint16)
        cut = np.searchsorted(at[order], np.arange(buckets + 1))
        sat = (many % np.uint64(buckets)).astype(np.int64)
        sorder = np.argsort(sat, kind="stable")
        s, c = many[sorder], count[count > 1][sorder].astype(np.uint32)
        scut = np.searchsorted(sat[sorder], np.arange(buckets + 1))
        for k in range(buckets):
            if cut[k + 1] > cut[k] or scut[k + 1] > scut[k]:
                p, q = slice(cut[k], cut[k + 1]), slice(scut[k], scut[k + 1])
                row(k, 0, batch, t[p].tobytes(), d[p].tobytes(), s[q].tobytes(), c[q].tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["bucket"], pa.int32()), pa.array(rows["kind"], pa.int32()), pa.array(rows["batch"], pa.int64()), *(pa.array(rows[k], pa.binary()) for k in "abcd")], names=list(rows)
        )

    def send(batches):
        known = _Words()
        ids, sets, size, number = [], [], 0, 0
        for b in batches:
            part = b.column("part")[0].as_py() if b.num_rows else 0
            for doc_id, text in zip(b.column("doc_id"), b.column("text")):
                s = shingles(text.as_py(), known)
                ids.append(doc_id.as_py())
                sets.append(s)
                size += len(s)
                if size >= BATCH_TOKENS or len(ids) >= BATCH_DOCS:
                    yield pack((part << 24) + number, ids, sets)
                    ids, sets, size, number = [], [], 0, number + 1
        if ids:
            yield pack((part << 24) + number, ids, sets)

    return send


def _table(columns: dict, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    pairs = [x.split() for x in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(columns[n], kinds[k]) for n, k in pairs], names=[n for n, _ in pairs])


def _answer(table: pa.Table) -> pa.Table:
    """For each batch: its shared tokens with document numbers and frequency class, and unshared tokens a document."""
    out = {k: [] for k in ("kind", "batch", "a", "b", "c", "d", "e", "f")}
    rows = table.to_pylist()
    mine = [r for r in rows if r["kind"] == 0]
    for r in rows:
        if r["kind"] == 1:
            for k, v in zip(out, (1, r["batch"], r["a"], None, None, None, None, None)):
                out[k].append(v)
    if mine:
        t = [np.frombuffer(r["a"], np.uint64) for r in mine]
        s = [np.frombuffer(r["c"], np.uint64) for r in mine]
        weight = np.concatenate([np.ones(sum(map(len, t)), np.int64), *(np.frombuffer(r["d"], np.uint32).astype(np.int64) for r in mine)])
        own, inverse = np.unique(np.concatenate([*t, *s]), return_inverse=True)
        df = np.bincount(inverse, weight, len(own)).astype(np.int64)
        rare = np.floor(np.log2(df)).astype(np.uint8)[inverse]
        shared = (df > 1)[inverse]
        at, sat = 0, sum(map(len, t))
        for r, a, c in zip(mine, t, s):
            keep, doc = shared[at : at + len(a)], np.frombuffer(r["b"], np.uint16)
            alone = np.bincount(doc[~keep]).astype(np.uint32)
            for k, v in zip(out, (0, r["batch"], a[keep].tobytes(), doc[keep].tobytes(), rare[at : at + len(a)][keep].tobytes(), alone.tobytes(), r["c"], rare[sat : sat + len(c)].tobytes())):
                out[k].append(v)
            at, sat = at + len(a), sat + len(c)
    return _table(out, _ANSWER)


def _profile(table: pa.Table) -> pa.Table:
    """One row a document of the batch; shared tokens and prefixes where a link is still possible."""
    rows = table.to_pylist()
    ids, n, s1, s2, many, csr = pickle.loads(next(r["a"] for r in rows if r["kind"] == 1))
    rows = [r for r in rows if r["kind"] == 0]
    alone = np.zeros(len(ids), np.int64)
    for r in rows:
        a = np.frombuffer(r["d"], np.uint32)
        alone[: len(a)] += a
    join = lambda k, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[k], kind) for r in rows)])
    s = join("e", np.uint64)
    order = np.argsort(s)
    rare = join("f", np.uint8)[order]  # many is sorted, and s holds the same tokens
    tok = np.r_[join("a", np.uint64), many[csr[1]]]
    doc = np.r_[join("b", np.uint16), csr[0]].astype(np.int64)
    freq = np.r_[join("c", np.uint8), rare[csr[1]]]
    order = np.argsort(doc, kind="stable")
    tok, freq = tok[order], freq[order]
    cut = np.searchsorted(doc[order], np.arange(len(ids) + 1))
    prefix = n - need(n) + 1 - alone
    out = {"doc_id": ids, "n": n.tolist(), "s1": s1, "s2": s2, "mass": [], "tokens": [], **{f"p{k}": [] for k in range(ORDERS)}}
    for i in range(len(ids)):
        out["mass"].append(float(freq[cut[i] : cut[i + 1]].sum()) / max(1, int(n[i])))
        if n[i] == 0 or prefix[i] <= 0:
            for k in ("tokens", *(f"p{j}" for j in range(ORDERS))):
                out[k].append(None)
            continue
        t, f = tok[cut[i] : cut[i + 1]], freq[cut[i] : cut[i + 1]]
        out["tokens"].append(t.view(np.int64))
        for k in range(ORDERS):
            first = np.lexsort((common.mix64(t, 100 + k), f))[: prefix[i]]
            out[f"p{k}"].append(t[first].view(np.int64))
    return _table(out, _PROFILE)


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n, signature of every row; tokens and prefixes of those that may have a link.

    The answers are written, so that what was sent to the buckets leaves the disks before the profiles take room.
    """
    buckets = common.buckets(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.spark_partition_id().cast("long").alias("part"))
    answers = common.written(rows.mapInArrow(_send(buckets), _SENT).groupBy("bucket").applyInArrow(_answer, _ANSWER), docs.sparkSession)
    common.drop_shuffles(docs.sparkSession)
    return answers.groupBy("batch").applyInArrow(_profile, _PROFILE)


def components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label: the smallest label of each node's component. links: a, b; labels: node, label."""
    spark = links.sparkSession
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = common.written(both, spark)
    now = labels.join(edges.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("node", "label")
    # pointers: every node points at the smallest node in reach, pointers are doubled each round
    at = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
    while True:
        at = common.written(at, spark)
        reach = edges.join(at, edges["b"] == at["node"]).groupBy("a").agg(F.min("to").alias("m"))
        best = at.join(reach, at["node"] == reach["a"], "left").select("node", F.col("to").alias("old"), F.least("to", F.coalesce("m", "to")).alias("to"))
        jump = at.select(F.col("node").alias("hop"), F.col("to").alias("further"))
        new = common.written(best.join(jump, F.col("to") == F.col("hop"), "left").select("node", "old", F.least("to", F.coalesce("further", "to")).alias("to")), spark)
        if new.where("old <> to").isEmpty():
            break
        at = new.select("node", "to")
    rooted = new.select("node", F.col("to").alias("root")).join(now, "node")
    least = rooted.groupBy("root").agg(F.min("label").alias("label"))
    return rooted.select("node", "root").join(least, "root").select("node", "root", "label")


def _at_hand(df: DataFrame) -> DataFrame:
    """A table for a join, sent to every task as long as it is small enough for that."""
    return F.broadcast(df) if df.count() <= NAMED else df


def _named(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of the pairs; the tokens of all others stay where they are as long as the pairs are few."""
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return nodes.join(_at_hand(named), "node", "left_semi")


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that share prefix tokens under every order and are similar enough."""
    nodes = _named(pairs, nodes)
    names = ["n", "tokens", *(f"p{k}" for k in range(1, ORDERS))]
    left = nodes.select(F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in names))
    right = nodes.select(F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in names))
    met = pairs.join(right, "b").join(left, "a")
    for k in range(1, ORDERS):
        met = met.where(F.arrays_overlap(f"p{k}_a", f"p{k}_b"))
    met = met.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("i"))
    return met.where(100 * F.col("i") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("i"))).select("a", "b")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    profiled = profiles(docs)
    whole = common.written(profiled.withColumn("node", F.monotonically_increasing_id()), spark)
    common.discard(profiled)
    common.drop_shuffles(spark)
    rows = common.written(whole.select("doc_id", "n", "s1", "s2", "node", F.col("tokens").isNotNull().alias("may")), spark)
    some = rows.where("n > 0")
    sets = common.written(some.where("may").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("label"), F.min("node").alias("node")), spark)
    # tokens stay in their files; of equal sets, only the representative's prefix moves, and later what pairs name
    nodes = whole.drop("doc_id", "s1", "s2").where(F.size("p0") > 0)
    heads = common.written(nodes.select("node", "n", "mass", F.size("tokens").alias("shared"), "p0").join(sets.select("node"), "node", "left_semi"), spark)
    # rest: tokens of the set from this one on, in the first order (unshared ones come before all others)
    postings = heads.select("node", "n", "mass", "shared", F.posexplode("p0").alias("place", "token"))
    postings = postings.select("node", "n", "mass", "token", "place", (F.col("shared") - F.col("place")).alias("rest"))
    # tokens that only one node has in its prefix lead to no pair
    busy = postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    postings = common.written(postings.join(busy, "token", "left_semi"), spark)
    common.drop_shuffles(spark)
    close = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT) & ((100 + PERCENT) * F.least("rest_a", "rest_b") >= PERCENT * (F.col("n_a") + F.col("n_b")))
    links, done, comp = None, None, None
    for turn in range(STAR_ROUNDS + 1):
        own = postings.withColumn("root", F.col("node")) if comp is None else postings.join(_at_hand(comp.select("node", "root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
        if comp is not None:
            # written, as are centres below, so that a join on a hot token stands alone and can be split
            mixed = common.written(own.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token"), spark)
            own = common.written(own.join(mixed, "token", "left_semi"), spark)
            if own.isEmpty():
                break
        last = turn == STAR_ROUNDS
        side = lambda x, *more: [F.col(c).alias(f"{c}_{x}" if c != "node" else x) for c in ("node", "n", "rest", "root", *more)]
        if last:
            own = own.join(heads.select("node", "p0"), "node").withColumn("past", F.slice("p0", 1, F.col("place")))
            centre, right = own.select("token", *side("a", "past")), own.select("token", *side("b", "past"))
            apart = (F.col("a") < F.col("b")) & ~F.arrays_overlap("past_a", "past_b")
        else:
            first = F.struct(-F.col("mass"), "node") if turn == 0 else F.xxhash64("node", "token", F.lit(turn))
            centre = common.written(own.groupBy("token").agg(F.min_by(F.struct(*side("a")), first).alias("c")).select("token", "c.*"), spark)
            right, apart = own.select("token", *side("b")), F.col("a") != F.col("b")
        pairs = right.join(centre, "token").where(close & (F.col("root_a") != F.col("root_b")) & apart)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = common.written(pairs, spark)
        found = common.written(_verified(pairs, nodes), spark)
        common.drop_shuffles(spark)
        links = found if links is None else links.unionByName(found)
        done = pairs if done is None else done.unionByName(pairs)
        if not found.isEmpty():
            comp = common.written(components(links, sets.select("node", "label")), spark)
    label = sets.select("n", "s1", "s2", "node", F.col("label").alias("own"))
    if comp is not None:
        label = label.join(comp.select("node", "label"), "node", "left")
    else:
        label = label.withColumn("label", F.lit(None).cast("long"))
    label = label.select("n", "s1", "s2", F.coalesce("label", "own").alias("component"))
    return rows.select("doc_id", "n", "s1", "s2").join(label, ["n", "s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id (null ids last), of equal ids the one read first.

    docs must be read alike each time, as files are.
    """
    keyed = docs.withColumn("_uid", F.monotonically_increasing_id())
    groups = jaccard_components(keyed.select(F.col("_uid").alias("doc_id"), "text")).select(F.col("doc_id").alias("_uid"), "component_id")
    ids = keyed.select("_uid", F.col("doc_id").alias("_id")).join(groups, "_uid")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_uid")).alias("f")).select(F.col("f._uid").alias("_uid"))
    return keyed.join(first, "_uid", "left_semi").drop("_uid")


def op9(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents"))
