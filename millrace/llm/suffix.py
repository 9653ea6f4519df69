"""Removal of repeated long passages through a run-length compressed suffix index.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document with
a smaller id, or earlier in the same one. Index construction follows prefix-free parsing:

1. Each text is parsed at anchors, the places where the hash of GRAM bytes is the (leftmost)
   least of all in some window of LENGTH bytes. Every window belongs to one anchor, and equal
   windows to equal anchors at equal offsets. An anchor with the bytes of its windows is a phrase.
2. One packed exchange brings the occurrences of each anchor together. A phrase's later
   occurrences repeat its first one whole. Anchors with a single phrase have no more to tell:
   in the index their rows would form one run. Phrases whose anchor has others ("branching")
   enter the index, once each, at their first occurrence.
3. Branching phrases are dealt to shards by anchor. Each shard builds the run-compressed
   Burrows-Wheeler transform with sampled run ends, streams its phrases through it for matching
   statistics and marks windows whose class has an earlier occurrence (``runindex``).
   Anchors with more than INDEX_PHRASES phrases would make one shard too large; their windows are
   grouped by 128-bit hashes instead, with partial sums before the exchange.
4. All marked intervals of a document meet its text, which is cut.

What a batch repeats itself is settled there, and an anchor that branches in a batch is sent on
as phrases, so that a passage that many documents hold weighs once a batch in any bucket.

Cases: a null text is empty; texts shorter than LENGTH keep everything; of rows that repeat an
id the one read first counts as earlier; a null id counts as larger than any other; cutting
may leave bytes that are no UTF-8, so results speak of bytes; an empty table gives an empty
result; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common, runindex

LENGTH = 100
GRAM = 32
#: Grams of a window.
WINDOW = LENGTH - GRAM + 1
#: Bytes of a batch, and of a stretch of it that is hashed at once.
BATCH_BYTES = 4 << 20
STRETCH = 1 << 19
BATCH_DOCS = 60_000
#: Phrases that an anchor may have in a batch before they are sent one by one.
LOCAL_PHRASES = 8
#: Phrases that one anchor may bring into a shard.
INDEX_PHRASES = 20_000
#: Bytes of branching phrases that a shard is meant to hold.
SHARD_BYTES = 2 << 20
_LAST = np.iinfo(np.int64).max
_SENT = "bucket int, kind int, batch long, a binary"
_ANSWER = "batch long, kind int, a binary"
_DOC = "uid long, doc_id long, gone_from array<int>, gone_to array<int>, anchor array<long>, at array<int>, back array<int>, size array<int>"

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 1 << 63, (2, 256), np.uint64)  # a random number for each byte, for two hashes
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b):
        out = np.full(n, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    with np.errstate(over="ignore"):
        return run(base), run(pow(base, -1, 1 << 64))


_CACHE: dict = {}


def _tables():
    if not _CACHE:
        _CACHE["p"] = [_powers(b, STRETCH + 2 * LENGTH) for b in _ODD]
    return _CACHE["p"]


def _sums(raw: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums from which the polynomial hash of any substring follows."""
    with np.errstate(over="ignore"):
        return np.r_[np.uint64(0), np.cumsum(_BYTE[which][raw] * _tables()[which][0][: len(raw)])]


def _hash(sums: np.ndarray, which: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return common.mix64((sums[end] - sums[begin]) * _tables()[which][1][begin], which)


def parse(raw: np.ndarray):
    """Anchors of a stretch: hash, place, first window, windows, phrase hash."""
    n = len(raw) - LENGTH + 1
    empty = [np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64)]
    if n <= 0:
        return empty
    one, two = _sums(raw, 0), _sums(raw, 1)
    g = np.arange(len(raw) - GRAM + 1)
    gram = _hash(one, 0, g, g + GRAM)
    low = np.uint64((1 << 20) - 1)
    key = (gram & ~low) | g.astype(np.uint64)  # the leftmost of equal ones is least
    # least of every WINDOW neighbours: from the running minima of blocks, forwards and backwards
    blocks = -(-len(key) // WINDOW)
    padded = np.full(blocks * WINDOW, np.uint64(2**64 - 1))
    padded[: len(key)] = key
    table = padded.reshape(blocks, WINDOW)
    ahead = np.minimum.accumulate(table, 1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    place = (np.minimum(back[:n], ahead[WINDOW - 1 : WINDOW - 1 + n]) & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[first, n])
    at = place[first]
    return gram[at], at, first, count, _hash(two, 1, first, first + count + LENGTH - 1)


def _occurrences(texts: list[bytes]):
    """Of a batch: document number, anchor, place, bytes before the anchor, windows, phrase hash."""
    out = []

    def add(doc_of, begin_of, raw, offset):
        gram, at, first, count, phrase = parse(raw)
        out.append((doc_of(first), gram, at + offset - begin_of(first), at - first, count, phrase))

    lengths = np.array([len(t) for t in texts], np.int64)
    group, size = [], 0

    def flush():
        nonlocal group, size
        if group:
            raw = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
            ends = np.cumsum(lengths[group])
            gram, at, first, count, phrase = parse(raw)
            # windows that cross from one document into the next don't exist: cut each phrase at its document's end
            doc = np.searchsorted(ends, first, "right")
            stop = np.minimum(first + count, ends[np.minimum(doc, len(ends) - 1)] - LENGTH + 1)
            keep = stop > first
            # a phrase may also begin in one document and go on in the next
            spill = np.searchsorted(ends, first + count - 1, "right") > doc
            parts = [(doc[keep], first[keep], stop[keep], at[keep], gram[keep])]
            for i in np.flatnonzero(spill).tolist():
                for d in range(int(doc[i]) + 1, int(np.searchsorted(ends, first[i] + count[i] - 1, "right")) + 1):
                    a, z = int(ends[d - 1]), min(int(first[i] + count[i]), int(ends[d]) - LENGTH + 1)
                    if z > a:
                        parts.append(tuple(np.array([v], t) for v, t in ((d, np.int64), (a, np.int64), (z, np.int64), (at[i], np.int64), (gram[i], np.uint64))))
            doc, first, stop, at, gram = (np.concatenate(x) for x in zip(*parts))
            two = _sums(raw, 1)
            out.append((np.array(group)[doc], gram, at - (ends - lengths[group])[doc], at - first, stop - first, _hash(two, 1, first, stop + LENGTH - 1)))
        group, size = [], 0

    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        if len(text) > STRETCH // 2:
            flush()
            for a in range(0, len(text) - LENGTH + 1, STRETCH):
                raw = np.frombuffer(text[a : a + STRETCH + LENGTH - 1], np.uint8)
                add(lambda f, i=i: np.full(len(f), i), lambda f: 0, raw, a)
            continue
        if size + len(text) > STRETCH:
            flush()
        group.append(i)
        size += len(text)
    flush()
    if not out:
        out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64)))
    return [np.concatenate(x) for x in zip(*out)]


def _send(buckets: int):
    def pack(batch, uids, ids, texts):
        doc, gram, at, back, count, phrase = _occurrences(texts)
        order_id = np.array([_LAST if i is None else i for i in ids], np.int64)
        o = np.lexsort((at - back, doc, order_id[doc]))
        doc, gram, at, back, count, phrase = (x[o] for x in (doc, gram, at, back, count, phrase))
        # phrases that the batch repeats: all but the first go
        with np.errstate(over="ignore"):
            both = common.mix64(gram ^ common.mix64(phrase, 5), 6)
        o = np.argsort(both, kind="stable")
        new = np.r_[True, both[o][1:] != both[o][:-1]] if len(o) else np.zeros(0, bool)
        later = np.sort(o[~new])
        here = np.sort(o[new])
        gone = (doc[later].astype(np.uint16), (at - back)[later].astype(np.int32), (at - back + count)[later].astype(np.int32) + LENGTH - 1)
        # anchors with many phrases branch for certain: their phrases go by themselves, the anchor once
        _, inverse, times = np.unique(gram[here], return_inverse=True, return_counts=True)
        many = times[inverse] >= LOCAL_PHRASES
        rows = [(int(batch % buckets), 1, batch, pickle.dumps((uids, ids, gone)))]
        hot = np.unique(gram[here[many]])
        key = np.where(many, both[here], gram[here])
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        o = np.argsort(bucket, kind="stable")
        here, many = here[o], many[o]
        cut = np.searchsorted(bucket[o], np.arange(buckets + 1))
        hot_bucket = (hot % np.uint64(buckets)).astype(np.int64)
        for k in np.unique(np.r_[bucket, hot_bucket]).tolist():
            w, h = here[cut[k] : cut[k + 1]], many[cut[k] : cut[k + 1]]
            rows.append((k, 0, batch, b"".join(x.tobytes() for x in (
                np.array([len(w), (hot_bucket == k).sum()], np.int64), gram[w], phrase[w], order_id[doc[w]], doc[w].astype(np.uint16), at[w].astype(np.int32), back[w].astype(np.uint8), count[w].astype(np.uint8), h, hot[hot_bucket == k]))))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "kind", "batch", "a"])

    def send(batches):
        uids, ids, texts, size, number = [], [], [], 0, TaskContext.get().partitionId() << 24
        for b in batches:
            for uid, doc_id, text in zip(b.column("uid").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                raw = (text.as_py() or "").encode()
                uids.append(uid)
                ids.append(doc_id)
                texts.append(raw)
                size += len(raw)
                if size >= BATCH_BYTES or len(ids) >= BATCH_DOCS:
                    yield pack(number, uids, ids, texts)
                    uids, ids, texts, size, number = [], [], [], 0, number + 1
        if ids:
            yield pack(number, uids, ids, texts)

    return send


_KINDS = (np.uint64, np.uint64, np.int64, np.uint16, np.int32, np.uint8, np.uint8, np.bool_)


def _unpack(raw: bytes) -> list[np.ndarray]:
    n, hot = np.frombuffer(raw, np.int64, 2).tolist()
    out, at = [], 16
    for kind in _KINDS:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return [*out, np.frombuffer(raw, np.uint64, hot, at)]


def _answer(table: pa.Table) -> pa.Table:
    """For each batch: occurrences that repeat an earlier phrase, and branching first occurrences."""
    rows = table.to_pylist()
    out = [(r["batch"], 1, r["a"]) for r in rows if r["kind"] == 1]
    mine = [r for r in rows if r["kind"] == 0]
    if mine:
        cells = [_unpack(r["a"]) for r in mine]
        gram, phrase, ids, doc, at, back, count, many = (np.concatenate([c[k] for c in cells]) for k in range(8))
        hot = np.unique(np.concatenate([c[8] for c in cells]))
        batch = np.repeat(np.array([r["batch"] for r in mine], np.int64), [len(c[0]) for c in cells])
        o = np.lexsort((at.astype(np.int64) - back, doc, batch, ids, phrase, gram))
        g, p = gram[o], phrase[o]
        anchor = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
        new = anchor | np.r_[True, p[1:] != p[:-1]] if len(g) else anchor
        number = np.cumsum(anchor) - 1
        branches = np.bincount(number[new], minlength=len(anchor) and number[-1] + 1)[number] > 1 if len(g) else anchor
        branches |= many[o] | np.isin(g, hot)
        later, first = o[~new], o[new & branches]
        for kind, w in ((0, later), (2, first)):
            w = w[np.argsort(batch[w], kind="stable")]
            own, begin = np.unique(batch[w], return_index=True)
            for b, part in zip(own.tolist(), np.split(w, begin[1:])):
                start = at[part].astype(np.int32) - back[part]
                if kind == 0:
                    out.append((b, 0, pickle.dumps((doc[part], start, start + count[part].astype(np.int32) + LENGTH - 1))))
                else:
                    out.append((b, 2, pickle.dumps((doc[part], gram[part], at[part], back[part], count[part]))))
    return pa.Table.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["batch", "kind", "a"])


def _documents(table: pa.Table) -> pa.Table:
    """One row a document of the batch: intervals to remove and branching phrases."""
    rows = table.to_pylist()
    own = [r["a"] for r in rows if r["kind"] == 1]
    if len(own) != 1:
        raise RuntimeError(f"{len(own)} lists of documents for one batch")
    uids, ids, gone = pickle.loads(own[0])
    intervals = [gone, *(pickle.loads(r["a"]) for r in rows if r["kind"] == 0)]
    doc, begin, end = (np.concatenate([x[k] for x in intervals]) for k in range(3))
    o = np.lexsort((begin, doc))
    doc, begin, end = doc[o], begin[o], end[o]
    cut = np.searchsorted(doc, np.arange(len(ids) + 1))
    branch = [pickle.loads(r["a"]) for r in rows if r["kind"] == 2] or [tuple(np.zeros(0, t) for t in (np.uint16, np.uint64, np.int32, np.uint8, np.uint8))]
    bdoc, *rest = (np.concatenate([x[k] for x in branch]) for k in range(5))
    o = np.argsort(bdoc, kind="stable")
    bdoc, rest = bdoc[o], [x[o] for x in rest]
    bcut = np.searchsorted(bdoc, np.arange(len(ids) + 1))
    out = {k: [] for k in ("uid", "doc_id", "gone_from", "gone_to", "anchor", "at", "back", "size")}
    for i in range(len(ids)):
        a, z, p, q = cut[i], cut[i + 1], bcut[i], bcut[i + 1]
        if a == z and p == q:
            continue
        f, t = merged(begin[a:z], end[a:z])
        for k, v in zip(out, (uids[i], ids[i], f, t, rest[0][p:q].view(np.int64), *(x[p:q].astype(np.int32) for x in rest[1:]))):
            out[k].append(v)
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted intervals joined where they touch."""
    if not len(begin):
        return begin.astype(np.int32), end.astype(np.int32)
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
    return begin[new].astype(np.int32), reach[np.r_[new[1:], len(end)] - 1].astype(np.int32)


def _runs(flags: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Byte intervals of the flagged windows."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [(start + a, start + z + LENGTH - 1) for a, z in edge.reshape(-1, 2).tolist()]


def _phrases(batches):
    """The bytes of every branching phrase."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            raw = (r["text"] or "").encode()
            for anchor, at, back, size in zip(r["anchor"], r["at"], r["back"], r["size"]):
                out.append((anchor, r["doc_id"], r["uid"], at - back, back, raw[at - back : at - back + size + LENGTH - 1]))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _P)], names=_PN)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _P)], names=_PN)


_P = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
_PN = ["anchor", "doc_id", "uid", "start", "back", "bytes"]


def sharing(raw: list[bytes], back: list[int]) -> np.ndarray:
    """Phrases that may hold a repeated window. A window with i to i + 7 bytes before its anchor has a core, from i before the anchor on, that another phrase must have too."""
    out = np.zeros(len(raw), bool)
    spare = LENGTH - GRAM
    for i in range(0, spare + 1, 8):
        after = GRAM + max(0, spare - 7 - i)
        at = [k for k, (r, b) in enumerate(zip(raw, back)) if b >= i and len(r) >= b + after]
        cores = [raw[k][back[k] - i : back[k] + after] for k in at]
        times = Counter(cores)
        out[[k for k, c in zip(at, cores) if times[c] > 1]] = True
    return out


def _shard(table: pa.Table) -> pa.Table:
    """Marks repeated windows of a shard's phrases by the run-length index."""
    ids = pc.fill_null(table["doc_id"], int(_LAST)).to_numpy()
    uid, start = table["uid"].to_numpy(), table["start"].to_numpy()
    raw = table["bytes"].to_pylist()
    near = sharing(raw, table["back"].to_pylist())
    o = np.lexsort((start, uid, ids))
    o = o[near[o]].tolist()
    out = [], [], []
    for i, flags in zip(o, runindex.repeats([raw[i] for i in o], LENGTH)):
        for a, z in _runs(flags, int(start[i])):
            for c, v in zip(out, (int(uid[i]), a, z)):
                c.append(v)
    return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names=["uid", "a", "z"])


def _windows(batches):
    """Both hashes of every window of each phrase."""
    for b in batches:
        for r in b.to_pylist():
            raw = np.frombuffer(r["bytes"], np.uint8)
            w = np.arange(len(raw) - LENGTH + 1)
            h = [_hash(_sums(raw, k), k, w, w + LENGTH).view(np.int64) for k in (0, 1)]
            n = len(w)
            yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array([r["doc_id"]] * n, pa.int64()), pa.array(np.full(n, r["uid"])), pa.array((w + r["start"]).astype(np.int32))], names=["h1", "h2", "doc_id", "uid", "start"])


def _mark(phrases: DataFrame, shards: int) -> DataFrame:
    """uid, a, z: byte intervals of windows that start earlier elsewhere."""
    spark = phrases.sparkSession
    sizes = phrases.groupBy("anchor").agg(F.count("*").alias("c"))
    huge = common.written(sizes.where(F.col("c") > INDEX_PHRASES).select("anchor"), spark)
    small = phrases.join(huge, "anchor", "left_anti").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
    marked = small.groupBy("shard").applyInArrow(_shard, "uid long, a int, z int")
    if huge.isEmpty():
        return marked
    windows = common.written(phrases.join(huge, "anchor", "left_semi").mapInArrow(_windows, "h1 long, h2 long, doc_id long, uid long, start int"), spark)
    own = F.struct(F.coalesce("doc_id", F.lit(int(_LAST))).alias("i"), "uid", "start")
    first = windows.groupBy("h1", "h2").agg(F.min(own).alias("first"))
    late = windows.join(first, ["h1", "h2"]).where(own > F.col("first"))
    return marked.unionByName(late.select("uid", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("z")))


def _cut(batches):
    for b in batches:
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for r in b.to_pylist():
            raw = (r["text"] or "").encode()
            begin = np.array((r["gone_from"] or []) + (r["more_from"] or []), np.int64)
            end = np.array((r["gone_to"] or []) + (r["more_to"] or []), np.int64)
            o = np.argsort(begin, kind="stable")
            begin, end = merged(begin[o], end[o])
            kept, at = [], 0
            for x, y in zip(begin.tolist(), end.tolist()):
                kept.append(raw[at:x])
                at = y
            kept.append(raw[at:])
            for k, v in zip(out, (r["doc_id"], len(raw), int((end - begin).sum()), len(begin), hashlib.sha256(b"".join(kept)).hexdigest())):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (*[pa.int64()] * 4, pa.string()))], names=list(out))


def removal_spans(texts: DataFrame) -> DataFrame:
    """uid, gone_from, gone_to, more_from, more_to: the intervals to remove. texts: uid, doc_id, text, read alike each time."""
    spark = texts.sparkSession
    buckets = common.buckets(texts)
    answers = texts.mapInArrow(_send(buckets), _SENT).groupBy("bucket").applyInArrow(_answer, _ANSWER)
    found = common.written(answers.groupBy("batch").applyInArrow(_documents, _DOC), spark)
    common.drop_shuffles(spark)
    branching = found.where(F.size("anchor") > 0).select("uid", "anchor", "at", "back", "size")
    phrases = common.written(texts.join(branching, "uid").mapInArrow(_phrases, "anchor long, doc_id long, uid long, start int, back int, bytes binary"), spark)
    common.drop_shuffles(spark)
    total = phrases.agg(F.sum(F.length("bytes"))).first()[0] or 0
    marked = common.written(_mark(phrases, max(buckets, -(-total // SHARD_BYTES))), spark)
    more = marked.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias("m")).select("uid", F.col("m.a").alias("more_from"), F.col("m.z").alias("more_to"))
    return common.written(found.select("uid", "gone_from", "gone_to").join(more, "uid", "full_outer"), spark)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    texts = common.written(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    gone = removal_spans(texts)
    return texts.join(gone, "uid", "left").select("doc_id", "text", "gone_from", "gone_to", "more_from", "more_to").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))
