"""Ranked lexical search over a tiered index, exact to the last integer.

Statistics: one pass counts the documents with a term (N) and all terms (L). Index: each task cuts its documents into
blocks of at most BLOCK_DOCS rows and about BLOCK_BYTES of text and inverts them. A row of the index is a term of a block: its postings
(document in the block, impact) by falling impact, the first TIERS[0] in tier 0, the next TIERS[1] in tier 1,
the rest in tier 2, with the largest impact below each tier (the residual bound). Postings of a common term are
spread over the blocks, so no term is one group. A document's impact for a term is (10^9 tf) div (1000 tf + 20 m).

Search: the rows of the items' terms are taken out of the index once. The first round reads only their tier 0. In each block an item's documents get the sum of
what was read (a lower bound) and that sum plus the residuals of their other terms (an upper bound). The limit of an item is its
k-th best lower bound over all blocks. Where a document that isn't settled (bounds differ) could still reach the limit, the
item lacks a proof of exactness in that block and falls through: the next round reads one tier more for these (item, block) pairs
and for no others. Elsewhere all that can rank is settled, and its scores are exact.

Items travel in groups of ITEMS to the blocks; weights come from document counts summed over all blocks.

Cases: a null text has no term, and documents without a term count nowhere; every row is a document of its own, rows that
repeat an id rank each, a row without an id ranks after those with one at equal scores; a null or termless item gives no rows, items that
repeat an id are answered each, one without an id likewise; ties go to the smaller doc_id; scores of 0 are left out (only a term of nearly all
documents weighs 0); empty tables give an empty result; other columns are not read. Texts are read whole, a long one makes a block of its own.
Terms are told apart by two 64-bit hashes within a block and by their own text beyond it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common

#: A term is a maximal run of what is no ASCII character but a digit or letter.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TIERS = (64, 512)
BLOCK_DOCS = 8192
BLOCK_BYTES = 8 << 20
ITEMS = 256
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SCHEMA = "block long, term string, df int, residuals array<int>, " + ", ".join(f"docs{t} binary, impacts{t} binary" for t in range(3))
_INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def terms_of(text: Column) -> Column:
    """The terms of a text, in order, with repeats; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Folded UTF-8 bytes of a column of strings, a space behind each text, and where each text begins; null is empty."""
    raw = [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
    begins = np.cumsum([0, *(len(t) + 1 for t in raw)])
    return _FOLD[np.frombuffer(b" ".join([*raw, b""]), np.uint8)], begins


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the terms."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _INSIDE[data], [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def _hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, factor: np.uint64) -> np.ndarray:
    """A 64-bit polynomial hash of each term, byte by byte over all terms at once, longest terms last."""
    h = size.astype(np.uint64)
    order = np.argsort(size, kind="stable")
    live, at = order, 0
    sizes = size[order]
    with np.errstate(over="ignore"):
        while True:
            cut = np.searchsorted(sizes, at, side="right")
            live = order[cut:]
            if not len(live):
                return common.mix64(h)
            if len(live) < 64 and sizes[-1] - at > 64:  # few long terms: one by one
                for i in live.tolist():
                    for c in data[begin[i] + at : begin[i] + size[i]].tolist():
                        h[i] = h[i] * factor + np.uint64(c + 1)
                return common.mix64(h)
            h[live] = h[live] * factor + data[begin[live] + at] + np.uint64(1)
            at += 1


def statistics(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms all have."""

    def run(batches):
        for b in batches:
            data, begins = _bytes(b.column(0))
            n = np.bincount(np.searchsorted(begins, _runs(data)[0], side="right") - 1, minlength=b.num_rows)
            yield pa.RecordBatch.from_pydict({"n": [int((n > 0).sum())], "l": [int(n.sum())]})

    r = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return r.n or 0, r.l or 0


def inverted(data: np.ndarray, begins: np.ndarray, n: int, total: int) -> tuple:
    """terms (Arrow strings), where each one's postings begin, documents and impacts, by term and falling impact."""
    begin, end = _runs(data)
    size = end - begin
    doc = np.searchsorted(begins, begin, side="right") - 1
    h, g = (_hashes(data, begin, size, f) for f in (_A, _B))
    order = np.argsort(h, kind="stable")
    if (g[order][1:] != g[order][:-1])[h[order][1:] == h[order][:-1]].any():  # terms of one first hash
        order = np.lexsort((doc, g, h))
    h, g, d = h[order], g[order], doc[order]
    new_term = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])][: len(h)]
    new = new_term | np.r_[True, d[1:] != d[:-1]][: len(h)]
    first = np.flatnonzero(new)
    tf = np.diff(np.r_[first, len(h)]).astype(np.int64)
    own = np.bincount(doc, minlength=len(begins) - 1).astype(np.int64)
    m = 50 + 50 * own * n // max(total, 1)
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[d[first]])
    term = np.cumsum(new_term)[first] - 1
    by = np.argsort(term << 33 | (999_999 - impact) << 13 | d[first])  # impacts are below 10^6, documents below BLOCK_DOCS
    heads = order[np.flatnonzero(new_term)]
    sizes = size[heads]
    ends = np.cumsum(sizes)
    spots = np.repeat(begin[heads] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
    words = pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data[spots].tobytes())).cast(pa.string())
    return words, np.r_[0, np.cumsum(np.bincount(term, minlength=len(heads)))], d[first][by], impact[by]


def _binary(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """values[lo:hi] of each row as bytes; null where there are none."""
    size = hi - lo
    ends = np.cumsum(size)
    spots = np.repeat(lo - (ends - size), size) + np.arange(int(size.sum()))
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer((np.r_[0, ends] * values.itemsize).astype(np.int64)), pa.py_buffer(values[spots].tobytes())]).cast(pa.binary())
    return pc.if_else(pa.array(size > 0), out, pa.scalar(None, pa.binary()))


class TieredIndex:
    """The index of one table of documents (doc_id, text), written to the shared folder: postings by block and term, and the blocks' ids."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.n, self.total = n, total = statistics(rows)

        def index(batches):
            """Rows of (term, postings) of each block, and one with a null term that holds the ids."""
            from pyspark import TaskContext

            number = TaskContext.get().partitionId() << 32
            for ids, texts in _blocks(batches, BLOCK_DOCS, BLOCK_BYTES):
                data, begins = _bytes(texts)
                ids = ids.to_pylist()
                flat = np.array([0 if i is None else i for i in ids], np.int64)
                none = np.array([i is None for i in ids], np.int32)
                yield pa.RecordBatch.from_pydict({"block": [number], "term": pa.array([None], pa.string()), "df": pa.array([len(ids)], pa.int32()), "residuals": pa.array([[]], pa.list_(pa.int32())), **{f"{c}{t}": pa.array([flat.tobytes() if t == 0 and c == "docs" else none.tobytes() if t == 0 else None], pa.binary()) for t in range(3) for c in ("docs", "impacts")}})
                words, edge, doc, impact = inverted(data, begins, n, total)
                doc, impact = doc.astype(np.uint16), impact.astype(np.int32)
                for s in range(0, len(words), 1 << 14):
                    lo, hi = edge[s:-1][: 1 << 14], edge[s + 1 :][: 1 << 14]
                    cuts = [lo, np.minimum(lo + TIERS[0], hi), np.minimum(lo + sum(TIERS), hi), hi]
                    below = [np.where(c < hi, np.r_[impact, 0][np.minimum(c, len(impact))], 0) for c in cuts[1:3]]
                    out = {"block": pa.array(np.full(len(lo), number)), "term": words.slice(s, len(lo)), "df": pa.array((hi - lo).astype(np.int32)), "residuals": pa.FixedSizeListArray.from_arrays(pa.array(np.stack(below, 1).astype(np.int32).ravel()), 2).cast(pa.list_(pa.int32()))}
                    for t in range(3):
                        out |= {f"docs{t}": _binary(doc, cuts[t], cuts[t + 1]), f"impacts{t}": _binary(impact, cuts[t], cuts[t + 1])}
                    yield pa.RecordBatch.from_pydict(out)
                number += 1

        self.rows = common.written(rows.mapInArrow(index, _SCHEMA))

    def lists(self, asked: DataFrame) -> DataFrame:
        """The index's rows of the terms of asked (item, term), apart from the others, so that later reads and exchanges hold no more."""
        return common.written(self.rows.join(asked.select("term").distinct(), "term", "left_semi"))

    def weights(self, asked: DataFrame, lists: DataFrame) -> DataFrame:
        """item, term, w: asked with the terms' weights (terms of no document are left out)."""
        df = lists.groupBy("term").agg(F.sum("df").alias("df"))
        w = F.floor(1000 * F.log((2.0 * self.n + 2) / (2.0 * F.col("df") + 1))).cast("long")
        return asked.join(df, "term").select("item", "term", w.alias("w"))

    def _round(self, lists: DataFrame, asked: DataFrame, tiers: int, k: int) -> DataFrame:
        """block, item, reach, docs, scores of each pair: what is settled or ranks by its lower bound, from so many tiers.

        asked: block, part, item, term, w, limit (an item's limit so far).
        """
        names = [f"{c}{t}" for t in range(tiers) for c in ("docs", "impacts")]
        need = asked.select(F.col("block") + 0, (F.col("part") + 0).alias("part"), F.concat("term").alias("term")).toDF("block", "part", "term").distinct()  # columns of its own
        # a row an asked pair of block and term on both sides, so neither fits a broadcast for all sizes
        hits = lists.join(need.hint("merge"), ["block", "term"]).select("block", "part", "term", "residuals", *names)

        def run(q: pa.Table, x: pa.Table) -> pa.Table:
            out: dict = {"block": [], "item": [], "reach": [], "docs": [], "lower": [], "upper": []}
            at = {t: i for i, t in enumerate(x["term"].to_pylist())}
            docs = [[(np.frombuffer(x[f"docs{t}"][i].as_buffer(), np.uint16).astype(np.int64), np.frombuffer(x[f"impacts{t}"][i].as_buffer(), np.int32).astype(np.int64)) for t in range(tiers) if x[f"docs{t}"][i].is_valid] for i in range(x.num_rows)]
            rest = [r[tiers - 1] if tiers < 3 else 0 for r in x["residuals"].to_pylist()]
            by: dict = {}
            for item, term, w, limit in zip(q["item"].to_pylist(), q["term"].to_pylist(), q["w"].to_pylist(), q["limit"].to_pylist()):
                if term in at:
                    by.setdefault((item, limit), []).append((at[term], w))
            for (item, limit), terms in by.items():
                lower, open_ = np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
                unread = 0
                for i, w in terms:
                    left = w * rest[i]
                    unread += left
                    for d, v in docs[i]:
                        lower[d] += w * v
                        open_[d] += left  # read in this document, so nothing is left of it
                upper = lower + unread - open_
                waits = upper[upper > lower]
                seen = np.flatnonzero((lower > 0) & (upper >= limit))
                # k documents of this block that rank before another one by their lower bounds and ids do so by their scores, if that one is settled
                seen = seen[np.lexsort((seen, -lower[seen]))[:k]]
                out["block"].append(q["block"][0].as_py())
                out["item"].append(item)
                out["reach"].append(int(waits.max()) if len(waits) else 0)
                out["docs"].append(seen.astype(np.int32).tolist())
                out["lower"].append(lower[seen].tolist())
                out["upper"].append(upper[seen].tolist())
            return pa.Table.from_pydict(out, schema=pa.schema([("block", pa.int64()), ("item", pa.int64()), ("reach", pa.int64()), ("docs", pa.list_(pa.int32())), ("lower", pa.list_(pa.int64())), ("upper", pa.list_(pa.int64()))]))

        met = asked.select("block", "part", "item", "term", "w", "limit").groupBy("block", "part").cogroup(hits.groupBy("block", "part")).applyInArrow(run, "block long, item long, reach long, docs array<int>, lower array<long>, upper array<long>")
        return common.written(met)

    def search(self, items: DataFrame, k: int = 50) -> DataFrame:
        """item_id, rank, doc_id, score: the k best documents of each item (item_id, text)."""
        numbered = common.written(items.select(F.col("item_id"), F.col("text").cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()))
        terms = common.written(numbered.select("item", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")))
        lists = self.lists(terms)
        weights = common.written(self.weights(terms, lists))
        part = F.pmod(F.hash("item"), F.lit(self._parts(numbered))).alias("part")
        blocks = lists.select("block", "term")
        # which blocks hold a term of an item: pairs, not postings
        asked = common.written(blocks.join(weights, "term").select("block", part, "item", "term", "w", F.lit(1).cast("long").alias("limit")))
        settled = None
        for tiers in (1, 2, 3):
            found = self._round(lists, asked, tiers, k)
            kept = found if settled is None else settled.unionByName(found)
            best = kept.select("item", F.explode("lower").alias("lower"))
            first = best.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("lower")))).where(F.col("r") <= k)  # limited in each task before the exchange
            limit = common.written(first.groupBy("item").agg(F.count("*").alias("n"), F.min("lower").alias("limit")).where(F.col("n") == k).select("item", F.greatest("limit", F.lit(1).cast("long")).alias("limit")))
            judged = kept.join(limit, "item", "left").withColumn("limit", F.coalesce("limit", F.lit(1).cast("long")))
            settled = common.written(judged.where("reach < limit").drop("limit"))
            unproved = common.written(judged.where("reach >= limit").select("block", "item", "limit"))
            if tiers == 3 or unproved.isEmpty():
                break
            asked = common.written(unproved.hint("merge").join(weights, "item").select("block", part, "item", "term", "w", "limit"))
        rows = settled.select("block", "item", F.explode(F.arrays_zip("docs", "lower", "upper")).alias("r")).where("r.lower = r.upper").select("block", "item", F.col("r.docs").alias("doc"), F.col("r.lower").alias("score"))
        top = rows.join(limit, "item", "left").where(F.col("score") >= F.coalesce("limit", F.lit(1))).drop("limit")
        named = top.join(self.ids().hint("merge"), ["block", "doc"])
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "doc"))
        ranked = named.withColumn("rank", rank).where(F.col("rank") <= k)
        return ranked.join(numbered.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

    def ids(self) -> DataFrame:
        """block, doc, doc_id."""

        def run(batches):
            for b in batches:
                for r in range(b.num_rows):
                    ids, none = np.frombuffer(b["docs0"][r].as_buffer(), np.int64), np.frombuffer(b["impacts0"][r].as_buffer(), np.int32)
                    yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(ids), b["block"][r].as_py())), "doc": pa.array(np.arange(len(ids), dtype=np.int32)), "doc_id": pa.array(ids, mask=none > 0)})

        return self.rows.where("term IS NULL").select("block", "docs0", "impacts0").mapInArrow(run, "block long, doc int, doc_id long")

    def _parts(self, items: DataFrame) -> int:
        return max(1, -(-items.count() // ITEMS))


def _blocks(batches, most: int, room: int):
    """Ids and texts of at most so many rows and, but for one long text, so many bytes; by id within a block, so that places order like ids."""
    held, count, size = [], 0, 0
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, s in enumerate(sizes.tolist()):
            if count and (count >= most or size + s > room):
                held.append(b.slice(start, i - start))
                yield _joined(held)
                held, count, size, start = [], 0, 0, i
            count, size = count + 1, size + s
        held.append(b.slice(start))
    if count:
        yield _joined(held)


def _joined(held: list) -> tuple:
    t = pa.Table.from_batches(held)
    t = t.take(pc.sort_indices(t.column(0), null_placement="at_end")).combine_chunks()
    return t.column(0).combine_chunks(), t.column(1).combine_chunks()


def op13(spark, sf_dir: str) -> DataFrame:
    return TieredIndex(common.table(spark, sf_dir, "documents")).search(common.table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents WHERE text IS NOT NULL),
    d AS (SELECT r, doc_id, len(terms) AS n, terms FROM t WHERE len(terms) > 0),
    s AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
    p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM d) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, big_n),
    q AS (SELECT DISTINCT b, item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM (SELECT row_number() OVER () AS b, * FROM benchmark WHERE text IS NOT NULL)),
    x AS (SELECT b, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l))))) AS BIGINT) AS score
          FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY b, item_id, r, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 50"""
