"""Training byte-level BPE merges over a table of distinct words, thousands of merges a round, exact.

The greedy order (most frequent pair, ties to the smaller symbols, older ones first) is sequential, but until counts fall
to a bound, only little of the words takes part in it. A round

1. counts the pairs of all words and takes the first KEEP to the driver;
2. chooses a bound and cuts all words wherever the pair at hand has a smaller count. What two merged symbols are to be
   joined across has at most the count of the pair that was there before, so no merge above the bound crosses a cut;
3. sums up equal segments in Spark. The bound is the least one for which distinct segments have about SAMPLE symbols at
   most (or that of the most frequent pair alone);
4. merges in greedy order over the distinct segments, in which every pair above the bound has its exact count. The round
   ends at the bound, or with a merge that spells a token that exists, as counts may grow from there on;
5. applies these merges to the words, which become a table in the shared folder.

A pair that was merged once isn't merged again. The bound decides only how far a round gets, never which merges come out.
What reaches the driver is bounded by KEEP and SAMPLE; words stay distributed, whatever the corpus's size.
"""

from __future__ import annotations

import heapq
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import checkpoint_folder

#: Pairs whose counts are known to the driver, merges of a round and symbols of its segments, at most.
KEEP = 200_000
BATCH = 1 << 20
SAMPLE = 4_000_000
#: Symbols of segments that a round may have in any case, and places of the pairs whose counts are tried as bounds.
LEAST = 256
RANKS = [8**k for k in range(7)]
CACHE_ENTRIES = 300_000
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPARE = iter(range(256, 512))
#: The character that stands for each byte in a tokenizer file: itself if it is printed, else the next from 256 on.
CHARACTERS = [chr(b if b in _SHOWN else next(_SPARE)) for b in range(256)]
#: Bytes in the order of their characters: symbols 0 to 255.
BYTES = sorted(range(256), key=CHARACTERS.__getitem__)
_SYMBOL = [BYTES.index(b) for b in range(256)]
_WORDS = "symbols array<int>, freq long"


def word_table(docs: DataFrame, text: str, pattern: str) -> DataFrame:
    """Distinct pre-tokens of the composed (NFC) texts as symbols, with counts."""

    def composed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t and unicodedata.normalize("NFC", t) for t in b.column(0).to_pylist()], pa.string())], names=["t"])

    def symbols(batches):
        for b in batches:
            words = [[_SYMBOL[c] for c in w.encode()] for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int32())), b.column(1)], names=["symbols", "freq"])

    texts = docs.select(F.col(text).cast("string").alias("t")).where("t IS NOT NULL").mapInArrow(composed, "t string")
    words = texts.select(F.explode(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("freq"))
    return words.mapInArrow(symbols, _WORDS)


def merged(word: list[int], a: int, b: int, new: int) -> list[int]:
    """The word with each occurrence of the pair, from the left, as one symbol."""
    out, i = [], 0
    while i < len(word):
        if word[i] == a and i + 1 < len(word) and word[i + 1] == b:
            out.append(new)
            i += 2
        else:
            out.append(word[i])
            i += 1
    return out


def applied(word: list[int], rank: dict) -> list[int]:
    """The word under ranked merges {(a, b): (step, new)}."""
    while len(word) > 1:
        found = [rank[p] + p for p in zip(word, word[1:]) if p in rank]
        if not found:
            break
        _, new, a, b = min(found)
        word = merged(word, a, b, new)
    return word


def segments(values: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Where the segments of words begin: words are cut wherever the pair at hand isn't one of the sorted keys kept."""
    pairs = (values[:-1].astype(np.int64) << 32) | values[1:]
    at = np.minimum(np.searchsorted(kept, pairs), len(kept) - 1)
    begins = np.ones(len(values), bool)
    begins[1:] = kept[at] != pairs
    begins[offsets[:-1][offsets[:-1] < len(values)]] = True
    return np.flatnonzero(begins)


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of words, and where each word begins and ends in them."""
    offsets = words.offsets.to_numpy().astype(np.int64)
    return words.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _binary(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Segments as binaries of 32-bit symbols."""
    ends = (np.r_[begins, len(values)] * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.astype("<i4").tobytes())])


def pair_table(words: DataFrame) -> DataFrame:
    """a, b, count of all adjacent pairs."""
    pairs = F.arrays_zip(F.expr("slice(symbols, 1, greatest(size(symbols) - 1, 0))").alias("a"), F.expr("slice(symbols, 2, greatest(size(symbols) - 1, 0))").alias("b"))
    return words.where(F.size("symbols") > 1).select(F.explode(pairs).alias("p"), "freq").groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("freq").alias("count"))


def segment_table(words: DataFrame, kept: np.ndarray) -> DataFrame:
    """Distinct segments of two symbols or more, as binaries of 32-bit symbols, with counts."""

    def run(batches):
        for b in batches:
            values, offsets = _flat(b.column(0))
            if not len(values):
                continue
            begins = segments(values, offsets, kept)
            long = np.diff(np.r_[begins, len(values)]) > 1
            freq = b.column(1).to_numpy()[np.searchsorted(offsets, begins[long], "right") - 1]
            coded = _binary(values, begins).filter(pa.array(long)).dictionary_encode()
            total = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(total, coded.indices.to_numpy(), freq)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(total)], names=["segment", "freq"])

    return words.mapInArrow(run, "segment binary, freq long").groupBy("segment").agg(F.sum("freq").alias("freq"))


def _sizes(words: DataFrame, kept: list[np.ndarray], one_in: int) -> list[int]:
    """About how many symbols the distinct segments have under each of the sets of pairs, from one in so many of them by hash."""

    def run(batches):
        for b in batches:
            values, offsets = _flat(b.column(0))
            for k, own in enumerate(kept if len(values) else ()):
                begins = segments(values, offsets, own)
                size = np.diff(np.r_[begins, len(values)])
                place = np.arange(len(values), dtype=np.uint64) - np.repeat(begins, size).astype(np.uint64)
                h = mixed(np.add.reduceat(mixed(values.astype(np.uint64) + (place << np.uint64(32))), begins))
                some = (size > 1) & (h % np.uint64(one_in) == 0)
                h, first = np.unique(h[some], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64)), pa.array(size[some][first])], names=["k", "h", "size"])

    found = words.mapInArrow(run, "k int, h long, size long").groupBy("k", "h").agg(F.max("size").alias("size")).groupBy("k").agg(F.sum("size").alias("size")).collect()
    sizes = {r.k: r["size"] * one_in for r in found}
    return [sizes.get(k, 0) for k in range(len(kept))]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scrambled."""
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


class Greedy:
    """The greedy merges over distinct segments, in which all pairs of a count of ``least`` or more are whole.

    Symbols are nodes of doubly linked lists; a pair's nodes are merged at once. Pairs that come into being with less than
    ``least`` are forgotten, as counts only fall until a merge spells a token that exists.
    """

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, freq: np.ndarray, least: int, gone: set):
        n = len(symbols)
        self.symbol, self.least, self.mark = np.append(symbols, -1).astype(np.int64), least, np.zeros(n + 1, bool)
        self.after, self.before = np.arange(1, n + 2), np.arange(-1, n)
        self.after[offsets[1:] - 1], self.before[offsets[:-1]] = n, n  # node n is no node
        self.weight = np.append(np.repeat(freq, np.diff(offsets)), 0)
        self.counts, self.where, self.heap = {}, {}, []
        inner = np.flatnonzero(self.after[:n] < n)
        self._add(inner, gone)

    def _keys(self, at: np.ndarray) -> np.ndarray:
        return (self.symbol[at] << 32) | self.symbol[self.after[at]]

    def _add(self, at: np.ndarray, gone=()) -> None:
        """Take in pairs, given their left nodes."""
        keys = self._keys(at)
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        total = np.add.reduceat(self.weight[at], begin) if len(begin) else begin
        ends = np.r_[begin[1:], len(keys)]
        some = total >= self.least
        for key, count, a, z in zip(keys[begin[some]].tolist(), total[some].tolist(), begin[some].tolist(), ends[some].tolist()):
            pair = (key >> 32, key & 0xFFFFFFFF)
            if pair not in gone:
                self.counts[key], self.where[key] = count, at[a:z].copy() if z - a < len(at) // 2 else at[a:z]
                heapq.heappush(self.heap, (-count, *pair))

    def best(self):
        """The most frequent pair, ties to the smaller symbols; None if all have less than ``least``."""
        while self.heap:
            c, a, b = self.heap[0]
            now = self.counts.get(a << 32 | b, 0)
            if now == -c:
                return a, b
            heapq.heappop(self.heap)
            if now >= self.least:
                heapq.heappush(self.heap, (-now, a, b))
            else:
                self.where.pop(a << 32 | b, None)
        return None

    def merge(self, a: int, b: int, new: int) -> None:
        """Every occurrence of the best pair, from the left, as one symbol."""
        heapq.heappop(self.heap)
        key, none = a << 32 | b, len(self.symbol) - 1
        at = self.where.pop(key)
        del self.counts[key]
        at = at[(self.symbol[at] == a) & (self.symbol[self.after[at]] == b)]
        if a == b and len(at) > 1:  # of a run, every other one
            at.sort()
            chained = np.r_[False, self.after[at[:-1]] == at[1:]]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
        right, left = self.after[at], self.before[at]
        self.mark[right] = True
        left = left[(left != none) & ~self.mark[left]]
        self.mark[right] = False
        old = np.concatenate([left, right[self.after[right] != none]])
        keys, inverse = np.unique(self._keys(old), return_inverse=True)
        for k, d in zip(keys.tolist(), np.bincount(inverse, self.weight[old], len(keys)).astype(np.int64).tolist()):
            if k in self.counts:
                self.counts[k] -= d
        beyond = self.after[right]
        self.symbol[at], self.after[at] = new, beyond
        self.before[beyond] = at
        self.symbol[right] = -2
        self._add(np.concatenate([left, at[self.after[at] != none]]))


def train(docs: DataFrame, merges: int, pattern: str, min_frequency: int = 2, text: str = "text", batch: int = BATCH, keep: int = KEEP, sample: int = SAMPLE) -> list[tuple[bytes, bytes]]:
    """Merges until so many new tokens exist, or no pair is frequent enough. A pair that spells an existing token becomes that token."""
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/bpe-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    words = stored(word_table(docs, text, pattern).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "words-0")
    names = [bytes([b]) for b in BYTES]
    ids, out, gone, turn = {n: i for i, n in enumerate(names)}, [], set(), 0
    while len(names) - 256 < merges:
        most = keep + len(gone)  # pairs merged before may be formed again
        pairs = pair_table(words).where(F.col("count") >= min_frequency).orderBy(F.desc("count"), "a", "b").limit(most + 1).toArrow()
        count = pairs["count"].to_numpy()
        keys = (pairs["a"].to_numpy().astype(np.int64) << 32) | pairs["b"].to_numpy()
        fresh = np.array([(k >> 32, k & 0xFFFFFFFF) not in gone for k in keys.tolist()], bool)
        if not fresh.any():
            break
        top = int(count[fresh][0])
        least = min_frequency if len(count) <= most else min(int(count[-1]) + 1, top)
        bounds = sorted({max(least, min(top, int(count[min(r, len(count)) - 1]))) for r in RANKS} | {least, top})
        sets = [np.sort(keys[count >= x]) for x in bounds]
        total = words.count()
        sizes = _sizes(words, sets, max(1, total // 100_000))
        at = next((k for k, n in enumerate(sizes) if n <= max(sample, LEAST)), len(bounds) - 1)
        own = segment_table(words, sets[at]).toArrow().combine_chunks()
        greedy = Greedy(*_nodes(own["segment"]), own["freq"].to_numpy(), bounds[at], gone)
        done = []
        while len(done) < batch and len(names) - 256 < merges and (pair := greedy.best()):
            name = names[pair[0]] + names[pair[1]]
            again = name in ids
            if not again:
                ids[name] = len(names)
                names.append(name)
            done.append((*pair, ids[name]))
            if again:
                break  # counts of pairs may grow now
            greedy.merge(*done[-1])
        out += done
        gone |= {d[:2] for d in done}
        rank = {(a, b): (s, new) for s, (a, b, new) in enumerate(done)}
        turn += 1
        if len(names) - 256 < merges:
            words = stored(words.mapInArrow(lambda batches, rank=rank, kept=sets[at]: _rewritten(batches, rank, kept), _WORDS), f"words-{turn}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return [(names[a], names[b]) for a, b, _ in out]


def _nodes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of segments, and where each begins and ends."""
    size = pc.binary_length(column).to_numpy().astype(np.int64) // 4
    return np.frombuffer(b"".join(x.as_buffer() for x in column), "<i4"), np.r_[0, np.cumsum(size)]


def _rewritten(batches, rank: dict, kept: np.ndarray):
    """Words under ranked merges, each segment that a task has met once; words of one symbol go."""
    known: dict = {}
    for b in batches:
        values, offsets = _flat(b.column(0))
        if not len(values):
            continue
        begins = segments(values, offsets, kept)
        coded = _binary(values, begins).dictionary_encode()
        if len(known) > CACHE_ENTRIES:
            known.clear()
        after = []
        for s in coded.dictionary.to_pylist():
            if len(s) > 4 and s not in known:
                known[s] = np.array(applied(np.frombuffer(s, "<i4").tolist(), rank), "<i4").tobytes()
            after.append(known[s] if len(s) > 4 else s)
        index = coded.indices.to_numpy()
        size = np.array([len(s) // 4 for s in after], np.int64)[index]
        ends = np.r_[0, np.cumsum(size)][np.searchsorted(begins, offsets)]
        symbols = np.frombuffer(b"".join([after[i] for i in index.tolist()]), "<i4")
        words = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(symbols))
        some = pa.array(np.diff(ends) > 1)
        yield pa.RecordBatch.from_arrays([words.filter(some), b.column(1).filter(some)], names=["symbols", "freq"])
