"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents stay in the order their partition reads them. A block is a run of about
BLOCK_TOKENS tokens of one partition; within it window cuts are chosen among document
ends (free), sentence ends (SENTENCE_COST), and filler positions inside long stretches
without either (TRUNCATION_COST), so that padding plus those penalties is least. With
f(j) the least cost of everything before candidate position j,

    f(j) = cost of a cut at j + 1 + min( W - j + min over i >= j - W of f(i) + i ,
                                         min over powers of two p of f(j - p) )

The inner minimum over the window comes from a monotone queue (each candidate enters and
leaves once); the second term is there because a sequence whose length is a power of two
is not padded. Powers p under WINDOW / 32 are allowed in a block's last window only, where they spare the padding
of its last sequence; the cuts cost least among all that keep to this. Blocks are bounded, need no shuffle and are recomputed alone if an
executor is lost.

Cases: a null or empty text is the end token alone; repeated rows and null ids are packed
as they come; a document longer than a block is cut at the block's end; an empty table
gives an empty result; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import os
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import bpe, common

WINDOW = 2048
BLOCK_TOKENS = 1 << 19
END_ID = 1
SENTENCE_COST = 1
TRUNCATION_COST = 16
FILLER = 64
#: Chunks that a worker keeps at most.
CHUNKS = 900_000
#: Words that are encoded as one text.
LUMP = 4000
_LETTERS = regex.compile("[a-zà-öø-ÿ]+")
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class LibraryEncoder:
    """Whole texts to ids with the tokenizers library, which sees each distinct chunk once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.own = bpe.load(path)
        self.chunks: dict[str, bytes] = {}
        last = regex.compile(r"[.!?…。]+[\"')\]]*</w>")
        self.ends, self.sentence = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        self.ends[[i for i, t in self.own.tokens.items() if t.endswith(self.own.end)]] = True
        self.sentence[[i for i, t in self.own.tokens.items() if last.fullmatch(t)]] = True

    def learn(self, chunks: list[str]) -> None:
        """Bring the distinct chunks of a batch into the table."""
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        known = self.chunks
        new = [c for c in chunks if c not in known]
        words = list(filter(_LETTERS.fullmatch, new))
        for a in range(0, len(words), LUMP):
            self._ask_words(words[a : a + LUMP])
        self._ask([c for c in new if c not in known])

    def _ask_words(self, words: list[str]) -> None:
        """Words of plain letters, each one pre-token, as one text: an id with the word's end closes each."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cut = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
        if len(cut) != len(words) + 1:
            return self._ask(words)
        raw = ids.tobytes()
        self.chunks.update([(w, raw[4 * a : 4 * z]) for w, a, z in zip(words, cut, cut[1:])])

    def _ask(self, new: list[str]) -> None:
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            self.chunks.update([(c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False))])

    def encode(self, texts: pa.Array) -> list:
        """Ids of each text, little-endian."""
        chunks, indices, offsets = bpe.split(texts)
        self.learn(chunks)
        out = bpe.taken(list(map(self.chunks.__getitem__, chunks)), indices, offsets)
        special = pc.match_substring(pc.fill_null(texts, ""), "<|").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(special).tolist():
            out[i] = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def choose_cuts(candidates: np.ndarray, costs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the cheapest cuts. candidates: ascending, first 0, gaps at most window; costs: of a cut there."""
    at, cost = candidates.tolist(), costs.tolist()
    powers = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
    # short unpadded sequences are of use at the end only
    long_powers, tail = [p for p in powers if p >= window // 32], at[-1] - window
    # which candidates lie a power of two after another
    whole, pairs = np.asarray(candidates), []
    for p in powers:
        j = np.arange(len(at)) if p in long_powers else np.flatnonzero(whole > tail)
        i = np.searchsorted(whole, whole[j] - p)
        hit = whole[i] == whole[j] - p
        pairs.append((j[hit], i[hit]))
    later, earlier = (np.concatenate([x[k] for x in pairs]) for k in (0, 1))
    order = np.argsort(later, kind="stable")
    hits = earlier[order].tolist()
    begins = np.searchsorted(later[order], np.arange(len(at) + 1)).tolist()
    best, back = [0], [0]
    queue: deque = deque([(0, 0, 0)])  # (f + position, position, index), ascending in both
    for j in range(1, len(at)):
        here = at[j]
        while queue[0][1] < here - window:
            queue.popleft()
        value, source = queue[0][0] + window - here, queue[0][2]
        for i in hits[begins[j] : begins[j + 1]]:
            if best[i] <= value:
                value, source = best[i], i
        value += cost[j] + 1
        best.append(value)
        back.append(source)
        value += here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, here, j))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return np.array([0, *cuts[::-1]], np.int64)


def candidates_of(lengths: np.ndarray, sentence_ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cut positions of a block and their costs."""
    ends = np.cumsum(lengths)
    total = int(ends[-1])
    cost = {}
    base = np.unique(np.r_[0, ends, sentence_ends])
    gaps = np.diff(base)
    fill = [np.arange(a + FILLER, a + g, FILLER) for a, g in zip(base[:-1][gaps > FILLER].tolist(), gaps[gaps > FILLER].tolist())]
    tail = np.arange(total % FILLER if total < window else total - window, total, FILLER)
    every = np.unique(np.concatenate([base, tail, *fill]))
    cost = np.full(len(every), TRUNCATION_COST, np.int64)
    cost[np.searchsorted(every, sentence_ends)] = SENTENCE_COST
    cost[np.searchsorted(every, ends)] = 0
    return every, cost


def pack_block(segments: list, sentence: np.ndarray, first: int):
    """Pieces of one block. segments: (doc_id, ids, start in the document, tokens of the document)."""
    lengths = np.array([len(s[1]) for s in segments], np.int64)
    ids = np.concatenate([s[1] for s in segments])
    ends = np.cumsum(lengths)
    every, cost = candidates_of(lengths, np.flatnonzero(sentence[ids]) + 1)
    cuts = choose_cuts(every, cost)
    begin = np.unique(np.r_[0, ends[:-1], cuts[:-1]])
    stop = np.r_[begin[1:], ends[-1]]
    doc = np.searchsorted(ends, begin, "right")
    sequence = np.searchsorted(cuts, begin, "right") - 1
    raw = memoryview(ids.astype("<u4").tobytes())
    start = begin - (ends - lengths)[doc] + np.array([s[2] for s in segments], np.int64)[doc]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([segments[d][0] for d in doc.tolist()], pa.int64()),
            pa.array(start), pa.array(stop - begin),
            pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist())], pa.int64()),
            pa.array(np.array([s[3] for s in segments], np.int64)[doc]),
            pa.array(first + sequence), pa.array(begin - cuts[sequence]),
        ],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    ), len(cuts) - 1


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or bpe.default_path()

    def run(batches):
        enc = encoder(path)
        held, size, made = [], 0, 0
        for batch in batches:
            part = batch.column("part")
            for b in bpe.slices(batch):
                got = enc.encode(b.column("text"))
                for doc_id, raw in zip(b.column("doc_id").to_pylist(), got):
                    ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(END_ID))
                    at = 0
                    while at < len(ids):
                        take = ids[at : at + BLOCK_TOKENS - size]
                        held.append((doc_id, take, at, len(ids)))
                        at += len(take)
                        size += len(take)
                        if size >= BLOCK_TOKENS:
                            out, n = pack_block(held, enc.sentence, (part[0].as_py() << 32) + made)
                            yield out
                            held, size, made = [], 0, made + n
        if held:
            yield pack_block(held, enc.sentence, (part[0].as_py() << 32) + made)[0]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, _SCHEMA)


def op10(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
