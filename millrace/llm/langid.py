"""Language identification by a bit-sliced Bloom filter of character n-grams.

Learning: every labelled training text is folded (letters lower-cased, all else a space) and cut into
n-grams of ORDERS inside its words, padded by a space on both sides. Counts by language come from all
training texts, summed in every task before the exchange. A language holds an n-gram that makes up at
least SHARE of its n-grams of that order and RATIO of what the n-gram makes up where it is most common,
so a language holds at most len(ORDERS) / SHARE n-grams, however large the corpus.

Filter: a table of m slots of language bit masks, which is all languages' Bloom filters sliced by slot: the
HASHES slots of an n-gram, taken together by AND, give the set of all languages that hold it. Slots
are filled by a bit-wise OR in Spark; m is at least BITS slots for each n-gram of the largest language.
The table (at most HASHES * languages * 2 * BITS / SHARE bits) is what workers get.

Prediction: of a text's n n-grams, c languages' bits are counted; a filter that answers falsely at the rate f
(its share of filled slots to the power of HASHES) is corrected to max(0, (c - n f) / (1 - f)). The
language with the most wins, ties to the smaller name; the score is its part of all languages' corrected counts.

Cases: null texts and texts without a letter are ``und`` with score 0; a text of which no language holds an
n-gram gets the language with the most training documents (ties to the smaller name) and score 0; rows
without a language, or a null text, teach nothing; without any labelled row all are ``und``. Texts are read whole, long
ones in overlapping stretches of CHUNK characters. Rows that repeat an id are predicted each; a null id counts as the empty text
in the fold. An empty table gives an empty result; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

ORDERS = (2, 4)
SHARE = 1e-5
RATIO = 0.1
HASHES = 3
BITS = 10
CHUNK = 1 << 19
SPACE = np.uint32(32)
UNKNOWN = "und"


@lru_cache
def folding() -> np.ndarray:
    """For each code point the lower-case letter, or a space for what is no letter."""
    out = np.full(0x110000, SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def stretches(texts: list[str | None], chunk: int = CHUNK):
    """Groups of (row, characters, how many n-grams begin in them) of about chunk characters; words are padded by spaces."""
    held, size, over = [], 0, max(ORDERS) - 1
    for row, t in enumerate(texts):
        s = f" {t or ''} "
        for a in range(0, len(s), chunk):
            held.append((row, s[a : a + chunk + over], min(chunk, len(s) - a)))
            size += len(held[-1][1])
            if size >= chunk:
                yield held
                held, size = [], 0
    if held:
        yield held


def ngrams(held: list, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each n-gram that begins in these stretches and lies in one padded word."""
    points = np.frombuffer("".join(h[1] for h in held).encode("utf-32-le", "surrogatepass"), np.uint32)
    a = folding()[points]
    sizes = np.array([len(h[1]) for h in held])
    rows = np.repeat(np.array([h[0] for h in held]), sizes)
    ends = np.cumsum(sizes)
    good = np.repeat(ends - sizes + np.array([h[2] for h in held]), sizes) > np.arange(len(a))  # the rest is the next stretch's
    letter = a != SPACE
    n = len(a) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    good = good[:n] & (letter[:n] | letter[1:]) if order == 2 else good[:n]
    for i in range(1, order - 1):
        good &= letter[i : n + i]
    at = np.flatnonzero(good)
    h = np.full(len(at), order, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(order):
            h = h * np.uint64(0x9E3779B97F4A7C15) + a[at + i].astype(np.uint64)
    return common.mix64(h), rows[at]


def slots(grams: np.ndarray, m: int) -> list[np.ndarray]:
    """The HASHES slots of each n-gram in a table of m (a power of two)."""
    step = (grams >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [((grams + np.uint64(i) * step) & np.uint64(m - 1)).astype(np.int64) for i in range(HASHES)]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, n, gram, count over all rows (lang, text); sums are made in each task first."""

    def run(batches):
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            names = sorted(set(langs))
            number = {k: i for i, k in enumerate(names)}
            own = np.array([number[k] for k in langs])
            for held in stretches(texts):
                for n in ORDERS:
                    grams, rows = ngrams(held, n)
                    for i in np.unique(own[rows]).tolist():
                        u, c = np.unique(grams[own[rows] == i], return_counts=True)
                        yield pa.RecordBatch.from_pydict({"lang": pa.array([names[i]] * len(u), pa.string()), "n": pa.array(np.full(len(u), n, np.int32)), "gram": pa.array(common.to_long(u)), "count": pa.array(c.astype(np.int64))})

    return labelled.mapInArrow(run, "lang string, n int, gram long, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))


class LanguageFilter:
    """Languages, their bit-sliced filter (slot, word of 64 languages), the rates of false answers, and what an unknown text gets."""

    def __init__(self, langs: list[str], table: np.ndarray, rates: np.ndarray, common_lang: str):
        self.langs, self.table, self.rates, self.common_lang = langs, table, rates, common_lang

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """The set of all languages that hold each n-gram, as bits."""
        places = slots(grams, len(self.table))
        out = self.table[places[0]]
        for p in places[1:]:
            out = out & self.table[p]
        return out

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: how many of its n-grams each language holds, and its n-grams."""
        found, total = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for held in stretches(texts):
            for n in ORDERS:
                grams, rows = ngrams(held, n)
                masks = self.masks(grams)
                total += np.bincount(rows, minlength=len(texts))
                for i in range(len(self.langs)):
                    bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                    found[:, i] += np.bincount(rows, weights=bit.astype(np.float64), minlength=len(texts))
        return found, total

    def decide(self, found: np.ndarray, total: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text from its counts."""
        real = np.maximum(0, (found - total[:, None] * self.rates) / (1 - self.rates))
        every = real.sum(1)
        pred = [UNKNOWN if not n else self.langs[k] if s > 0 else self.common_lang for n, k, s in zip(total, real.argmax(1), every)]
        return pred, np.where(every > 0, real.max(1) / np.where(every > 0, every, 1), 0.0)


def fit(docs: DataFrame) -> LanguageFilter | None:
    """The filter of all rows with a text and a language; None if there are none. docs: text, lang."""
    good = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    seen = good.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row a language
    if not seen:
        return None
    langs = sorted(r["lang"] for r in seen)
    counts = common.written(gram_counts(good))
    totals = counts.groupBy("lang", "n").agg(F.sum("count").alias("all"))
    share = F.col("count") / F.col("all")
    parts = counts.join(F.broadcast(totals), ["lang", "n"]).select("lang", "n", "gram", share.alias("share"))  # languages x orders rows
    spread = parts.groupBy("n", "gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share")).alias("own"))  # a row a language at most
    kept = common.written(spread.select("gram", "most", F.explode("own").alias("own")).where((F.col("own.share") >= SHARE) & (F.col("own.share") >= RATIO * F.col("most"))).select("gram", F.col("own.lang").alias("lang")))
    most = max((r["count"] for r in kept.groupBy("lang").count().collect()), default=1)
    m = 1 << int(BITS * most - 1).bit_length()
    bit = {k: i for i, k in enumerate(langs)}

    def place(batches):
        for b in batches:
            i = np.array([bit[k] for k in b.column("lang").to_pylist()], np.int64)
            mask = common.to_long(np.uint64(1) << (i % 64).astype(np.uint64))
            for p in slots(b.column("gram").to_numpy().view(np.uint64), m):
                yield pa.RecordBatch.from_pydict({"slot": pa.array(p), "word": pa.array((i // 64).astype(np.int32)), "mask": pa.array(mask)})

    filled = kept.mapInArrow(place, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros((m, -(-len(langs) // 64)), np.uint64)
    table[filled["slot"].to_numpy(), filled["word"].to_numpy()] = filled["mask"].to_numpy().astype(np.int64).view(np.uint64)
    full = np.array([float(((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(langs))])
    common.discard(counts)
    common.discard(kept)
    return LanguageFilter(langs, table, np.minimum(full**HASHES, 0.999999), seen[0]["lang"])


def predict(docs: DataFrame, model: LanguageFilter | None, key: list[str]) -> DataFrame:
    """The columns of key with lang_pred and score. docs: key, text. Map-only."""
    rows = docs.select(*key, F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select(*key, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            pred, score = shared.value.decide(*shared.value.counts(b.column(len(key)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*key, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in key)
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op11(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.where(~common.train_fold("doc_id", 0)))
    found = predict(docs.select("doc_id", common.train_fold("doc_id", 0).alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")
