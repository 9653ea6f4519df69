"""Byte-level BPE: pre-tokens, pair counts, training rounds and encoding.

Training (``bpe_training``) works on the table of distinct pre-tokens with their counts, many merges a round.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import bpe_training

#: Letters of texts, and ids, that the tokenizers library has at once in a task (a longer text is a block of its own).
BLOCK_LETTERS = 1 << 19
BLOCK_IDS = 1 << 17
# The published pattern of byte-level pre-tokens.
PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def word_counts(docs: DataFrame, text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """Distinct pre-tokens as arrays of byte symbols (two hex digits each), with counts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("freq"))
    return words.select(F.regexp_extract_all(F.hex(F.encode("w", "UTF-8")), F.lit(".."), F.lit(0)).alias("symbols"), "freq")


def pair_counts(words: DataFrame) -> DataFrame:
    """How often each adjacent pair occurs."""
    pairs = F.arrays_zip(F.expr("slice(symbols, 1, greatest(size(symbols) - 1, 0))").alias("a"), F.expr("slice(symbols, 2, greatest(size(symbols) - 1, 0))").alias("b"))
    return words.where(F.size("symbols") > 1).select(F.explode(pairs).alias("p"), "freq").groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("freq").alias("count"))


def train(docs: DataFrame, merges: int, min_frequency: int = 2, text: str = "text") -> list[tuple[str, str]]:
    """The merges that make so many new tokens, in order, as hex digits: the most frequent pair first, ties to the older symbols (``bpe_training``)."""
    return [(a.hex().upper(), b.hex().upper()) for a, b in bpe_training.train(docs, merges, PATTERN, min_frequency, text)]


def blocks(sizes, most: int):
    """Stretches (begin, end) of rows whose sizes sum up to most, or of one larger row."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if len(sizes) > begin:
        yield begin, len(sizes)


def encode(docs: DataFrame, tokenizer_path: str, eos: int, text: str = "text") -> DataFrame:
    """docs with ids: NFC, the tokenizer file's own rules, the end id unless it is there; blank texts and empty results go. Map-only.

    The library's own record of a token takes far more room than its id, so a batch is encoded in blocks of letters.
    """
    out = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType())])
    names = [f.name for f in out]
    place = docs.columns.index(text)

    def run(batches):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer_path)
        for whole in batches:
            for begin, end in blocks(pc.fill_null(pc.utf8_length(whole.column(place)), 0).to_pylist(), BLOCK_LETTERS):
                b = whole.slice(begin, end - begin)
                texts = [unicodedata.normalize("NFC", (t or "").strip()) for t in b.column(place).to_pylist()]
                found = [np.array(e.ids, np.int32) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
                keep = pa.array([bool(t) and len(i) > 0 for t, i in zip(texts, found)])
                found = [i if len(i) and i[-1] == eos else np.append(i, np.int32(eos)) for i in found]
                n = np.array([len(i) for i in found], np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array(n)], names=names).filter(keep)

    return docs.mapInArrow(run, out)


def decode(encoded: DataFrame, tokenizer_path: str, special: int, ids: str = "ids") -> DataFrame:
    """encoded with a column decoded: the text of the ids, without the special id at their end. Map-only."""
    out = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    names, place = [f.name for f in out], encoded.columns.index(ids)

    def run(batches):
        from tokenizers import Tokenizer, decoders

        own = Tokenizer.from_file(tokenizer_path)
        own.decoder = own.decoder or decoders.ByteLevel()
        for whole in batches:
            for begin, end in blocks(pc.fill_null(pc.list_value_length(whole.column(place)), 0).to_pylist(), BLOCK_IDS):
                b = whole.slice(begin, end - begin)
                rows = [x[:-1] if x and x[-1] == special else x or [] for x in b.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.decode_batch(rows, skip_special_tokens=False), pa.string())], names=names)

    return encoded.mapInArrow(run, out)


def token_id(tokenizer_path: str, token: str, fallback: int | None = None) -> int:
    """The id of a token; a missing one has the fallback or is an error."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path).token_to_id(token)
    if found is None and fallback is None:
        raise ValueError(f"the tokenizer has no token {token!r}")
    return fallback if found is None else found


def quality(encoded: DataFrame, unknown: int, by: list[str], text: str = "text") -> DataFrame:
    """Bytes a token and unknown tokens of each group of encoded texts; the end id is no token of the text."""
    n = F.col("n_tokens") - 1
    return encoded.groupBy(*by).agg((F.sum(F.octet_length(text)) / F.sum(n)).alias("bytes_per_token"), F.sum(F.size(F.filter("ids", lambda i: i == unknown))).cast("long").alias("unknown"))


def save(merges: list[tuple[str, str]], special: list[str], path: str) -> None:
    """A tokenizer file for the library: special tokens first, then the 256 bytes in the order of their characters, then the merges (hex symbols) in order."""
    import json

    name = lambda h: "".join(bpe_training.CHARACTERS[c] for c in bytes.fromhex(h))
    order = [*special, *sorted(bpe_training.CHARACTERS), *(name(a + b) for a, b in merges)]
    spec = {
        "version": "1.0", "truncation": None, "padding": None, "post_processor": None,
        "added_tokens": [{"id": i, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, t in enumerate(special)],
        "normalizer": {"type": "NFC"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {t: i for i, t in enumerate(dict.fromkeys(order))}, "merges": [[name(a), name(b)] for a, b in merges]},
    }
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f, ensure_ascii=False)
