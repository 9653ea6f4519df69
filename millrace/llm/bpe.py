"""BPE encoding and decoding of whole texts with a public word-end vocabulary.

The merges of one word run over a segment tree. Leaf i holds rank * length + i of the
pair that starts at symbol i (infinity: no merge), inner nodes hold minima, so the root
names the leftmost pair of the lowest rank. A merge changes three leaves: its own, the
one it swallowed and the one before it, each in logarithmic time. It ends when the root is
infinite. Words are cut from the text by the tokenizer file's own rules, white space is
dropped there, so what lies between two white-space characters encodes on its own; encoded
chunks are kept in a bounded table of each Python worker.

Cases: a null text counts as empty and has no ids; special tokens in a text become their
ids, as in the library; a text without white space is one chunk and costs n log n.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

VOCABULARY = "word_bpe_49k.json"
#: Chunks that a worker keeps at most; beyond it the table starts anew.
CACHE_ENTRIES = 400_000
#: Bytes of texts that are split at once.
SLICE_BYTES = 4 << 20
_INF = 1 << 62
# White space of the tokenizer beyond ASCII.
_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Chunks that every Unicode version treats alike: printable ASCII, composed Latin-1 letters, general punctuation.
PLAIN = regex.compile("[!-~À-ÖØ-öø-ÿ‐-‧‰-⁞]*")
_ODD = r"[^\x09-\x0d\x20-\x7eÀ-ÖØ-öø-ÿ\x{2010}-\x{2027}\x{2030}-\x{205e}]"


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES):
    """Parts of a batch with about ``most`` bytes of text each, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, z - a)
        a = z


def split(texts: pa.Array) -> tuple[list[str], pa.Array, np.ndarray]:
    """Distinct chunks between white space, the number of each occurrence's chunk, and where each text's occurrences begin.

    Where all characters are plain, chunks are in lower case and a full stop or comma after a letter or digit is
    split off: it begins a word of its own in any case, and fewer chunks differ.
    """
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, _ODD)
    low = pc.replace_substring_regex(pc.utf8_lower(texts), "([0-9a-zà-öø-ÿ])([.,])", r"\1 \2")
    if pc.any(odd).as_py():
        low = pc.if_else(odd, pc.replace_substring_regex(texts, _SPACE, " "), low)
    lists = pc.ascii_split_whitespace(low)
    coded = lists.values.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices, lists.offsets.to_numpy()


def taken(pieces: list[bytes], indices: pa.Array, offsets: np.ndarray) -> list[memoryview]:
    """The pieces that indices names, put together for each stretch between offsets."""
    got = pa.array(pieces, pa.large_binary()).take(indices)
    if not len(got):
        return [memoryview(b"")] * (len(offsets) - 1)
    raw = memoryview(got.buffers()[2] or b"")
    bounds = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1)[offsets].tolist()
    return [raw[a:z] for a, z in zip(bounds, bounds[1:])]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(free))
        free += b not in shown
    return out


class _Table(dict):
    """A bounded dict that computes what is missing."""

    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, key):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        out = self[key] = self.compute(key)
        return out


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.cutter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.normalizer = Tokenizer.from_file(path).normalizer
        shown = _byte_symbols()
        self.inner = [vocab[c] for c in shown]
        self.last = [vocab[c + self.end] for c in shown]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.of_word = _Table(self.merge)
        self.of_chunk = _Table(self.chunk)

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word, by the segment tree."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        n = len(ids)
        if n == 1:
            return tuple(ids)
        get = self.merges.get
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [_INF] * (2 * size)
        for i in range(n - 1):
            if found := get((ids[i], ids[i + 1])):
                tree[size + i] = found[0] * n + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least

        while (root := tree[1]) < _INF:
            i = root % n
            j = after[i]
            ids[i] = get((ids[i], ids[j]))[1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                put(j, _INF)
            found = None
            if k < n:
                before[k] = i
                found = get((ids[i], ids[k]))
            put(i, found[0] * n + i if found else _INF)
            if (h := before[i]) >= 0:
                found = get((ids[h], ids[i]))
                put(h, found[0] * n + h if found else _INF)
        return tuple(x for x in ids if x >= 0)

    def words_of(self, chunk: str) -> list[str]:
        """The words of a text without white space and special tokens, in lower case."""
        if PLAIN.fullmatch(chunk):
            return self.words.findall(chunk.lower())
        return [w for w, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]

    def chunk(self, chunk: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of a text without white space and special tokens."""
        ids = [x for w in self.words_of(chunk) for x in self.of_word[w]]
        return np.array(ids, "<u4").tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[list, list]:
        """Of each text its ids as little-endian 32-bit integers, and their decoded text in UTF-8."""
        chunks, indices, offsets = split(texts)
        own = list(map(self.of_chunk.__getitem__, chunks))
        ids = taken(own, indices, offsets)
        decoded = [x[:-1] for x in taken([self.decode(np.frombuffer(x, "<u4").tolist()).encode() + b" " if x else b"" for x in own], indices, offsets)]
        special = pc.match_substring(pc.fill_null(texts, ""), "<|").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(special).tolist():
            ids[i] = self.encode(texts[i].as_py())
            decoded[i] = self.decode(np.frombuffer(ids[i], "<u4").tolist()).encode()
        return ids, decoded

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, in which special tokens may stand, as little-endian 32-bit integers."""
        out = []
        for x in self.split_special.split(text):
            if x in self.special:
                out.append(np.array([self.special[x]], "<u4").tobytes())
            elif x:
                chunks, indices, offsets = split(pa.array([x]))
                out.append(bytes(taken(list(map(self.of_chunk.__getitem__, chunks)), indices, offsets)[0]))
        return b"".join(out)

    def decode(self, ids) -> str:
        """The library's decode without a decoder step: token strings joined by a space."""
        return " ".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The tokenizer at path, built once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's text. Map-only."""
    path = path or default_path()

    def run(batches):
        bpe = load(path)
        for batch in (part for whole in batches for part in slices(whole)):
            ids, decoded = bpe.encode_all(batch.column("text"))
            sha = lambda x: pa.array([hashlib.sha256(v).hexdigest() for v in x], pa.string())
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, sha(ids), sha(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3(spark, sf_dir: str) -> DataFrame:
    return encode_decode(common.table(spark, sf_dir, "documents"))
