import unicodedata

import pyarrow as pa
import tokenizers
from pyspark.sql import types as T

from millrace.operators import bpe


class Mapped:
    """A table that gives the function which a map-only operator runs on its batches."""

    def __init__(self, fields):
        self.schema = T.StructType([T.StructField(n, t) for n, t in fields])
        self.columns = [n for n, _ in fields]

    def mapInArrow(self, run, schema):
        return run


def test_the_library_gets_bounded_blocks(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, sizes = tokenizers.Tokenizer.from_file(path), []

    class Counted:
        decoder = library.decoder

        @staticmethod
        def from_file(_):
            return Counted()

        def encode_batch(self, texts, **more):
            sizes.append(("letters", len(texts), sum(map(len, texts))))
            return library.encode_batch(texts, **more)

        encode_batch_fast = encode_batch

        def decode_batch(self, rows, **more):
            sizes.append(("ids", len(rows), sum(map(len, rows))))
            return library.decode_batch(rows, **more)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    monkeypatch.setattr(bpe, "BLOCK_LETTERS", 200, raising=False)
    monkeypatch.setattr(bpe, "BLOCK_IDS", 60, raising=False)
    texts = ["été " * (i % 40) + f"text {i}" for i in range(120)] + [None, "", " ", "x" * 1000, "done<|endoftext|>"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    fields = [("doc_id", T.LongType()), ("text", T.StringType())]
    coded = list(bpe.encode(Mapped(fields), path, 50256)([batch]))
    ids = [("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.IntegerType())]
    back = pa.Table.from_batches(list(bpe.decode(Mapped(fields + ids), path, 50256)(coded))).to_pylist()
    want = [(i, unicodedata.normalize("NFC", (t or "").strip())) for i, t in enumerate(texts)]
    want = [(i, t) for i, t in want if t]
    assert [r["doc_id"] for r in back] == [i for i, _ in want]
    for r, (_, t) in zip(back, want):
        own = library.encode(t, add_special_tokens=False).ids
        assert r["ids"] == (own if own[-1] == 50256 else [*own, 50256]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == t.removesuffix("<|endoftext|>")
    for kind, rows, size in sizes:
        assert rows == 1 or size <= (200 if kind == "letters" else 60)
