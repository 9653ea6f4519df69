import hashlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe, packing

TEXTS = [
    None, "", " ", "Hello, world's  été 12", "ΑΣ ΣΑΣ İstanbul", "a\x1cb \x85 c　d e", "é ́x", "<|startoftext|>Hi<|endoftext|> <| x",
    "x" * 3000, "aaaa bbbb" * 50, "日本語 텍스트 🙂🙂", "it's we'll I'd 'dx 's", "\x00\x01 tab\tnl\n", "!!! ### $$$ %%%&&&", "1234567890", "<|STARTOFTEXT|>", "ﬁ ǅ ẞ ß", "Σİ.", "aΣİ., x",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def compare(library, texts):
    ids, decoded = bpe.load(bpe.default_path()).encode_all(pa.array(texts, pa.string()))
    packed = packing.encoder(bpe.default_path()).encode(pa.array(texts, pa.string()))
    for text, own, back, raw in zip(texts, ids, decoded, packed):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(own, "<u4").tolist() == want, text
        assert np.frombuffer(raw, "<u4").tolist() == want, text
        assert bytes(back).decode() == library.decode(want, skip_special_tokens=False), text


def test_ids_and_text_match_the_library(library):
    compare(library, TEXTS)
    for text in TEXTS:
        compare(library, [text])
    compare(library, [])


def test_every_code_point(library):
    """Alone, after a letter with a full stop behind it, and between digits."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 97 == 0)]
    for a in range(0, len(points), 20_000):
        compare(library, [f"{c} a{c}. 1{c}2 x.,{c}" for c in points[a : a + 20_000]])


def test_random_mixtures(library):
    rng = np.random.default_rng(4)
    marks = np.array([*"aZéÉßñŸÿ×÷ºµ.,!?'\"-0 \t\n\u3000\x85\x1c\xa0ΣσİıΩ漢\u0301“”…—", "'s", "'LL", "<|", "<|endoftext|>"])
    compare(library, ["".join(rng.choice(marks, rng.integers(1, 30))) for _ in range(30_000)])


def test_documents_match_the_library(spark, library, sf_dir):
    got = {r.doc_id: r for r in bpe.op3(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "z"), (1, "a b", 7, "z"), (None, None, 1, "q")], "doc_id long, text string, n_tokens int, ids_sha256 string")
    assert bpe.encode_decode(docs).count() == 3
    assert bpe.encode_decode(docs.limit(0)).count() == 0
