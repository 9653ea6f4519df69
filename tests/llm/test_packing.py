import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe, packing


def brute(at, cost, window, every=True):
    """Least cost; with every = False, unpadded powers under window / 32 only in the last window."""
    best = [0]
    for j in range(1, len(at)):
        options = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= window:
                free = n & (n - 1) == 0 and (every or 32 * n >= window or at[j] > at[-1] - window)
                options.append(best[i] + (0 if free else window - n))
        best.append(min(options) + cost[j] + 1)
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=60), st.data())
def test_cuts_cost_least(gaps, data):
    at = np.r_[0, np.cumsum(gaps)]
    cost = np.array([0] + [data.draw(st.integers(0, 9)) for _ in gaps])
    cuts = packing.choose_cuts(at, cost, 16)
    n = np.diff(cuts)
    assert (n <= 16).all() and cuts[0] == 0 and cuts[-1] == at[-1]
    paid = sum((0 if x & (x - 1) == 0 else 16 - x) + 1 for x in n.tolist()) + sum(cost[np.searchsorted(at, c)] for c in cuts[1:])
    assert paid == brute(at.tolist(), cost.tolist(), 16)


def test_cuts_cost_least_in_the_production_window():
    rng = np.random.default_rng(8)
    for turn in range(25):
        at = np.r_[0, np.cumsum(rng.choice([1, 3, 16, 32, 64, 100, 128, 500, 512, 1024, 2048], 150))]
        cost = np.r_[0, rng.choice([0, 1, 16], 150)]
        cuts = packing.choose_cuts(at, cost)
        n, where = np.diff(cuts), np.searchsorted(at, cuts[1:])
        free = (n & (n - 1) == 0) & ((32 * n >= 2048) | (cuts[1:] > at[-1] - 2048))
        assert (n <= 2048).all() and cuts[-1] == at[-1]
        assert int((np.where(free, 0, 2048 - n) + 1 + cost[where]).sum()) == brute(at.tolist(), cost.tolist(), 2048, every=False)


def test_repeated_and_null_ids(spark):
    rows = [(None, "one two"), (None, None), (7, "a b c"), (7, "a b c"), (7, "")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got) == [(0, 1), (0, 3), (7, 1), (7, 4), (7, 4)]
    assert [r.offset for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))][0] == 0


def check(rows, texts):
    """Every id of every document in one piece, sequences gapless and short enough; share of padding."""
    library = Tokenizer.from_file(bpe.default_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, got in by_doc.items():
        ids = [*library.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for got in by_seq.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / max(1, total)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert check(packing.op10(spark, sf_dir).collect(), {d.doc_id: d.text for d in docs}) < 0.01


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "x" * 3000, 5: "A. B! C?"}
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, start int")
    check(packing.pack(docs).collect(), texts)
    assert packing.pack(docs.limit(0)).count() == 0


def test_blocks_cut_long_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 700)
    enc = packing.LibraryEncoder(bpe.default_path())
    ids = np.arange(5000, dtype=np.uint32) % 300
    out, n = packing.pack_block([(7, ids[:700], 0, 5000), (7, ids[700:], 700, 5000)], enc.sentence, 0)
    assert sum(out.column("length").to_pylist()) == 5000 and n >= 3
