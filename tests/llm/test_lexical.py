import math
import random
import re

import pytest

from millrace.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans(lexical.UPPER, lexical.LOWER)


def plain(docs, items, k=50):
    """docs: id, text; items: id, text."""
    own = [(i, TERM.findall((t or "").translate(FOLD))) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n, total = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        terms = [t for t in set(TERM.findall((text or "").translate(FOLD))) if t in df]
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms}
        scores = [(-sum(w[t] * (10**9 * d.count(t) // (1000 * d.count(t) + 20 * (50 + 50 * len(d) * n // total))) for t in terms), i is None, i or 0) for i, d in own]
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(out, key=str)


def found(docs, items, k=50):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.TieredIndex(docs).search(items, k).collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(lexical, "TIERS", (2, 4))
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(lexical, "ITEMS", 3)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "Ñu", "ñu", "x-y", "a1", "é", "日本", "z" * 90, *(f"w{i}" for i in range(200))]
    text = lambda: " ".join(words[min(int(rng.expovariate(0.05)), len(words) - 1)] for _ in range(rng.randint(0, 60)))
    return [(i, text()) for i in range(n)]


@pytest.mark.parametrize("k", [1, 5, 50])
def test_against_plain_ranking(spark, small, k):
    docs = corpus(1, 300) + [(1000, None), (1001, ""), (1002, "-- !"), (None, "the w3 w4"), (5, "the w3 w4"), (5, "the w3 w4"), (1003, "w3 " * 3000)]
    items = [(i, " ".join(t.split()[:9])) for i, t in corpus(2, 12)] + [(50, None), (51, "?!"), (52, "unseen"), (53, "THE the"), (53, "w150 the of"), (None, "w3 w4 w3")]
    got = found(spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k)
    assert got == plain(docs, items, k)


def test_many_copies_tie_by_id(spark, small):
    docs = [(i, "alpha beta gamma") for i in range(200)] + [(300 + i, f"alpha w{i} delta") for i in range(100)] + [(900, None)]
    items = [(1, "alpha beta"), (2, "delta alpha")]
    assert found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")) == plain(docs, items)


def test_only_unproved_pairs_fall_through(spark, small, monkeypatch):
    """Rare terms prove themselves in tier 0; a common one must go down."""
    docs = [(i, f"common rare{i // 2} " + "filler " * (i % 17)) for i in range(240)]
    rounds, own = [], lexical.TieredIndex._round

    def watch(self, lists, asked, tiers, k):
        rounds.append((tiers, {r.item for r in asked.select("item").distinct().collect()}, asked.select("item", "block").distinct().count()))
        return own(self, lists, asked, tiers, k)

    monkeypatch.setattr(lexical.TieredIndex, "_round", watch)
    items = [(0, "rare5"), (1, "common")]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    assert found(df, asked, 2) == plain(docs, items, 2)
    assert rounds[0][0] == 1 and len(rounds[0][1]) == 2
    assert all(len(r[1]) == 1 and r[2] < rounds[0][2] for r in rounds[1:])
    rounds.clear()
    assert found(df, asked, 100) == plain(docs, items, 100)
    assert len(rounds) > 1 and len(rounds[1][1]) == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert found(docs.limit(0), items) == [] and found(docs, items.limit(0)) == []
    assert found(docs, items) == plain([(1, "a b")], [(1, "a")])
