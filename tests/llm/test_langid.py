import random
import zlib

import numpy as np
import pytest

from millrace.llm import langid

SF = "/root/testdata/sf0.01"
M = 2**64 - 1


def plain_hash(gram):
    h = len(gram)
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) & M
    x = (h + 0x9E3779B97F4A7C15) & M
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M
    return x ^ x >> 31


def plain_grams(text):
    """Letters in lower case, words between spaces, n-grams of 2 and 4 inside padded words."""
    folded = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    return [w[i : i + n] for word in folded.split() for w in [f" {word} "] for n in (2, 4) for i in range(len(w) - n + 1)]


def plain_fit(rows):
    """Sets of n-grams by language, and the documents of each language."""
    counts, docs = {}, {}
    for text, lang in rows:
        if text is not None and lang is not None:
            docs[lang] = docs.get(lang, 0) + 1
            for g in plain_grams(text):
                counts.setdefault((lang, len(g)), {}).setdefault(g, 0)
                counts[lang, len(g)][g] += 1
    share = {k: {g: c / sum(v.values()) for g, c in v.items()} for k, v in counts.items()}
    sets = {}
    for (lang, n), v in share.items():
        most = lambda g: max(share.get((other, n), {}).get(g, 0) for other in docs)  # noqa: B023, E731
        sets.setdefault(lang, set()).update(g for g, p in v.items() if p >= langid.SHARE and p >= langid.RATIO * most(g))
    return sets, docs


def plain_filters(sets):
    """One Bloom filter a language, as a set of slots, and the table's size."""
    m = 1 << (langid.BITS * max(map(len, sets.values())) - 1).bit_length()
    at = lambda g: {((h := plain_hash(g)) + i * (h >> 32 | 1)) % m for i in range(langid.HASHES)}
    return {k: set().union(*map(at, v)) for k, v in sets.items()}, m, at


def plain_predict(text, filters, m, at, docs):
    grams = plain_grams(text)
    if not grams:
        return "und", 0.0
    real = {}
    for lang, full in sorted(filters.items()):
        rate = (len(full) / m) ** langid.HASHES
        real[lang] = max(0.0, (sum(at(g) <= full for g in grams) - len(grams) * rate) / (1 - rate))
    if not sum(real.values()):
        return min(docs, key=lambda k: (-docs[k], k)), 0.0
    best = max(real, key=lambda k: real[k])
    return best, real[best] / sum(real.values())


def texts(seed, n):
    rng = random.Random(seed)
    letters = {"aa": "abcdeé", "bb": "bcdfgß", "cc": "дежзи"}
    return [(" ".join("".join(rng.choice(v) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 40))), k) for _ in range(n) for k, v in letters.items()]


def test_stretches_of_long_texts_keep_every_gram():
    asked = [*(t for t, _ in texts(4, 10)), None, "a", "é" * 100, "a b  c" * 50]
    for chunk in (1, 2, 7, 61, 1 << 19):
        got = {}
        for held in langid.stretches(asked, chunk):
            for n in langid.ORDERS:
                for g, r in zip(*langid.ngrams(held, n)):
                    got.setdefault(int(r), []).append(int(g))
        assert all(sorted(got.get(i, [])) == sorted(map(plain_hash, plain_grams(t))) for i, t in enumerate(asked)), chunk


def test_against_plain_filters(spark):
    train = [*texts(1, 30), (None, "aa"), ("дада", None), ("", "bb")]
    asked = [*(t for t, _ in texts(2, 25)), None, "", "12 -- !", "ŁŁŁŁ", "Ab", "abc" * 400, "É é É"]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string"), model, ["doc_id"]).collect()}
    sets, docs = plain_fit(train)
    filters, m, at = plain_filters(sets)
    for i, t in enumerate(asked):
        pred, score = plain_predict(t, filters, m, at, docs)
        assert got[i][0] == pred and got[i][1] == pytest.approx(score, abs=1e-12), t


def test_masks_hold_every_language_of_a_gram(spark):
    rows = texts(3, 20)
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    sets, _ = plain_fit(rows)
    for g in sorted(set().union(*sets.values()))[:300]:
        mask = int(model.masks(np.array([plain_hash(g)], np.uint64))[0, 0])
        assert all(mask >> model.langs.index(k) & 1 for k, v in sets.items() if g in v)


def test_more_than_64_languages(spark):
    rows = [(chr(0x4E00 + 7 * i) * 3 + " " + chr(0x4E01 + 7 * i) * 2, f"l{i:03}") for i in range(70)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.table.shape[1] == 2
    found = langid.predict(spark.createDataFrame(rows, "text string, lang string"), model, ["lang"]).collect()
    assert all(r.lang == r.lang_pred and 0 < r.score <= 1 for r in found)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (1, "", "en", 1), (1, "a b", None, 1), (None, "x" * 100_000, "en", 2), (None, "x" * 100_000, "en", 2)], "doc_id long, text string, lang string, score int")
    model = langid.fit(docs)
    assert sorted((r.lang_pred, r.score > 0) for r in langid.predict(docs, model, ["doc_id"]).collect()) == [("en", False), ("en", True), ("en", True), ("und", False), ("und", False)]
    assert langid.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(docs, None, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model, ["doc_id"]).count() == 0


def test_query_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = langid.op11(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert np.mean([docs[r.doc_id].lang == r.lang_pred for r in held]) > 0.98
