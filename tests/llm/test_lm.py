import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import lm


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 40)
    monkeypatch.setattr(lm, "TRAIN_DOCS", 40)
    monkeypatch.setattr(lm, "HEAD", 3000)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def check_base(got, rows):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c, ends = Counter(), 0
    for i, t in rows:
        if not fold(i):
            c.update(words(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    want = []
    for i, t in rows:
        counts = [c[w] for w in words(t)] + [ends]
        want.append((-1 if i is None else i, fold(i), len(counts), sum(x > 0 for x in counts), n, sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in counts)))
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * (1 + abs(b[5]))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_base(lm.op7(spark, sf_dir).collect(), rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b A"), (3, "a b A"), (None, "x" * 5000), (4, "é\x85ü"), (5, "\x1cq r")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    check_base(lm.Scorer(df).score().collect(), rows)
    assert lm.Scorer(df.limit(0)).score().count() == 0


def random_model(seed, factor=1.0):
    rng = np.random.default_rng(seed)
    n = lm.SINGLES + 2 * lm.GROUPS
    m = lm.Model(n, rng, np.arange(lm.IDS) % n, np.zeros(lm.IDS), 50)
    m.flat = m.flat * np.float32(factor) + rng.normal(0, 0.1, len(m.flat)).astype(np.float32)
    return m, rng, n


def flattened(sequences):
    return np.concatenate(sequences), np.array([*map(len, sequences)])


def scored(m, sequences, most=None):
    ids, lengths = flattened(sequences)
    return np.split(lm.log_probs(m, ids, lengths, most)[0], np.cumsum(lengths)[:-1])


def plain(m, s):
    """The model written out, one place after another, in double precision."""
    w = {k: v.astype(float) for k, v in m.views(m.flat).items()}
    e, inputs = m.E.astype(float), np.r_[lm.END, s[:-1]]
    out, opening = [], []
    for i, target in enumerate(m.class_of[s].tolist()):
        x, begin = e[inputs[i]], i // lm.BLOCK * lm.BLOCK
        weight, value = [], []
        for j in range(max(0, begin - lm.BLOCK), i + 1):
            score = x @ w["Q"] @ (e[inputs[j]] @ w["K"]) / np.sqrt(lm.DIM) + w["B"][i - begin, j - begin + lm.BLOCK]
            weight.append((1 + score / lm.POWER) ** lm.POWER)
            value.append(e[inputs[j]] @ w["V"])
        h = x + (np.array(weight) @ np.array(value) / sum(weight)) @ w["O"]
        z = np.append(h + np.maximum(h @ w["W1"] + w["c1"], 0) @ w["W2"], 1)
        outer = z @ w["U"]
        inner = (z @ w["S"][m.family[target]])[: (m.family == m.family[target]).sum()]
        log_sum = lambda v: v.max() + np.log(np.exp(v - v.max()).sum())
        out.append(outer[m.family[target]] - log_sum(outer) + inner[m.slot[target]] - log_sum(inner))
        opening.append(log_sum(outer[: m.opening]) - log_sum(outer))
    return np.array(out), np.array(opening)


def test_forward_pass_as_written_out():
    m, rng, n = random_model(5)
    sequences = [rng.integers(0, lm.IDS, k) for k in (1, 40, 100)]
    ids, lengths = flattened(sequences)
    p, opening = lm.log_probs(m, ids, lengths)
    want = [plain(m, s) for s in sequences]
    assert np.allclose(p, np.concatenate([x for x, _ in want]), atol=1e-3)
    assert np.allclose(opening, np.concatenate([x for _, x in want]), atol=1e-3)


def test_scores_are_those_of_the_plain_model(spark, sf_dir):
    """Every score from the written-out forward pass, the mixture and counts, word by word."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 400").limit(25)
    scorer = lm.Scorer(docs)
    rows, m, bpe = docs.collect(), scorer.model, lm.encoder(scorer.path)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for r in rows if not fold(r.doc_id) for w in words(r.text))
    ends = sum(not fold(r.doc_id) for r in rows)
    begun = Counter({m.class_of[lm.END]: ends})
    for w, k in c.items():
        begun[m.class_of[bpe.encode_ordinary(" " + w)[0]]] += k
    got = {r.doc_id: r.score for r in scorer.score().collect()}
    for r in rows:
        own = [bpe.encode_ordinary(" " + w) for w in words(r.text)] + [[lm.END]]
        ids = np.array([i for x in own for i in x])
        p, opening = plain(m, ids)
        at, want = 0, 0.0
        for w, x in zip([*words(r.text), None], own):
            spelled = p[at : at + len(x)].sum() + m.log_share[x].sum() - opening[at] + (opening[at + len(x)] if w is not None else 0)
            whole = np.exp(p[at] - opening[at]) * (ends if w is None else c[w]) / max(1, begun[m.class_of[x[0]]])
            want += math.log10(lm.MIX * whole + (1 - lm.MIX) * math.exp(spelled) + 1e-300)
            at += len(x)
        assert abs(got[r.doc_id] - want) < 1e-3 * (1 + abs(want))


def test_gradients():
    m, rng, n = random_model(1)
    m.flat, m.E, m.gap = m.flat.astype(np.float64), m.E.astype(np.float64), m.gap.astype(np.float64)
    c, t = rng.integers(0, n, (4, lm.BLOCK)), rng.integers(0, n, (4, lm.BLOCK))
    first, real = np.array([True, False, True, False]), rng.random((4, lm.BLOCK)) < 0.8

    def slope(w, at):
        old, d = w[at], []
        for e in (1e-5, -1e-5):
            w[at] = old + e
            d.append(m.gradients(c, first, t, real)[0])
        w[at] = old
        return (d[0] - d[1]) / 2e-5

    _, own, rows, flat = m.gradients(c, first, t, real)
    assert own.tolist() == sorted(set(c.ravel().tolist()))
    for k, begin, end, _ in m.spans:
        for at in rng.integers(begin, end, 6).tolist():
            assert abs(slope(m.flat, at) - flat[at]) < 1e-5, k
    for i in range(6):
        assert abs(slope(m.E, (own[i], i)) - rows[i, i]) < 1e-5


def test_each_id_is_scored_once_whatever_the_batch():
    m, rng, n = random_model(2, factor=3)
    sequences = [rng.integers(0, lm.IDS, k) for k in (1, 31, 32, 33, 700, 5000)]
    one = [scored(m, [s])[0] for s in sequences]
    for a, b, c in zip(one, scored(m, sequences), scored(m, sequences, most=3)):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-3) and np.allclose(a, c, rtol=1e-4, atol=1e-3)
    # a later id doesn't change an earlier score
    s = sequences[4].copy()
    s[500:] = 7
    assert np.allclose(scored(m, [s])[0][:500], one[4][:500], rtol=1e-4, atol=1e-3)


def test_words_outside_the_head_keep_their_counts(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    scores = []
    for head in (5, 100_000):
        monkeypatch.setattr(lm, "HEAD", head)
        scores.append([r.score for r in lm.Scorer(docs).score().orderBy("doc_id").collect()])
    assert len(scores[0]) == 60 and np.allclose(*scores, rtol=1e-9)


def test_every_training_document_is_learned_from_whole(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 1)
    monkeypatch.setattr(lm, "TRAIN_DOCS", 2)
    seen, own = [], lm.averaged
    monkeypatch.setattr(lm, "averaged", lambda model, total: (seen.append(total[: len(model.E), lm.DIM].sum()), own(model, total)))
    rows = [(i, "one two three " * (1 + i * 40)) for i in range(60)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    lm.Scorer(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sum(seen) == sum(3 * (1 + i * 40) + 1 for i, _ in rows)


def test_long_texts_are_learned_from_to_their_end():
    rng = np.random.default_rng(3)
    n = lm.SINGLES + 2 * lm.GROUPS
    m = lm.Model(n, rng, np.minimum(np.arange(lm.IDS), n - 1), np.zeros(lm.IDS), 50)
    s = np.r_[rng.integers(0, 20, 30_000), np.tile([40, 41], 20_000)]
    before = scored(m, [s])[0][-2000:].mean()
    assert lm.train_whole(m, [flattened([s])], 0.01)[0] == len(s)
    assert scored(m, [s])[0][-2000:].mean() > before + 1


def test_attention_sees_each_id_and_the_block_before():
    m, rng, n = random_model(4)
    s = rng.integers(0, lm.IDS // n * n - n, 64)
    one = scored(m, [s])[0]
    other = s.copy()
    other[30] = s[30] + n  # another id of the same class, 33 before the last
    two = scored(m, [other])[0]
    assert m.class_of[other[30]] == m.class_of[s[30]]
    assert np.allclose(one[:31], two[:31], atol=1e-5) and abs(one[63] - two[63]) > 1e-5


def test_words_longer_than_any_piece(spark):
    text = "ab" * 20_000
    (row,) = lm.Scorer(spark.createDataFrame([(3, text)], "doc_id long, text string")).score().collect()
    assert row.n_tokens == 2 and math.isfinite(row.score)


def test_words_go_to_the_tokenizer_together(monkeypatch):
    """Few calls of the tokenizer, and the ids that each word has by itself, other white space at its edges included."""
    path, rng, calls = lm.default_path(), np.random.default_rng(6), []
    bpe = lm.encoder(path)

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(bpe, name)

    letters = np.array(list("abX\xe9\xdf1.'s-_\x1c\u0300\u200b\u4e2d\U0001f642") + ["\x85", "\xa0", "\u2003", "\u3000"])
    words = ["".join(rng.choice(letters[:-4], k)) for k in rng.integers(1, 8, 3000)] + ["".join(rng.choice(letters, k)) for k in rng.integers(1, 4, 50)] + ["\xa0", "a\xa0", "\xa0b"]
    monkeypatch.setitem(lm._ENCODERS, path, Counted())
    ids, begin = lm.encoded(pa.array(words), path, lm.opening_ids(path))
    odd = sum(any(x in w for x in letters[-4:]) for w in words)
    assert sum(k.startswith("encode") for k in calls) <= 1 + odd
    assert [ids[a:z].tolist() for a, z in zip(begin, begin[1:])] == [bpe.encode_ordinary(" " + w) for w in words]
    for few in ([], ["\xa0"]):
        ids, begin = lm.encoded(pa.array(few, pa.string()), path, lm.opening_ids(path))
        assert ids.tolist() == [i for w in few for i in bpe.encode_ordinary(" " + w)] and begin.tolist() == [0, len(ids)][: len(few) + 1]


def test_scoring_keeps_nothing_for_gradients():
    m, rng, n = random_model(7)
    c, first = rng.integers(0, lm.IDS, (2 * lm.PART + 1, lm.BLOCK)), rng.random(2 * lm.PART + 1) < 0.5
    whole, scoring = m.forward(c, first), m.forward(c, first, m.queries())
    assert scoring["kept"] is None and np.allclose(whole["z"], scoring["z"], atol=1e-4)


def test_counts_of_words_sent_on_in_parts(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 300, 200)) for _ in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]) for t in texts]
    for most in (10, 400, 1_000_000):
        monkeypatch.setattr(lm, "COUNTED", most)
        got, parts = Counter(), 0
        for b in lm._count(iter(batches)):
            parts += 1
            for w, c in zip(b.column("word").to_pylist(), b.column("c").to_pylist()):
                got[w] += c
        assert got == Counter(w for t in texts for w in t.split()) and (parts == 1 or most == 10)
