import random
from collections import Counter

import pytest
import regex

from millrace.operators import bpe, bpe_training

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def plain(texts, merges, least=2):
    """Recounts everything for each merge: the most frequent pair, ties to the older symbols; a pair that spells a token becomes it."""
    import unicodedata

    words = Counter(w for t in texts for w in regex.findall(PATTERN, unicodedata.normalize("NFC", t)))
    names = [bytes([b]) for b in bpe_training.BYTES]
    state, out, known = {w: [bpe_training.BYTES.index(b) for b in w.encode()] for w in words}, [], set()
    while len(names) - 256 < merges:
        counts = Counter()
        for w, f in words.items():
            for p in zip(state[w], state[w][1:]):
                counts[p] += f
        left = [(-c, p) for p, c in counts.items() if c >= least and p not in known]
        if not left:
            break
        a, b = min(left)[1]
        known.add((a, b))
        name = names[a] + names[b]
        if name not in names:
            names.append(name)
        out.append((names[a], name[len(names[a]) :]))
        new = names.index(name)
        for w, s in state.items():
            i, made = 0, []
            while i < len(s):
                hit = s[i : i + 2] == [a, b]
                made.append(new if hit else s[i])
                i += 2 if hit else 1
            state[w] = made
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    parts = ["th", "e", "an", "in", "ab", "aba", "é", "中", "ß", "ing", "a", "aa", "12", "'s", "é", "\n", "!"]
    return [" ".join("".join(rng.choice(parts) for _ in range(min(6, 1 + int(rng.expovariate(0.6))))) for _ in range(rng.randint(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("merges,batch,keep,sample", [(90, 40, 60, 20), (90, 4096, 16384, 200_000), (90, 30, 50, 0), (10_000, 4096, 16384, 100)])
def test_rounds_give_the_greedy_merges(spark, merges, batch, keep, sample):
    texts = corpus(3, 60)
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string")
    assert bpe_training.train(df, merges, bpe.PATTERN, batch=batch, keep=keep, sample=sample) == plain(texts, merges)


def test_nothing_to_merge(spark):
    df = spark.createDataFrame([("abc",)], "text string")
    assert bpe_training.train(df, 5, bpe.PATTERN) == [] and bpe_training.train(df.limit(0), 5, bpe.PATTERN) == []


def test_few_rounds_where_most_words_are_rare(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(2, 9))) for _ in range(40)) for _ in range(60)]
    rounds, counted = [], bpe_training.pair_table
    monkeypatch.setattr(bpe_training, "pair_table", lambda words: rounds.append(1) or counted(words))
    assert bpe_training.train(spark.createDataFrame([(t,) for t in texts], "text string"), 150, bpe.PATTERN, sample=1500) == plain(texts, 150)
    assert len(rounds) <= 12


def test_a_merge_that_spells_a_token_ends_the_round(spark):
    texts = ["a" * n + " " + "ab" * n + " " + "aab" * (n % 5) for n in range(1, 40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert bpe_training.train(df, 40, bpe.PATTERN) == plain(texts, 40)
