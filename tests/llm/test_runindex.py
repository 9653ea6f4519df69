import random

import pytest

from millrace.llm import runindex


def brute(phrases, depth):
    seen, out = set(), []
    for p in phrases:
        flags = []
        for i in range(len(p) - depth + 1):
            flags.append(p[i : i + depth] in seen)
            seen.add(p[i : i + depth])
        out.append(flags)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_small_depths(seed):
    rng = random.Random(seed)
    depth = rng.choice([1, 2, 3, 5])
    phrases = [bytes(rng.choices([0, 1, 255], k=rng.randrange(0, 25))) for _ in range(rng.randrange(1, 40))]
    assert [x.tolist() for x in runindex.repeats(phrases, depth)] == brute(phrases, depth)


@pytest.mark.parametrize("seed", range(4))
def test_depth_of_production(seed):
    rng = random.Random(seed)
    base = bytes(rng.choices(range(256), k=600))
    phrases = []
    for _ in range(120):
        a = rng.randrange(450)
        p = bytearray(base[a : a + rng.randrange(60, 169)])
        if rng.random() < 0.5 and p:
            p[rng.randrange(len(p))] = rng.randrange(256)
        phrases.append(bytes(p))
    phrases += [b"ab" * 80, b"ab" * 84, b"a" * 150, phrases[0], phrases[0]]
    assert [x.tolist() for x in runindex.repeats(phrases)] == brute(phrases, 100)
