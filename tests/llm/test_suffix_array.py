import random

import numpy as np
import pytest

from lodestar.llm import suffix_array as sa


def text(s):
    return np.append(np.frombuffer(s, np.uint8).astype(np.int16) + 1, 0).astype(np.int16)


def check(s, cap, tmp_path, budget=sa.BUDGET):
    t = text(s)
    pos, lcp = (np.concatenate(x) for x in zip(*sa.SuffixSorter(t, str(tmp_path), cap, budget).descending(), strict=True))
    b = t.astype(np.uint16).byteswap().tobytes()
    n = len(t)
    assert sorted(pos.tolist()) == list(range(n))
    suffix = lambda p: b[2 * p : 2 * (p + cap)]
    for i in range(1, n):
        x, y = int(pos[i - 1]), int(pos[i])
        assert suffix(x) >= suffix(y), (s, i)
        k = 0
        while k < cap and x + k < n and y + k < n and t[x + k] == t[y + k]:
            k += 1
        assert int(lcp[i]) == k, (s, cap, i, x, y, int(lcp[i]), k)


@pytest.mark.parametrize("budget", [sa.BUDGET, 200])
def test_random_strings(tmp_path, budget, monkeypatch):
    monkeypatch.setattr(sa, "BLOCK", 7)
    rng = random.Random(5)
    for _ in range(150):
        alphabet = rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        s = bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 90)))
        if rng.random() < 0.5:
            s = s[:20] * rng.randint(1, 6) + s
        check(s, rng.choice([3, 10, 400]), tmp_path, budget)


def test_doubling_and_recursion(tmp_path, monkeypatch):
    rng = random.Random(9)
    base = bytes(rng.choice(b"abcd ") for _ in range(500))
    s = base + b"x" + base[100:400] + b"y" + base + b"aaaa" * 30 + base[:50]
    check(s, 60, tmp_path)
    monkeypatch.setattr(sa, "MAX_SIGMA", 2)
    check(s, 60, tmp_path)


def test_groups():
    blocks = [(np.array([5, 6, 7]), np.array([0, 9, 9], np.uint16)), (np.array([8, 9, 1]), np.array([9, 0, 3], np.uint16)), (np.array([2, 3]), np.array([9, 0], np.uint16))]
    got = [(p.tolist(), g.tolist()) for p, g, _ in sa.equal_groups(iter(blocks), 9)]
    assert got == [([5, 6, 7, 8], [0, 0, 0, 0]), ([1, 2], [0, 0])]
