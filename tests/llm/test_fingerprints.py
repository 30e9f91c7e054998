import hashlib
import random

import numpy as np

from lodestar.llm import fingerprints as fp
from lodestar.llm import textvec as V


def brute_winnow(text, k, w):
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    h = V.prefix_hash(V.mix(cp.astype(np.uint64) + np.uint64(1)))
    g = (V.rolling_hash(h, k) >> np.uint64(32)).tolist()
    w = min(w, len(g))
    out = {}
    for i in range(len(g) - w + 1):
        best = min(range(i, i + w), key=lambda j: (g[j], -j))
        out[best] = g[best]
    return sorted(out.items())


def test_winnow_matches_brute_force_and_guarantee():
    rng = random.Random(3)
    for n in (0, 1, 5, 12, 13, 40, 300):
        for alphabet in ("a", "ab", "abcdefgé\U0001f600"):
            t = "".join(rng.choice(alphabet) for _ in range(n))
            h, pos = fp.winnow(V.code_points(np.frombuffer(t.encode(), np.uint8)), 4, 6)
            if n >= 4:
                assert list(zip(pos.tolist(), h.tolist())) == brute_winnow(t, 4, 6)
            a, b = fp.from_text(fp.to_text(h, pos))
            assert a.tolist() == h.tolist() and b.tolist() == pos.tolist()
    shared = "".join(rng.choice("abcdef") for _ in range(31))
    x, y = ("".join(rng.choice("abcdef") for _ in range(200)) + shared + "".join(rng.choice("abcdef") for _ in range(200)) for _ in range(2))
    a, b = (set(fp.winnow(V.code_points(np.frombuffer(t.encode(), np.uint8)))[0].tolist()) for t in (x, y))
    assert a & b


def test_far_positions_round_trip():
    h, pos = np.array([5, 0, 7, 0, 0], np.uint32), np.array([300, 555, 9000, 9254, 9764])
    a, b = fp.from_text(fp.to_text(h, pos))
    assert a.tolist() == h.tolist() and b.tolist() == pos.tolist()


def test_edited_pairs(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_PART", 7)
    rng = random.Random(1)
    texts = [None, "", "é", "abc"] + ["".join(rng.choice("abcdefg \n") for _ in range(rng.randint(1, 400))) for _ in range(60)] + ["z" * 5000] * 3
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in fp.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string, part string")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[i * 3]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other, following = (np.unique(fp.winnow(V.code_points(np.frombuffer(x.encode(), np.uint8)))[0]) for x in (t, edited, nxt))
        assert r.near_edited == fp.likeness(own, other) and r.near_next == fp.likeness(own, following)


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert fp.edited_pairs(spark.createDataFrame([], schema)).count() == 0
    one = fp.edited_pairs(spark.createDataFrame([(1, "abcd" * 9)], schema)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fp.edited_pairs(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (None, None)], schema)).count() == 4
    assert fp.fingerprint(spark.createDataFrame([(1, None), (2, "same"), (3, "same")], schema)).select("fingerprint").distinct().count() == 2
