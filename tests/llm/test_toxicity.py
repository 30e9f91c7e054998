import numpy as np

from lodestar.llm import toxicity as tox


def test_gradients_match_differences(monkeypatch):
    rng = np.random.default_rng(0)
    net = tox.Net(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    monkeypatch.setattr(tox.np, "float32", np.float64)
    words = 9
    own = np.sort(np.concatenate([np.arange(words), rng.integers(0, words, 20)]))
    ids = rng.integers(0, 500, len(own))
    index = rng.integers(0, words, (tox.WINDOW, 4))
    mask = np.arange(tox.WINDOW)[:, None] < np.array([tox.WINDOW, 3, 17, 1])
    y = np.array([1.0, 0.0, 0.0, 1.0])
    _, grad = net.loss_and_gradients(ids, own, words, index, mask, y)
    for k, v in net.p.items():
        flat, g = v.reshape(-1), np.asarray(grad[k]).reshape(-1)
        for j in rng.choice(np.flatnonzero(g) if k == "E" else len(flat), min(5, len(flat)), replace=False):
            old = flat[j]
            flat[j] = old + 1e-5
            up = net.loss_and_gradients(ids, own, words, index, mask, y)[0]
            flat[j] = old - 1e-5
            down = net.loss_and_gradients(ids, own, words, index, mask, y)[0]
            flat[j] = old
            assert abs((up - down) / 2e-5 - g[j]) < 1e-6, k


def test_windows_cover_every_word():
    counts = np.array([0, 1, 31, 32, 33, 48, 49, 200])
    doc, first = tox.windows(counts)
    for k, n in enumerate(counts):
        covered = set()
        for a in first[doc == k]:
            assert 0 <= a <= max(0, n - tox.WINDOW)
            covered |= set(range(a, min(n, a + tox.WINDOW)))
        assert covered == set(range(n))


def corpus(spark, n, seed):
    rng = np.random.default_rng(seed)
    plain = ["the", "river", "stone", "walks", "over", "green", "hills", "and", "sings", "morning"]
    rows = []
    for i in range(n):
        w = list(rng.choice(plain, rng.integers(5, 150)))
        bad = bool(rng.random() < 0.3)
        if bad:
            for _ in range(3):
                w[rng.integers(len(w))] = rng.choice(["grubsnark", "grubling", "vilegrub"])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_learns_held_out_and_unseen_words(spark):
    rows = corpus(spark, 300, 1)
    docs = spark.createDataFrame([(i, t, "score") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = tox.fit(docs, labels.where("doc_id < 220"))
    got = {r.doc_id: r.score for r in tox.score(docs, model).collect()}
    held = [(got[i] >= tox.THRESHOLD) == bool(y) for i, _, y in rows if i >= 220]
    assert np.mean(held) > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "river stone grubsnarks walks"), (4, "river"), (None, "x" * 9000)], "doc_id long, text string")
    s = [(r.doc_id, r.score) for r in tox.score(odd, model).collect()]
    assert len(s) == 6 and all(0 <= x <= 1 for _, x in s) and s[0][1] == s[1][1] == s[2][1] < tox.THRESHOLD
    again = tox.fit(docs, labels.where("doc_id < 220"))
    assert all(np.array_equal(again["net"].p[k], model["net"].p[k]) for k in model["net"].p)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = tox.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [round(r.score, 3) for r in tox.score(docs, model).collect()] == [0.0, 0.0]
    assert tox.score(docs.limit(0), model).count() == 0


def test_training_bound_is_not_lowered():
    from lodestar.llm import toxicity

    assert toxicity.TOXIC_DOCS >= 2500 and toxicity.CLEAN_DOCS >= 4000
