import hashlib
import random
import re

from lodestar.llm import decontaminate as dc
from lodestar.llm import scratch


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, k=8):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        if not iw or item is None:
            continue
        n = min(k, len(iw))
        for i in range(len(iw) - n + 1):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == iw[i : i + n]:
                    found.add(str(item))
                    hit |= set(range(p, p + n))
    return len(w), len(hit), sorted(found)


def case(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "the", "Éé", "x1", "of", "zu"]) if rng.random() < 0.6 else "".join(rng.choice("pqrst") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 25)))) for i in range(12)] + [(3, "second text of item three with some more words in it"), (50, None), (51, "..."), (None, "no id here at all")]
    texts = [None, "", "--", "THE", "the the the"]
    for _ in range(60):
        w = [word() for _ in range(rng.randint(1, 50))]
        for _ in range(rng.randint(0, 2)):
            iw = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(iw) - 8))
            w[rng.randint(0, len(w)) : 0] = iw[a : a + rng.randint(6, 14)]
        texts.append(rng.choice([" ", "-", ", "]).join(w))
    return items, [*texts, texts[7], "x " * 20000]


def test_against_brute_force(spark):
    for seed in (1, 2):
        items, texts = case(seed)
        docs = spark.createDataFrame([(i // 2 if i > 60 else i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, pos int")
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.decontaminate(docs, bench).collect())
        want = []
        for r in docs.collect():
            n, hit, found = brute(r.text, items)
            want.append((r.doc_id, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), len(found) >= 2))
        assert got == sorted(want)


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_items) for r in dc.decontaminate(docs, none).collect()] == [(2, 0)]
    assert dc.decontaminate(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_shuffled_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_WORDS", 0)
    test_against_brute_force(spark)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "gamma z alpha beta"), (2, "alpha q q q q q q q q q beta gamma")], "doc_id long, text string")
    index, terms, n = dc.index_and_terms(docs, spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string"))
    assert {r.doc for r in dc.proximity_matches(index, terms, n).collect()} == {1}


def test_scratch_folder(spark):
    t = scratch.persist_table(spark.range(3).toDF("n"), "t")
    assert t.count() == 3
    scratch.drop_table(t)
