import random

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import bitmap, jaccard_join

from . import brute


def near_groups(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    texts = []
    passage = [word() for _ in range(40)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    base = [word() for _ in range(150)]
    for _ in range(60):  # one large group of near copies, links by chance
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = word()
        texts.append("\t".join(w).title())
    for _ in range(30):  # many share a passage
        texts.append(" ".join([*(word() for _ in range(rng.randint(5, 60))), *passage]))
    texts += ["a b c", "A b\tC", "a b", None, "", " \n", "x" * 3000, "x" * 3000] + ["one two three four five six"] * 9
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_components_match_brute_force(spark):
    for seed in (1, 2, 3):
        texts = near_groups(seed)
        df = spark.createDataFrame([(k, t, 1, "n") for k, t in texts.items()], "doc_id long, text string, n long, key string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
        assert got == brute.components(texts)


def test_edge_tables(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = jaccard_join.jaccard_components(spark.createDataFrame([(1, None), (2, "é"), (None, "é"), (2, "é"), (3, "É")], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows) == [(0, 1, 2), (1, 0, 1), (2, 1, 2), (2, 1, 2), (3, 1, 3)]


def test_marked_rows_hold_all_that_are_wanted(spark, monkeypatch):
    df = spark.range(20_000).select("id", (F.col("id") * 3).alias("_bit"))
    wanted = df.where("id % 50 = 7").select("id")
    got = bitmap.marked(df, ["id"], wanted, wanted.count())
    assert got.columns == ["id", "_bit", "_marked"] and got.count() == 20_000
    assert got.where("id % 50 = 7 and not _marked").count() == 0 and got.where("_marked").count() < 3_000
    monkeypatch.setattr(bitmap, "MOST_BITS", 10)
    assert bitmap.marked(df, ["id"], wanted, wanted.count()).where("not _marked").count() == 0  # too many to tell: all


def test_leads_of_linked_sets_share_enough():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(1, 90))
        x = rng.choice(10_000, n, replace=False)
        y = np.unique(np.append(x[rng.random(n) < rng.uniform(0.7, 1)], rng.choice(10_000, int(rng.integers(0, 1 + n // 4)))))
        common = len(np.intersect1d(x, y))
        if 100 * common >= 75 * (n + len(y) - common):
            a, b = (np.sort(s)[: jaccard_join.lead_size(len(s), 75)] for s in (x, y))
            for s in (x, y):
                assert len(np.intersect1d(a, b)) >= -(-jaccard_join.LEAD * -(-75 * len(s) // 100) // 100)
