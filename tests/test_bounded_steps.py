"""Steps whose memory, shuffles and plans must not grow faster than their input."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestar.functions import text as T
from lodestar.functions.batches import Best, tokens
from lodestar.operators import fuzzy, ranking, search, vector
from lodestar.operators.index import FLAT, corpus, read_index, write_index

from .test_entry import SF
from .test_retrieval import ask, people  # noqa: F401

here = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
PROBES = ["自然语言处理", "图、论", "中", "", "a_b C9 é", "NLP方向 与AI 结合", "中 a 文字", "İ ſ 汉字x", "，中，文，", "x", "Red  ring", "red ring red"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_without_shuffle(spark):
    df = spark.createDataFrame(list(enumerate(PROBES)), "i long, t string")
    rows = vector.sparse_counts(df, "i", "t")
    assert "Exchange" not in plan(rows)
    got = np.zeros((len(PROBES), vector.DIMENSIONS))
    for r in rows.collect():
        got[r.id, r.dim] = r.value
    want = np.array([r.v for r in df.orderBy("i").select(vector.hash_vector(F.col("t")).alias("v")).collect()])
    assert np.allclose(got, want, atol=1e-12)


def test_vector_search_in_blocks_of_queries(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, f"f{i % 3}") for i, t in enumerate(PROBES * 5)], "ord long, text string, facet string")
    asked = [("a", "red ring", ""), ("b", "语言处理", "f1"), ("c", "zzzz", ""), ("d", "", "f2"), ("e", "x", "none")]
    queries = spark.createDataFrame(asked, "query_id string, text string, value string")
    unit = {r.t: np.array(r.v) for r in spark.createDataFrame([(t,) for t in {*PROBES, *(a[1] for a in asked)}], "t string").select("t", vector.hash_vector(F.col("t")).alias("v")).collect()}
    want = set()
    for q, text, value in asked:
        s = sorted((-round(float(unit[t] @ unit[text]), 9), i) for i, t in enumerate(PROBES * 5) if value in f"f{i % 3}")
        want |= {(q, n + 1, i) for n, (_, i) in enumerate(s[:7])}
    for block in (4096, 2):
        monkeypatch.setattr(vector, "BLOCK", block)
        found = vector.sparse_search(docs, queries, 7)
        assert {(r.query_id, r["rank"], r.ord) for r in found.collect()} == want
    assert "CartesianProduct" not in plan(found) and "BroadcastNestedLoopJoin" not in plan(found)


def test_best_rows_over_batches():
    g, best = np.random.default_rng(1), Best(3, 4)
    s = g.integers(0, 5, (3, 60)).astype(float)
    for a in range(0, 60, 7):
        best.add(s[:, a : a + 7], np.arange(a, min(a + 7, 60)))
    for i in range(3):
        assert list(best.ords[i]) == sorted(range(60), key=lambda x: (-s[i, x], x))[:4]


def test_plain_tokens(spark):
    got = spark.createDataFrame(list(enumerate(PROBES)), "i int, t string").select("i", F.lower("t").alias("low"), T.tokenize(F.col("t")).alias("w")).collect()
    assert all(tokens(r.low) == list(r.w) for r in got)


def test_index_is_made_without_shuffle(spark, people, tmp_path):  # noqa: F811
    raw = corpus(spark.createDataFrame(list(enumerate(PROBES)), "i long, t string"), ("t",), "i")
    assert "Exchange" not in plan(raw.counted()) and "Exchange" not in plan(raw.postings())
    write_index(people, str(tmp_path), terms=False)
    kept = read_index(spark, str(tmp_path), people)
    assert kept.stored_terms is None
    fields = people.docs.select(*people.fields).collect()
    want = {}
    for r in fields:
        own = {f: set(tokens((r[f] or "").lower())) for f in people.fields}
        for f, words in [*own.items(), (FLAT, set().union(*own.values()))]:
            for w in words:
                want[f, w] = want.get((f, w), 0) + 1
    for index in (people, kept):
        assert {(r.field, r.term): r.df for r in index.term_counts().collect()} == want


@here
@pytest.mark.parametrize("name", ["hash_vector", "fuzzy_names", "mode_semantic", "tokenize_df"])
def test_no_index_where_none_is_read(spark, monkeypatch, name):
    from lodestar.plans import catalogue

    def never(*a, **k):
        raise AssertionError("index")

    monkeypatch.setattr(catalogue, "kept_index", never)
    entry.queries()[name](spark, SF)


def test_similar_names_are_compared_once(spark, monkeypatch):
    df = spark.createDataFrame([(" A ", "a"), ("abc", "xyz"), (" A ", "a"), (None, "a")], "a string, b string")
    assert [r.s for r in df.select(fuzzy.similarity("a", "b").alias("s")).collect()] == [100.0, 0.0, 100.0, 0.0]


def test_conditional_plan_is_cut(spark, people):  # noqa: F811
    rows = search.conditional(people, ask(spark, ("研究人类语言理解和文本分析的老师", "all")), 3)
    assert len(plan(rows)) < 60_000 and "InMemoryRelation" not in plan(rows)


def test_batch_search_where_documents_lie(spark, people, monkeypatch):  # noqa: F811
    queries = ask(spark, ("机器学习 深度学习 机器学习", "all"), ("自然语言处理", "all"), ("计算机", "all"), ("", "all"), ("nothing_at_all", "all"), ("图论 教授 计算机科学", "all"))
    small = corpus(spark.createDataFrame([(i, " ".join(PROBES[: i % 12 + 1])) for i in range(40)], "i long, t string"), ("t",), "i")
    key = lambda rows: sorted((r.query_id, r["rank"], r.ord, round(r.score, 9), tuple(r.matched_terms)) for r in rows.collect())
    for index, asked in ((people, queries), (small, ask(spark, ("red ring", "all"), ("red red 处理 x", "all"), ("ai nlp", "all")))):
        want = key(ranking.top_k(ranking.flat_scores(index, asked), 3))
        assert want and key(ranking.flat_best(index, asked, 3)) == want
        with monkeypatch.context() as m:
            m.setattr(ranking, "PASS_TERMS", 2)
            m.setattr(ranking, "TRIPLES", 3)
            m.setattr(ranking, "CELLS", 8)
            assert key(ranking.flat_best(index, asked, 3)) == want


@here
def test_ordered_files_grow_in_number(spark, monkeypatch):
    from lodestar.plans import catalogue

    paths, write = [], catalogue.written
    monkeypatch.setattr(catalogue, "written", lambda *a: paths.append(write(*a)) or paths[-1])
    monkeypatch.setattr(catalogue, "RANGE_BYTES", 20_000)
    rows = entry.queries()["documents_jsonl_order"](spark, SF).collect()
    assert len([f for f in os.listdir(paths[0]) if f.startswith("part-")]) > 4
    assert [int(r.doc_id) for r in sorted(rows, key=lambda r: r.doc_ord)] == sorted(int(r.doc_id) for r in rows) and [r.doc_ord for r in sorted(rows, key=lambda r: r.doc_ord)] == list(range(len(rows)))
