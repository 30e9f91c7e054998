from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestar.functions import html as H
from lodestar.functions import text as T
from lodestar.functions.local import local_table
from lodestar.functions.lexicon import FIELDS, REPEATS
from lodestar.operators import evaluate, fuzzy, intent, ranking, search, vector
from lodestar.operators.index import corpus, read_index, write_index
from lodestar.sources import io

DATA = str(Path(__file__).parent / "data" / "people.jsonl")


def model_tokens(text):
    out, held = [], ""
    word = ""
    flush = lambda: [held] if 0 < len(held) <= 2 else [held[i : i + 2] for i in range(len(held) - 1)]
    for c in text.lower():
        if "一" <= c <= "鿿":
            if word:
                out.append(word)
                word = ""
            held += c
        elif c.isascii() and (c.isalnum() or c == "_"):
            if held:
                out += flush()
                held = ""
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + ([word] if word else []) + (flush() if held else [])


@pytest.fixture(scope="module")
def people(spark):
    docs = io.read_documents(spark, DATA).cache()
    return corpus(docs, FIELDS, "doc_id", "doc_ord", REPEATS)


def ask(spark, *rows):
    return local_table(spark, [(f"q{i}", q, f) for i, (q, f) in enumerate(rows)], "query_id string, query string, field string")


def names(index, rows):
    got = ranking.with_ids(rows, index, "name").orderBy("query_id", "rank").collect()
    return {q: [r.name for r in got if r.query_id == q] for q in {r.query_id for r in got}}


def test_documents(people):
    rows = people.docs.orderBy("doc_ord").collect()
    assert [r.doc_id for r in rows] == ["p1", "p2", "p3", "p4"] and rows[2].url == "" and rows[1].email == ""


def test_tokenizer_against_plain_model(spark):
    probes = ["自然语言处理", "图、论", "中", "", "a_b C9 é", "NLP方向 与AI 结合", "中 a 文字", "İ ſ 汉字x", "，中，文，"]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(probes)], "i int, p string").select("i", T.tokenize(F.col("p")).alias("t")).orderBy("i").collect()
    assert [list(r.t) for r in got] == [model_tokens(p) for p in probes]


def test_searches(spark, people):
    queries = ask(spark, ("赵文海", "name"), ("自然语言处理", "all"), ("计算机", "college"), ("NLP", "all"), ("赵文涛", "name"), ("医学影像", "all"), ("", "all"))
    got = names(people, search.optimized(people, queries, 5))
    assert got["q0"][0] == "赵文海" and got["q1"][0] == "赵文海" and len(got["q2"]) == 2 and got["q3"][0] == "赵文海" and got["q4"][0] == "赵文海" and got["q5"][0] == "孙丽" and "q6" not in got
    base = names(people, search.baseline(people, queries, 5))
    assert base["q0"] == ["赵文海"] and base["q1"][0] == "赵文海" and "q4" not in base


def test_facet_restricts_but_statistics_stay_global(spark, people):
    got = names(people, search.adaptive(people, ask(spark, ("数学学院 图论", "all")), 5))
    assert got["q0"] == ["李静"]


def test_stored_index_gives_the_same(spark, people, tmp_path):
    write_index(people, str(tmp_path))
    stored = read_index(spark, str(tmp_path), people)
    queries = ask(spark, ("机器学习 深度学习", "all"))
    key = lambda rows: [(r.rank, r.ord, round(r.score, 9)) for r in rows.orderBy("rank").collect()]
    assert key(ranking.top_k(ranking.flat_scores(people, queries), 5)) == key(ranking.top_k(ranking.flat_scores(stored, queries), 5))
    assert key(search.adaptive(people, queries, 5)) == key(search.adaptive(stored, queries, 5))


def test_plan_broadcasts_terms_and_limits(spark, people):
    plan = ranking.top_k(ranking.flat_scores(people, ask(spark, ("机器学习", "all"))), 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and "CartesianProduct" not in plan


def test_gate(spark):
    rows = [("自然语言处理", False), ("ACL 机器翻译论文", False), ("纳米学院 论文比较多的柔性传感器老师", False), ("研究人类语言理解和文本分析的老师", True), ("研究智能问答和知识表示的老师", False), ("有没有老师研究机器翻译和跨语言处理", False)]
    got = intent.gate(intent.analyze(ask(spark, *[(q, "all") for q, _ in rows]))).orderBy("query_id").collect()
    assert [r.use_semantic for r in got] == [x for _, x in rows]


def test_kinds(spark):
    rows = [("计算机学院 机器学习", "college_research"), ("计科院", "college"), ("副教授", "title"), ("教授 图论", "title_research"), ("Nature 文章", "paper"), ("图论", "research"), ("推荐几位", "colloquial"), ("柔性电子", "general")]
    got = intent.analyze(ask(spark, *[(q, "all") for q, _ in rows])).orderBy("query_id").collect()
    assert [r.kind for r in got] == [k for _, k in rows]
    assert got[2].title == "副教授" and got[1].college == "计算机科学与技术学院" and got[1].search_text == "计科院"
    assert intent.analyze(ask(spark, ("x", "name"))).first().kind == "name"


def test_similarity_and_bonus(spark, people):
    got = spark.createDataFrame([("赵文海", "赵文涛"), ("", "a"), (" A ", "a"), ("abc", "xyz")], "a string, b string").select(fuzzy.similarity("a", "b").alias("s")).collect()
    assert [round(r.s, 1) for r in got] == [66.7, 0.0, 100.0, 0.0]
    bonus = {r.query_id: r.bonus for r in fuzzy.field_bonus(people, ask(spark, ("文海", "all"), ("孙丽莉", "all"), ("一个很长的查询文本", "all"))).collect()}
    assert bonus == {"q0": 8.0}


def test_fusion(spark):
    rows = lambda xs: spark.createDataFrame([("q", i + 1, x, ["t"]) for i, x in enumerate(xs)], "query_id string, rank int, ord long, matched_terms array<string>")
    got = ranking.fuse([rows([1, 2]), rows([3, 2])], None, 10).orderBy("rank").collect()
    assert [r.ord for r in got] == [2, 1, 3] and got[0].score == pytest.approx(2 / 62)
    with pytest.raises(ValueError):
        ranking.fuse([rows([1])], [1.0, 2.0], 5)


def test_vectors(spark, people):
    v = spark.createDataFrame([("机器学习",), ("",)], "t string").select(vector.hash_vector(F.col("t")).alias("v")).collect()
    assert sum(x * x for x in v[0].v) == pytest.approx(1.0) and len(v[0].v) == 512 and not any(v[1].v)
    got = names(people, search.semantic(people, ask(spark, ("医学图像分析", "all")), 3))
    assert got["q0"][0] == "孙丽" and len(got["q0"]) == 3
    with pytest.raises(ValueError):
        vector.encoder("other")
    with pytest.raises(vector.EncoderMissing):
        vector.encoder("sentence-transformers")


def test_modes_and_engines(spark, people):
    queries = ask(spark, ("研究人类语言理解和文本分析的老师", "all"), ("图论", "all"))
    assert set(search.MODES) >= {"baseline", "fielded", "adaptive", "optimized", "semantic", "hybrid_semantic", "conditional_semantic"}
    assert names(people, search.conditional(people, queries, 3))["q1"][0] == "李静"
    assert names(people, search.hybrid(people, queries, 3))["q1"][0] == "李静"
    assert names(people, search.served(people, ask(spark, ("机器学习", "all")), 4, college="数学")).get("q0", []) in ([], ["李静"])
    with pytest.raises(ValueError):
        search.engine("none")
    assert search.engine("bm25") is search.baseline


def test_metrics(spark):
    queries = spark.createDataFrame([("q1", "a"), ("q2", None)], "query_id string, category string")
    results = spark.createDataFrame([("q1", 1, "x"), ("q1", 2, "y"), ("q1", 3, "z")], "query_id string, rank int, doc_id string")
    qrels = spark.createDataFrame([("q1", "y", 3), ("q1", "x", 1), ("q1", "w", 2)], "query_id string, doc_id string, relevance int")
    rows = {r.category: r for r in evaluate.evaluate(results, queries, qrels).collect()}
    dcg, ideal = 1 / 1 + 7 / 1.584962500721156, 7 / 1 + 3 / 1.584962500721156
    assert rows["a"].precision == pytest.approx(0.2) and rows["a"].mrr == 0.5 and rows["a"].ndcg == pytest.approx(dcg / ideal)
    assert rows["uncategorized"].ndcg == 0 and rows[None].cases == 2


def test_lookups(people):
    assert search.lookup(people.docs, "p3").count() == 1 and search.lookup(people.docs, "none").count() == 0
    assert search.listing(people.docs, "计算机").count() == 2
    assert [(r["name"], r["count"]) for r in search.facet_counts(people.docs, ord_col="doc_ord").collect()][0] == ("计算机科学与技术学院", 2)
    ids = people.docs.sparkSession.createDataFrame([(["p3", "none", "p1"],)], "ids array<string>")
    assert [r.doc_id for r in search.selected(people.docs, ids).collect()] == ["p3", "p1"]
    assert [r.name for r in search.sort_results(people.docs, "name").collect()] == ["李静", "钱敏", "孙丽", "赵文海"]


def test_urls(spark):
    rows = [("HTTP://A.B/x?q#f", "http://a.b/x?q"), ("//h", "https://h/"), ("https://H", "https://h/")]
    got = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "i int, u string").select("i", H.normalize_url(F.col("u")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [n for _, n in rows]
    page = '<a href="/a.html">x</a><a href="b/">y</a><a href="c.pdf">z</a><a href="https://o.org/">o</a><a href="/a.html#t">again</a><a href="mailto:x">m</a>'
    links = spark.createDataFrame([("https://h.org/d/", page)], "u string, p string").select(H.discover_links(F.col("u"), F.col("p")).alias("l")).first().l
    assert list(links) == ["https://h.org/a.html", "https://h.org/d/b/"]
    fixed = spark.createDataFrame([("“//site.org/a”",), ("site.org/li",), ("http://site.org/x.htm",)], "u string").select(H.repair_url(F.col("u"), "site.org").alias("r")).collect()
    assert [r.r for r in fixed][1:] == ["https://site.org/li/", "https://site.org/x.htm"]
    q = spark.createDataFrame([("http://h/?a=1&b=%25E4%25B8%25AD",)], "u string").select(H.query_map(F.col("u")).alias("m")).first().m
    assert q["a"] == "1"
    back = spark.createDataFrame([("%25E4%25B8%25AD",)], "u string").select(H.repeated_unquote(F.col("u")).alias("r")).first().r
    assert back == "中"


def test_sources(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query": "a", "category": "exact_name"}\n\n{"query": "b", "relevant": ["x", "y"]}\n', encoding="utf-8")
    queries, inline = io.read_queries(spark, str(tmp_path / "q.jsonl"))
    assert [(r.query_id, r.field) for r in queries.orderBy("query_id").collect()] == [("Q001", "name"), ("Q003", "all")]
    assert sorted((r.query_id, r.doc_id, r.relevance) for r in inline.collect()) == [("Q003", "x", 3), ("Q003", "y", 3)]
    (tmp_path / "r.jsonl").write_text('{"query_id":"q","doc_id":"d","relevance":1}\n{"query_id":"q","doc_id":"d","relevance":3}\n{"query_id":"q","doc_id":"e"}\n', encoding="utf-8")
    assert sorted((r.doc_id, r.relevance) for r in io.read_qrels(spark, str(tmp_path / "r.jsonl")).collect()) == [("d", 3), ("e", 1)]
    (tmp_path / "unit").mkdir()
    (tmp_path / "unit" / "seeds.csv").write_text("﻿college,name,url\nA, n ,http://h/1\n,m,http://h/2\nB,k,\n", encoding="utf-8")
    rows = io.read_seeds(spark, f"{tmp_path}/*/seeds.csv").orderBy("url").collect()
    assert [(r.college, r.name, r.url) for r in rows] == [("A", "n", "http://h/1"), ("unit", "m", "http://h/2")]
    io.write_seeds(io.read_seeds(spark, f"{tmp_path}/*/seeds.csv"), str(tmp_path / "out"))
    assert io.read_seeds(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "unit" / "a.html").write_bytes(b"<p>x\xff</p>")
    assert [(r.folder, r.raw_key, r.html) for r in io.read_page_folders(spark, str(tmp_path)).collect()] == [("unit", "a.html", "<p>x</p>")]
    io.write_documents(io.read_documents(spark, DATA), str(tmp_path / "docs"))
    assert io.read_documents(spark, str(tmp_path / "docs")).count() == 4
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        (tmp_path / "bad.jsonl").write_text("{bad\n", encoding="utf-8")
        io.read_documents(spark, str(tmp_path / "bad.jsonl")).collect()
