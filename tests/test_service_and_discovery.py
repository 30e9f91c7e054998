import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestar import service
from lodestar.__main__ import main, metrics
from lodestar.functions.lexicon import FIELDS, REPEATS
from lodestar.operators import corpus as C
from lodestar.operators.index import corpus
from lodestar.settings import Settings, settings
from lodestar.sources import discovery, fetch, io

DATA = str(Path(__file__).parent / "data" / "people.jsonl")


def test_service(spark):
    index = corpus(io.read_documents(spark, DATA), FIELDS, "doc_id", "doc_ord", REPEATS)
    got = service.search_response(index, "图论", top_k=3)
    assert got["results"][0]["name"] == "李静" and got["total"] == len(got["results"]) and "图论" in got["results"][0]["matched_terms"]
    assert service.search_response(index, "机器学习", college="电子", engine="bm25")["results"][0]["name"] == "孙丽"
    assert service.document_response(index, "p1")["name"] == "赵文海" and service.document_response(index, "x") is None
    assert service.stats_response(index)["total_teachers"] == 4
    for bad in ({"query": ""}, {"query": "x", "top_k": 101}):
        with pytest.raises(ValueError):
            service.search_response(index, **bad)


def test_discovery(spark):
    one = lambda c, **cols: spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(c.alias("x")).first().x
    page = '<a class="x news_box y" href="/t1"><b>Li</b> Na</a><a href="/other">no</a>'
    assert [(r.href, r.text) for r in one(discovery.static_cards(F.col("h")), h=page)] == [("/t1", "Li Na")]
    body = json.dumps({"title": "A", "data": [{"name": "B", "url": "https://s.org/b", "more": {"u": "//s.org/c"}}, "s.org/d"], "again": "https://s.org/b"})
    assert [(r.name, r.url) for r in one(discovery.json_seeds(F.col("t"), "s.org"), t=body)] == [("B", "https://s.org/b"), ("B", "//s.org/c"), ("A", "s.org/d")]
    assert list(one(discovery.json_seeds(F.col("t"), "s.org"), t="not json")) == []
    assert one(discovery.total_pages(F.col("t"), 10), t='{"x": {"total": "21"}}') == 3 and one(discovery.total_pages(F.col("t"), 10), t="") == 1
    assert one(discovery.clean_name(F.col("t")), t=" Li \n Na  访问 12") == "Li Na"
    body = json.loads(one(discovery.query_payload(F.create_map(F.lit("orgId"), F.col("t")), F.lit(2), 14), t="15"))
    assert body["page"] == 2 and body["conditions"] == [{"field": "orgId", "value": "15", "judge": "="}]
    assert discovery.page_diagnostics(spark.createDataFrame([(page,)], "html string")).first().anchors == 2


def test_decode():
    assert fetch.decode("中文".encode("gb18030")) == "中文" and fetch.decode("中文".encode()) == "中文" and fetch.decode(b"plain") == "plain"


def test_engine_handles(spark):
    plain = service.engine(spark, "stub", DATA)
    assert plain is service.engine(spark, "stub", DATA) and plain is not service.engine(spark, "bm25", DATA)
    with pytest.raises(ValueError):
        service.engine(spark, "none", DATA)
    got = plain.search(" 李静 ", field="name")
    assert [(r["name"], r["score"], r["matched_terms"]) for r in got["results"]] == [("李静", 100.0, ["李静"])]
    assert plain.search("电子", field="college")["results"][0]["score"] == 1.0 and plain.search("图论")["results"][0]["score"] == 10.0
    every = plain.documents()
    assert len(every) == plain.stats()["total_teachers"] and all(len(d["profile"] or "") <= 300 for d in every)
    some = plain.documents("电子")
    assert some and all("电子" in d["college"] for d in some) and plain.document(every[0]["doc_id"])["name"] == every[0]["name"]


def test_settings(spark, monkeypatch):
    assert settings(spark) == Settings()
    monkeypatch.setenv("LODESTAR_SEMANTIC", "No")
    monkeypatch.setenv("LODESTAR_SEMANTIC_WEIGHT", "0.2")
    assert settings(spark) == Settings(semantic=False, semantic_weight=0.2)
    spark.conf.set("spark.lodestar.semantic_weight", "0.3")
    try:
        assert settings(spark).semantic_weight == 0.3 and settings(spark, semantic_weight=0.4).semantic_weight == 0.4
    finally:
        spark.conf.unset("spark.lodestar.semantic_weight")
    with pytest.raises(TypeError):
        settings(spark, colour="red")


def test_evaluate_command(spark, tmp_path):
    asked = tmp_path / "q.jsonl"
    asked.write_text("".join(json.dumps(q, ensure_ascii=False) + "\n" for q in [{"query_id": "a", "query": "图论", "field": "all", "category": "x"}, {"query_id": "b", "query": "李静", "field": "name", "category": "y"}]))
    best = service.engine(spark, "bm25", DATA).search("图论")["results"][0]["doc_id"]
    qrels = tmp_path / "qrels.jsonl"
    qrels.write_text(json.dumps({"query_id": "a", "doc_id": best, "relevance": 3}) + "\n")
    got = metrics(spark, DATA, str(asked), str(qrels), ["baseline"], 5, 2)["baseline"]
    assert got["by_category"]["x"]["mrr"] == 1.0 and got["by_category"]["y"]["mrr"] == 0.0 and got["overall"]["cases"] == 2
    with pytest.raises(SystemExit):
        main(["evaluate", "--data", DATA, "--queries", str(asked), "--modes", "baseline,none"])


def test_ledger_takes_the_seeds_college_and_name(spark):
    page = "<html><body><p>Li Na</p></body></html>"
    pages = spark.createDataFrame([("https://s.org/a.html", page, "fetched"), ("https://s.org/b.html", page, "fetched"), ("https://s.org/c.html", None, "fetch_error")], "url string, html string, status string")
    seeds = spark.createDataFrame([("https://s.org/a.html", "Physics", "Wang"), ("https://s.org/c.html", "Maths", "Zhao")], "url string, college string, name string")
    got = {r.url[-6]: r for r in C.crawl_ledger(pages, include_nonteacher=True, seeds=seeds).collect()}
    assert got["a"].name == "Wang" and got["a"].college == "Physics" and got["a"].status == "saved"
    assert got["b"].name != "Wang" and got["b"].status == "saved" and got["c"].status == "fetch_error"
