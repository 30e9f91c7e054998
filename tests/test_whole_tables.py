"""Queries that answer for whole tables, against their SQL and plain versions."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestar.functions import html as H
from lodestar.operators import corpus as C
from lodestar.operators import vector

from .test_entry import SF, duck, rows  # noqa: F401

here = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def matches_sql(spark, duck, name):  # noqa: F811
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert len(got) and sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    return got


@here
@pytest.mark.parametrize("name", ["vector_topk_all", "vector_allowlist_all"])
def test_every_twentieth_vector_is_a_query(spark, duck, name):  # noqa: F811
    got = matches_sql(spark, duck, name)
    assert set(got.query_id) == {f"q{r[0]}" for r in duck.sql("select vec_id from embeddings where vec_id % 20 = 0").fetchall()}


def test_vector_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 7)
    g = np.random.default_rng(3)
    v = g.integers(-2, 3, (50, 4)).astype(float)  # small whole numbers: many ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ord long, v array<double>")
    asked = df.where("ord % 3 = 0").selectExpr("'q' || ord as query_id", "v as qv")
    got = {(r.query_id, r["rank"]): (r.ord, r.score) for r in vector.vector_search_blocks(df, asked, 5).collect()}
    want = {(f"q{q}", i + 1): (j, v[q] @ v[j]) for q in range(0, 50, 3) for i, j in enumerate(sorted(range(50), key=lambda j: (-(v[q] @ v[j]), j))[:5])}
    assert got == want


@pytest.fixture
def some_pages(spark, tmp_path):
    """70 pages in chains of 7, each with a link to the next, to a page that is not there and to another host."""
    page = lambda i: f'<a href="/p{i + 1}">n</a><a href="/gone{i}">g</a><a href="http://other.x/o{i % 3}">o</a>'
    df = spark.createDataFrame([(i, f"http://h{i // 7}.x/p{i}", page(i)) for i in range(70)], "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    return df


def test_crawl_reaches_all_pages(spark, tmp_path, some_pages):
    urls = {r.url for r in some_pages.collect()}
    links = {f"http://h{i // 7}.x/{x}" for i in range(70) for x in (f"p{i + 1}", f"gone{i}")}
    got = {r.url: (r.level, r.status) for r in entry.queries()["crawl"](spark, str(tmp_path)).collect()}
    assert got == {u: (0, "fetched") if u in urls else (1, "fetch_error") for u in urls | links}


def test_crawl_levels_and_limit(spark, some_pages):
    seeds = some_pages.where("page_id % 7 = 0").orderBy("page_id")
    every = C.crawl(seeds, some_pages, max_pages=None).collect()
    assert {r.url: r.level for r in every if r.status == "fetched"} == {f"http://h{i // 7}.x/p{i}": i % 7 for i in range(70)}
    some = C.crawl(seeds, some_pages, max_pages=13).collect()
    assert len(some) == 13 and {r.url for r in some if r.level == 0} == {f"http://h{i}.x/p{7 * i}" for i in range(10)}


def test_seed_merge_all(spark, tmp_path, some_pages):
    got = [r.url for r in entry.queries()["seed_merge_all"](spark, str(tmp_path)).collect()]
    want = {f"http://h{i // 7}.x/gone{i}" for i in range(70)} | {f"http://other.x/o{i}" for i in range(3)} | {f"http://h{i // 7}.x/p{i + 1}" for i in range(6, 70, 7)}
    assert len(got) == len(set(got)) and set(got) == want


@here
def test_seed_sets_of_whole_tables(spark, duck):  # noqa: F811
    assert matches_sql(spark, duck, "seed_overlay_all").seed_name.notna().all()
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(H.normalize_url(F.col("url")).alias("u"), H.discover_links(F.col("url"), F.col("html"), same_domain=False).alias("l")).collect()
    assert {r.url for r in entry.queries()["seed_merge_all"](spark, SF).collect()} == {x for r in pages for x in r.l} - {r.u for r in pages}


@here
@pytest.mark.parametrize("name", ["bm25_batch_whole", "eval_metrics_whole", "eval_by_category_whole"])
def test_whole_texts_match_sql(spark, duck, name):  # noqa: F811
    matches_sql(spark, duck, name)


def test_terms_behind_the_prefix_count(spark, tmp_path):
    head = "same words at the head of every single text of this small table here "
    spark.createDataFrame([(i, head + x, "s") for i, x in enumerate(("red", "green", "blue"))], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, head + "blue"), (2, head + "green")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.query_id: r.doc_id for r in entry.queries()["bm25_batch_whole"](spark, str(tmp_path)).where("rank = 1").collect()}
    assert got == {"b1": 2, "b2": 1}
    assert [r.mrr for r in entry.queries()["eval_metrics_whole"](spark, str(tmp_path)).collect()] == [1.0, 1.0]
