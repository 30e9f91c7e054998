import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Cheap ones; the driver runs all of them.
CHECKED = ("tokenize_df", "bm25_batch", "fielded_full", "rrf_weighted", "intent_kind", "gate", "weighted_terms", "hash_vector", "vector_topk", "html_to_text", "url_normalize", "quality_report", "seed_merge", "section_assign", "documents_jsonl_order", "seeds_csv", "qrels_jsonl", "queries_jsonl", "url_query_map", "stored_terms", "mode_baseline", "mode_fielded_expand")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple("" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df[cols].astype(object).values.tolist())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_registry():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and "bm25_batch" in known


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
