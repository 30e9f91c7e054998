"""Named queries over the driver's tables, each with the SQL that says the same (where SQL can)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import pages as P
from ..functions import text as T
from ..functions.local import local_table
from ..functions.lexicon import BASE_WEIGHTS, KINDS, REPEATS, Lexicon
from ..operators import clean, evaluate, fuzzy, intent, ranking, search, vector
from ..operators import corpus as C
from ..operators.index import FLAT, Index, corpus, kept_index, settled, shared_folder, table_bytes
from ..sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def document_corpus(spark: SparkSession, d: str) -> Index:
    return corpus(table(spark, d, "documents"), ("text",))


def documents(spark: SparkSession, d: str, terms: bool = False) -> Index:
    return kept_index(document_corpus(spark, d), "documents", f"{d}/documents.parquet", terms)


def part_corpus(spark: SparkSession, d: str) -> Index:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"), F.col("p_type").alias("title"), F.col("p_brand").alias("college"))
    return corpus(p, ("name", "title", "college"), repeats=REPEATS)


def parts(spark: SparkSession, d: str, terms: bool = False) -> Index:
    return kept_index(part_corpus(spark, d), "part", f"{d}/part.parquet", terms)


def ask(spark: SparkSession, *texts: str, field: str = "all") -> DataFrame:
    return local_table(spark, [(f"q{i}", t, field) for i, t in enumerate(texts)], "query_id string, query string, field string")


def r6(c: str) -> Column:
    return F.round(F.col(c), 6).alias(c)


def shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("query_id", "rank", F.col("ord").alias("doc_id"), r6("score"), *more)


WORDS = "regexp_extract_all(lower({c}), '[a-z0-9_]+')"


def flat_sql(queries: list[str], k: int, tail: str = "", allowed: str = "", cols: str = "query_id, rank, doc_id, round(score, 6) AS score") -> str:
    """Flat BM25 over documents.text."""
    values = ", ".join(f"('q{i}', '{q}')" for i, q in enumerate(queries))
    return flat_sql_over(f"SELECT * FROM (VALUES {values}) v(query_id, query)", k, tail, allowed, cols)


def flat_sql_over(queries: str, k: int, tail: str = "", allowed: str = "", cols: str = "query_id, rank, doc_id, round(score, 6) AS score") -> str:
    return f"""
WITH qs AS ({queries}), d AS (SELECT doc_id, source, {WORDS.format(c="coalesce(text, '')")} AS ws FROM documents),
st AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS avgdl FROM d),
tok AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS t FROM d), tf AS (SELECT doc_id, dl, t, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
qt AS (SELECT query_id, t, count(*) AS c FROM (SELECT query_id, unnest({WORDS.format(c="query")}) AS t FROM qs) GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum(c * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score, string_agg(t, ',' ORDER BY t) AS terms
  FROM qt JOIN tf USING (t) JOIN df USING (t), st {allowed} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT {cols} FROM r {tail or f"WHERE rank <= {k}"}"""


def fielded_sql(terms: list[tuple], weights: list[tuple], phrases: list[tuple], k: int, exact: list[tuple] = (), allowed: str = "", tail: str = "") -> str:
    """Field-weighted BM25 over part (name, title, college); all inputs are given as rows."""
    rows = lambda xs, cols: f"(SELECT * FROM (VALUES {', '.join(str(tuple(x)) for x in xs)}) v({cols}))" if xs else f"(SELECT * FROM (VALUES {str(('', '', 0.0)[: cols.count(',') + 1])}) v({cols}) WHERE false)"
    return f"""
WITH d AS (SELECT p_partkey AS doc_id, f, x, {WORDS.format(c="x")} AS ws FROM part, LATERAL (VALUES ('name', p_name), ('title', p_type), ('college', p_brand)) v(f, x)),
st AS (SELECT f, count(*) AS n, sum(len(ws)) / count(*) AS avgdl FROM d GROUP BY f),
tok AS (SELECT f, doc_id, len(ws) AS dl, unnest(ws) AS t FROM d), tf AS (SELECT f, doc_id, dl, t, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT f, t, count(*) AS df FROM tf GROUP BY ALL),
qt AS {rows(terms, "query_id, t, q")}, w AS {rows(weights, "query_id, f, weight")}, ph AS {rows(phrases, "query_id, phrase, bonus")}, ex AS {rows(exact, "query_id, text")},
a AS (SELECT query_id, doc_id, sum(weight * q * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (t) JOIN df USING (f, t) JOIN st USING (f) JOIN w USING (query_id, f) GROUP BY ALL
  UNION ALL SELECT query_id, doc_id, sum(weight * bonus::DOUBLE) FROM ph JOIN w USING (query_id) JOIN d USING (f) WHERE length(phrase) >= 2 AND contains(x, phrase) GROUP BY ALL
  UNION ALL SELECT query_id, p_partkey, 100.0 FROM ex JOIN part ON p_name = text),
s AS (SELECT query_id, doc_id, sum(score) AS score FROM a {allowed} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
{tail or f"SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= {k}"}"""


# ---- sources and sinks: written to the shared folder and read back

#: Bytes of a table's files that go to one range when it is written in order.
RANGE_BYTES = 16 << 20


def written(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """A new path below the shared folder, with what ``write`` puts there."""
    path = f"{shared_folder(spark)}/lodestar-files/{name}-{uuid.uuid4().hex}"
    write(path)
    return path


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(source, '') AS college, '' AS title, md5(coalesce(text, '')) AS digest FROM documents")
def documents_jsonl(spark, d):  # noqa: ANN001, ANN201
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string"), F.col("source").alias("college"), F.col("text").alias("content"), "n_chars")
    back = io.read_documents(spark, written(spark, "documents", lambda p: io.write_documents(io.project_document(rows), p)))
    return back.select("doc_id", "college", "title", F.md5("content").alias("digest"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_ord FROM documents")
def documents_jsonl_order(spark, d):  # noqa: ANN001, ANN201
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string"), F.col("doc_id").alias("n"), F.col("text").alias("content"))
    ranges = max(4, -(-table_bytes(spark, f"{d}/documents.parquet") // RANGE_BYTES))
    path = written(spark, "documents", lambda p: rows.repartitionByRange(ranges, "n").sortWithinPartitions("n").drop("n").write.json(p))
    return io.read_documents(spark, path).select("doc_id", F.col("doc_ord").cast("long").alias("doc_ord"))


@query("SELECT 'unit' || page_id % 5 AS college, 'name' || page_id AS name, url FROM pages")
def seeds_csv(spark, d):  # noqa: ANN001, ANN201
    own = table(spark, d, "pages").select(F.concat(F.lit("unit"), F.col("page_id") % 5).alias("college"), F.concat(F.lit("name"), F.col("page_id")).alias("name"), "url")
    return io.read_known_urls(spark, written(spark, "seeds", lambda p: io.write_seeds(own, p))).select("college", "name", "url")


@query("SELECT 'q' || doc_id % 3 AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN quality = 0 THEN 1 ELSE quality + 1 END::INT AS relevance FROM labels")
def qrels_jsonl(spark, d):  # noqa: ANN001, ANN201
    grade = F.when(F.col("quality") != 0, F.col("quality") + 1)  # missing grades count 1
    rows = table(spark, d, "labels").select(F.concat(F.lit("q"), F.col("doc_id") % 3).alias("query_id"), F.col("doc_id").cast("string"), grade.alias("relevance"))
    return io.read_qrels(spark, written(spark, "qrels", lambda p: rows.write.json(p)))


@query("SELECT 'Q' || lpad(CAST(row_number() OVER (ORDER BY item_id) AS VARCHAR), 3, '0') AS query_id, md5(text) AS digest, CASE WHEN item_id % 2 = 0 THEN 'name' ELSE 'all' END AS field FROM benchmark")
def queries_jsonl(spark, d):  # noqa: ANN001, ANN201
    line = F.to_json(F.struct(F.col("text").alias("query"), F.when(F.col("item_id") % 2 == 0, "fuzzy_name").otherwise("research").alias("category")))
    rows = table(spark, d, "benchmark").orderBy("item_id").select(line.alias("value")).coalesce(1)
    asked, _ = io.read_queries(spark, written(spark, "queries", lambda p: rows.write.text(p)))
    return asked.select("query_id", F.md5("query").alias("digest"), "field")


@query("SELECT substr(sha1(url), 1, 16) || '.html' AS raw_key, md5(html) AS digest FROM pages")
def raw_page_sink(spark, d):  # noqa: ANN001, ANN201
    pages = io.raw_pages(table(spark, d, "pages"))
    return spark.read.parquet(written(spark, "raw", lambda p: pages.write.parquet(p))).select("raw_key", F.md5("html").alias("digest"))


@query(r"""WITH p AS (SELECT page_id, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS kv FROM pages WHERE regexp_extract(url, '\?([^#]*)', 1) <> '')
SELECT page_id, split_part(kv, '=', 1) AS key, CASE WHEN contains(kv, '=') THEN substr(kv, instr(kv, '=') + 1) ELSE '' END AS value FROM p""")
def url_query_map(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "pages").select("page_id", F.explode(H.query_map(F.col("url"))).alias("key", "value"))


@query("SELECT doc_id, CAST(greatest(1, ceil(n_chars / 500.0)) AS INT) AS pages FROM documents")
def page_counts(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", H.page_count(F.col("n_chars"), 500).alias("pages"))


# ---- index and flat ranking

@query(f"""WITH d AS (SELECT p_partkey AS doc_id, f, {WORDS.format(c="x")} AS ws FROM part, LATERAL (VALUES ('name', p_name), ('title', p_type), ('college', p_brand)) v(f, x)),
tok AS (SELECT DISTINCT doc_id, f, unnest(ws) AS term FROM d)
SELECT f AS field, term, count(*) AS df FROM tok GROUP BY ALL UNION ALL SELECT '*', term, count(DISTINCT doc_id) FROM tok GROUP BY ALL""")
def stored_terms(spark, d):  # noqa: ANN001, ANN201
    return parts(spark, d, terms=True).stored_terms.select("field", "term", "df")


@query(f"SELECT t AS term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({WORDS.format(c='text')}) AS t FROM documents) GROUP BY t")
def stored_document_terms(spark, d):  # noqa: ANN001, ANN201
    return documents(spark, d, terms=True).stored_terms.where("field = '*'").select("term", "df")


@query(f"SELECT t AS term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({WORDS.format(c='text')}) AS t FROM documents) GROUP BY t")
def tokenize_df(spark, d):  # noqa: ANN001, ANN201
    return document_corpus(spark, d).term_counts().where(F.col("field") == FLAT).select("term", "df")


@query("""SELECT 'name' AS field, count(*) AS n, round(sum(len(regexp_extract_all(lower(p_name), '[a-z0-9_]+'))) / count(*), 6) AS avgdl FROM part
UNION ALL SELECT 'title', count(*), round(sum(len(regexp_extract_all(lower(p_type), '[a-z0-9_]+'))) / count(*), 6) FROM part
UNION ALL SELECT 'college', count(*), round(sum(len(regexp_extract_all(lower(p_brand), '[a-z0-9_]+'))) / count(*), 6) FROM part""")
def index_totals(spark, d):  # noqa: ANN001, ANN201
    return parts(spark, d).totals().select("field", "n", r6("avgdl"))


@query(flat_sql(["aning nicht"], 10))
def bm25_topk(spark, d):  # noqa: ANN001, ANN201
    return shown(ranking.top_k(ranking.flat_scores(documents(spark, d), ask(spark, "aning nicht")), 10))


@query(flat_sql_over("SELECT 'b' || item_id AS query_id, substr(text, 1, 60) AS query FROM benchmark", 5))
def bm25_batch(spark, d):  # noqa: ANN001, ANN201
    asked = table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("query_id"), F.substring("text", 1, 60).alias("query"))
    return shown(ranking.flat_best(documents(spark, d), asked, 5))


@query(flat_sql_over("SELECT 'b' || item_id AS query_id, text AS query FROM benchmark", 5))
def bm25_batch_whole(spark, d):  # noqa: ANN001, ANN201
    asked = table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("query_id"), F.col("text").alias("query"))
    return shown(ranking.flat_best(documents(spark, d), asked, 5))


@query(flat_sql(["heble heble reing", "heble reing"], 10))
def bm25_dup_terms(spark, d):  # noqa: ANN001, ANN201
    return shown(ranking.top_k(ranking.flat_scores(documents(spark, d), ask(spark, "heble heble reing", "heble reing")), 10))


@query(flat_sql(["ining ention heble"], 10, cols="query_id, rank, doc_id, terms"))
def matched_terms(spark, d):  # noqa: ANN001, ANN201
    rows = ranking.top_k(ranking.flat_scores(documents(spark, d), ask(spark, "ining ention heble")), 10)
    return rows.select("query_id", "rank", F.col("ord").alias("doc_id"), F.array_join("matched_terms", ",").alias("terms"))


@query(flat_sql(["aning reing"], 10, allowed="WHERE doc_id IN (SELECT doc_id FROM documents WHERE contains(source, 'src1'))"))
def bm25_college_filter(spark, d):  # noqa: ANN001, ANN201
    index, asked = documents(spark, d), ask(spark, "aning reing").withColumn("college", F.lit("src1"))
    return shown(ranking.top_k(ranking.flat_scores(index, asked, lambda rows: ranking.within_facet(rows, index, asked, "source")), 10))


@query(flat_sql(["aning reing"], 10, tail="JOIN documents USING (doc_id) WHERE rank <= 10 AND contains(source, 'src1')"))
def bm25_post_filter(spark, d):  # noqa: ANN001, ANN201
    index = documents(spark, d)
    return shown(ranking.post_filter(ranking.top_k(ranking.flat_scores(index, ask(spark, "aning reing")), 10), index, "source", "src1"))


@query("""WITH d AS (SELECT p_partkey AS doc_id, f, r, regexp_extract_all(lower(x), '[a-z0-9_]+') AS ws FROM part, LATERAL (VALUES ('name', 5, p_name), ('title', 2, p_type), ('college', 1, p_brand)) v(f, r, x)),
dl AS (SELECT doc_id, sum(r * len(ws)) AS dl FROM d GROUP BY doc_id), st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl),
tf AS (SELECT doc_id, t, sum(r) AS tf FROM (SELECT doc_id, r, unnest(ws) AS t FROM d) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (t) JOIN dl USING (doc_id), st WHERE t IN ('red', 'ring', 'small') GROUP BY doc_id)
SELECT 'q0' AS query_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score FROM s QUALIFY rank <= 20""")
def bm25_weighted_fields(spark, d):  # noqa: ANN001, ANN201
    return shown(ranking.top_k(ranking.flat_scores(parts(spark, d), ask(spark, "red ring small")), 20))


# ---- fielded ranking

FIELD_ROWS = [("q0", f, BASE_WEIGHTS[f]) for f in ("name", "title", "college")]


def field_inputs(spark: SparkSession, terms: list, phrases: list) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (local_table(spark, terms, "query_id string, term string, q double"), local_table(spark, FIELD_ROWS, "query_id string, field string, weight double"), local_table(spark, phrases, "query_id string, phrase string, bonus double"))


SOME_TERMS = [("q0", "red", 1.0), ("q0", "ring", 1.0), ("q0", "promo", 0.65)]


@query(fielded_sql(SOME_TERMS, FIELD_ROWS, [], 20))
def fielded_bm25(spark, d):  # noqa: ANN001, ANN201
    return shown(ranking.top_k(ranking.fielded_scores(parts(spark, d), *field_inputs(spark, SOME_TERMS, [])), 20))


@query(fielded_sql([], FIELD_ROWS, [("q0", "red ring", 2.0), ("q0", "PROMO", 0.8)], 20))
def fielded_phrase_bonus(spark, d):  # noqa: ANN001, ANN201
    return shown(ranking.top_k(ranking.fielded_scores(parts(spark, d), *field_inputs(spark, [], [("q0", "red ring", 2.0), ("q0", "PROMO", 0.8)])), 20))


@query(fielded_sql(SOME_TERMS, FIELD_ROWS, [("q0", "red ring", 2.0), ("q0", "PROMO", 0.8)], 25, [("q0", "red ring")]))
def fielded_full(spark, d):  # noqa: ANN001, ANN201
    index = parts(spark, d)
    inputs = field_inputs(spark, SOME_TERMS, [("q0", "red ring", 2.0), ("q0", "PROMO", 0.8)])
    return shown(ranking.top_k(ranking.fielded_scores(index, *inputs, bonuses=ranking.exact_matches(index, ask(spark, "red ring"), "name")), 25))


# ---- filters and lookups

@query("SELECT 'q0' AS query_id, row_number() OVER (ORDER BY p_partkey)::INT AS rank, p_partkey AS doc_id, 1.0::DOUBLE AS score FROM part WHERE contains(p_brand, 'Brand#1') QUALIFY rank <= 30")
def contains_filter(spark, d):  # noqa: ANN001, ANN201
    return shown(ranking.contains_filter(part_corpus(spark, d), ask(spark, "Brand#1", field="college"), "college", 30))


@query("SELECT 'q0' AS query_id, row_number() OVER (ORDER BY p_partkey)::INT AS rank, p_partkey AS doc_id, CASE WHEN p_name = 'red ring' THEN 100.0 ELSE 50.0 END::DOUBLE AS score FROM part WHERE contains(p_name, 'red ring') QUALIFY rank <= 30")
def name_exact_partial(spark, d):  # noqa: ANN001, ANN201
    return shown(ranking.name_filter(part_corpus(spark, d), ask(spark, " red ring ", field="name"), 30))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 17")
def doc_lookup(spark, d):  # noqa: ANN001, ANN201
    return search.lookup(table(spark, d, "documents"), 17).select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, substr(text, 1, 300) AS text FROM documents WHERE contains(source, 'src7')")
def doc_list(spark, d):  # noqa: ANN001, ANN201
    return search.listing(table(spark, d, "documents"), "src7", "source", "text").select("doc_id", "text")


@query("SELECT source AS name, count(*) AS count FROM documents GROUP BY source")
def corpus_stats(spark, d):  # noqa: ANN001, ANN201
    return search.facet_counts(table(spark, d, "documents"), "source", ord_col="doc_id")


@query("""WITH s AS (SELECT 'q0' AS query_id, p_partkey AS doc_id, 100.0 AS score FROM part WHERE contains(lower(p_name), 'red')
UNION ALL SELECT 'q1', p_partkey, 1.0 FROM part WHERE contains(lower(p_brand), 'brand#2')
UNION ALL SELECT 'q2', p_partkey, 10.0 FROM part WHERE contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'promo'))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank, doc_id, score::DOUBLE AS score FROM s QUALIFY rank <= 15""")
def stub_search(spark, d):  # noqa: ANN001, ANN201
    asked = local_table(spark, [("q0", "RED", "name"), ("q1", "Brand#2", "college"), ("q2", "promo", "all")], "query_id string, query string, field string")
    return shown(ranking.substring_search(part_corpus(spark, d).docs, asked, 15, ("name", "title", "college"), "name", "college"))


# ---- fusion

def two_lists(spark, d):  # noqa: ANN001, ANN201
    index = documents(spark, d)
    one, two = (ranking.top_k(ranking.flat_scores(index, ask(spark, q)), 20) for q in ("aning reing heble", "reing nicht"))
    return one, two


def rrf_sql(w: tuple[float, float]) -> str:
    one, two = flat_sql(["aning reing heble"], 20), flat_sql(["reing nicht"], 20)
    return f"""WITH one AS ({one}), two AS ({two}), u AS (SELECT doc_id, {w[0]} / (60 + rank) AS p, 0 AS l, rank FROM one UNION ALL SELECT doc_id, {w[1]} / (60 + rank), 1, rank FROM two),
m AS (SELECT doc_id, sum(p) AS score, min(l * 1000 + rank) AS place FROM u GROUP BY doc_id)
SELECT 'q0' AS query_id, row_number() OVER (ORDER BY round(score, 12) DESC, place)::INT AS rank, doc_id, round(score, 6) AS score FROM m QUALIFY rank <= 10"""


@query(rrf_sql((1.0, 1.0)))
def rrf(spark, d):  # noqa: ANN001, ANN201
    return shown(ranking.fuse(list(two_lists(spark, d)), None, 10))


@query(rrf_sql((1.0, 0.05)))
def rrf_weighted(spark, d):  # noqa: ANN001, ANN201
    return shown(ranking.fuse(list(two_lists(spark, d)), [1.0, 0.05], 10))


# ---- query analysis (a small demonstration lexicon in place of the default)

DEMO = Lexicon(
    colleges={"Brand#1": ("Brand#1", "first brand"), "Brand#22": ("Brand#22", "second brand", "second")},
    titles=("ECONOMY", "PROMO"),
    paper_terms=("paper", "ACL"),
    fillers=("looking for", "for", "find"),
    descriptive=("about", "which", "find"),
    synonyms={"ring": ("bolt", "Widget", "rod"), "red widget": ("blue widget", "ring"), "Plate": ("WIDGET", "disc")},
    kinds=KINDS,
)
ASKED = ("red ring", "looking for a red widget of second brand", "find PROMO plate", "PROMO", "first brand", "ACL paper ring", "find gears", "hot rod of Brand#1 for ECONOMY", "gears", "which bolts are good for cold rooms", "RING")
ASKED_SQL = f"(SELECT * FROM (VALUES {', '.join(str((f'q{i}', t)) for i, t in enumerate(ASKED))}) v(query_id, query))"
SYN_SQL = f"(SELECT * FROM (VALUES {', '.join(str((k, s, i)) for i, (k, s) in enumerate((k, s) for k, ss in DEMO.synonyms.items() for s in ss))}) v(key, synonym, pos))"
EXPANDED = f"""q AS {ASKED_SQL}, syn AS {SYN_SQL},
x AS (SELECT query_id, arg_min(synonym, pos) AS phrase, min(pos)::INT AS pos FROM q, syn WHERE (contains(lower(query), lower(key)) OR contains(lower(key), lower(query))) AND lower(synonym) <> lower(query) GROUP BY query_id, lower(synonym)
  UNION ALL SELECT query_id, query, -1 FROM q)"""


@query(f"WITH {EXPANDED} SELECT query_id, phrase, pos FROM x")
def query_expansion(spark, d):  # noqa: ANN001, ANN201
    return intent.expand(ask(spark, *ASKED), intent.synonym_table(spark, DEMO))


@query(f"WITH {EXPANDED} SELECT query_id, t AS term, max(CASE WHEN pos < 0 THEN 1.0 ELSE 0.65 END)::DOUBLE AS q FROM (SELECT query_id, pos, unnest({WORDS.format(c='phrase')}) AS t FROM x) GROUP BY ALL")
def weighted_terms(spark, d):  # noqa: ANN001, ANN201
    return intent.weighted_terms(intent.expand(ask(spark, *ASKED), intent.synonym_table(spark, DEMO)))


ALIAS_SQL = f"(SELECT * FROM (VALUES {', '.join(str((a, c, -len(a) * 100 + i)) for i, (a, c) in enumerate(DEMO.aliases()))}) v(alias, canon, o))"
TITLE_SQL = f"(SELECT * FROM (VALUES {', '.join(str((t, i)) for i, t in enumerate(sorted(DEMO.titles, key=lambda t: -len(t))))}) v(title, o))"
INTENT = f"""q AS {ASKED_SQL}, al AS {ALIAS_SQL}, ti AS {TITLE_SQL},
a AS (SELECT q.query_id, query, coalesce((SELECT arg_min(canon, o) FROM al WHERE contains(query, alias)), '') AS college, coalesce((SELECT arg_min(alias, o) FROM al WHERE contains(query, alias)), '') AS alias,
  coalesce((SELECT arg_min(title, o) FROM ti WHERE contains(query, title)), '') AS title FROM q),
b AS (SELECT *, trim(regexp_replace(replace(replace(replace(CASE WHEN title = '' THEN c ELSE replace(c, title, ' ') END, 'looking for', ' '), 'find', ' '), 'for', ' '), '\\s+', ' ', 'g')) AS cleaned
  FROM (SELECT *, CASE WHEN alias = '' THEN query ELSE replace(query, alias, ' ') END AS c FROM a)),
i AS (SELECT *, CASE WHEN title <> '' THEN CASE WHEN cleaned <> '' THEN 'title_research' ELSE 'title' END
  WHEN college <> '' THEN CASE WHEN cleaned <> '' THEN 'college_research' ELSE 'college' END
  WHEN contains(lower(query), 'paper') OR contains(lower(query), 'acl') THEN 'paper'
  WHEN contains(lower(query), 'ring') OR contains(lower(query), 'red widget') OR contains(lower(query), 'plate') THEN 'research'
  WHEN contains(query, 'looking for') OR contains(query, 'for') OR contains(query, 'find') THEN 'colloquial' ELSE 'general' END AS kind FROM b)"""


@query(f"WITH {INTENT} SELECT query_id, college, title FROM i")
def alias_longest_match(spark, d):  # noqa: ANN001, ANN201
    return intent.analyze(ask(spark, *ASKED), DEMO).select("query_id", "college", "title")


@query(f"WITH {INTENT} SELECT query_id, kind, cleaned, CASE WHEN cleaned <> '' THEN cleaned ELSE query END AS search_text FROM i")
def intent_kind(spark, d):  # noqa: ANN001, ANN201
    return intent.analyze(ask(spark, *ASKED), DEMO).select("query_id", "kind", "cleaned", "search_text")


@query(f"""WITH {INTENT} SELECT query_id, CASE WHEN kind IN ('name', 'paper', 'college', 'title') OR contains(lower(query), 'paper') OR contains(lower(query), 'acl') OR length(replace(query, ' ', '')) < 10 THEN false
  WHEN kind = 'research' THEN NOT (contains(lower(replace(query, ' ', '')), 'ring') OR contains(lower(replace(query, ' ', '')), 'red widget') OR contains(lower(replace(query, ' ', '')), 'plate')) AND (contains(query, 'about') OR contains(query, 'which') OR contains(query, 'find'))
  WHEN kind = 'colloquial' THEN true ELSE contains(query, 'about') OR contains(query, 'which') OR contains(query, 'find') END AS use_semantic FROM i""")
def gate(spark, d):  # noqa: ANN001, ANN201
    return intent.gate(intent.analyze(ask(spark, *ASKED), DEMO), DEMO).select("query_id", "use_semantic")


# ---- search modes: queries of over 6 characters, so that no fuzzy bonus takes part and SQL can say the same

MODE_QUERIES = ("small red widget", "hot plate of Brand#1", "paper blue widget")
MODE_TEXTS = ("small red widget", "hot plate of", "paper blue widget")


def mode_rows() -> tuple[list, list, list, list]:
    """Terms, weights, phrases and exact names of the demonstration queries, as the analysis gives them."""
    kinds = ("research", "college_research", "paper")
    terms, weights, phrases = [], [], []
    for i, (text, kind) in enumerate(zip(MODE_TEXTS, kinds, strict=True)):
        ws, e, *_ = KINDS[kind]
        own = text.split()
        low, more = text.lower(), []
        for key, synonyms in DEMO.synonyms.items():
            if key.lower() in low or low in key.lower():
                more += [s for s in synonyms if s.lower() not in {low, *(m.lower() for m in more)}]
        q = dict.fromkeys((t.lower() for m in more for t in m.split()), e) | dict.fromkeys((t.lower() for t in own), 1.0)
        terms += [(f"q{i}", t, w) for t, w in q.items()]
        weights += [(f"q{i}", f, w) for f, w in zip(("name", "research", "papers", "title", "profile", "college", "content"), ws, strict=True) if f in ("name", "title", "college")]
        phrases += [(f"q{i}", text, 2.0)] + [(f"q{i}", m, 0.8) for m in more]
    return terms, weights, phrases, [(f"q{i}", t) for i, t in enumerate(MODE_TEXTS)]


ONLY = "WHERE query_id <> 'q1' OR doc_id IN (SELECT p_partkey FROM part WHERE contains(p_brand, 'Brand#1'))"


@query(fielded_sql(*mode_rows()[:3], 10, mode_rows()[3], ONLY))
def adaptive_search(spark, d):  # noqa: ANN001, ANN201
    return shown(search.adaptive(parts(spark, d), ask(spark, *MODE_QUERIES), 10, DEMO))


@query(fielded_sql(*mode_rows()[:3], 10, mode_rows()[3], ONLY, tail="""SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10 AND query_id <> 'q2' UNION ALL
SELECT 'q2', row_number() OVER (ORDER BY round(sum(p), 12) DESC, min(place))::INT, doc_id, round(sum(p), 6) FROM (
  SELECT doc_id, 1.0 / (60 + rank) AS p, rank AS place FROM r WHERE query_id = 'q2' AND rank <= 20
  UNION ALL SELECT doc_id, 1.0 / (60 + rank), 1000 + rank FROM (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
    SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM
      (SELECT doc_id, t, sum(tf * CASE f WHEN 'name' THEN 5 WHEN 'title' THEN 2 ELSE 1 END) AS tf FROM tf GROUP BY ALL) JOIN
      (SELECT t, count(DISTINCT doc_id) AS df FROM tf GROUP BY t) USING (t) JOIN
      (SELECT doc_id, sum(len(ws) * CASE f WHEN 'name' THEN 5 WHEN 'title' THEN 2 ELSE 1 END) AS dl FROM d GROUP BY doc_id) USING (doc_id),
      (SELECT max(n) AS n, sum(avgdl * CASE f WHEN 'name' THEN 5 WHEN 'title' THEN 2 ELSE 1 END) AS avgdl FROM st)
    WHERE t IN ('paper', 'blue', 'widget') GROUP BY doc_id)) WHERE rank <= 20) GROUP BY doc_id QUALIFY row_number() OVER (ORDER BY round(sum(p), 12) DESC, min(place)) <= 10"""))
def optimized_search(spark, d):  # noqa: ANN001, ANN201
    return shown(search.optimized(parts(spark, d), ask(spark, *MODE_QUERIES), 10, DEMO))


def weighted_sql(queries: list[str], k: int) -> str:
    """Flat BM25 over part's weighted fields, with 100 for an equal name."""
    asked = ", ".join(f"('q{i}', '{q}')" for i, q in enumerate(queries))
    repeats = ", ".join(f"('{f}', {REPEATS[f]}, {c})" for f, c in (("name", "p_name"), ("title", "p_type"), ("college", "p_brand")))
    return f"""
WITH qs AS (SELECT * FROM (VALUES {asked}) v(query_id, query)), d AS (SELECT p_partkey AS doc_id, f, r, {WORDS.format(c="x")} AS ws FROM part, LATERAL (VALUES {repeats}) v(f, r, x)),
dl AS (SELECT doc_id, sum(r * len(ws)) AS dl FROM d GROUP BY doc_id), st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl),
tf AS (SELECT doc_id, t, sum(r) AS tf FROM (SELECT doc_id, r, unnest(ws) AS t FROM d) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
qt AS (SELECT query_id, t, count(*) AS c FROM (SELECT query_id, unnest({WORDS.format(c="query")}) AS t FROM qs) GROUP BY ALL),
a AS (SELECT query_id, doc_id, sum(c * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (t) JOIN df USING (t) JOIN dl USING (doc_id), st GROUP BY ALL
  UNION ALL SELECT query_id, p_partkey, 100.0 FROM qs JOIN part ON p_name = trim(query)),
s AS (SELECT query_id, doc_id, sum(score) AS score FROM a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= {k}"""


ALL_MODES = (*MODE_QUERIES, "which bolts are good for cold rooms")


def raw_rows() -> tuple[list, list, list, list]:
    """Terms, weights, phrases and equal names of the raw queries, as the fielded mode takes them."""
    ids = [(f"q{i}", t) for i, t in enumerate(ALL_MODES)]
    terms = [(i, w, 1.0) for i, t in ids for w in dict.fromkeys(re.findall("[a-z0-9_]+", t.lower()))]
    return terms, [(i, f, BASE_WEIGHTS[f]) for i, _ in ids for f in ("name", "title", "college")], [(i, t.strip(), 2.0) for i, t in ids], ids


def expanded_rows(weight: float = 0.65) -> tuple[list, list, list, list]:
    """The same with the dictionary's synonyms: their terms at the expansion's weight, their phrases at 0.8."""
    terms, weights, phrases, ids = raw_rows()
    for i, text in ids:
        own, more = {t for q, t, _ in terms if q == i}, {}
        for key, synonyms in DEMO.synonyms.items():
            if key.lower() in text.lower() or text.lower() in key.lower():
                more |= {s.lower(): s for s in synonyms if s.lower() not in more and s.lower() != text.lower()}
        added = dict.fromkeys(w for m in more for w in re.findall("[a-z0-9_]+", m))
        terms = [*terms, *((i, w, weight) for w in added if w not in own)]
        phrases = [*phrases, *((i, m, 0.8) for m in more.values())]
    return terms, weights, phrases, ids


MODE_SQL = {"baseline": weighted_sql(list(ALL_MODES), 10), "fielded": fielded_sql(*raw_rows()[:3], 10, raw_rows()[3]), "fielded+expand": fielded_sql(*expanded_rows()[:3], 10, expanded_rows()[3])}


def _mode(name: str) -> None:
    def run(spark, d):  # noqa: ANN001, ANN202
        index = part_corpus(spark, d) if name == "semantic" else parts(spark, d)  # vectors need no terms
        return shown(search.MODES[name](index, ask(spark, *ALL_MODES), 10, DEMO))

    run.__name__ = f"mode_{name.replace('+', '_')}"
    query(MODE_SQL.get(name))(run)


for _name in ("baseline", "fielded", "fielded+fuzzy", "fielded+expand", "semantic", "hybrid_semantic", "conditional_semantic"):
    _mode(_name)


# ---- similarity and vectors

@query()
def fuzzy_names(spark, d):  # noqa: ANN001, ANN201
    return shown(fuzzy.name_search(part_corpus(spark, d), ask(spark, "red rinng", "widgte hot"), 20))


@query("""WITH q AS (SELECT * FROM (VALUES ('q0', 'red rinng'), ('q1', 'hot plat')) v(query_id, query)), s AS (SELECT query_id, p_partkey AS doc_id, levenshtein(query, lower(p_name)) AS dist FROM q, part)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, doc_id)::INT AS rank, doc_id, (-dist)::DOUBLE AS score FROM s WHERE dist <= 3 QUALIFY rank <= 20""")
def levenshtein_names(spark, d):  # noqa: ANN001, ANN201
    return shown(fuzzy.levenshtein_search(part_corpus(spark, d), ask(spark, "red rinng", "hot plat"), 20))


GRAMS = "(SELECT p_partkey AS doc_id, s, substr(s, i::INT, n::INT) AS g FROM (SELECT p_partkey, replace(lower(p_name), ' ', '') AS s FROM part), unnest([2, 3, 4]) a(n), LATERAL (SELECT unnest(range(1, greatest(length(s) - n + 2, 1))) AS i))"
FNV = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(g, ''), lambda c: unicode(c)::UBIGINT)), lambda a, c: (xor(a, c) * 16777619::UBIGINT) & 4294967295::UBIGINT)"


@query(f"SELECT doc_id, count(*)::BIGINT AS n FROM {GRAMS} GROUP BY doc_id")
def char_ngrams_count(spark, d):  # noqa: ANN001, ANN201
    return part_corpus(spark, d).docs.select("doc_id", F.size(T.char_ngrams(T.text("name"))).cast("long").alias("n"))


@query(f"SELECT g, {FNV}::BIGINT AS h FROM (SELECT DISTINCT p_name AS g FROM part)")
def fnv1a(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "part").select(F.col("p_name").alias("g")).distinct().select("g", T.fnv1a(F.col("g")).alias("h"))


@query(f"WITH c AS (SELECT doc_id, ({FNV} % 512)::INT AS dim, count(*) AS c FROM {GRAMS} GROUP BY ALL) SELECT doc_id, dim, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS value FROM c")
def hash_vector(spark, d):  # noqa: ANN001, ANN201
    return vector.sparse_counts(part_corpus(spark, d).docs, "doc_id", "name").select(F.col("id").alias("doc_id"), "dim", r6("value"))


def vectors(spark, d):  # noqa: ANN001, ANN201
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id in (0, 7)").select(F.concat(F.lit("q"), F.col("vec_id")).alias("query_id"), F.col("embedding").alias("qv"))
    return rows.select(F.col("vec_id").alias("ord"), F.col("embedding").alias("v"), "label"), asked


def vector_sql(where: str = "true", asked: str = "IN (0, 7)") -> str:
    return f"""WITH s AS (SELECT 'q' || q.vec_id AS query_id, e.vec_id AS doc_id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id {asked} AND {where})
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank, doc_id, round(score, 4) AS score FROM s QUALIFY rank <= 20"""


@query(vector_sql())
def vector_topk(spark, d):  # noqa: ANN001, ANN201
    rows, asked = vectors(spark, d)
    return vector.vector_search(rows, asked, 20).select("query_id", "rank", F.col("ord").alias("doc_id"), F.round("score", 4).alias("score"))


@query(vector_sql("e.label = 3"))
def vector_allowlist(spark, d):  # noqa: ANN001, ANN201
    rows, asked = vectors(spark, d)
    allowed = rows.where("label = 3").select("ord").crossJoin(F.broadcast(asked.select("query_id")))
    return vector.vector_search(rows, asked, 20, allowed).select("query_id", "rank", F.col("ord").alias("doc_id"), F.round("score", 4).alias("score"))


def all_asked(spark, d):  # noqa: ANN001, ANN201
    """(vectors, queries): every row whose id is divisible by 20 is a query."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.concat(F.lit("q"), F.col("vec_id")).alias("query_id"), F.col("embedding").alias("qv"))
    return rows.select(F.col("vec_id").alias("ord"), F.col("embedding").alias("v"), "label"), asked


@query(vector_sql(asked="% 20 = 0"))
def vector_topk_all(spark, d):  # noqa: ANN001, ANN201
    rows, asked = all_asked(spark, d)
    return vector.vector_search_blocks(rows, asked, 20).select("query_id", "rank", F.col("ord").alias("doc_id"), F.round("score", 4).alias("score"))


@query(vector_sql("e.label = 3", "% 20 = 0"))
def vector_allowlist_all(spark, d):  # noqa: ANN001, ANN201
    rows, asked = all_asked(spark, d)
    return vector.vector_search_blocks(rows.where("label = 3"), asked, 20).select("query_id", "rank", F.col("ord").alias("doc_id"), F.round("score", 4).alias("score"))


# ---- evaluation

def judged(spark, d, query=None):  # noqa: ANN001, ANN201
    query = F.substring("text", 1, 60) if query is None else query
    items = table(spark, d, "benchmark")
    asked = items.select(F.concat(F.lit("b"), F.col("item_id")).alias("query_id"), query.alias("query"), F.when(F.col("item_id") % 3 == 0, "a").otherwise("b").alias("category"), "text")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    qrels = docs.join(F.broadcast(asked.select("query_id", "text")), F.col("body").contains(F.col("text"))).select("query_id", "doc_id", (F.lit(2) + (F.col("doc_id") % 2)).cast("int").alias("relevance"))
    qrels = settled(qrels, "qrels")  # read twice; one search for all items' texts
    best = ranking.flat_best(documents(spark, d), asked, 5).withColumnRenamed("ord", "doc_id")
    return best, asked, qrels


def cases_sql(query: str) -> str:
    return f"""b AS ({flat_sql_over(f"SELECT 'b' || item_id AS query_id, {query} AS query FROM benchmark", 5)}),
qr AS (SELECT 'b' || item_id AS query_id, doc_id, 2 + doc_id % 2 AS rel FROM benchmark i JOIN documents d ON contains(d.text, i.text)),
g AS (SELECT query_id, sum((coalesce(rel, 0) >= 2)::INT) AS hits, max(CASE WHEN rel >= 2 THEN 1.0 / rank END) AS mrr, sum((2 ** coalesce(rel, 0) - 1) / log2(rank + 1)) AS dcg FROM b LEFT JOIN qr USING (query_id, doc_id) GROUP BY query_id),
id AS (SELECT query_id, sum((2 ** rel - 1) / log2(r + 1)) AS idcg FROM (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS r FROM qr) WHERE r <= 5 GROUP BY query_id),
c AS (SELECT 'b' || item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'a' ELSE 'b' END AS category, coalesce(hits, 0) / 5.0 AS precision, coalesce(mrr, 0) AS mrr, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END AS ndcg
  FROM benchmark LEFT JOIN g ON g.query_id = 'b' || item_id LEFT JOIN id ON id.query_id = 'b' || item_id)"""


CASES, WHOLE_CASES = cases_sql("substr(text, 1, 60)"), cases_sql("text")


@query(f"WITH {CASES} SELECT query_id, category, round(precision, 6)::DOUBLE AS precision, round(mrr, 6)::DOUBLE AS mrr, round(ndcg, 6)::DOUBLE AS ndcg FROM c")
def eval_metrics(spark, d):  # noqa: ANN001, ANN201
    return evaluate.case_metrics(*judged(spark, d)).select("query_id", "category", r6("precision"), r6("mrr"), r6("ndcg"))


@query(f"WITH {CASES} SELECT category, count(*) AS cases, round(avg(precision), 6)::DOUBLE AS precision, round(avg(mrr), 6)::DOUBLE AS mrr, round(avg(ndcg), 6)::DOUBLE AS ndcg FROM c GROUP BY ROLLUP (category)")
def eval_by_category(spark, d):  # noqa: ANN001, ANN201
    return evaluate.evaluate(*judged(spark, d)).select("category", "cases", r6("precision"), r6("mrr"), r6("ndcg"))


@query(f"WITH {WHOLE_CASES} SELECT query_id, category, round(precision, 6)::DOUBLE AS precision, round(mrr, 6)::DOUBLE AS mrr, round(ndcg, 6)::DOUBLE AS ndcg FROM c")
def eval_metrics_whole(spark, d):  # noqa: ANN001, ANN201
    return evaluate.case_metrics(*judged(spark, d, F.col("text"))).select("query_id", "category", r6("precision"), r6("mrr"), r6("ndcg"))


@query(f"WITH {WHOLE_CASES} SELECT category, count(*) AS cases, round(avg(precision), 6)::DOUBLE AS precision, round(avg(mrr), 6)::DOUBLE AS mrr, round(avg(ndcg), 6)::DOUBLE AS ndcg FROM c GROUP BY ROLLUP (category)")
def eval_by_category_whole(spark, d):  # noqa: ANN001, ANN201
    return evaluate.evaluate(*judged(spark, d, F.col("text"))).select("category", "cases", r6("precision"), r6("mrr"), r6("ndcg"))


# ---- pages

def text_sql(c: str = "html") -> str:
    for pattern, by in H.MARKUP:
        c = f"regexp_replace({c}, '{pattern}', {'chr(10)' if by else repr('')}, 'g')"
    for entity, by in H.ENTITIES:
        c = "replace({}, '{}', '{}')".format(c, entity.replace("'", "''"), by.replace("'", "''"))
    for pattern, by in H.LAYOUT:
        c = f"regexp_replace({c}, '{pattern}', {'chr(10)' if by == chr(10) else repr(by)}, 'g')"
    return c


@query(f"SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM (SELECT page_id, {text_sql()} AS t FROM pages)")
def html_to_text(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "pages").select("page_id", H.html_to_text(T.text("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def html_title(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "pages").select("page_id", H.html_title(F.col("html")).alias("title"))


LINKS_SQL = """SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref=["'']([^"'']*)["'']', 1)) AS href FROM pages"""


@query(f"SELECT page_id, href, count(*) AS n FROM ({LINKS_SQL}) GROUP BY ALL")
def html_links(spark, d):  # noqa: ANN001, ANN201
    rows = table(spark, d, "pages").select("page_id", F.explode(H.hrefs(F.col("html"))).alias("href"))
    return rows.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END
|| CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) = '' THEN '' ELSE '?' || regexp_extract(url, '\\?([^#]*)', 1) END AS url FROM pages""")
def url_normalize(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "pages").select("page_id", H.normalize_url(F.col("url")).alias("url"))


@query(f"SELECT href, NOT regexp_matches(lower(href), '\\.(jpg|jpeg|png|gif|css|js|pdf|doc|docx)$') AND (regexp_matches(lower(href), '(\\.html?|/)$') OR regexp_matches(lower(href), '(^|/)[^/.]*$')) AS crawlable FROM (SELECT DISTINCT href FROM ({LINKS_SQL}))")
def crawlable_links(spark, d):  # noqa: ANN001, ANN201
    links = table(spark, d, "pages").select(F.explode(H.hrefs(F.col("html"))).alias("href")).distinct()
    return links.select("href", H.crawlable(F.col("href")).alias("crawlable"))


PAGE_LEX = Lexicon(positive=("The", "Le", "Der"), english=("the", "nicht", "une", "eine", "los"), listing=("Home", "About", "Next", "Last"), hard_negative=("404 not found",), template_colleges=(), template_tokens=())


@query(f"""WITH t AS (SELECT page_id, {text_sql()} AS t FROM pages), h AS (SELECT *, substr(t, 1, 300) AS s, contains(t, 'The')::INT + contains(t, 'Le')::INT + contains(t, 'Der')::INT AS p,
contains(lower(t), 'the')::INT + contains(lower(t), 'nicht')::INT + contains(lower(t), 'une')::INT + contains(lower(t), 'eine')::INT + contains(lower(t), 'los')::INT AS e FROM t),
l AS (SELECT *, contains(s, 'Home')::INT + contains(s, 'About')::INT + contains(s, 'Next')::INT + contains(s, 'Last')::INT AS n FROM h)
SELECT page_id, CASE WHEN length(t) < 20 THEN 'too_short' WHEN contains(s, '404 not found') THEN 'hard_negative:404 not found' WHEN n >= 3 THEN 'navigation_or_listing_page' WHEN p >= 2 THEN 'chinese_teacher_signals' WHEN e >= 3 THEN 'english_teacher_signals'
ELSE 'weak_teacher_signals:positive=' || p || ',english=' || e || ',negative=' || n END AS reason FROM l""")
def page_classifier(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "pages").select("page_id", P.classify_page(H.html_to_text(T.text("html")), PAGE_LEX)["reason"].alias("reason"))


@query(f"SELECT page_id, substr(sha1(url || substr({text_sql()}, 1, 200)), 1, 16) AS id, substr(sha1(url), 1, 16) || '.html' AS raw_key FROM pages")
def sha1_id(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "pages").select("page_id", T.sha_id(F.col("url"), H.html_to_text(T.text("html"))).alias("id"), T.raw_key(F.col("url")).alias("raw_key"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\s*\\[\\s*at\\s*\\]\\s*', '@', 'gi'), '\\s+at\\s+', '@', 'gi'), '\\s*\\[\\s*dot\\s*\\]\\s*', '.', 'gi'), '\\s+dot\\s+', '.', 'gi')) AS digest FROM documents")
def email_deobfuscate(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", F.md5(T.deobfuscate_email(T.text("text"))).alias("digest"))


@query()
def redact(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", F.md5(T.redact(T.text("text"))).alias("digest"))


@query("SELECT doc_id, md5(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 700)) AS digest FROM documents")
def truncate_700(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", F.md5(T.truncate(T.text("text"))).alias("digest"))


# ---- cleaning and corpus building

@query("""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS x FROM documents), p AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM l)
SELECT doc_id, count(*) FILTER (WHERE y IS NULL OR x <> y)::BIGINT AS n_lines FROM p GROUP BY doc_id""")
def consecutive_dedupe(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", F.size(T.drop_consecutive(F.split(T.text("text"), "\n"))).cast("long").alias("n_lines"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def first_dedupe(spark, d):  # noqa: ANN001, ANN201
    return C.first_by(table(spark, d, "documents"), ["text"], ["doc_id"]).select("doc_id", "source")


def graded(spark, d):  # noqa: ANN001, ANN201
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    title = F.when(F.col("quality") == 1, "t").otherwise("")
    profile = F.when(F.col("toxic") == 0, F.substring("text", 1, 20)).otherwise("")
    q = clean.quality(title, F.when(F.col("lang") == "en", "r").otherwise(""), profile, F.col("source"), F.col("text"), F.when(F.col("n_chars") < 60, "too_short").otherwise(""))
    return rows.select("doc_id", q["grade"].alias("clean_quality"), q["flags"].alias("clean_flags"))


GRADED = """x AS (SELECT doc_id, coalesce(quality, 0) = 1 AS t, lang = 'en' AS r, coalesce(toxic = 0, false) AND text <> '' AS p, source <> '' AS u, regexp_matches(text, '(?i)\\b(lab|laboratory|members|gallery|join us|advisor)\\b') AND NOT coalesce(quality = 1, false) AND NOT (coalesce(toxic = 0, false) AND text <> '') AS lab,
  n_chars < 60 AS weak, length(text) < 200 AS short FROM documents LEFT JOIN labels USING (doc_id)),
y AS (SELECT *, t::INT + r::INT + p::INT + u::INT + (NOT lab)::INT AS s FROM x),
z AS (SELECT doc_id, CASE WHEN s >= 5 AND NOT weak THEN 'high' WHEN s >= 3 THEN 'medium' ELSE 'low' END AS grade,
  list_filter([CASE WHEN NOT t THEN 'missing_title' END, CASE WHEN NOT r THEN 'missing_research' END, CASE WHEN NOT p THEN 'missing_profile' END, CASE WHEN NOT u THEN 'missing_url' END, CASE WHEN lab THEN 'lab_like_homepage' END, CASE WHEN weak THEN 'weak_page_signal' END, CASE WHEN short THEN 'very_short_content' END], lambda f: f IS NOT NULL) AS flags FROM y)"""


@query(f"WITH {GRADED} SELECT doc_id, grade, array_to_string(flags, ',') AS flags FROM z")
def quality_grade(spark, d):  # noqa: ANN001, ANN201
    return graded(spark, d).select("doc_id", F.col("clean_quality").alias("grade"), F.array_join("clean_flags", ",").alias("flags"))


@query(f"""WITH {GRADED} SELECT 'summary' AS section, 'input_docs' AS name, count(*) AS value FROM z UNION ALL SELECT 'summary', 'output_docs', count(*) FILTER (WHERE grade <> 'low') FROM z UNION ALL SELECT 'summary', 'dropped_docs', count(*) FILTER (WHERE grade = 'low') FROM z
UNION ALL SELECT 'quality', grade, count(*) FROM z GROUP BY grade UNION ALL SELECT 'flags', f, count(*) FROM (SELECT unnest(flags) AS f FROM z) GROUP BY f""")
def quality_report(spark, d):  # noqa: ANN001, ANN201
    return clean.clean_report(graded(spark, d), drop_low=True)


def seeds(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "pages").where("page_id % 3 = 0").select(F.concat(F.lit("unit"), F.col("page_id") % 5).alias("college"), F.concat(F.lit("name"), F.col("page_id")).alias("name"), "url")


@query("""WITH s AS (SELECT substr(sha1(url), 1, 16) || '.html' AS raw_key, 'unit' || page_id % 5 AS college, 'name' || page_id AS name, url FROM pages WHERE page_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1)
SELECT page_id, college AS seed_college, name AS seed_name FROM pages p LEFT JOIN s ON s.raw_key = substr(sha1(p.url), 1, 16) || '.html'""")
def seed_overlay(spark, d):  # noqa: ANN001, ANN201
    own = table(spark, d, "pages").where("page_id % 3 = 0").select("page_id", F.concat(F.lit("unit"), F.col("page_id") % 5).alias("college"), F.concat(F.lit("name"), F.col("page_id")).alias("name"), "url")
    files = table(spark, d, "pages").select("page_id", T.raw_key(F.col("url")).alias("raw_key"))
    return C.overlay_seeds(files, C.last_seeds(own, ["page_id"])).select("page_id", "seed_college", "seed_name")


@query("SELECT url FROM (SELECT DISTINCT url FROM pages WHERE page_id % 2 = 0) WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def seed_merge(spark, d):  # noqa: ANN001, ANN201
    found = table(spark, d, "pages").where("page_id % 2 = 0").select(F.lit("c").alias("college"), F.lit("n").alias("name"), "url")
    return C.new_seeds(found, seeds(spark, d)).select("url")


@query("""WITH s AS (SELECT substr(sha1(url), 1, 16) || '.html' AS raw_key, 'unit' || page_id % 5 AS college, 'name' || page_id AS name, url FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1)
SELECT page_id, college AS seed_college, name AS seed_name FROM pages p LEFT JOIN s ON s.raw_key = substr(sha1(p.url), 1, 16) || '.html'""")
def seed_overlay_all(spark, d):  # noqa: ANN001, ANN201
    pages = table(spark, d, "pages")
    own = pages.select("page_id", F.concat(F.lit("unit"), F.col("page_id") % 5).alias("college"), F.concat(F.lit("name"), F.col("page_id")).alias("name"), "url")
    files = pages.select("page_id", T.raw_key(F.col("url")).alias("raw_key"))
    return C.overlay_seeds(files, C.last_seeds(own, ["page_id"])).select("page_id", "seed_college", "seed_name")


@query()
def seed_merge_all(spark, d):  # noqa: ANN001, ANN201
    pages = table(spark, d, "pages")
    links = pages.select(F.explode(H.discover_links(F.col("url"), F.col("html"), same_domain=False)).alias("url"))
    return C.new_seeds(links.select(F.lit("c").alias("college"), F.lit("n").alias("name"), "url"), pages.select(H.normalize_url(F.col("url")).alias("url"))).select("url")


@query()
def frontier_step(spark, d):  # noqa: ANN001, ANN201
    pages = table(spark, d, "pages")
    return C.frontier_step(pages, pages.select(H.normalize_url(F.col("url")).alias("url")))


@query()
def crawl(spark, d):  # noqa: ANN001, ANN201
    pages = table(spark, d, "pages")
    return C.crawl(pages, pages, max_pages=None).select("url", "level", "status")


@query("""WITH l AS (SELECT doc_id AS id, unnest(range(len(string_split(text, chr(10)))))::INT AS line, unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT id, line, last_value(CASE WHEN regexp_matches(text, '^[A-Z][a-z]+ [a-z]+ ') THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line) AS section FROM l""")
def section_assign(spark, d):  # noqa: ANN001, ANN201
    return C.assign_sections(table(spark, d, "documents"), "doc_id", "text", "^[A-Z][a-z]+ [a-z]+ ").select("id", "line", F.md5("section").alias("section"))


@query("SELECT 'doc_count' AS name, count(*) AS value FROM documents UNION ALL SELECT 'college_count', count(DISTINCT source) FROM documents UNION ALL SELECT source, count(*) FROM documents GROUP BY source")
def corpus_summary(spark, d):  # noqa: ANN001, ANN201
    return C.summarize(table(spark, d, "documents").withColumn("college", F.col("source")))


@query("SELECT p_partkey AS doc_id, array_to_string(list_filter(string_split(p_name || ' ' || p_type, ' '), lambda x: length(x) BETWEEN 2 AND 30), '|') AS parts FROM part")
def name_parts(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.array_join(T.name_parts(F.concat_ws(" ", "p_name", "p_type")), "|").alias("parts"))


@query()
def parse_pages(spark, d):  # noqa: ANN001, ANN201
    return C.parse_pages(table(spark, d, "pages"), F.col("url"), F.col("html"), F.lit("")).select("page_id", "doc_id", "name", "college", "title", F.size("sections").alias("n_sections"), "page_reason")


@query()
def clean_documents(spark, d):  # noqa: ANN001, ANN201
    docs = C.parse_pages(table(spark, d, "pages"), F.col("url"), F.col("html"), F.lit(""))
    return clean.clean_documents(docs).select("page_id", "doc_id", "clean_quality", F.array_join("clean_flags", ",").alias("flags"), F.length("content").alias("n_chars"))
