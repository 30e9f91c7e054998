"""Search modes over a table of queries, and the lookups of the service contract.

A query row has query_id, query and field (``all``, ``name`` or a document field).  Every mode is one plan: rows of different fields take
different legs, and the legs' results are united.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.local import small
from ..functions.lexicon import BASE_WEIGHTS, DEFAULT, Lexicon
from . import fuzzy, intent, vector
from .index import Index, settled
from .ranking import RESULT, contains_filter, exact_matches, fielded_scores, flat_scores, fuse, name_filter, post_filter, substring_search, top_k, within_facet

FILTER_FIELDS = ("college", "research", "papers", "title")
COLUMNS = ("query_id", "rank", *RESULT[1:])
RRF_DEPTH, VECTOR_DEPTH, VECTOR_WEIGHT = 20, 50, 0.05


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select(*COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*COLUMNS))
    return out


def _filters(index: Index, queries: DataFrame, k: int) -> list[DataFrame]:
    return [contains_filter(index, queries.where(F.col("field") == f), f, k) for f in FILTER_FIELDS if f in index.fields]


def _rest(queries: DataFrame) -> DataFrame:
    """Queries that no filter answers: any field that is not one of the known ones counts as ``all``."""
    return queries.where(~F.col("field").isin("name", *FILTER_FIELDS))


def baseline(index: Index, queries: DataFrame, k: int, lex: Lexicon = DEFAULT) -> DataFrame:
    """Exact and partial names, substring filters, else flat BM25."""
    name = "name" if "name" in index.fields else None
    full = top_k(flat_scores(index, _rest(queries), exact_field=name), k)
    legs = [name_filter(index, queries.where("field = 'name'"), k)] if name else []
    return _union([*legs, *_filters(index, queries, k), full])


def fielded(index: Index, queries: DataFrame, k: int, lex: Lexicon = DEFAULT, expansion: bool = False, fuzzy_names: bool = False, expansion_weight: float = 0.65) -> DataFrame:
    """Field-weighted BM25 with base weights and the raw query; expansion and fuzzy names as options."""
    spark = index.docs.sparkSession
    rest = _rest(queries)
    phrases = intent.expand(rest, intent.synonym_table(spark, lex)) if expansion else rest.select("query_id", T.strip(T.text("query")).alias("phrase"), F.lit(-1).alias("pos")).where("phrase <> ''")
    weights = rest.select("query_id", F.explode(F.create_map(*[x for f in index.fields for x in (F.lit(f), F.lit(BASE_WEIGHTS[f]))])).alias("field", "weight"))
    bonuses = exact_matches(index, rest, "name")
    if fuzzy_names:
        bonuses = bonuses.unionByName(fuzzy.field_bonus(index, rest))
    bonus = F.when(F.col("pos") < 0, 2.0).otherwise(0.8)
    full = fielded_scores(index, intent.weighted_terms(phrases, default=expansion_weight), weights, phrases.select("query_id", "phrase", bonus.alias("bonus")), bonuses=bonuses)
    by_name = fuzzy.name_search if fuzzy_names else name_filter
    return _union([by_name(index, queries.where("field = 'name'"), k), *_filters(index, queries, k), top_k(full, k)])


def adaptive(index: Index, queries: DataFrame, k: int, lex: Lexicon = DEFAULT, rrf: bool = False, facet: str = "college") -> DataFrame:
    """Intent decides weights, expansion and the facet filter; with ``rrf`` paper queries are fused with flat BM25 over the raw query."""
    spark = index.docs.sparkSession
    q = settled(intent.analyze(_rest(queries), lex), "analyzed")  # a dozen branches read it, and the analysis is a large expression
    depth = F.when(F.col("kind") == "paper", max(k, RRF_DEPTH)).otherwise(k) if rrf else F.lit(k)
    allowed = (lambda rows: within_facet(rows, index, q, facet)) if lex.colleges else None
    text = q.select("query_id", F.col("search_text").alias("query"))
    own = text.select("query_id", T.strip(T.text("query")).alias("phrase"), F.lit(-1).alias("pos")).where("phrase <> ''")
    more = intent.expand(q.where("use_expansion").select("query_id", F.col("search_text").alias("query")), intent.synonym_table(spark, lex)).where("pos >= 0")
    phrases = settled(own.unionByName(more), "phrases")
    terms = settled(intent.weighted_terms(phrases, q.select("query_id", "expansion_weight")), "terms")
    weights = q.select("query_id", "kind").join(small(intent.kind_weights(spark, lex, index.fields)), "kind").select("query_id", "field", "weight")
    bonuses = exact_matches(index, text, "name").unionByName(fuzzy.field_bonus(index, q.where("use_fuzzy").select("query_id", F.col("search_text").alias("query"))))
    bonus = F.when(F.col("pos") < 0, 2.0).otherwise(0.8)
    scored = fielded_scores(index, terms, weights, phrases.select("query_id", "phrase", bonus.alias("bonus")), allowed, bonuses)
    scored = scored.join(small(q.select("query_id", "kind", depth.alias("depth"))), "query_id")
    best = top_k(scored, F.col("depth"))
    if rrf:
        paper = best.where("kind = 'paper'")
        raw = top_k(flat_scores(index, q.where("kind = 'paper'").select("query_id", F.col("original").alias("query")), exact_field="name"), max(k, RRF_DEPTH))
        best = best.where("kind <> 'paper'").select(*COLUMNS).unionByName(fuse([paper, raw], None, k).select(*COLUMNS))
    return _union([fuzzy.name_search(index, queries.where("field = 'name'"), k), *_filters(index, queries, k), best])


def optimized(index: Index, queries: DataFrame, k: int, lex: Lexicon = DEFAULT) -> DataFrame:
    return adaptive(index, queries, k, lex, rrf=True)


def semantic_text(index: Index) -> Column:
    """What a document's vector is made of: its labelled fields, else its content."""
    # Labels of the fields, in order.
    labels = {"姓名": "name", "学院": "college", "职称": "title", "研究方向": "research", "论文成果": "papers", "个人简介": "profile"}
    content = T.text("content") if "content" in index.docs.columns else F.lit("")
    return T.labelled_text({k: F.col(v) for k, v in labels.items() if v in index.docs.columns}, content)


def semantic(index: Index, queries: DataFrame, k: int, lex: Lexicon = DEFAULT, encoder: str = "hashing", facet: str = "college") -> DataFrame:
    """Vector search of the analysed query text, restricted to the facet that the query names."""
    encode = vector.encoder(encoder)
    asked = settled(intent.analyze(queries, lex).where("search_text <> ''").select("query_id", "search_text", "college"), "analyzed")
    texts = index.docs.select(F.col(index.ord_col).alias("ord"), semantic_text(index).alias("text"), T.text(facet).alias("facet"))
    if encoder == "hashing":
        return vector.sparse_search(texts, asked.select("query_id", F.col("search_text").alias("text"), F.col("college").alias("value")), k).select(*COLUMNS)
    allowed = lambda rows: within_facet(rows, index, asked, facet)
    vectors = texts.select("ord", encode(F.col("text")).alias("v"))
    return vector.vector_search(vectors, asked.select("query_id", encode(F.col("search_text")).alias("qv")), k, allowed).select(*COLUMNS)


def hybrid(index: Index, queries: DataFrame, k: int, lex: Lexicon = DEFAULT, weight: float = VECTOR_WEIGHT) -> DataFrame:
    """Optimised search fused with vector recall."""
    deep = max(k, VECTOR_DEPTH)
    return fuse([optimized(index, queries, deep, lex), semantic(index, queries, deep, lex)], [1.0, weight], k).select(*COLUMNS)


def conditional(index: Index, queries: DataFrame, k: int, lex: Lexicon = DEFAULT, weight: float = VECTOR_WEIGHT) -> DataFrame:
    """Vector recall only for queries that pass the gate; a query whose facet holds no document keeps its lexical result."""
    deep = max(k, VECTOR_DEPTH)
    lexical = settled(optimized(index, queries, deep, lex), "lexical")  # a few rows per query, read by three branches
    empty = queries.select("query_id").join(lexical.select("query_id").distinct(), "query_id", "left_anti")
    open_ = intent.gate(intent.analyze(queries, lex), lex, empty_results=empty).where("use_semantic")
    near = settled(semantic(index, queries.join(small(open_.select("query_id")), "query_id", "left_semi"), deep, lex), "near")
    gated = near.select("query_id").distinct()
    plain = lexical.where(F.col("rank") <= k).join(gated, "query_id", "left_anti")
    fused = fuse([lexical.join(gated, "query_id", "left_semi"), near], [1.0, weight], k)
    return _union([plain, fused])


def served(index: Index, queries: DataFrame, k: int, lex: Lexicon = DEFAULT, college: str | None = None, use_vectors: bool = False) -> DataFrame:
    """The service's default engine: conditional search, cut to k, then the facet filter (fewer than k may remain)."""
    try:
        rows = conditional(index, queries, k, lex) if use_vectors else optimized(index, queries, k, lex)
    except (vector.EncoderMissing, ValueError):
        rows = optimized(index, queries, k, lex)
    return post_filter(rows, index, "college", college) if college else rows


def stub(index: Index, queries: DataFrame, k: int, lex: Lexicon = DEFAULT) -> DataFrame:
    """Plain containment without statistics, for trying out a client: the first k documents in load order."""
    shown = tuple(c for c in ("name", "college", "title", "research", "profile") if c in index.docs.columns)
    return substring_search(index.docs, queries.withColumn("query", F.trim("query")), k, shown, "name", "college", index.ord_col)


Mode = Callable[..., DataFrame]
#: What an evaluation compares by default, and what it compares to tell the parts' shares apart.
COMPARED = ("baseline", "optimized")
ABLATION = ("baseline", "fielded", "fielded+fuzzy", "fielded+expand", "adaptive", "optimized")
MODES: dict[str, Mode] = {
    "baseline": baseline,
    "fielded": fielded,
    "fielded+fuzzy": lambda i, q, k, lex=DEFAULT: fielded(i, q, k, lex, fuzzy_names=True),
    "fielded+expand": lambda i, q, k, lex=DEFAULT: fielded(i, q, k, lex, expansion=True),
    "adaptive": adaptive,
    "optimized": optimized,
    "semantic": semantic,
    "hybrid_semantic": hybrid,
    "conditional_semantic": conditional,
}
#: The service's engines; `register` adds to them.
ENGINES: dict[str, Mode] = {"bm25": baseline, "optimized": served, "stub": stub}


def register(name: str) -> Callable[[Mode], Mode]:
    """Decorator: add an engine."""
    def add(f: Mode) -> Mode:
        ENGINES[name] = f
        return f

    return add


def engine(name: str) -> Mode:
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name!r}; there are {sorted(ENGINES)}")
    return ENGINES[name]


def lookup(docs: DataFrame, doc_id: object, id_col: str = "doc_id") -> DataFrame:
    """The document with an id, or no row."""
    return docs.where(F.col(id_col) == F.lit(doc_id)).limit(1)


def listing(docs: DataFrame, college: str | None = None, facet: str = "college", text_col: str = "profile", limit: int = 300) -> DataFrame:
    """All documents, or those whose facet contains a value; the long text cut."""
    rows = docs.where(T.text(facet).contains(college)) if college else docs
    return rows.withColumn(text_col, F.substring(T.text(text_col), 1, limit))


def facet_counts(docs: DataFrame, facet: str = "college", unknown: str = "未知", ord_col: str | None = None) -> DataFrame:
    """(name, count) by facet, largest first; ties by first appearance where an ordinal is given, else by name."""
    value = F.when(T.text(facet) == "", unknown).otherwise(T.text(facet))
    counts = docs.groupBy(value.alias("name")).agg(F.count("*").alias("count"), *([F.min(ord_col).alias("_o")] if ord_col else []))
    return counts.orderBy(F.desc("count"), "_o" if ord_col else "name").drop("_o")


def sort_results(results: DataFrame, by: str = "relevance") -> DataFrame:
    """Client orders: relevance, name, or facet then name, in Chinese collation."""
    zh = lambda c: F.collate(F.coalesce(F.col(c), F.lit("")), "zh")
    order = {"relevance": [F.desc("score")], "name": [zh("name")], "college": [zh("college"), zh("name")]}
    return results.orderBy(*order[by])


def selected(results: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of the selected ids in selection order (ids: an array column ``ids``); ids that are not there are left out."""
    return ids.select(F.posexplode("ids").alias("pos", id_col)).join(results, id_col).orderBy("pos")
