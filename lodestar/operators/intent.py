"""What a query asks for, as Columns: facet and title mentions, kind, weights, expansion, and the gate to vector recall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.local import local_table, small
from ..functions.lexicon import DEFAULT, FIELDS, SEMANTIC_KINDS, Lexicon


def _first(c: Column, options: list[tuple[str, str]]) -> Column:
    """The value of the first option whose key the text contains; empty if none."""
    return reduce(lambda rest, o: F.when(c.contains(o[0]), o[1]).otherwise(rest), reversed(options), F.lit(""))


def analyze(queries: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """``queries`` with original, cleaned, kind, college, title, search_text, use_expansion, expansion_weight and use_fuzzy."""
    q = F.col("original")
    by_length = lambda words: sorted(words, key=lambda w: -len(w))
    aliases = lex.aliases()
    titles = [(t, t) for t in by_length(lex.titles)]
    field = T.text("field") if "field" in queries.columns else F.lit("all")
    out = queries.withColumn("original", T.squeeze(T.text("query")))
    out = out.withColumn("college", _first(q, aliases)).withColumn("_alias", _first(q, [(a, a) for a, _ in aliases])).withColumn("title", _first(q, titles))
    bare = F.when(F.col("_alias") != "", F.replace(q, F.col("_alias"), F.lit(" "))).otherwise(q)
    bare = F.when(F.col("title") != "", F.replace(bare, F.col("title"), F.lit(" "))).otherwise(bare)
    out = out.withColumn("cleaned", bare)
    stripped = F.col("cleaned")
    for w in by_length(lex.fillers):
        stripped = F.replace(stripped, F.lit(w), F.lit(" "))
    out = out.withColumn("cleaned", F.regexp_replace(T.squeeze(stripped), "^[，,。；;：:]+|[，,。；;：:]+$", ""))
    rest = F.col("cleaned") != ""
    rules = [
        (field == "name", F.lit("name")),
        (field == "papers", F.lit("paper")),
        (field == "research", F.lit("research")),
        ((field == "title") | (F.col("title") != ""), F.when(rest, "title_research").otherwise("title")),
        (F.col("college") != "", F.when(rest, "college_research").otherwise("college")),
        (T.contains_any(q, lex.paper_terms, fold=True), F.lit("paper")),
        (T.contains_any(q, tuple(lex.synonyms), fold=True), F.lit("research")),
        (T.contains_any(q, lex.fillers), F.lit("colloquial")),
    ]
    kind = reduce(lambda otherwise, r: F.when(r[0], r[1]).otherwise(otherwise), reversed(rules), F.lit("general"))
    out = out.withColumn("kind", kind).withColumn("search_text", F.when(rest, F.col("cleaned")).otherwise(q))
    of = lambda i: reduce(lambda o, k: F.when(F.col("kind") == k[0], F.lit(k[1][i])).otherwise(o), lex.kinds.items(), F.lit(lex.kinds["general"][i]))
    return out.withColumn("expansion_weight", of(1)).withColumn("use_expansion", of(2)).withColumn("use_fuzzy", of(3)).drop("_alias")


def kind_weights(spark: SparkSession, lex: Lexicon = DEFAULT, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(kind, field, weight): a small dimension."""
    rows = [(k, f, float(w)) for k, (ws, *_) in lex.kinds.items() for f, w in zip(FIELDS, ws, strict=True) if f in fields]
    return local_table(spark, rows, "kind string, field string, weight double")


def synonym_table(spark: SparkSession, lex: Lexicon = DEFAULT) -> DataFrame:
    """(key, synonym, pos): the dictionary in order."""
    rows = [(k, s, i) for i, (k, s) in enumerate((k, s) for k, ss in lex.synonyms.items() for s in ss)]
    return local_table(spark, rows, "key string, synonym string, pos int")


def expand(queries: DataFrame, synonyms: DataFrame, text_col: str = "query") -> DataFrame:
    """(query_id, phrase, pos): the stripped query (pos -1), then synonyms of every key that contains it or that it contains, each once
    whatever its case, in dictionary order."""
    q = queries.select("query_id", T.strip(T.text(text_col)).alias("own")).where("own <> ''")
    low, key = F.lower("own"), F.lower("key")
    found = q.crossJoin(small(synonyms)).where(low.contains(key) | key.contains(low)).where(F.lower("synonym") != low)
    once = found.groupBy("query_id", F.lower("synonym").alias("_l")).agg(F.min_by("synonym", "pos").alias("phrase"), F.min("pos").alias("pos"))
    return q.select("query_id", F.col("own").alias("phrase"), F.lit(-1).alias("pos")).unionByName(once.select("query_id", "phrase", "pos"))


def weighted_terms(phrases: DataFrame, weights: DataFrame | None = None, default: float = 0.65) -> DataFrame:
    """(query_id, term, q): 1 for the query's own terms, the expansion weight (query_id, expansion_weight) for the others, the larger of both."""
    rows = phrases.join(small(weights), "query_id", "left") if weights is not None else phrases.withColumn("expansion_weight", F.lit(default))
    w = F.when(F.col("pos") < 0, 1.0).otherwise(F.coalesce("expansion_weight", F.lit(default)))
    return rows.select("query_id", F.explode(T.tokenize(F.col("phrase"))).alias("term"), w.alias("q")).groupBy("query_id", "term").agg(F.max("q").alias("q"))


def gate(analyzed: DataFrame, lex: Lexicon = DEFAULT, min_chars: int = 10, empty_results: DataFrame | None = None) -> DataFrame:
    """``analyzed`` with ``use_semantic``: whether vector recall may help.  ``empty_results``: (query_id) of queries whose lexical result is
    known to be empty."""
    q = F.regexp_replace(T.text("query"), r"(?U)\s+", "")
    field = T.text("field") if "field" in analyzed.columns else F.lit("all")
    if empty_results is not None:
        analyzed = analyzed.join(small(empty_results.select("query_id", F.lit(True).alias("_empty"))), "query_id", "left")
        weak = F.coalesce("_empty", F.lit(False))
    else:
        weak = F.lit(False)
    rules = [
        ((field != "all") | ~F.col("kind").isin(*SEMANTIC_KINDS) | T.contains_any(T.text("query"), lex.paper_terms, fold=True) | (F.length(q) < min_chars), F.lit(False)),
        ((F.col("kind") == "research") & T.contains_any(q, tuple(lex.synonyms), fold=True), F.lit(False)),
        (F.col("kind") == "colloquial", F.lit(True)),
        (T.contains_any(q, lex.descriptive), F.lit(True)),
    ]
    return analyzed.withColumn("use_semantic", reduce(lambda o, r: F.when(r[0], r[1]).otherwise(o), reversed(rules), weak)).drop("_empty")
