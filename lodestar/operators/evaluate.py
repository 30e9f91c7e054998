"""Relevance metrics of ranked results against judgements, overall and by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.local import small


def case_metrics(results: DataFrame, queries: DataFrame, qrels: DataFrame, k: int = 5, threshold: int = 2) -> DataFrame:
    """(query_id, category, precision, mrr, ndcg) of every query.

    precision: hits / k, k and not the number of results; ndcg: all grades gain, the ideal counts grades from the threshold on only, so a
    value above 1 can occur; without such grades it is 0."""
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    graded = results.where(F.col("rank") <= k).join(small(qrels), ["query_id", "doc_id"], "left").withColumn("g", F.coalesce("relevance", F.lit(0)))
    hit = F.col("g") >= threshold
    got = graded.groupBy("query_id").agg(F.sum(hit.cast("int")).alias("hits"), F.max(F.when(hit, 1.0 / F.col("rank"))).alias("mrr"), F.sum(gain(F.col("g"), F.col("rank"))).alias("dcg"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))
    ideal = qrels.where(F.col("relevance") >= threshold).withColumn("r", place).where(F.col("r") <= k).groupBy("query_id").agg(F.sum(gain(F.col("relevance"), F.col("r"))).alias("idcg"))
    rows = queries.select("query_id", "category").join(got, "query_id", "left").join(ideal, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("query_id", "category", (zero(F.col("hits").cast("double")) / k).alias("precision"), zero(F.col("mrr")).alias("mrr"), F.when(zero(F.col("idcg")) > 0, zero(F.col("dcg")) / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def summary(cases: DataFrame) -> DataFrame:
    """(category, cases, precision, mrr, ndcg): means by category and, with a null category, over all."""
    rows = cases.withColumn("category", F.coalesce("category", F.lit("uncategorized"))).rollup("category")
    return rows.agg(F.count("*").alias("cases"), F.avg("precision").alias("precision"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"))


def evaluate(results: DataFrame, queries: DataFrame, qrels: DataFrame, k: int = 5, threshold: int = 2) -> DataFrame:
    return summary(case_metrics(results, queries, qrels, k, threshold))
