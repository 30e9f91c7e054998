"""String similarity and fuzzy name search (sequence-matcher ratio; Levenshtein is a different measure and offered apart)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..functions.local import small
from .index import Index
from .ranking import RESULT, top_k


@F.pandas_udf(S.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """0 to 100 after stripping and lower-casing; 0 where a side is empty."""
    matcher, known = SequenceMatcher(None), {}  # a batch compares each pair of strings once

    def ratio(a: str, b: str) -> float:
        a, b = a.strip().lower(), b.strip().lower()
        if a == b:
            return 100.0 if a else 0.0
        matcher.set_seqs(a, b)
        return matcher.ratio() * 100.0 if a and b else 0.0

    pairs = list(zip(left.fillna(""), right.fillna(""), strict=True))
    for p in pairs:
        if p not in known:
            known[p] = ratio(*p)
    return pd.Series([known[p] for p in pairs], dtype="float64")


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """A bound by lengths alone: the ratio is at most 2 min / (sum), so hopeless pairs never reach Python."""
    la, lb = F.length(T.strip(a)), F.length(T.strip(b))
    return 200.0 * F.least(la, lb) >= threshold * (la + lb)


def name_search(index: Index, queries: DataFrame, k: Column | int = 10, threshold: float = 60.0, field: str = "name") -> DataFrame:
    """Names like the query, best first; containment either way counts 88 at least."""
    q = small(queries.select("query_id", T.strip(T.text("query")).alias("_q"), *(["k"] if "k" in queries.columns else [])).where("_q <> ''"))
    rows = index.docs.select(F.col(index.ord_col).alias("ord"), T.text(field).alias("_n")).where("_n <> ''").crossJoin(q)
    inside = F.col("_n").contains(F.col("_q")) | F.col("_q").contains(F.col("_n"))
    rows = rows.withColumn("_in", inside).where(F.col("_in") | may_reach(F.col("_q"), F.col("_n"), threshold))
    score = similarity(F.col("_q"), F.col("_n"))
    rows = rows.withColumn("_s", score).withColumn("score", F.when(F.col("_in"), F.greatest("_s", F.lit(88.0))).otherwise(F.col("_s")))
    rows = rows.where(F.col("score") >= threshold).withColumn("matched_terms", F.array("_q"))
    return top_k(rows, k).select("query_id", "rank", *RESULT[1:])


def field_bonus(index: Index, queries: DataFrame, field: str = "name", bonus: str = "parts") -> DataFrame:
    """(query_id, ord, bonus) for queries of 2 to 6 characters: 8 for containment, else (similarity - 80) / 4 of the best part from 82 on.

    ``bonus="whole_name"``: the whole name only and no containment rule."""
    q = small(queries.select("query_id", T.strip(T.text("query")).alias("_q")).where("length(_q) between 2 and 6"))
    rows = index.docs.select(F.col(index.ord_col).alias("ord"), T.text(field).alias("_n")).where("_n <> ''").crossJoin(q)
    inside = F.col("_n").contains(F.col("_q")) if bonus == "parts" else F.lit(False)
    parts = T.name_parts(F.col("_n")) if bonus == "parts" else F.array("_n")
    hit = rows.where(inside).select("query_id", "ord", F.lit(8.0).alias("bonus"))
    near = rows.where(~inside).select("query_id", "ord", "_q", F.explode(parts).alias("_p")).where(may_reach(F.col("_q"), F.col("_p"), 82.0))
    near = near.withColumn("s", similarity(F.col("_q"), F.col("_p"))).where("s >= 82").groupBy("query_id", "ord").agg(((F.max("s") - 80.0) / 4.0).alias("bonus"))
    return hit.unionByName(near)


def levenshtein_search(index: Index, queries: DataFrame, k: int = 10, most: int = 3, field: str = "name") -> DataFrame:
    """Names within an edit distance, nearest first: a JVM-only alternative."""
    q = small(queries.select("query_id", F.lower(T.strip(T.text("query"))).alias("_q")).where("_q <> ''"))
    rows = index.docs.select(F.col(index.ord_col).alias("ord"), F.lower(T.text(field)).alias("_n")).crossJoin(q)
    rows = rows.where(F.abs(F.length("_n") - F.length("_q")) <= most).withColumn("d", F.levenshtein("_q", "_n"))
    rows = rows.where(F.col("d") <= most).withColumn("score", -F.col("d").cast("double")).withColumn("matched_terms", F.array("_q"))
    return top_k(rows, k).select("query_id", "rank", *RESULT[1:])
