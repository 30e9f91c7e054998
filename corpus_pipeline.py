"""The corpus pipeline: language ID, near-duplicate removal, repeated-string removal, benchmark decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each to the shared scratch folder and reads it as the
next one's documents.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, jaccard_join, language_id, packing, scratch, suffix_dedup

#: No SQL can express language models, external suffix sorting or packing: the stages are tested against plain versions.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: null texts and texts without a letter.

    The model learns from the labelled folds only; a document's own label plays no part in keeping it."""
    docs = _columns(docs)
    model = language_id.fit(docs.where(~language_id.held_out()))
    return _columns(language_id.predict(docs, model, carry=list(COLUMNS)).where("lang_pred <> 'und'"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: the one with its smallest id (of repeated rows of that id, the smallest text)."""
    comp = jaccard_join.jaccard_components(docs).where("component_id is null or doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(comp, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    return _columns(kept.withColumn("_place", F.when(F.col("doc_id").isNull(), 1).otherwise(place)).where("_place = 1"))


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that occur twice, and passages of over 50 words that another document holds, are cut out; a document of which
    nothing is left goes."""
    others = [c for c in COLUMNS if c != "text"]
    cut = suffix_dedup.suffix_dedup(docs, carry=others, words=suffix_dedup.WORDS).where("not changed or kept <> ''")
    n_chars = F.when(F.col("changed"), F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return cut.select("row.doc_id", F.col("kept").alias("text"), "row.lang", "row.source", n_chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 8 consecutive words of a benchmark item go, and those that hold two items of any length (one item of fewer words,
    whole, is too common to tell a leak)."""
    long = F.size(decontaminate.words(F.col("text"))) >= decontaminate.WINDOW
    items = scratch.load(spark, sf_dir, "benchmark").select(F.concat(F.when(long, "L").otherwise("S"), F.col("item_id").cast("string")).alias("item_id"), "text")
    ids = F.array_distinct(F.transform("items", lambda x: F.substring(x, 2, 1 << 30)))
    leak = F.exists("items", lambda x: x.startswith("L")) | (F.size(ids) >= decontaminate.MIN_ITEMS)
    hit = decontaminate.decontaminate(docs, items, min_items=1).where(leak).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_hash"))
    return _columns(docs.join(hit, same, "left_anti"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, packed into sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_strings),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = scratch.load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.persist_table(docs, f"stage-{name}")
    return docs
