"""Sources and sinks: JSON lines, seed lists, page folders, judgements, queries and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import html as H
from ..functions import text as T

STRINGS = ("doc_id", "name", "college", "title", "research", "papers", "profile", "content", "url", "final_url", "email", "phone", "photo_url")
EXTRA = S.StructType([S.StructField("sections", S.MapType(S.StringType(), S.StringType())), S.StructField("clean_flags", S.ArrayType(S.StringType())), S.StructField("is_teacher_page", S.BooleanType()), S.StructField("status_code", S.IntegerType()), *[S.StructField(k, S.StringType()) for k in ("clean_quality", "raw_path", "page_reason", "seed_file", "seed_college", "source", "parsed_name", "parsed_college", "client_redirect_url", "error", "cleaned_from")]])
DOCUMENT = S.StructType([*[S.StructField(k, S.StringType()) for k in STRINGS], S.StructField("extra", EXTRA)])


def project_document(df: DataFrame) -> DataFrame:
    """The document columns only; missing ones are empty strings."""
    have = set(df.columns)
    return df.select(*[(T.text(c) if c in have else F.lit("")).alias(c) for c in STRINGS], *(["extra"] if "extra" in have else []))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON lines in file order (``doc_ord``); a malformed line raises, unknown keys are dropped, missing ones are empty."""
    rows = spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path)
    return _in_file_order(rows).select(*[T.text(c).alias(c) for c in STRINGS], "extra", "doc_ord")


#: Where a row was read: its file, its block of the file, and its place among the rows of the task, which reads a block from front to end.
def _place() -> tuple:
    return F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_r")


def _in_file_order(rows: DataFrame) -> DataFrame:
    """Rows with ``doc_ord``, counted from 0 over all files: places inside each block, plus the rows of the blocks before it (one row for each
    block is all that a single task sees)."""
    placed = rows.select("*", *_place())
    blocks = placed.groupBy("_f", "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("_f", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_r")) - 1
    return placed.withColumn("_i", inside).join(offsets, ["_f", "_b"]).withColumn("doc_ord", F.col("_i") + F.col("_before")).drop("_f", "_b", "_r", "_i", "_before")


def write_documents(df: DataFrame, path: str) -> None:
    """JSON lines, overwriting."""
    df.drop("doc_ord").write.mode("overwrite").json(path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed lists (college, name, url, seed_file): a byte-order mark is dropped, values trimmed, rows without url left out.

    ``path`` may be a glob such as ``root/*/seeds.csv``; a missing college is the folder's name."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("seed_file"))
    raw = raw.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in raw.columns if c != c.lstrip("﻿").strip()})
    own = {c: F.trim(T.text(c)) if c in raw.columns else F.lit("") for c in ("college", "name", "url")}
    rows = raw.select(*[v.alias(k) for k, v in own.items()], "seed_file").where("url <> ''")
    return rows.withColumn("college", F.when(F.col("college") == "", F.element_at(F.split("seed_file", "/"), -2)).otherwise(F.col("college")))


def read_known_urls(spark: SparkSession, path: str, secure_host: str = "") -> DataFrame:
    """Seeds with repaired urls."""
    return read_seeds(spark, path).withColumn("url", H.repair_url(F.col("url"), secure_host))


def write_seeds(df: DataFrame, path: str) -> None:
    """Seed lists with a header that starts with a byte-order mark."""
    df.select(F.col("college").alias("﻿college"), "name", "url").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_page_folders(spark: SparkSession, root: str, skip: str = "colleges") -> DataFrame:
    """(path, folder, raw_key, html) of ``root/<folder>/*.html``; bytes that are not UTF-8 are dropped."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(f"{root}/*/")
    parts = F.split("path", "/")
    valid = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "")
    return rows.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("raw_key"), valid.alias("html")).where(F.col("folder") != skip)


def raw_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(raw_key, html): what the crawl keeps of a page."""
    return pages.select(T.raw_key(F.col(url_col)).alias("raw_key"), F.col(html_col).alias("html"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, relevance): relevance 1 where it is missing, the last of repeated judgements."""
    rows = spark.read.schema("query_id string, doc_id string, relevance int").json(path).select("*", *_place())
    return rows.groupBy("query_id", "doc_id").agg(F.max_by(F.coalesce("relevance", F.lit(1)), F.struct("_f", "_b", "_r")).alias("relevance"))


def infer_field(df: DataFrame) -> DataFrame:
    """The field of a query: its own, else by category."""
    field = F.col("field") if "field" in df.columns else F.lit(None).cast("string")
    return df.withColumn("field", F.coalesce(field, F.when(F.col("category").isin("exact_name", "fuzzy_name"), "name").otherwise("all")))


def read_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, judgements given inline): a missing id is Q and the 1-based line number, blank lines counted; inline ids get grade 3."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "json")).where(F.trim("json") != "")
    rows = lines.select("line", F.from_json("json", "query_id string, query string, field string, category string, intent string, relevant array<string>").alias("j")).select("line", "j.*")
    rows = infer_field(rows.withColumn("query_id", F.coalesce("query_id", F.format_string("Q%03d", F.col("line") + 1))))
    return rows.drop("relevant", "line"), rows.select("query_id", F.explode("relevant").alias("doc_id"), F.lit(3).alias("relevance"))


def write_report(df: DataFrame, path: str) -> None:
    """A small report as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)
