"""Operator 7, benchmark decontamination: a distributed positional inverted index, in DataFrame functions only.

Words are the runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased.  A window is ``window`` consecutive words
of a benchmark item; an item of fewer words is one window.

1. The training frequency of every test term is counted over all documents.
2. For each window the rarest term is chosen (ties: the leftmost).  Neighbouring windows mostly share it, so an item of n words keeps about
   2 n / (window + 1) anchors, each with the range of windows that it stands for.
3. One pass stores the postings of the anchor terms: (term, document, position) with the neighbourhood that the anchor's windows can span
   as payload.  A posting's payload holds the entries of all other terms' lists around it, so lists are intersected there, offset-adjusted
   and rarest term first, and the full lists of frequent words are never stored, shuffled or joined.
4. ``phrase_matches`` gives the exact windows, ``proximity_matches`` those whose words all lie near the anchor in any order.

The test side (terms and anchors) is broadcast while its word count is at most ``BROADCAST_WORDS``; beyond, Spark joins by shuffle.
No document text is ever shuffled.

Defined cases: null texts have no words; items without words or id match nothing; an item id that occurs in several rows counts once;
repeated document rows each get a result row; empty tables give empty results (an empty benchmark: nothing is hit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

WINDOW, MIN_ITEMS, BROADCAST_WORDS = 8, 2, 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; pure ASCII takes the quick way to lower case."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), GAPS), "")


def item_words(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words) of every item with words and an id; ``item`` is the id as a string."""
    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col).cast("string")).alias("iw"))
    return rows.where(F.size("iw") > 0).distinct()


def small(df: DataFrame, n_words: int) -> DataFrame:
    """A broadcast hint for a test side of proven size."""
    return F.broadcast(df) if n_words <= BROADCAST_WORDS else df


def term_counts(docs: DataFrame, items: DataFrame, n_words: int) -> DataFrame:
    """(h, df): how often each test term (by hash) occurs in the training texts."""
    vocab = items.select(F.explode("iw").alias("w")).select(F.xxhash64("w").alias("h")).distinct()
    seen = docs.select(F.explode("ws").alias("w")).select(F.xxhash64("w").alias("h")).join(small(vocab, n_words), "h", "left_semi").groupBy("h").agg(F.count("*").alias("df"))
    return vocab.join(seen, "h", "left").select("h", F.coalesce("df", F.lit(0)).alias("df"))


def anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(h, item, size, before, span): for each anchor the window size, the words of its windows, and how many of them precede it."""
    at = items.select("item", "iw", F.posexplode("iw").alias("off", "w")).withColumn("h", F.xxhash64("w")).join(counts, "h")
    size = F.least(F.size("iw"), F.lit(window))
    first = F.greatest(F.col("off") - size + 1, F.lit(0))
    last = F.least(F.col("off"), F.size("iw") - size)
    per_window = at.withColumn("size", size).select("item", "iw", "size", "h", "off", "df", F.explode(F.sequence(first, last)).alias("w0"))
    rarest = Window.partitionBy("item", "iw", "w0").orderBy("df", "off")
    best = per_window.withColumn("r", F.row_number().over(rarest)).where("r = 1")
    # a text with a rarest term at one place only: the windows of an anchor are neighbours
    grouped = best.groupBy("item", "iw", "size", "h", "off").agg(F.min("w0").alias("lo"), F.max("w0").alias("hi"))
    return grouped.select("h", "item", "size", (F.col("off") - F.col("lo")).alias("before"), F.slice("iw", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("size")).alias("span"))


def build_postings(docs: DataFrame, terms: DataFrame, window: int, n_words: int) -> DataFrame:
    """The stored index: for each document one row with its word count, and one for each posting of an anchor term.

    Columns: doc, tid (hash of the text), n_words, h, pos, start (position of the payload's first word), around."""
    exploded = docs.select("doc", "tid", "ws", F.size("ws").alias("n_words"), F.posexplode_outer("ws").alias("pos", "w")).withColumn("h", F.xxhash64("w"))
    marked = exploded.join(small(terms.select("h", F.lit(True).alias("anchor")).distinct(), n_words), "h", "left")
    kept = marked.where(F.col("anchor") | F.col("pos").isNull() | (F.col("pos") == 0))
    start = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    around = F.when(F.col("anchor"), F.slice("ws", start + 1, F.col("pos") - start + window))
    return kept.select("doc", "tid", F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("n_words")).cast("long").alias("n_words"), F.when(F.col("anchor"), F.col("h")).alias("h"), "pos", start.alias("start"), around.alias("around"))


def phrase_matches(postings: DataFrame, terms: DataFrame, n_words: int) -> DataFrame:
    """(doc, tid, item, hits): exact windows; ``hits`` are the document's word positions inside them."""
    both = postings.where("h is not null").select("doc", "tid", "h", "pos", "start", "around").join(small(terms, n_words), "h")
    # the payload's word at place k of the span, null outside the text
    same = F.transform("span", lambda w, k: F.coalesce(F.get("around", F.col("pos") - F.col("start") - F.col("before") + k) == w, F.lit(False)))
    both = both.withColumn("same", same).where(F.element_at("same", F.col("before") + 1))
    starts = F.filter(F.sequence(F.lit(0), F.size("span") - F.col("size")), lambda i: F.forall(F.slice("same", i + 1, F.col("size")), lambda x: x))
    both = both.withColumn("full", starts).where(F.size("full") > 0)
    hits = F.array_distinct(F.flatten(F.transform("full", lambda i: F.sequence(F.col("pos") - F.col("before") + i, F.col("pos") - F.col("before") + i + F.col("size") - 1))))
    return both.select("doc", "tid", "item", hits.alias("hits"))


def proximity_matches(postings: DataFrame, terms: DataFrame, n_words: int, least: float = 1.0) -> DataFrame:
    """(doc, tid, item, pos, share): anchors around which at least ``least`` of the distinct words of their windows occur, in any order."""
    both = postings.where("h is not null").join(small(terms, n_words), "h")
    share = F.size(F.array_intersect("span", "around")) / F.size(F.array_distinct("span"))
    return both.withColumn("share", share).where(F.col("share") >= least).select("doc", "tid", "item", "pos", "share")


def index_and_terms(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(stored postings, anchors, number of test words)."""
    items = scratch.persist_table(item_words(benchmark, item_col, item_text), "items")
    n_words = items.agg(F.coalesce(F.sum(F.size("iw")), F.lit(0))).first()[0]
    text = F.col(text_col).cast("string")
    docs = documents.select(F.col(id_col).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tid"), words(text).alias("ws"))
    counts = scratch.persist_table(term_counts(docs, items, n_words), "term-counts")
    terms = scratch.persist_table(anchors(items, counts, window), "anchors")
    return scratch.persist_table(build_postings(docs, terms, window, n_words), "postings"), terms, n_words


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, items, text_hash) for each document row; with its id, the hash
    (xxhash64) of the text says which row it is."""
    index, terms, n_words = index_and_terms(documents, benchmark, window, id_col, text_col, item_col, item_text)
    found = phrase_matches(index, terms, n_words).distinct()
    hit = found.groupBy("doc", "tid").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items"))
    rows = index.where("n_words is not null").select("doc", "tid", "n_words")
    hit = hit.select(F.col("doc").alias("_d"), F.col("tid").alias("_t"), "n_hit", "items")
    out = rows.join(hit, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("tid") == F.col("_t")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("doc").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size(items) >= min_items).alias("contaminated"),
        items.alias("items"),
        F.col("tid").alias("text_hash"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact benchmark windows in whole ``documents``."""
    return decontaminate(scratch.load(spark, sf_dir, "documents"), scratch.load(spark, sf_dir, "benchmark")).drop("items", "text_hash")


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 8) AS k, array_to_string(list_slice(ws, i + 1, i + least(len(ws), 8)), ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(len(ws) - least(len(ws), 8) + 1)) AS i FROM b WHERE len(ws) > 0)
), ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT rid, k, i, array_to_string(list_slice(ws, i + 1, i + k), ' ') AS g
  FROM (SELECT rid, ws, k, unnest(range(len(ws) - k + 1)) AS i FROM d, ks WHERE len(ws) >= k)
), m AS (SELECT rid, item_id, i, dw.k AS k FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM m) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
