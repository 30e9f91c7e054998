"""Corpus building: pages to documents, seed overlay, duplicates, summaries, and the crawl as steps over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import pages as P
from ..functions import text as T
from ..functions.lexicon import DEFAULT, Lexicon
from .index import shared_folder


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order (deterministic, unlike dropDuplicates)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def mark_first(df: DataFrame, key: Column, order: list) -> DataFrame:
    """``df`` with ``is_first``: whether a row is its key's first."""
    # the digest of the key stands for it, so that no long text is a key of the shuffle
    return df.withColumn("_k", F.sha2(key.cast("string"), 256)).withColumn("is_first", F.row_number().over(Window.partitionBy("_k").orderBy(*order)) == 1).drop("_k")


def parse_pages(pages: DataFrame, url: Column, html: Column, college: Column, lex: Lexicon = DEFAULT) -> DataFrame:
    """Typed documents of pages: text, fields, sections, identity and the classifier's verdict."""
    text = pages.withColumn("_text", T.deobfuscate_email(H.html_to_text(T.text(html)))).withColumn("_url", T.text(url)).withColumn("_college", T.text(college))
    parsed = text.withColumn("_p", P.parse_fields("_text", "_college")).withColumn("_c", P.classify_page(F.col("_text"), lex))
    fields = {c: F.col(f"_p.{c}") for c in ("name", "college", "title", "research", "papers", "profile", "content", "sections")}
    out = parsed.withColumns(fields | {"url": F.col("_url"), "final_url": F.col("_url"), "doc_id": T.sha_id(F.col("_url"), F.col("_text")), "is_teacher_page": F.col("_c.keep"), "page_reason": F.col("_c.reason")})
    return out.drop("_text", "_url", "_college", "_p", "_c")


def last_seeds(seeds: DataFrame, order: list) -> DataFrame:
    """Seeds by raw key: of several with one url the last in order holds."""
    keyed = seeds.where(T.text("url") != "").withColumn("raw_key", T.raw_key(F.trim("url")))
    w = Window.partitionBy("raw_key").orderBy(*[o.desc() if isinstance(o, Column) else F.desc(o) for o in order])
    return keyed.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def overlay_seeds(files: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pages (raw_key, ...) with their seed's college, name and url, null without one."""
    return files.join(seeds.select("raw_key", F.col("college").alias("seed_college"), F.col("name").alias("seed_name"), F.col("url").alias("seed_url")), "raw_key", "left")


def build_documents(files: DataFrame, seeds: DataFrame, include_nonteacher: bool = True, dedupe: bool = True, lex: Lexicon = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(documents, report) of saved pages (path, folder, raw_key, html): the seed's name and url and the folder's college win over parsed values,
    which are kept apart; of equal keys (url, else name, else path) the first path stays.  Documents are ordered by doc_ord."""
    joined = overlay_seeds(files, seeds)
    unit = F.when(T.text("seed_college") != "", F.col("seed_college")).otherwise(F.col("folder"))
    docs = parse_pages(joined, T.text("seed_url"), F.col("html"), unit, lex).drop("html")
    named = T.text("seed_name") != ""
    docs = docs.withColumns({
        "parsed_name": F.when(named & (F.col("name") != "") & (F.col("name") != F.col("seed_name")), F.col("name")),
        "parsed_college": F.when((F.col("college") != "") & (F.col("college") != F.col("folder")), F.col("college")),
        "name": F.when(named, F.col("seed_name")).otherwise(F.col("name")),
        "college": F.col("folder"),
        "source": F.lit("handoff_html"),
    })
    key = F.when(F.col("url") != "", F.col("url")).when(F.col("name") != "", F.col("name")).otherwise(F.col("path"))
    kept = F.col("is_teacher_page") | F.lit(include_nonteacher)
    marked = mark_first(docs.withColumn("_kept", kept), F.struct(F.col("_kept"), key), ["path"])
    status = F.when(~F.col("_kept"), "skipped_nonteacher").when(~F.col("is_first") & F.lit(dedupe), "skipped_duplicate").otherwise("saved")
    marked = marked.withColumn("status", status).drop("_kept", "is_first")
    report = marked.select("path", "status", "name", "college", "title", "url", F.size("sections").alias("section_count"), F.col("page_reason").alias("reason"))
    saved = marked.where("status = 'saved'").drop("status")
    return saved.orderBy("college", "name", "doc_id"), report


def summarize(docs: DataFrame, unknown: str = "未知学院") -> DataFrame:
    """(name, value): documents, facets, and documents by facet, in one aggregation."""
    by = docs.groupBy(F.when(T.text("college") == "", unknown).otherwise(F.col("college")).alias("name")).agg(F.count("*").alias("value"))
    total = by.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("doc_count"), F.count("*").alias("college_count"))
    rows = total.select(F.explode(F.create_map(F.lit("doc_count"), F.col("doc_count"), F.lit("college_count"), F.col("college_count"))).alias("name", "value"))
    return rows.unionByName(by)


def frontier_step(fetched: DataFrame, visited: DataFrame, url_col: str = "url", html_col: str = "html", same_domain: bool = True, domains: tuple[str, ...] = ()) -> DataFrame:
    """(url, parent): the next breadth-first level of a crawl: new links of the fetched pages, first parent wins."""
    found = fetched.select(F.col(url_col).alias("parent"), F.posexplode(H.discover_links(F.col(url_col), F.col(html_col), same_domain, domains)).alias("pos", "url"))
    first = found.groupBy("url").agg(F.min(F.struct("parent", "pos")).alias("p")).select("url", F.col("p.parent").alias("parent"))
    return first.join(visited.select("url").distinct(), "url", "left_anti")


def crawl(seeds: DataFrame, store: DataFrame, max_pages: int | None = 100, follow: bool = True, domains: tuple[str, ...] = ()) -> DataFrame:
    """Breadth-first crawl over a table of pages (url, html) that stands for the network: (url, level, html, status).

    At most ``max_pages`` urls in all, None: all that are found.  Frontier and visited urls stay tables; the driver counts the levels."""
    spark, level, n, seen, parts = seeds.sparkSession, 0, 0, None, None
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    pages = store.select(H.normalize_url(F.col("url")).alias("url"), "html")
    named = seeds.select(H.normalize_url(F.col("url")).alias("url"), F.monotonically_increasing_id().alias("pos")).where("url is not null")
    queue, order = named.groupBy("url").agg(F.min("pos").alias("pos")), "pos"
    while max_pages is None or n < max_pages:
        now = (queue if max_pages is None else queue.orderBy(order).limit(max_pages - n)).select("url")
        now = now.checkpoint()  # in the folder that executors share: a lost one costs a re-read
        size = now.count()
        if not size:
            break
        n += size
        seen = now if seen is None else seen.unionByName(now)
        got = pages.join(now, "url", "right").select("url", F.lit(level).alias("level"), "html", F.when(F.col("html").isNull(), "fetch_error").otherwise("fetched").alias("status"))
        parts = got if parts is None else parts.unionByName(got)
        if not follow:
            break
        queue, order = frontier_step(got.where("html is not null"), seen, domains=domains), "url"
        level += 1
    return parts if parts is not None else spark.createDataFrame([], "url string, level int, html string, status string")


def crawl_ledger(pages: DataFrame, include_nonteacher: bool = False, lex: Lexicon = DEFAULT, seeds: DataFrame | None = None) -> DataFrame:
    """Status of each crawled page (url, html, status): fetch_error, skipped_nonteacher, skipped_duplicate (same name, else url), saved.

    With ``seeds`` (url, college, name; urls as crawled, of equal ones the largest name holds) a page takes its seed's college, and a seed's name wins over the
    parsed one, which stays in ``parsed_name``."""
    fetched = pages.withColumnRenamed("url", "_u").withColumn("fetch", F.col("status"))
    if seeds is None:
        fetched = fetched.withColumn("_seed", F.lit(None).cast("struct<name: string, college: string>"))
    else:
        meta = seeds.groupBy(H.normalize_url(F.col("url")).alias("_url")).agg(F.max(F.struct(T.text("name").alias("name"), T.text("college").alias("college"))).alias("_seed"))
        fetched = fetched.join(meta, H.normalize_url(F.col("_u")) == F.col("_url"), "left").drop("_url")
    docs = parse_pages(fetched, F.col("_u"), F.col("html"), T.text("_seed.college"), lex)
    named = T.text("_seed.name") != ""
    docs = docs.withColumns({
        "parsed_name": F.when(named & (F.col("name") != F.col("_seed.name")), F.col("name")),
        "name": F.when(named, F.col("_seed.name")).otherwise(F.col("name")),
    })
    key = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("final_url"))
    fine = (F.col("fetch") != "fetch_error") & (F.col("is_teacher_page") | F.lit(include_nonteacher))
    marked = mark_first(docs.withColumn("_f", fine), F.struct("_f", key), ["_u"])
    status = F.when(F.col("fetch") == "fetch_error", "fetch_error").when(~F.col("_f"), "skipped_nonteacher").when(~F.col("is_first"), "skipped_duplicate").otherwise("saved")
    own = ["college", "parsed_name"] if seeds is not None else []
    return marked.select(F.col("_u").alias("url"), status.alias("status"), "name", "title", F.size("sections").alias("section_count"), "page_reason", *own)


def new_seeds(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Seeds with name and url that no existing row has, each url once."""
    ok = found.where((T.text("name") != "") & (T.text("url") != ""))
    return first_by(ok, ["url"], ["college", "name"]).join(existing.select("url").distinct(), "url", "left_anti")


def assign_sections(docs: DataFrame, id_col: str, text_col: str, heading: str) -> DataFrame:
    """(id, line, section, text): every line under the last line before it that matches the heading pattern."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(T.text(text_col), "\n")).alias("line", "text"))
    w = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("section", F.last(F.when(F.col("text").rlike(heading), F.col("text")), ignorenulls=True).over(w))
