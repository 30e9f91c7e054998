"""Command line: search, evaluate, clean, parse, crawl."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import service
from .functions.lexicon import FIELDS, REPEATS
from .functions.local import local_table
from .operators import clean, corpus, evaluate, ranking, search
from .operators.index import corpus as index_of
from .operators.vector import EncoderMissing
from .sources import io


def metrics(spark: SparkSession, data: str, queries: str, qrels: str, modes: list[str], k: int, threshold: int) -> dict[str, dict]:
    """{mode: {"overall": metrics, "by_category": {category: metrics}}}; a mode whose encoder is missing is left out, with a line that says so."""
    index = index_of(io.read_documents(spark, data), FIELDS, "doc_id", "doc_ord", REPEATS)
    asked, inline = io.read_queries(spark, queries)
    judged = inline.unionByName(io.read_qrels(spark, qrels)) if qrels else inline
    reports = {}
    for mode in modes:
        try:
            rows = ranking.with_ids(search.MODES[mode](index, asked, k), index)
        except EncoderMissing as e:
            print(f"{mode} skipped: {e}")
            continue
        got = [r.asDict() for r in evaluate.evaluate(rows, asked, judged, k, threshold).orderBy("category").collect()]  # a row for each category
        split = {r.pop("category"): r for r in got}
        reports[mode] = {"overall": split.pop(None, {}), "by_category": split}
    return reports


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="documents for one query")
    s.add_argument("--data", required=True)
    s.add_argument("--query", required=True)
    s.add_argument("--top-k", type=int, default=5)
    s.add_argument("--field", default="all", choices=["all", "name", "college", "research", "papers", "title"])
    s.add_argument("--mode", default="optimized", choices=sorted(search.ENGINES))
    e = sub.add_parser("evaluate", help="metrics of modes over judged queries")
    for a in ("--data", "--queries"):
        e.add_argument(a, required=True)
    e.add_argument("--qrels", default="")
    e.add_argument("--modes", default="", help="names with commas between")
    e.add_argument("--ablation", action="store_true", help="all steps from the baseline to the optimised search")
    e.add_argument("--no-breakdown", action="store_true")
    e.add_argument("--output", help="JSON file for the metrics")
    e.add_argument("--top-k", type=int, default=5)
    e.add_argument("--rel-threshold", type=int, default=2)
    c = sub.add_parser("clean", help="clean and grade documents")
    c.add_argument("--input", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--report")
    c.add_argument("--drop-low-quality", action="store_true")
    h = sub.add_parser("parse", help="folders of pages to documents")
    h.add_argument("--root", required=True)
    h.add_argument("--seeds", help="glob of seed lists")
    h.add_argument("--output", required=True)
    h.add_argument("--teachers-only", action="store_true")
    w = sub.add_parser("crawl", help="crawl a stored table of pages (url, html) from seeds; ledger out")
    w.add_argument("--pages", required=True, help="Parquet table that stands for the network")
    w.add_argument("--seed", action="append", default=[])
    w.add_argument("--seed-file")
    w.add_argument("--college", default="")
    w.add_argument("--max-pages", type=int, default=50)
    w.add_argument("--follow-links", action="store_true")
    w.add_argument("--include-nonteacher", action="store_true")
    w.add_argument("--report", required=True)
    args = p.parse_args(argv)
    if args.command == "crawl" and not (args.seed or args.seed_file):
        p.error("--seed or --seed-file is needed")
    if args.command == "evaluate":
        modes = [m.strip() for m in args.modes.split(",") if m.strip()] or list(search.ABLATION if args.ablation else search.COMPARED)
        if unknown := [m for m in modes if m not in search.MODES]:
            p.error(f"unknown modes {unknown}")
    spark = SparkSession.builder.appName("lodestar").getOrCreate()
    if args.command == "search":
        index = index_of(io.read_documents(spark, args.data), FIELDS, "doc_id", "doc_ord", REPEATS)
        print(json.dumps(service.search_response(index, args.query, args.field, args.top_k, engine=args.mode), ensure_ascii=False, indent=2))
    elif args.command == "evaluate":
        reports = metrics(spark, args.data, args.queries, args.qrels, modes, args.top_k, args.rel_threshold)
        for mode, r in reports.items():
            for name, m in [(mode, r["overall"]), *([] if args.no_breakdown else r["by_category"].items())]:
                print(name, *(f"{k}={v:.4f}" if isinstance(v, float) else f"{k}={v}" for k, v in m.items()))
        if args.output:
            asked = {"data": args.data, "queries": args.queries, "qrels": args.qrels or None, "top_k": args.top_k, "rel_threshold": args.rel_threshold}
            Path(args.output).parent.mkdir(parents=True, exist_ok=True)
            Path(args.output).write_text(json.dumps(asked | {"reports": reports}, ensure_ascii=False, indent=2), encoding="utf-8")
    elif args.command == "crawl":
        seeds = local_table(spark, [(u, args.college, "") for u in args.seed], "url string, college string, name string")
        if args.seed_file:
            seeds = seeds.unionByName(io.read_seeds(spark, args.seed_file).select("url", "college", "name"))
        found = corpus.crawl(seeds, spark.read.parquet(args.pages), args.max_pages, args.follow_links)
        io.write_report(corpus.crawl_ledger(found, args.include_nonteacher, seeds=seeds), args.report)
    elif args.command == "clean":
        cleaned = clean.clean_documents(io.read_documents(spark, args.input).withColumn("page_reason", F.col("extra.page_reason")).withColumn("sections", F.col("extra.sections")))
        io.write_documents(clean.split_low(cleaned)[0] if args.drop_low_quality else cleaned, args.output)
        if args.report:
            io.write_report(clean.clean_report(cleaned, args.drop_low_quality), args.report)
    else:
        files = io.read_page_folders(spark, args.root)
        seeds = corpus.last_seeds(io.read_seeds(spark, args.seeds), ["seed_file"]) if args.seeds else spark.createDataFrame([], "raw_key string, college string, name string, url string")
        docs, report = corpus.build_documents(files, seeds, include_nonteacher=not args.teachers_only)
        io.write_documents(docs, args.output)
        report.groupBy("status").count().show()


if __name__ == "__main__":
    main()
