"""The service contract over an index: requests are checked, answers are plain dictionaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from .functions.lexicon import DEFAULT, FIELDS, REPEATS, Lexicon
from .functions.local import local_table
from .operators import ranking, search
from .operators.index import Index, corpus
from .settings import settings
from .sources import io

SHOWN = ("doc_id", "name", "college", "title", "research", "papers", "profile", "content", "url", "final_url", "email", "phone", "photo_url")


def search_response(index: Index, query: str, field: str = "all", top_k: int = 10, college: str | None = None, engine: str = "optimized", lex: Lexicon = DEFAULT) -> dict:
    """``{"total", "results"}``; total is the number of results returned."""
    if not query or not 1 <= top_k <= 100:
        raise ValueError("a query of one character or more and 1 to 100 results are asked for")
    asked = local_table(index.docs.sparkSession, [("q", query, field)], "query_id string, query string, field string")
    run = search.engine(engine)
    rows = run(index, asked, top_k, lex, college=college) if run is search.served else run(index, asked, top_k, lex)
    if college and run is not search.served:
        rows = ranking.post_filter(rows, index, "college", college)
    columns = [c for c in SHOWN if c in index.docs.columns]
    got = ranking.with_ids(rows, index, *columns).orderBy("rank").collect()  # at most top_k rows
    results = [{c: r[c] for c in columns} | {"score": r.score, "matched_terms": list(r.matched_terms)} for r in got]
    return {"total": len(results), "results": results}


def document_response(index: Index, doc_id: str) -> dict | None:
    """The document, or None where the service says 404."""
    row = search.lookup(index.docs, doc_id, index.id_col).first()
    return row.asDict(recursive=True) if row else None


def stats_response(index: Index) -> dict:
    """Documents in all and by facet."""
    rows = search.facet_counts(index.docs, "college", ord_col=index.ord_col).collect()
    return {"total_teachers": sum(r["count"] for r in rows), "colleges": [{"name": r["name"], "count": r["count"]} for r in rows]}


def list_response(index: Index, college: str | None = None, limit: int = 300) -> list[dict]:
    """All documents in load order, or those whose college contains the value; profiles cut.  The answer is the whole list: one for a
    service over a corpus that its client can hold; `search.listing` is the table."""
    columns = [c for c in SHOWN if c in index.docs.columns]
    rows = search.listing(index.docs, college, limit=limit).orderBy(index.ord_col).select(*columns)
    return [r.asDict(recursive=True) for r in rows.toLocalIterator()]


@dataclass(frozen=True)
class Engine:
    """An engine over loaded data: the service's whole contract in one handle."""

    name: str
    index: Index

    def search(self, query: str, field: str = "all", top_k: int = 10, college: str | None = None) -> dict:
        return search_response(self.index, query, field, top_k, college, self.name)

    def document(self, doc_id: str) -> dict | None:
        return document_response(self.index, doc_id)

    def documents(self, college: str | None = None) -> list[dict]:
        return list_response(self.index, college)

    def stats(self) -> dict:
        return stats_response(self.index)


_open: dict[tuple, Engine] = {}


def engine(spark: SparkSession, name: str = "bm25", data: str | None = None) -> Engine:
    """The engine of a name over a data path (else the settings' one): made once for each pair and session; an unknown name raises ValueError."""
    search.engine(name)
    path = data or settings(spark).data
    key = (name, path, spark.sparkContext.applicationId)
    if key not in _open:
        _open[key] = Engine(name, corpus(io.read_documents(spark, path), FIELDS, "doc_id", "doc_ord", REPEATS))
    return _open[key]
