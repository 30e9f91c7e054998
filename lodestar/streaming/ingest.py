"""Incremental ingest: a stream of pages becomes documents and postings (an extension; the batch operators do the work)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import html as H
from ..functions import text as T
from ..operators.corpus import first_by
from ..operators.index import corpus


def page_stream(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    """New page files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def ingest(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append documents and postings of every micro-batch below ``out``, each url once (its smallest page); a batch that is repeated overwrites
    its own folder.

    Urls of earlier batches are looked up in the documents that they have written, so the stream keeps no state that grows with it."""

    def write(batch: DataFrame, number: int) -> None:
        batch = first_by(batch, ["url"], ["page_id"])
        spark = batch.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/documents")
        if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            seen = spark.read.parquet(f"{out}/documents").where(F.col("batch") != number)
            batch = batch.join(seen.select("url").distinct(), "url", "left_anti").select(*batch.columns)
        docs = batch.select("page_id", "url", H.html_to_text(T.text("html")).alias("content"))
        docs.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        corpus(docs, ("content",), "page_id").postings().write.mode("overwrite").parquet(f"{out}/postings/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
