"""Incremental ingest: a stream of page records is merged page by page and upserted; the checkpoint is the resume point.

The merge of a page's records is a streaming aggregation: what is known of each page is the state, which Spark keeps
beside the checkpoint (in RocksDB, if the session says so), and a batch gives the pages that it changed and no others.
These go into the index as a segment of their own, and the former documents of the same pages are marked in theirs.
So a batch costs what it touches, whatever came before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from webquarry.config import load
from webquarry.functions import trigrams
from webquarry.operators import maintain
from webquarry.operators.documents import merge_pages
from webquarry.plans.ingest import Manifest, as_documents
from webquarry.sources import finding_aids
from webquarry.sources.locations import STREAM
from webquarry.sources.package_stream import registered


def ingest_stream(records: DataFrame, home: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """records: the input of merge_pages, with crawl_name and collection; a crawl may come in any number of batches.

    seq must order a crawl's records over all batches: then documents are what one batch of all records would give. A
    batch that is run again after a failure gives the same pages and replaces the same documents. Crawls are registered
    as streamed ones, which a rebuild keeps, or with the registered package that they came from, which a rebuild reads
    again. A crawl that was read from a package before keeps its other documents.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        written = maintain.upsert_documents(spark, home, as_documents(batch, F.col("crawl_name"), F.col("collection"), load(home), trigrams.load(spark, home)))
        if written is None:
            return
        manifest, packages = Manifest.open(spark, home), {r["id"]: r["source"] for r in registered(spark, home)}
        crawls = written.groupBy("crawl_id").agg(*[F.max_by(c, "timestamp").alias(c) for c in ("crawl_name", "collection")]).collect()  # a row for each crawl of the batch
        for r in crawls:
            old = manifest.rows.get(r["crawl_id"])
            if old is None or old["source"].startswith(STREAM):
                manifest.put({"id": r["crawl_id"], "name": r["crawl_name"], "collection": r["collection"], "source": packages.get(r["crawl_id"], STREAM + r["crawl_id"]), "sha256": None})
                finding_aids.seed(spark, home, r["collection"], {})
        if maintain.fragmented(spark, home):
            maintain.compact(spark, home)

    pages = merge_pages(records, facts=("crawl_name", "collection"))
    return pages.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class ProgressListener(StreamingQueryListener):
    """Hands (kind, facts) of every query to a function: begin, batch and done or error."""

    def __init__(self, tell: Callable[[str, dict], None]):
        self.tell = tell

    def onQueryStarted(self, event):
        self.tell("begin", {"query": str(event.id)})

    def onQueryProgress(self, event):
        p = event.progress
        self.tell("batch", {"query": str(p.id), "batch": p.batchId, "records": p.numInputRows})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.tell("error" if event.exception else "done", {"query": str(event.id), "message": event.exception})


def first_seen(pages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First event of each url within the watermark: a stream (url, ts, ...) without repeats."""
    return pages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["url"])


def windowed_counts(events: DataFrame, every: str, slide: str | None = None, delay: str = "0 seconds", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts in tumbling or sliding windows of event time ts."""
    w = F.window("ts", every, slide) if slide else F.window("ts", every)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(events: DataFrame, gap: str, key: str, delay: str = "0 seconds") -> DataFrame:
    """Counts in sessions of a key that a gap ends."""
    s = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
