"""Records to documents: one merged document for each URL of a crawl, with derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.functions import scalars as X
from webquarry.model import DOCUMENT

SNIP_BYTES = 16 * 1024


def merge_pages(records: DataFrame, facts: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (crawl_id, url).

    records: crawl_id, url, seq (input order), kind ('html' or 'text'), timestamp, and the columns of a page. Of html
    records the last non-empty value of each column wins and the last timestamp; text records give the body, and fill
    timestamp and title only where html gave none. Pages without title, body and description are dropped. A single
    shuffle on (crawl_id, url) with partial aggregation; no ordering of groups. records may be a stream: then the
    aggregates are its state. facts: further columns, of which the latest record's values are kept.
    """
    html, text = F.col("kind") == "html", F.col("kind") == "text"
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    last = lambda c, side: F.max_by(F.when(side & filled(c), F.col(c)), F.when(side & filled(c), F.col("seq")))
    first = lambda c, side: F.min_by(F.when(side & filled(c), F.col(c)), F.when(side & filled(c), F.col("seq")))
    own = ("title", "body", "description", "headings", "keywords", "author", "lang", "media_type", "status", "modified")
    merged = records.groupBy("crawl_id", "url").agg(
        *[last(c, html).alias(c) for c in own],
        F.max_by(F.when(html, F.col("timestamp")), F.when(html, F.col("seq"))).alias("html_ts"),
        first("timestamp", text).alias("text_ts"),
        first("title", text).alias("text_title"),
        last("body", text).alias("text_body"),
        *[F.max_by(c, "seq").alias(c) for c in facts],
    )
    blank = lambda c: F.coalesce(c, F.lit(""))
    out = merged.select(
        "crawl_id",
        "url",
        blank(F.coalesce(F.nullif(F.col("html_ts"), F.lit("")), F.col("text_ts"))).alias("timestamp"),
        blank(F.coalesce("title", "text_title")).alias("title"),
        blank(F.coalesce("text_body", "body")).alias("body"),
        *[blank(F.col(c)).alias(c) for c in ("description", "headings", "keywords", "author", "lang")],
        F.coalesce("media_type", F.lit("html")).alias("media_type"),
        "status",
        "modified",
        *facts,
    )
    return out.where((F.col("title") != "") | (F.col("body") != "") | (F.col("description") != ""))


def derive(pages: DataFrame, site: Column | None = None, lang: Column | None = None, snip_bytes: int = SNIP_BYTES) -> DataFrame:
    """Documents from merged pages: pages carries doc_id, crawl_id, crawl_name, collection and a page's columns.

    site: registrable domain, the host's last two labels unless given. lang: a guess for pages that declare none.
    """
    host = X.host("url")
    declared = F.coalesce(X.primary_lang("lang"), F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    made = {
        "doc_type": F.lit("page"),
        "body_snip": X.byte_prefix(text("body"), snip_bytes),
        "domain": host,
        "site": X.last_labels(host) if site is None else site,
        "url_tokens": X.url_tokens("url"),
        "year": X.year_of("timestamp"),
        "month": X.month_of("timestamp"),
        "type": text("media_type"),
        "lang": declared if lang is None else F.when(declared == "", F.coalesce(lang, F.lit(""))).otherwise(declared),
    } | {c: text(c) for c in ("title", "body", "description", "headings", "keywords", "author")}
    return pages.select([(made[f.name] if f.name in made else F.col(f.name)).cast(f.dataType).alias(f.name) for f in DOCUMENT.fields])


def collection_documents(crawls: DataFrame) -> DataFrame:
    """The document of each crawl itself: titled by its name, with description and seeds as its body."""
    seeds = F.flatten(F.transform("seed_pages", lambda p: F.filter(F.array(p["title"], p["url"]), lambda x: x.isNotNull())))
    body = F.concat_ws(" ", F.col("description"), seeds)
    made = {"doc_id": F.col("doc_id"), "doc_type": F.lit("collection"), "crawl_id": F.col("id"), "crawl_name": F.col("name"), "title": F.col("name"), "collection": F.coalesce("collection", F.lit("")), "body": body, "body_snip": X.byte_prefix(body, SNIP_BYTES), "timestamp": F.coalesce("created", F.lit("")), "description": F.coalesce("description", F.lit(""))}
    return crawls.select([made.get(f.name, F.lit("" if f.dataType.typeName() == "string" else None)).cast(f.dataType).alias(f.name) for f in DOCUMENT.fields])


def captures(pages: DataFrame) -> DataFrame:
    """A page table (page_id, url, html) as captures: seven crawls in three collections, one to three captures each.

    Times, statuses and types follow from page_id, so that SQL can make the same rows.
    """
    p, r = F.col("page_id"), F.col("repeat")
    # a page is read once, whatever the number of its captures
    read = pages.select("page_id", "url", X.html_title("html").alias("title"), X.tag_strip("html").alias("body"), X.html_headings("html").alias("headings"), X.html_lang("html").alias("lang"), F.length("html").cast("bigint").alias("bytes"))
    rows = read.withColumn("repeat", F.explode(F.sequence(F.lit(0), (p % 3).cast("int"))))
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return rows.select(
        (p * 4 + r).alias("doc_id"),
        X.hash8(F.concat(F.lit("crawl-"), (p % 7).cast("string"))).alias("crawl_id"),
        F.concat(F.lit("Crawl "), (p % 7).cast("string")).alias("crawl_name"),
        F.concat(F.lit("col-"), (p % 7 % 3).cast("string")).alias("collection"),
        "url",
        F.concat((F.lit(2015) + (p + r) % 10).cast("string"), pad(1 + (p * 7 + r) % 12), pad(1 + p % 28), F.lit("120000")).alias("timestamp"),
        "title",
        "body",
        F.lit("").alias("description"),
        "headings",
        F.lit("").alias("keywords"),
        F.lit("").alias("author"),
        "lang",
        F.when(p % 7 == 3, "pdf").otherwise("html").alias("media_type"),
        F.when(p % 11 == 0, 404).when(p % 13 == 0, 301).otherwise(200).alias("status"),
        F.when(p % 5 == 0, (2010 + p % 12).cast("int")).alias("modified"),
        "bytes",
    )
