"""What the home and results pages show, as tables: browse links, result rows, facet items and the filters that are set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webquarry.functions import scalars as X
from webquarry.operators.catalog import collection_cards, viewer_source
from webquarry.plans import query as Q
from webquarry.plans.search import FACETS, facet_overview
from webquarry.plans.textindex import TextIndex

PAGE = 20
#: Facets that the home page links to, with how many values: years go by value, latest first, sites by count.
BROWSE = {"year": 12, "site": 8}


def search_href(q: Column | str) -> Column:
    return F.concat(F.lit("/search?q="), X.url_encode(F.lit(q) if isinstance(q, str) else q))


def browse_links(facets: DataFrame) -> DataFrame:
    """field, place (from 1), label, n, href of the home page's entry points, from an overview of facets."""
    order = [F.when(F.col("field") == "year", F.col("value")).desc_nulls_last(), F.desc("n"), F.asc("value")]
    place = F.row_number().over(Window.partitionBy("field").orderBy(*order))
    most = X.either(*[(F.col("field") == f, F.lit(n)) for f, n in BROWSE.items()], otherwise=F.lit(0))
    found = facets.where(F.col("field").isin(*BROWSE)).withColumn("place", place).where(F.col("place") <= most)
    return found.select("field", "place", F.col("value").alias("label"), "n", search_href(F.concat_ws(":", "field", "value")).alias("href"))


def home(index: TextIndex, collections: DataFrame, crawls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards of all collections, browse links) of the home page."""
    return collection_cards(collections, crawls), browse_links(facet_overview(index.docs))


def result_rows(hits: DataFrame, crawls: DataFrame, collections: DataFrame) -> DataFrame:
    """Display columns of a page of hits (search().hits): link into the viewer, title, collection, time and what stands below.

    The text below is the snippet, else the description, else the excerpt, escaped where it isn't yet; null for none.
    """
    known = crawls.select(F.col("id").alias("crawl_id"), viewer_source("id", "source").alias("_source"))
    named = collections.select(F.col("id").alias("collection"), F.col("name").alias("_collection_name"))
    h = hits.join(known, "crawl_id", "left").join(named, "collection", "left")
    whole = F.col("doc_type") == "collection"
    shown = F.coalesce("_collection_name", "collection")
    source = F.coalesce("_source", F.concat(F.lit("/files/"), "crawl_id"))
    fields = lambda **of: F.concat_ws("&", *[F.concat(F.lit(f"{k}="), X.url_encode(v)) for k, v in of.items()])
    page = F.when(whole, F.lit("")).otherwise(F.concat(F.lit("&"), fields(url=F.col("url"), ts=F.col("timestamp"))))
    trail = fields(name=F.col("crawl_name"), collection=shown, collection_id=F.col("collection"), crawl=F.col("crawl_id"))
    href = F.concat(F.lit("/replay/viewer?"), fields(source=source), page, F.lit("&"), trail)
    title = F.coalesce(F.nullif("title", F.lit("")), F.when(whole, F.col("crawl_name")).otherwise(F.col("url")))
    below = F.coalesce(F.nullif("snippet", F.lit("")), X.html_escape(F.nullif("description", F.lit(""))), X.html_escape(F.nullif("body_excerpt", F.lit(""))))
    time = F.when(whole | (F.col("timestamp") == ""), "").otherwise(X.minute_of("timestamp"))
    return h.select("doc_id", "score", href.alias("href"), title.alias("title"), whole.alias("is_collection"), "url", time.alias("time_text"), below.alias("snippet_html"), F.concat(F.lit("/collection/"), X.url_encode("collection")).alias("collection_href"), shown.alias("collection_name"), "capture_count", "status")


def facet_items(facets: DataFrame, q: str) -> DataFrame:
    """field, label, value, n, active, href: the link adds the value to the query as a filter, or takes it out if it is set."""
    set_ = [F.struct(F.lit(f).alias("field"), F.lit(v).alias("value")) for f, v in Q.active_filters(q)]
    active = F.array_contains(F.array(*set_), F.struct("field", "value")) if set_ else F.lit(False)
    token = F.concat_ws(":", "field", "value")
    words = F.array(*map(F.lit, q.split())) if q.split() else F.array().cast("array<string>")
    added = F.concat_ws(" ", F.lit(q.strip()) if q.strip() else F.lit(None).cast("string"), token)
    href = search_href(F.when(active, F.concat_ws(" ", F.filter(words, lambda w: w != token))).otherwise(added))
    label = X.either(*[(F.col("field") == f, F.lit(name)) for f, name in FACETS.items()], otherwise=F.col("field"))
    return facets.select("field", label.alias("label"), "value", "n", active.alias("active"), href.alias("href"))


def set_filters(q: str, crawls: DataFrame) -> DataFrame:
    """place, label, value, remove_query of the filters that a query has set; a crawl is shown by its name."""
    spark = crawls.sparkSession
    rows = [(k, Q.filter_label(f), f, v, Q.without_filter(q, f, v)) for k, (f, v) in enumerate(Q.active_filters(q))]
    found = spark.createDataFrame(rows, "place int, label string, field string, value string, remove_query string")
    named = found.join(crawls.select(F.col("id").alias("value"), F.col("name").alias("_name")), "value", "left")
    shown = F.when(F.col("field").isin("crawl", "crawl_id"), F.coalesce("_name", "value")).otherwise(F.col("value"))
    return named.select("place", "label", shown.alias("value"), "remove_query")


def page_of(q: str, totals: dict, offset: int = 0, size: int = PAGE) -> dict:
    """Where a page of results stands among all: numbers from 1."""
    return {"page": offset // size + 1, "total_pages": max(1, -(-totals["total_hits"] // size)), "total_hits": totals["total_hits"], "capped": totals["capped"], "query": q}
