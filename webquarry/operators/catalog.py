"""The two-level catalogue, collections over crawls, as tables: roll-ups, joins and merge policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webquarry.functions import scalars as X
from webquarry.sources.locations import parsed


def status_histogram(records: DataFrame, *by: str) -> DataFrame:
    """status, n (and the grouping columns): statuses of all records, 0 and null ignored."""
    return records.where(F.coalesce("status", F.lit(0)) != 0).groupBy(*by, "status").agg(F.count("*").alias("n"))


def as_map(histogram: DataFrame, *by: str) -> DataFrame:
    """The histogram of each group as a map in order of status; at most one entry for each code."""
    return histogram.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("status").cast("int"), F.col("n").cast("bigint"))))).alias("status_counts"))


def merged_histograms(crawls: DataFrame, *by: str) -> DataFrame:
    """Sum of the crawls' status maps in each group."""
    return crawls.select(*by, F.explode("status_counts").alias("status", "n")).groupBy(*by, "status").agg(F.sum("n").alias("n"))


def capture_quality(histogram: DataFrame, *by: str) -> DataFrame:
    """`N captures, P% ok — 404×n, ...`: share of 2xx and 3xx, and the four most frequent codes from 400 on."""
    bad = F.collect_list(F.when(F.col("status") >= 400, F.struct((-F.col("n")).alias("m"), F.col("status").alias("c"))))
    ok = F.sum(F.when((F.col("status") >= 200) & (F.col("status") < 400), F.col("n")).otherwise(0))
    g = histogram.groupBy(*by).agg(F.sum("n").alias("total"), ok.alias("ok"), F.slice(F.sort_array(bad), 1, 4).alias("bad"))
    text = F.concat(F.col("total").cast("string"), F.lit(" captures, "), F.round(F.col("ok") / F.col("total") * 100).cast("int").cast("string"), F.lit("% ok"))
    codes = F.array_join(F.transform("bad", lambda x: F.concat(x["c"].cast("string"), F.lit("×"), (-x["m"]).cast("string"))), ", ")
    return g.select(*by, F.when(F.size("bad") > 0, F.concat(text, F.lit(" — "), codes)).otherwise(text).alias("quality"))


def capture_range(records: DataFrame, *by: str, ts: str = "timestamp") -> DataFrame:
    """Earliest and latest capture, and the two as text. Times are brought to 14 digits first."""
    t = F.nullif(X.to_14_digits(ts), F.lit(""))
    g = records.groupBy(*by).agg(F.min(t).alias("capture_start"), F.max(t).alias("capture_end"))
    return g.withColumn("capture_range", X.date_range("capture_start", "capture_end"))


def software_union(crawls: DataFrame, *by: str, order: str = "id") -> DataFrame:
    """Distinct software of each group in order of first appearance."""
    rows = crawls.select(*by, F.col(order).alias("_o"), F.posexplode("software").alias("_p", "_s"))
    first = rows.groupBy(*by, "_s").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    return first.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_s"))), lambda x: x["_s"]).alias("software"))


def is_remote(source: Column | str) -> Column:
    """URLs and items of either service; all else is a file of this machine."""
    return parsed(source)["kind"] != "file"


def collection_rollup(crawls: DataFrame) -> DataFrame:
    """Members, bytes and whether any is local or remote, for each collection."""
    return crawls.groupBy("collection").agg(F.count("*").alias("members"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), F.max(~is_remote("source")).alias("has_local"), F.max(is_remote("source")).alias("has_remote"))


def year_span(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """`min–max` of the years that a column starts with."""
    y = X.year_prefix(column)
    g = rows.groupBy(*by).agg(F.min(y).alias("lo"), F.max(y).alias("hi"))
    return g.select(*by, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.concat("lo", F.lit("–"), "hi")).alias("years"))


def capped_per_collection(crawls: DataFrame, most: int, collection: str = "collection", order: str = "id") -> DataFrame:
    """The first `most` crawls of each collection."""
    w = Window.partitionBy(collection).orderBy(order)
    return crawls.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def plan_crawls(files: DataFrame) -> DataFrame:
    """Files by crawl, those without one under 0."""
    return files.groupBy(F.coalesce("crawl", F.lit(0)).alias("crawl")).agg(F.sort_array(F.collect_list("filename")).alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


def crawl_totals(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs with the number and size of their files, 0 without any."""
    sums = files.groupBy(F.col("crawl").alias("id")).agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))
    return jobs.join(sums, "id", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0))).withColumn("files", F.coalesce("files", F.lit(0)))


def with_names(hits: DataFrame, crawls: DataFrame) -> DataFrame:
    """Hits with their crawl's source and collection name, the ids where the catalogue has none."""
    side = crawls.select(F.col("id").alias("crawl_id"), F.col("source").alias("crawl_source"), F.col("name").alias("catalogue_name"))
    return hits.join(side, "crawl_id", "left").withColumn("shown_crawl", F.coalesce("catalogue_name", "crawl_id")).drop("catalogue_name")


def members(collections: DataFrame, crawls: DataFrame) -> DataFrame:
    return collections.select(F.col("id").alias("collection"), F.col("name").alias("collection_name")).join(crawls, "collection")


def not_imported(plan: DataFrame, crawls: DataFrame, keys: list[str]) -> DataFrame:
    return plan.join(crawls.select(*keys).distinct(), keys, "left_anti")


def imported_items(crawls: DataFrame) -> DataFrame:
    """item: service items that are in, by either trace: the source that a crawl is streamed from, or its recorded provenance."""
    streamed = crawls.select(parsed("source")["item"].alias("item"))
    return streamed.union(crawls.select("importer_item")).where("item is not null").distinct()


def shared_sources(crawls: DataFrame) -> DataFrame:
    """Crawls whose file another crawl uses too: it must outlive either."""
    return crawls.join(crawls.groupBy("source").agg(F.count("*").alias("_n")).where("_n > 1"), "source", "left_semi")


def importable(jobs: DataFrame) -> Column:
    """Finished and not deleted; a job without a status counts as finished."""
    gone = (F.coalesce("test_crawl_state", F.lit("")) == "DELETED") | F.coalesce("type", F.lit("")).endswith("_DELETED")
    return ~gone & F.coalesce("status", F.lit("FINISHED")).startswith("FINISHED")


def reviewed(rating: Column, include_unreviewed: bool = False, least: int | None = None) -> Column:
    """Whether a crawl's review lets it pass: only reviewed ones unless told otherwise, from a rating on."""
    ok = F.lit(True) if least is None else rating >= least
    return F.when(rating.isNull(), F.lit(include_unreviewed)).otherwise(ok)


def fill_gaps(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of old, blanks filled from new; rows only new has are added."""
    return _merge(old, new, key, prefer_new=False)


def overwrite(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of old with whatever new sets."""
    return _merge(old, new, key, prefer_new=True)


def _merge(old: DataFrame, new: DataFrame, key: str, prefer_new: bool) -> DataFrame:
    o, n = old.alias("o"), new.alias("n")
    kinds = dict(old.dtypes)
    value = lambda side, c: F.when(F.trim(F.col(f"{side}.{c}")) != "", F.col(f"{side}.{c}")) if kinds[c] == "string" else F.col(f"{side}.{c}")
    pick = [F.coalesce(*[value(s, c) for s in (("n", "o") if prefer_new else ("o", "n"))]).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in old.columns if c != key]
    return o.join(n, key, "full").select(key, *pick).select(old.columns)


def provenance(crawls: DataFrame) -> DataFrame:
    """`Software: X · N pages · dates` of each crawl, null where nothing is known."""
    soft = F.when(F.size("software") > 0, F.concat(F.lit("Software: "), F.array_join("software", ", ")))
    pages = F.when(F.col("page_count").isNotNull(), F.concat(F.col("page_count").cast("string"), F.when(F.col("page_count") == 1, " page").otherwise(" pages")))
    text = F.concat_ws(" · ", soft, pages, X.date_range("capture_start", "capture_end"))
    return crawls.select("id", F.nullif(text, F.lit("")).alias("provenance"))


def largest_image(records: DataFrame, *by: str, low: int = 5_000, high: int = 3_000_000) -> DataFrame:
    """The largest raster image of each group inside a window of sizes; the first of equals."""
    raster = F.col("mime").contains("image") & ~F.col("mime").contains("svg") & F.col("length").between(low, high)
    w = Window.partitionBy(*by).orderBy(F.desc("length"), "seq")
    return records.where(raster).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def field_sizes(docs: DataFrame, fields: list[str], first: int | None = None) -> DataFrame:
    """Bytes and non-empty values of each stored field, largest first; of the first documents by id only, if a number is given."""
    docs = docs if first is None else docs.orderBy("doc_id").limit(first)
    aggs = [a for f in fields for a in (F.sum(F.octet_length(F.coalesce(f, F.lit("")))).alias(f"b_{f}"), F.count_if(F.coalesce(F.col(f), F.lit("")) != "").alias(f"n_{f}"))]
    one = docs.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b_{f}").alias("bytes"), F.col(f"n_{f}").alias("filled")) for f in fields]))
    return one.select(rows.alias("r")).select("r.*").orderBy(F.desc("bytes"), "field")


def listing(crawls: DataFrame, collections: DataFrame) -> DataFrame:
    """Flat list of crawls with collection names; date: crawl date, else start of captures, 10 characters."""
    names = collections.select(F.col("id").alias("collection"), F.col("name").alias("collection_name"))
    return crawls.join(names, "collection", "left").select("id", "name", "collection", F.coalesce("collection_name", "collection").alias("collection_name"), F.left(F.coalesce("crawl_date", X.ymd("capture_start")), F.lit(10)).alias("date"), "bytes")


def replay_manifest(collections: DataFrame, crawls: DataFrame) -> DataFrame:
    """For each collection with members: id, name and resources as JSON; a resource without a hash omits it."""
    given = F.when(F.col("importer_hash").contains(":"), F.lower("importer_hash")).otherwise(F.concat(F.lit("sha256:"), F.lower("importer_hash")))
    digest = F.coalesce(F.when(F.coalesce("sha256", F.lit("")) != "", F.concat(F.lit("sha256:"), F.col("sha256"))), F.when(F.coalesce("importer_hash", F.lit("")) != "", given))
    item = F.struct(F.col("id").alias("crawlId"), F.concat(X.source_name("source"), F.lit(".wacz")).alias("name"), F.col("source").alias("path"), digest.alias("hash"), F.col("bytes").alias("size"))
    listed = crawls.withColumn("item", item).groupBy(F.col("collection").alias("id")).agg(F.sort_array(F.collect_list("item")).alias("resources"))
    return collections.select("id", "name").join(listed, "id").select("id", F.to_json(F.struct("id", "name", "resources")).alias("manifest"))


# ---------------------------------------------------------------- what pages about the catalogue show


def viewer_source(id_: Column | str, source: Column | str) -> Column:
    """Where a viewer reads a crawl: a URL as it is, all else through the file route."""
    source = F.col(source) if isinstance(source, str) else source
    return F.when(parsed(source)["kind"] == "url", source).otherwise(F.concat(F.lit("/files/"), id_))


def landing_pages(crawls: DataFrame, order: str = "id") -> DataFrame:
    """collection, page_url, page_ts: the first seed page of the first crawl of a collection that has one."""
    seeded = crawls.where(F.size(F.coalesce("seed_pages", F.array().cast("array<struct<url:string,title:string,ts:string>>"))) > 0)
    first = seeded.groupBy("collection").agg(F.min_by(F.element_at("seed_pages", 1), order).alias("_p"))
    return first.select("collection", F.col("_p.url").alias("page_url"), F.coalesce(X.to_14_digits("_p.ts"), F.lit("")).alias("page_ts"))


def collection_cards(collections: DataFrame, crawls: DataFrame, order: str = "id") -> DataFrame:
    """One row per collection, empty ones too: members, sizes, kinds of sources, dates of captures and its replay link."""
    spans = capture_range(crawls.select("collection", F.explode(F.array("capture_start", "capture_end")).alias("timestamp")), "collection").select("collection", "capture_range")
    facts = collection_rollup(crawls).join(spans, "collection", "left").join(landing_pages(crawls, order), "collection", "left").withColumnRenamed("collection", "id")
    c = collections.select("id", "name", "description").join(facts, "id", "left")
    given = {"source": F.concat(F.lit("/collection/"), "id", F.lit("/replay.json")), "coll": F.col("id"), "name": F.col("name"), "collection": F.col("name"), "collection_id": F.col("id")}
    query = F.concat_ws("&", *[F.concat(F.lit(f"{k}="), X.url_encode(v)) for k, v in given.items()])
    page = F.when(F.col("page_url").isNotNull(), F.concat(F.lit("&url="), X.url_encode(F.col("page_url")), F.lit("&ts="), X.url_encode(F.col("page_ts")))).otherwise("")
    none = lambda name, value: F.coalesce(name, F.lit(value)).alias(name)
    return c.select("id", "name", "description", none("members", 0), none("bytes", 0), none("has_local", False), none("has_remote", False), "capture_range", F.concat(F.lit("/replay/viewer?"), query, page).alias("replay_href"))


def crawl_view(crawls: DataFrame, collections: DataFrame) -> DataFrame:
    """One row per crawl with all that its page shows: names, dates, provenance, review, viewer source."""
    names = collections.select(F.col("id").alias("collection"), F.col("name").alias("collection_name"))
    c = crawls.join(names, "collection", "left").join(provenance(crawls), "id", "left")
    review = F.when(F.col("review").isNotNull(), X.review_label("review"))
    return c.select("id", "name", "collection", F.coalesce("collection_name", "collection").alias("collection_name"), "bytes", X.human_size("bytes").alias("size_text"), X.date_range("capture_start", "capture_end").alias("capture_range"), "provenance", review.alias("review_text"), is_remote("source").alias("remote"), viewer_source("id", "source").alias("viewer_source"))
