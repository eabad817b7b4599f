"""CDX indexes as DataFrames: `{json}` or `key timestamp {json}` lines, numbers quoted or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "url string, timestamp string, mime string, status string, filename string, offset string, length string"


#: Archive files of one package up to which their places are sent to every task.
FEW = 10_000


def parse_cdx(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """url, ts, mime, status, filename, offset, length, and columns of lines to keep; lines without a url are dropped. All inside the JVM."""
    line = F.trim(F.col(column))
    brace = F.locate("{", line)
    parsed = lines.where(brace > 0).select(*keep, F.split(F.left(line, brace - 1), " ").alias("head"), F.from_json(F.substr(line, brace), RAW).alias("j"))
    number = lambda c, t="bigint": F.coalesce(F.col(f"j.{c}").try_cast(t), F.lit(0).cast(t))
    ts = F.coalesce(F.nullif(F.try_element_at("head", F.lit(2)), F.lit("")), "j.timestamp", F.lit(""))
    return parsed.where(F.coalesce("j.url", F.lit("")) != "").select(*keep, F.col("j.url").alias("url"), ts.alias("ts"), F.coalesce("j.mime", F.lit("")).alias("mime"), number("status", "int").alias("status"), F.coalesce("j.filename", F.lit("")).alias("filename"), number("offset").alias("offset"), number("length").alias("length"))


def read_cdx(spark: SparkSession, path: str) -> DataFrame:
    """Files, folders or patterns, gzip told by suffix."""
    return parse_cdx(spark.read.text(path))


def lookup(cdx: DataFrame, url: str) -> DataFrame:
    """Exact matches of a URL."""
    return cdx.where(F.col("url") == url)


def wanted(cdx: DataFrame) -> DataFrame:
    """What indexing fetches: rendered texts, pages and PDFs that have a length."""
    kind = F.lower("mime")
    return cdx.where((F.col("length") != 0) & (F.col("url").startswith("urn:text:") | kind.contains("html") | kind.contains("pdf")))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)


def with_places(cdx: DataFrame, starts: DataFrame, many: int | None = None) -> DataFrame:
    """Absolute place of each record inside its archive: starts has basename and start, a row for each inner file.

    many: the rows of starts, where known; few are broadcast, else Spark chooses by size.
    """
    side = F.broadcast(starts) if many is not None and many <= FEW else starts
    return cdx.withColumn("basename", basename("filename")).join(side, "basename").withColumn("at", F.col("start") + F.col("offset"))


def cdx_lines(records: DataFrame, filename: Column) -> DataFrame:
    """Sorted CDXJ lines of WARC records."""
    return unsorted_lines(records, filename).orderBy("line")


def unsorted_lines(records: DataFrame, filename: Column) -> DataFrame:
    """CDXJ lines of WARC records: requests, warcinfo and records without a URI are left out."""
    from webquarry.functions.scalars import surt

    keep = ~F.lower("warc_type").isin("request", "warcinfo") & (F.col("target_uri") != "")
    mime = F.nullif(F.trim(F.element_at(F.split("content_type", ";"), 1)), F.lit(""))
    digest = F.nullif(F.regexp_replace("digest", "^[^:]*:", ""), F.lit(""))
    body = F.to_json(F.struct(F.col("target_uri").alias("url"), mime.alias("mime"), F.col("http_status").cast("string").alias("status"), digest.alias("digest"), F.col("record_length").cast("string").alias("length"), F.col("offset").cast("string").alias("offset"), filename.alias("filename")))
    return records.where(keep).select(F.concat_ws(" ", surt("target_uri"), "timestamp", body).alias("line"))
