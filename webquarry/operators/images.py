"""Which captured image stands for a crawl: candidates of its main page, ranked and joined with the capture index."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.functions import suffixes
from webquarry.functions.scalars import host
from webquarry.operators.catalog import largest_image

#: Ranks of what a candidate is: the curator's pin, then rendered pictures, the declared image, images of the page, of the site.
RANKS = {"pinned": 0, "thumbnail": 1, "view": 2, "declared": 3, "embedded": 4, "site": 5}
EMBEDDED = 120


class _Images(HTMLParser):
    def __init__(self):
        super().__init__()
        self.declared: dict[str, str] = {}
        self.embedded: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = a.get("property") or a.get("name")
            if name in ("og:image", "twitter:image") and a.get("content", "").strip():
                self.declared.setdefault(name, a["content"].strip())
        elif tag == "img":
            first = a.get("srcset", "").split(",")[0].split()
            if src := a.get("src") or (first[0] if first else None):
                self.embedded.append(src)


def absolute(base: str, ref: str) -> str | None:
    """A reference against its page; None where either is no URL."""
    try:
        out = urljoin(base, ref.strip())
        return out if urlsplit(out).scheme else None
    except ValueError:
        return None


def candidates_of(url: str, html: str) -> list[tuple[str, int, str]]:
    """(kind, order, url) of what could show a page; order tells ties apart."""
    url = url.strip()
    slash = url[:-1] if url.endswith("/") else url + "/"
    out = [(kind, i, f"urn:{kind}:{u}") for kind in ("thumbnail", "view") for i, u in enumerate((url, slash))]
    parser = _Images()
    parser.feed(html or "")
    declared = parser.declared.get("og:image") or parser.declared.get("twitter:image")
    found = [("declared", 0, absolute(url, declared) if declared else None)]
    found += [("embedded", i, absolute(url, x)) for i, x in enumerate(parser.embedded[:EMBEDDED])]
    return out + [f for f in found if f[2]]


def candidates(pages: DataFrame) -> DataFrame:
    """id, kind, nth, image_url for pages (id, url, html)."""

    @F.pandas_udf("array<struct<kind:string,nth:int,image_url:string>>")
    def run(url: pd.Series, html: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "nth": n, "image_url": x} for k, n, x in candidates_of(u or "", h)] for u, h in zip(url, html, strict=True)])

    return pages.select("id", F.explode(run("url", "html")).alias("c")).select("id", "c.*")


def is_raster() -> Column:
    return (F.col("length") != 0) & F.col("mime").contains("image") & ~F.col("mime").contains("svg")


def chosen(pages: DataFrame, cdx: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """One row for each page that has an image: id, kind, image_url, length.

    pages: id, url, html of each crawl's main page; cdx: id, seq, url, mime, length of its captures; pinned: id, image_url.
    Candidates meet captures by URL, the first raster capture of a URL counts. Embedded images and, last, any image of the
    page's own site must have a useful size, and the largest wins; other kinds go by rank.
    """
    raster = cdx.where(is_raster())
    first = raster.groupBy("id", "url").agg(F.min_by("length", "seq").alias("length"), F.min("seq").alias("seq"), F.min_by("mime", "seq").alias("mime"))
    met = candidates(pages).join(first.withColumnRenamed("url", "image_url"), ["id", "image_url"])
    plain = met.where(F.col("kind") != "embedded").select("id", "kind", "nth", "image_url", "length")
    seen = largest_image(met.where(F.col("kind") == "embedded").drop("seq").withColumnRenamed("nth", "seq"), "id").select("id", "kind", F.col("seq").alias("nth"), "image_url", "length")
    spark = pages.sparkSession
    sites = pages.select("id", suffixes.site(spark, host("url")).alias("site")).where("site <> ''")
    own = raster.withColumn("site", suffixes.site(spark, host("url"))).join(sites, ["id", "site"])
    site = largest_image(own, "id").select("id", F.lit("site").alias("kind"), F.lit(0).alias("nth"), F.col("url").alias("image_url"), "length")
    every = plain.unionByName(seen).unionByName(site)
    if pinned is not None:
        every = every.unionByName(pinned.select("id", F.lit("pinned").alias("kind"), F.lit(0).alias("nth"), "image_url", F.lit(0).cast("bigint").alias("length")))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.col("kind"))
    best = every.groupBy("id").agg(F.min_by(F.struct("kind", "image_url", "length"), F.struct(rank.alias("r"), F.col("nth"))).alias("b"))
    return best.select("id", "b.kind", "b.image_url", "b.length")
