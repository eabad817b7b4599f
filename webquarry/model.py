"""Schemas of the engine's tables, and the guard that refuses a table of another version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TEXT_FIELDS = ("title", "headings", "body", "description", "keywords", "author", "url_tokens")
#: Fields whose postings hold positions, so that phrases work on them.
POSITIONAL = ("title", "body", "description", "keywords", "author")
#: Weight of a match in each field.
BOOSTS = {"title": 3.0, "headings": 2.0}

_ATOMS = {"string": T.StringType, "int": T.IntegerType, "bigint": T.LongType, "binary": T.BinaryType}


def _type(spec: str) -> T.DataType:
    if spec.startswith("array<"):
        return T.ArrayType(_type(spec[6:-1]))
    if spec.startswith("map<"):
        key, value = _split(spec[4:-1])
        return T.MapType(_type(key), _type(value))
    if spec.startswith("struct<"):
        return T.StructType([T.StructField(n, _type(t)) for n, _, t in (p.partition(":") for p in _split(spec[7:-1]))])
    return _ATOMS[spec]()


def _split(spec: str) -> list[str]:
    """At commas outside of brackets."""
    out, depth = [""], 0
    for c in spec:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _struct(spec: str) -> T.StructType:
    """A schema from `name type, ...`, without a running session."""
    return T.StructType([T.StructField(n, _type(t)) for n, _, t in (p.partition(" ") for p in _split(spec))])


DOCUMENT = _struct(
    "doc_id bigint, doc_type string, crawl_id string, crawl_name string, collection string, url string, timestamp string, title string, "
    "body string, body_snip string, description string, headings string, keywords string, author string, domain string, site string, "
    "url_tokens string, year int, month int, type string, lang string, status int, modified int"
)
WARC_RECORD = _struct(
    "record_id string, concurrent_to string, target_uri string, timestamp string, warc_type string, http_status int, content_type string, "
    "digest string, payload binary, http_headers array<struct<name:string,value:string>>, offset bigint, record_length bigint"
)
WARCINFO = _struct("software string, operator string, user_agent string, is_part_of string, conforms_to string, robots string, hostname string")
CDX = _struct("url string, ts string, mime string, status int, filename string, offset bigint, length bigint")
PAGE_TEXT = _struct("url string, ts string, title string, text string")
RAW_RECORD = _struct(
    "kind string, url string, timestamp string, title string, body string, description string, headings string, keywords string, author string, "
    "lang string, og_image string, media_type string, status int, modified int"
)
CRAWL = _struct(
    "id string, name string, collection string, source string, title string, description string, created string, modified string, software array<string>, "
    "main_page_url string, keywords array<string>, licenses array<string>, creator string, seed_pages array<struct<url:string,title:string,ts:string>>, "
    "sha256 string, bytes bigint, page_count bigint, date_indexed string, capture_start string, capture_end string, warcinfo struct<software:string,operator:string,user_agent:string,is_part_of:string,conforms_to:string,robots:string,hostname:string>, "
    "crawl_date string, review int, importer string, importer_item string, importer_hash string, status_counts map<int,bigint>"
)
COLLECTION = _struct("id string, name string, description string, created string, curator string, creator string, dates string, rights string, subjects array<string>, narrative string")


class SchemaMismatch(ValueError):
    """A stored table has another schema than this version writes: it must be rebuilt."""


def guard(df: DataFrame, schema: T.StructType) -> DataFrame:
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    want = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    if sorted(have) != sorted(want):
        raise SchemaMismatch(f"stored table differs from this version's schema and must be rebuilt: {sorted(set(have) ^ set(want))}")
    return df.select([n for n, _ in want])
