"""The engine's queries over the driver's tables, by name."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.functions import scalars as X
from webquarry.functions import langdetect, suffixes
from webquarry.operators import catalog, documents
from webquarry.plans import search as S
from webquarry.plans.textindex import TextIndex, all_postings, field_tokens
from webquarry.sources.files import scratch
from webquarry.sources.html import extracted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.captures(pages(spark, sf_dir))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.derive(captures(spark, sf_dir))


_BUILT: dict[tuple, TextIndex] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> TextIndex:
    """The index of a whole table, built at its first use in a session and read by all searches after that."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        root = f"{scratch(spark)}/webquarry-index-{uuid.uuid4().hex}"
        TextIndex.write(make(), root)
        _BUILT[key] = TextIndex.open(spark, root)
    return _BUILT[key]


def index(spark: SparkSession, sf_dir: str) -> TextIndex:
    return stored(spark, sf_dir, "pages", lambda: docs(spark, sf_dir))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a corpus of single-field pages."""
    blank = F.lit("")
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("page").alias("doc_type"), blank.alias("title"), blank.alias("headings"), F.coalesce("text", blank).alias("body"), blank.alias("description"), blank.alias("keywords"), blank.alias("author"), blank.alias("url_tokens"), "lang", F.col("source").alias("collection"))


def texts(spark: SparkSession, sf_dir: str) -> TextIndex:
    return stored(spark, sf_dir, "documents", lambda: corpus(spark, sf_dir))


# ---------------------------------------------------------------- SQL pieces

HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#]*([^?#]*)', 1)"
URL_TOKENS = f"array_to_string(list_concat([{HOST}], list_filter(string_split({PATH}, '/'), lambda x: x <> '')), ' ')"
STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
LANG = r"""lower(trim(regexp_split_to_array(regexp_extract(html, '(?is)<html[^>]*\slang=["'']?([A-Za-z0-9_-]+)', 1), '[-_]')[1]))"""
HEADINGS = r"array_to_string(list_transform(regexp_extract_all(html, '(?is)<h[12](?:\s[^>]*)?>(.*?)</h[12]>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), ' ')"
TOKENS = r"list_filter(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+'), lambda t: strlen(t) <= 40)"
SITE = f"regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1)"

CAP = f"""
cap AS (
  SELECT page_id * 4 + r AS doc_id, page_id, r AS repeat, left(sha256('crawl-' || (page_id % 7)), 8) AS crawl_id, 'Crawl ' || (page_id % 7) AS crawl_name,
         'col-' || (page_id % 7 % 3) AS collection, url, html,
         (2015 + (page_id + r) % 10)::VARCHAR || lpad((1 + (page_id * 7 + r) % 12)::VARCHAR, 2, '0') || lpad((1 + page_id % 28)::VARCHAR, 2, '0') || '120000' AS timestamp,
         CASE WHEN page_id % 7 = 3 THEN 'pdf' ELSE 'html' END AS type,
         CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 13 = 0 THEN 301 ELSE 200 END AS status,
         CASE WHEN page_id % 5 = 0 THEN 2010 + page_id % 12 END AS modified, length(html) AS bytes
  FROM pages, unnest(range(0, page_id % 3 + 1)) t(r)),
docs AS (
  SELECT *, 'page' AS doc_type, {TITLE} AS title, {STRIP} AS body, '' AS description, {HEADINGS} AS headings, '' AS keywords, '' AS author, {LANG} AS lang,
         {HOST} AS domain, {SITE} AS site, {URL_TOKENS} AS url_tokens, left(timestamp, 4)::INT AS year, left(timestamp, 6)::INT AS month FROM cap)
"""
FIELDS = ("title", "headings", "body", "description", "keywords", "author", "url_tokens")
BOOST = {"title": 3.0, "headings": 2.0}
TEXTS = "docs AS (SELECT doc_id, 'page' AS doc_type, '' AS title, '' AS headings, coalesce(text, '') AS body, '' AS description, '' AS keywords, '' AS author, '' AS url_tokens, lang, source AS collection FROM documents)"


def search_ctes(leaves: list[dict], where: str, corpus: str = CAP, boost: dict | None = None) -> str:
    """CTEs up to m: matching documents with their score. leaves: terms, fields, weight (0: an exclusion)."""
    boost = BOOST if boost is None else boost
    tok = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {TOKENS.format(f)} AS t FROM docs" for f in FIELDS)
    parts = []
    for i, leaf in enumerate(leaves):
        terms, fields = leaf["terms"], leaf.get("fields", FIELDS)
        if len(terms) > 1:
            fields = [f for f in fields if f not in ("headings", "url_tokens")]
            same = " AND ".join(f"t[i + {k}] = '{x}'" for k, x in enumerate(terms))
            tf = f"len(list_filter(range(1, len(t) + 1), lambda i: {same}))"
        else:
            tf = f"len(list_filter(t, lambda x: x = '{terms[0]}'))"
        names = ", ".join(f"'{f}'" for f in fields)
        weight = "CASE field " + " ".join(f"WHEN '{f}' THEN {boost.get(f, 1.0) * leaf.get('weight', 1.0)}" for f in fields) + " END"
        parts.append(f"SELECT * FROM (SELECT {i} AS leaf, field, doc_id, {tf} AS tf, len(t) AS n_tok, {weight}::DOUBLE AS w FROM tok WHERE field IN ({names})) WHERE tf > 0")
    flags = ", ".join(f"bool_or(leaf = {i}) AS l{i}" for i in range(len(leaves)))
    for i in range(len(leaves)):
        where = where.replace(f"@{i}", f"coalesce(l{i}, false)")
    return f"""
{corpus}, tok AS ({tok}),
st AS (SELECT field, count(*) AS n, avg(len(t)) AS a FROM tok GROUP BY field),
lf AS ({" UNION ALL ".join(parts)}),
df AS (SELECT leaf, field, count(*) AS df FROM lf GROUP BY leaf, field),
sc AS (
  SELECT doc_id, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tok / a))) AS score, {flags}
  FROM lf JOIN df USING (leaf, field) JOIN st USING (field) GROUP BY doc_id),
m AS (SELECT docs.*, coalesce(score, 0) AS score FROM docs LEFT JOIN sc USING (doc_id) WHERE {where})
"""


def hits_sql(leaves: list[dict], where: str, **more) -> str:
    return f"WITH {search_ctes(leaves, where, **more)} SELECT doc_id, round(score, 6) AS score FROM m"


def hits(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.round("score", 6).alias("score"))


FACETS_SQL = """
, u AS (
  SELECT 'collection' AS field, collection AS value FROM {0} UNION ALL SELECT 'year', year::VARCHAR FROM {0} UNION ALL SELECT 'site', site FROM {0}
  UNION ALL SELECT 'type', type FROM {0} UNION ALL SELECT 'lang', lang FROM {0}),
g AS (SELECT field, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY field, value QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 50)
SELECT field, value, n FROM g WHERE value <> ''
"""

# ---------------------------------------------------------------- scalars


@query(f"SELECT page_id, {HOST} AS domain, {SITE} AS site, {URL_TOKENS} AS url_tokens FROM pages")
def url_parts(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", X.host("url").alias("domain"), X.last_labels(X.host("url")).alias("site"), X.url_tokens("url").alias("url_tokens"))


@query(f"SELECT page_id, {SITE} AS site FROM pages")
def registrable_domains(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", suffixes.site(spark, X.host("url")).alias("site"))


@query()
def html_parsed(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", extracted("html").alias("p")).select("page_id", "p.title", "p.headings", "p.lang", "p.body")


@query()
def languages_guessed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", langdetect.detected("text").alias("lang"))


VARIED = "CASE page_id % 4 WHEN 0 THEN replace(url, '://', '://www.') WHEN 1 THEN replace(url, '://', '://www2.') WHEN 2 THEN 'urn:text:' || url ELSE regexp_replace(url, '^(https?://[^/]+)', '\\1:8080') || '?b=2&a=1' END"


@query(rf"""
WITH v AS (SELECT page_id, {VARIED} AS url FROM pages), b AS (SELECT *, regexp_replace(url, '^(https?://)www\d*\.', '\1') AS bare FROM v),
p AS (SELECT *, lower(bare) AS low FROM b),
q AS (SELECT *, regexp_extract(low, '^[a-z]+://([^/?#:]*)', 1) AS h, regexp_extract(low, '^[a-z]+://[^/?#:]*:(\d+)', 1) AS port,
             regexp_extract(low, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(low, '^[^?#]*\?([^#]*)', 1) AS qs FROM p)
SELECT page_id, CASE WHEN url NOT LIKE 'http%' THEN url ELSE array_to_string(list_reverse(string_split(h, '.')), ',') || CASE WHEN port = '' THEN '' ELSE ':' || port END || ')'
       || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN qs = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(qs, '&')), '&') END END AS surt FROM q""")
def surt_keys(spark, sf_dir):
    u, p = F.col("url"), F.col("page_id") % 4
    varied = F.when(p == 0, F.replace(u, F.lit("://"), F.lit("://www."))).when(p == 1, F.replace(u, F.lit("://"), F.lit("://www2."))).when(p == 2, F.concat(F.lit("urn:text:"), u)).otherwise(F.concat(F.regexp_replace(u, "^(https?://[^/]+)", "$1:8080"), F.lit("?b=2&a=1")))
    return pages(spark, sf_dir).select("page_id", X.surt(varied).alias("surt"))


@query(r"""
SELECT page_id, left(sha256(url), 8) AS crawl_id, left(sha256(url), 16) AS seed_id,
       CASE WHEN s = '' THEN left(sha256(t), 8) ELSE lower(s) END AS slug, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS component,
       coalesce(list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/'), lambda x: x <> '')[-1], url) AS pdf_title
FROM (SELECT page_id, url, t, regexp_replace(regexp_replace(t, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM (SELECT *, """ + TITLE + " AS t FROM pages))")
def names_and_ids(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", X.hash8("url").alias("crawl_id"), F.left(F.sha2(F.col("url").cast("binary"), 256), F.lit(16)).alias("seed_id"), X.slugify(X.html_title("html")).alias("slug"), X.safe_component("url").alias("component"), X.pdf_title("url").alias("pdf_title"))


@query("""
SELECT event_id, d AS digits, left(d, 4)::INT AS year, left(d, 6)::INT AS month, left(d, 4) || '-' || d[5:6] || '-' || d[7:8] AS ymd,
       left(d, 4) || '-' || d[5:6] || '-' || d[7:8] || 'T' || d[9:10] || ':' || d[11:12] || ':' || d[13:14] || 'Z' AS iso,
       left(d, 4) || '-' || d[5:6] || '-' || d[7:8] || ' ' || d[9:10] || ':' || d[11:12] AS minute,
       left(d, 4) || '-' || d[5:6] AS ym, left(d, 4) AS prefix
FROM (SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS d FROM events)""")
def time_parts(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", X.to_14_digits(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("d"))
    return d.select("event_id", F.col("d").alias("digits"), X.year_of("d").alias("year"), X.month_of("d").alias("month"), X.ymd("d").alias("ymd"), X.to_iso("d").alias("iso"), X.minute_of("d").alias("minute"), X.year_and_month(X.month_of("d")).alias("ym"), X.year_prefix("d").alias("prefix"))


@query(r"""
SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0)
         WHEN b < 1099511627776 THEN printf('%.1f GB', b / 1073741824.0) ELSE printf('%.1f TB', b / 1099511627776.0) END AS size,
       'Archived HTTP ' || c || CASE c WHEN 301 THEN ' Moved Permanently' WHEN 404 THEN ' Not Found' WHEN 503 THEN ' Service Unavailable' WHEN 200 THEN '' ELSE ' Gone' END AS status,
       CASE r WHEN 5 THEN 'Excellent' WHEN 4 THEN 'Good' WHEN 3 THEN 'Fair' WHEN 2 THEN 'Poor' WHEN 1 THEN 'Bad' ELSE 'Reviewed' END || ' (' || r || '/5)' AS review
FROM (SELECT doc_id, strlen(text)::BIGINT * (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1000000000 END)::BIGINT AS b, [200, 301, 404, 410, 503][doc_id % 5 + 1] AS c, doc_id % 6 AS r FROM documents)""")
def labels_and_sizes(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length("text").cast("bigint") * F.element_at(F.array(*[F.lit(x).cast("bigint") for x in (1, 1000, 10**6, 10**9)]), (i % 4 + 1).cast("int"))).alias("b"), F.element_at(F.array(*map(F.lit, (200, 301, 404, 410, 503))), (i % 5 + 1).cast("int")).alias("c"), (i % 6).alias("r"))
    return d.select("doc_id", X.human_size("b").alias("size"), X.status_label("c").alias("status"), X.review_label("r").alias("review"))


@query(rf"""
SELECT page_id, replace(replace(replace(replace({TITLE}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, url_encode(url || ' *~+') AS encoded,
       CASE WHEN length(f) > 300 THEN left(f, 300) || '…' ELSE f END AS excerpt, nullif(trim({HEADINGS}), '') AS cleaned FROM (SELECT *, {STRIP} AS f FROM pages)""")
def text_escapes(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", X.html_escape(X.html_title("html")).alias("escaped"), X.url_encode(F.concat("url", F.lit(" *~+"))).alias("encoded"), X.excerpt(X.tag_strip("html")).alias("excerpt"), X.clean(X.html_headings("html")).alias("cleaned"))


@query(f"SELECT page_id, {TITLE} AS title, {LANG} AS lang, {HEADINGS} AS headings FROM pages")
def html_fields(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", X.html_title("html").alias("title"), X.html_lang("html").alias("lang"), X.html_headings("html").alias("headings"))


@query(f"SELECT page_id, sha256({STRIP}) AS body FROM pages")
def html_body_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.sha2(X.tag_strip("html").cast("binary"), 256).alias("body"))


@query(r"""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 2000 + event_id % 25 END AS modified
FROM (SELECT event_id FROM events)""")
def modified_years(spark, sf_dir):
    i = F.col("event_id")
    header = F.when(i % 3 == 0, "yesterday").otherwise(F.concat(F.lit("Wed, 21 Oct "), (2000 + i % 25).cast("string"), F.lit(" 07:28:00 GMT")))
    return table(spark, sf_dir, "events").select("event_id", X.modified_year(header).alias("modified"))


@query("""
SELECT source, list_reduce(list_transform(string_split(source, ''), lambda c: ascii(c)::BIGINT), lambda a, b: (a * 31 + b) % 4294967296) % 360 AS hue
FROM (SELECT DISTINCT source FROM documents)""")
def placeholder_hues(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", X.placeholder_hue("source").alias("hue"))


# ---------------------------------------------------------------- documents


@query(f"WITH {CAP} SELECT doc_id, doc_type, crawl_id, collection, url, timestamp, title, sha256(body) AS body, headings, domain, site, url_tokens, year, month, type, lang, status, modified FROM docs")
def documents_derived(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "doc_type", "crawl_id", "collection", "url", "timestamp", "title", F.sha2(F.col("body").cast("binary"), 256).alias("body"), "headings", "domain", "site", "url_tokens", "year", "month", "type", "lang", "status", "modified")


@query(f"""
WITH {CAP}, rec AS (
  SELECT crawl_id, 'http://m.example.org/' || (page_id % 40) AS url, doc_id AS seq, CASE WHEN repeat = 2 THEN 'text' ELSE 'html' END AS kind, timestamp,
         CASE WHEN doc_id % 5 = 0 THEN '' ELSE title END AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE body END AS body, status FROM docs),
g AS (
  SELECT crawl_id, url, arg_max(title, seq) FILTER (WHERE kind = 'html' AND title <> '') AS ht, arg_max(body, seq) FILTER (WHERE kind = 'html' AND body <> '') AS hb,
         arg_max(timestamp, seq) FILTER (WHERE kind = 'html') AS hts, arg_min(timestamp, seq) FILTER (WHERE kind = 'text') AS tts,
         arg_min(title, seq) FILTER (WHERE kind = 'text' AND title <> '') AS tt, arg_max(body, seq) FILTER (WHERE kind = 'text' AND body <> '') AS tb,
         arg_max(status, seq) FILTER (WHERE kind = 'html') AS status
  FROM rec GROUP BY crawl_id, url)
SELECT crawl_id, url, coalesce(hts, tts) AS timestamp, coalesce(ht, tt, '') AS title, coalesce(tb, hb, '') AS body, status FROM g
WHERE coalesce(ht, tt, '') <> '' OR coalesce(tb, hb, '') <> ''""")
def merge_pages(spark, sf_dir):
    d = captures(spark, sf_dir)
    p, r = F.floor(F.col("doc_id") / 4), F.col("doc_id") % 4
    blank = F.lit("")
    rec = d.select("crawl_id", F.concat(F.lit("http://m.example.org/"), (p % 40).cast("string")).alias("url"), F.col("doc_id").alias("seq"), F.when(r == 2, "text").otherwise("html").alias("kind"), "timestamp", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("title")).alias("title"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("body")).alias("body"), blank.alias("description"), blank.alias("headings"), blank.alias("keywords"), blank.alias("author"), "lang", "media_type", "status", "modified")
    return documents.merge_pages(rec).select("crawl_id", "url", "timestamp", "title", "body", "status")


# ---------------------------------------------------------------- index


@query(f"WITH {TEXTS}, t AS (SELECT doc_id, unnest({TOKENS.format('body')}) AS term FROM docs) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term")
def term_stats(spark, sf_dir):
    return field_tokens(corpus(spark, sf_dir), ("body",)).select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


@query(f"WITH {TEXTS} SELECT doc_id, len({TOKENS.format('body')}) AS n FROM docs")
def doc_lengths(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.size(X.tokens("body")).alias("n"))


@query(f"WITH {CAP}, tok AS ({' UNION ALL '.join(f'''SELECT '{f}' AS field, len({TOKENS.format(f)}) AS n FROM docs''' for f in FIELDS)}) SELECT field, count(*) AS n_docs, round(avg(n), 6) AS avg_len FROM tok GROUP BY field")
def field_statistics(spark, sf_dir):
    """Of the pages themselves: a stored index would give seven sums that are known already."""
    return TextIndex.of(docs(spark, sf_dir)).stats.select("field", "n_docs", F.round("avg_len", 6).alias("avg_len"))


@query(f"""
WITH {CAP}, t AS (SELECT doc_id, {TOKENS.format('title')} AS t FROM docs), p AS (SELECT doc_id, t[i] AS term, i - 1 AS pos FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM t))
SELECT 'title' AS field, term, doc_id, count(*) AS tf, array_to_string(list_sort(list(pos)), ',') AS positions FROM p GROUP BY term, doc_id""")
def postings_of_titles(spark, sf_dir):
    d = docs(spark, sf_dir)
    return all_postings(d).where("field = 'title'").select("field", "term", "doc_id", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


# ---------------------------------------------------------------- searches

W = lambda *terms, **more: {"terms": terms, **more}


def search_query(name: str, q: str, leaves: list[dict], where: str, corpus: str = "pages") -> None:
    make = index if corpus == "pages" else texts
    cte = CAP if corpus == "pages" else TEXTS
    QUERIES[name] = lambda spark, sf_dir: hits(S.matched_ids(make(spark, sf_dir), q))
    ORACLE_SQL[name] = hits_sql(leaves, where, corpus=cte)


search_query("search_word", "the", [W("the")], "@0", "texts")
search_query("search_and", "the and", [W("the"), W("and")], "@0 AND @1", "texts")
search_query("search_or", "the OR para", [W("the"), W("para")], "@0 OR @1", "texts")
search_query("search_not", "the -with", [W("the"), W("with", weight=0.0)], "@0 AND NOT @1", "texts")
search_query("search_phrase", '"of the"', [W("of", "the")], "@0", "texts")
search_query("search_group", "(the OR der) in", [W("the"), W("der"), W("in")], "(@0 OR @1) AND @2", "texts")
search_query("search_boost", "the^2 and", [W("the", weight=2.0), W("and")], "@0 AND @1", "texts")
search_query("search_rare", "license mit", [W("license"), W("mit")], "@0 AND @1", "texts")
search_query("search_lang_filter", "de lang:fr", [W("de")], "@0 AND lang = 'fr'", "texts")
search_query("search_malformed", 'the "and', [W("the"), W("and")], "@0 AND @1", "texts")
search_query("search_field_title", "title:the", [W("the", fields=("title",))], "@0")
search_query("search_all_fields", "the en", [W("the"), W("en")], "@0 AND @1")
search_query("search_site_filter", "the site:example.com", [W("the")], "@0 AND site = 'example.com'")
CRAWL_3 = hashlib.sha256(b"crawl-3").hexdigest()[:8]
search_query("search_crawl_alias", f"the crawl:{CRAWL_3}", [W("the")], f"@0 AND crawl_id = '{CRAWL_3}'")
search_query("search_year_range", "the year:[2018 TO 2021]", [W("the")], "@0 AND year BETWEEN 2018 AND 2021")
search_query("search_open_range", "the year:{2018 TO *]", [W("the")], "@0 AND year > 2018")
search_query("search_status_range", "of status:[400 TO 499]", [W("of")], "@0 AND status BETWEEN 400 AND 499")
search_query("search_modified", "of modified:2015", [W("of")], "@0 AND modified = 2015")
search_query("search_either_filter", "type:pdf OR title:the", [W("the", fields=("title",))], "type = 'pdf' OR @0")


@query(f"WITH {CAP} SELECT doc_id, 0.0::DOUBLE AS score FROM docs WHERE month = 201801 OR lang = 'de'")
def filters_alone(spark, sf_dir):
    return hits(S.matches(index(spark, sf_dir), "month:201801 OR lang:de"))


COLLAPSE = """
, win AS (SELECT * FROM m ORDER BY round(score, 9) DESC, doc_id LIMIT 1000),
c AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY round(score, 9) DESC, doc_id) AS rk, count(*) OVER (PARTITION BY url) AS capture_count FROM win),
h AS (SELECT * FROM c WHERE rk = 1)
"""


def steady(found: DataFrame) -> DataFrame:
    """Scores rounded, so that sums taken in another order give the same ranks."""
    return found.withColumn("score", F.round("score", 9))


@query(f"WITH {search_ctes([W('the')], '@0')} {COLLAPSE} SELECT doc_id, url, capture_count, round(score, 6) AS score FROM h")
def collapse_urls(spark, sf_dir):
    found = S.collapse(S.candidates(steady(S.matches(index(spark, sf_dir), "the"))))
    return found.select("doc_id", "url", "capture_count", F.round("score", 6).alias("score"))


@query(f"WITH {search_ctes([W('the')], '@0')} {COLLAPSE} SELECT doc_id, url, capture_count FROM h ORDER BY round(score, 9) DESC, doc_id LIMIT 20 OFFSET 20")
def search_page2(spark, sf_dir):
    found = S.collapse(S.candidates(steady(S.matches(index(spark, sf_dir), "the"))))
    return found.orderBy(F.desc("score"), "doc_id").offset(20).limit(20).select("doc_id", "url", "capture_count")


@query(f"WITH {search_ctes([W('the')], '@0')} {COLLAPSE} SELECT (SELECT count(*) FROM h) AS total_hits, (SELECT count(*) FROM m) AS total_captures, (SELECT count(*) FROM m) > 1000 AS capped")
def search_totals(spark, sf_dir):
    m = S.matches(index(spark, sf_dir), "the")
    total = m.agg(F.count("*").alias("total_captures"))
    groups = S.collapse(S.candidates(steady(m))).agg(F.count("*").alias("total_hits"))
    return groups.join(F.broadcast(total)).select("total_hits", "total_captures", (F.col("total_captures") > S.CANDIDATES).alias("capped"))


@query()
def search_snippets(spark, sf_dir):
    return S.search(index(spark, sf_dir), "the of").hits.select("doc_id", "display_title", "snippet", "body_excerpt", "display_text", "capture_count")


@query(f"""
WITH {CAP}, w AS (SELECT * FROM docs WHERE collection = 'col-0' AND doc_type = 'page' ORDER BY doc_id LIMIT 25)
SELECT doc_id, url, timestamp, title, crawl_id FROM w""")
def page_listing(spark, sf_dir):
    return S.collection_pages(index(spark, sf_dir), "col-0").select("doc_id", "url", "timestamp", "title", "crawl_id")


@query(f"WITH {CAP} SELECT doc_id, url, status FROM docs WHERE collection = 'col-2' AND url = (SELECT url FROM pages WHERE page_id = 2)")
def resolve_url(spark, sf_dir):
    url = pages(spark, sf_dir).where("page_id = 2").first()["url"]
    return S.collection_pages(index(spark, sf_dir), "col-2", url=url).select("doc_id", "url", "status")


@query(f"WITH {search_ctes([W('the')], '@0', boost={})}, w AS (SELECT * FROM m WHERE collection = 'col-1' ORDER BY round(score, 9) DESC, doc_id LIMIT 25) SELECT doc_id, url, round(score, 6) AS score FROM w")
def page_search(spark, sf_dir):
    return S.collection_pages(index(spark, sf_dir), "col-1", q="the").select("doc_id", "url", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- facets


@query(f"WITH {CAP} {FACETS_SQL.format('docs')}")
def facets_all(spark, sf_dir):
    return S.facet_overview(index(spark, sf_dir).docs)


@query(f"WITH {CAP}, s AS (SELECT * FROM docs WHERE collection = 'col-1') {FACETS_SQL.format('s')}")
def facets_scoped(spark, sf_dir):
    return S.facet_overview(index(spark, sf_dir).docs, collection="col-1")


@query(f"WITH {search_ctes([W('the')], '@0')} {FACETS_SQL.format('m')}")
def facets_query(spark, sf_dir):
    return S.facets(S.matches(index(spark, sf_dir), "the"))


@query(f"WITH {CAP} SELECT month, count(*) AS n FROM docs WHERE month IS NOT NULL GROUP BY month ORDER BY n DESC, month LIMIT 120")
def timeline_months(spark, sf_dir):
    return S.timeline(index(spark, sf_dir).docs)


@query(f"WITH {search_ctes([W('the')], '@0')} SELECT month, count(*) AS n FROM m WHERE month IS NOT NULL GROUP BY month ORDER BY n DESC, month LIMIT 120")
def timeline_query(spark, sf_dir):
    return S.timeline(S.matches(index(spark, sf_dir), "the"))


@query(f"WITH {CAP}, g AS (SELECT year::VARCHAR AS value, count(*) AS n FROM docs GROUP BY year) SELECT 'year' AS field, value, n FROM g ORDER BY value::INT DESC LIMIT 8")
def facet_year_display(spark, sf_dir):
    return S.facet_display(S.facets(index(spark, sf_dir).docs), "year", 8)


# ---------------------------------------------------------------- catalogue

CRAWLS_SQL = f"""
{CAP}, crawls AS (
  SELECT crawl_id AS id, any_value(crawl_name) AS name, any_value(collection) AS collection, min(timestamp) AS capture_start, max(timestamp) AS capture_end, sum(bytes)::BIGINT AS bytes, count(*) AS page_count,
         CASE WHEN any_value(page_id % 7) % 2 = 0 THEN 'https://a.example.org/' || any_value(crawl_name) || '.wacz' ELSE 'archive/' || any_value(crawl_name) || '.wacz' END AS source,
         CASE any_value(page_id % 7) % 3 WHEN 0 THEN ['warcio', 'browser'] WHEN 1 THEN ['browser', 'crawler'] ELSE []::VARCHAR[] END AS software
  FROM cap GROUP BY crawl_id)
"""


def crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = captures(spark, sf_dir).groupBy(F.col("crawl_id").alias("id")).agg(F.first("crawl_name").alias("name"), F.first("collection").alias("collection"), F.min("timestamp").alias("capture_start"), F.max("timestamp").alias("capture_end"), F.sum("bytes").alias("bytes"), F.count("*").alias("page_count"))
    no = F.regexp_extract("name", r"(\d+)", 1).cast("int")
    source = F.when(no % 2 == 0, F.concat(F.lit("https://a.example.org/"), "name", F.lit(".wacz"))).otherwise(F.concat(F.lit("archive/"), "name", F.lit(".wacz")))
    soft = F.when(no % 3 == 0, F.array(F.lit("warcio"), F.lit("browser"))).when(no % 3 == 1, F.array(F.lit("browser"), F.lit("crawler"))).otherwise(F.array().cast("array<string>"))
    return c.withColumn("source", source).withColumn("software", soft)


@query(f"WITH {CAP} SELECT crawl_id, status, count(*) AS n FROM docs GROUP BY crawl_id, status")
def status_histogram(spark, sf_dir):
    return catalog.status_histogram(captures(spark, sf_dir), "crawl_id")


@query(f"WITH {CAP} SELECT collection, status, count(*) AS n FROM docs GROUP BY collection, status")
def merged_histograms(spark, sf_dir):
    c = captures(spark, sf_dir)
    maps = catalog.as_map(catalog.status_histogram(c, "collection", "crawl_id"), "collection", "crawl_id")
    return catalog.merged_histograms(maps, "collection")


@query(f"""
WITH {CAP}, h AS (SELECT crawl_id, status, count(*) AS n FROM docs GROUP BY crawl_id, status),
g AS (SELECT crawl_id, sum(n) AS total, sum(CASE WHEN status >= 200 AND status < 400 THEN n ELSE 0 END) AS ok,
             array_to_string(list(status || '×' || n ORDER BY n DESC, status) FILTER (WHERE status >= 400), ', ') AS bad FROM h GROUP BY crawl_id)
SELECT crawl_id, total || ' captures, ' || round(ok / total * 100)::INT || '% ok' || CASE WHEN bad IS NULL OR bad = '' THEN '' ELSE ' — ' || bad END AS quality FROM g""")
def capture_quality(spark, sf_dir):
    return catalog.capture_quality(catalog.status_histogram(captures(spark, sf_dir), "crawl_id"), "crawl_id")


@query(f"""
WITH {CAP}, g AS (SELECT crawl_id, min(timestamp) AS a, max(timestamp) AS b FROM docs GROUP BY crawl_id)
SELECT crawl_id, a AS capture_start, b AS capture_end, CASE WHEN left(a, 8) = left(b, 8) THEN '' ELSE left(a, 4) || '-' || a[5:6] || '-' || a[7:8] || ' → ' END || left(b, 4) || '-' || b[5:6] || '-' || b[7:8] AS capture_range FROM g""")
def capture_range(spark, sf_dir):
    return catalog.capture_range(captures(spark, sf_dir), "crawl_id")


@query(f"WITH {CRAWLS_SQL} SELECT collection, count(*) AS members, sum(bytes)::BIGINT AS bytes, bool_or(source NOT LIKE 'http%') AS has_local, bool_or(source LIKE 'http%') AS has_remote FROM crawls GROUP BY collection")
def collection_rollup(spark, sf_dir):
    return catalog.collection_rollup(crawls(spark, sf_dir))


@query(f"""
WITH {CRAWLS_SQL}, u AS (SELECT collection, id, unnest(range(1, len(software) + 1)) AS i, software FROM crawls), f AS (SELECT collection, software[i] AS s, min((id, i)) AS o FROM u GROUP BY collection, software[i])
SELECT collection, array_to_string(list(s ORDER BY o), '|') AS software FROM f GROUP BY collection""")
def software_union(spark, sf_dir):
    return catalog.software_union(crawls(spark, sf_dir), "collection").select("collection", F.array_join("software", "|").alias("software"))


@query(f"WITH {CRAWLS_SQL} SELECT collection, CASE WHEN min(left(capture_start, 4)) = max(left(capture_start, 4)) THEN min(left(capture_start, 4)) ELSE min(left(capture_start, 4)) || '–' || max(left(capture_start, 4)) END AS years FROM crawls GROUP BY collection")
def year_span(spark, sf_dir):
    return catalog.year_span(crawls(spark, sf_dir), "capture_start", "collection")


@query(f"WITH {CRAWLS_SQL} SELECT id, collection FROM crawls QUALIFY row_number() OVER (PARTITION BY collection ORDER BY id) <= 2")
def import_cap(spark, sf_dir):
    return catalog.capped_per_collection(crawls(spark, sf_dir), 2).select("id", "collection")


@query(f"WITH {CRAWLS_SQL} SELECT DISTINCT left(sha256('crawl-' || (page_id % 10)), 8) AS id FROM pages WHERE left(sha256('crawl-' || (page_id % 10)), 8) NOT IN (SELECT id FROM crawls)")
def not_imported(spark, sf_dir):
    plan = pages(spark, sf_dir).select(X.hash8(F.concat(F.lit("crawl-"), (F.col("page_id") % 10).cast("string"))).alias("id")).distinct()
    return catalog.not_imported(plan, crawls(spark, sf_dir), ["id"])


@query("SELECT coalesce(crawl, 0) AS crawl, array_to_string(list(filename ORDER BY filename), ',') AS files, sum(size)::BIGINT AS bytes FROM (SELECT CASE WHEN page_id % 9 = 0 THEN NULL ELSE page_id % 5 END AS crawl, 'f' || page_id AS filename, length(html) AS size FROM pages) GROUP BY 1")
def plan_crawls(spark, sf_dir):
    p = F.col("page_id")
    files = pages(spark, sf_dir).select(F.when(p % 9 != 0, p % 5).alias("crawl"), F.concat(F.lit("f"), p.cast("string")).alias("filename"), F.length("html").alias("size"))
    return catalog.plan_crawls(files).select("crawl", F.array_join("files", ",").alias("files"), "bytes")


@query("WITH f AS (SELECT page_id % 5 AS crawl, length(html) AS size FROM pages WHERE page_id % 5 < 4), j AS (SELECT DISTINCT page_id % 6 AS id FROM pages), s AS (SELECT crawl AS id, sum(size)::BIGINT AS bytes, count(*) AS files FROM f GROUP BY crawl) SELECT id, coalesce(bytes, 0) AS bytes, coalesce(files, 0) AS files FROM j LEFT JOIN s USING (id)")
def crawl_totals(spark, sf_dir):
    p = F.col("page_id")
    base = pages(spark, sf_dir)
    return catalog.crawl_totals(base.select((p % 6).alias("id")).distinct(), base.where(p % 5 < 4).select((p % 5).alias("crawl"), F.length("html").alias("size")))


@query(f"WITH {CRAWLS_SQL} SELECT doc_id, docs.crawl_id, source AS crawl_source, coalesce(crawls.name, docs.crawl_id) AS shown_crawl FROM docs LEFT JOIN crawls ON docs.crawl_id = crawls.id AND crawls.collection <> 'col-2'")
def hits_with_names(spark, sf_dir):
    return catalog.with_names(docs(spark, sf_dir).select("doc_id", "crawl_id"), crawls(spark, sf_dir).where("collection <> 'col-2'")).select("doc_id", "crawl_id", "crawl_source", "shown_crawl")


@query(f"WITH {CRAWLS_SQL} SELECT collection, 'Name of ' || collection AS collection_name, id FROM crawls")
def collection_members(spark, sf_dir):
    c = crawls(spark, sf_dir)
    cols = c.select(F.col("collection").alias("id"), F.concat(F.lit("Name of "), "collection").alias("name")).distinct()
    return catalog.members(cols, c.select("id", "collection")).select("collection", "collection_name", "id")


@query(f"""
WITH {CRAWLS_SQL} SELECT id, CASE WHEN len(software) > 0 THEN 'Software: ' || array_to_string(software, ', ') || ' · ' ELSE '' END || page_count || CASE WHEN page_count = 1 THEN ' page' ELSE ' pages' END || ' · '
  || CASE WHEN left(capture_start, 8) = left(capture_end, 8) THEN '' ELSE left(capture_start, 4) || '-' || capture_start[5:6] || '-' || capture_start[7:8] || ' → ' END || left(capture_end, 4) || '-' || capture_end[5:6] || '-' || capture_end[7:8] AS provenance FROM crawls""")
def crawl_provenance(spark, sf_dir):
    return catalog.provenance(crawls(spark, sf_dir))


@query(f"WITH {CRAWLS_SQL} SELECT id, name, collection, collection AS collection_name, left(capture_start, 4) || '-' || capture_start[5:6] || '-' || capture_start[7:8] AS date, bytes FROM crawls")
def crawl_listing(spark, sf_dir):
    c = crawls(spark, sf_dir).withColumn("crawl_date", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "id string, name string")
    return catalog.listing(c, none)


@query(f"""
WITH {CAP}, u AS (SELECT 'url' AS field, url AS v FROM docs UNION ALL SELECT 'title', title FROM docs UNION ALL SELECT 'body', body FROM docs UNION ALL SELECT 'keywords', keywords FROM docs)
SELECT field, sum(strlen(v))::BIGINT AS bytes, count(*) FILTER (WHERE v <> '') AS filled FROM u GROUP BY field""")
def field_sizes(spark, sf_dir):
    return catalog.field_sizes(docs(spark, sf_dir), ["url", "title", "body", "keywords"])


@query(f"WITH {CAP} SELECT crawl_id, doc_id AS seq, bytes AS length FROM cap WHERE page_id % 3 > 0 AND page_id % 5 > 0 AND bytes BETWEEN 5000 AND 3000000 QUALIFY row_number() OVER (PARTITION BY crawl_id ORDER BY bytes DESC, doc_id) = 1")
def largest_image(spark, sf_dir):
    p = F.floor(F.col("doc_id") / 4)
    rec = captures(spark, sf_dir).select("crawl_id", F.col("doc_id").alias("seq"), F.when(p % 3 == 0, "text/html").when(p % 5 == 0, "image/svg+xml").otherwise("image/png").alias("mime"), F.col("bytes").alias("length"))
    return catalog.largest_image(rec, "crawl_id").select("crawl_id", "seq", "length")


@query("SELECT page_id, page_id % 4 NOT IN (1, 2) AS importable, CASE WHEN page_id % 6 = 0 THEN FALSE ELSE page_id % 6 >= 3 END AS passes FROM pages")
def review_and_job_filters(spark, sf_dir):
    p = F.col("page_id")
    jobs = pages(spark, sf_dir).select("page_id", F.when(p % 4 == 1, "DELETED").otherwise("SAVED").alias("test_crawl_state"), F.when(p % 4 == 2, "TEST_DELETED").otherwise("ANNUAL").alias("type"), F.when(p % 4 == 3, "FINISHED_TIME_LIMIT").alias("status"), F.when(p % 6 > 0, p % 6).alias("review"))
    return jobs.select("page_id", catalog.importable(jobs).alias("importable"), catalog.reviewed(F.col("review"), least=3).alias("passes"))


@query("""
WITH o AS (SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'old' || page_id END AS title, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'c' END AS creator FROM pages),
n AS (SELECT page_id AS id, 'new' || page_id AS title, CASE WHEN page_id % 5 = 0 THEN ' ' ELSE 'd' END AS creator FROM pages WHERE page_id % 4 < 3)
SELECT id, coalesce(nullif(trim(o.title), ''), nullif(trim(n.title), '')) AS title, coalesce(nullif(trim(o.creator), ''), nullif(trim(n.creator), '')) AS creator FROM o FULL JOIN n USING (id)""")
def fill_gaps(spark, sf_dir):
    p = F.col("page_id")
    base = pages(spark, sf_dir)
    old = base.select(p.alias("id"), F.when(p % 2 == 0, "").otherwise(F.concat(F.lit("old"), p.cast("string"))).alias("title"), F.when(p % 3 != 0, "c").alias("creator"))
    new = base.where(p % 4 < 3).select(p.alias("id"), F.concat(F.lit("new"), p.cast("string")).alias("title"), F.when(p % 5 == 0, " ").otherwise("d").alias("creator"))
    return catalog.fill_gaps(old, new)


@query(f"""WITH {CRAWLS_SQL},
r AS (SELECT collection, id, '{{"crawlId":"' || id || '","name":"' || name || '.wacz","path":"' || source || '","hash":"sha256:' || sha256(id) || '","size":' || bytes || '}}' AS item FROM crawls)
SELECT collection AS id, '{{"id":"' || collection || '","name":"' || collection || '","resources":[' || string_agg(item, ',' ORDER BY id) || ']}}' AS manifest FROM r GROUP BY collection""")
def replay_manifest(spark, sf_dir):
    """The manifest's JSON, letter by letter."""
    c = crawls(spark, sf_dir).withColumn("sha256", F.sha2(F.col("id").cast("binary"), 256)).withColumn("importer_hash", F.lit(None).cast("string"))
    cols = c.select(F.col("collection").alias("id"), F.col("collection").alias("name")).distinct()
    return catalog.replay_manifest(cols, c)


@query(f"""WITH {CRAWLS_SQL}
SELECT 'page' AS doc_type, crawl_id, title, description, sha256(body) AS body, count(*) AS n FROM docs GROUP BY ALL
UNION ALL SELECT 'collection', id, name, 'about', sha256('about X http://x/'), 1 FROM crawls""")
def page_and_collection_documents(spark, sf_dir):
    c = crawls(spark, sf_dir).select("*", F.lit(0).cast("bigint").alias("doc_id"), F.lit("").alias("created"), F.lit("about").alias("description"), F.array(F.struct(F.lit("http://x/").alias("url"), F.lit("X").alias("title"))).alias("seed_pages"))
    both = docs(spark, sf_dir).unionByName(documents.collection_documents(c))
    return both.groupBy("doc_type", "crawl_id", "title", "description", F.sha2(F.col("body").cast("binary"), 256).alias("body")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- events (an extension)


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_daily(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "total")
