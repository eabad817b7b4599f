"""Scalar functions as Column expressions: URLs, times, names, labels. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def either(*options: tuple[Column, Column | str], otherwise: Column | str) -> Column:
    """CASE over (condition, value) pairs."""
    out = None
    for when, value in options:
        out = F.when(when, value) if out is None else out.when(when, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


# ---------------------------------------------------------------- URLs


def host(url: Column | str) -> Column:
    """Lower-cased host; empty where there is none."""
    return F.lower(F.regexp_extract(_c(url), AUTHORITY + r"([^/?#:]*)", 1))


def path(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), AUTHORITY + r"[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column | str) -> Column:
    """Host and non-empty path segments, joined by spaces."""
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    return F.when(host(url) == "", "").otherwise(F.concat_ws(" ", host(url), segments))


def last_labels(h: Column | str, n: int = 2) -> Column:
    """The last n labels of a host."""
    return F.regexp_extract(_c(h), r"((?:[^.]+\.){%d}[^.]+)$" % (n - 1), 1)


def surt(url: Column | str) -> Column:
    """Sort-friendly key of an http(s) URL; other schemes stay as they are."""
    url = _c(url)
    bare = F.regexp_replace(url, r"^(https?://)www\d*\.", "$1")
    low = F.lower(bare)
    name = F.regexp_extract(low, AUTHORITY + r"([^/?#:]*)", 1)
    port = F.regexp_extract(low, AUTHORITY + r"[^/?#:]*:(\d+)", 1)
    usual = ((port == "80") & low.startswith("http:")) | ((port == "443") & low.startswith("https:"))
    rest = F.regexp_extract(low, AUTHORITY + r"[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(low, r"^[^?#]*\?([^#]*)", 1)
    key = F.concat(
        F.array_join(F.reverse(F.split(name, r"\.")), ","),
        F.when((port == "") | usual, "").otherwise(F.concat(F.lit(":"), port)),
        F.lit(")"),
        F.when(rest == "", "/").otherwise(rest),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))),
    )
    web = url.startswith("http:") | url.startswith("https:")
    return F.when(~web, url).when(name == "", bare).otherwise(key)


def pdf_title(url: Column | str) -> Column:
    """Last non-empty path segment before ? or #; the URL itself without one."""
    segments = F.filter(F.split(F.regexp_replace(_c(url), r"[?#].*$", ""), "/"), lambda x: x != "")
    return F.coalesce(F.try_element_at(segments, F.lit(-1)), _c(url))


def source_name(location: Column | str) -> Column:
    """Display name of a location: its last segment without query, fragment and archive suffix."""
    return F.regexp_replace(pdf_title(location), r"(\.warc\.gz|\.warc|\.wacz)$", "")


def url_encode(s: Column | str) -> Column:
    """Percent-encoding of all but the unreserved characters."""
    out = F.url_encode(_c(s))
    for a, b in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~")):
        out = F.regexp_replace(out, a, b)
    return out


def html_escape(s: Column | str) -> Column:
    out = _c(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


# ---------------------------------------------------------------- time


def year_of(ts: Column | str) -> Column:
    """Year 1000..9999 that a timestamp starts with, else null."""
    y = F.when(F.substring(_c(ts), 1, 4).rlike(r"^\d{4}$"), F.substring(_c(ts), 1, 4).try_cast("int"))
    return F.when(y.between(1000, 9999), y)


def month_of(ts: Column | str) -> Column:
    """YYYYMM that a timestamp starts with, else null."""
    ok = F.substring(_c(ts), 1, 6).rlike(r"^\d{6}$")
    m = F.when(ok, F.substring(_c(ts), 5, 2).try_cast("int"))
    return F.when(m.between(1, 12), year_of(ts) * 100 + m)


def to_14_digits(ts: Column | str) -> Column:
    return F.left(F.regexp_replace(_c(ts), r"[^0-9]", ""), F.lit(14))


def to_iso(ts: Column | str) -> Column:
    """14 digits as ISO 8601; anything else as it is."""
    return F.regexp_replace(_c(ts), r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3T$4:$5:$6Z")


def to_rfc3339(ts: Column | str) -> Column:
    """14 digits that are a real time as RFC 3339; anything else as it is."""
    t = F.when(_c(ts).rlike(r"^\d{14}$"), F.try_to_timestamp(_c(ts), F.lit("yyyyMMddHHmmss")))
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), _c(ts))


def ymd(ts: Column | str) -> Column:
    return F.when(_c(ts).rlike(r"^\d{8}"), F.concat_ws("-", F.substring(_c(ts), 1, 4), F.substring(_c(ts), 5, 2), F.substring(_c(ts), 7, 2))).otherwise(_c(ts))


def minute_of(ts: Column | str) -> Column:
    day = F.concat_ws("-", F.substring(_c(ts), 1, 4), F.substring(_c(ts), 5, 2), F.substring(_c(ts), 7, 2))
    return F.when(F.length(_c(ts)) >= 14, F.concat(day, F.lit(" "), F.substring(_c(ts), 9, 2), F.lit(":"), F.substring(_c(ts), 11, 2))).otherwise(_c(ts))


def year_and_month(ym: Column | str) -> Column:
    return F.format_string("%04d-%02d", F.floor(_c(ym) / 100).cast("int"), (_c(ym) % 100).cast("int"))


def year_prefix(s: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(s), r"^(\d{4})", 1), F.lit(""))


def modified_year(header: Column | str) -> Column:
    """Year of an IMF-fixdate such as `Wed, 21 Oct 2015 07:28:00 GMT`."""
    y = F.regexp_extract(F.trim(_c(header)), r"^(?:[A-Za-z]{3}, )?\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (\d{4}) \d{2}:\d{2}(?::\d{2})? (?:GMT|UT|[+-]\d{4})$", 1).try_cast("int")
    return F.when(y > 0, y)


def millis_to_rfc3339(ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(_c(ms)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def date_range(start: Column | str, end: Column | str) -> Column:
    """`a → b`, one date if they coincide or only one is known, null if none is."""
    a, b = ymd(start), ymd(end)
    return F.when(_c(start).isNull(), b).when(_c(end).isNull() | (a == b), a).otherwise(F.concat(a, F.lit(" → "), b))


# ---------------------------------------------------------------- names and labels


def hash8(s: Column | str) -> Column:
    """First 8 hex digits of SHA-256."""
    return F.left(F.sha2(_c(s).cast("binary"), 256), F.lit(8))


def slugify(name: Column | str) -> Column:
    """Lower-case ASCII letters and digits, other runs one hyphen; a hash where nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(_c(name), r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", "")
    plain = F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(plain == "", hash8(name)).otherwise(plain)


def safe_component(s: Column | str) -> Column:
    """One path component: unsafe characters become _, and no `.` or `..`."""
    mapped = F.regexp_replace(_c(s), r"[^A-Za-z0-9._-]", "_")
    return F.when(mapped.isin("", "."), "_").when(mapped == "..", "__").otherwise(mapped)


def safe_archive_name(name: Column | str, fallback: Column | str) -> Column:
    own = F.regexp_replace(_c(name), r"^\s+|\s+$", "")
    base = safe_component(F.when(own == "", _c(fallback)).otherwise(own))
    return F.when(F.lower(base).endswith(".wacz"), base).otherwise(F.concat(base, F.lit(".wacz")))


def clean(s: Column | str) -> Column:
    return F.nullif(F.trim(_c(s)), F.lit(""))


def human_size(n: Column | str) -> Column:
    n = _c(n)
    # ties go to the even digit
    shown = lambda k, u: F.format_string("%.1f " + u, F.bround(n / F.lit(float(1024**k)), 1))
    steps = [(n < 1024 ** (k + 1), shown(k, u)) for k, u in ((1, "KB"), (2, "MB"), (3, "GB"))]
    return either((n < 1024, F.concat(n.cast("string"), F.lit(" B"))), *steps, otherwise=shown(4, "TB"))


#: Phrases for the codes that get one.
STATUS_PHRASES = {
    301: "Moved Permanently", 302: "Found (redirect)", 307: "Redirect", 308: "Redirect", 400: "Bad Request",
    401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 410: "Gone", 429: "Too Many Requests",
    500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}
REVIEW_WORDS = {5: "Excellent", 4: "Good", 3: "Fair", 2: "Poor", 1: "Bad"}


def status_label(code: Column | str) -> Column:
    phrase = either(*[(_c(code) == k, F.lit(" " + v)) for k, v in STATUS_PHRASES.items()], otherwise="")
    return F.concat(F.lit("Archived HTTP "), _c(code).cast("string"), phrase)


def review_label(rating: Column | str) -> Column:
    word = either(*[(_c(rating) == k, F.lit(v)) for k, v in REVIEW_WORDS.items()], otherwise="Reviewed")
    return F.concat(word, F.lit(" ("), _c(rating).cast("string"), F.lit("/5)"))


def humanize_topic(code: Column | str) -> Column:
    """`artsAndHumanities` as `Arts and Humanities`."""
    words = F.split(F.lower(F.regexp_replace(F.trim(_c(code)), r"(?<=.)(?=\p{Lu})", "\u0001")), "\u0001")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin("and", "of", "the", "for"), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))), " ")


def placeholder_hue(seed: Column | str) -> Column:
    """31-fold hash of the bytes, in 32 bits, as a hue."""
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(_c(seed))), lambda i: F.conv(F.substr(F.hex(_c(seed)), 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))
    return (F.aggregate(F.when(F.octet_length(_c(seed)) > 0, octets).otherwise(F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, b: (a * 31 + b) % (1 << 32)) % 360).cast("int")


def primary_lang(lang: Column | str) -> Column:
    return F.lower(F.trim(F.element_at(F.split(_c(lang), "[-_]"), 1)))


def missing_minimum(**fields: Column) -> Column:
    """Names of the fields that are null or blank."""
    return F.filter(F.array(*[F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(n)) for n, c in fields.items()]), lambda x: x.isNotNull())


# ---------------------------------------------------------------- text


def excerpt(s: Column | str, chars: int = 300) -> Column:
    """White space collapsed, cut at `chars` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(_c(s), r"\s+", " "))
    return F.when(F.length(flat) > chars, F.concat(F.left(flat, F.lit(chars)), F.lit("…"))).otherwise(flat)


def byte_prefix(s: Column | str, cap: int) -> Column:
    """At most `cap` bytes of UTF-8, cut at a character; 0: no limit."""
    if cap == 0:
        return _c(s)
    cut = F.substr(F.encode(_c(s), "UTF-8"), F.lit(1), F.lit(cap))
    return F.when(F.octet_length(_c(s)) <= cap, _c(s)).otherwise(F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "�+$", ""))


def tokens(s: Column | str) -> Column:
    """Lower-cased runs of letters and digits, those over 40 bytes dropped."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_c(s), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(found, lambda t: F.octet_length(t) <= 40)


def tag_strip(html: Column | str) -> Column:
    """Text of a page by pattern: scripts and styles out, tags to spaces, white space collapsed."""
    out = F.regexp_replace(_c(html), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"\s+", " "))


def html_title(html: Column | str) -> Column:
    return F.trim(F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_lang(html: Column | str) -> Column:
    return primary_lang(F.regexp_extract(_c(html), r"""(?is)<html[^>]*\slang=["']?([A-Za-z0-9_-]+)""", 1))


def html_headings(html: Column | str) -> Column:
    """Texts of h1 and h2 in order, tags stripped, joined by a space."""
    found = F.regexp_extract_all(_c(html), F.lit(r"(?is)<h[12](?:\s[^>]*)?>(.*?)</h[12]>"), F.lit(1))
    return F.array_join(F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " "))), " ")
