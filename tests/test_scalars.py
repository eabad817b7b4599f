import pytest
from pyspark.sql import functions as F

from webquarry.functions import scalars as X


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://www7.Museum.org/Hall/", "org,museum)/hall/"),
        ("ftp://files.museum.org", "ftp://files.museum.org"),
        ("http://curator@museum.org/a", "org,museum)/a"),
        ("http://museum.org:80?z", "org,museum)/?z"),
        ("http://museum.org:443/", "org,museum:443)/"),
        ("http://museum.org:81/x#part", "org,museum:81)/x"),
        ("http://museum.org/l?k=2&k=10&a", "org,museum)/l?a&k=10&k=2"),
        ("http://wwwmuseum.org/", "org,wwwmuseum)/"),
        ("tel:+4930123", "tel:+4930123"),
    ],
)
def test_surt(spark, url, key):
    assert one(spark, X.surt(F.lit(url))) == key


@pytest.mark.parametrize(("ts", "year", "month"), [("19990228235959", 1999, 199902), ("00001225", None, None), ("20180015", 2018, None), ("19", None, None), ("2007", 2007, None), ("1984-11-30", 1984, None)])
def test_year_and_month(spark, ts, year, month):
    assert one(spark, X.year_of(F.lit(ts))) == year
    assert one(spark, X.month_of(F.lit(ts))) == month


@pytest.mark.parametrize(("name", "slug"), [("River & Sea: 2nd ed.", "river-sea-2nd-ed"), ("__x__", "x"), ("Z", "z")])
def test_slug(spark, name, slug):
    assert one(spark, X.slugify(F.lit(name))) == slug


def test_slug_without_letters_is_a_hash(spark):
    assert len(one(spark, X.slugify(F.lit("¿¡")))) == 8


@pytest.mark.parametrize(
    ("column", "value"),
    [
        (lambda: X.human_size(F.lit(7)), "7 B"),
        (lambda: X.human_size(F.lit(1536)), "1.5 KB"),
        (lambda: X.human_size(F.lit(3 * 1024**3)), "3.0 GB"),
        (lambda: X.to_iso(F.lit("19840229010203")), "1984-02-29T01:02:03Z"),
        (lambda: X.to_iso(F.lit("198402")), "198402"),
        (lambda: X.to_14_digits(F.lit("1984-02-29 01:02:03+00")), "19840229010203"),
        (lambda: X.to_rfc3339(F.lit("19840230010203")), "19840230010203"),
        (lambda: X.to_rfc3339(F.lit("19840229010203")), "1984-02-29T01:02:03Z"),
        (lambda: X.ymd(F.lit("1984")), "1984"),
        (lambda: X.safe_component(F.lit(".")), "_"),
        (lambda: X.safe_component(F.lit("x:y?z")), "x_y_z"),
        (lambda: X.safe_archive_name(F.lit("\t"), F.lit("box 1")), "box_1.wacz"),
        (lambda: X.pdf_title(F.lit("http://lib.net/shelf/plan.v2.pdf#p3")), "plan.v2.pdf"),
        (lambda: X.source_name(F.lit("/mnt/tapes/box1.wacz")), "box1"),
        (lambda: X.url_encode(F.lit("x/y+ü-_.")), "x%2Fy%2B%C3%BC-_."),
        (lambda: X.html_escape(F.lit("1 < 2 & 'q'")), "1 &lt; 2 &amp; 'q'"),
        (lambda: X.status_label(F.lit(500)), "Archived HTTP 500 Internal Server Error"),
        (lambda: X.status_label(F.lit(299)), "Archived HTTP 299"),
        (lambda: X.review_label(F.lit(0)), "Reviewed (0/5)"),
        (lambda: X.humanize_topic(F.lit("historyOfTheSea")), "History of the Sea"),
        (lambda: X.modified_year(F.lit("Mon, 05 Jan 1998 00:00:00 GMT")), 1998),
        (lambda: X.modified_year(F.lit("1998-01-05")), None),
        (lambda: X.primary_lang(F.lit("PT_br")), "pt"),
        (lambda: X.byte_prefix(F.lit("€5"), 2), ""),
        (lambda: X.byte_prefix(F.lit("€5"), 3), "€"),
        (lambda: X.excerpt(F.lit("one\ttwo  three"), 7), "one two…"),
        (lambda: X.date_range(F.lit("19840229"), F.lit("19850101")), "1984-02-29 → 1985-01-01"),
        (lambda: X.placeholder_hue(F.lit("Z")), 90),
        (lambda: X.host(F.lit("data:,x")), ""),
    ],
)
def test_values(spark, column, value):
    assert one(spark, column()) == value


def test_missing_minimum(spark):
    assert one(spark, X.missing_minimum(a=F.lit("x"), b=F.lit(" "), c=F.lit(None).cast("string"))) == ["b", "c"]


def test_languages_by_trigrams(spark, sf, tmp_path):
    from webquarry.functions import trigrams

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learn, rest = docs.where("doc_id % 4 > 0"), docs.where("doc_id % 4 = 0 and lang is not null")
    found = trigrams.learn(spark, str(tmp_path), learn.select(F.col("text").alias("body"), "lang"))
    assert trigrams.load(spark, str(tmp_path)) == found and all(len(p) <= trigrams.PLACES for p in found.values())
    rows = rest.select("lang", trigrams.told("text", found).alias("told")).where("told is not null").collect()
    assert len(rows) >= 0.7 * rest.count() and sum(r["lang"] == r["told"] for r in rows) >= 0.95 * len(rows)
    odd = spark.createDataFrame([(None,), ("",), ("short",), ("1234567890 " * 20,), ("\u4e2d" * 60,)], "text string")
    assert [r[0] for r in odd.select(trigrams.told("text", found)).collect()] == [None] * 5
    assert [r[0] for r in odd.select(trigrams.told("text", {})).collect()] == [None] * 5


def test_language_votes_of_mixed_letters():
    from webquarry.functions.langdetect import _script, detect

    assert [_script(c) for c in "aд漢か1 .ש"] == ["", "", "zh", "ja", None, None, None, "he"]
    assert detect("漢字かな交じり文" * 8) == "ja" and detect("שלום עולם " * 8) == "he" and detect("123 456 " * 9) is None
    _script.cache_clear()
    detect("the river and the town of the hills " * 40)
    assert _script.cache_info().misses <= 20  # a letter is looked up once, not at each of its places
