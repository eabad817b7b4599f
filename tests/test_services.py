import json

import pytest

from webquarry import config
from webquarry.functions.langdetect import detect
from webquarry.functions.markdown import render
from webquarry.operators import catalog
from webquarry.sources import importers as I
from webquarry.sources.http_range import RangeReader, Transient, parse_byte_range, retry_after, with_retry
from webquarry.sources.locations import Source, parsed, source_list


def transport(pages):
    seen = []

    def run(method, url, headers, body):
        seen.append((method, url, headers.get("Authorization")))
        return 200, json.dumps(pages[url]).encode()

    run.seen = seen
    return run


def test_token_login_and_paging():
    t = transport({"https://b/api/auth/jwt/login": {"access_token": "T"}, "https://b/api/orgs?page=1&pageSize=2": {"items": [{"id": "1"}, {"id": "2"}], "total": 3}, "https://b/api/orgs?page=2&pageSize=2": {"items": [{"id": "3"}], "total": 3}})
    c = I.BrowsertrixClient.login("https://b/", "u", "p", t)
    c.page_size = 2
    assert [o["id"] for o in c.orgs()] == ["1", "2", "3"] and t.seen[-1][2] == "Bearer T"


def test_cursor_paging_and_plan(spark):
    t = transport({"https://a/wasapi/v1/webdata?collection=7": {"files": [{"filename": "x", "size": 2, "crawl": 5}], "next": "https://a/n2"}, "https://a/n2": {"files": [{"filename": "y", "size": 3}], "next": None}})
    c = I.ArchiveItClient.basic("https://a", "u", "p", t)
    files = I.files_table(spark, c.webdata(collection=7))
    assert {(r["crawl"], r["bytes"]) for r in catalog.plan_crawls(files).collect()} == {(5, 2), (0, 3)}


def test_service_errors_show_a_snippet():
    c = I.ArchiveItClient.basic("https://a", "u", "p", lambda *a: (500, b"x" * 999))
    with pytest.raises(I.ServiceError, match="HTTP 500"):
        c.collections()


def test_jobs(spark):
    jobs = I.jobs_table(spark, [{"id": 1, "status": "FINISHED"}, {"id": 2, "test_crawl_state": "DELETED"}, {"id": 3, "type": "TEST_DELETED"}, {"id": 4, "status": "RUNNING"}, {"id": 5, "other": 1}])
    assert [r["id"] for r in jobs.where(catalog.importable(jobs)).orderBy("id").collect()] == [1, 5]


def test_finding_aid():
    c = {"metadata": {"description": [{"value": "N"}], "Subject": ["s", {"value": "t"}], "Collector": "me"}, "topics": "artsAndHumanities"}
    assert I.finding_aid(c) == {"narrative": "N", "creator": "me", "subjects": ["s", "t", "Arts and Humanities"]}


def test_choose():
    rows = [{"id": "1", "slug": "a", "name": "Ay"}, {"id": "2", "slug": "b", "name": "Be"}]
    assert I.choose(rows, "be")["id"] == "2" and I.choose(rows[:1], None)["id"] == "1"
    with pytest.raises(I.ServiceError):
        I.choose(rows, None)
    assert I.allowlisted({"a": 1, "b": None, "c": 2}, ("a", "b")) == {"a": 1}


def test_retry():
    waits, left = [], [Transient("x"), Transient("x", 7.0)]

    def f():
        if left:
            raise left.pop(0)
        return "ok"

    assert with_retry(f, sleep=waits.append) == "ok"
    assert 0.5 <= waits[0] <= 0.6 and 7 <= waits[1] <= 8.4
    with pytest.raises(OSError, match="gave up"):
        with_retry(lambda: (_ for _ in ()).throw(Transient("x")), sleep=lambda s: None)
    assert retry_after("12") == 12 and retry_after("soon") is None


def test_range_reader():
    data = bytes(range(256)) * 9000
    calls = []

    def fetch(url, a, b):
        calls.append((a, b))
        return data[a : b + 1], len(data)

    r = RangeReader("u", fetch)
    r.seek(100)
    assert r.read(50) == data[100:150] and r.read(50) == data[150:200]
    r.seek(-10, 2)
    assert r.read() == data[-10:] and len(calls) == 3


@pytest.mark.parametrize(("header", "found"), [("bytes=0-9", (0, 9)), ("bytes=90-", (90, 99)), ("bytes=-5", (95, 99)), ("bytes=100-", None), ("bytes=9-3", None), ("x", None)])
def test_byte_ranges(header, found):
    assert parse_byte_range(header, 100) == found


def test_sources(spark):
    for s, kind in (("a/b.wacz", "file"), ("https://x/y", "url"), ("browsertrix|h|o|i|r|x", "browsertrix"), ("browsertrix-public|h|o|c|r", "browsertrix-public"), ("browsertrix|h", "file")):
        assert Source.parse(s).kind == kind and Source.parse(s).location == s
        row = spark.createDataFrame([(s,)], "s string").select(parsed("s").alias("p")).first()["p"]
        assert row["kind"] == kind
    assert source_list(" a \n# b\n\nc") == ["a", "c"]


def test_config(tmp_path):
    assert config.load(str(tmp_path)) == config.Config()
    (tmp_path / "config.yaml").write_text("index:\n  stored_body_cap_kb: 0\n  writer_heap_mb: 1\nother: 1\n")
    assert config.load(str(tmp_path)) == config.Config(0, 15 * 1024 * 1024)
    (tmp_path / "config.yaml").write_text("index: [\n")
    with pytest.raises(ValueError):
        config.load(str(tmp_path))


def test_languages():
    assert detect("The quick brown fox jumps over the lazy dog and it is not the only one of them.") == "en"
    assert detect("Ceci est une phrase en français qui est assez longue pour que la langue soit reconnue dans le texte.") == "fr"
    assert detect("Привет, это не просто так, а на русском языке, и он как раз длинный") == "ru"
    assert detect("これは日本語の文章です。言語を判定するために書かれています。") == "ja"
    assert detect("short") is None and detect("zzzz qqqq " * 20) is None


def test_markdown():
    assert render("# A\n\n<b>x</b> [l](javascript:1) [m](https://x/) ![alt](i.png)") == '<h1>A</h1>\n<p>&lt;b&gt;x&lt;/b&gt; l <a href="https://x/">m</a> alt</p>'
    assert render("- a\n- b") == "<ul><li>a</li><li>b</li></ul>"


def test_quality_and_ranges(spark):
    h = spark.createDataFrame([("c", 200, 96), ("c", 301, 2), ("c", 404, 1), ("c", 504, 1)], "id string, status int, n bigint")
    assert catalog.capture_quality(h, "id").first()["quality"] == "100 captures, 98% ok — 404×1, 504×1"
    r = spark.createDataFrame([("c", "20210101000000"), ("c", "2022-03-04T00:00:00Z")], "id string, timestamp string")
    assert catalog.capture_range(r, "id").first()["capture_range"] == "2021-01-01 → 2022-03-04"


def test_fill_gaps_and_overwrite(spark):
    old = spark.createDataFrame([("a", "x", None), ("b", " ", 1)], "id string, title string, n int")
    new = spark.createDataFrame([("a", "y", 2), ("b", "z", None), ("c", "w", 3)], "id string, title string, n int")
    assert sorted(map(tuple, catalog.fill_gaps(old, new).collect())) == [("a", "x", 2), ("b", "z", 1), ("c", "w", 3)]
    assert sorted(map(tuple, catalog.overwrite(old, new).collect())) == [("a", "y", 2), ("b", "z", 1), ("c", "w", 3)]
