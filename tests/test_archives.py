import gzip
import io
import json
import os
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from webquarry.config import Config
from webquarry.operators import maintain
from webquarry.plans import ingest
from webquarry.plans import search as S
from webquarry.plans.textindex import TextIndex
from webquarry.sources import cdx, finding_aids, wacz, warc
from webquarry.sources.html import extract
from webquarry.sources.wacz_writer import build_wacz, unique_names


def record(kind, uri, payload, http=None, date="2024-01-15T12:00:00Z", ctype="application/http;msgtype=response"):
    block = (http or b"") + payload
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: <{uri}>\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Type: {ctype}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page(uri, html, status=200, **more):
    return record("response", uri, html.encode(), f"HTTP/1.1 {status} OK\r\nContent-Type: text/html\r\nLast-Modified: Wed, 21 Oct 2015 07:28:00 GMT\r\n\r\n".encode(), **more)


RECORDS = [
    record("warcinfo", "", b"software: tester\r\nsoftware: second\r\n", ctype="application/warc-fields"),
    page("http://ex.com/x", "<html lang='en-GB'><head><title>Hi</title></head><body><h1>Head</h1><p>hello world</p></body></html>"),
    record("request", "http://ex.com/x", b"GET / HTTP/1.1\r\n\r\n", ctype="application/http;msgtype=request"),
    page("http://ex.com/gone", "<title>Gone</title><body>missing</body>", 404),
    record("resource", "urn:text:http://ex.com/x", "rendered text".encode(), ctype="text/plain"),
]


@pytest.fixture(params=["plain", "gzip"])
def warc_file(request, tmp_path):
    at = tmp_path / ("a.warc" if request.param == "plain" else "a.warc.gz")
    at.write_bytes(b"".join(RECORDS) if request.param == "plain" else b"".join(gzip.compress(r) for r in RECORDS))
    return str(at)


def test_data_source(spark, warc_file):
    spark.dataSource.register(warc.WarcDataSource)
    rows = spark.read.format("warc").load(warc_file).orderBy("offset").collect()
    assert [r["warc_type"] for r in rows] == ["warcinfo", "response", "request", "response", "resource"]
    x = rows[1]
    assert (x["target_uri"], x["timestamp"], x["http_status"], x["content_type"], x["digest"]) == ("http://ex.com/x", "20240115120000", 200, "text/html", "sha1:ABC")
    with open(warc_file, "rb") as f:
        f.seek(x["offset"])
        again = warc.record_slice(f.read(x["record_length"]))
    assert again[0]["payload"] == bytes(x["payload"])


def test_extension_does_not_decide(tmp_path):
    data = gzip.compress(RECORDS[1])
    assert next(warc.read_records(io.BytesIO(data)))["target_uri"] == "http://ex.com/x"
    assert next(warc.read_records(io.BytesIO(RECORDS[1])))["target_uri"] == "http://ex.com/x"


def test_records_of_one_member_share_its_place():
    rows = list(warc.read_records(io.BytesIO(gzip.compress(RECORDS[1] + RECORDS[3]) + b"trailing")))
    assert len(rows) == 2 and rows[0]["offset"] == rows[1]["offset"] and rows[0]["record_length"] == rows[1]["record_length"]


def test_warcinfo_keeps_the_first_value():
    assert warc.warcinfo(b"software: a\r\nsoftware: b\r\nisPartOf: c\r\nother: d")["software"] == "a"


def test_binary_files_source(spark, warc_file):
    df = warc.read_binary_files(spark.read.format("binaryFile").load(warc_file))
    assert df.where("warc_type = 'response'").count() == 2


def test_cdx_lines(spark, tmp_path):
    at = tmp_path / "i.cdx"
    at.write_text('com,ex)/x 20240115 {"url":"http://ex.com/x","mime":"text/html","status":"200","filename":"a.warc.gz","offset":"12","length":"34"}\n{"url":"http://ex.com/y","timestamp":"2020","status":404,"length":0}\n{"mime":"x"}\nbroken\n')
    rows = cdx.read_cdx(spark, str(at)).orderBy("url").collect()
    assert [(r["url"], r["ts"], r["status"], r["offset"], r["length"]) for r in rows] == [("http://ex.com/x", "20240115", 200, 12, 34), ("http://ex.com/y", "2020", 404, 0, 0)]
    df = cdx.read_cdx(spark, str(at))
    assert cdx.lookup(df, "http://ex.com/x").count() == 1 and cdx.wanted(df).count() == 1


def test_extraction():
    p = extract("<html lang=fr><head><title> A &amp; B </title><meta name=description content=' d '><meta property='og:image' content=i></head><body>x<script>no</script> <b>y</b>z<noscript>n</noscript><h2>H <i>2</i></h2></body></html>")
    assert (p["title"], p["lang"], p["description"], p["og_image"], p["headings"], p["body"]) == ("A & B", "fr", "d", "i", "H 2", "x y z H 2")


def test_references_without_semicolon_are_text():
    p = extract("<html><head><title>a &amp; b &amp</title><meta name=description content='d&copy;&copy'></head><body>x &ampy; &#65; &#65 &quot;q&quot;<h1>h &lt; &lt</h1>&</body></html>")
    assert (p["title"], p["description"], p["headings"], p["body"]) == ("a & b &amp", "d©&copy", "h < &lt", 'x &ampy; A &#65 "q" h < &lt &')


@pytest.mark.parametrize("name", ["html_bodies", "html_parsed_fields"])
def test_cut_and_quoted_references_as_in_sql(spark, tmp_path, name):
    import duckdb

    pages = [(1, "http://a.org/1", "<html lang='de-AT'><head><title>cut &amp;&amp</title></head><body><h1>cut &amp;&amp</h1>t &amp</body></html>"), (2, "http://a.org/2", "<html lang=en><head><title>t = &quot;a&quot; &lt;</title></head><body><h2>t = &quot;a&quot;</h2></body></html>")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    df = entry.queries()[name](spark, str(tmp_path))
    found = duckdb.connect().execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'").execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())


def make(path, compression, warcs, extra=()):
    with zipfile.ZipFile(path, "w", compression) as z:
        for name, data in warcs:
            z.writestr(f"archive/{name}", data)
        for name, data in extra:
            z.writestr(name, data)


PAGES = "\n".join(['{"format":"json-pages-1.0"}', json.dumps({"url": "http://ex.com/only", "title": "Only", "ts": "2022-01-05T00:00:00Z", "text": "Привет from pages"}), json.dumps({"url": "http://ex.com/blank", "text": "  "})])


@pytest.mark.parametrize("route", ["scan", "fetch", "nested"])
def test_routes_give_the_same_pages(spark, tmp_path, route):
    data = b"".join(gzip.compress(r) for r in RECORDS)
    lines, at = [], 0
    for r in RECORDS:
        n = len(gzip.compress(r))
        rec = warc.record_slice(gzip.compress(r))[0]
        if rec["warc_type"] in ("response", "resource"):
            lines.append(json.dumps({"url": rec["target_uri"], "mime": rec["content_type"], "status": str(rec["http_status"] or ""), "filename": "a.warc.gz", "offset": str(at), "length": str(n)}))
        at += n
    extra = [("pages/pages.jsonl", PAGES), ("indexes/index.cdx", "\n".join(lines))]
    path = str(tmp_path / "p.wacz")
    make(path, zipfile.ZIP_DEFLATED if route == "scan" else zipfile.ZIP_STORED, [("a.warc.gz", data)], extra)
    if route == "nested":
        outer = str(tmp_path / "outer.wacz")
        with zipfile.ZipFile(outer, "w", zipfile.ZIP_STORED) as z:
            z.write(path, "inner.wacz")
            z.writestr("pages/pages.jsonl", PAGES)
        path = outer
    found = {r["url"]: r for r in ingest.pages_of(spark, "c", path).collect()}
    assert set(found) == {"http://ex.com/x", "http://ex.com/gone", "http://ex.com/only"}
    x = found["http://ex.com/x"]
    assert (x["title"], x["body"], x["status"], x["modified"], x["lang"]) == ("Hi", "rendered text", 200, 2015, "en-GB")
    assert found["http://ex.com/only"]["timestamp"] == "20220105000000"


def test_build_ingest_search_delete(spark, tmp_path, warc_file):
    home = str(tmp_path / "home")
    built = build_wacz(spark, [warc_file], str(tmp_path / "out.wacz"), title="Built", keywords=["k"])
    assert built["records"] == 5 and built["cdx_lines"] == 3 and built["pages"] == 1
    with open(tmp_path / "out.wacz", "rb") as f:
        meta = wacz.read_datapackage(f)
        assert meta["title"] == "Built" and meta["seed_pages"][0]["url"] == "http://ex.com/x"
        assert wacz.read_warcinfo(f)["software"] == "tester"
    out = ingest.ingest(spark, home, [str(tmp_path / "out.wacz")], "col")
    assert len(out["indexed"]) == 1 and not out["failed"]
    assert ingest.ingest(spark, home, [str(tmp_path / "out.wacz")], "col")["skipped"] == out["indexed"]
    hits = S.search(maintain.open_index(spark, home), "rendered").hits.collect()
    assert [h["url"] for h in hits] == ["http://ex.com/x"]
    n = maintain.documents(spark, home).count()
    ingest.ingest(spark, home, [str(tmp_path / "out.wacz")], "col", force=True)
    assert maintain.documents(spark, home).count() == n
    maintain.compact(spark, home)
    assert maintain.documents(spark, home).count() == n and maintain.index_stats(spark, home).count() == 5
    cid = out["indexed"][0]
    ingest.Manifest.open(spark, home).set_provenance(cid, importer="service", importer_item="item-9")
    assert ingest.rebuild(spark, home)["indexed"] == 1
    assert maintain.documents(spark, home).count() == n and S.search(maintain.open_index(spark, home), "Built").hits.first()["doc_type"] == "collection"
    ingest.ingest(spark, home, [str(tmp_path / "out.wacz")], "col", force=True)
    assert ingest.Manifest.open(spark, home).rows[cid]["importer_item"] == "item-9"
    refused = ingest.ingest(spark, home, [str(tmp_path / "out.wacz")], "other")
    assert refused["failed"][0][0] == cid and not refused["indexed"]
    assert maintain.index_summary(spark, home)["docs"] == n
    answer = S.search(maintain.open_index(spark, home), "rendered").document()
    assert answer["total_hits"] == 1 and answer["num_docs"] == n and answer["hits"][0]["url"] == "http://ex.com/x" and {f["field"] for f in answer["facets"]} >= {"collection", "site"}
    finding_aids.set_note(spark, home, "col", cid, " a note ")
    assert finding_aids.note(spark, home, "col", cid) == "a note"
    with pytest.raises(ValueError, match="holds 1"):
        ingest.delete_collection(spark, home, "col")
    filed = ingest.plan_crawl_deletion(spark, home, cid)["file"]
    assert ingest.delete_collection(spark, home, "col", with_crawls=True)["members"] == [cid]
    assert maintain.documents(spark, home).count() == 0 and not os.path.exists(filed) and finding_aids.listed(spark, home) == []
    assert S.search(maintain.open_index(spark, home), "rendered").hits.count() == 0


def documents_of(spark, crawl, texts):
    rows = [(i, crawl, f"http://{crawl}.com/{i}", t) for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "n int, crawl_id string, url string, body string").select("*", *[F.lit("").alias(c) for c in ("timestamp", "title", "description", "headings", "keywords", "author", "lang")], F.lit("html").alias("media_type"), F.lit(200).alias("status"), F.lit(None).cast("int").alias("modified"))
    return ingest.as_documents(pages, "name", "col", Config())


def test_a_commit_writes_its_own_segment_only(spark, tmp_path):
    home = str(tmp_path)
    maintain.upsert(spark, home, documents_of(spark, "aaaa0001", ["alpha beta", "alpha"]))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    maintain.upsert(spark, home, documents_of(spark, "bbbb0002", ["alpha gamma"]))
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    assert all(after[p] == t for p, t in before.items()) and len(after) > len(before)
    assert len(maintain.segments(spark, home)) == 2
    find = lambda q: sorted((r["crawl_id"], round(r["score"], 9)) for r in S.matches(maintain.open_index(spark, home), q).collect())
    two = find("alpha")
    maintain.compact(spark, home, target=1)
    assert find("alpha") == two and len(two) == 3 and len(maintain.segments(spark, home)) == 1
    maintain.delete_crawl(spark, home, "aaaa0001")  # out of a segment that holds both
    assert [c for c, _ in find("alpha")] == ["bbbb0002"] and find("beta") == []
    whole = {(r["crawl_id"], round(r["score"], 9)) for r in S.matches(TextIndex.of(maintain.documents(spark, home)), "alpha").collect()}
    assert set(find("alpha")) == whole
    maintain.upsert(spark, home, documents_of(spark, "bbbb0002", ["delta"]))
    assert find("alpha") == [] and [c for c, _ in find("delta")] == ["bbbb0002"]


def test_rare_terms_read_few_files_and_filters_reach_the_scan(spark, tmp_path):
    maintain.upsert(spark, str(tmp_path), documents_of(spark, "aaaa0001", [f"common word{i}" for i in range(200)]))
    found = S.matches(maintain.open_index(spark, str(tmp_path)), "word7 site:aaaa0001.com")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(site,aaaa0001.com)" in plan and "EqualTo(term,word7)" in plan and "PartitionFilters: [isnotnull(bucket" in plan
    assert found.count() == 1


def test_scan_makes_one_task_for_each_inner_file(spark, tmp_path):
    path = str(tmp_path / "many.wacz")
    make(path, zipfile.ZIP_DEFLATED, [(f"w{i}.warc.gz", gzip.compress(page(f"http://ex.com/{i}", f"<title>t{i}</title>"))) for i in range(6)])
    with open(path, "rb") as f:
        assert wacz.inner_files(f) == [(f"archive/w{i}.warc.gz", None, None) for i in range(6)]
    records = wacz.page_records(spark, spark.createDataFrame([("c", path)], "crawl_id string, path string"))
    assert [r["url"] for r in records.orderBy("seq").collect()] == [f"http://ex.com/{i}" for i in range(6)]
    assert records.rdd.getNumPartitions() == 7  # the page texts are one of their own
    assert records.select(F.spark_partition_id()).distinct().count() == 6


def test_pdf_text_is_a_hook(spark, tmp_path):
    path = str(tmp_path / "pdf.wacz")
    make(path, zipfile.ZIP_DEFLATED, [("a.warc.gz", gzip.compress(record("response", "http://ex.com/doc/r.pdf", b"%PDF", b"HTTP/1.1 200 OK\r\nContent-Type: application/pdf\r\n\r\n")))])

    def text(data):
        if data != b"%PDF":
            raise RuntimeError("not a PDF")
        return "words inside"

    out = ingest.ingest(spark, str(tmp_path / "h"), [path], "col", pdf_text=text)
    assert len(out["indexed"]) == 1
    assert S.search(maintain.open_index(spark, str(tmp_path / "h")), "inside").hits.first()["title"] == "r.pdf"


def test_package_without_records_is_refused(spark, tmp_path):
    (tmp_path / "w.warc").write_bytes(RECORDS[0])
    with pytest.raises(ValueError, match="no indexable"):
        build_wacz(spark, [str(tmp_path / "w.warc")], str(tmp_path / "o.wacz"))


def test_unique_names():
    assert unique_names(["p/k.warc", "q/m", "r/k.warc", "s/m", "t/k-2.warc", "u/k.warc"]) == ["k.warc", "m", "k-3.warc", "m-2", "k-2.warc", "k-4.warc"]


def test_writer_lock(spark, tmp_path):
    home = str(tmp_path)
    with maintain.writer(spark, home), pytest.raises(maintain.Locked), maintain.writer(spark, home):
        pass
    with maintain.writer(spark, home):
        pass
    (tmp_path / "WRITER").write_text("left by a dead writer")
    with maintain.writer(spark, home, stale=-5):
        pass
    assert not (tmp_path / "WRITER").exists()


def test_fixity(spark, tmp_path):
    (tmp_path / "ok").write_bytes(b"1")
    (tmp_path / "bad").write_bytes(b"2")
    good = maintain.file_sha256(str(tmp_path / "ok"))
    crawls = spark.createDataFrame([("a", "ok", good), ("b", "bad", good), ("c", "none", good), ("d", "https://x/", None)], "id string, source string, sha256 string")
    assert {r["id"]: r["state"] for r in maintain.verify(crawls, str(tmp_path)).collect()} == {"a": "ok", "b": "modified", "c": "missing", "d": "remote"}


def test_deletion_plan_keeps_shared_files(spark):
    crawls = spark.createDataFrame([("a", "x", "f1"), ("b", "y", "f1"), ("c", "x", "f2")], "id string, collection string, source string")
    assert {r["id"]: r["delete_file"] for r in maintain.plan_deletion(crawls, collection="x").collect()} == {"a": False, "c": True}


def test_streaming_ingest(spark, tmp_path):
    from webquarry.streaming.ingest import ingest_stream

    schema = "crawl_id string, crawl_name string, collection string, url string, seq bigint, kind string, timestamp string, title string, body string, description string, headings string, keywords string, author string, lang string, media_type string, status int, modified int"
    def write(rows, name, kind="html"):
        spark.createDataFrame([(c, "n", "col", u, int(name) * 100 + i, kind, "2021", t, b, "", "", "", "", "", "html", 200, None) for i, (c, u, t, b) in enumerate(rows)], schema).write.json(str(tmp_path / "in" / name))

    def run():
        s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
        ingest_stream(s, str(tmp_path / "home"), str(tmp_path / "cp")).awaitTermination()
        return sorted((r["crawl_id"], r["url"], r["title"], r["body"]) for r in maintain.documents(spark, str(tmp_path / "home")).collect())

    write([("a", "http://x.co.uk/1", "one", ""), ("a", "http://x.co.uk/2", "two", ""), ("b", "u2", "bee", "")], "1")
    assert run() == [("a", "http://x.co.uk/1", "one", ""), ("a", "http://x.co.uk/2", "two", ""), ("b", "u2", "bee", "")]
    write([("a", "http://x.co.uk/1", "", "rendered")], "2", kind="text")  # the crawl goes on in a second batch
    assert run() == [("a", "http://x.co.uk/1", "one", "rendered"), ("a", "http://x.co.uk/2", "two", ""), ("b", "u2", "bee", "")]
    assert {r["site"] for r in maintain.documents(spark, str(tmp_path / "home")).where("crawl_id = 'a'").collect()} == {"x.co.uk"}


def files_of(home):
    return {p: p.stat().st_size for p in (home / "index").rglob("*.parquet")}


def test_deletion_writes_no_posting_and_compaction_expunges(spark, tmp_path):
    home = str(tmp_path)
    crawls = [f"aaaa000{i}" for i in range(7)]
    for c in crawls:
        maintain.upsert(spark, home, documents_of(spark, c, [f"alpha word{i} {c}" for i in range(20)]))
    maintain.compact(spark, home, target=1)
    find = lambda q, at=None: sorted((r["crawl_id"], r["doc_id"], round(r["score"], 9)) for r in S.matches(at or maintain.open_index(spark, home), q).collect())
    before, size = files_of(tmp_path), maintain.index_summary(spark, home)["docs"]
    maintain.delete_crawl(spark, home, crawls[3])
    new = {p: n for p, n in files_of(tmp_path).items() if p not in before}
    assert new and all("/deleted/" in str(p) for p in new) and sum(new.values()) < 5_000
    live = next(iter(maintain.segments(spark, home)))
    assert {p for p in before if live in str(p)} <= set(files_of(tmp_path)) and maintain.index_summary(spark, home)["docs"] == size - 20
    index = maintain.open_index(spark, home)
    whole = TextIndex.of(maintain.documents(spark, home))
    for q in ("alpha", "word3", '"alpha word4"', "word5 -aaaa0001", crawls[3], f"alpha {crawls[2]}"):
        assert find(q, index) == find(q, whole)
    assert index.averages == whole.averages and index.frequencies(["alpha"]) == whole.frequencies(["alpha"])
    # the crawl comes back while its old documents are still marked in the old segment
    maintain.upsert(spark, home, documents_of(spark, crawls[3], ["alpha again"]))
    assert [c for c, *_ in find("again")] == [crawls[3]] and len(find("alpha")) == 121
    maintain.delete_crawls(spark, home, crawls[4:6])
    two = find("alpha")
    assert len(maintain.manifest(spark, home)) == 2 and any(s.marked.vectors for s in maintain.manifest(spark, home).values())
    maintain.compact(spark, home)  # no merge is due, but marked documents go
    now = maintain.manifest(spark, home)
    assert find("alpha") == two and len(now) == 2 and not any(s.marked.vectors for s in now.values()) and sorted(s.docs for s in now.values()) == [1, 80]


def test_smallest_first_merges(spark, tmp_path):
    # sixty commits of like size against a large segment: it is never read again, and bytes stay near linear
    docs, written = {"large": 10_000}, 0
    for i in range(60):
        docs[f"s{i}"] = 10
        if len(docs) > 12:
            while names := maintain.merge_plan(docs, target=4, most=5):
                assert "large" not in names and len(names) <= 5 and max(docs[n] for n in names) <= min(n for k, n in docs.items() if k not in names)
                written += sum(docs[n] for n in names)
                docs = {k: n for k, n in docs.items() if k not in names} | {f"m{i}-{len(docs)}": sum(docs[n] for n in names)}
            assert len(docs) == 4
    assert written <= 6 * 600 and sum(docs.values()) == 10_600
    assert maintain.merge_plan({"a": 1, "b": 2, "c": 3}, target=3) == [] and maintain.merge_plan({"a": 5, "b": 2, "c": 3}, target=2) == ["b", "c"]
    home = str(tmp_path)
    maintain.upsert(spark, home, documents_of(spark, "bbbb0000", ["alpha"] * 50))
    large = next(iter(maintain.segments(spark, home)))
    for i in range(4):
        maintain.upsert(spark, home, documents_of(spark, f"cccc000{i}", ["alpha beta"]))
    assert maintain.compact(spark, home, target=2) == (5, 2) and large in maintain.segments(spark, home)
    assert len(S.matches(maintain.open_index(spark, home), "alpha").collect()) == 54


def test_an_index_that_follows_its_home(spark, tmp_path):
    maintain.upsert(spark, str(tmp_path), documents_of(spark, "aaaa0001", ["alpha"]))
    following = maintain.Following(spark, str(tmp_path))
    first = following.index
    assert following.index is first
    maintain.upsert(spark, str(tmp_path), documents_of(spark, "bbbb0002", ["alpha"]))
    assert S.matches(following.index, "alpha").count() == 2 and S.matches(first, "alpha").count() == 1


def test_streamed_crawls_survive_a_rebuild(spark, tmp_path, warc_file):
    from webquarry.streaming.ingest import ingest_stream

    home = str(tmp_path / "home")
    schema = "crawl_id string, crawl_name string, collection string, url string, seq bigint, kind string, timestamp string, title string, body string, description string, headings string, keywords string, author string, lang string, media_type string, status int, modified int"
    package = str(tmp_path / "p.wacz")
    build_wacz(spark, [warc_file], package)
    ingest.ingest(spark, home, [package], "col")
    packaged = maintain.documents(spark, home).count()
    segments = len(maintain.segments(spark, home))
    for k in range(6):
        rows = [("abc", "streamed", "col2", f"http://s.org/{i}", 100 * k + i, "html", "2021", f"title {k}", f"alpha {i}", "", "", "", "", "", "html", 200, None) for i in ((0, k) if k else (0,))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").json(str(tmp_path / "in"))
    ingest_stream(source, home, str(tmp_path / "cp")).awaitTermination()
    now = maintain.manifest(spark, home)
    own = sorted((s.docs, s.marked.docs) for s in now.values() if "abc" in s.crawls)
    assert len(now) == segments + 5 and sum(d for d, _ in own) == 6 and sum(m for _, m in own) == 4  # a batch holds what it touched; of the first one nothing is left
    def state():
        return sorted((r["url"], r["title"]) for r in maintain.documents(spark, home).where("crawl_id = 'abc'").collect())
    before = state()
    assert len(before) == 6 and dict(before)["http://s.org/0"] == "title 5"
    assert len(S.matches(maintain.open_index(spark, home), "alpha collection:col2").collect()) == 6
    assert ingest.Manifest.open(spark, home).rows["abc"]["source"] == "stream:abc" and ingest.Manifest.open(spark, home).is_present("abc")
    out = ingest.rebuild(spark, home)
    assert out["carried"] == ["abc"] and out["failed"] == [] and state() == before
    assert maintain.documents(spark, home).count() == packaged + 6
    maintain.compact(spark, home, target=1)
    assert state() == before and len(maintain.segments(spark, home)) == 1


def test_streaming_windows(spark, sf, tmp_path):
    from webquarry.streaming.ingest import windowed_counts

    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = windowed_counts(stream, "7 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = events.groupBy(F.window("ts", "7 days").alias("w")).agg(F.count("*").alias("n")).select("w.start", "n")
    assert {tuple(r) for r in spark.table("windows").select("start", "n").collect()} == {tuple(r) for r in batch.collect()}


def test_import_run(spark, tmp_path):
    from webquarry.plans import imports
    from webquarry.sources import importers as I
    from webquarry.sources.locations import Source

    home = str(tmp_path / "home")
    files = [{"filename": "../a.warc.gz", "size": 3, "collection": 7, "crawl": c, "crawl-time": f"20{c}0-01-01T00:00:00Z", "locations": [f"https://s/{c}"]} for c in (1, 2, 3)] + [{"filename": "n.warc", "crawl": 4, "locations": []}]
    answers = {"webdata": {"files": files, "next": None}, "crawl_job": [{"id": 2, "status": "RUNNING"}, {"id": 1, "status": "FINISHED", "password": "x"}], "api/collection": [{"id": 7, "name": "Rivers", "metadata": {"description": [{"value": "About rivers"}]}}]}
    client = I.ArchiveItClient.basic("https://s", "u", "p", lambda method, url, headers, body: (200, json.dumps(next(v for k, v in answers.items() if k in url)).encode()))
    got = []

    def download(url, path):
        got.append(url)
        with open(path, "wb") as f:
            f.write(b"".join(gzip.compress(r) for r in RECORDS))

    (tmp_path / "home" / imports.STAGING / "left").mkdir(parents=True)
    out = imports.import_crawls(spark, client, home, "rivers", download, collection=7)
    # the running job and the crawl without a location are left; the crawl without a job is kept
    assert got == ["https://s/1", "https://s/3"] and len(out["imported"]) == 2 and sorted(out["skipped"]) == [2, 4] and not out["failed"]
    assert not os.path.exists(os.path.join(home, imports.STAGING))
    rows = ingest.Manifest.open(spark, home).rows
    assert {(r["importer_item"], r["importer_collection"], r["name"]) for r in rows.values()} == {("1", 7, "Rivers - crawl 1"), ("3", 7, "Rivers - crawl 3")}
    aid = finding_aids.listed(spark, home)[0]
    assert (aid["id"], aid["narrative"], aid["dates"]) == ("rivers", "About rivers", "2010–2030")
    assert imports.import_crawls(spark, client, home, "rivers", download, collection=7)["imported"] == [] and len(got) == 2
    assert imports.imported_items([*rows.values(), {"source": Source("browsertrix", ("h", "o", "item-1", "r")).location}]) == {"1", "3", "item-1"}
    with zipfile.ZipFile(os.path.join(home, "archive", "rivers", "7-1.wacz")) as z:
        assert "password" not in z.read("datapackage.json").decode()


@pytest.mark.parametrize("streamed", [False, True])
def test_import_of_items(spark, tmp_path, streamed):
    from webquarry.plans import imports
    from webquarry.sources import importers as I
    from webquarry.sources.wacz import open_local

    source = tmp_path / "in.warc.gz"
    source.write_bytes(b"".join(gzip.compress(r) for r in RECORDS))
    package, home = str(tmp_path / "p.wacz"), str(tmp_path / "home")
    build_wacz(spark, [str(source)], package)
    items = [{"id": "a", "name": "Creek", "type": "crawl", "reviewStatus": 4}, {"id": "b", "name": "Pond", "type": "upload", "reviewStatus": 2}, {"id": "c", "name": "Lake", "type": "crawl"}]
    hashes = {"a": "h1", "b": "h2", "c": "h3"}

    def transport(method, url, headers, body):
        if "all-crawls" in url:
            return 200, json.dumps({"items": [i for i in items if "ids=" not in url or f"ids={i['id']}" in url], "total": 3}).encode()
        own = url.split("/")[-2]
        return 200, json.dumps({"resources": [{"name": "../x.wacz", "path": f"https://signed/{own}", "hash": hashes[own]}]}).encode()

    client = I.BrowsertrixClient("https://s", transport, "Bearer t")
    ways = {"opener": lambda location: open_local(package)} if streamed else {"download": lambda url, path: shutil.copy(package, path)}
    run = lambda **more: imports.import_items(spark, client, home, "waters", {"id": "o", "name": "Society"}, **ways, **more)
    out = run(least_review=3)
    assert len(out["imported"]) == 1 and out["unreviewed"] == ["b", "c"] and not out["failed"]
    row = ingest.Manifest.open(spark, home).rows[out["imported"][0]]
    assert (row["importer_item"], row["importer_hash"], row["review"], row["name"]) == ("a", "h1", 4, "Creek")
    assert row["source"] == ("browsertrix|s|o|a|../x.wacz" if streamed else os.path.join("archive", "waters", "a", "x.wacz"))
    # what is in stays as it is, a new version and an item named by its id come in
    assert run(least_review=3)["skipped"] == [("a", "../x.wacz")]
    hashes["a"] = "h9"
    assert run(least_review=3)["imported"] == out["imported"] and len(run(item="c")["imported"]) == 1
    aid = finding_aids.listed(spark, home)[0]
    assert (aid["id"], aid["creator"]) == ("waters", "Society")


def test_resolver_logs_in_again_once(spark):
    from webquarry.plans.imports import Resolver
    from webquarry.sources.importers import ServiceError
    from webquarry.sources.locations import Source

    logins = []

    class Client:
        def __init__(self, ok):
            self.ok = ok

        def item_resources(self, org, item):
            if not self.ok:
                raise ServiceError("401")
            return [{"name": "r", "path": f"https://signed/{item}"}]

    def login(host):
        logins.append(host)
        return Client(len(logins) > 1)

    find = Resolver(login)
    assert find(Source("browsertrix", ("h", "o", "i", "r"))) == "https://signed/i" and logins == ["h", "h"]
    assert find(Source("browsertrix", ("h", "o", "j", "r"))) == "https://signed/j" and len(logins) == 2


def test_finding_aids(spark, tmp_path):
    home = str(tmp_path)
    row = {"id": "c", "name": 'A "name": yes', "created": "2020", "subjects": ["x, y", "z"], "narrative": "# Text\n\n---\nmore", "rights": None}
    assert finding_aids.write(spark, home, row) and not finding_aids.write(spark, home, row)
    assert finding_aids.listed(spark, home)[0] == {"id": "c", "description": None, "creator": None, "dates": None, "curator": None} | row
    assert finding_aids.seed(spark, home, "c", {"name": "other", "rights": "free"})["rights"] == "free"
    assert finding_aids.listed(spark, home)[0]["name"] == 'A "name": yes'
    assert finding_aids.split_front_matter("---\nname: x\nno end") == ("", "---\nname: x\nno end")
    assert finding_aids.parse("k", "\ufeff---\r\nname: 'it''s'\r\nsubjects: [a, b]\r\n---\r\nbody")["subjects"] == ["a", "b"]
    with pytest.raises(ValueError, match="malformed"):
        finding_aids.parse("k", "---\n  nested\n---\n")
    assert finding_aids.table(spark, home).first()["id"] == "c"


def test_image_choice(spark):
    from webquarry.operators import images

    html = "<meta name='twitter:image' content='/t.png'><img src='a.png'><img srcset='b.png 2x, c.png 3x'><img src='//cdn.net/d.png'>"
    pages = spark.createDataFrame([(i, f"http://www.site.co.uk/p{i}/", html) for i in range(6)], "id int, url string, html string")
    at = "http://www.site.co.uk/"
    cdx = [
        (0, 0, "urn:thumbnail:http://www.site.co.uk/p0", "image/jpeg", 10), (0, 1, "urn:view:http://www.site.co.uk/p0/", "image/png", 99),
        (1, 0, at + "t.png", "image/png", 7), (1, 1, at + "p1/a.png", "image/png", 9000),
        (2, 0, at + "p2/a.png", "image/png", 6000), (2, 1, at + "p2/b.png", "image/png", 8000), (2, 2, "http://cdn.net/d.png", "image/svg+xml", 9000),
        (3, 0, "http://img.site.co.uk/z.png", "image/png", 5000), (3, 1, "http://other.co.uk/z.png", "image/png", 9000),
        (4, 0, at + "p4/a.png", "image/png", 12), (5, 0, at + "t.png", "image/png", 7),
    ]
    found = images.chosen(pages, spark.createDataFrame(cdx, "id int, seq bigint, url string, mime string, length bigint"), spark.createDataFrame([(5, "pin.jpg")], "id int, image_url string"))
    assert {r["id"]: (r["kind"], r["image_url"]) for r in found.collect()} == {0: ("thumbnail", cdx[0][2]), 1: ("declared", at + "t.png"), 2: ("embedded", at + "p2/b.png"), 3: ("site", "http://img.site.co.uk/z.png"), 5: ("pinned", "pin.jpg")}


def test_streamed_batches_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    import webquarry.queries_archives as Q

    spark.createDataFrame([(i, f"http://a.org/{i}", "<html><body>x</body></html>") for i in range(60)], "page_id bigint, url string, html string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(Q, "scratch", lambda spark: str(tmp_path))
    monkeypatch.setattr(Q.streams, "ingest_stream", lambda *a: (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        Q.streamed_crawls(spark, str(tmp_path))
    assert len(list(tmp_path.glob("webquarry-stream-*/in/*.parquet"))) > 2


def test_exclusions_alone_read_the_index(spark, sf):
    found = entry.queries()["exclusions_alone"](spark, sf)
    assert any("/postings/" in f for f in found.inputFiles())


def test_field_statistics_read_the_pages(spark, sf):
    assert any("pages.parquet" in f for f in entry.queries()["field_statistics"](spark, sf).inputFiles())


def test_compacted_index_searches_what_compaction_wrote(spark, sf, tmp_path, monkeypatch):
    import webquarry.queries_archives as Q

    committed, steps, searched, compact, ids = {}, [], [], maintain.compact, S.matched_ids

    def watched(spark, home, **more):
        committed.update(maintain.manifest(spark, home))
        return compact(spark, home, progress=lambda kind, facts: steps.append((kind, facts)), **more)

    monkeypatch.setattr(Q, "scratch", lambda spark: str(tmp_path))
    monkeypatch.setattr(maintain, "compact", watched)
    monkeypatch.setattr(S, "matched_ids", lambda index, q: searched.append(index) or ids(index, q))
    Q.compacted_index(spark, sf)
    now = maintain.manifest(spark, str(next(tmp_path.glob("webquarry-home-*"))))
    assert steps == [("merged", {"segments": 2, "inputs": 3}), ("expunged", {"segments": 2})]
    assert len(committed) == 4 and sum(bool(own.marked.docs) for own in committed.values()) == 2
    assert len(now) == 2 and not set(now) & set(committed) and not any(own.marked.vectors for own in now.values())
    assert sum(own.docs for own in now.values()) == Q.docs(spark, sf).count()
    assert {f.split("segment=")[1].split("/")[0] for f in searched[0].stored.inputFiles()} == set(now)
