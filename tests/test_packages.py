"""Splits of compressed archives, random access into deflated entries, and the package source with pushed filters."""

import gzip
import io
import os
import random
import zipfile

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from test_archives import page

from webquarry.sources import packages, wacz, warc


def members(n, seed=1):
    rng = random.Random(seed)
    return [gzip.compress(page(f"http://s.org/{i}", f"<html><title>t{i}</title><body>{rng.randbytes(rng.choice([10, 400, 3000])).hex()}</body></html>")) for i in range(n)]


def test_splits_give_every_record_once(spark, tmp_path):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members(60)))
    whole = [(r["target_uri"], r["offset"], r["record_length"]) for r in warc.read_records(io.BytesIO(path.read_bytes()))]
    assert len(whole) == 60
    for split in (1, 7, 997, 4096, 50_000, 1 << 30):
        if split > 7:
            got = [(r["target_uri"], r["offset"], r["record_length"]) for low, high in warc.split_ranges(path.stat().st_size, split) for r in warc.read_split(io.BytesIO(path.read_bytes()), low, high)]
            assert got == whole
    spark.dataSource.register(warc.WarcDataSource)
    df = spark.read.format("warc").option("splitBytes", "4096").load(str(path))
    assert df.rdd.getNumPartitions() == -(-path.stat().st_size // 4096) > 5
    assert sorted((r["target_uri"], r["offset"], r["record_length"]) for r in df.select("target_uri", "offset", "record_length").collect()) == sorted(whole)
    assert spark.read.format("warc").load(path.as_uri()).count() == 60


def test_an_archive_inside_a_record_is_not_taken_for_the_archive(tmp_path):
    inner = b"".join(members(30, seed=2))  # does not shrink: it lies verbatim in the member around it
    outer = [*members(3), gzip.compress(page("http://s.org/nested", ""), 0), *members(3)]
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://s.org/a.warc.gz\r\nContent-Length: %d\r\n\r\n" % len(inner)
    outer[3] = gzip.compress(head + inner + b"\r\n\r\n", 0)
    data = b"".join(outer)
    low = len(b"".join(outer[:3])) + 500
    with pytest.raises(ValueError, match="splitBytes"):
        list(warc.read_split(io.BytesIO(data), low, len(data)))
    assert len(list(warc.read_split(io.BytesIO(data), 0, len(data)))) == 7


def test_plain_files_are_not_split(spark, tmp_path):
    path = tmp_path / "a.warc"
    path.write_bytes(b"".join(page(f"http://s.org/{i}", "<title>x</title>") for i in range(20)))
    spark.dataSource.register(warc.WarcDataSource)
    df = spark.read.format("warc").option("splitBytes", "100").load(str(path))
    assert df.rdd.getNumPartitions() == 1 and df.count() == 20


def test_deflated_entries_can_be_sought(monkeypatch):
    monkeypatch.setattr(wacz.Inflated, "SPAN", 10_000)
    rng = random.Random(4)
    data = b"".join(rng.choice([b"some words ", b"and others, ", rng.randbytes(3)]) for _ in range(20_000))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", data)
    with zipfile.ZipFile(out) as z:
        f = wacz.entry_file(out, z.getinfo("x"))
        assert f.read() == data and len(f.raw.points) > 10
        for _ in range(60):
            at, n = rng.randrange(len(data) + 10), rng.randrange(5000)
            f.seek(at)
            assert f.read(n) == data[at : at + n]


def package(path, n, compression=zipfile.ZIP_STORED, index=True, seed=1):
    parts, lines, at = members(n, seed), [], 0
    for i, m in enumerate(parts):
        lines.append(f'org,s)/{i} 20240115120000 {{"url": "http://s.org/{i}", "mime": "{"text/html" if i % 2 else "text/plain"}", "status": "{200 if i % 3 else 404}", "filename": "a.warc.gz", "offset": "{at}", "length": "{len(m)}"}}')
        at += len(m)
    with zipfile.ZipFile(path, "w", compression) as z:
        z.writestr("archive/a.warc.gz", b"".join(parts))
        if index:
            z.writestr("indexes/index.cdx.gz", gzip.compress("".join(x + "\n" for x in sorted(lines)).encode()))
        z.writestr("datapackage.json", "{}")
    return path


@pytest.mark.parametrize("compression", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_filters_reach_the_index(spark, tmp_path, compression):
    path = package(str(tmp_path / "p.wacz"), 40, compression)
    reader = packages.PackageReader(path, share=20_000)
    assert list(reader.pushFilters([D.EqualTo(("url",), "http://s.org/7"), D.EqualTo(("digest",), "x")])) == [D.EqualTo(("digest",), "x")]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(reader.partitions()) == 1 and reader.fetched == 1 and len(rows) == 1 and b"<title>t7</title>" in rows[0][9]
    assert len(packages.PackageReader(path, share=20_000).partitions()) > 1
    df = packages.captures(spark, path, share=20_000)
    assert df.count() == 40
    one = df.where("url = 'http://s.org/7'")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert [r["status"] for r in one.collect()] == [200] and "Filter" not in plan(one)  # the reader has taken it
    assert "Filter" in plan(df.where("digest = 'x'"))
    for where, keep in {"status = 404": lambda i: i % 3 == 0, "mime = 'text/html' and status >= 200 and status < 300": lambda i: i % 2 and i % 3, "url in ('http://s.org/1', 'http://s.org/39', 'nowhere')": lambda i: i in (1, 39), "url like 'http://s.org/3%'": lambda i: str(i)[0] == "3", "status = 404 or mime = 'text/html'": lambda i: i % 3 == 0 or i % 2}.items():
        assert {r["url"] for r in df.where(where).select("url").collect()} == {f"http://s.org/{i}" for i in range(40) if keep(i)}, where


def test_packages_without_index_and_inside_packages(spark, tmp_path):
    package(str(tmp_path / "a.wacz"), 12, index=False)
    inner = package(str(tmp_path / "inner.bin"), 9, zipfile.ZIP_DEFLATED)
    with zipfile.ZipFile(tmp_path / "b.wacz", "w", zipfile.ZIP_DEFLATED) as z:
        z.write(inner, "inner.wacz")
    os.remove(inner)
    df = packages.captures(spark, str(tmp_path))
    seen = {(r["path"].rpartition("/")[2], r["n"]) for r in df.groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert seen == {("a.wacz", 12), ("b.wacz!inner.wacz", 9)}
    assert df.where("status = 200 and url = 'http://s.org/4'").count() == 2


def test_ranges_of_an_inner_file_keep_the_order(spark, tmp_path):
    path = package(str(tmp_path / "p.wacz"), 50)
    with open(path, "rb") as f:
        assert len(wacz.inner_files(f, 4096)) > 5
    one = spark.createDataFrame([("c", path)], "crawl_id string, path string")
    rows = wacz.page_records(spark, one, split=4096)
    assert rows.rdd.getNumPartitions() > 5
    assert [r["url"] for r in rows.orderBy("seq").collect()] == [f"http://s.org/{i}" for i in range(50)]


def test_stream_of_registered_packages(spark, tmp_path):
    from webquarry.operators import documents, maintain
    from webquarry.plans import ingest
    from webquarry.sources import package_stream as P
    from webquarry.streaming.ingest import ingest_stream

    home, folder = str(tmp_path / "home"), tmp_path / "in"
    folder.mkdir()
    first = package(str(folder / "a.wacz"), 8, seed=1)
    assert P.find_new(spark, home, str(folder), "col") == [1] and P.find_new(spark, home, str(folder), "col") == []

    def run():
        q = ingest_stream(P.package_stream(spark, home, split=2048), home, str(tmp_path / "cp"))
        q.awaitTermination()
        return sum(p["numInputRows"] for p in q.recentProgress)

    assert run() == 8 and run() == 0  # a restart reads nothing twice
    package(str(folder / "b.wacz"), 5, zipfile.ZIP_DEFLATED, seed=2)
    package(str(folder / "c.wacz"), 4, index=False, seed=3)
    assert P.find_new(spark, home, str(folder), "col") == [2, 3]
    assert run() == 9 and run() == 0
    known, stored = ingest.Manifest.open(spark, home).rows, maintain.segments(spark, home)
    assert sorted(known) == sorted({c for own in stored.values() for c in own}) == sorted(r["id"] for r in P.registered(spark, home))
    assert sorted(r["source"] for r in known.values()) == sorted(r["source"] for r in P.registered(spark, home))
    # what a batch reading of a package gives
    cid = ingest.crawl_id(P.registered(spark, home)[0]["source"])
    pick = lambda df: sorted((r["doc_id"], r["url"], r["title"], r["body"], r["status"]) for r in df.where("doc_type = 'page'").collect())
    scanned = wacz.page_records(spark, spark.createDataFrame([(cid, first)], "crawl_id string, path string"))
    batch = ingest.as_documents(documents.merge_pages(scanned), "a", "col", ingest.load(home))
    assert pick(maintain.documents(spark, home).where(F.col("crawl_id") == cid)) == pick(batch)
    out = ingest.rebuild(spark, home)
    assert out["indexed"] == 3 and out["carried"] == [] and out["failed"] == []


def test_package_written_by_tasks(spark, tmp_path):
    import hashlib
    import json

    from webquarry.sources.wacz_writer import build_wacz

    paths = [str(tmp_path / n / "x.warc.gz") for n in ("a", "b", "c")]
    for k, path in enumerate(paths):
        os.mkdir(os.path.dirname(path))
        with open(path, "wb") as f:
            f.write(b"".join(members(7 + k, seed=k)))
    out = str(tmp_path / "o.wacz")
    facts = build_wacz(spark, paths, out, title="T")
    assert facts["records"] == facts["cdx_lines"] == 24 and facts["pages"] == 24
    with zipfile.ZipFile(out) as z:
        assert z.testzip() is None
        assert z.namelist() == ["archive/x.warc.gz", "archive/x-2.warc.gz", "archive/x-3.warc.gz", "indexes/index.cdxj", "pages/pages.jsonl", "datapackage.json", "datapackage-digest.json"]
        for r in json.loads(z.read("datapackage.json"))["resources"]:
            data = z.read(r["path"])
            assert (r["bytes"], r["hash"]) == (len(data), "sha256:" + hashlib.sha256(data).hexdigest())
        lines = z.read("indexes/index.cdxj").decode().splitlines()
        assert lines == sorted(lines, key=str.encode) and len(lines) == 24
        assert [z.read(n) for n in z.namelist()[:3]] == [open(p, "rb").read() for p in paths]
        assert json.loads(z.read("datapackage-digest.json"))["hash"] == "sha256:" + hashlib.sha256(z.read("datapackage.json")).hexdigest()
    assert packages.captures(spark, out).where("url = 'http://s.org/8'").count() == 1


@pytest.mark.parametrize("ranges", [True, False])
def test_remote_packages_with_and_without_ranges(spark, tmp_path, ranges):
    import http.server
    import threading

    from webquarry.operators import maintain
    from webquarry.plans import ingest
    from webquarry.sources.http_range import parse_byte_range

    with open(package(str(tmp_path / "p.wacz"), 12), "rb") as f:
        data = f.read()
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            part = parse_byte_range(self.headers.get("Range") or "", len(data)) if ranges else None
            asked.append(part)
            low, high = part or (0, len(data) - 1)
            self.send_response(206 if part else 200)
            if part:
                self.send_header("Content-Range", f"bytes {low}-{high}/{len(data)}")
            self.send_header("Content-Length", str(high - low + 1))
            self.end_headers()
            self.wfile.write(data[low : high + 1])

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    phases = []
    try:
        home = str(tmp_path / "h")
        out = ingest.ingest(spark, home, [f"http://127.0.0.1:{server.server_port}/p.wacz"], "col", progress=lambda kind, facts: phases.append(facts.get("phase")))
    finally:
        server.shutdown()
    assert out["failed"] == [] and maintain.documents(spark, home).where("doc_type = 'page'").count() == 6
    assert ("downloading" in phases) != ranges and os.listdir(os.path.join(home, "downloads")) == [] if not ranges else all(asked)


def test_unreadable_records_are_counted(spark, tmp_path):
    from webquarry.plans import ingest

    path = package(str(tmp_path / "p.wacz"), 10)
    with open(path, "r+b") as f:
        at = f.read().find(members(10)[1]) + 12
        f.seek(at)
        f.write(b"\xff" * 8)  # the second record is damaged
    told = []
    out = ingest.ingest(spark, str(tmp_path / "h"), [path], "col", progress=lambda kind, facts: told.append((kind, facts)))
    facts = dict(told)["indexed"]
    assert out["failed"] == [] and facts["unreadable"] == 1 and facts["pages"] == 4
