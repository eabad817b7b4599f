"""WACZ packages: metadata, page texts, indexes, and records by either of two routes.

Where all inner WARCs are stored uncompressed, records are fetched by CDX: the filtered index is a
DataFrame, dealt over tasks, and each task seeks and reads just its byte ranges. Otherwise every inner
WARC is scanned. Packages that hold packages are expanded in place.
"""

from __future__ import annotations

import contextlib
import gzip
import io
import itertools
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.model import RAW_RECORD
from webquarry.sources import warc
from webquarry.sources.html import extract

Opener = Callable[[str], BinaryIO]
PdfText = Callable[[bytes], str | None]
#: Records from the head of an inner WARC among which its warcinfo is looked for.
HEAD_RECORDS = 8


def open_local(path: str) -> BinaryIO:
    return open(path.removeprefix("file://"), "rb")


class Window(io.RawIOBase):
    """A byte range of an open file as a file of its own."""

    def __init__(self, f: BinaryIO, start: int, length: int):
        self.f, self.start, self.length, self.at = f, start, length, 0

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = {0: 0, 1: self.at, 2: self.length}[whence] + to
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, into) -> int:
        n = max(0, min(len(into), self.length - self.at))
        self.f.seek(self.start + self.at)
        data = self.f.read(n)
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


class Inflated(io.RawIOBase):
    """A deflated ZIP entry that can be sought: the inflater's state is kept every SPAN bytes, so memory stays bounded."""

    SPAN = 8 << 20

    def __init__(self, f: BinaryIO, start: int, packed: int, size: int):
        self.f, self.start, self.packed, self.size, self.at = f, start, packed, size, 0
        #: place in the content, place in the packed bytes, state
        self.points = [(0, 0, zlib.decompressobj(-15))]
        self._back(0)

    def _back(self, to: int) -> None:
        self.out, self.used, state = next(p for p in reversed(self.points) if p[0] <= to)
        self.state, self.rest = state.copy(), b""

    def _more(self, most: int) -> bytes:
        while True:
            if not self.rest and self.used < self.packed:
                self.f.seek(self.start + self.used)
                self.rest = self.f.read(min(1 << 16, self.packed - self.used))
                self.used += len(self.rest)
            had = len(self.rest)
            data = self.state.decompress(self.rest, most)
            self.rest = self.state.unconsumed_tail
            self.out += len(data)
            if self.out >= self.points[-1][0] + self.SPAN:
                self.points.append((self.out, self.used - len(self.rest), self.state.copy()))
            if data or self.state.eof or (not had and self.used >= self.packed):
                return data

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = {0: 0, 1: self.at, 2: self.size}[whence] + to
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, into) -> int:
        if self.at < self.out or any(self.out < p[0] <= self.at for p in self.points):
            self._back(self.at)
        while self.out < self.at:
            if not self._more(min(1 << 20, self.at - self.out)):
                return 0
        data = self._more(len(into)) if len(into) else b""
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


def entry_file(f: BinaryIO, info: zipfile.ZipInfo) -> BinaryIO:
    """An entry of an open package as a file that can be sought, however it is stored; nothing is held whole."""
    start = data_start(f, info)
    if info.compress_type == zipfile.ZIP_STORED:
        return io.BufferedReader(Window(f, start, info.file_size))
    if info.compress_type == zipfile.ZIP_DEFLATED:
        return io.BufferedReader(Inflated(f, start, info.compress_size, info.file_size))
    raise ValueError(f"{info.filename}: neither stored nor deflated")


def is_warc(name: str) -> bool:
    return name.startswith("archive/") and name.endswith((".warc", ".warc.gz"))


def data_start(f: BinaryIO, info: zipfile.ZipInfo) -> int:
    """Where an entry's bytes begin: behind its local header, whose lengths may differ from the directory's."""
    f.seek(info.header_offset + 26)
    name, extra = struct.unpack("<HH", f.read(4))
    return info.header_offset + 30 + name + extra


def entries(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return [i for i in z.infolist() if is_warc(i.filename)]


def stored(z: zipfile.ZipFile) -> bool:
    """Whether every inner WARC lies uncompressed, so that byte ranges can be read in place."""
    return bool(entries(z)) and all(i.compress_type == zipfile.ZIP_STORED for i in entries(z))


def nested(f: BinaryIO, z: zipfile.ZipFile) -> list[tuple[str, BinaryIO]]:
    """Inner packages of a package that has no WARCs itself."""
    if entries(z):
        return []
    out = []
    for i in z.infolist():
        if i.filename.endswith(".wacz"):
            out.append((i.filename, entry_file(f, i)))
    return out


def _clean(x) -> str | None:
    return x.strip() or None if isinstance(x, str) else None


def millis(ms) -> str | None:
    return datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ") if isinstance(ms, (int, float)) else None


def read_datapackage(f: BinaryIO) -> dict:
    """Title, description, dates, software, keywords, licenses, creator and seed pages; top level over `metadata`."""
    with zipfile.ZipFile(f) as z:
        try:
            top = json.loads(z.read("datapackage.json"))
        except (KeyError, ValueError):
            top = {}
        top = top if isinstance(top, dict) else {}
        inner = top.get("metadata") if isinstance(top.get("metadata"), dict) else {}
        pick = lambda k: _clean(top.get(k)) or _clean(inner.get(k))
        software = top.get("software", inner.get("software"))
        many = top.get("contributors") or []
        names = [_clean(c.get("title")) or _clean(c.get("organization")) for c in many if isinstance(c, dict)]
        licenses = [_clean(x.get("title")) or _clean(x.get("name")) or _clean(x.get("path")) for x in top.get("licenses") or [] if isinstance(x, dict)]
        seeds = []
        if "pages/pages.jsonl" in z.namelist():
            for line in z.read("pages/pages.jsonl").decode("utf-8", "replace").splitlines()[1:]:
                try:
                    p = json.loads(line)
                except ValueError:
                    continue
                if isinstance(p, dict) and _clean(p.get("url")):
                    seeds.append({"url": p["url"], "title": _clean(p.get("title")), "ts": _clean(p.get("ts"))})
        return {
            "title": pick("title"),
            "description": pick("description"),
            "created": pick("created") or millis(inner.get("mtime")),
            "modified": pick("modified"),
            "software": [software] if isinstance(software, str) else [s for s in software or [] if isinstance(s, str)],
            "main_page_url": pick("mainPageUrl") or pick("mainPageURL"),
            "keywords": [k for k in map(_clean, top.get("keywords") or inner.get("keywords") or []) if k],
            "licenses": [x for x in licenses if x],
            "creator": _clean(top.get("organization")) or ", ".join(x for x in names if x) or None,
            "seed_pages": seeds,
        }


def read_page_texts(f: BinaryIO) -> Iterator[dict]:
    """Rendered texts of both page lists; lines without url or text are left out."""
    with zipfile.ZipFile(f) as z:
        for name in ("pages/pages.jsonl", "pages/extraPages.jsonl"):
            if name in z.namelist():
                with z.open(name) as lines:
                    for line in lines:
                        try:
                            p = json.loads(line)
                        except ValueError:
                            continue
                        if isinstance(p, dict) and _clean(p.get("url")) and _clean(p.get("text")):
                            yield {"url": p["url"], "ts": p.get("ts") or "", "title": _clean(p.get("title")), "text": p["text"]}


def cdx_entry(z: zipfile.ZipFile) -> str | None:
    return next((n for n in z.namelist() if n.startswith("indexes/") and n.endswith((".cdx.gz", ".cdxj.gz", ".cdx", ".cdxj"))), None)


def read_cdx_lines(f: BinaryIO) -> Iterator[str]:
    """Lines of the capture index, as they are read."""
    with zipfile.ZipFile(f) as z:
        name = cdx_entry(z)
        if name:
            with z.open(name) as e:
                packed = e.peek(2)[:2] == b"\x1f\x8b"
                with gzip.GzipFile(fileobj=e) if packed else contextlib.nullcontext(e) as lines:
                    for line in io.TextIOWrapper(lines, "utf-8", "replace", newline="\n"):
                        yield line.rstrip("\r\n")


def warc_starts(f: BinaryIO) -> dict[str, int]:
    with zipfile.ZipFile(f) as z:
        return {i.filename.rsplit("/", 1)[-1]: data_start(f, i) for i in entries(z) if i.compress_type == zipfile.ZIP_STORED}


def read_warcinfo(f: BinaryIO) -> dict | None:
    """The first warcinfo among the opening records of the inner WARCs, in order: only the head of each is read."""
    with zipfile.ZipFile(f) as z:
        for i in entries(z):
            for k, r in enumerate(warc.read_records(entry_file(f, i))):
                if r["warc_type"] == "warcinfo":
                    return warc.warcinfo(r["payload"])
                if k >= HEAD_RECORDS:
                    break
        for _, inner in nested(f, z):
            if (found := read_warcinfo(inner)) is not None:
                return found
    return None


# ---------------------------------------------------------------- records to pages


def last_modified(headers: list[tuple[str, str]]) -> int | None:
    from email.utils import parsedate_to_datetime

    value = next((v for n, v in headers if n.lower() == "last-modified"), None)
    try:
        return parsedate_to_datetime(value.strip()).year if value else None
    except (TypeError, ValueError):
        return None


def raw_record(r: dict, pdf_text: PdfText | None = None) -> dict | None:
    """What a WARC record gives an index: a page, a PDF or a rendered text; None for the rest."""
    url, none = r["target_uri"], dict.fromkeys(RAW_RECORD.names)
    if not url or url.startswith("dns:"):
        return None
    if url.startswith("urn:"):
        if not url.startswith("urn:text:"):
            return None
        text = r["payload"].decode("utf-8", "replace")
        return none | {"kind": "text", "url": url.removeprefix("urn:text:"), "timestamp": r["timestamp"], "body": text, "title": "", "media_type": "html"} if text.strip() else None
    if r["warc_type"] != "response":
        return None
    kind = (r["content_type"] or "").lower()
    base = none | {"kind": "html", "url": url, "timestamp": r["timestamp"], "status": r["http_status"], "modified": last_modified(r["http_headers"])}
    if "pdf" in kind:
        try:
            text = pdf_text(r["payload"]) if pdf_text else None
        except Exception:  # an unreadable PDF has no text
            text = None
        name = next((s for s in reversed(url.split("?")[0].split("#")[0].split("/")) if s), url)
        return base | {"title": name, "body": text or "", "description": "", "media_type": "pdf"}
    if "html" in kind:
        page = extract(r["payload"].decode("utf-8", "replace"))
        if page["title"] or page["body"] or page["description"]:
            return base | page | {"media_type": "html"}
    return None


def scan(f: BinaryIO, pdf_text: PdfText | None = None, only: str | None = None, part: tuple[int, int] | None = None) -> Iterator[dict]:
    """All page records of a package, inner packages included, WARC by WARC; or those of one inner file, named by its place, or of a range of it."""
    with zipfile.ZipFile(f) as z:
        for name, inner in nested(f, z):
            if only is None or only.startswith(name + "!"):
                yield from scan(inner, pdf_text, only and only.removeprefix(name + "!"), part)
        for i in entries(z):
            if only is not None and i.filename != only:
                continue
            source = entry_file(f, i)
            for r in warc.read_records(source) if part is None else warc.read_split(source, *part):
                if (page := raw_record(r, pdf_text)) is not None:
                    yield page


def inner_files(f: BinaryIO, split: int = warc.SPLIT) -> list[tuple[str, int | None, int | None]]:
    """(place, low, high) of all WARCs of a package, in order: `inner.wacz!archive/a.warc.gz` for those of inner packages.

    A large compressed one that lies uncompressed in its package is several ranges; else low and high are None.
    """
    with zipfile.ZipFile(f) as z:
        out = [(f"{name}!{x}", low, high) for name, inner in nested(f, z) for x, low, high in inner_files(inner, split)]
        for i in entries(z):
            parted = i.file_size > split and i.compress_type == zipfile.ZIP_STORED and entry_file(f, i).read(2) == b"\x1f\x8b"
            out += [(i.filename, low, high) for low, high in (warc.split_ranges(i.file_size, split) if parted else [(None, None)])]
        return out


def page_records(spark: SparkSession, paths: DataFrame, opener: Opener = open_local, pdf_text: PdfText | None = None, split: int = warc.SPLIT) -> DataFrame:
    """crawl_id, seq and a page's columns for every package; paths has crawl_id and path. One task for each inner WARC, or each range of a large one.

    seq orders records as they lie in the package, rendered page texts last.
    """
    shape = pa.schema([("crawl_id", pa.string()), ("seq", pa.int64()), *((n, pa.int32() if n in ("status", "modified") else pa.string()) for n in RAW_RECORD.names)])
    kinds = {"crawl_id": pa.string(), "path": pa.string(), "nth": pa.int64(), "inner": pa.string(), "low": pa.int64(), "high": pa.int64()}

    def list_inner(batches):
        for b in batches:
            rows = []
            for crawl, path in zip(b["crawl_id"].to_pylist(), b["path"].to_pylist(), strict=True):
                with opener(path) as f:
                    rows += [(crawl, path, k, *x) for k, x in enumerate([*inner_files(f, split), (None, None, None)])]  # None: the page texts
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    def run(batches):
        for b in batches:
            for crawl, path, nth, inner, low, high in zip(*(b[c].to_pylist() for c in kinds), strict=True):
                held, seq = [], nth << 40
                with opener(path) as f:
                    found = scan(f, pdf_text, inner, None if low is None else (low, high)) if inner is not None else text_records(f)
                    for page in found:
                        held.append(dict.fromkeys(shape.names) | {"crawl_id": crawl, "seq": seq} | page)
                        seq += 1
                        if len(held) == 500:
                            yield pa.RecordBatch.from_pylist(held, schema=shape)
                            held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=shape)

    tasks = spark.sparkContext.defaultParallelism
    ddl = "crawl_id string, path string, nth bigint, inner string, low bigint, high bigint"
    each = paths.select("crawl_id", "path").repartition(tasks, "path").mapInArrow(list_inner, ddl)
    many = each.count()  # packages' directories alone are read
    return each.coalesce(1).repartition(max(1, many)).mapInArrow(run, _record_ddl())


def text_records(f: BinaryIO) -> Iterator[dict]:
    """A package's page texts as records."""
    for t in read_page_texts(f):
        yield {"kind": "text", "url": t["url"], "timestamp": warc.digits14(t["ts"]), "title": t["title"], "body": t["text"], "media_type": "html"}


def _record_ddl() -> str:
    return "crawl_id string, seq bigint, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in RAW_RECORD.fields)


def fetch_records(places: DataFrame, opener: Opener = open_local, pdf_text: PdfText | None = None, skipped: Accumulator | None = None) -> DataFrame:
    """Page records at (crawl_id, path, at, length, seq): each task seeks to its ranges. Unreadable ones are skipped, and counted in skipped (again if a task runs again)."""
    shape = pa.schema([("crawl_id", pa.string()), ("seq", pa.int64()), *((n, pa.int32() if n in ("status", "modified") else pa.string()) for n in RAW_RECORD.names)])

    def run(batches):
        files: dict[str, BinaryIO] = {}
        for b in batches:
            held = []
            for crawl, path, at, length, seq in zip(*(b[c].to_pylist() for c in ("crawl_id", "path", "at", "length", "seq")), strict=True):
                f = files.setdefault(path, None) or opener(path)
                files[path] = f
                f.seek(at)
                try:
                    found = warc.record_slice(f.read(length))
                except Exception:  # one bad record doesn't stop the rest
                    if skipped is not None:
                        skipped.add(1)
                    continue
                held += [{"crawl_id": crawl, "seq": seq} | p for r in found if (p := raw_record(r, pdf_text)) is not None]
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=shape)
        for f in files.values():
            f.close()

    # record sizes are skewed: deal them by place rather than by file
    return places.repartition(places.sparkSession.sparkContext.defaultParallelism, F.xxhash64("path", "at")).mapInArrow(run, _record_ddl())


def read_package(spark: SparkSession, crawl_id: str, path: str, opener: Opener = open_local, pdf_text: PdfText | None = None, skipped: Accumulator | None = None) -> DataFrame:
    """Page records of one package by whichever route its layout allows. Index and page texts are read by tasks, not here."""
    from webquarry.sources.cdx import parse_cdx, wanted, with_places

    with opener(path) as f, zipfile.ZipFile(f) as z:
        direct = stored(z) and cdx_entry(z) is not None
        starts = warc_starts(f) if direct else {}
    if not direct:
        return page_records(spark, spark.createDataFrame([(crawl_id, path)], "crawl_id string, path string"), opener, pdf_text)
    one = spark.createDataFrame([(path,)], "path string").coalesce(1)

    def index_lines(batches):
        for b in batches:
            for p in b["path"].to_pylist():
                with opener(p) as f:
                    for k, some in enumerate(itertools.batched(read_cdx_lines(f), 10_000)):
                        yield pa.RecordBatch.from_arrays([pa.array(range(k * 10_000, k * 10_000 + len(some)), pa.int64()), pa.array(some, pa.string())], names=["seq", "value"])

    def page_texts(batches):
        for b in batches:
            for p in b["path"].to_pylist():
                with opener(p) as f:
                    for k, some in enumerate(itertools.batched(text_records(f), 500)):
                        yield pa.RecordBatch.from_pylist([{"seq": (1 << 50) + k * 500 + i} | t for i, t in enumerate(some)], schema=pa.schema([("seq", pa.int64()), *((n, pa.string()) for n in ("kind", "url", "timestamp", "title", "body", "media_type"))]))

    numbered = one.mapInArrow(index_lines, "seq bigint, value string")
    places = with_places(wanted(parse_cdx(numbered, keep=("seq",))), spark.createDataFrame(list(starts.items()), "basename string, start bigint"), len(starts))
    found = fetch_records(places.select(F.lit(crawl_id).alias("crawl_id"), F.lit(path).alias("path"), "at", "length", "seq"), opener, pdf_text, skipped)
    late = one.mapInArrow(page_texts, "seq bigint, kind string, url string, timestamp string, title string, body string, media_type string")
    return found.unionByName(late.withColumn("crawl_id", F.lit(crawl_id)), allowMissingColumns=True)
