"""Captures of packages as a Spark data source that fetches only what a filter asks for.

spark.read.format("wacz").load(path): one row for each line of a package's capture index, with the record behind it.
Filters on url, mime and status are pushed into the reader, which tests them on the index alone: of the archives,
just the byte ranges of the lines that pass are read, several partitions to a large package. A package without an
index is scanned, WARC by WARC, and its records are tested instead.

path is a package, a folder, a pattern, a URI of a store that Arrow knows, or a http(s) URL that serves byte ranges.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from webquarry.model import _struct
from webquarry.sources import http_range, wacz, warc

CAPTURE = _struct("path string, url string, timestamp string, mime string, status int, digest string, filename string, offset bigint, length bigint, payload binary, http_headers array<struct<name:string,value:string>>")
#: Bytes of archives that one partition of a package covers.
SHARE = 256 << 20

Test = Callable[[dict], bool]


def open_package(path: str) -> BinaryIO:
    return http_range.open_any(path) if path.startswith(("http://", "https://")) else warc.open_file(path)


def _ordered(of: Callable[[object, object], bool]):
    return lambda c, v: lambda line: line[c] is not None and of(line[c], v)


#: How a filter tests one column of an index line.
TESTS: dict[type, Callable[[str, object], Test]] = {
    D.EqualTo: lambda c, v: lambda line: line[c] == v and v is not None,
    D.In: lambda c, v: (lambda some: lambda line: line[c] is not None and line[c] in some)(set(v)),
    D.StringStartsWith: lambda c, v: lambda line: line[c] is not None and line[c].startswith(v),
    D.GreaterThan: _ordered(lambda a, b: a > b),
    D.GreaterThanOrEqual: _ordered(lambda a, b: a >= b),
    D.LessThan: _ordered(lambda a, b: a < b),
    D.LessThanOrEqual: _ordered(lambda a, b: a <= b),
    D.IsNotNull: lambda c, v: lambda line: line[c] is not None,
}
PUSHED = ("url", "mime", "status")


def index_line(text: str) -> dict | None:
    """url, timestamp, mime, status, digest, filename, offset and length of a CDXJ line; None without a url or a place."""
    head, brace, rest = text.strip().partition("{")
    try:
        j = json.loads(brace + rest)
    except ValueError:
        return None
    if not isinstance(j, dict) or not j.get("url"):
        return None
    number = lambda x: int(x) if str(x if x is not None else "").isdigit() else None
    words = head.split()
    line = {"url": j["url"], "timestamp": words[1] if len(words) > 1 else j.get("timestamp") or "", "mime": j.get("mime") or None, "status": number(j.get("status")), "digest": j.get("digest"), "filename": str(j.get("filename") or ""), "offset": number(j.get("offset")), "length": number(j.get("length"))}
    return line if line["offset"] is not None and line["length"] else None


class PackageSource(D.DataSource):
    """format("wacz")."""

    @classmethod
    def name(cls) -> str:
        return "wacz"

    def schema(self):
        return CAPTURE

    def reader(self, schema):
        return PackageReader(self.options.get("path", ""), int(self.options.get("shareBytes", SHARE)))


class PackageReader(D.DataSourceReader):
    def __init__(self, path: str, share: int = SHARE):
        self.path, self.share, self.pushed = path, share, []
        #: Byte ranges that read() has fetched so far in this process.
        self.fetched = 0

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.pushed.append((type(f), f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def _passes(self) -> Test:
        tests = [TESTS[kind](column, value) for kind, column, value in self.pushed]
        return lambda line: all(t(line) for t in tests)

    def partitions(self) -> list[D.InputPartition]:
        files = [(self.path, None)] if self.path.startswith(("http://", "https://")) else warc.list_files(self.path, (".wacz",))
        out = []
        one_place = any(kind is D.EqualTo and column == "url" for kind, column, _ in self.pushed)
        for name, _ in files:
            with open_package(name) as f:
                for inner, size, indexed in _packages(f):
                    shares = 1 if one_place or not indexed else max(1, -(-size // self.share))
                    out += [D.InputPartition((name, inner, k, shares)) for k in range(shares)]
        return out

    def read(self, partition: D.InputPartition) -> Iterator[tuple]:
        name, inner, k, shares = partition.value
        passes = self._passes()
        with open_package(name) as whole:
            f = _inner(whole, inner)
            place = f"{name}!{inner}" if inner else name
            with zipfile.ZipFile(f) as z:
                known = {i.filename.rsplit("/", 1)[-1]: i for i in wacz.entries(z)}
                indexed = wacz.cdx_entry(z) is not None
                lines = self._indexed(f, passes, k, shares, known) if indexed else self._scanned(f, z, passes)
                for line, record in lines:
                    yield (place, *[line[n] for n in CAPTURE.names[1:9]], record["payload"], record["http_headers"])

    def _indexed(self, f: BinaryIO, passes: Test, k: int, shares: int, known: dict) -> Iterator[tuple[dict, dict]]:
        files: dict[str, BinaryIO] = {}
        for text in wacz.read_cdx_lines(f):
            line = index_line(text)
            if line is None or not passes(line) or (line["offset"] // 65536) % shares != k:
                continue
            base = line["filename"].rsplit("/", 1)[-1]
            if base not in known:
                continue
            source = files.setdefault(base, None) or wacz.entry_file(f, known[base])
            files[base] = source
            source.seek(line["offset"])
            self.fetched += 1
            data = source.read(line["length"])
            found = warc.record_slice(data, line["offset"]) if data else []
            own = [r for r in found if r["target_uri"] == line["url"]] or found
            if own:
                yield line, own[0]

    def _scanned(self, f: BinaryIO, z: zipfile.ZipFile, passes: Test) -> Iterator[tuple[dict, dict]]:
        for i in wacz.entries(z):
            for r in warc.read_records(wacz.entry_file(f, i)):
                if not r["target_uri"] or r["warc_type"].lower() in ("request", "warcinfo"):
                    continue
                line = {"url": r["target_uri"], "timestamp": r["timestamp"], "mime": r["content_type"].split(";")[0].strip() or None, "status": r["http_status"], "digest": r["digest"].rpartition(":")[2] or None, "filename": i.filename.rsplit("/", 1)[-1], "offset": r["offset"], "length": r["record_length"]}
                if passes(line):
                    yield line, r


def _packages(f: BinaryIO, at: str = "") -> list[tuple[str, int, bool]]:
    """(place, bytes of its archives, whether it has an index) of a package, or of each one inside it."""
    with zipfile.ZipFile(f) as z:
        own = wacz.entries(z)
        inner = wacz.nested(f, z)
        if inner:
            return [x for name, file in inner for x in _packages(file, f"{at}!{name}" if at else name)]
        return [(at, sum(i.file_size for i in own), wacz.cdx_entry(z) is not None)] if own else []


def _inner(f: BinaryIO, place: str) -> BinaryIO:
    for name in place.split("!") if place else ():
        with zipfile.ZipFile(f) as z:
            f = next(file for n, file in wacz.nested(f, z) if n == name)
    return f


def captures(spark: SparkSession, path: str, share: int = SHARE) -> DataFrame:
    """format("wacz") with filters pushed into it; the session's setting for that is turned on.

    Every row has a url; asking for it gives the reader a filter in any query. Spark keeps a Python reader with its
    relation, and a query that pushes nothing would read with the filters of the query before.
    """
    spark.dataSource.register(PackageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("wacz").option("shareBytes", str(share)).load(path).where("url is not null")
