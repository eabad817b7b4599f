"""WARC records as a Spark data source: spark.read.format("warc").load(path).

Files are told apart by their first bytes, not their names. A gzip file is a series of members; a record
carries the offset and length of its member, which several records may share. A compressed file is split into
byte ranges of `splitBytes` (option), each a partition: a range has the members that begin in it, the first of
which is found by a member header that inflates to the begin of a record. Uncompressed files are a partition
each, as a record's payload may hold whole records. Records are emitted as they are parsed, never gathered.
"""

from __future__ import annotations

import glob
import os
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from webquarry.model import WARC_RECORD, WARCINFO

CHUNK = 1 << 16
#: Bytes of a compressed file that one partition reads.
SPLIT = 128 << 20


def digits14(s: str) -> str:
    return re.sub(r"\D", "", s)[:14]


def split_headers(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Header lines and what follows the empty line."""
    for gap in (b"\r\n\r\n", b"\n\n"):
        at = block.find(gap)
        if at >= 0:
            head, rest = block[:at], block[at + len(gap) :]
            break
    else:
        head, rest = block, b""
    lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    pairs = [(n.strip(), v.strip()) for n, colon, v in (line.partition(":") for line in lines[1:]) if colon]
    return [("", lines[0]), *pairs], rest


def http_response(block: bytes) -> tuple[int | None, str | None, list[tuple[str, str]], bytes]:
    """Status, content type (the last one given), headers and body of a response."""
    headers, body = split_headers(block)
    line = headers[0][1].split()
    status = int(line[1]) if len(line) > 1 and line[1].isdigit() else None
    kind = next((v for n, v in reversed(headers[1:]) if n.lower() == "content-type"), None)
    return status, kind, headers[1:], body


def warc_fields(payload: bytes) -> dict[str, str]:
    """application/warc-fields: the first value of each key."""
    out: dict[str, str] = {}
    for line in payload.decode("utf-8", "replace").splitlines():
        name, colon, value = line.partition(":")
        if colon and name.strip() and value.strip():
            out.setdefault(name.strip().lower(), value.strip())
    return out


def warcinfo(payload: bytes) -> dict[str, str | None]:
    f = warc_fields(payload)
    keys = {"software": "software", "operator": "operator", "user_agent": "http-header-user-agent", "is_part_of": "ispartof", "conforms_to": "conformsto", "robots": "robots", "hostname": "hostname"}
    return {n: f.get(keys[n]) for n in WARCINFO.names}


def parse_record(block: bytes, offset: int, length: int) -> dict:
    """One record from its header and content."""
    headers, content = split_headers(block)
    h: dict[str, str] = {}
    for n, v in headers[1:]:
        h.setdefault(n.lower(), v)
    size = h.get("content-length", "")
    if size.isdigit():
        content = content[: int(size)]
    kind = h.get("warc-type", "")
    status, content_type, http, payload = None, h.get("content-type", ""), [], content
    if content_type.replace(" ", "").lower().startswith("application/http") and kind in ("response", "revisit"):
        status, http_type, http, payload = http_response(content)
        content_type = http_type or ""
    return {
        "record_id": h.get("warc-record-id", ""),
        "concurrent_to": h.get("warc-concurrent-to"),
        "target_uri": h.get("warc-target-uri", "").strip("<>"),
        "timestamp": digits14(h.get("warc-date", "")),
        "warc_type": kind,
        "http_status": status,
        "content_type": content_type,
        "digest": h.get("warc-payload-digest") or h.get("warc-block-digest") or "",
        "payload": payload,
        "http_headers": http,
        "offset": offset,
        "record_length": length,
    }


def split_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of each record of uncompressed WARC data."""
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        if at < 0:
            return
        ends = [(e, len(g)) for g in (b"\r\n\r\n", b"\n\n") if (e := data.find(g, at)) >= 0]
        if not ends:
            yield at, data[at:]
            return
        end, gap = min(ends)
        m = re.search(rb"(?im)^content-length:\s*(\d+)", data[at:end])
        stop = end + gap + (int(m.group(1)) if m else 0)
        yield at, data[at:stop]
        at = stop


def gzip_members(f: BinaryIO) -> Iterator[tuple[int, int, bytes]]:
    """Offset, compressed length and content of each member; stops at what is not a member."""
    buf, base = b"", 0
    while True:
        while len(buf) < 2:
            more = f.read(CHUNK)
            if not more:
                break
            buf += more
        if buf[:1] != b"\x1f":
            return
        d, out, used = zlib.decompressobj(31), [], 0
        try:
            while not d.eof:
                if not buf:
                    buf = f.read(CHUNK)
                    if not buf:
                        break
                out.append(d.decompress(buf))
                used += len(buf) - len(d.unused_data)
                buf = d.unused_data
        except zlib.error:
            return
        yield base, used, b"".join(out)
        base += used


def opens_record(data: bytes) -> bool:
    """Whether a gzip member begins here whose content begins like a record. data: some of the file from here on."""
    try:
        return zlib.decompressobj(31).decompress(data, 5) == b"WARC/"
    except zlib.error:
        return False


def first_member(f: BinaryIO, low: int, high: int) -> int | None:
    """Place of the first member with records that begins in low..high - 1."""
    at, buf = low, b""
    f.seek(low)
    while at < high:
        more = f.read(CHUNK)
        buf += more
        found = buf.find(b"\x1f\x8b\x08")
        while 0 <= found and at + found < high:
            if len(buf) - found < CHUNK // 2 and more:
                break  # too little of it is read yet
            if opens_record(buf[found : found + CHUNK]):
                return at + found
            found = buf.find(b"\x1f\x8b\x08", found + 1)
        if not more:
            return None
        keep = found if found >= 0 else max(0, len(buf) - 2)
        at, buf = at + keep, buf[keep:]
    return None


def split_ranges(size: int, split: int = SPLIT) -> list[tuple[int, int]]:
    return [(low, min(size, low + split)) for low in range(0, max(1, size), split)]


def read_split(f: BinaryIO, low: int, high: int) -> Iterator[dict]:
    """Records of the members of a compressed file that begin in low..high - 1."""
    start = first_member(f, low, high) if low else 0
    if start is None:
        return
    f.seek(start)
    end = start
    for offset, length, content in gzip_members(f):
        if start + offset >= high:
            return
        for _, block in split_records(content):
            yield parse_record(block, start + offset, length)
        end = start + offset + length
    f.seek(end)
    if low and end < high and f.read(1):
        # a file inside a record may look like members: rather stop than give its records for the archive's
        raise ValueError(f"members end at byte {end}, before their range does: read this file with splitBytes of its size or more")


def plain_records(f: BinaryIO) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and bytes of each record of an uncompressed file, read record by record."""
    buf, base = b"", 0
    while True:
        while (start := buf.find(b"WARC/")) < 0:
            more = f.read(CHUNK)
            if not more:
                return
            buf += more
        gap = b"\r\n\r\n"
        while (end := buf.find(gap, start)) < 0:
            more = f.read(CHUNK)
            if not more:
                break
            buf += more
        if end < 0:
            end, gap = buf.find(b"\n\n", start), b"\n\n"
            if end < 0:
                return
        m = re.search(rb"(?im)^content-length:\s*(\d+)", buf[start:end])
        stop = end + len(gap) + (int(m.group(1)) if m else 0)
        while len(buf) < stop:
            more = f.read(max(CHUNK, stop - len(buf)))
            if not more:
                break
            buf += more
        yield base + start, stop - start, buf[start:stop]
        base, buf = base + stop, buf[stop:]


def read_records(f: BinaryIO) -> Iterator[dict]:
    """All records of an open file, compressed or not."""
    magic = f.read(2)
    f.seek(0)
    if magic == b"\x1f\x8b":
        for offset, length, content in gzip_members(f):
            for _, block in split_records(content):
                yield parse_record(block, offset, length)
    else:
        for offset, length, block in plain_records(f):
            yield parse_record(block, offset, length)


def record_slice(data: bytes, offset: int = 0, length: int | None = None) -> list[dict]:
    """The records of a byte range that holds one member or record."""
    length = len(data) if length is None else length
    content = zlib.decompressobj(31).decompress(data) if data[:2] == b"\x1f\x8b" else data
    return [parse_record(block, offset, length) for _, block in split_records(content)]


def row(r: dict) -> tuple:
    return tuple(r[n] for n in WARC_RECORD.names)


def open_file(path: str) -> BinaryIO:
    """A file of the shared file system, or of a store that Arrow knows, by its URI."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        return store.open_input_file(at)
    return open(path.removeprefix("file://"), "rb")


def list_files(path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of all files with these endings in a folder, or of those that a pattern names."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        head = path[: len(path) - len(at)]
        info = store.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else [i for i in store.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(endings)]
        return sorted((head + i.path, i.size) for i in found)
    path = path.removeprefix("file://")
    names = [os.path.join(d, n) for d, _, ns in os.walk(path) for n in ns if n.endswith(endings)] if os.path.isdir(path) else glob.glob(path)
    return [(n, os.path.getsize(n)) for n in sorted(names)]


class WarcDataSource(DataSource):
    """format("warc"): path is a file, a folder or a pattern on a file system that executors share, or a URI.

    Option paths: several of these, one a line. Option withPath: the file of each record as a last column, path.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self):
        return T.StructType([*WARC_RECORD.fields, T.StructField("path", T.StringType())]) if self.options.get("withPath") else WARC_RECORD

    def reader(self, schema):
        paths = self.options["paths"].split("\n") if "paths" in self.options else [self.options.get("path", "")]
        return WarcReader(paths, int(self.options.get("splitBytes", SPLIT)), bool(self.options.get("withPath")))


class WarcReader(DataSourceReader):
    def __init__(self, paths: list[str], split: int = SPLIT, with_path: bool = False):
        self.paths, self.split, self.with_path = paths, split, with_path

    def partitions(self) -> list[InputPartition]:
        out = []
        for name, size in [f for path in self.paths for f in list_files(path, (".warc", ".warc.gz"))]:
            ranges = [(0, size)]
            if size > self.split:
                with open_file(name) as f:
                    ranges = split_ranges(size, self.split) if f.read(2) == b"\x1f\x8b" else ranges
            out += [InputPartition((name, low, high, len(ranges) > 1)) for low, high in ranges]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, low, high, parted = partition.value
        with open_file(name) as f:
            for r in read_split(f, low, high) if parted else read_records(f):
                yield (*row(r), name) if self.with_path else row(r)


def read_binary_files(df):
    """Records of files read by spark.read.format("binaryFile"): for stores that only Spark opens."""
    import io

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(WARC_RECORD)

    def run(batches):
        for b in batches:
            for content in b["content"].to_pylist():
                held = []
                for r in read_records(io.BytesIO(content)):
                    held.append({k: ([{"name": n, "value": x} for n, x in v] if k == "http_headers" else v) for k, v in r.items()})
                    if len(held) == 500:
                        yield pa.RecordBatch.from_pylist(held, schema=shape)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=shape)

    return df.select("content").mapInArrow(run, WARC_RECORD)
