"""Remote files by byte ranges, with retries that are polite to the host."""

from __future__ import annotations

import io
import os
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable

ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, JITTER = 5, 0.5, 30.0, 0.2
TRANSIENT = (429, 502, 503, 504)
TAIL, AHEAD = 1 << 20, 256 << 10


class Transient(Exception):
    """A failure worth another try; after: seconds the server asks for."""

    def __init__(self, what: str, after: float | None = None):
        super().__init__(what)
        self.after = after


class NoRanges(OSError):
    """The server sends whole files only."""


def retry_after(value: str | None) -> float | None:
    value = (value or "").strip()
    return float(value) if value.isdigit() else None


def with_retry(f: Callable, label: str = "request", sleep: Callable[[float], None] = time.sleep):
    wait = FIRST_WAIT
    for n in range(1, ATTEMPTS + 1):
        try:
            return f()
        except Transient as e:
            if n == ATTEMPTS:
                raise OSError(f"{label}: gave up after {ATTEMPTS} attempts") from e
            base = min(LONGEST_WAIT, wait if e.after is None else e.after)
            sleep(base + random.uniform(0, JITTER * base))
            wait = min(LONGEST_WAIT, 2 * wait)


def get_range(url: str, start: int, end: int, headers: dict[str, str] | None = None) -> tuple[bytes, int | None]:
    """Bytes start..end inclusive and the file's size. Only a 206 will do."""
    request = urllib.request.Request(url, headers={"Range": f"bytes={start}-{end}"} | (headers or {}))
    try:
        with urllib.request.urlopen(request, timeout=60) as r:
            if r.status != 206:
                raise NoRanges(f"{url}: the server doesn't serve byte ranges")
            total = (r.headers.get("Content-Range") or "").rpartition("/")[2]
            return r.read(), int(total) if total.isdigit() else None
    except urllib.error.HTTPError as e:
        if e.code in TRANSIENT:
            raise Transient(str(e), retry_after(e.headers.get("Retry-After"))) from e
        raise
    except urllib.error.URLError as e:
        raise Transient(str(e)) from e


class RangeReader(io.RawIOBase):
    """A remote file that can be sought: keeps its tail, where ZIP directories lie, and reads ahead."""

    def __init__(self, url: str, fetch: Callable[[str, int, int], tuple[bytes, int | None]] = get_range, sleep: Callable[[float], None] = time.sleep):
        self.url, self.at, self.sleep = url, 0, sleep
        self.fetch = lambda a, b: with_retry(lambda: fetch(url, a, b), url, sleep)
        _, size = self.fetch(0, 0)
        if size is None:
            raise OSError(f"{url}: size unknown")
        self.size = size
        start = max(0, size - TAIL)
        self.tail = (start, self.fetch(start, size - 1)[0] if size else b"")
        self.ahead = (0, b"")

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
        n = min(len(into), max(0, self.size - self.at))
        if not n:
            return 0
        for start, data in (self.tail, self.ahead):
            if start <= self.at < start + len(data):
                part = data[self.at - start : self.at - start + n]
                break
        else:
            self.ahead = (self.at, self.fetch(self.at, min(self.size, self.at + max(n, AHEAD)) - 1)[0])
            part = self.ahead[1][:n]
        into[: len(part)] = part
        self.at += len(part)
        return len(part)


def open_any(location: str):
    """A local file or a remote one; an opener for the package sources."""
    if location.startswith(("http://", "https://")):
        return io.BufferedReader(RangeReader(location), AHEAD)
    return open(location.removeprefix("file://"), "rb")


def download(chunks, dest: str) -> int:
    """Write chunks to a .part file, then rename: a partial download never looks complete."""
    part, n = dest + ".part", 0
    with open(part, "wb") as f:
        for c in chunks:
            f.write(c)
            n += len(c)
    os.replace(part, dest)
    return n


def parse_byte_range(header: str, size: int) -> tuple[int, int] | None:
    """First and last byte that a Range header asks for; None where it can't be served."""
    if not header.startswith("bytes=") or "," in header:
        return None
    a, dash, b = header[6:].strip().partition("-")
    if not dash or not (a or b) or any(x and not x.isdigit() for x in (a, b)):
        return None
    start, end = (max(0, size - int(b)), size - 1) if not a else (int(a), min(int(b), size - 1) if b else size - 1)
    return (start, end) if start <= end and start < size else None
