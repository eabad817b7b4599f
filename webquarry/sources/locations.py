"""Where archives come from: a file, a URL, an item of a crawling service or a stream, stored as one string."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of service items; the fields that follow are split at |, the last takes the rest.
SERVICES = ("browsertrix-public", "browsertrix")
#: Prefix of a crawl that came by stream: its records can't be read again.
STREAM = "stream:"


@dataclass(frozen=True)
class Source:
    kind: str  # file, url, stream, or a service
    parts: tuple[str, ...]

    @classmethod
    def parse(cls, s: str) -> Source:
        head, bar, rest = s.partition("|")
        if bar and head in SERVICES and len(p := rest.split("|", 3)) == 4:
            return cls(head, tuple(p))
        if s.startswith(STREAM):
            return cls("stream", (s,))
        return cls("url" if s.startswith(("http://", "https://")) else "file", (s,))

    @classmethod
    def for_file(cls, path: str, home: str) -> Source:
        """Relative to the home where it lies under it."""
        full, base = os.path.realpath(path), os.path.realpath(home)
        return cls("file", (os.path.relpath(full, base) if full.startswith(base + os.sep) else full,))

    @property
    def location(self) -> str:
        return self.parts[0] if self.kind in ("file", "url", "stream") else "|".join((self.kind, *self.parts))

    @property
    def remote(self) -> bool:
        return self.kind != "file"

    def resolve(self, home: str) -> str | None:
        return None if self.remote else os.path.join(home, self.parts[0])


def parsed(location: Column | str) -> Column:
    """kind, host, org, item, resource of a location column."""
    c = F.col(location) if isinstance(location, str) else location
    bits = F.split(c, r"\|", 5)
    service = F.element_at(bits, 1).isin(*SERVICES) & (F.size(bits) == 5)
    kind = F.when(service, F.element_at(bits, 1)).when(c.rlike("^https?://"), "url").when(c.startswith(STREAM), "stream").otherwise("file")
    field = lambda i: F.when(service, F.try_element_at(bits, F.lit(i)))
    return F.struct(kind.alias("kind"), field(2).alias("host"), field(3).alias("org"), field(4).alias("item"), F.when(service, F.try_element_at(bits, F.lit(5))).otherwise(c).alias("resource"))


def source_list(text: str) -> list[str]:
    """One location a line; blanks and # lines are skipped."""
    return [s for line in text.splitlines() if (s := line.strip()) and not s.startswith("#")]
