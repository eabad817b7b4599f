"""Registered packages as a stream of page records.

A registration is a numbered file `incoming/<n>.json` under a home, made once and never changed, so registering is
safe for several writers and needs no lock. The stream's offset is the number of the latest registration: what lies
between two offsets is the same at every reading, and a restart goes on behind the last committed one. Reading a
package is dealt over tasks by inner WARC, or by ranges of large ones, as in batch.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from webquarry.model import RAW_RECORD
from webquarry.sources import wacz, warc
from webquarry.sources.files import Store
from webquarry.sources.packages import open_package
from webquarry.sources.pdf import extract_text

FOLDER = "incoming"
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("crawl_id", "crawl_name", "collection")] + [T.StructField("seq", T.LongType()), *RAW_RECORD.fields])


def registered(spark: SparkSession, home: str) -> list[dict]:
    """All registrations in order."""
    store = Store(spark, home)
    numbers = sorted(int(n.removesuffix(".json")) for n in store.names(FOLDER) if n.endswith(".json"))
    return [json.loads(store.read(f"{FOLDER}/{n}.json")) for n in numbers]


def register(spark: SparkSession, home: str, locations: list[str], collection: str, name: str | None = None) -> list[int]:
    """Register packages that aren't yet; returns their numbers."""
    from webquarry.plans.ingest import crawl_id, display_name
    from webquarry.sources.locations import Source

    store, known = Store(spark, home), {r["source"] for r in registered(spark, home)}
    out, n = [], len(known)
    for location in locations:
        source = Source.parse(location)
        own = location if source.remote or "://" in location or not home.startswith("/") else Source.for_file(location, home).location
        if own in known:
            continue
        row = {"id": crawl_id(own), "name": name or display_name(source), "collection": collection, "source": own, "path": location}
        while not store.create(f"{FOLDER}/{n + 1}.json", json.dumps(row)):
            n += 1  # another writer was first
        n += 1
        known.add(own)
        out.append(n)
    return out


def find_new(spark: SparkSession, home: str, folder: str, collection: str) -> list[int]:
    """Register the packages of a folder that aren't yet, in order of their names."""
    return register(spark, home, [path for path, _ in warc.list_files(folder, (".wacz",))], collection)


class PackageStream(DataSource):
    """readStream.format("wacz_pages"), option home: input for ingest_stream."""

    @classmethod
    def name(cls) -> str:
        return "wacz_pages"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return PackageStreamReader(self.options["home"], int(self.options.get("splitBytes", warc.SPLIT)))


class PackageStreamReader(DataSourceStreamReader):
    def __init__(self, home: str, split: int = warc.SPLIT):
        self.folder, self.split = f"{home.rstrip('/')}/{FOLDER}", split

    def _numbers(self) -> list[int]:
        local = self.folder.removeprefix("file://")
        if "://" not in local and not os.path.isdir(local):
            return []
        return sorted(int(os.path.basename(p).removesuffix(".json")) for p, _ in warc.list_files(self.folder, (".json",)))

    def initialOffset(self) -> dict:
        return {"registered": 0}

    def latestOffset(self) -> dict:
        return {"registered": max(self._numbers(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for n in range(start["registered"] + 1, end["registered"] + 1):
            with warc.open_file(f"{self.folder}/{n}.json") as f:
                row = json.loads(f.read())
            with open_package(row["path"]) as f:
                out += [InputPartition((row, nth, *place)) for nth, place in enumerate([*wacz.inner_files(f, self.split), (None, None, None)])]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        row, nth, inner, low, high = partition.value
        with open_package(row["path"]) as f:
            found = wacz.text_records(f) if inner is None else wacz.scan(f, extract_text, inner, None if low is None else (low, high))
            for seq, record in zip(itertools.count(nth << 40), found):  # noqa: B905 - the count has no end
                yield (row["id"], row["name"], row["collection"], seq, *[record.get(c) for c in RAW_RECORD.names])

    def commit(self, end: dict) -> None:
        """Registrations stay: they are the record of what has come."""


def package_stream(spark: SparkSession, home: str, split: int = warc.SPLIT):
    spark.dataSource.register(PackageStream)
    return spark.readStream.format("wacz_pages").option("home", home).option("splitBytes", str(split)).load()
