"""The stored index: segments behind a manifest, deletion vectors, tiered compaction, fixity, sizes.

Layout of a home: `index/<part>/segment=<name>/` holds the parts of each segment (see textindex);
`manifests/<n>.json` lists the segments of version n, the highest n is in use. A commit writes one new
segment with its crawls and a new manifest; other segments stay as they are, so its cost follows the
commit and not the index. Readers always see a whole version, and a crash leaves the old one. Writers hold
a lock file, which may be taken over once it is old. All files are reached through Hadoop's FileSystem.

A crawl that goes, or is replaced, is marked: the ids of its documents become a deletion vector beside each
segment that holds it (`index/deleted`), and readers leave these out. No posting and no document is written.
Compaction merges the smallest segments first, some dozens at a time, until few are left, and leaves marked
documents behind; segments that still hold such ones are then written again by themselves.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.model import DOCUMENT, guard
from webquarry.plans.textindex import PARTS, Marked, TextIndex, read_part
from webquarry.sources.files import Store
from webquarry.sources.warc import open_file

#: Segments that compaction leaves, segments beyond which ingest asks for it, inputs of one merge, bytes of a merged segment's files.
TARGET, FRAGMENTED, MOST, FILE_BYTES = 8, 48, 32, 256 << 20
#: Seconds after which a lock counts as left by a dead writer.
STALE = 6 * 3600

@dataclass
class Segment:
    """What a manifest says of a segment: its live crawls and documents, and what is marked as deleted in it."""

    crawls: list[str]
    docs: int = 0
    marked: Marked = field(default_factory=Marked)


class Locked(RuntimeError):
    """Another writer is at work."""


@contextlib.contextmanager
def writer(spark: SparkSession, home: str, stale: float = STALE) -> Iterator[None]:
    store, token = Store(spark, home), uuid.uuid4().hex
    if not store.create("WRITER", token):
        if store.age("WRITER") < stale:
            raise Locked(f"{home}/WRITER exists: another writer is at work, or one has died; it is taken over after {stale:.0f} s")
        store.delete("WRITER")
        if not store.create("WRITER", token):
            raise Locked(f"{home}/WRITER was taken over by another writer")
    try:
        yield
    finally:
        if store.read("WRITER") == token:
            store.delete("WRITER")


def _versions(store: Store) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in store.names("manifests") if n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, home: str) -> dict[str, Segment]:
    """Segments of the version in use."""
    store = Store(spark, home)
    found = _versions(store)
    if not found:
        return {}
    rows = json.loads(store.read(f"manifests/{found[-1]}.json"))["segments"]
    return {name: Segment(r["crawls"], r["docs"], Marked(**r["marked"])) for name, r in rows.items()}


def segments(spark: SparkSession, home: str) -> dict[str, list[str]]:
    """Segments of the version in use, with the live crawls of each."""
    return {name: own.crawls for name, own in manifest(spark, home).items()}


def publish(spark: SparkSession, home: str, now: dict[str, Segment]) -> int:
    """Make these segments the version in use. The one before stays readable; segments that neither names go."""
    store = Store(spark, home)
    found = _versions(store)
    n = (found[-1] if found else 0) + 1
    store.put(f"manifests/{n}.json", json.dumps({"segments": {name: asdict(own) for name, own in now.items()}}, sort_keys=True))
    sweep(spark, home)
    return n


def sweep(spark: SparkSession, home: str, keep: int = 2) -> list[str]:
    """Delete manifests but for the latest ones, and all segments that these don't name: also what a crash left."""
    store = Store(spark, home)
    found = _versions(store)
    named = {s for n in found[-keep:] for s in json.loads(store.read(f"manifests/{n}.json"))["segments"]}
    gone = []
    for part in PARTS:
        for name in store.names(f"index/{part}"):
            if name.startswith("segment=") and name.removeprefix("segment=") not in named:
                store.delete(f"index/{part}/{name}")
                gone.append(name.removeprefix("segment="))
    for n in found[:-keep]:
        store.delete(f"manifests/{n}.json")
    return sorted(set(gone))


def _root(home: str) -> str:
    return f"{home.rstrip('/')}/index"


def _marks(now: dict[str, Segment]) -> dict[str, Marked]:
    return {name: own.marked for name, own in now.items() if own.marked.vectors}


def documents(spark: SparkSession, home: str) -> DataFrame:
    """All documents of the version in use, with their full bodies."""
    now = manifest(spark, home)
    if not now:
        return spark.createDataFrame([], DOCUMENT)
    live = TextIndex.live_docs(spark, _root(home), sorted(now), _marks(now))
    return guard(live.drop("lens", "segment"), DOCUMENT)


def open_index(spark: SparkSession, home: str) -> TextIndex:
    if not _versions(Store(spark, home)):
        raise FileNotFoundError(f"{home} has no index yet")
    now = manifest(spark, home)
    return TextIndex.open(spark, _root(home), sorted(now), _marks(now)) if now else TextIndex.of(documents(spark, home))


@dataclass
class Following:
    """An index that follows its home: every read sees the latest version. A version is opened once."""

    spark: SparkSession
    home: str
    version: int = 0
    opened: TextIndex | None = None

    @property
    def index(self) -> TextIndex:
        latest = max(_versions(Store(self.spark, self.home)), default=0)
        if self.opened is None or latest != self.version:
            self.opened, self.version = open_index(self.spark, self.home), latest
        return self.opened


def _marking(spark: SparkSession, home: str, crawls: set[str]) -> dict[str, Segment]:
    """Segments with these crawls marked as deleted; a segment without a live crawl is left out."""
    now = {}
    for name, own in manifest(spark, home).items():
        goes, left = sorted(set(own.crawls) & crawls), sorted(set(own.crawls) - crawls)
        if not goes:
            now[name] = own
        elif left:
            vector = TextIndex.mark(spark, _root(home), name, own.marked, goes)
            now[name] = _less(own, vector, left, goes)
    return now


def _less(own: Segment, vector: tuple[str, int, dict[str, list[int]]], crawls: list[str], gone: list[str]) -> Segment:
    """A segment after a deletion vector: of whole crawls, or (none gone) of single documents."""
    name, docs, totals = vector
    was = own.marked
    sums = {f: [a + b for a, b in zip(was.totals.get(f, [0, 0]), totals[f], strict=True)] for f in totals}
    return Segment(crawls, own.docs - docs, Marked(sorted({*was.crawls, *gone}), [*was.vectors, name], was.by_id if gone else [*was.by_id, name], sums, was.docs + docs))


def _written(spark: SparkSession, home: str, docs: DataFrame) -> dict[str, Segment]:
    """docs as a segment of its own; nothing if there are none."""
    fresh = uuid.uuid4().hex
    TextIndex.write(guard(docs, DOCUMENT), _root(home), fresh)
    return _counted(spark, home, fresh)


def _counted(spark: SparkSession, home: str, name: str) -> dict[str, Segment]:
    own = {r["crawl_id"]: r["n"] for r in read_part(spark, _root(home), "docs", [name]).groupBy("crawl_id").agg(F.count("*").alias("n")).collect()}  # a row for each crawl
    return {name: Segment(sorted(own), sum(own.values()))} if own else {}


def upsert(spark: SparkSession, home: str, docs: DataFrame, crawls: Iterable[str] | None = None) -> int:
    """Replace the documents of some crawls (those in docs, unless named): one new segment and a new manifest."""
    with writer(spark, home):
        fresh = _written(spark, home, docs)
        own = {c for x in fresh.values() for c in x.crawls}
        return publish(spark, home, _marking(spark, home, own | set(crawls or ())) | fresh)


def upsert_documents(spark: SparkSession, home: str, docs: DataFrame) -> DataFrame | None:
    """Add documents, in place of those of the same crawl and id; a crawl's other documents stay. docs is evaluated once.

    Returns the documents as they were written; None, and nothing is published, if there are none.
    """
    with writer(spark, home):
        fresh = _written(spark, home, docs)
        if not fresh:
            return None
        (name, new), now = next(iter(fresh.items())), {}
        ids = read_part(spark, _root(home), "docs", [name]).select("doc_id")
        for other, own in manifest(spark, home).items():
            touched = sorted(set(own.crawls) & set(new.crawls))
            vector = TextIndex.mark(spark, _root(home), other, own.marked, touched, ids) if touched else (None, 0, {})
            if vector[1] < own.docs:
                now[other] = _less(own, vector, own.crawls, []) if vector[1] else own
        publish(spark, home, now | fresh)
        return read_part(spark, _root(home), "docs", [name])


def replace_all(spark: SparkSession, home: str, docs: DataFrame, carried: Iterable[str] = ()) -> int:
    """One new segment in place of all; the crawls named in carried stay as they are."""
    with writer(spark, home):
        fresh, stays = _written(spark, home, docs), set(carried)
        goes = {c for own in manifest(spark, home).values() for c in own.crawls} - stays
        return publish(spark, home, _marking(spark, home, goes) | fresh)


def delete_crawls(spark: SparkSession, home: str, crawls: Iterable[str]) -> int:
    with writer(spark, home):
        return publish(spark, home, _marking(spark, home, set(crawls)))


def delete_crawl(spark: SparkSession, home: str, crawl_id: str) -> int:
    return delete_crawls(spark, home, [crawl_id])


def plan_deletion(crawls: DataFrame, crawl_id: str | None = None, collection: str | None = None) -> DataFrame:
    """What a deletion takes: crawls, and whether each one's file may go (no other crawl uses it, and it is local)."""
    from webquarry.operators.catalog import is_remote

    goes = crawls.where(F.col("id") == crawl_id if crawl_id is not None else F.col("collection") == collection)
    stays = crawls.join(goes.select("id"), "id", "left_anti").select(F.col("source").alias("_used")).distinct()
    marked = goes.join(stays, goes["source"] == stays["_used"], "left")
    return marked.select("id", "source", (F.col("_used").isNull() & ~is_remote("source")).alias("delete_file"))


def fragmented(spark: SparkSession, home: str) -> bool:
    return len(segments(spark, home)) > FRAGMENTED


def merge_plan(docs: dict[str, int], target: int = TARGET, most: int = MOST) -> list[str]:
    """The segments of the next merge, smallest by documents first; none when the target is met."""
    spare = len(docs) - max(1, target)
    return sorted(docs, key=lambda name: (docs[name], name))[: min(most, max(2, spare + 1))] if spare > 0 else []


def compact(spark: SparkSession, home: str, target: int = TARGET, most: int = MOST, files: int | None = None, progress: Callable[[str, dict], None] = lambda kind, facts: None) -> tuple[int, int]:
    """Merge smallest segments first until `target` are left, then write those again that hold marked documents.

    Postings are moved and no text is read again. Every merge is a version of its own, so a run that breaks off keeps
    what it did. files: how many files a merged segment's documents lie in; by its bytes unless given. Returns the
    numbers of segments before and after.
    """
    with writer(spark, home):
        store, before = Store(spark, home), len(manifest(spark, home))

        def merged(now: dict[str, Segment], names: list[str]) -> dict[str, Segment]:
            size = sum(n for name in names for _, n in store.files(f"index/docs/segment={name}", ".parquet"))
            fresh = uuid.uuid4().hex
            TextIndex.merge(spark, _root(home), names, fresh, marks=_marks({n: now[n] for n in names}), files=files or -(-size // FILE_BYTES))
            return {n: own for n, own in now.items() if n not in names} | _counted(spark, home, fresh)

        now = manifest(spark, home)
        while names := merge_plan({n: own.docs for n, own in now.items()}, target, most):
            now = merged(now, names)
            publish(spark, home, now)
            progress("merged", {"segments": len(now), "inputs": len(names)})
        for name in [n for n, own in now.items() if own.marked.vectors]:
            now = merged(now, [name])
            publish(spark, home, now)
            progress("expunged", {"segments": len(now)})
        return before, len(now)


def index_files(spark: SparkSession, home: str) -> list[tuple[str, int]]:
    """(part, bytes) of the files of the version in use."""
    now, store = segments(spark, home), Store(spark, home)
    return [(part, size) for part in PARTS for name in sorted(now) for _, size in store.files(f"index/{part}/segment={name}", ".parquet")]


def index_stats(spark: SparkSession, home: str) -> DataFrame:
    """Files and bytes of the current version by part, largest first."""
    rows = index_files(spark, home)
    return spark.createDataFrame(rows, "part string, bytes bigint").groupBy("part").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "part")


def index_summary(spark: SparkSession, home: str, at: tuple[int, ...] = (1_000_000, 100_000_000)) -> dict:
    """Segments, documents, bytes and bytes for each document, and the size at other numbers of documents in proportion."""
    docs, size = documents(spark, home).count(), sum(n for _, n in index_files(spark, home))
    each = size / docs if docs else 0.0
    return {"segments": len(segments(spark, home)), "docs": docs, "bytes": size, "bytes_per_doc": each, "projected": {n: int(each * n) for n in at}}


# ---------------------------------------------------------------- fixity


def file_sha256(path: str) -> str:
    h = hashlib.sha256()
    with open_file(path) as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()


def verify(crawls: DataFrame, home: str) -> DataFrame:
    """id, state (ok, modified, missing, remote): files are hashed by the executors, one task each.

    Files lie under home or at paths and URIs of their own, in any store that Arrow knows.
    """
    from webquarry.operators.catalog import is_remote

    @F.pandas_udf("string")
    def state(paths: pd.Series, expected: pd.Series) -> pd.Series:
        def one(p: str, want: str | None) -> str:
            full = p if os.path.isabs(p) or "://" in p else f"{home.rstrip('/')}/{p}"
            try:
                return "ok" if file_sha256(full) == want else "modified"
            except FileNotFoundError:
                return "missing"

        return pd.Series([one(p, w) for p, w in zip(paths, expected, strict=True)], dtype=object)

    local = crawls.where(~is_remote("source")).repartition("id")
    checked = local.select("id", state("source", "sha256").alias("state"))
    return checked.unionByName(crawls.where(is_remote("source")).select("id", F.lit("remote").alias("state")))


def fixity_summary(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count("*").alias("n"))
