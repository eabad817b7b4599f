"""Exact deduplication through a cuckoo-filter index over the digests of live documents.

Digests are dealt to buckets, and each bucket has a cuckoo filter. Every row's digest is looked up in its
bucket's filter: a miss is a new text, for which nothing else has to be done, and its digest goes in; a hit
may be a copy. Only texts of hits are brought together, by digest, and compared byte by byte; texts that
are met once, the most, never move. Copies inside one scan task collapse before anything is shuffled, so
a text that makes up a third of all rows reaches its bucket once for each scan task.

ExactIndex keeps the filters and the live digests between batches. A document that comes again with
another text, or is deleted, takes its digest out of the filter unless another live document has it. A
filter that would be too full is rebuilt at twice the size or more, from the stored digests of its bucket.

Defined results: a null text counts as empty; texts of any length are hashed and compared whole; an empty
table gives an empty result; rows that repeat one doc_id are one document, counted in group_size and marked
alike; a null doc_id ranks below all others; ties don't arise, as only equal ids tie; further columns are
ignored, whatever their names, and kept by `deduplicate`.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm.common import bitmap, columns, cut, discard, fresh, parted, partitions, places, scratch_dir, shuffles_dropped, text_or_empty

#: Rows that a scan task gathers before it collapses equal ones; digests that a new filter has room for; fill at which one is resized.
COLLAPSE_ROWS, ROOM, FULL = 500_000, 1024, 0.85
#: Digests of a bucket, about: a task holds one bucket's filter and the digests that it is resized from.
BUCKET = 200_000


class FilterFull(Exception):
    """No place was found for a fingerprint within the allowed number of moves."""


class CuckooFilter:
    """Partial-key cuckoo hashing: buckets of four 16-bit fingerprints, two candidate buckets for a key."""

    SLOTS, MOVES = 4, 200

    def __init__(self, capacity: int, seed: int = 0):
        self.size = 1 << max(4, (max(1, int(capacity / (self.SLOTS * 0.9))) - 1).bit_length())
        self.slots = [0] * (self.size * self.SLOTS)
        self.count = 0
        self.random = random.Random(seed)

    @property
    def room(self) -> int:
        return int(self.size * self.SLOTS * FULL)

    def dump(self) -> bytes:
        return np.array(self.slots, np.uint16).tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        out = cls(1)
        out.slots = np.frombuffer(data, np.uint16).tolist()
        out.size, out.count = len(out.slots) // cls.SLOTS, sum(x > 0 for x in out.slots)
        return out

    @classmethod
    def of(cls, digests: Iterable[bytes], capacity: int) -> CuckooFilter:
        """A filter of stored digests, of at least that capacity."""
        digests = list(digests)
        capacity = max(capacity, len(digests))
        while True:
            out = cls(capacity)
            try:
                for d in digests:
                    out.insert(d)
                return out
            except FilterFull:
                capacity *= 2

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(digest[8:10], "little") or 1
        one = int.from_bytes(digest[:8], "little") & (self.size - 1)
        return print_, one, self._other(one, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ ((print_ * 0x5BD1E995) & (self.size - 1))

    def _put(self, bucket: int, print_: int) -> bool:
        for i in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
            if not self.slots[i]:
                self.slots[i] = print_
                return True
        return False

    def insert(self, digest: bytes) -> None:
        print_, one, two = self._places(digest)
        if not (self._put(one, print_) or self._put(two, print_)):
            at = self.random.choice((one, two))
            for _ in range(self.MOVES):
                i = at * self.SLOTS + self.random.randrange(self.SLOTS)
                print_, self.slots[i] = self.slots[i], print_
                at = self._other(at, print_)
                if self._put(at, print_):
                    break
            else:
                raise FilterFull
        self.count += 1

    def __contains__(self, digest: bytes) -> bool:
        print_, one, two = self._places(digest)
        s = self.SLOTS
        return print_ in self.slots[one * s : one * s + s] or print_ in self.slots[two * s : two * s + s]

    def delete(self, digest: bytes) -> bool:
        print_, one, two = self._places(digest)
        for bucket in (one, two):
            for i in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if self.slots[i] == print_:
                    self.slots[i] = 0
                    self.count -= 1
                    return True
        return False


# ---------------------------------------------------------------- probing

#: Order of a bucket's rows: its filter, its stored digests (sent only to buckets that must grow), digests that go, rows that come.
FILTER, STORED, GONE, COMES = range(4)
EVENTS = pa.schema([("bucket", pa.int32()), ("op", pa.int32()), ("digest", pa.binary()), ("data", pa.binary()), ("hit", pa.bool_())])


def _probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, op, digest, data) sorted by bucket and op: every coming row with whether its digest hit, and the filters after that."""
    now: int | None = None
    index, stored, since = CuckooFilter(ROOM), {}, []

    def close() -> list[tuple]:
        return [] if now is None else [(now, FILTER, None, index.dump(), None)]

    def grow(size: int) -> CuckooFilter:
        return CuckooFilter.of([*stored, *since], size)

    for b in batches:
        out: list[tuple] = []
        for bucket, op, digest, data in zip(*(b[c].to_pylist() for c in ("bucket", "op", "digest", "data")), strict=True):
            if bucket != now:
                out += close()
                now, index, stored, since = bucket, CuckooFilter(ROOM), {}, []
            if op == FILTER:
                index = CuckooFilter.load(data)
            elif op == STORED:
                stored[digest] = None
            elif op == GONE:
                if stored:
                    del stored[digest]
                index.delete(digest)
            else:
                hit = digest in index
                if not hit:
                    since.append(digest)
                    if stored and len(since) == 1:  # the first to come: the filter is built again with room for all
                        index = grow(2 * index.size * CuckooFilter.SLOTS)
                    else:
                        try:
                            if index.count >= index.room:
                                raise FilterFull
                            index.insert(digest)
                        except FilterFull:
                            index = grow(2 * index.size * CuckooFilter.SLOTS)
                out.append((bucket, COMES, digest, data, hit))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(EVENTS)], schema=EVENTS)
    if last := close():
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in last], f.type) for i, f in enumerate(EVENTS)], schema=EVENTS)


def _keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, digest, mark: SHA-256 and a second hash of the text, by which even texts of one digest would be told apart."""
    body = text_or_empty(text)
    return columns(docs, "doc_id", text).select("doc_id", F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), F.xxhash64(body).alias("mark"))


def _collapsed(keyed: DataFrame) -> DataFrame:
    """digest, mark, doc_id (greatest), n: one row for each text among the rows that a scan task holds at once."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        g = t.append_column("n", pa.array(np.ones(len(t), np.int64))).group_by(["digest", "mark"]).aggregate([("doc_id", "max"), ("n", "sum")])
        yield from pa.table({"digest": g["digest"], "mark": g["mark"], "doc_id": g["doc_id_max"], "n": g["n_sum"]}).combine_chunks().to_batches(10_000)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= COLLAPSE_ROWS:
                yield from flush(held)
                held, rows = [], 0
        if held:
            yield from flush(held)

    return keyed.mapInArrow(run, f"digest binary, mark bigint, doc_id {dict(keyed.dtypes)['doc_id']}, n bigint")


def _bucket(digest: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")


def _verified(docs: DataFrame, hits: DataFrame, text: str) -> None:
    """Compare the texts of every digest that hit; the answer is that equal hashes mean equal texts, or an error.

    Texts whose digest surely didn't hit stay where they are. The test is part of the step in Python that follows: one worker for each task.
    """
    bits = bitmap(hits.select("digest"))
    body = columns(docs, text).select(text_or_empty(text).alias("body")).withColumn("digest", F.unhex(F.sha2(F.col("body").cast("binary"), 256)))
    some = body.select("digest", F.xxhash64("body").alias("mark"), "body", places("digest").alias("at"))

    def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b["at"].to_numpy()
            t = pa.Table.from_batches([b.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))]).drop_columns("at")
            t = t.append_column("at", pa.array(np.arange(len(t))))
            yield from t.take(t.group_by(["digest", "mark", "body"]).aggregate([("at", "min")])["at_min"]).drop_columns("at").combine_chunks().to_batches()

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, content = None, None
        for b in batches:
            bad = []
            for digest, mark, text in zip(b["digest"].to_pylist(), b["mark"].to_pylist(), b["body"], strict=True):
                text = text.as_buffer()
                if (digest, mark) != name:
                    name, content = (digest, mark), text
                elif not content.equals(text):
                    bad.append(digest)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.binary())], names=["digest"])

    kept = some.mapInArrow(once, "digest binary, mark bigint, body string").repartition("digest", "mark").sortWithinPartitions("digest", "mark")
    if kept.mapInArrow(compare, "digest binary").limit(1).count():
        raise ValueError("two texts share SHA-256 and a second hash")


def groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """digest (binary SHA-256), mark, keep_id, group_size: one row for each text that may have copies; all others stand alone."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    coming = cut(_collapsed(_keyed(docs, text)), "digests")
    buckets = max(4 * partitions(spark), -(-coming.count() // BUCKET))
    events = coming.withColumn("bucket", _bucket("digest", buckets)).select("bucket", F.lit(COMES).alias("op"), "digest", F.when(F.col("n") > 1, F.lit(b"copies")).alias("data"))
    probed = events.repartition("bucket").sortWithinPartitions("bucket", "op").mapInArrow(_probe, "bucket int, op int, digest binary, data binary, hit boolean")
    hits = cut(probed.where((F.col("op") == COMES) & (F.col("hit") | F.col("data").isNotNull())).select("digest").distinct(), "hits")
    _verified(docs, hits, text)
    found = coming.join(hits, "digest", "left_semi").groupBy("digest", "mark").agg(F.max("doc_id").cast(kind).alias("keep_id"), F.sum("n").alias("group_size"))
    out = cut(found, "groups")
    discard(coming, hits)
    return out


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    out = _keyed(docs).join(groups(docs), ["digest", "mark"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    names = [fresh(docs, n) for n in ("group_digest", "group_mark", "group_keep")]
    written = groups(docs)
    found = written.select(*[F.col(c).alias(n) for c, n in zip(("digest", "mark", "keep_id"), names, strict=True)])
    digest, mark, keep = (F.col(n) for n in names)
    body = text_or_empty("`text`")
    own = F.unhex(F.sha2(body.cast("binary"), 256))
    some, alone = parted(docs, own, written.select("digest"))
    # a document goes if its text has a group that keeps another
    gone = (own == digest) & (F.xxhash64(body) == mark) & ~some["doc_id"].eqNullSafe(keep)
    return alone.union(some.join(found, gone, "left_anti"))


# ---------------------------------------------------------------- batch by batch


class ExactIndex:
    """Live documents on shared storage: doc_id and digest, and a filter for each bucket of digests. Each batch writes a new version."""

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int = 64):
        self.spark, self.buckets, self.version = spark, buckets, 0
        self.root = root or f"{scratch_dir(spark)}/webquarry-exact-{uuid.uuid4().hex}"

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.version}/{name}")

    def apply(self, docs: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        """Take a batch in, and deletions (doc_id); returns doc_id, hit: whether the text's digest was among the live ones or before it in the batch."""
        spark, kind = self.spark, dict(docs.dtypes)["doc_id"]
        batch = cut(_keyed(docs).dropDuplicates(["doc_id"]).withColumn("bucket", _bucket("digest", self.buckets)), "batch")
        live = self._table("live") if self.version else spark.createDataFrame([], f"doc_id {kind}, digest binary, mark bigint, bucket int")
        leaving = batch.select("doc_id") if gone is None else batch.select("doc_id").union(gone.select(F.col("doc_id").cast(kind)))
        stay = live.join(leaving.distinct(), "doc_id", "left_anti").select(live.columns)
        # a digest dies with its last live document
        dead = live.join(leaving.distinct(), "doc_id", "left_semi").select("bucket", "digest").distinct().join(stay.select("digest").distinct(), "digest", "left_anti")
        event = lambda df, op, data=None: df.select("bucket", F.lit(op).alias("op"), "digest", (F.lit(None).cast("binary") if data is None else data).alias("data"), F.lit(None).cast(kind).alias("doc_id") if "doc_id" not in df.columns else F.col("doc_id"))
        coming = batch.select("bucket", "digest", "doc_id")
        events = event(coming, COMES, F.col("doc_id").cast("string").cast("binary")).union(event(dead, GONE))
        if self.version:
            filters = self._table("filters")
            come = coming.groupBy("bucket").agg(F.count("*").alias("come"))
            growing = filters.join(come, "bucket").where(F.col("count") + F.col("come") > FULL * F.octet_length("data") / 2).select("bucket")
            keys = live.select("bucket", "digest").distinct().join(growing, "bucket", "left_semi")
            events = events.union(event(filters.select("bucket", F.lit(None).cast("binary").alias("digest"), "data"), FILTER, F.col("data"))).union(event(keys, STORED))
        probed = cut(events.drop("doc_id").repartition("bucket").sortWithinPartitions("bucket", "op").mapInArrow(_probe, "bucket int, op int, digest binary, data binary, hit boolean"), "probed")
        at = f"{self.root}/{self.version + 1}"
        with shuffles_dropped(spark):
            stay.union(batch.select(live.columns)).write.parquet(f"{at}/live")
            # filters that nothing touched are carried over by their rows too: each was among the events
            probed.where(F.col("op") == FILTER).select("bucket", "data", F.size(F.filter(F.transform(F.sequence(F.lit(1), (F.octet_length("data") / 2).cast("int")), lambda i: F.hex(F.substr("data", 2 * i - 1, F.lit(2)))), lambda x: x != "0000")).alias("count")).write.parquet(f"{at}/filters")
        discard(batch)
        self.version += 1
        return probed.where(F.col("op") == COMES).select(F.col("data").cast("string").cast(kind).alias("doc_id"), "hit")

    def live(self) -> DataFrame:
        """digest, keep_id, group_size of the live texts."""
        return self._table("live").groupBy("digest", "mark").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).drop("mark")
