"""Removal of repeated word windows through a log-structured fingerprint index.

Fingerprints are sampled by content: of every window of 35 words, the 10-word run with the least hash is
an anchor, so equal windows share an anchor at the same place. The index holds anchors in sorted
immutable runs of (hash, count), bucketed by hash. A new batch of documents is merge-joined with every
run; hashes that history or the batch itself already holds are matches; the batch then becomes a run of
its own, and when runs pile up they are compacted into one. Only windows whose anchor has matched are
verified: a 95-bit digest of all 35 words must be found at a second place. Words under a verified
window go.

Equal texts are told by their SHA-256 first: one of them stands for all in the search for windows, the
others are covered as a whole. Copies inside one task are settled there, so a passage found everywhere
reaches the task of its digest once for each task. Equal digests are looked for inside hash partitions,
never in one place.

Defined results: null and empty texts have no words and keep the hash of nothing; texts shorter than a
window keep all; an empty table gives an empty result; a row is told by its id and text, so ids of several
texts and null ids are rows like any other, and rows that repeat both count as repeats of each other; a very
long text is read whole; ties don't matter, as every place of a repeated window goes; words are compared
unchanged; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm.common import PASS_BYTES, as_i64, columns, cut, delete, discard, mix, padded, partitions, passes, row_key, run_hash, scratch_dir, slide, span_hash, text_buffer, text_or_empty, winnow, word_spans

WINDOW, GRAM = 35, 10
#: Batches that a whole table is fed to the index in, and runs that may lie side by side.
BATCHES, FANOUT = 3, 2
#: Rows that a task gathers before it settles copies among them.
HELD = 1_000_000


class FingerprintIndex:
    """Sorted immutable runs of (h, n) on shared storage, bucketed by h."""

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout, self.buckets = spark, fanout, partitions(spark)
        self.root = root or f"{scratch_dir(spark)}/webquarry-index-{uuid.uuid4().hex}"
        self.runs: list[str] = []
        self.compactions = 0

    def _write(self, counts: DataFrame) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        counts.select("h", "n").sortWithinPartitions("h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.root}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def _read(self, name: str) -> DataFrame:
        """A run without its buckets: a union of bucketed scans claims a partitioning that it doesn't keep, and sums go wrong."""
        return self.spark.read.schema("h bigint, n bigint").parquet(f"{self.root}/{name}")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, f"{self.root}/{name}")

    def add(self, counts: DataFrame) -> DataFrame:
        """Index a batch's (h, n); returns the h that are now known to repeat."""
        run = self._write(counts.groupBy("h").agg(F.sum("n").alias("n")))
        new = self.spark.table(run)
        found = new.where("n > 1").select("h")
        for old in self.runs:
            found = found.union(new.join(self.spark.table(old), "h", "left_semi").select("h"))
        found = cut(found.distinct(), "matches")
        self.runs.append(run)
        if len(self.runs) > self.fanout:
            self.compact()
        return found

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) < 2:
            return
        merged = self._read(self.runs[0])
        for r in self.runs[1:]:
            merged = merged.union(self._read(r))
        run = self._write(merged.groupBy("h").agg(F.sum("n").alias("n")))
        for r in self.runs:
            self._drop(r)
        self.runs = [run]
        self.compactions += 1

    def close(self) -> None:
        for r in self.runs:
            self._drop(r)
        self.runs = []


def _grams(buf: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document of each word, hash of the run of words from each on, and start of each document's words."""
    start, end, doc = word_spans(buf, offsets)
    word = span_hash(padded(buf), start, end - start)
    return doc, run_hash(word, gram), np.searchsorted(doc, np.arange(len(offsets)))


def anchors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """row, pos (index of the anchor's first word), h, batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = text_buffer(b["text"])
            for i, j in passes(offsets, PASS_BYTES):
                doc, h, first = _grams(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], gram)
                at = winnow(h, window - gram + 1)
                own = doc[at]
                ok = (doc[at + gram - 1] == own) & (first[own + 1] - first[own] >= window)
                at, own = at[ok], own[ok]
                yield pa.RecordBatch.from_arrays([b["row"].take(pa.array(own + i)), pa.array((at - first[own]).astype(np.int32)), pa.array(as_i64(h[at])), b["batch"].take(pa.array(own + i))], names=["row", "pos", "h", "batch"])

    ready = docs.select("row", "text", F.pmod(F.xxhash64("row", F.lit("batch")), F.lit(BATCHES)).cast("int").alias("batch"))
    return ready.mapInArrow(run, f"row binary, pos int, h bigint, batch int")


def repeated_anchors(found: DataFrame, batches: int = BATCHES) -> DataFrame:
    """row, at: places of the anchors whose hash occurs twice or more. Every batch goes through the index."""
    index = FingerprintIndex(found.sparkSession)
    known = None
    for k in range(batches):
        hits = index.add(found.where(F.col("batch") == k).select("h", F.lit(1).cast("bigint").alias("n")))
        known = hits if known is None else known.union(hits)
    known = cut(known.distinct(), "repeats")
    index.close()
    marked = cut(found.join(known, "h").select("row", "pos").groupBy("row").agg(F.collect_set("pos").alias("at")), "marked")
    discard(known)
    return marked


def _settled(held: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Windows of one task: those found twice are settled here but for one, which tells the others' tasks."""
    one, two, pos = (np.concatenate([x[k] for x in held]) for k in range(3))
    times = np.concatenate([x[5] for x in held])
    ids = pa.concat_arrays([x[3] for x in held])
    order = np.lexsort((two, one))
    one, two, pos, at = one[order], two[order], pos[order], order
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    start = np.flatnonzero(new)
    n = np.add.reduceat(times[order], start)
    yield pa.RecordBatch.from_arrays([pa.array(as_i64(one[start])), pa.array(two[start]), ids.take(pa.array(at[start])), pa.array(pos[start]), pa.array(np.ones(len(start), np.int32)), pa.array(n.astype(np.int64))], schema=schema)
    rest = np.sort(at[~new])
    if len(rest):  # as runs of neighbours, which are in order within their document
        where = np.concatenate([x[2] for x in held])[rest]
        name = np.concatenate([x[4] for x in held])[rest]
        new = np.ones(len(rest), bool)
        new[1:] = (where[1:] != where[:-1] + 1) | (name[1:] != name[:-1])
        start = np.flatnonzero(new)
        nothing = pa.nulls(len(start), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(as_i64(mix(name[start].astype(np.uint64)))), nothing, ids.take(pa.array(rest[start])), pa.array(where[start]), pa.array(np.diff(np.append(start, len(rest))).astype(np.int32)), pa.array(np.full(len(start), 2, np.int64))], schema=schema)


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one hash partition: the windows whose digest is found twice, and those settled before."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    settled = t.filter(pc.is_null(t["two"]))
    t = t.filter(pc.is_valid(t["two"]))
    one, two, n = t["one"].to_numpy(), t["two"].to_numpy(), t["n"].to_numpy()
    order = np.lexsort((two, one))
    new = np.ones(len(one), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    group = np.cumsum(new) - 1
    many = np.bincount(group, weights=n[order]) > 1 if len(group) else np.zeros(0, bool)
    found = t.take(pa.array(np.sort(order[many[group]]))) if len(group) else t
    for part in (settled, found):
        yield from part.select(["row", "pos", "len"]).combine_chunks().to_batches(50_000)


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(documents with their row keys, row with spans of pos and len: runs of verified windows by their first word; len -1: all)."""
    texts = columns(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"), row_key("doc_id", "text").alias("row"))
    found = cut(anchors(texts, window, gram), "anchors")
    marked = repeated_anchors(found)
    discard(found)
    slim = texts.select("row", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    many = slim.groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = slim.join(many, "digest").groupBy("row").agg(F.max(F.col("row") == F.col("first")).alias("stands"))
    roles = cut(marked.join(copies, "row", "left"), "roles")
    discard(marked)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, named = [], 0, 0
        shape = None
        for b in batches:
            shape = pa.schema([("one", pa.int64()), ("two", pa.int32()), ("row", b.schema.field("row").type), ("pos", pa.int32()), ("len", pa.int32()), ("n", pa.int64())])
            buf, offsets = text_buffer(b["text"])
            lists, times = b["at"], 1 + b["stands"].fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, border = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            for i, j in passes(offsets, PASS_BYTES):
                part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                start, end, doc = word_spans(part, off)
                first = np.searchsorted(doc, np.arange(len(off)))
                wide = padded(part)
                word = span_hash(wide, start, end - start)
                h = run_hash(word, gram)
                if len(word) < window:
                    continue
                flag = np.zeros(len(h), bool)
                flag[flat[border[i] : border[j]] + np.repeat(first[:-1], np.diff(border[i : j + 1]))] = True
                w = window - gram + 1
                hit = slide(np.where(flag, h, np.uint64(2**64 - 1)), w, np.minimum) == slide(h, w, np.minimum)
                at = np.flatnonzero(hit)
                at = at[doc[at] == doc[at + window - 1]]
                other = span_hash(wide, start, end - start, seed=1)
                held.append((run_hash(word, window)[at], (run_hash(other, window)[at] >> np.uint64(33)).astype(np.int32), (at - first[doc[at]]).astype(np.int32), b["row"].take(pa.array(doc[at] + i)), doc[at] + i + named, times[doc[at] + i]))
                size += len(at)
                if size >= HELD:
                    yield from _settled(held, shape)
                    held, size = [], 0
            named += len(b)
        if size:
            yield from _settled(held, shape)

    dealt = texts.join(roles.where("stands is null or stands"), "row").select("row", "text", "at", "stands")
    rows = dealt.mapInArrow(digests, f"one bigint, two int, row binary, pos int, len int, n bigint")
    windows = rows.repartition("one").mapInArrow(_find, f"row binary, pos int, len int")
    whole = roles.where("stands is not null").select("row", F.lit(0).alias("pos"), F.lit(-1).alias("len"))
    # a table of its own, so that the shuffles of this step are gone before texts are shuffled again
    spans = cut(windows.union(whole).groupBy("row").agg(F.collect_set(F.struct("pos", "len")).alias("spans")), "spans")
    discard(roles)
    return texts, spans


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by a space)."""
    kind = dict(docs.dtypes)["doc_id"]
    texts, spans = repeated_windows(docs, window)

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, gone, digest, text = [], [], [], []
            for t, spans in zip(b["text"], b["spans"], strict=True):
                own, removed = t.as_py().encode().split(), 0
                if (spans := spans.as_py()) is not None:
                    keep = np.ones(len(own) + 1, np.int32)
                    edge = np.zeros(len(own) + 1, np.int32)
                    at = np.array([(s["pos"], s["pos"] + s["len"] - 1 + window if s["len"] > 0 else len(own)) for s in spans])
                    np.add.at(edge, at[:, 0], 1)
                    np.add.at(edge, at[:, 1], -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    removed = len(own) - int(keep.sum())
                    left = list(compress(own, keep.tolist()))
                else:
                    left = own
                kept = b" ".join(left)
                words.append(len(own))
                gone.append(removed)
                digest.append(hashlib.sha256(kept).hexdigest())
                text.append(kept.decode())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return texts.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(remove, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
