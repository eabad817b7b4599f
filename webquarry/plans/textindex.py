"""Postings, terms and corpus statistics.

Postings are (field, term, doc_id, tf, len, positions), terms (term, field, df), statistics (field, n_docs,
total_len). A stored index is a set of segments. Postings and terms are partitioned by a hash of the term
and sorted by term, so a query's terms prune them to a few folders and row groups; documents are one
columnar table, of which a query reads the columns it needs.

Beside the postings lie bounds: for each term, field and block (a range of document ids that holds some
BLOCK_DOCS documents) the greatest tf and the least length, and how many postings. Blocks have the same borders
for all terms of a segment, so a query's bounds add up by block.

Documents that are marked as deleted stay in their segment's files and are left out by readers: of the
documents' table by a pushed filter on the crawl (an anti-join where single documents were replaced), of
postings and frequencies by the segment's deletion vectors (tables of ids), of the statistics by their sums,
which the manifest holds. An id may be live in one segment and marked in another, so vectors hold for their
own segment alone.
"""

from __future__ import annotations

import contextlib
import zlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.functions.scalars import tokens
from webquarry.model import POSITIONAL, TEXT_FIELDS

BUCKETS = 64
PARTS = ("docs", "totals", "postings", "terms", "bounds", "deleted")
#: Documents of a block.
BLOCK_DOCS = 1024
#: Tokens whose postings a task sorts and writes, on average; bytes of a row group of documents.
PART_TOKENS, ROW_GROUP = 1 << 20, 8 << 20
#: Tasks that share the buckets' files of a small segment.
LEAST_PARTS = 8
#: Settings of the tasks that make postings: bytes that they read of documents, bytes of a batch that goes to Python, and open files, so that no sort by bucket is needed.
SMALL = {"spark.sql.files.maxPartitionBytes": "8m", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.maxConcurrentOutputFileWriters": str(BUCKETS)}


def bucket_of(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def field_tokens(docs: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """doc_id, field, tokens: narrow, no shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(f).alias("tokens")) for f in fields]))
    return docs.select("doc_id", each.alias("f")).select("doc_id", "f.field", "f.tokens").where(F.size("tokens") > 0)


def postings(docs: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """All postings, or those of some terms: then other terms are dropped before anything is shuffled."""
    lists = field_tokens(docs)
    if terms is not None:  # the lists of a document stay in one row: no shuffle at all
        wanted = F.array(*[F.lit(t) for t in sorted(set(terms))]) if terms else F.array().cast("array<string>")
        found = F.array_intersect("tokens", wanted)
        rows = lists.where(F.arrays_overlap("tokens", wanted)).select("doc_id", "field", "tokens", F.explode(found).alias("term"))
    else:
        rows = lists.select("doc_id", "field", "tokens", F.explode(F.array_distinct("tokens")).alias("term"))
    places = F.filter(F.transform("tokens", lambda t, i: F.when(t == F.col("term"), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("places", places)
    return rows.select("field", "term", "doc_id", F.size("places").alias("tf"), F.size("tokens").alias("len"), F.when(F.col("field").isin(*POSITIONAL), F.col("places")).alias("positions"))


def all_postings(docs: DataFrame) -> DataFrame:
    """The whole index: a document's tokens stand in one row, so its postings are gathered in its task. No shuffle, linear in the tokens."""
    found = field_tokens(docs).mapInArrow(_gathered, "field string, term string, doc_id bigint, tf int, len int, places array<int>")
    return found.select("field", "term", "doc_id", "tf", "len", F.when(F.col("field").isin(*POSITIONAL), F.col("places")).alias("positions"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of tokens to their terms, each with its places in ascending order. A batch's postings come sorted: shuffles squeeze them better, and sorts find long runs."""
    for b in batches:
        lists = b["tokens"]
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words, fields = lists.flatten().dictionary_encode(), b["field"].dictionary_encode()
        codes, row = words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        kind = _ranks(words.dictionary)[codes] * len(fields.dictionary) + _ranks(fields.dictionary)[fields.indices.to_numpy()][row]
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = kind * len(sizes) + row
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        ends = np.append(starts[1:], len(order))
        own, term = pa.array(row[order[starts]]), pa.array(codes[order[starts]])
        places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
        columns = [b["field"].take(own), words.dictionary.take(term), b["doc_id"].take(own), pa.array((ends - starts).astype(np.int32)), pa.array(sizes[own].astype(np.int32)), places]
        yield pa.RecordBatch.from_arrays(columns, names=["field", "term", "doc_id", "tf", "len", "places"])


def _ranks(words: pa.Array) -> np.ndarray:
    """The place of each word in the order of their bytes."""
    out = np.empty(len(words), np.int64)
    out[pc.array_sort_indices(words).to_numpy()] = np.arange(len(words))
    return out


def _bounds(low: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted postings to a row for each run of a term, field and block. A file that two tasks read may give a run in two rows: looser, but bounds."""

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            block = pa.array((b["doc_id"].to_numpy(zero_copy_only=False) - low) // width * width + low).cast("int64")
            keys = [c.to_numpy(zero_copy_only=False) for c in (b["term"].dictionary_encode().indices, b["field"].dictionary_encode().indices, block)]
            starts = np.append(0, np.flatnonzero(reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])) + 1)
            first = pa.array(starts)
            own = [b["term"].take(first), b["field"].take(first), block.take(first)]
            n, tf, least = np.diff(np.append(starts, b.num_rows)), np.maximum.reduceat(b["tf"].to_numpy(), starts), np.minimum.reduceat(b["len"].to_numpy(), starts)
            if held is not None and all(c[0] == h[0] for c, h in zip(own, held.columns, strict=False)):
                n[0], tf[0], least[0] = n[0] + held["n"][0].as_py(), max(tf[0], held["tf"][0].as_py()), min(least[0], held["len"][0].as_py())
            elif held is not None:
                yield held
            out = pa.RecordBatch.from_arrays([*own, pa.array(n.astype(np.int64)), pa.array(tf), pa.array(least)], names=["term", "field", "low", "n", "tf", "len"])
            held = out.slice(out.num_rows - 1)
            yield out.slice(0, out.num_rows - 1)
        if held is not None:
            yield held

    return run


def statistics(docs: DataFrame) -> DataFrame:
    """field, n_docs (all documents), avg_len (over all documents)."""
    sizes = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(tokens(f)).alias("n")) for f in TEXT_FIELDS]))
    return docs.select(sizes.alias("f")).groupBy("f.field").agg(F.count("*").alias("n_docs"), F.avg("f.n").alias("avg_len"))


def lengths(docs: DataFrame) -> DataFrame:
    """docs with lens, the tokens of each text field in the order of TEXT_FIELDS."""
    return docs.withColumn("lens", F.array(*[F.size(tokens(f)) for f in TEXT_FIELDS]))


def _totals(with_lens: DataFrame) -> DataFrame:
    sums = with_lens.agg(F.count("*").alias("n_docs"), *[F.coalesce(F.sum(F.col("lens")[i]), F.lit(0)).cast("bigint").alias(f) for i, f in enumerate(TEXT_FIELDS)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("n_docs"), F.col(f).alias("total_len")) for f in TEXT_FIELDS])).alias("s")).select("s.*")


@dataclass
class Marked:
    """Documents of a segment that are deleted: of which crawls, in which vectors (by_id: those of single documents), the (documents, length) they had of each field, and their number."""

    crawls: list[str] = field(default_factory=list)
    vectors: list[str] = field(default_factory=list)
    by_id: list[str] = field(default_factory=list)
    totals: dict[str, list[int]] = field(default_factory=dict)
    docs: int = 0


@dataclass
class TextIndex:
    """What a search reads. With `source` set, postings are made on the fly for the query's terms alone.

    deleted: (segment, doc_id) of the documents that are marked, in the segments named by marked_in.
    """

    docs: DataFrame
    totals: DataFrame
    stored: DataFrame | None = None
    terms: DataFrame | None = None
    source: DataFrame | None = None
    deleted: DataFrame | None = None
    marked_in: tuple[str, ...] = ()
    bounds: DataFrame | None = None
    #: Where the leaves of recent phrase queries stand, persisted by their leaves: a phrase's frequency and scores come from one grouping.
    kept: dict[tuple, DataFrame] = field(default_factory=dict, compare=False)

    #: Frequencies of terms that were asked for: an index is one version, which doesn't change.
    counted: dict[str, dict[str, int]] = field(default_factory=dict, compare=False)

    KEPT: ClassVar[int] = 8
    COUNTED: ClassVar[int] = 10_000

    @classmethod
    def of(cls, docs: DataFrame) -> TextIndex:
        return cls(docs=docs, totals=_totals(lengths(docs)), source=docs)

    @classmethod
    def open(cls, spark: SparkSession, root: str, segments: list[str] | None = None, marks: dict[str, Marked] | None = None) -> TextIndex:
        """All segments under root, or the named ones, without what is marked."""
        marks = marks or {}
        totals, stored, terms, bounds = (read_part(spark, root, part, segments) for part in ("totals", "postings", "terms", "bounds"))
        docs, totals = cls.live_docs(spark, root, segments, marks).drop("lens", "segment"), totals.drop("segment")
        if marks:
            less = [(f, -n, -length) for m in marks.values() for f, (n, length) in m.totals.items()]
            totals = totals.unionByName(spark.createDataFrame(less, "field string, n_docs bigint, total_len bigint"))
        return cls(docs=docs, totals=totals, stored=stored, terms=terms, deleted=vectors(spark, root, marks), marked_in=tuple(sorted(marks)), bounds=bounds)

    @staticmethod
    def live_docs(spark: SparkSession, root: str, segments: list[str] | None, marks: dict[str, Marked]) -> DataFrame:
        """The documents' table without what is marked: whole crawls by a filter that reaches the scan, single documents by their vectors."""
        docs = read_part(spark, root, "docs", segments)
        own = F.col("segment").cast("string")
        for name, m in sorted(marks.items()):
            if m.crawls:
                docs = docs.where((own != name) | F.col("crawl_id").isNull() | ~F.col("crawl_id").isin(*m.crawls))
        single = {name: Marked(vectors=m.by_id) for name, m in marks.items() if m.by_id}
        return _unmarked(docs.withColumn("segment", own), vectors(spark, root, single), tuple(single)) if single else docs

    @classmethod
    def mark(cls, spark: SparkSession, root: str, segment: str, marked: Marked, crawls: list[str], ids: DataFrame | None = None) -> tuple[str, int, dict[str, list[int]]]:
        """Write the ids of these crawls' live documents (those of ids alone, if given) as a deletion vector: its name, how many, and their sums by field."""
        goes = cls.live_docs(spark, root, [segment], {segment: marked}).where(F.col("crawl_id").isin(*crawls))
        if ids is not None:
            goes = goes.join(ids.select("doc_id"), "doc_id", "left_semi")
        name = uuid.uuid4().hex
        at = f"{root}/deleted/segment={segment}/vector={name}"
        goes.select("doc_id", "lens").write.parquet(at)
        sums = {r["field"]: [r["n_docs"], r["total_len"]] for r in _totals(spark.read.schema("doc_id bigint, lens array<int>").parquet(at)).collect()}  # a row for each field
        return name, max((n for n, _ in sums.values()), default=0), sums

    @staticmethod
    def write(docs: DataFrame, root: str, segment: str = "0") -> None:
        """One segment. docs is evaluated once; all else is made from what was written."""
        spark = docs.sparkSession
        lengths(docs).write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{root}/docs/segment={segment}")
        written = spark.read.parquet(f"{root}/docs/segment={segment}")
        _write_terms(written, all_postings(written), root, segment)

    @classmethod
    def merge(cls, spark: SparkSession, root: str, segments: list[str], segment: str, marks: dict[str, Marked] | None = None, files: int | None = None) -> None:
        """One segment out of several, without what is marked; postings move, no text is read again."""
        docs = cls.live_docs(spark, root, segments, marks or {}).drop("segment")
        (docs.repartition(files) if files else docs).write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{root}/docs/segment={segment}")
        written = spark.read.parquet(f"{root}/docs/segment={segment}")
        rows = _unmarked(read_part(spark, root, "postings", segments), vectors(spark, root, marks or {}), tuple(marks or ()))
        _write_terms(written, rows.drop("segment", "bucket"), root, segment)

    @cached_property
    def averages(self) -> dict[str, tuple[int, float]]:
        """(documents, average length) of each field: one row for each of the fixed fields."""
        rows = self.totals.groupBy("field").agg(F.sum("n_docs").alias("n"), F.sum("total_len").alias("len")).collect()
        return {r["field"]: (r["n"], r["len"] / r["n"] if r["n"] else 0.0) for r in rows}

    @property
    def stats(self) -> DataFrame:
        return self.totals.groupBy("field").agg(F.sum("n_docs").alias("n_docs"), (F.sum("total_len") / F.sum("n_docs")).alias("avg_len"))

    def postings(self, terms: list[str]) -> DataFrame:
        if self.stored is None:
            return postings(self.source, terms)
        rows = _unmarked(self._of_terms(self.stored, terms), self.deleted, self.marked_in)
        return rows.select("field", "term", "doc_id", "tf", "len", "positions")

    def frequencies(self, terms: list[str]) -> dict[tuple[str, str], int]:
        """(term, field) -> documents that hold it: at most terms x fields rows come back, and are remembered."""
        missing = sorted({t for t in terms if t not in self.counted})
        if missing:
            if len(self.counted) > self.COUNTED:
                self.counted.clear()
                missing = sorted(set(terms))
            self.counted.update({t: {} for t in missing})
            for r in self._frequencies(missing).collect():
                self.counted[r["term"]][r["field"]] = r["df"]
        return {(t, f): n for t in terms for f, n in self.counted[t].items()}

    def _frequencies(self, terms: list[str]) -> DataFrame:
        if self.terms is None:
            return self.postings(terms).groupBy("term", "field").agg(F.count("*").alias("df"))
        counted = self._of_terms(self.terms, terms).select("term", "field", "df")
        if self.deleted is not None:
            marked = self._of_terms(self.stored, terms).where(F.col("segment").isin(*self.marked_in)).join(self.deleted, ["segment", "doc_id"], "left_semi")
            counted = counted.union(marked.select("term", "field", F.lit(-1).cast("bigint")))
        return counted.groupBy("term", "field").agg(F.sum("df").alias("df"))

    def keep(self, leaves: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        """make(), persisted; the oldest of KEPT ones goes."""
        if leaves not in self.kept:
            while len(self.kept) >= self.KEPT:
                self.kept.pop(next(iter(self.kept))).unpersist()
            self.kept[leaves] = make().persist()
        return self.kept[leaves]

    def blocks(self, terms: list[str]) -> DataFrame:
        """segment, low, high (ids low..high - 1), term, field, n, tf (the greatest), len (the least): marked documents count too."""
        return self._of_terms(self.bounds, terms).select("segment", "low", "high", "term", "field", "n", "tf", "len")

    def within(self, ranges: list[tuple[str, int, int]]) -> TextIndex:
        """The same index with the postings of some (segment, low, high) alone; statistics stay those of the whole."""
        held = [(F.col("segment") == s) & (F.col("doc_id") >= low) & (F.col("doc_id") < high) for s, low, high in ranges]
        return replace(self, stored=self.stored.where(reduce(Column.__or__, held, F.lit(False))), kept={})

    @staticmethod
    def _of_terms(rows: DataFrame, terms: list[str]) -> DataFrame:
        if not terms:
            return rows.where("false")
        return rows.where(F.col("bucket").isin(*{bucket(t) for t in terms}) & F.col("term").isin(*sorted(set(terms))))


def vectors(spark: SparkSession, root: str, marks: dict[str, Marked]) -> DataFrame | None:
    """(segment, doc_id) of what is marked, or nothing."""
    paths = [f"{root}/deleted/segment={name}/vector={v}" for name, m in sorted(marks.items()) for v in m.vectors]
    if not paths:
        return None
    return spark.read.option("basePath", f"{root}/deleted").schema("doc_id bigint, segment string, vector string").parquet(*paths).drop("vector")


def _unmarked(rows: DataFrame, deleted: DataFrame | None, marked_in: tuple[str, ...]) -> DataFrame:
    """Postings of live documents: rows of segments without marks aren't joined with anything."""
    if deleted is None:
        return rows
    own = F.col("segment").isin(*marked_in)
    return rows.where(~own).unionByName(rows.where(own).join(deleted, ["segment", "doc_id"], "left_anti"))


#: Schemas of the partitioned parts: a segment without postings has no file to take one from.
SCHEMAS = {
    "postings": "field string, term string, doc_id bigint, tf int, len int, positions array<int>, segment string, bucket int",
    "terms": "term string, field string, df bigint, segment string, bucket int",
    "bounds": "term string, field string, low bigint, high bigint, n bigint, tf int, len int, segment string, bucket int",
}


def read_part(spark: SparkSession, root: str, part: str, segments: list[str] | None) -> DataFrame:
    paths = [f"{root}/{part}/segment={s}" for s in segments] if segments is not None else [f"{root}/{part}"]
    reader = spark.read.option("basePath", f"{root}/{part}")
    return (reader.schema(SCHEMAS[part]) if part in SCHEMAS else reader).parquet(*paths)


@contextlib.contextmanager
def _small_tasks(spark: SparkSession) -> Iterator[None]:
    """Tasks that make postings read little at a time: what they hold doesn't grow with the files."""
    before = {name: spark.conf.get(name) for name in SMALL}
    for name, value in SMALL.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _dealt(rows: DataFrame, parts: int, spread: Column) -> DataFrame:
    """Rows by their bucket, a bucket's by spread where there are more parts than buckets: no sampling pass, as ranges would need."""
    each = -(-parts // BUCKETS)
    if parts <= BUCKETS:
        return rows.repartitionById(parts, F.col("bucket") % parts)
    return rows.repartitionById(BUCKETS * each, (F.col("bucket") * each + F.pmod(spread, F.lit(each))).cast("int"))


def _write_terms(written: DataFrame, rows: DataFrame, root: str, segment: str) -> None:
    spark = written.sparkSession
    _totals(written).coalesce(1).write.mode("overwrite").parquet(f"{root}/totals/segment={segment}")
    low, high, many, length = written.agg(F.min("doc_id"), F.max("doc_id"), F.count("*"), F.sum(F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, n: a + n))).first()
    low, parts = low or 0, max(LEAST_PARTS, -(-(length or 0) // PART_TOKENS))
    width = ((high or 0) - low) // max(1, -(-many // BLOCK_DOCS)) + 1
    # dealt by blocks of documents: a frequent term spreads over as many tasks as its postings need, and a block's postings of a term follow one another in one file
    dealt = _dealt(rows.withColumn("bucket", bucket_of(F.col("term"))), parts, F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)))
    at = f"{root}/postings/segment={segment}"
    with _small_tasks(spark):
        dealt.sortWithinPartitions("term", "field", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(at)
        each = spark.read.schema(SCHEMAS["postings"]).parquet(at).select("term", "field", "doc_id", "tf", "len")
        bounds = each.mapInArrow(_bounds(low, width), "term string, field string, low bigint, n bigint, tf int, len int")
        bounds = bounds.select(bucket_of(F.col("term")).alias("bucket"), "term", "field", "low", (F.col("low") + width).alias("high"), "n", "tf", "len")
        bounds.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/bounds/segment={segment}")
    by_term = F.shiftright(F.crc32(F.col("term").cast("binary")), 6)
    counted = spark.read.schema(SCHEMAS["bounds"]).parquet(f"{root}/bounds/segment={segment}").groupBy("bucket", "term", "field").agg(F.sum("n").alias("df"))
    _dealt(counted, max(LEAST_PARTS, parts // 4), by_term).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/terms/segment={segment}")
