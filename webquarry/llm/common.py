"""Shared pieces of the training-data operators: scratch tables and vectorised hashing of texts.

Hashing works on Arrow's own text buffers: a batch of documents is one byte array plus offsets, and
every step (word borders, word hashes, shingles, windows) is a numpy pass over it, so that no Python
code runs for each word.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a numpy pass handles at once; a longer document is a pass of its own.
PASS_BYTES = 2 << 20


#: Set while a table is written: the files of that write's shuffles go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch that goes to a Python worker while a table is written: what a task holds on both sides of the way.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Paths of the tables that cut() made and nothing has deleted yet.
LIVE: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may go without, and gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="webquarry-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/webquarry-{name}-{uuid.uuid4().hex}"
    LIVE.append(path)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The settings of a scratch table's write: its shuffle files go when it ends, and batches for Python are small."""
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), BATCH: spark.conf.get(BATCH)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def small_batches(spark: SparkSession) -> None:
    """From now on batches for Python are small in this session, also when its results are written."""
    spark.conf.set(BATCH, str(BATCH_BYTES))


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """All tables that cut() makes inside go at the end, after a failure too; write a lazy result before that."""
    before = set(LIVE)
    try:
        yield
    finally:
        for path in [p for p in LIVE if p not in before]:
            delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in LIVE:
        LIVE.remove(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns: further ones may bear any name without a clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def row_key(*names: str) -> Column:
    """16 bytes that tell rows apart by these columns, null from any value: ids may repeat, or be null. Rows alike in all of them share a key."""
    each = [F.coalesce(F.concat(F.length(c := F.col(n).cast("string")).cast("string"), F.lit(":"), c), F.lit("-")) for n in names]
    return F.unhex(F.md5(F.concat(*each).cast("binary")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of a bitmap of keys: its size is fixed, whatever the number of keys.
PLACES = 1 << 24


def places(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("place")), F.lit(PLACES))


def bitmap(keys: DataFrame) -> np.ndarray:
    """PLACES bits, as bytes, with the place of every key (the one column of keys) set; put together by the executors."""
    at = keys.select((places(keys.columns[0]) + 1).alias("at"))  # the bitmap functions count from 1
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(PLACES // 8, np.uint8)
    for r in parts:
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["k"] - 1) * len(bits) : r["k"] * len(bits)] |= bits
    return out


def parted(docs: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs whose key may be among the keys, and docs whose key surely isn't.

    A bitmap of fixed size goes to all tasks, so the second part never has to move for a join with keys. The more keys,
    the more documents are in the first part; at worst all are.
    """
    bits, flag = bitmap(keys), fresh(docs, "among")

    @F.pandas_udf("boolean")
    def among(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    flagged = docs.withColumn(flag, among(places(key)))
    return flagged.where(F.col(flag)).drop(flag), flagged.where(~F.col(flag)).drop(flag)


# ---------------------------------------------------------------- numpy


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def trim() -> None:
    """Give freed memory back: a Python worker lives on beside its executor, with all that its allocators keep."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018 - not every C library has it
except (OSError, AttributeError):
    _libc = None


def passes(offsets: np.ndarray, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes each; what the passes have freed is given back after the last."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j
    trim()


def padded(buf: np.ndarray, by: int = 16) -> np.ndarray:
    return np.concatenate([buf, np.zeros(by, np.uint8)])


def loads(buf: np.ndarray) -> np.ndarray:
    """View: the 8 bytes from each position on, as an integer. buf needs 8 bytes of padding."""
    return np.ndarray(shape=(max(0, len(buf) - 7),), dtype="<u8", buffer=buf, strides=(1,))


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word `[^\\x20\\x09-\\x0D]+`; words end where documents do."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = (buf != 0x20) & ((buf - np.uint8(9)) > 4)
    first = word.copy()
    first[1:] &= ~word[:-1]
    border = offsets[:-1][offsets[:-1] < n]
    first[border] = word[border]
    last = word.copy()
    last[:-1] &= ~word[1:]
    border = offsets[1:][offsets[1:] > 0] - 1
    last[border] = word[border]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def span_hash(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes. buf needs 8 bytes of padding."""
    view, h = loads(buf), mix(length.astype(np.uint64) + np.uint64(0x51ED270B + (seed << 32)))
    live, at, left = np.arange(len(start)), start.astype(np.int64), length.astype(np.int64)
    keep = left > 0
    live, at, left = live[keep], at[keep], left[keep]
    while len(live):
        part = view[at]
        short = left < 8
        if short.any():
            part[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[live] = mix(h[live] * np.uint64(0x9FB21C651E98DF25) ^ part)
        keep = left > 8
        live, at, left = live[keep], at[keep] + 8, left[keep] - 8
    return h


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end, document and hash of every word."""
    start, end, doc = word_spans(buf, offsets)
    return start, end, doc, span_hash(padded(buf), start, end - start)


def run_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbours; n - k + 1 values. Built by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    size, cur = 1, h
    while size * 2 <= k:
        cur = pair(cur[:-size], cur[size:])
        size *= 2
    if size < k:
        cur = pair(cur[: len(h) - k + 1], cur[k - size : k - size + len(h) - k + 1])
    return cur


def slide(h: np.ndarray, w: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over each run of w neighbours; n - w + 1 values."""
    size, cur = 1, h
    while size * 2 <= w:
        cur = f(cur[:-size], cur[size:])
        size *= 2
    if size < w:
        n = len(h) - w + 1
        cur = f(cur[:n], cur[w - size : w - size + n])
    return cur


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least value of some run of w neighbours: equal runs select equal places."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    low = slide(h, w, np.minimum)
    edge = np.zeros(w - 1, low.dtype)
    return np.flatnonzero(slide(np.concatenate([edge, low, edge]), w, np.maximum) == h)


def as_i64(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def batch(schema: pa.Schema, cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
