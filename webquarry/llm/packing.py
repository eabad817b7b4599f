"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

Documents become pieces of at most `capacity` tokens. Pieces and gaps are taken as classes sorted by length,
not as rows range-sorted over the cluster. One superstep takes the longest pieces that are left, all of one length, and sweeps the gaps upwards for the
successor: the tightest gap that holds them. Conflicts between pieces that want the same gaps are
resolved by rank: the r-th piece of a length takes the r-th place. Then gaps shrink and the next
superstep follows. A sweep needs to know how many pieces have each length and how many sequences have
each gap, never which, so the supersteps run on at most `capacity` counts whatever the input; what they
leave is a plan of rank intervals. Ranks inside a length are taken by all tasks at once, in two levels,
and every piece then finds its place in the plan by binary search. No step is a round of its own over
the data, and nothing that is broadcast grows with the input.

Defined results: a null or empty text is the end token alone; an empty table gives an empty result;
rows that repeat an id are packed each by itself; ties of length go by rank (id and piece in a hashed part);
a text of any length is cut into full pieces, the
first of which may be shorter; further columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webquarry.llm.common import columns, cut, partitions

CAPACITY, END = 2048, 0
#: Words whose ids a worker remembers.
MEMORY = 250_000
#: Split pattern of this vocabulary's byte-level pre-tokenizer (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "It's  a\n\ntest,\tof 123 wörds — «ñandú» isn't <b>¿?</b>\n x"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    """Ids of texts, as little-endian unsigned 32-bit bytes, with the ids of known words remembered.

    The split pattern never joins what stands on two sides of a single space, except that the space goes
    to the word after it; so a text whose white space is single spaces and line ends can be cut there and
    its words looked up. Any other text is encoded whole, and one that names a special token by the tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special, letters = {t["content"] for t in spec.get("added_tokens", ())}, byte_letters()
        self.special = tuple(special)
        self.slow = lambda t: slow.encode(t, add_special_tokens=False).ids
        try:
            ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
            fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            same = fast.encode_ordinary(PROBE) == slow.encode(PROBE, add_special_tokens=False).ids
        except (KeyError, ValueError):
            same = False
        self.quick = same
        self.encode = fast.encode_ordinary if same else self.slow
        self.words = _Words(self.encode)

    def packed(self, text: str) -> bytes:
        if any(x in text for x in self.special):  # such a name in a text becomes its own id
            return np.array(self.slow(text), dtype="<u4").tobytes()
        if not self.quick or not _plain(text):
            return np.array(self.encode(text), dtype="<u4").tobytes()
        first, *rest = text.replace("\n", " \x01").split(" ")
        if len(self.words) > MEMORY:
            self.words.clear()
        return np.array(self.encode(first), dtype="<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


class _Words(dict):
    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode("\n" + word[1:] if word[:1] == "\x01" else " " + word)
        self[word] = out = np.array(ids, dtype="<u4").tobytes()
        return out


def _plain(text: str) -> bool:
    if any(x in text for x in ("  ", " \n", "\n\n", "\n ", "\t", "\r", "\x01", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")):
        return False
    return text.isascii() or not any(x in text for x in _WIDE)


#: White space beyond ASCII.
_WIDE = ("\x85", "\xa0", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　")

_ids: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document's ids, end token included."""
    kind = dict(docs.dtypes)["doc_id"]

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = ids_of(tokenizer), np.array([END], "<u4").tobytes()
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b["text"]):
                data = ids.packed(text.as_py() or "") + end
                n = len(data) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if k == 0 else capacity
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return columns(docs, "doc_id", "text").mapInArrow(cut_up, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The plan: (length, first rank, sequence of that rank, pieces in a row in one sequence, offset).

    The pieces of `length` from that rank on, up to the next interval's, go `pieces` at a time into
    consecutive sequences, side by side from `offset` on.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted
    held: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, how many)
    opened = 0

    def free(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in held:
                bisect.insort(gaps, gap)
            held.setdefault(gap, []).append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, many = held[gap].pop()
                if not held[gap]:
                    del held[gap], gaps[at]
            else:
                gap, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            each, offset = gap // length, capacity - gap
            full = min(many, left // each)
            if full:
                plan.append((length, rank, first, each, offset))
                free(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < many:
                if left:  # fewer than a sequence holds
                    plan.append((length, rank, first + full, each, offset))
                    free(gap - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                free(gap, first + full, many - full)
    return plan


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    kind, spark = dict(docs.dtypes)["doc_id"], docs.sparkSession
    cut_up = cut(pieces(docs, tokenizer, capacity).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * partitions(spark))).cast("int")), "pieces")
    counts = cut_up.groupBy("length", "part").agg(F.count("*").alias("n"))
    plan = best_fit({int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    # one sorted key for the binary search: length above, rank below
    table = np.array(sorted(plan), np.int64).reshape(-1, 5)
    keys = table[:, 0] * (1 << 48) + table[:, 1]
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = cut_up.withColumn("inside", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))).join(before, ["length", "part"])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            hit = table[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1] if len(rank) else table[:0]
            k = rank - hit[:, 1]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(hit[:, 2] + k // hit[:, 3]), pa.array(hit[:, 4] + k % hit[:, 3] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside") - 1).cast("bigint").alias("rank"))
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
