"""Removal of repeated byte strings through a sparse suffix array sorted deep-shallow.

Suffixes are sampled by content: of every 200-byte string, the position of the 16-byte gram with the
least hash is an anchor, so equal strings hold an anchor at the same place, and the array needs only the
suffixes that start at anchors. Two suffixes whose strings of 200 bytes around the anchor are equal agree
in the 100 bytes after it or in the 100 bytes before it; each of the two makes a key, and suffixes meet
in the hash partition of a shared key. There

1. suffixes with equal surroundings, 184 bytes before and 200 after, collapse to one;
2. the rest are sorted by what follows the anchor: a multikey quicksort on 8-byte words orders them to a
   shallow depth, and groups that still share that long a prefix are ordered by blind tries;
3. a walk over the array's runs of common prefixes, joined with the same order of what precedes the
   anchor, gives each suffix its longest reach to the left and right of which the sum is 200 or more.

Suffixes with equal surroundings are told by a 64-bit hash of these 384 bytes; all other comparison is of
bytes. Bytes within a reach go.

A suffix that is settled inside its task sends one row for all its copies, so a text that makes up a
third of all rows reaches a key's task once for each scan task.

Defined results: a null or empty text has no bytes; shorter texts than 200 bytes keep all; an empty
table gives an empty result; rows that repeat an id count as repeats of each other; a cut inside a
character leaves its bytes as they are; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import PASS_BYTES, as_i64, columns, cut, discard, loads, mix, padded, pair, passes, row_key, span_hash, text_buffer, text_or_empty, winnow

LENGTH, GRAM = 200, 16
#: Words of 8 bytes that the multikey quicksort looks at before blind tries take over.
SHALLOW = 4
#: Rows that the quicksort orders by all their words at once.
BASE = 1024
HELD = 1_000_000
#: Runs of the array of up to so many suffixes are compared pair by pair rather than by a walk over all starts.
SMALL = 48


# ---------------------------------------------------------------- sorting


def multikey_quicksort(words: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Order rows of words by their first `most` words: three-way partition on one word at a time.

    Runs of up to BASE rows are ordered by all words that are left at once.
    """
    out, stack = [], [(rows, 0)]
    while stack:
        rows, depth = stack.pop()
        if depth == most or len(rows) < 2:
            out.append(rows)
        elif len(rows) <= BASE:
            out.append(rows[np.lexsort([words[rows, d] for d in range(most - 1, depth - 1, -1)])])
        else:
            key = words[rows, depth]
            pivot = np.partition(key, len(key) // 2)[len(key) // 2]
            stack += [(rows[key > pivot], depth), (rows[key == pivot], depth + 1), (rows[key < pivot], depth)]
    return np.concatenate(out) if out else rows


class BlindTrie:
    """Patricia trie over byte strings: nodes hold the depth of their branch, edges one byte.

    A new string walks down blindly, by the bytes at the branch depths alone; one comparison with a leaf
    below tells how much they share; the string is then hooked in at that depth.
    """

    def __init__(self) -> None:
        self.depth: list[int] = []
        self.edges: list[dict[int, int]] = []  # byte (-1: the string ends) -> node, or ~leaf
        self.root: int | None = None

    def insert(self, strings: list[bytes], leaf: int) -> None:
        s = strings[leaf]
        if self.root is None:
            self.root = ~leaf
            return
        at = self.root
        while at >= 0:
            d, edges = self.depth[at], self.edges[at]
            nxt = edges.get(s[d] if d < len(s) else -1)
            at = next(iter(edges.values())) if nxt is None else nxt
        shared = common(s, strings[~at])
        up, key, at = None, 0, self.root
        while at >= 0 and self.depth[at] < shared:
            up, key = at, (s[self.depth[at]] if self.depth[at] < len(s) else -1)
            at = self.edges[at][key]
        mine = s[shared] if shared < len(s) else -1
        if at >= 0 and self.depth[at] == shared:
            self.edges[at][mine] = ~leaf
            return
        below = strings[self._leaf(at)]
        self.depth.append(shared)
        self.edges.append({below[shared] if shared < len(below) else -1: at, mine: ~leaf})
        node = len(self.depth) - 1
        if up is None:
            self.root = node
        else:
            self.edges[up][key] = node

    def _leaf(self, at: int) -> int:
        while at >= 0:
            at = next(iter(self.edges[at].values()))
        return ~at

    def order(self) -> list[int]:
        out, stack = [], [] if self.root is None else [self.root]
        while stack:
            at = stack.pop()
            if at < 0:
                out.append(~at)
            else:
                stack += [self.edges[at][k] for k in sorted(self.edges[at], reverse=True)]
        return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def deep_shallow_sort(chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Order of byte strings, given as rows of a zero-padded matrix with their lengths."""
    n, width = chars.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = chars
    words = wide.view(">u8").astype(np.uint64)
    shallow = min(SHALLOW, words.shape[1])
    order = multikey_quicksort(words, np.arange(n), shallow)
    differ = np.ones(n + 1, bool)
    differ[1:-1] = (words[order[1:], :shallow] != words[order[:-1], :shallow]).any(1)
    border = np.flatnonzero(differ)
    for k in np.flatnonzero(np.diff(border) > 1):
        rows = order[border[k] : border[k + 1]]
        strings = [chars[r, : lengths[r]].tobytes() for r in rows]
        trie, same = BlindTrie(), {}
        for i, s in enumerate(strings):
            if s in same:
                same[s].append(i)
            else:
                same[s] = [i]
                trie.insert(strings, i)
        order[border[k] : border[k + 1]] = rows[np.array([j for i in trie.order() for j in same[strings[i]]])]
    return order


def matched(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common prefix of each row of a with the same row of b, `most` at most."""
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return np.minimum(first, most)


# ---------------------------------------------------------------- reaches


def reaches(group: np.ndarray, lcp: np.ndarray, near: np.ndarray, nlen: np.ndarray, far: np.ndarray, flen: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Reach of each suffix on the near and the far side; 0, 0 where no other suffix agrees over `length` bytes.

    Rows are in suffix array order of the near side; group: which run of the array each belongs to; lcp: what each
    shares with the row before it. near, far: what stands on the two sides of the anchor, read away from it.
    """
    n = len(group)
    by_near, by_far = np.zeros(n, np.int64), np.zeros(n, np.int64)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(start, n))
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        i, j = np.triu_indices(size, 1)
        first = start[sizes == size]
        i, j = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
        for at in range(0, len(i), 20_000):
            x, y = i[at : at + 20_000], j[at : at + 20_000]
            a = matched(near[x], near[y], np.minimum(nlen[x], nlen[y]))
            b = matched(far[x], far[y], np.minimum(flen[x], flen[y]))
            ok = a + b >= length
            for z in (x[ok], y[ok]):
                np.maximum.at(by_near, z, a[ok])
                np.maximum.at(by_far, z, b[ok])
    for first, size in zip(start[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        rows = slice(first, first + size)
        other = deep_shallow_sort(far[rows], flen[rows])
        x, y = other[:-1], other[1:]
        step = matched(far[rows][x], far[rows][y], np.minimum(flen[rows][x], flen[rows][y]))
        own, run = lcp[rows][1:], np.empty(size, np.int64)
        # strings of `length` that start d before the anchor agree if the array's prefixes and the other side's both reach
        for d in range(max(0, length - int(nlen[rows].max())), int(flen[rows].max()) + 1):
            run[other] = np.concatenate([[0], np.cumsum(step < d)])
            near_run = np.concatenate([[0], np.cumsum(own < length - d)])
            _, back, many = np.unique(near_run * size + run, return_inverse=True, return_counts=True)
            hit = first + np.flatnonzero(many[back] > 1)
            by_far[hit] = d
            by_near[hit] = np.maximum(by_near[hit], length - d)
    return by_near, by_far


# ---------------------------------------------------------------- stages


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows that meet by k: h0 (hash of the surroundings), row, pos, llen, rlen, kind (1 after, 2 before, 0 settled), n."""
    half, before = length // 2, length - gram

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h0, h1, h2, pos, llen, rlen, name = (np.concatenate([x[k] for x in held]) for k in range(7))
        ids = pa.concat_arrays([x[7] for x in held])
        order = np.argsort(h0, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = h0[order][1:] != h0[order][:-1]
        at = np.flatnonzero(new)
        n, rep = np.diff(np.append(at, len(order))), order[at]

        def rows(which: np.ndarray, k: np.ndarray, code: int, many: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(as_i64(k)), pa.array(as_i64(h0[which])), ids.take(pa.array(which)), pa.array(pos[which]), pa.array(llen[which].astype(np.int16)), pa.array(rlen[which].astype(np.int16)), pa.array(np.full(len(which), code, np.int8)), pa.array(many.astype(np.int32))], names=["k", "h0", "row", "pos", "llen", "rlen", "kind", "n"])

        for code, key, side in ((1, h1, rlen), (2, h2, llen)):
            ok = side[rep] >= half
            yield rows(rep[ok], key[rep[ok]], code, n[ok])
        rest = order[~new]
        yield rows(rest, mix(name[rest].astype(np.uint64)), 0, np.full(len(rest), 2))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, named = [], 0, 0
        for b in batches:
            buf, offsets = text_buffer(b["text"])
            for i, j in passes(offsets, PASS_BYTES):
                part, off = padded(buf[offsets[i] : offsets[j]], gram + 8), offsets[i : j + 1] - offsets[i]
                view = loads(part)
                n = int(off[-1])
                h = view[:n] * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
                h += view[8 : 8 + n]
                h *= np.uint64(0xD6E8FEB86659FD93)
                at = winnow((h >> np.uint64(32)).astype(np.uint32), length - gram + 1)
                doc = np.searchsorted(off, at, side="right") - 1
                llen, rlen = np.minimum(before, at - off[doc]), np.minimum(length, off[doc + 1] - at)
                ok = (rlen >= gram) & (llen + rlen >= length)
                at, doc, llen, rlen = at[ok], doc[ok], llen[ok], rlen[ok]
                if not len(at):
                    continue
                h0 = pair(span_hash(part, at - llen, llen + rlen), llen.astype(np.uint64))
                h1 = span_hash(part, at, np.where(rlen >= half, half, 0), seed=1)
                h2 = span_hash(part, at - np.where(llen >= half, half, 0), np.where(llen >= half, half + gram, 0), seed=2)
                held.append((h0, h1, h2, (at - off[doc]).astype(np.int32), llen, rlen, doc + i + named, b["row"].take(pa.array(doc + i))))
                size += len(at)
                if size >= HELD:
                    yield from settle(held)
                    held, size = [], 0
            named += len(b)
        if held:
            yield from settle(held)

    return docs.mapInArrow(run, f"k bigint, h0 bigint, row binary, pos int, llen smallint, rlen smallint, kind tinyint, n int")


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one hash partition: suffixes that are covered, as kind 0, and those to sort, as kind 1 or 2."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    kind, half = t["kind"].to_numpy(), LENGTH // 2
    k, h0, n, rlen = (t[c].to_numpy() for c in ("k", "h0", "n", "rlen"))
    order = np.lexsort((h0, k, kind))
    order = order[kind[order] > 0]
    kk, hh, cc = k[order], h0[order], kind[order]
    new_key = np.ones(len(order), bool)
    new_key[1:] = (kk[1:] != kk[:-1]) | (cc[1:] != cc[:-1])
    new = new_key.copy()
    new[1:] |= hh[1:] != hh[:-1]
    alike = np.cumsum(new) - 1
    copies = np.bincount(alike, weights=n[order]) if len(order) else np.zeros(0)
    key = np.cumsum(new_key) - 1
    distinct = np.bincount(key[new]) if len(order) else np.zeros(0)
    # the same suffix may meet by either key: the first one that it has settles it
    covered = order[(copies[alike] > 1) & ((cc == 1) | (rlen[order] < half))]
    sort = order[new & (distinct[key] > 1)]
    out = np.zeros(len(kind), np.int8)
    for rows, code in ((np.concatenate([np.flatnonzero(kind == 0), covered]), None), (sort, kind)):
        out = np.zeros(len(rows), np.int8) if code is None else kind[rows]
        part = t.take(pa.array(rows)).select(["k", "row", "pos", "llen", "rlen"])
        yield from part.append_column("kind", pa.array(out)).combine_chunks().to_batches(50_000)


def _sides(batches: Iterable[pa.RecordBatch], before: int, length: int) -> Iterator[pa.RecordBatch]:
    """The surroundings of the suffixes to sort: before (backwards) and after, zero-padded."""
    for b in batches:
        buf, offsets = text_buffer(b["text"])
        lists = b["at"].flatten()
        own = np.repeat(np.arange(len(b)), b["at"].value_lengths().to_numpy())
        pos, llen, rlen = (lists.field(c).to_numpy().astype(np.int64) for c in ("pos", "llen", "rlen"))
        wide = np.concatenate([np.zeros(before, np.uint8), buf, np.zeros(length, np.uint8)])
        for i in range(0, len(own), 5000):
            s = slice(i, i + 5000)
            at = before + offsets[own[s]] + pos[s]
            left = wide[at[:, None] - 1 - np.arange(before)]
            left[np.arange(before) >= llen[s, None]] = 0
            right = wide[at[:, None] + np.arange(length)]
            right[np.arange(length) >= rlen[s, None]] = 0
            fixed = lambda m: pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(m).tobytes())])
            yield pa.RecordBatch.from_arrays([*(lists.field(c)[i : i + 5000] for c in ("k", "kind")), b["row"].take(pa.array(own[s])), *(lists.field(c)[i : i + 5000] for c in ("pos", "llen", "rlen")), fixed(left), fixed(right)], names=["k", "kind", "row", "pos", "llen", "rlen", "before", "after"])


def _sorted_reaches(batches: Iterable[pa.RecordBatch], before: int, length: int) -> Iterator[pa.RecordBatch]:
    """Of one hash partition: build its suffix array, walk it, return what is covered."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    matrix = lambda c, w: np.frombuffer(b"".join(t[c].to_pylist()), np.uint8).reshape(-1, w)
    left, right = matrix("before", before), matrix("after", length)
    llen, rlen, kind = (t[c].to_numpy().astype(np.int64) for c in ("llen", "rlen", "kind"))
    for code in (1, 2):
        rows = np.flatnonzero(kind == code)
        near, nlen, far, flen = (right, rlen, left, llen) if code == 1 else (left, llen, right, rlen)
        rows = rows[deep_shallow_sort(near[rows], nlen[rows])] if len(rows) else rows
        if len(rows) < 2:
            continue
        lcp = np.concatenate([[0], matched(near[rows[1:]], near[rows[:-1]], np.minimum(nlen[rows[1:]], nlen[rows[:-1]]))])
        group = np.cumsum(lcp < length // 2)
        a, b = reaches(group, lcp, near[rows], nlen[rows], far[rows], flen[rows], length)
        hit = np.flatnonzero(a + b >= length)
        l_, r = (b[hit], a[hit]) if code == 1 else (a[hit], b[hit])
        part = t.take(pa.array(rows[hit]))
        pos = part["pos"].to_numpy().astype(np.int64)
        yield from pa.table({"row": part["row"], "from": pa.array(pos - l_), "to": pa.array(pos + r)}).combine_chunks().to_batches(50_000)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(documents with their row keys, row with spans of from and to: byte ranges covered by strings that occur twice)."""
    before = length - gram
    ready = columns(docs, "doc_id", "text")
    texts = ready.select("doc_id", text_or_empty().alias("text"), row_key("doc_id", "text").alias("row"))
    met = cut(_anchors(texts.select("row", "text"), length, gram).repartition("k").mapInArrow(_meet, f"k bigint, row binary, pos int, llen smallint, rlen smallint, kind tinyint"), "suffixes")
    plain = met.where("kind = 0").select("row", (F.col("pos") - F.col("llen")).cast("bigint").alias("from"), (F.col("pos") + F.col("rlen")).cast("bigint").alias("to"))
    wanted = met.where("kind > 0").groupBy("row").agg(F.collect_set(F.struct("k", "kind", "pos", "llen", "rlen")).alias("at"))
    sides = texts.join(wanted, "row").select("row", "text", "at").mapInArrow(lambda x: _sides(x, before, length), f"k bigint, kind tinyint, row binary, pos int, llen smallint, rlen smallint, before binary, after binary")
    found = sides.repartition("k").mapInArrow(lambda x: _sorted_reaches(x, before, length), f"row binary, `from` bigint, `to` bigint")
    # a table of its own, so that the shuffles of this step are gone before texts are shuffled again
    spans = cut(plain.union(found).groupBy("row").agg(F.collect_set(F.struct("from", "to")).alias("spans")), "spans")
    discard(met)
    return texts, spans


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    kind = dict(docs.dtypes)["doc_id"]
    texts, spans = repeated_spans(docs, length)

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            flat, lists = b["spans"].flatten(), b["spans"]
            lo, hi = (flat.field(c).to_numpy() for c in ("from", "to"))
            border = np.concatenate([[0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy())])
            for i, t in enumerate(b["text"]):
                data = t.as_py().encode()
                parts, runs, at, gone = [], 0, 0, 0
                a, z = lo[border[i] : border[i + 1]], hi[border[i] : border[i + 1]]
                if len(a):
                    order = np.argsort(a, kind="stable")
                    a, z = a[order], np.maximum.accumulate(z[order])
                    new = np.concatenate([[True], a[1:] > z[:-1]])
                    first = a[new]
                    last = z[np.append(np.flatnonzero(new)[1:] - 1, len(z) - 1)]
                    for x, y in zip(first.tolist(), last.tolist(), strict=True):
                        parts.append(data[at:x])
                        at, runs, gone = y, runs + 1, gone + y - x
                kept = b"".join([*parts, data[at:]])
                for col, v in zip(out, (len(data), gone, runs, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(remove, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
