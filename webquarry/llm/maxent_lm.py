"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

P(word | history) = P(class | history) * P(bucket | class, history) * P(word | bucket). The class of a word
is its own for the end token and for the most frequent words, and a hash of its last bytes otherwise; the
words of a hashed class are dealt to buckets by hash. P(class | history) is a maximum-entropy model over
hashed features of the words before: the last one (bigram), the one before it (skip) and the pair (trigram).
P(bucket | class, history) is one over the features of the last word (bigram) and the one before it (skip),
each with the class. A word counts in a history as itself if it is among the frequent ones and by a hash
otherwise. P(word | bucket) is the softmax of the words' own weights alone, whose optimum is add-one
smoothed counting, with one place for unknown words.

1. One pass counts all training words, every task its own and their sums by hash; a top-k of these sums gives
   the frequent words of the whole corpus.
2. Every scan task counts words, as 64-bit hashes, for each unit (some thousand documents) and sends them
   as sorted blobs to the partition of the hash; counts of (history, class), and of either word before with
   (class, bucket), go along, sparse.
3. A hash partition adds up its words over all units, one hash range after the other, and replies to each
   unit with the counts of the unit's own words; so words travel once for each unit, never once for each
   document.
4. The features' weights are trained by epochs of distributed gradients: tasks hold parts of the history
   counts and compute gradients, which are summed into weights of a fixed number.
5. Each unit's documents meet its replies and are scored in numpy batches: one softmax for each distinct
   history of a batch, of as many sparse features as a history has.

Counting, training counts and scoring cover all documents.

Defined results: a null or empty text is the end token alone; without training documents N and V are 0;
a very long text is a pass of its own; an empty table gives an empty result; rows that repeat an id are
scored each by itself, a null id counts as the empty text in the fold; ties among frequent words go by
hash; further columns are ignored. Words are told by 59 bits of hash and 5 of their class: two of 10^8 distinct
words share a key with a chance of about one half a percent, and then share their count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import PASS_BYTES, columns, cut, discard, mix, padded, pair, partitions, passes, span_hash, text_buffer, text_or_empty, word_spans

HASHED, FREQUENT = 32, 31
CLASSES = HASHED + FREQUENT + 1
END_CLASS = CLASSES - 1
#: Buckets of a hashed class, and of all.
BUCKETS = 32
INSIDE = HASHED * BUCKETS
SUMS = CLASSES + INSIDE
END = np.uint64(0xE2D0_0000_0000_0000)
#: What a word before counts as: one of the NAMED most frequent, a hash of the rest, or the border of the text.
NAMED, STATES = 191, 256
BORDER = STATES - 1
FEATURES, EPOCHS, PRIOR = 1 << 12, 12, 1.0
#: Documents of a unit and of a hash range of words, tokens that a task counts at once, bytes of text of a unit.
UNIT, RANGE, HELD, UNIT_BYTES = 4096, 16_384, 4_000_000, 64 << 20
#: Tasks of a gradient, histories of one table of probabilities.
GRADIENT_TASKS, STEP = 4, 4096

_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32


def fold_of(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of every token, each document's end included, and the n + 1 borders. A key's low bits are its hashed class."""
    low = _lower[buf]
    start, end, doc = word_spans(low, offsets)
    wide = padded(low)
    last = np.minimum(3, end - start)
    word = (span_hash(wide, start, end - start) & ~np.uint64(HASHED - 1)) | (span_hash(wide, end - last, last, seed=3) & np.uint64(HASHED - 1))
    n = np.bincount(doc, minlength=len(offsets) - 1) + 1
    border = np.concatenate([[0], np.cumsum(n)])
    out = np.full(border[-1], END)
    out[np.arange(len(word)) + doc] = word
    return out, border


def classes(key: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """frequent: sorted keys that have classes of their own."""
    out = (key & np.uint64(HASHED - 1)).astype(np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
        own = frequent[at] == key
        out[own] = HASHED + at[own]
    out[key == END] = END_CLASS
    return out


def buckets(key: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Number of each word's bucket among all; -1 for words of classes of their own."""
    return np.where(cls < HASHED, cls * BUCKETS + (key >> np.uint64(59)).astype(np.int64), -1)


def states(key: np.ndarray, named: np.ndarray) -> np.ndarray:
    """What each word counts as in a history. named: sorted keys of the frequent words."""
    out = NAMED + (mix(key) % np.uint64(STATES - NAMED - 1)).astype(np.int64)
    if len(named):
        at = np.minimum(np.searchsorted(named, key), len(named) - 1)
        own = named[at] == key
        out[own] = at[own]
    return out


def histories(state: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Of every token: the states of the two tokens before it in its document, as one number."""
    one = np.empty_like(state)
    one[1:] = state[:-1]
    one[border[:-1]] = BORDER
    two = np.empty_like(state)
    two[2:] = state[:-2]
    two[border[:-1]] = BORDER
    second = border[:-1] + 1
    two[second[second < border[1:]]] = BORDER
    return two * STATES + one


def features(history: np.ndarray) -> np.ndarray:
    """The three hashed features of each history: last word, skip, pair."""
    h = history.astype(np.uint64)
    one, two = h % np.uint64(STATES), h // np.uint64(STATES)
    return np.stack([mix(pair(np.full_like(x, k), x)) % np.uint64(FEATURES) for k, x in enumerate((one, two, h))], 1).astype(np.int64)


def log_softmax(weights: np.ndarray, bias: np.ndarray, active: np.ndarray) -> np.ndarray:
    z = weights[active[:, 0]] + weights[active[:, 1]] + weights[active[:, 2]] + bias
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def inner_softmax(weights: np.ndarray, bias: np.ndarray, one: np.ndarray, two: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """log P(bucket | class, words before) of all buckets of a class. weights: (2 * STATES, HASHED, BUCKETS), bias: (HASHED, BUCKETS)."""
    z = weights[one, cls] + weights[STATES + two, cls] + bias[cls]
    z -= z.max(-1, keepdims=True)
    return z - np.log(np.exp(z).sum(-1, keepdims=True))


def train(counts: DataFrame, seen_inside: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """counts: p (state of the word two before), n (counts of the last state and the class, as bytes); seen_inside: counts of
    (last state, bucket), then of (state before it, bucket). Returns weights and bias of classes, weights and bias of buckets."""
    spark = counts.sparkSession

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CLASSES, np.int64)
        for b in batches:
            for n in b["n"].to_pylist():
                out += np.frombuffer(n, np.int64).reshape(STATES, CLASSES).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["n"])

    total = sum((np.frombuffer(r["n"], np.int64) for r in counts.select("n").coalesce(GRADIENT_TASKS).mapInArrow(add, "n binary").collect()), np.zeros(CLASSES, np.int64))
    bias = np.log((total + 1) / (total.sum() + CLASSES))
    weights = np.zeros((FEATURES, CLASSES), np.float32)
    held = seen_inside[:STATES].sum(0).reshape(HASHED, BUCKETS)
    inner, inner_bias = np.zeros((2 * STATES, HASHED, BUCKETS), np.float32), np.log((held + 1) / (held.sum(1, keepdims=True) + BUCKETS))
    for _ in range(epochs if total.sum() else 0):
        shared = spark.sparkContext.broadcast((weights, inner))

        def gradient(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seen, want = np.zeros((2, FEATURES, CLASSES))
            weights, inner = shared.value
            inside, every = np.zeros((2 * STATES, HASHED, BUCKETS)), np.arange(HASHED)[None]
            for b in batches:
                for two, n in zip(b["p"].to_pylist(), b["n"].to_pylist(), strict=True):
                    rows = features(two * STATES + np.arange(STATES))
                    n = np.frombuffer(n, np.int64).reshape(STATES, CLASSES).astype(float)
                    p = np.exp(log_softmax(weights, bias, rows)) * n.sum(1, keepdims=True)
                    for f in range(rows.shape[1]):
                        np.add.at(seen, rows[:, f], n)
                        np.add.at(want, rows[:, f], p)
                    one = np.flatnonzero(n[:, :HASHED].any(1))
                    q = np.exp(inner_softmax(inner, inner_bias, one[:, None], np.full((len(one), 1), two), every)) * n[one, :HASHED, None]
                    inside[one] += q
                    inside[STATES + two] += q.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()]) for x in (seen, want, inside)], names=["seen", "want", "inside"])

        # the histories are STATES rows whatever the corpus, and so are the sums: a few tasks
        parts = counts.select("p", "n").coalesce(GRADIENT_TASKS).mapInArrow(gradient, "seen binary, want binary, inside binary").collect()
        seen, want = (sum(np.frombuffer(r[c], np.float32).reshape(FEATURES, CLASSES).astype(float) for r in parts) for c in ("seen", "want"))
        inside = sum(np.frombuffer(r["inside"], np.float32).reshape(inner.shape).astype(float) for r in parts)
        # gradient of the log likelihood with a Gaussian prior, scaled by its own curvature
        weights = (weights + np.clip((seen - want - PRIOR * weights) / (3 * (want + PRIOR)), -1, 1)).astype(np.float32)
        inner = (inner + np.clip((seen_inside.reshape(inner.shape) - inside - PRIOR * inner) / (2 * (inside + PRIOR)), -1, 1)).astype(np.float32)
        shared.destroy()
    return weights.astype(float), bias, inner, inner_bias.astype(np.float32)


def frequent_words(docs: DataFrame, most: int = NAMED) -> np.ndarray:
    """Keys of the most frequent training words, most frequent first, by exact counts; ties by key."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, back = np.unique(np.concatenate([key, *held]), return_inverse=True)
            total = np.bincount(back[: len(key)], weights=n, minlength=len(k)) + np.bincount(back[len(key) :], minlength=len(k))
            return k, total.astype(np.int64)

        for b in batches:
            buf, offsets = text_buffer(b["text"])
            for i, j in passes(offsets, PASS_BYTES):
                own, _ = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append(own[own != END])
                size += len(own)
                if size >= HELD:
                    (key, n), held, size = merged(), [], 0
        key, n = merged()
        for at in range(0, len(key), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(n[part])], names=["key", "n"])

    found = docs.where("train").select("text").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return np.array([r["key"] for r in found.orderBy(F.desc("n"), "key").limit(most).collect()], np.int64).view(np.uint64)


def _requests(docs: DataFrame, parts: int, frequent: np.ndarray, named: np.ndarray) -> DataFrame:
    """p (hash range of the words; parts + a state for counts of histories; parts + STATES and more for those of buckets), unit, keys, n."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, inside, held, size = np.zeros(STATES * STATES * CLASSES, np.int64), np.zeros(2 * STATES * INSIDE, np.int64), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            unit = np.concatenate([x[0] for x in held])
            key = np.concatenate([x[1] for x in held])
            train = np.concatenate([x[2] for x in held])
            for u in np.unique(unit):
                own = unit == u
                k, back = np.unique(key[own], return_inverse=True)
                n = np.bincount(back, weights=train[own]).astype(np.uint32)
                p = (mix(k) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(p, kind="stable")
                k, n = k[order], n[order]
                at = np.searchsorted(p[order], np.arange(parts + 1))
                some = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), u, np.int64)), pa.array([k[at[x] : at[x + 1]].tobytes() for x in some], pa.binary()), pa.array([n[at[x] : at[x + 1]].tobytes() for x in some], pa.binary())], names=["p", "unit", "keys", "n"])

        for b in batches:
            buf, offsets = text_buffer(b["text"])
            units, train = b["unit"].to_numpy(), b["train"].to_numpy(zero_copy_only=False)
            for i, j in passes(offsets, PASS_BYTES):
                key, border = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                many = np.diff(border)
                learn = np.repeat(train[i:j], many)
                cls = classes(key, frequent)
                before = histories(states(key, named), border)
                cell, n = np.unique((before * CLASSES + cls)[learn], return_counts=True)
                grams[cell] += n
                own = buckets(key, cls)
                some = learn & (own >= 0)
                for side, state in enumerate((before[some] % STATES, before[some] // STATES)):
                    inside += np.bincount((side * STATES + state) * INSIDE + own[some], minlength=len(inside))
                held.append((np.repeat(units[i:j], many), key, learn))
                size += len(key)
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
        for first, table in ((parts, grams.reshape(STATES, -1)), (parts + STATES, inside.reshape(2 * STATES, -1))):
            for k in np.flatnonzero(table.any(1)):
                cell = np.flatnonzero(table[k])
                yield pa.RecordBatch.from_arrays([pa.array([first + k], pa.int32()), pa.array([-1], pa.int64()), pa.array([cell.astype(np.uint32).tobytes()], pa.binary()), pa.array([table[k, cell].tobytes()], pa.binary())], names=["p", "unit", "keys", "n"])

    return docs.select("text", "unit", "train").mapInArrow(run, "p int, unit bigint, keys binary, n binary")


def _replies(parts: int, frequent: np.ndarray):
    """Answers to requests that are sorted by p: one hash range is held at a time."""

    def row(p: int, unit: int, keys: bytes, n: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([unit], pa.int64()), pa.array([keys], pa.binary()), pa.array([n], pa.binary())], names=["p", "unit", "keys", "n"])

    def answer(p: int, asked: list) -> Iterator[pa.RecordBatch]:
        key, back = np.unique(np.concatenate([k for _, k, _ in asked]), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([n for _, _, n in asked])).astype(np.int64)
        seen, cls = total > 0, classes(key, frequent)
        own = buckets(key, cls)
        in_bucket = own >= 0
        both = lambda of, size, n, some: [np.bincount(of, weights=n, minlength=size), np.bincount(of[some], minlength=size)]
        sums = np.concatenate([both(cls, CLASSES, total, seen), both(own[in_bucket], INSIDE, total[in_bucket], seen[in_bucket])], 1).astype(np.int64)
        yield row(p, -2, b"", sums.tobytes())
        kind, at = np.int64 if total.max() >= 2**32 else np.uint32, 0
        for unit, k, _ in asked:
            yield row(p, unit, k.tobytes(), total[back[at : at + len(k)]].astype(kind).tobytes())
            at += len(k)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, cells = None, [], None
        for b in batches:
            for p, unit, keys, n in zip(*(b[c].to_pylist() for c in ("p", "unit", "keys", "n")), strict=True):
                if p != now:
                    yield from finish(now, asked, cells)
                    now, asked, cells = p, [], np.zeros(STATES * CLASSES if p < parts + STATES else INSIDE, np.int64) if p >= parts else None
                if p >= parts:
                    cells[np.frombuffer(keys, np.uint32)] += np.frombuffer(n, np.int64)
                else:
                    asked.append((unit, np.frombuffer(keys, np.uint64), np.frombuffer(n, np.uint32)))
        yield from finish(now, asked, cells)

    def finish(p, asked, cells) -> Iterator[pa.RecordBatch]:
        if cells is not None:
            yield row(p - parts, -1, b"", cells.tobytes())
        elif asked:
            yield from answer(p, asked)

    return run


@dataclass
class Model:
    """Class keys (sorted), history keys (sorted), weights and bias of classes and of buckets, and log10 of each bucket's words and places."""

    frequent: np.ndarray
    named: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    inside: np.ndarray

    def of_classes(self, key: np.ndarray, border: np.ndarray) -> np.ndarray:
        """log10 P(class | history) of every token."""
        seen, back = np.unique(histories(states(key, self.named), border), return_inverse=True)
        cls, out = classes(key, self.frequent), np.empty(len(key))
        order = np.argsort(back, kind="stable")
        edges = np.searchsorted(back[order], np.arange(0, len(seen) + STEP, STEP))
        for i, at in enumerate(range(0, len(seen), STEP)):  # a table of STEP histories at a time
            own = order[edges[i] : edges[i + 1]]
            table = log_softmax(self.weights, self.bias, features(seen[at : at + STEP]))
            out[own] = table[back[own] - at, cls[own]]
        return out / np.log(10)

    def of_buckets(self, key: np.ndarray, border: np.ndarray) -> np.ndarray:
        """log10 P(bucket | class, history) of every token; classes of one word have no buckets."""
        before, cls, out = histories(states(key, self.named), border), classes(key, self.frequent), np.zeros(len(key))
        own = buckets(key, cls)
        hashed = np.flatnonzero(own >= 0)
        for at in range(0, len(hashed), 4 * STEP):
            rows = hashed[at : at + 4 * STEP]
            table = inner_softmax(self.inner, self.inner_bias, before[rows] % STATES, before[rows] // STATES, cls[rows])
            out[rows] = table[np.arange(len(rows)), own[rows] % BUCKETS]
        return out / np.log(10)

    def of_words(self, key: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 P(word | bucket); classes of one word are sure of it."""
        own = buckets(key, classes(key, self.frequent))
        return np.where(own >= 0, np.log10(count + 1.0) - self.inside[own], 0.0)


def _class_sums(replies: DataFrame) -> np.ndarray:
    """Tokens and words of each class, then of each bucket, summed up by the executors."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * SUMS, np.int64)
        for b in batches:
            for n in b["n"].to_pylist():
                out += np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * SUMS)), pa.array(out)], names=["k", "n"])

    rows = replies.where("unit = -2").select("n").mapInArrow(add, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(2 * SUMS, np.int64)
    for r in rows:
        out[r["k"]] = r["n"]
    return out.reshape(2, SUMS)


def _units(docs: DataFrame, kind: str) -> tuple[DataFrame, int]:
    """docs with unit, and the documents' number. A unit is about UNIT documents and half of UNIT_BYTES of text at most.

    Ranges of ids keep a task's documents in few units; where ids or bytes lie too unevenly for that, id and text are hashed.
    """
    size = F.octet_length("text")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        many, bytes_, low, high = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.min("doc_id"), F.max("doc_id")).first()
    else:
        (many, bytes_), low, high = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first(), None, None
    units = max(1, -(-many // UNIT), -(-2 * bytes_ // UNIT_BYTES))
    hashed = docs.withColumn("unit", F.pmod(F.xxhash64("doc_id", "text"), F.lit(units)).cast("bigint"))
    if low is None:
        return hashed, many
    width = max(1, -(-(high - low + 1) // units))
    ranged = docs.withColumn("unit", F.floor((F.coalesce(F.col("doc_id"), F.lit(low)) - F.lit(low)) / F.lit(width)).cast("bigint"))
    most, heavy = ranged.groupBy("unit").agg(F.count("*").alias("n"), F.sum(size).alias("b")).agg(F.max("n"), F.max("b")).first()
    return ranged if most <= 4 * UNIT and heavy <= UNIT_BYTES else hashed, many


def scored(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    ready = columns(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"), held_out.alias("held_out"), (~held_out).alias("train"))
    ready, many = _units(ready, kind)
    top = frequent_words(ready)
    frequent, named = np.sort(top[:FREQUENT]), np.sort(top)
    parts = max(partitions(spark), -(-many // RANGE))
    requests = _requests(ready, parts, frequent, named).repartition(parts, "p").sortWithinPartitions("p")
    replies = cut(requests.mapInArrow(_replies(parts, frequent), "p int, unit bigint, keys binary, n binary"), "replies")
    sums = _class_sums(replies)
    counted = cut(replies.where(f"unit = -1 and p < {STATES}").select("p", "n").repartition(GRADIENT_TASKS), "histories")
    seen_inside = np.zeros((2 * STATES, INSIDE), np.int64)
    for r in replies.where(f"unit = -1 and p >= {STATES}").select("p", "n").collect():  # two rows for each state
        seen_inside[r["p"] - STATES] = np.frombuffer(r["n"], np.int64)
    learned = train(counted, seen_inside)
    discard(counted)
    total, words = int(sums[0, :CLASSES].sum()), int(sums[1, :CLASSES].sum())
    shared = spark.sparkContext.broadcast(Model(frequent, named, *learned, np.log10(sums[0, CLASSES:] + sums[1, CLASSES:] + 1.0)))

    def score(text: pa.Table, counts: pa.Table) -> pa.Table:
        model = shared.value
        keys = [np.frombuffer(x.as_py(), np.uint64) for x in counts["keys"]]
        n = [np.frombuffer(x.as_py(), np.uint32 if len(x.as_py()) == 4 * len(k) else np.int64).astype(np.int64) for x, k in zip(counts["n"], keys, strict=True)]
        key, n = np.concatenate(keys), np.concatenate(n)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        out = []
        buf, offsets = text_buffer(text["text"])
        for i, j in passes(offsets, PASS_BYTES):
            tok, border = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            at = np.minimum(np.searchsorted(key, tok), len(key) - 1)
            if (key[at] != tok).any():
                raise ValueError("a word of this unit has no count")
            c = n[at]
            log_c, chance = np.log10(c + 1.0), model.of_classes(tok, border) + model.of_buckets(tok, border) + model.of_words(tok, c)
            first, many = border[:-1], np.diff(border)
            out.append((many, np.add.reduceat((c > 0).astype(np.int64), first), np.add.reduceat(log_c, first) - many * np.log10(total + words + 1.0), np.add.reduceat(chance, first)))
        many, known, base, chance = (np.concatenate([x[k] for x in out]) for k in range(4))
        return pa.table({"doc_id": text["doc_id"], "held_out": text["held_out"], "n_tokens": pa.array(many, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(many), total, np.int64)), "base_score": pa.array(base), "score": pa.array(chance)})

    answers = replies.where("unit >= 0").select("unit", "keys", "n")
    return ready.select("doc_id", "text", "held_out", "unit").groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
