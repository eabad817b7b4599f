"""Near-duplicate detection with BagMinHash signatures, banding and verified multiset overlap.

A document is the multiset of its five-word shingles. Each shingle's weight (its count) is discretised
into shells [0,1), [1,2), [2,4), [4,8), ...; every (shingle, shell) owns a Poisson process whose rate is
the shell's width, and each point of it falls on one signature component and one place in the shell. A
point counts if its place lies below the weight, so a weight of w costs about log2(w) processes rather
than w. A component keeps its earliest point. Points are drawn in order of time up to a bound at which
all components of a document are expected to be hit; documents that miss one go on with a later bound.
Two documents agree in a component with the probability of their weighted Jaccard similarity.

Equal texts collapse first. Bands of the signature make buckets. Every bucket has a leader, the member
that meets most others over all its bands, and members are verified against their leaders only: that
is one pair for each member, not one for each two. What is left are members that their leader is not
near. Two members a and b of one leader c differ by |a - b| = |a - c| + |b - c| - 2 * overlap, where the
overlap is what their differences from c have in common, so a link needs a known least overlap. That
makes a prefix join over the differences, rarest first: few elements, each of which few members have,
and exact. No bucket is capped and no link inside a bucket is lost to the bucket's size. Verification
compares the multisets themselves. Classes are the connected components of verified links.

Defined results: null and empty texts have no shingles and are near nothing but equal texts; a text of
one to four words is a single shingle; a very long text is a pass of its own; an empty table gives an
empty result; each row counts in class_size, also one that repeats a doc_id; a repeated id with several
texts is in the classes of all of them, row by row; a null doc_id is a document like any other, and ranks
below all ids; of a class the row with the least id stays, null first; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webquarry.llm.common import PASS_BYTES, as_i64, columns, cut, discard, fresh, mix, pair, parted, passes, run_hash, text_buffer, text_or_empty, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 36, 7
#: Points expected for each component before a document's first bound.
DEPTH = 8.0
#: Pairs of one leader that one copy of its text serves.
DEAL = 256


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, shingle hash and count, sorted by document and hash."""
    _, _, doc, word = word_hashes(buf, offsets)
    h = run_hash(word, k)
    own = doc[: len(h)] == doc[len(doc) - len(h) :]
    docs, keys = [doc[: len(h)][own]], [h[own]]
    n = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        if len(short):
            docs.append(short)
            keys.append(pair(run_hash_at(word, first[short], size), np.full(len(short), size, np.uint64)))
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return doc[at], key[at], np.diff(np.append(at, len(doc)))


def run_hash_at(word: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = word[at]
    for i in range(1, k):
        out = pair(out, word[at + i])
    return out


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """docs x size earliest times; inf throughout for a document without shingles."""
    cell, name, rate, low = [np.arange(len(doc))], [key], [np.ones(len(doc))], [np.zeros(len(doc), np.int64)]
    shell = 1
    while len(live := np.flatnonzero(weight > (1 << (shell - 1)))):
        cell.append(live)
        name.append(pair(key[live], np.full(len(live), shell, np.uint64)))
        rate.append(np.full(len(live), float(1 << (shell - 1))))
        low.append(np.full(len(live), 1 << (shell - 1)))
        shell += 1
    cell, name, rate, low = map(np.concatenate, (cell, name, rate, low))
    whose, most = doc[cell], weight[cell]
    total = np.bincount(doc, weights=weight, minlength=docs)
    bound = np.where(total > 0, DEPTH * size / np.maximum(total, 1), 0.0)
    sig = np.full(docs * size, np.inf)
    todo = np.arange(len(cell))
    while len(todo):
        live, t, step = todo, np.zeros(len(todo)), 0
        while len(live):
            r = mix(name[live] + np.uint64((step * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            t = t - np.log(_uniform(r)) / rate[live]
            ok = t < bound[whose[live]]
            live, t, r = live[ok], t[ok], mix(r[ok] + np.uint64(0xA5A5A5A5))
            place = low[live] + np.floor(_uniform(mix(r)) * rate[live]).astype(np.int64)
            counts = place < most[live]
            hit = whose[live[counts]] * size + ((r[counts] >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(sig, hit, t[counts])
            step += 1
        open_ = np.isinf(sig.reshape(docs, size)).any(1) & (total > 0)
        bound[open_] *= 2
        todo = np.flatnonzero(open_[whose])
    return sig.reshape(docs, size)


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    h = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + np.uint64(77)), (len(sig), bands))
    for i in range(rows):
        h = pair(h, bits[:, :, i])
    return h


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, digest, bands (empty for a text without words)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = text_buffer(b["text"])
            for i, j in passes(offsets, PASS_BYTES // 4):  # its points are many times its text
                doc, key, weight = shingles(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                some = np.zeros(j - i, np.int64)
                some[doc] = bands
                h = bands_of(signatures(doc, key, weight, j - i, bands * rows), bands, rows)[some > 0]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)]).astype(np.int32)), pa.array(as_i64(np.ascontiguousarray(h)).reshape(-1)))
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["digest"], lists], names=["doc_id", "digest", "bands"])

    ready = columns(docs, "doc_id", "text").select("doc_id", F.unhex(F.sha2(text_or_empty().cast("binary"), 256)).alias("digest"), text_or_empty().alias("text"))
    return ready.mapInArrow(run, f"doc_id {kind}, digest binary, bands array<bigint>")


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with the distance sum |w_a - w_b| of their multisets and both total weights.

    `b` may be shared by very many pairs: it is dealt to as many places as its pairs need.
    """
    ready = _with_texts(pairs, texts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, sides in _both_sides(b):
                n = part.num_rows
                total = [np.bincount(d, weights=w, minlength=n).astype(np.int64) for d, _, w in sides]
                _, x, y = np.intersect1d(pair(sides[0][1], sides[0][0].astype(np.uint64)), pair(sides[1][1], sides[1][0].astype(np.uint64)), assume_unique=True, return_indices=True)
                both = np.bincount(sides[0][0][x], weights=np.minimum(sides[0][2][x], sides[1][2][y]), minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part["a"], part["b"], pa.array(total[0] + total[1] - 2 * both), pa.array(total[0]), pa.array(total[1])], names=["a", "b", "apart", "total_a", "total_b"])

    return ready.mapInArrow(run, "a binary, b binary, apart bigint, total_a bigint, total_b bigint")


def differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, h, w) for every shingle of which a and b have unlike counts; h tells more from fewer."""
    ready = _with_texts(pairs, texts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, ((doc_a, key_a, w_a), (doc_b, key_b, w_b)) in _both_sides(b):
                doc, key = np.concatenate([doc_a, doc_b]), np.concatenate([key_a, key_b])
                gain = np.concatenate([w_a, -w_b]).astype(np.int64)
                order = np.lexsort((key, doc))
                doc, key, gain = doc[order], key[order], gain[order]
                if not len(doc):
                    continue
                at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
                gain, doc, key = np.add.reduceat(gain, at), doc[at], key[at]
                some = gain != 0
                gain, doc, key = gain[some], pa.array(doc[some]), key[some]
                h = pair(key, (gain > 0).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([part["a"].take(doc), part["b"].take(doc), pa.array(as_i64(h)), pa.array(np.abs(gain))], names=["a", "b", "h", "w"])

    return ready.mapInArrow(run, "a binary, b binary, h bigint, w bigint")


def _both_sides(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Passes over rows of (text_a, text_b): the rows, and (row, shingle, count) of either side."""
    one, at_one = text_buffer(b["text_a"])
    two, at_two = text_buffer(b["text_b"])
    for i, j in passes(at_one + at_two, PASS_BYTES):
        yield b.slice(i, j - i), [shingles(buf[at[i] : at[j]], at[i : j + 1] - at[i]) for buf, at in ((one, at_one), (two, at_two))]


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, text_a, text_b. A text of b that more than DEAL pairs ask for is given out in copies, one for each DEAL pairs."""
    deals = pairs.groupBy("b").agg(F.ceil(F.count("*") / DEAL).cast("int").alias("deals"))
    left = pairs.select("a", "b").join(deals, "b").join(texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a")
    left = left.withColumn("deal", F.pmod(F.xxhash64("a"), F.col("deals")).cast("int"))
    right = texts.join(deals, texts["digest"] == deals["b"]).select("b", F.col("text").alias("text_b"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    return left.join(right, ["b", "deal"]).select("a", "b", "text_a", "text_b")


def components(edges: DataFrame) -> DataFrame:
    """node, label (its component's least node) of every node of edges (a, b): alternating large and small stars.

    A round leaves the graph as it was when it is done; the number of rounds grows with the logarithm of the nodes.
    """
    cur = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = cur.union(cur.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), "m").where("u <> m").union(low.select("u", "m")).select("u", F.col("m").alias("v")).distinct()
        before, cur = cur, cut(small, "edges")
        discard(before)
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            label = cut(cur.select(F.col("u").alias("node"), F.col("v").alias("label")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "labels")
            discard(cur)
            return label
        mark = now


def _rest(tried: DataFrame, label: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of two classes that share a leader and could be near each other: all those, and few others.

    With r = (1 - s) / (1 + s), a and b are near when |a - b| <= r (|a| + |b|). Let e = |a - c| - r |a|: near means
    2 * overlap >= e_a + e_b. For each member the least such need over members of other classes bounds what may be cut
    from the end of its differences, rarest first; two near members still share an element of what is left.
    """
    ratio = (1 - similarity) / (1 + similarity)
    named = lambda of, out: label.select(F.col("node").alias(of), F.col("label").alias(out))
    group = tried.join(named("a", "own"), "a", "left").join(named("b", "lead"), "b", "left")
    group = group.select("a", "b", "apart", F.col("total_a").alias("total"), F.coalesce("own", "a").alias("own"), F.coalesce("lead", "b").alias("lead"))
    group = group.withColumn("e", F.col("apart") - F.lit(ratio) * F.col("total")).withColumn("led", F.col("own") == F.col("lead"))
    # the least e of those outside the leader's class, and of those in it; one member besides the leader was settled with it
    open_ = group.groupBy("b").agg(F.min(F.when(~F.col("led"), F.col("e"))).alias("e_out"), F.min(F.when(F.col("led"), F.col("e"))).alias("e_in"), F.count("*").alias("n")).where("e_out is not null and n > 1").drop("n")
    # a partner has |b| <= |a| / s, and the overlap is at most |b - c| = e_b + r |b|
    least = lambda of: (F.col("e") + F.greatest(F.col(of), F.col("e") - F.lit(2 * ratio / similarity) * F.col("total"))) / 2 - 1e-6
    group = group.join(open_, "b").withColumn("need_out", least("e_out")).withColumn("need_in", F.when(~F.col("led"), least("e_in")))
    group = group.where("need_out <= apart or need_in <= apart")
    both = group.groupBy("b").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("b")
    group = cut(group.join(both, "b", "left_semi").select("a", "b", "own", "led", "e", "need_out", "need_in"), "groups")
    each = cut(differences(group, texts), "differences")
    often = each.groupBy("b", "h").agg(F.count("*").alias("n")).where("n > 1")
    shared = each.join(often, ["b", "h"]).join(group, ["a", "b"])
    after = Window.partitionBy("a", "b").orderBy(F.desc("n"), F.desc("h")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = shared.withColumn("behind", F.sum("w").over(after)).where("behind >= least(need_out, need_in)").select("a", "b", "h", "own", "led", "e", "need_out", "need_in", "behind")
    # a member that may need no overlap meets the others without sharing anything
    free = group.where("least(need_out, need_in) <= 0").select("a", "b", F.lit(0).cast("bigint").alias("h"), "own", "led", "e", F.lit(0.0).alias("need_out"), F.lit(0.0).alias("need_in"), F.lit(0).cast("bigint").alias("behind"))
    prefix = cut(ranked.withColumn("kind", F.lit(1)).union(free.withColumn("kind", F.lit(0))), "prefixes")
    left = prefix.where("not led")
    right = prefix.select(F.col("b").alias("b2"), F.col("h").alias("h2"), F.col("kind").alias("kind2"), F.col("a").alias("a2"), F.col("own").alias("own2"), F.col("led").alias("led2"), F.col("e").alias("e2"), F.col("need_out").alias("need2"), F.col("behind").alias("behind2"))
    # at the first element that two members share, no more can be common than what lies behind it in both
    near = (F.col("b") == F.col("b2")) & (F.col("h") == F.col("h2")) & (F.col("kind") == F.col("kind2")) & (F.col("own") != F.col("own2")) & (F.col("e") + F.col("e2") <= 2 * F.least("behind", "behind2") + 1e-6)
    inside = left.where("behind >= need_in").join(right.where("led2 and behind2 >= need2"), near)
    outside = left.where("behind >= need_out").join(right.where("not led2 and behind2 >= need2"), near & (F.col("a") < F.col("a2")))
    out = cut(inside.union(outside).select(F.least("a", "a2").alias("a"), F.greatest("a", "a2").alias("b")).distinct(), "pairs")
    discard(group, each, prefix)
    return out


def links(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(signed rows of documents, class label of every text that has a verified near copy); texts go by their digests."""
    near = F.col("apart") <= F.lit((1 - similarity) / (1 + similarity) + 1e-12) * (F.col("total_a") + F.col("total_b"))
    marks = cut(signed(docs), "signatures")
    rep = marks.groupBy("digest").agg(F.first("bands").alias("bands"))
    buckets = rep.select("digest", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(buckets.join(shared, "band"), "members")
    reach = members.groupBy("digest").agg(F.sum("n").alias("reach"))
    lead = members.join(reach, "digest").groupBy("band").agg(F.max(F.struct("reach", "digest")).alias("lead")).select("band", F.col("lead.digest").alias("b"))
    pairs = cut(members.withColumnRenamed("digest", "a").join(lead, "band").where("a <> b").select("a", "b").distinct(), "pairs")
    ids = members.select("digest").distinct()
    body = columns(docs, "text").select(text_or_empty().alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    # the texts of candidates move, the rest stays
    texts = cut(parted(body, F.col("digest"), ids)[0].join(ids, "digest", "left_semi").dropDuplicates(["digest"]), "candidates")
    discard(members)
    tried = cut(compared(pairs, texts), "compared")
    discard(pairs)
    found = tried.where(near).select("a", "b")
    label = components(found)
    rest = _rest(tried, label, texts, similarity)
    extra = cut(compared(rest, texts).where(near).select("a", "b"), "links")
    if not extra.isEmpty():
        discard(label)
        label = components(found.union(extra))
    discard(texts, tried, rest, extra)
    return marks, label


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least id of its class, null first), class_size, kept."""
    return _classed(docs, similarity).drop("digest")


def _classed(docs: DataFrame, similarity: float) -> DataFrame:
    marks, label = links(docs, similarity)
    # one row for each text and id: ties among rows of one id stay ties
    texts = marks.groupBy("digest").agg(F.min(F.struct("doc_id")).alias("id"), F.count("*").alias("n"))
    known = texts.join(label.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    facts = known.groupBy("label").agg(F.min("id").alias("id"), F.sum("n").alias("class_size"))
    per_text = known.select("digest", "label").join(facts, "label").select("digest", F.col("id.doc_id").alias("class_id"), "class_size")
    classed = marks.select("doc_id", "digest").join(per_text, "digest")
    return classed.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "digest")


def thin(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that stay, one of each class, with all their columns."""
    id_, digest = fresh(docs, "gone_id"), fresh(docs, "gone_digest")
    gone = cut(_classed(docs, similarity).where(~F.col("kept")).select(F.col("doc_id").alias(id_), F.col("digest").alias(digest)).distinct(), "gone")
    own = F.unhex(F.sha2(text_or_empty("`text`").cast("binary"), 256))
    some, alone = parted(docs, own, gone.select(digest))
    return alone.union(some.join(gone, some["doc_id"].eqNullSafe(F.col(id_)) & (own == F.col(digest)), "left_anti"))
