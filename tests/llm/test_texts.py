"""Operators on texts against brute force, over a fixture with nulls, empty, long, repeated and tied rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from webquarry.llm import common, exact_dedup, langid, maxent_lm, mixing, near_dedup, packing, sharding, substring_dedup, suffix_dedup
from webquarry.llm.queries import OP1_SQL, OP2_SQL, OP4_SQL, OP7_SQL, OP8_SQL, tokenizer

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = {"en": "the ing and tion er ed ly".split(), "fr": "eau que les ment oir eux".split()}


def words(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def corpus():
    rng, rows = random.Random(7), []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        rows.append([i, words(rng, lang, rng.choice([3, 20, 60, 200])), lang, f"s{i % 4}", 0])
    base = rows[4][1] + " " + words(rng, "en", 150)
    passage = words(rng, "en", 60)
    rows += [[60 + i, base, "en", "hot", 0] for i in range(5)]  # equal
    for i in range(8):  # near
        w = base.split()
        w[i * 7 % len(w)] = f"changed{i}"
        rows.append([70 + i, " ".join(w), "en", "hot", 0])
    rows += [[80 + i, words(rng, "en", 40) + " " + passage + "\n" + words(rng, "fr", 30), "en", "hot", 0] for i in range(4)]
    rows += [[90, None, "en", "s1", 0], [91, "", None, None, 0], [92, " \t\n", "fr", None, 0], [93, "1234 !!", "en", "s2", 0], [94, "one two", "en", "s2", 0], [95, "one two", "en", "s3", 0]]
    rows += [[96, "ab" * 30_000, "en", "s2", 0], [97, words(rng, "en", 6000), "en", "s2", 0], [98, passage + "  x\t" + passage, "en", "s2", 0], [99, "ñandú  é\n\n<|endoftext|>  it's\r\n", "fr", "s1", 0]]
    return [tuple(r) for r in rows]


ROWS = corpus()
TEXT = {r[0]: r[1] or "" for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame(ROWS, SCHEMA)
    # columns whose names could clash with an operator's own
    return extra.select("*", *[F.lit(1).alias(c) for c in ("digest", "size", "k", "pos", "_id", "part", "rank", "task", "unit", "n", "id", "bands", "_copy")]).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sql(query, rows=ROWS):
    import duckdb
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    con = duckdb.connect()
    con.register("documents", documents)
    cur = con.execute(query)
    names = [d[0] for d in cur.description]
    return {r[names.index("doc_id")]: dict(zip(names, r, strict=True)) for r in cur.fetchall()}


def sql_of(query, **tables):
    """(names, rows) of a query over tables given as (rows, column names); types come from pandas with nullable integers."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for name, (rows, columns) in tables.items():
        df = pd.DataFrame(rows, columns=columns)
        con.register(name, df.astype({c: "Int64" for c in columns if c.endswith("_id") or c == "turn"}))
    cur = con.execute(query)
    return [d[0] for d in cur.description], cur.fetchall()


OPERATORS = {
    "suffix": suffix_dedup.suffix_dedup,
    "mixing": mixing.mixed,
    "curriculum": mixing.curriculum,
    "sharding": sharding.sharded,
    "exact": exact_dedup.exact_dedup,
    "deduplicate": exact_dedup.deduplicate,
    "packing": lambda d: packing.packed(d, tokenizer()),
    "language": langid.identify,
    "accepted": langid.accepted,
    "substring": substring_dedup.substring_dedup,
    "near": near_dedup.near_dedup,
    "thin": near_dedup.thin,
    "maxent": lambda d: maxent_lm.scored(d, maxent_lm.fold_of() % 7 == 2),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("deduplicate", "accepted", "thin", "curriculum", "packing")])
def test_repeated_rows_and_null_ids(spark, name):
    rows = [(1, "same text here it is", "en", "a", 0)] * 3 + [(2, "same text here it is", "en", None, 0), (None, "other words in a row", "en", "a", 0)]
    assert OPERATORS[name](spark.createDataFrame(rows, SCHEMA)).count() == 5


def long_rows():
    """Two near texts longer than a pass over a batch, with a passage that short texts share."""
    rng = random.Random(11)
    passage = words(rng, "en", 70)
    long = " ".join([words(rng, "en", 200_000), passage, words(rng, "fr", 200_000), passage])
    assert len(long) > common.PASS_BYTES
    changed = long.split(" ")
    changed[5:300_000:1000] = ["other"] * len(changed[5:300_000:1000])
    return [(1, long, "en", "a", 0), (2, " ".join(changed), "en", "b", 0), (3, words(rng, "fr", 30) + " " + passage, "fr", "b", 0), (4, None, "en", "a", 0), (5, "short", "fr", None, 0), (6, "short", "fr", None, 0)]


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = long_rows()
    return rows, spark.createDataFrame(rows, SCHEMA).coalesce(1)


@pytest.mark.parametrize(("name", "query"), [("suffix", OP1_SQL), ("mixing", OP2_SQL), ("exact", OP4_SQL), ("substring", OP7_SQL), ("near", OP8_SQL)])
def test_texts_beyond_one_pass(long_docs, name, query):
    rows, docs = long_docs
    got = by_id(OPERATORS[name](docs))
    for i, want in sql(query, rows).items():
        assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in want.items()} == {k: got[i][k] for k in want}


def test_long_texts_are_read_whole(long_docs):
    rows, docs = long_docs
    n = {r[0]: len(WORD.findall((r[1] or "").encode())) for r in rows}
    assert {i: r["n_tokens"] for i, r in by_id(OPERATORS["maxent"](docs)).items()} == {i: k + 1 for i, k in n.items()}
    pieces = OPERATORS["packing"](docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("k")).collect()
    assert all(r["n"] > n[r["doc_id"]] and r["k"] == -(-r["n"] // 2048) for r in pieces)
    assert {i: r["lang_pred"] for i, r in by_id(OPERATORS["language"](docs)).items()}.keys() == n.keys()


def brute_spans(symbols, k):
    """Symbols covered by runs of k that start anywhere else too."""
    count = collections.Counter(tuple(s[i : i + k]) if isinstance(s, list) else s[i : i + k] for s in symbols.values() for i in range(len(s) - k + 1))
    out = {}
    for key, s in symbols.items():
        edge = np.zeros(len(s) + 1, int)
        for i in range(len(s) - k + 1):
            if count[tuple(s[i : i + k]) if isinstance(s, list) else s[i : i + k]] > 1:
                edge[i] += 1
                edge[i + k] -= 1
        out[key] = np.cumsum(edge)[:-1] > 0
    return out


def check_suffix(docs):
    got, data = by_id(suffix_dedup.suffix_dedup(docs)), {i: t.encode() for i, t in TEXT.items()}
    for i, gone in brute_spans(data, 200).items():
        kept = bytes(np.frombuffer(data[i], np.uint8)[~gone]) if len(gone) else b""
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) == (len(data[i]), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept), i


def test_suffix_dedup(docs):
    check_suffix(docs)


def test_suffix_dedup_of_large_runs(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SMALL", 2)
    edge = np.random.default_rng(1)
    left, right = edge.integers(0, 2, (40, 184)).astype(np.uint8), edge.integers(0, 2, (40, 200)).astype(np.uint8)
    left[:, :90], right[:, :120] = 1, 1
    left[::3, :150], right[1::2, :160] = 1, 0
    order = suffix_dedup.deep_shallow_sort(right, np.full(40, 200))
    right, left = right[order], left[order]
    lcp = np.concatenate([[0], suffix_dedup.matched(right[1:], right[:-1], np.full(39, 200))])
    args = (np.cumsum(lcp < 100), lcp, right, np.full(40, 200), left, np.full(40, 184), 200)
    many = suffix_dedup.reaches(*args)
    monkeypatch.setattr(suffix_dedup, "SMALL", 100)
    pairs = suffix_dedup.reaches(*args)
    # a walk reports reaches by starts; where a pair reaches, so does the walk, and no further than some pair
    assert ((many[0] + many[1] > 0) == (pairs[0] + pairs[1] > 0)).all() and (many[1] == pairs[1]).all() and (many[0] == pairs[0]).all()


def test_deep_shallow_sort():
    rng = random.Random(3)
    strings = [bytes(rng.choices(b"ab", k=rng.randint(0, 90))) for _ in range(500)] + [b"a" * 80, b"a" * 81, b"a" * 80]
    matrix, lengths = np.zeros((len(strings), 96), np.uint8), np.array([len(s) for s in strings])
    for i, s in enumerate(strings):
        matrix[i, : len(s)] = np.frombuffer(s, np.uint8)
    assert [strings[i] for i in suffix_dedup.deep_shallow_sort(matrix, lengths)] == sorted(strings)


def test_substring_dedup(docs):
    got, data = by_id(substring_dedup.substring_dedup(docs)), {i: WORD.findall(t.encode()) for i, t in TEXT.items()}
    for i, gone in brute_spans(data, 35).items():
        kept = b" ".join(w for w, g in zip(data[i], gone, strict=True) if not g)
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(data[i]), int(gone.sum()), hashlib.sha256(kept).hexdigest()), i


def test_fingerprint_index_compacts(spark):
    index = substring_dedup.FingerprintIndex(spark, fanout=2)
    batch = lambda *h: spark.createDataFrame([(x, 1) for x in h], "h bigint, n bigint")
    assert index.add(batch(1, 2)).count() == 0
    assert [r["h"] for r in index.add(batch(2, 3)).collect()] == [2]
    assert {r["h"] for r in index.add(batch(1, 3, 4)).collect()} == {1, 3}
    assert index.compactions == 1 and len(index.runs) == 1
    assert {r["h"]: r["n"] for r in spark.table(index.runs[0]).collect()} == {1: 2, 2: 2, 3: 2, 4: 1}
    index.close()


def test_exact_dedup(docs):
    got, want = by_id(exact_dedup.exact_dedup(docs)), sql(OP4_SQL)
    assert {i: r.asDict() for i, r in got.items()} == want
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(docs).collect()) == sorted(i for i, r in want.items() if r["kept"])


def digest_of(x):
    return hashlib.sha256(str(x).encode()).digest()


def test_cuckoo_filter_inserts_deletes_and_is_stored():
    keys = [digest_of(i) for i in range(3000)]
    index = exact_dedup.CuckooFilter.of(keys, 3000)
    assert all(k in index for k in keys)
    for k in keys[:1500]:
        assert index.delete(k)
    index = exact_dedup.CuckooFilter.load(index.dump())
    assert index.count == 1500 and sum(k in index for k in keys[:1500]) < 30 and all(k in index for k in keys[1500:])


def test_probe_grows_and_hits_every_copy():
    import pyarrow as pa

    order = [i % 3500 for i in range(9000)]
    rows = pa.RecordBatch.from_arrays([pa.array([7] * 9000, pa.int32()), pa.array([exact_dedup.COMES] * 9000, pa.int32()), pa.array([digest_of(i) for i in order]), pa.array([None] * 9000, pa.binary())], names=["bucket", "op", "digest", "data"])
    out = [r for b in exact_dedup._probe([rows]) for r in b.to_pylist()]
    hits = [r["hit"] for r in out if r["op"] == exact_dedup.COMES]
    assert all(hits[3500:]) and sum(hits[:3500]) < 20
    assert exact_dedup.CuckooFilter.load(out[-1]["data"]).size * 4 > 2 * exact_dedup.ROOM


def test_exact_index_over_batches(spark):
    """Hits, supersession, deletion and growth against a dictionary."""
    index, live = exact_dedup.ExactIndex(spark, buckets=3), {}
    rng = random.Random(9)
    for step in range(4):
        batch = {i: f"text {rng.randrange(4000)}" for i in rng.sample(range(6000), 2500 if step else 900)}
        gone = rng.sample(sorted(live), len(live) // 10)
        left = {i: t for i, t in live.items() if i not in gone and i not in batch}
        docs = spark.createDataFrame(list(batch.items()), "doc_id bigint, text string")
        hits = {r["doc_id"]: r["hit"] for r in index.apply(docs, spark.createDataFrame([(i,) for i in gone], "doc_id bigint")).collect()}
        known, copies = set(left.values()), collections.Counter(batch.values())
        assert hits.keys() == batch.keys() and all(hits[i] for i, t in batch.items() if t in known)
        # one row of a text that is new may pass for new; false hits of texts that died or never were are rare
        new = collections.defaultdict(list)
        for i, t in batch.items():
            if t not in known:
                new[t].append(hits[i])
        assert all(sum(not h for h in found) <= 1 for found in new.values()) and sum(all(found) for found in new.values()) <= 0.02 * len(new) + 2
        assert copies
        live = left | batch
        want = collections.Counter(live.values())
        got = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in index.live().collect()}
        assert got == {hashlib.sha256(t.encode()).digest(): (max(i for i, x in live.items() if x == t), n) for t, n in want.items()}


def test_hits_are_compared_by_content(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "two")], "doc_id bigint, text string")
    hits = docs.select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    exact_dedup._verified(docs, hits, "text")
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(5).cast("bigint"))
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: real(F.lit("same"), n))
    with pytest.raises(ValueError, match="two texts share"):
        exact_dedup._verified(docs, docs.select(F.unhex(real(F.lit("same"), 256)).alias("digest")), "text")


def test_a_bitmap_parts_documents(spark):
    """Every key's own place is set, wherever it lies, and few documents pass by chance."""
    docs = spark.range(3000).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit(1).alias("among"))
    keys = docs.where("text < 'text 2'").select("text")
    some, alone = common.parted(docs, F.col("text"), keys)
    assert some.columns == docs.columns and some.count() + alone.count() == 3000
    assert keys.join(some, "text", "left_anti").count() == 0 and keys.count() <= some.count() <= keys.count() + 2
    at = [r["at"] for r in spark.range(1).select(F.explode(F.array(*map(F.lit, (0, 7, 8, 32767, 32768, common.PLACES - 1)))).alias("at")).collect()]
    kept = common.places
    try:
        common.places = lambda key: F.col(key).cast("bigint") if isinstance(key, str) else key.cast("bigint")
        bits = np.unpackbits(common.bitmap(spark.createDataFrame([(x,) for x in at], "at bigint")), bitorder="little")
    finally:
        common.places = kept
    assert np.flatnonzero(bits).tolist() == sorted(at)


def test_deduplicate_of_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, "a"), (2, "a"), (2, "a"), (None, "b"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *[F.lit(1).alias(c) for c in ("digest", "mark", "group_keep", "_keep", "_digest")])
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == [(0, "b"), (2, "a"), (2, "a"), (4, "")]


def test_sharding(docs):
    rows = by_id(sharding.sharded(docs, 4)).values()
    size = collections.Counter()
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(TEXT[r["doc_id"]].encode()) + 1, zlib.crc32(TEXT[r["doc_id"]].encode()))
        size[r["shard"]] += r["size"]
    shard = {r["doc_id"]: r["shard"] for r in rows}
    assert all(shard[a] == shard[b] for a in TEXT for b in TEXT if TEXT[a] == TEXT[b])
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert max(size.values()) <= max(60_001, sum(size.values()) / 4 * 1.1)


def test_lpt_is_balanced():
    sizes = sorted(random.Random(1).choices(range(1, 1000), k=500), reverse=True)
    bins = sharding.lpt(((s, i) for i, s in enumerate(sizes)), 8)
    load = collections.Counter()
    for i, b in bins.items():
        load[b] += sizes[i]
    assert max(load.values()) - min(load.values()) < 20


def test_mixing(docs):
    got, want = by_id(mixing.mixed(docs)), sql(OP2_SQL)
    assert {i: (r["size"], r["source_size"], r["target"], r["taken"], r["position"]) for i, r in got.items()} == {i: (r["size"], r["source_size"], r["target"], r["taken"], None if r["position"] != r["position"] else r["position"]) for i, r in want.items()}
    assert got == by_id(mixing.mixed(docs.repartition(3)))
    order = [r["position"] for r in mixing.mixed(docs).collect() if r["position"] is not None]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1
    copies = mixing.curriculum(docs, position="due").collect()
    size = collections.Counter()
    for r in copies:
        size[r["doc_id"]] += len(WORD.findall((r["text"] or "").encode()))
    assert size == {i: r["taken"] for i, r in got.items() if r["taken"]}
    due = [r["due"] for r in copies]
    assert due == sorted(due) and 0 <= due[0] and due[-1] <= 1
    firsts = {}
    for r in copies:
        firsts.setdefault(r["doc_id"], r["due"])
    assert firsts == {i: r["position"] for i, r in got.items() if r["taken"]}


def test_copies_lie_where_the_curve_has_their_counts(spark):
    """By bisection of each source's demand, not by its inverse."""
    rows = [(i, "w " * (i % 7 + 1), "en", f"s{i % 3}", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = by_id(mixing.mixed(docs))
    shapes = {"s0": (1.5, 0.5), "s1": (1.0, 1.0), "s2": (0.5, 1.5)}
    for source, (start, end) in shapes.items():
        at, quota = 0, None
        own = sorted((r for r in got.values() if r["source"] == source), key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest())
        quota = int(own[0]["target"] + 0.5)
        for walk in range(2):
            for r in own:
                if at < quota:
                    copy, low, high = r["copies"][walk], 0.0, 1.0
                    for _ in range(60):
                        t = (low + high) / 2
                        low, high = (t, high) if quota * (start * t + (end - start) * t * t / 2) < at else (low, t)
                    assert copy["position"] == pytest.approx(low, abs=1e-9) and copy["words"] == min(r["size"], quota - at)
                at += r["size"]


def test_mixing_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c", "en", "x", 0), (1, "d e", "en", "x", 0), (1, "d e", "en", "x", 0), (2, None, "en", None, 0), (3, "f " * 500, "en", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert mixing.mixed(docs).count() == 5
    assert {r["doc_id"] for r in mixing.curriculum(docs).collect()} == {None, 1, 3}


def test_targets_reshare_the_excess():
    found = mixing.targets([("a", 10), ("b", 1000), (None, 1000)])
    assert found["a"] == (5, 20.0) and found["b"][1] == pytest.approx(2 * 2995 / 3) and found[None][1] == pytest.approx(2995 / 3)


def test_due_inverts_the_demand(spark):
    row = spark.range(1).select(*[mixing.due(F.lit(x), F.lit(100.0), F.lit(1.5), F.lit(0.5)).alias(str(x)) for x in (0, 50, 100)]).first()
    t = row[1]
    assert row[0] == 0 and row[2] == pytest.approx(1) and 100 * (1.5 * t - 0.5 * t * t) == pytest.approx(50)


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer())
    rows = packing.packed(docs, tokenizer(), capacity=256).collect()
    held, used = collections.defaultdict(list), collections.defaultdict(int)
    for r in rows:
        held[r["doc_id"]].append(r)
        used[r["sequence_id"]] += r["length"]
    for i, t in TEXT.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        own = sorted(held[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == 256 for r in own[1:]) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    for s in used:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert len(used) <= 1.02 * sum(used.values()) / 256 + 2


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(5)
    lengths = [rng.randint(1, 100) for _ in range(3000)]
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            opened += 1
            gaps.append(100 - n)
    plan = packing.best_fit(collections.Counter(lengths), 100)
    ids = {first + k for length, rank, first, each, offset in plan for k in range(1)}
    assert max(ids) <= opened <= max(f for _, _, f, _, _ in plan) + len(lengths)


def test_words_remembered_match_the_tokenizer():
    from tokenizers import Tokenizer

    ids, tok = packing.ids_of(tokenizer()), Tokenizer.from_file(tokenizer())
    rng = random.Random(2)
    parts = ["a", "The", "don't", "we'll", "x1", "12", "é", "ñandú", "…", "--", "'s", " ", "\n", "  ", "\t", "\r\n", " \n", " ", "日本", ".", "<|endoftext|>", " "]
    for _ in range(400):
        t = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert np.frombuffer(ids.packed(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_language(docs, spark, sf):
    got = by_id(langid.identify(docs))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (90, 91, 92, 93))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in TEXT)
    real = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.identify(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert langid.accepted(real).count() >= real.count() - 2 and langid.accepted(real).columns == real.columns


def test_language_without_labels(spark):
    d = spark.createDataFrame([(1, "some text", None, "a", 0)], SCHEMA)
    assert langid.identify(d).first()["lang_pred"] == "und"


def brute_classes(texts, similarity=0.8):
    """Links by weighted Jaccard over five-word shingles, and the least id of each text's component."""
    sets, where = {}, collections.defaultdict(list)
    for i, t in texts.items():
        w = WORD.findall(t.encode())
        sets[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
        for k in sets[i]:
            where[k].append(i)
    total = {i: sum(s.values()) for i, s in sets.items()}
    links, label = set(), {i: i for i in texts}
    for a in sorted(texts):
        both = collections.Counter()
        for k, n in sets[a].items():
            for b in where[k]:
                if b > a:
                    both[b] += min(n, sets[b][k])
        links |= {(a, b) for b, n in both.items() if n >= (similarity - 1e-12) * (total[a] + total[b] - n)}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        one, two = find(a), find(b)
        label[max(one, two)] = min(one, two)
    return links, {i: find(i) for i in texts}


def test_near_dedup_recall_of_links(spark, sf):
    """Every pair of different texts that brute force links must be in one class, on the 1,000 documents of the next size."""
    at = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    links, want = brute_classes(texts)
    got = {i: r["class_id"] for i, r in by_id(near_dedup.near_dedup(docs)).items()}
    assert sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links) > 0
    assert all(want[i] == want[c] for i, c in got.items() if texts[i].split())


def test_near_dedup_of_a_chained_group(spark):
    """One group whose members are near their neighbours only: the leader settles few, the prefix join the rest."""
    rng = random.Random(11)
    base = words(rng, "en", 160).split()
    rows = []
    for i in range(60):  # member i has its own changes at i // 3 .. i // 3 + 4, shared with members of like i
        own = list(base)
        for k in range(i // 3, i // 3 + 5):
            own[k * 7 % 160] = f"edit{k}"
        own[i % 160] = f"own{i}" if i % 5 == 0 else own[i % 160]
        rows.append((i, " ".join(own)))
    links, want = brute_classes(dict(rows))
    got = {i: r["class_id"] for i, r in by_id(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))).items()}
    assert len(set(want.values())) < 40 and len(links) > 60
    assert got == want


def test_rest_finds_every_link_that_leaders_leave(spark):
    """The prefix join against all pairs, with one leader for all members and counts above one."""
    rng = random.Random(5)
    base = words(rng, "en", 90).split() + ["echo"] * 40
    rows = {}
    for i in range(80):
        own = list(base)
        for _ in range(rng.randint(2, 9)):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(12)}"
        rows[i] = " ".join(own[: rng.randint(110, 130)])
    digest = {i: hashlib.sha256(t.encode()).digest() for i, t in rows.items()}
    assert len(set(digest.values())) == 80
    texts = spark.createDataFrame([(bytearray(digest[i]), t) for i, t in rows.items()], "digest binary, text string")
    pairs = spark.createDataFrame([(bytearray(digest[i]), bytearray(digest[0])) for i in range(1, 80)], "a binary, b binary")
    tried = near_dedup.compared(pairs, texts)
    none = spark.createDataFrame([], "node binary, label binary")
    back = {d: i for i, d in digest.items()}
    near = {tuple(sorted((back[bytes(r["a"])], back[bytes(r["b"])]))) for r in near_dedup._rest(tried, none, texts, 0.8).collect()}
    want = {p for p in brute_classes(rows)[0] if 0 not in p}
    assert want and want <= near


def test_near_dedup_of_null_and_repeated_ids(spark):
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(None, long), (3, long), (3, long), (4, long + " end"), (4, "something else entirely"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("stay_id", F.lit(1)).withColumn("digest", F.lit(2))
    got = sorted(((r["doc_id"] or 0, r["class_id"], r["class_size"], r["kept"]) for r in near_dedup.near_dedup(docs).collect()), key=repr)
    assert got == sorted([(0, None, 4, True), (3, None, 4, False), (3, None, 4, False), (4, None, 4, False), (4, 4, 1, True), (5, 5, 2, True), (6, 5, 2, False)], key=repr)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in near_dedup.thin(docs).collect() if r["text"]) == [(0, long), (4, "something else entirely")]


def test_near_dedup(docs):
    label = brute_classes(TEXT)[1]
    label |= {i: 90 for i in (90, 91)}  # equal texts without words
    got = by_id(near_dedup.near_dedup(docs))
    assert {i: r["class_id"] for i, r in got.items()} == label
    size = collections.Counter(label.values())
    assert all(r["class_size"] == size[r["class_id"]] and r["kept"] == (i == label[i]) for i, r in got.items())
    assert sorted(r["doc_id"] for r in near_dedup.thin(docs).collect()) == sorted(size)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    keys, size = rng.integers(0, 2**63, 300).astype(np.uint64), 2000
    one, two = rng.integers(1, 40, 300), rng.integers(1, 40, 300)
    true = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    sig = near_dedup.signatures(np.repeat([0, 1], 300), np.concatenate([keys, keys]), np.concatenate([one, two]), 2, size)
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / size)


def test_maxent(docs):
    import math

    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    tokens = {i: [*WORD.findall(t.encode().translate(low)), None] for i, t in TEXT.items()}
    train = [i for i in TEXT if zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(t for i in train for t in tokens[i])
    n, v = sum(count.values()), len(count)
    got = by_id(maxent_lm.scored(docs, maxent_lm.fold_of() % 7 == 2))
    for i, own in tokens.items():
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in train, len(own), sum(count[t] > 0 for t in own), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0


def test_maxent_beats_its_base_on_held_out_text(spark, sf):
    rows = maxent_lm.scored(spark.read.parquet(f"{sf}/documents.parquet"), maxent_lm.fold_of() % 7 == 2).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_class_probabilities_sum_to_one():
    w, b = np.random.default_rng(0).normal(size=(maxent_lm.FEATURES, maxent_lm.CLASSES)), np.zeros(maxent_lm.CLASSES)
    assert np.exp(maxent_lm.log_softmax(w, b, maxent_lm.features(np.arange(maxent_lm.STATES**2)))).sum(1) == pytest.approx(1)


def test_word_probabilities_sum_to_one():
    """All words of a bucket and one unknown word; all buckets of a class."""
    key = np.unique(np.random.default_rng(1).integers(0, 2**62, 500).astype(np.uint64))
    count = np.arange(len(key)) % 7 + 1
    own = maxent_lm.buckets(key, maxent_lm.classes(key, key[:5]))
    hashed = own[own >= 0]
    sums = np.bincount(hashed, weights=count[own >= 0], minlength=maxent_lm.INSIDE) + np.bincount(hashed, minlength=maxent_lm.INSIDE)
    model = maxent_lm.Model(key[:5], key[:5], None, None, None, None, np.log10(sums + 1.0))
    p = 10 ** model.of_words(key, count)
    for b in range(maxent_lm.INSIDE):
        assert p[own == b].sum() + 10 ** -model.inside[b] == pytest.approx(1)
    rng = np.random.default_rng(2)
    table = maxent_lm.inner_softmax(rng.normal(size=(2 * maxent_lm.STATES, maxent_lm.HASHED, maxent_lm.BUCKETS)), np.zeros((maxent_lm.HASHED, maxent_lm.BUCKETS)), rng.integers(0, 256, 50), rng.integers(0, 256, 50), rng.integers(0, 32, 50))
    assert np.exp(table).sum(1) == pytest.approx(1)


def test_scores_by_one_word_after_the_other(docs, monkeypatch):
    """Every factor of every score again, in plain loops over the words, from the trained weights."""
    import math

    kept = []
    plain = maxent_lm.train
    monkeypatch.setattr(maxent_lm, "train", lambda counts, inside: kept.append(plain(counts, inside)) or kept[-1])
    tops = []
    found = maxent_lm.frequent_words
    monkeypatch.setattr(maxent_lm, "frequent_words", lambda d: tops.append(found(d)) or tops[-1])
    got = by_id(maxent_lm.scored(docs, maxent_lm.fold_of() % 7 == 2))
    (weights, bias, inner, inner_bias), top = kept[0], tops[0]
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    key_of, texts = {}, {i: WORD.findall(t.encode().translate(low)) for i, t in TEXT.items()}
    for i, own in texts.items():
        keys, _ = maxent_lm.tokens(np.frombuffer(b" ".join(own), np.uint8), np.array([0, len(b" ".join(own))]))
        key_of |= dict(zip(own, map(int, keys), strict=False))
    train = [w for i, own in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in own]
    count = collections.Counter(train)
    ranked = sorted(count, key=lambda w: (-count[w], np.uint64(key_of[w]).astype(np.int64)))
    assert [key_of[w] for w in ranked[: maxent_lm.NAMED]] == [int(k) for k in top]
    frequent, named = sorted(int(k) for k in top[: maxent_lm.FREQUENT]), sorted(int(k) for k in top)
    class_of = lambda w: maxent_lm.END_CLASS if w is None else maxent_lm.HASHED + frequent.index(key_of[w]) if key_of[w] in frequent else key_of[w] % maxent_lm.HASHED
    members = collections.defaultdict(set)
    bucket_of = lambda w: (class_of(w), key_of[w] >> 59)
    for w in count:
        members[bucket_of(w)].add(w)

    def state(w):
        if w is None:
            return maxent_lm.BORDER
        return named.index(key_of[w]) if key_of[w] in named else int(maxent_lm.states(np.array([key_of[w]], np.uint64), np.array(named, np.uint64))[0])

    for i in list(texts)[:40]:
        own, score = [None, None, *texts[i], None], 0.0
        for k in range(2, len(own)):
            f = maxent_lm.features(np.array([state(own[k - 2]) * maxent_lm.STATES + state(own[k - 1])]))[0]
            z = [sum(weights[x][c] for x in f) + bias[c] for c in range(maxent_lm.CLASSES)]
            top_z, c = max(z), class_of(own[k])
            score += (z[c] - top_z - math.log(sum(math.exp(v - top_z) for v in z))) / math.log(10)
            if c < maxent_lm.HASHED:
                c, b = bucket_of(own[k])
                z = [float(inner[state(own[k - 1])][c][x] + inner[maxent_lm.STATES + state(own[k - 2])][c][x] + inner_bias[c][x]) for x in range(maxent_lm.BUCKETS)]
                score += (z[b] - max(z) - math.log(sum(math.exp(v - max(z)) for v in z))) / math.log(10)
                score += math.log10((count[own[k]] + 1) / (sum(count[w] for w in members[c, b]) + len(members[c, b]) + 1))
        assert got[i]["score"] == pytest.approx(score, rel=1e-5), i


def test_uneven_ids_do_not_meet_in_one_unit(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "UNIT", 4)
    rows = [(i, f"word{i % 5} again", "en", "a", 0) for i in range(100)] + [(10**15, "far away", "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    units, many = maxent_lm._units(docs, "bigint")
    assert many == 101 and max(r["count"] for r in units.groupBy("unit").count().collect()) < 20
    assert maxent_lm.scored(docs, maxent_lm.fold_of() % 7 == 2).count() == 101


def clashing_rows():
    """Ids of several texts, null ids with repeated content, rows that repeat id and text, and a passage among them all."""
    rng = random.Random(5)
    passage = words(rng, "en", 60)
    around = lambda n: words(rng, "fr", n)
    rows = [(1, around(40) + " " + passage + " " + around(50)), (1, passage + " " + around(90)), (1, around(300)), (2, "short")]
    rows += [(None, around(20) + " " + passage), (None, around(70)), (None, passage + " " + around(10))]
    rows += [(3, around(60) + " " + around(30))] * 1 + [(4, around(80))] * 3 + [(5, None), (5, ""), (None, None)]
    return [(i, t, "en", "a", 0) for i, t in rows]


@pytest.mark.parametrize(("name", "query"), [("suffix", OP1_SQL), ("substring", OP7_SQL), ("exact", OP4_SQL)])
def test_ids_of_several_texts(spark, name, query):
    import duckdb
    import pandas as pd

    rows = clashing_rows()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"}))
    cur = con.execute(query)
    names = [d[0] for d in cur.description]
    got = OPERATORS[name](spark.createDataFrame(rows, SCHEMA).repartition(3)).select(*names)
    if name == "exact":  # null ids rank last in the operator and are left out by SQL's max
        got = got.select([c for c in names if c in ("group_size", "text_sha256")])
        names_used = [names.index(c) for c in got.columns]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in names_used)) for r in cur.fetchall())
        return
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, cur.fetchall()))


def test_scores_of_ids_with_several_texts(spark):
    rows = clashing_rows()
    got = OPERATORS["maxent"](spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len((t or "").split()) + 1 for _, t, *_ in rows)


def test_scores_whatever_the_files(spark):
    """Frequent words, classes and scores don't depend on how rows are dealt to tasks."""
    rng = random.Random(3)
    lexicon = [words(rng, "en", 1) + str(i) for i in range(3000)]
    rows = [(i, " ".join(rng.choices(lexicon, k=120)), "en", "a", 0) for i in range(250)]
    seen = []
    for parts in (1, 3, 7):
        seen.append({r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in OPERATORS["maxent"](spark.createDataFrame(rows, SCHEMA).repartition(parts, "doc_id")).collect()})
    assert all(seen[0][i] == pytest.approx(s[i], abs=1e-3) for s in seen[1:] for i in seen[0])


def test_units_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "UNIT_BYTES", 4000)
    docs = spark.createDataFrame([(i, "ab " * (1000 if i == 7 else 100), "en", "a", 0) for i in range(100)], SCHEMA)
    units, many = maxent_lm._units(docs, "bigint")
    assert many == 100
    assert all(r["b"] <= 12_000 for r in units.groupBy("unit").agg(F.sum(F.length("text")).alias("b"), F.count("*").alias("n")).collect())
