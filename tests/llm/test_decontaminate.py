"""Benchmark decontamination against brute force: windows, short items, copies, nulls, several scans."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from test_texts import sql_of

from webquarry.llm import decontaminate
from webquarry.llm.queries import OP11_SQL

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fixture():
    rng = random.Random(8)
    lexicon = [f"w{i}" for i in range(60)] + ["Été", "straße", "ÉTÉ", "x2", "naïve"]
    say = lambda n: " ".join(rng.choices(lexicon, k=n))
    items = [(i, say(rng.choice([12, 15, 30, 10]))) for i in range(12)]
    items += [(20, items[0][1] + " " + say(5)), (21, say(3) + " Once only-here, twice"), (22, "tiny item"), (23, "word"), (24, None), (25, "..."), (26, ""), (None, items[1][1]), (27, items[2][1]), (27, say(20)), (28, "the the the the the the the the the the the the")]
    docs = []
    for i in range(40):
        parts = [say(rng.choice([0, 5, 40]))]
        if i % 3 == 0:
            w = items[i % 12][1].split()
            at = rng.randrange(max(1, len(w) - 9))
            parts += [" ".join(w[at : at + rng.choice([9, 10, 13])]), say(6)]
        if i % 5 == 0:
            parts.append("TINY, item!")
        docs.append((i, rng.choice([" ", ", ", "\n", " – "]).join(parts)))
    docs += [(50, items[3][1].upper()), (50, "another text"), (50, None), (None, items[4][1]), (None, items[4][1]), (51, ""), (52, "a word"), (53, "the " * 30), (54, "été"), (55, items[5][1] + " " + items[5][1])]
    docs += [(60 + k, items[6][1] + " tail") for k in range(5)]
    docs.append((70, " ".join([say(30_000), items[7][1], say(30_000)])))
    return docs, items


def brute(docs, items, window=10):
    split = lambda t: WORD.findall((t or "").translate(ASCII))
    known = {}
    for i, t in items:
        w = split(t)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            known.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    sizes = {len(x) for x in known}
    out = []
    for i, t in docs:
        w = split(t)
        hit, own = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in known:
                    hit |= set(range(k, k + size))
                    own |= known[x]
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    clash = lambda df: df.select("*", *[F.lit(1).alias(c) for c in ("key", "w", "pos", "token", "size", "start")])
    return clash(spark.createDataFrame(docs, DOCS).repartition(4)), clash(spark.createDataFrame(items, ITEMS))


@pytest.mark.parametrize("limits", [{}, {"BLOCK_BYTES": 4000}])
def test_against_brute_force(spark, monkeypatch, limits):
    for name, v in limits.items():
        monkeypatch.setattr(decontaminate, name, v)
    docs, items = fixture()
    got = sorted((tuple(r) for r in decontaminate.verdicts(*frames(spark, docs, items)).collect()), key=repr)
    assert got == brute(docs, items) and sum(r[5] for r in got) > 15


def test_sql_agrees():
    docs, items = fixture()
    assert sorted(sql_of(OP11_SQL, documents=(docs, ["doc_id", "text"]), benchmark=(items, ["item_id", "text"]))[1], key=repr) == brute(docs, items)


def test_spans(spark):
    docs, items = frames(spark, [(1, "a b one two three four c one two three"), (2, "clean")], [(1, "one two three"), (2, "two three four")])
    rows = {r["doc_id"]: r for r in decontaminate.decontaminated(docs, items).collect()}
    assert [tuple(s) for s in rows[1]["spans"]] == [(2, 6), (7, 10)] and rows[1]["n_hit"] == 7 and rows[1]["items"] == ["1", "2"]
    assert rows[2]["spans"] == [] and rows[2]["items"] == []


def test_empty_tables(spark):
    docs, items = fixture()
    assert decontaminate.verdicts(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
    rows = decontaminate.verdicts(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).collect()
    assert len(rows) == len(docs) and not any(r["contaminated"] for r in rows)


def test_rarest_shingles_are_joined(spark, monkeypatch):
    """A window of a common phrase and a rare one is looked for by the rare one."""
    seen = []
    monkeypatch.setattr(decontaminate, "cut", lambda df, name, cut=decontaminate.cut: (seen.append((name, out := cut(df, name))), out)[1])
    docs = [(i, "common words all around the place " + ("where rare things hide" if i == 3 else "again")) for i in range(30)]
    items = [(1, "common words all around the place where rare things hide")]
    assert sum(r["contaminated"] for r in decontaminate.verdicts(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()) == 1
    tables = dict(seen)
    assert [(r["place"], r["size"]) for r in tables["prefixes"].collect()][0][0] >= 4
    assert max(r["many"] for r in tables["rarity"].collect()) == 30


def test_no_python_runs(spark):
    docs, items = frames(spark, *fixture())
    plan = decontaminate.places(docs.select(F.lit("k").alias("key"), "doc_id", decontaminate.words("text").alias("w")), [3])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
