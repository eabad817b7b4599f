"""The stages one after the other, each against a plain account of what it must keep."""

import collections

import pytest
from test_texts import brute_classes, words

import corpus_pipeline
from webquarry.llm import langid, mixing


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen.append((name, before.count(), docs.count()))
        if name == "packing":
            used = collections.Counter()
            for r in docs.collect():
                used[r["sequence_id"]] += r["length"]
            assert max(used.values()) <= 2048 and len(used) <= 1.01 * sum(used.values()) / 2048 + 2
            break
        assert docs.columns == columns
        rows = [(r["doc_id"], r["text"] or "") for r in before.collect()]
        kept = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        if name == "language_id":
            und = {r["doc_id"] for r in langid.identify(before).where("lang_pred = 'und'").collect()}
            assert not und & {i for i, _ in kept} and set(kept) <= set(rows)
        if name == "exact_dedup":
            last = {}
            for i, t in rows:
                last[t] = max(last.get(t, -1), i)
            assert sorted(kept) == sorted((i, t) for t, i in last.items())
        if name == "near_dedup":
            label = brute_classes(dict(rows))[1]
            assert sorted(kept) == sorted((i, t) for i, t in rows if label[i] == i)
        if name == "mixing":
            taken = {r["doc_id"]: (r["taken"], [c["position"] for c in r["copies"]]) for r in mixing.mixed(before).collect() if r["taken"]}
            many, due = collections.Counter(), []
            for i, t in kept:  # in the order of the files
                due.append(taken[i][1][many[i]])
                many[i] += 1
            assert due == sorted(due) and {i: len(p) for i, (_, p) in taken.items()} == many
            size = collections.Counter()
            for i, t in kept:
                size[i] += len(t.split())
            assert {i: n for i, (n, _) in taken.items()} == pytest.approx(size)
    assert seen[0][2] >= 0.98 * seen[0][1]


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_on_odd_rows(spark, tmp_path):
    import random

    rng = random.Random(4)
    long = words(rng, "en", 60)
    rows = [(None, long, "en", None, 0), (1, long, "en", "a", 0), (1, long, "en", "a", 0), (2, None, "fr", "a", 0), (3, "", None, None, 0), (4, " 12 ", "en", "b", 0), (5, long + " more", "en", "b", 0), (6, words(rng, "fr", 4000), "fr", "b", 0), (7, words(rng, "fr", 30), "fr", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.selectExpr("*", *[f"1 as `{c}`" for c in ("digest", "mark", "among", "key", "copy", "plan", "position", "gone_id", "stay_id", "part", "unit")])
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted((r["doc_id"] or 0) for r in docs.collect())
    assert kept["language_id"] == [0, 1, 1, 5, 6, 7]
    assert kept["exact_dedup"] == [1, 1, 5, 6, 7]  # rows that repeat id and text stay together
    assert kept["near_dedup"] == [1, 1, 6, 7]
    assert set(kept["mixing"]) == {1, 6, 7}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r["doc_id"] for r in packed.collect()} == {1, 6, 7}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, name):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, "").count() == 0
