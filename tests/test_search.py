import random

import pytest
from pyspark.sql import functions as F

from webquarry.model import DOCUMENT
from webquarry.operators.documents import collection_documents, derive, merge_pages
from webquarry.plans import search as S
from webquarry.plans.textindex import TextIndex


def corpus(spark, rows):
    base = {"crawl_id": "c1", "crawl_name": "Crawl", "collection": "col", "url": "", "timestamp": "20210101000000", "title": "", "body": "", "description": "", "headings": "", "keywords": "", "author": "", "lang": "", "media_type": "html", "status": 200, "modified": None}
    full = [base | {"doc_id": i, "url": f"http://example.com/{i}"} | r for i, r in enumerate(rows)]
    names = ["doc_id", *base]
    schema = "doc_id bigint, " + ", ".join(f"{n} {'int' if n in ('status', 'modified') else 'string'}" for n in base)
    return derive(spark.createDataFrame([tuple(r[n] for n in names) for r in full], schema))


def ids(df):
    return [r["doc_id"] for r in df.orderBy(F.desc("score"), "doc_id").collect()]


def find(spark, rows, q):
    return ids(S.matches(TextIndex.of(corpus(spark, rows)), q))


def test_and_across_words_and_fields(spark):
    rows = [{"body": "alpha beta"}, {"body": "alpha gamma"}, {"title": "alpha", "body": "beta"}]
    assert sorted(find(spark, rows, "alpha beta")) == [0, 2]
    assert find(spark, rows, "beta gamma") == []


def test_title_over_body(spark):
    assert find(spark, [{"body": "a kangaroo here"}, {"title": "kangaroo", "body": "something else"}], "kangaroo") == [1, 0]


def test_phrase_needs_order(spark):
    rows = [{"body": "web archive search"}, {"body": "archive web"}, {"headings": "web archive"}]
    assert find(spark, rows, '"web archive"') == [0]


def test_filters(spark):
    rows = [{"body": "x", "status": 200, "modified": 2015}, {"body": "x", "status": 404, "modified": 2020}, {"body": "x", "timestamp": "20230101000000", "status": None, "url": "http://blog.example.org/"}]
    assert find(spark, rows, "x status:200") == [0]
    assert find(spark, rows, "status:[400 TO 499]") == [1]
    assert find(spark, rows, "modified:2020") == [1]
    assert find(spark, rows, "year:[2022 TO 2024]") == [2]
    assert find(spark, rows, "site:example.com") == [0, 1]
    assert find(spark, rows, "domain:blog.example.org") == [2]


def test_exclusions_alone_match_nothing(spark):
    assert find(spark, [{"body": "x"}], "-y") == []
    assert find(spark, [{"body": "x"}, {"body": "x y"}], "x -y") == [0]


def test_collapse_counts_captures(spark):
    rows = [{"body": "demo", "url": "http://e.com/a"}] * 3 + [{"body": "demo", "url": "http://e.com/b"}]
    found = S.search(TextIndex.of(corpus(spark, rows)), "demo")
    assert sorted((r["url"], r["capture_count"]) for r in found.hits.collect()) == [("http://e.com/a", 3), ("http://e.com/b", 1)]
    assert found.totals() == {"total_hits": 2, "total_captures": 4, "capped": False}


def test_pages_do_not_overlap(spark):
    index = TextIndex.of(corpus(spark, [{"body": "same text"}] * 25))
    one = {r["doc_id"] for r in S.search(index, "same").hits.collect()}
    two = {r["doc_id"] for r in S.search(index, "same", offset=20).hits.collect()}
    assert len(one) == 20 and len(two) == 5 and not one & two


def test_facets_and_timeline_follow_the_query(spark):
    rows = [{"body": "demo", "timestamp": "20210301000000"}] * 2 + [{"body": "demo", "timestamp": "20230701000000", "media_type": "pdf", "url": "http://other.org/"}, {"body": "none", "timestamp": "20210101000000"}]
    found = S.search(TextIndex.of(corpus(spark, rows)), "demo year:2021")
    facets = {(r["field"], r["value"]): r["n"] for r in found.facets.collect()}
    assert facets == {("collection", "col"): 2, ("year", "2021"): 2, ("site", "example.com"): 2, ("type", "html"): 2}
    assert [(r["month"], r["n"]) for r in S.timeline(corpus(spark, rows)).collect()] == [(202101, 1), (202103, 2), (202307, 1)]


def test_good_captures_first_inside_the_page(spark):
    rows = [{"url": "http://e.com/", "status": None}, {"url": "http://e.com/", "status": 200}]
    assert [r["status"] for r in S.collection_pages(TextIndex.of(corpus(spark, rows)), "col", url="http://e.com/").collect()] == [200, None]


def test_snippets_mark_and_escape(spark):
    body = "filler " * 200 + "the <needle> & more " + "filler " * 200
    hit = S.search(TextIndex.of(corpus(spark, [{"body": body}])), "needle").hits.first()
    assert "&lt;<b>needle</b>&gt; &amp; more" in hit["snippet"] and len(hit["body_excerpt"]) == 301


def test_match_beyond_the_snip_is_found_without_highlight(spark):
    hit = S.search(TextIndex.of(corpus(spark, [{"body": "head " + "x " * 20_000 + "tailword"}])), "tailword").hits.first()
    assert hit["snippet"] == "" and hit["display_text"].startswith("head")


@pytest.mark.parametrize("q", ['"hello', "title:", "((", "a OR", ""])
def test_malformed_queries_do_not_fail(spark, q):
    S.matches(TextIndex.of(corpus(spark, [{"body": "a"}])), q).collect()


def test_stored_index_gives_the_same_scores(spark, tmp_path):
    docs = corpus(spark, [{"body": "alpha beta alpha", "title": "beta"}, {"body": "alpha"}, {"headings": "beta alpha"}])
    TextIndex.write(docs, str(tmp_path / "i"))
    for q in ("alpha beta", '"alpha beta"', "alpha -beta"):
        rows = [{(r["doc_id"], round(r["score"], 9)) for r in S.matches(i, q).collect()} for i in (TextIndex.of(docs), TextIndex.open(spark, str(tmp_path / "i")))]
        assert rows[0] == rows[1]


def test_merge(spark):
    schema = "crawl_id string, url string, seq bigint, kind string, timestamp string, title string, body string, description string, headings string, keywords string, author string, lang string, media_type string, status int, modified int"
    r = lambda url, seq, kind, ts, title, body, status=None: ("c", url, seq, kind, ts, title, body, "", "", "", "", "", "html", status, None)
    rows = [r("a", 0, "html", "1", "First", "one", 404), r("a", 1, "html", "2", "", "two", 200), r("a", 2, "text", "3", "Other", "rendered"), r("b", 3, "text", "9", "T", "only text"), r("c", 4, "html", "1", "", "")]
    out = {x["url"]: x for x in merge_pages(spark.createDataFrame(rows, schema)).collect()}
    assert (out["a"]["title"], out["a"]["body"], out["a"]["timestamp"], out["a"]["status"]) == ("First", "rendered", "2", 200)
    assert (out["b"]["title"], out["b"]["timestamp"], out["b"]["media_type"]) == ("T", "9", "html") and "c" not in out


def test_collection_documents_fit_the_schema(spark):
    crawl = spark.createDataFrame([(1, "c1", "Name", None, "about", "2020-01-01", [("http://x/", "X", None)])], "doc_id bigint, id string, name string, collection string, description string, created string, seed_pages array<struct<url:string,title:string,ts:string>>")
    out = collection_documents(crawl)
    assert out.columns == DOCUMENT.names and out.first()["body"] == "about X http://x/" and out.first()["doc_type"] == "collection"


@pytest.mark.parametrize("limits", [{"OPENING": 4}, {"OPENING": 1, "LISTED": 6}, {"OPENING": 2, "RANGES": 1}])
def test_bounds_give_the_rows_of_a_full_scan(spark, tmp_path, monkeypatch, limits):
    from webquarry.plans import textindex

    monkeypatch.setattr(textindex, "BLOCK_DOCS", 20)
    monkeypatch.setattr(S, "FREQUENT", 1)
    for name, v in limits.items():
        monkeypatch.setattr(S, name, v)
    rng = random.Random(5)
    rows = [{"body": " ".join(["common"] * rng.randint(1, 3 + 20 * (i // 20 == 7)) + rng.choices(["river", "hill", "town"], k=rng.randint(0, 12)) + (["rare"] if i % 97 == 5 else [])), "title": "common" if i % 200 == 0 else "x"} for i in range(400)]
    docs, root = corpus(spark, rows), str(tmp_path / "i")
    textindex.TextIndex.write(docs.where("doc_id % 3 > 0"), root, "a")
    textindex.TextIndex.write(docs.where("doc_id % 3 = 0"), root, "b")
    index = TextIndex.open(spark, root, ["a", "b"])
    seen = []
    monkeypatch.setattr(textindex.TextIndex, "within", lambda self, ranges, within=textindex.TextIndex.within: (seen.append(ranges), within(self, ranges))[1])
    for q, caps in {"common": (5, 40, 1000), "common rare": (5,), "river OR hill": (5,), "common -river": (5,), "nowhere": (5,), "common^3 (river OR rare) -town": (5, 40)}.items():
        for cap in caps:
            want = [(r["doc_id"], round(r["score"], 9)) for r in S.candidates(S.matched_ids(index, q), cap).collect()]
            assert [(r["doc_id"], round(r["score"], 9)) for r in S.best_ids(index, q, cap).collect()] == want, (q, cap)
    if limits == {"OPENING": 4}:
        seen.clear()
        S.best_ids(index, "common", 5).collect()
        assert sum(high - low for _, low, high in seen[-1]) <= 400  # half of the ids of both segments' blocks, at most
        plan = S.best_ids(index, "common rare", 5)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(doc_id" in plan and "LessThan(doc_id" in plan


def test_postings_are_gathered_in_the_documents_tasks(spark):
    from webquarry.plans.textindex import all_postings

    rows = [{"doc_id": 0, "title": "b a", "body": "a b a c É"}, {"doc_id": 1, "body": ""}, {"doc_id": 2, "headings": "a", "body": "c c c"}]
    found = all_postings(corpus(spark, rows).where("doc_id >= 0"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["field"], r["term"], r["doc_id"]): (r["tf"], r["len"], r["positions"]) for r in found.where("field <> 'url_tokens'").collect()}
    assert got == {("title", "b", 0): (1, 2, [0]), ("title", "a", 0): (1, 2, [1]), ("body", "a", 0): (2, 5, [0, 2]), ("body", "b", 0): (1, 5, [1]), ("body", "c", 0): (1, 5, [3]), ("body", "é", 0): (1, 5, [4]), ("headings", "a", 2): (1, 1, None), ("body", "c", 2): (3, 3, [0, 1, 2])}


def test_bounds_of_a_run_over_batches():
    import pyarrow as pa

    from webquarry.plans.textindex import _bounds

    rows = [("a", "body", 3, 1, 9), ("a", "body", 4, 5, 7), ("a", "body", 9, 2, 8), ("a", "body", 14, 1, 1), ("a", "title", 14, 1, 2), ("b", "title", 14, 3, 4)]
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["term", "field", "doc_id", "tf", "len"])
    for cut in range(1, len(rows)):
        out = [tuple(r.values()) for b in _bounds(3, 10)(iter([batch(rows[:cut]), batch(rows[cut:])])) for r in b.to_pylist()]
        assert out == [("a", "body", 3, 3, 5, 7), ("a", "body", 13, 1, 1, 1), ("a", "title", 13, 1, 1, 2), ("b", "title", 13, 1, 3, 4)]


def test_large_segments_deal_buckets_to_several_files(spark, tmp_path, monkeypatch):
    from webquarry.plans import textindex

    for name, v in (("PART_TOKENS", 8), ("BLOCK_DOCS", 5), ("BUCKETS", 4)):
        monkeypatch.setattr(textindex, name, v)
    docs = corpus(spark, [{"body": "alpha beta " + "word" * (i % 3)} for i in range(60)])
    textindex.TextIndex.write(docs, str(tmp_path / "i"))
    index = TextIndex.open(spark, str(tmp_path / "i"))
    files = index.stored.where("term = 'alpha'").select(F.input_file_name()).distinct().count()
    assert files > 1 and index.frequencies(["alpha"])["alpha", "body"] == 60
    assert sum(r["n"] for r in index.blocks(["alpha"]).collect()) == 60 == S.matches(index, "alpha beta").count()


def test_a_phrase_is_looked_for_once(spark, tmp_path):
    docs = corpus(spark, [{"body": "the old mill"}, {"body": "mill old the"}, {"title": "the old", "body": "x"}])
    TextIndex.write(docs, str(tmp_path / "i"))
    index = TextIndex.open(spark, str(tmp_path / "i"))
    want = {r["doc_id"] for r in S.matches(TextIndex.of(docs), '"the old"').collect()}
    found = S.search(index, '"the old"').keep()
    assert {r["doc_id"] for r in found.hits.collect()} == want == {0, 2} and found.totals()["total_captures"] == 2
    assert len(index.kept) == 1 and found.facets.where("field = 'collection'").first()["n"] == 2
    assert found.timeline.count() == 1 and found.document()["total_hits"] == 2
    found.release()
    for k in range(index.KEPT + 2):
        S.matches(index, f'"the w{k}"').count()
    assert len(index.kept) == index.KEPT


def test_views_of_results(spark):
    from webquarry.plans import views

    rows = [{"body": "alpha <b> beta", "title": "", "collection": "a b"}, {"body": "alpha", "title": "T & U", "timestamp": ""}]
    crawls = spark.createDataFrame([("c1", "Crawl", "https://x.org/a.wacz")], "id string, name string, source string")
    collections = spark.createDataFrame([("a b", "Name A", "d")], "id string, name string, description string")
    found = S.search(TextIndex.of(corpus(spark, rows)), "alpha")
    got = {r["doc_id"]: r for r in views.result_rows(found.hits, crawls, collections).collect()}
    assert got[0]["collection_name"] == "Name A" and got[1]["collection_name"] == "col" and got[0]["title"] == "http://example.com/0"
    assert got[0]["href"] == "/replay/viewer?source=https%3A%2F%2Fx.org%2Fa.wacz&url=http%3A%2F%2Fexample.com%2F0&ts=20210101000000&name=Crawl&collection=Name%20A&collection_id=a%20b&crawl=c1"
    assert got[0]["snippet_html"] == "<b>alpha</b> &lt;b&gt; beta" and (got[1]["time_text"], got[0]["time_text"]) == ("", "2021-01-01 00:00")
    items = {(r["field"], r["value"]): r for r in views.facet_items(found.facets, "alpha collection:col").collect()}
    assert items["collection", "col"]["active"] and items["collection", "col"]["href"] == "/search?q=alpha"
    assert not items["type", "html"]["active"] and items["type", "html"]["href"] == "/search?q=alpha%20collection%3Acol%20type%3Ahtml"
    assert [tuple(r) for r in views.set_filters("alpha crawl:c1 year:2021", crawls).orderBy("place").collect()] == [(0, "Crawl", "Crawl", "alpha year:2021"), (1, "Year", "2021", "alpha crawl:c1")]
    assert views.page_of("alpha", {"total_hits": 41, "capped": False}, offset=20) == {"page": 2, "total_pages": 3, "total_hits": 41, "capped": False, "query": "alpha"}
