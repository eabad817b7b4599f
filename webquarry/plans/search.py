"""Ranked search: BM25 per field, URL collapse inside a candidate window, facets, timeline, pages of hits.

A query reads its own terms' postings once. One aggregation by document gives every leaf's presence and
score; the query's tree becomes a boolean Column over presences and the document's own columns. Filters
that every match must meet go to the scan of the documents as bare predicates. Corpus statistics of the
leaves are at most leaves x fields numbers, read from the term table, and become literals of the plan.

The window of best matches of frequent words is found by bounds: the blocks of the greatest bounds give a
threshold, and of the rest only blocks whose bound reaches it are read, by pushed filters on document ids.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webquarry.functions import scalars as X
from webquarry.model import BOOSTS, POSITIONAL
from webquarry.plans.query import NUMERIC, Filter, Leaf, Node, leaves, parse
from webquarry.plans.textindex import TextIndex

K1, B = 1.2, 0.75
CANDIDATES, FACET_SIZE, TIMELINE_SIZE = 1000, 50, 120
#: Postings of a query's words from which bounds are asked, blocks that give the threshold, blocks that are looked at, ranges of one scan.
FREQUENT, OPENING, LISTED, RANGES = 200_000, 64, 8192, 256
FACETS = {"collection": "Collection", "year": "Year", "site": "Site", "type": "Type", "lang": "Language"}


def bm25(weight: Column, tf: Column, length: Column, average: Column) -> Column:
    """weight: boost times idf."""
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def _moved(k: int) -> Column:
    return F.transform("positions", lambda p: p - k)


def _fields(leaf: Leaf) -> list[str]:
    return [f for f in leaf.fields if f in POSITIONAL] if len(leaf.terms) > 1 else list(leaf.fields)


def _present(index: TextIndex, found: list[Leaf]) -> DataFrame:
    """doc_id, field, len and, for each leaf, tf0, tf1, ...: null where the leaf isn't. One scan of the terms' postings."""
    rows = index.postings([t for leaf in found for t in leaf.terms])
    inside = [F.col("field").isin(*_fields(leaf)) if _fields(leaf) else F.lit(False) for leaf in found]
    if all(len(leaf.terms) == 1 for leaf in found):
        return rows.select("doc_id", "field", "len", *[F.when((F.col("term") == leaf.terms[0]) & own, F.col("tf")).alias(f"tf{i}") for i, (leaf, own) in enumerate(zip(found, inside, strict=True))])
    # a phrase: starts at which each of its terms stands in its place
    spots, tfs = [], []
    for i, leaf in enumerate(found):
        if len(leaf.terms) == 1:
            spots.append(F.max(F.when(F.col("term") == leaf.terms[0], F.col("tf"))).alias(f"s{i}_0"))
            tfs.append(F.col(f"s{i}_0"))
        else:
            spots += [F.flatten(F.collect_list(F.when(F.col("term") == t, _moved(k)))).alias(f"s{i}_{k}") for k, t in enumerate(leaf.terms)]
            tfs.append(F.nullif(F.size(reduce(F.array_intersect, [F.col(f"s{i}_{k}") for k in range(len(leaf.terms))])), F.lit(0)))
    joined = rows.groupBy("doc_id", "field").agg(F.first("len").alias("len"), *spots)
    return joined.select("doc_id", "field", "len", *[F.when(own, tf).alias(f"tf{i}") for i, (own, tf) in enumerate(zip(inside, tfs, strict=True))])


def _frequencies(index: TextIndex, found: list[Leaf], rows: DataFrame) -> dict[tuple[int, str], int]:
    """(leaf, field) -> documents: words from the term table, phrases counted. At most leaves x fields numbers."""
    words = [leaf.terms[0] for leaf in found if len(leaf.terms) == 1]
    known = index.frequencies(words) if words else {}
    out = {(i, f): known.get((leaf.terms[0], f), 0) for i, leaf in enumerate(found) if len(leaf.terms) == 1 for f in leaf.fields}
    if phrases := [i for i, leaf in enumerate(found) if len(leaf.terms) > 1]:
        for r in rows.groupBy("field").agg(*[F.count(f"tf{i}").alias(f"n{i}") for i in phrases]).collect():
            out |= {(i, r["field"]): r[f"n{i}"] for i in phrases}
    return out


def _compare(node: Filter) -> Column:
    """A filter as a bare predicate, which reaches the scan; null where the column is."""
    col = F.col(node.field)
    value = (lambda v: F.lit(int(v))) if node.field in NUMERIC else F.lit
    if node.value is not None:
        return col == value(node.value)
    tests = [col.isNotNull()]
    if node.low is not None:
        tests.append(col >= value(node.low) if node.low_in else col > value(node.low))
    if node.high is not None:
        tests.append(col <= value(node.high) if node.high_in else col < value(node.high))
    return reduce(Column.__and__, tests)


def _condition(node, present: dict[Leaf, Column]) -> Column:
    if isinstance(node, Leaf):
        return present[node]
    if isinstance(node, Filter):
        return F.coalesce(_compare(node), F.lit(False))
    parts = [_condition(p, present) for p in node.parts]
    if node.op == "not":
        return ~parts[0]
    return reduce(Column.__and__ if node.op == "and" else Column.__or__, parts)


def _split(node) -> tuple[list[Filter], list]:
    """(filters that every match must meet, the other parts of the top-level conjunction)."""
    parts = [node]
    while any(isinstance(p, Node) and p.op == "and" for p in parts):
        parts = [x for p in parts for x in (p.parts if isinstance(p, Node) and p.op == "and" else [p])]
    return [p for p in parts if isinstance(p, Filter)], [p for p in parts if not isinstance(p, Filter)]


def _only_negative(node) -> bool:
    """Whether nothing but exclusions decides: such a query has no rows."""
    if isinstance(node, Node):
        return node.op == "not" or all(_only_negative(p) for p in node.parts)
    return False


def _needs_text(node) -> bool:
    """Whether a match implies that some leaf is present."""
    if isinstance(node, Leaf):
        return True
    if isinstance(node, Node) and node.op != "not":
        return (any if node.op == "and" else all)(map(_needs_text, node.parts))
    return False


def _has_filter(node) -> bool:
    return isinstance(node, Filter) or (isinstance(node, Node) and any(map(_has_filter, node.parts)))


def _scores(index: TextIndex, tree, boosts: dict[str, float]) -> tuple[DataFrame, dict[Leaf, Column]]:
    """doc_id, score and a flag for each leaf, of the documents that hold some leaf."""
    found = list(dict.fromkeys(leaf for leaf, _ in leaves(tree)))
    some_phrase = any(len(leaf.terms) > 1 for leaf in found)
    rows = index.keep(tuple(found), lambda: _present(index, found)) if some_phrase else _present(index, found)
    df, averages = _frequencies(index, found, rows), index.averages
    by_field = lambda values: X.either(*[(F.col("field") == f, F.lit(v)) for f, v in values.items()], otherwise=F.lit(0.0))
    average = by_field({f: max(a, 1e-9) for f, (_, a) in averages.items()})
    weights, parts = _weights(index, tree, boosts, df), []
    for i, leaf in enumerate(found):
        weight = by_field({f: weights[i, f] for f in _fields(leaf)})
        parts.append(F.coalesce(bm25(weight, F.col(f"tf{i}"), F.col("len"), average), F.lit(0.0)))
    per_doc = rows.groupBy("doc_id").agg(F.sum(reduce(Column.__add__, parts)).alias("score"), *[F.max(F.col(f"tf{i}").isNotNull()).alias(f"leaf{i}") for i in range(len(found))])
    return per_doc, {leaf: F.coalesce(F.col(f"leaf{i}"), F.lit(False)) for i, leaf in enumerate(found)}


def _weights(index: TextIndex, tree, boosts: dict[str, float], df: dict) -> dict[tuple[int, str], float]:
    """Boost times idf of each (leaf, field); 0 for leaves that only exclude."""
    counted = {leaf for leaf, positive in leaves(tree) if positive}
    found = list(dict.fromkeys(leaf for leaf, _ in leaves(tree)))
    return {(i, f): leaf.boost * boosts.get(f, 1.0) * (leaf in counted) * idf(index.averages.get(f, (0, 0.0))[0], df.get((i, f), 0)) for i, leaf in enumerate(found) for f in _fields(leaf)}


def _possible(node, present: dict[Leaf, Column]) -> Column:
    """Whether a block may hold a match: an exclusion rules out no block."""
    if isinstance(node, Leaf):
        return present[node]
    if node.op == "not":
        return F.lit(True)
    return reduce(Column.__and__ if node.op == "and" else Column.__or__, [_possible(p, present) for p in node.parts])


def _bounded(index: TextIndex, tree, boosts: dict[str, float]) -> DataFrame:
    """segment, low, high, bound: no document of the block scores more. Blocks that can't hold a match are left out."""
    found = list(dict.fromkeys(leaf for leaf, _ in leaves(tree)))
    df = index.frequencies([leaf.terms[0] for leaf in found])
    weights = _weights(index, tree, boosts, {(i, f): df.get((leaf.terms[0], f), 0) for i, leaf in enumerate(found) for f in leaf.fields})
    parts, present = [], {}
    for i, leaf in enumerate(found):
        own = (F.col("term") == leaf.terms[0]) & (F.col("field").isin(*_fields(leaf)) if _fields(leaf) else F.lit(False))
        score = X.either(*[((F.col("field") == f), bm25(F.lit(weights[i, f]), F.col("tf"), F.col("len"), F.lit(max(index.averages.get(f, (0, 0.0))[1], 1e-9)))) for f in _fields(leaf)], otherwise=F.lit(0.0))
        parts += [F.sum(F.when(own, score)).alias(f"bound{i}"), F.max(own).alias(f"leaf{i}")]
        present[leaf] = F.col(f"leaf{i}")
    blocks = index.blocks([t for leaf in found for t in leaf.terms]).groupBy("segment", "low", "high").agg(*parts)
    total = reduce(Column.__add__, [F.coalesce(f"bound{i}", F.lit(0.0)) for i in range(len(found))])
    return blocks.where(_possible(tree, present)).select("segment", "low", "high", total.alias("bound"))


def _joined(blocks: list) -> list[tuple[str, int, int]]:
    """Neighbouring blocks as ranges."""
    out: list[tuple[str, int, int]] = []
    for s, low, high in sorted((b["segment"], b["low"], b["high"]) for b in blocks):
        if out and out[-1][0] == s and out[-1][2] == low:
            out[-1] = (s, out[-1][1], high)
        else:
            out.append((s, low, high))
    return out


def best_ids(index: TextIndex, q: str, cap: int = CANDIDATES, boosts: dict[str, float] | None = None) -> DataFrame:
    """candidates(matched_ids()): the cap best matches, the same rows in the same order, from as few blocks as bounds allow.

    Bounds serve queries of words without filters; they are asked where the words have FREQUENT postings or more.
    Where they don't narrow the scan to RANGES ranges, all postings of the words are read.
    """
    tree, boosts = parse(q), BOOSTS if boosts is None else boosts
    plain = candidates(matched_ids(index, q, boosts), cap)
    if tree is None or index.bounds is None or _only_negative(tree) or _has_filter(tree) or not _needs_text(tree) or any(len(leaf.terms) > 1 for leaf, _ in leaves(tree)):
        return plain
    if sum(index.frequencies([leaf.terms[0] for leaf, _ in leaves(tree)]).values()) < FREQUENT:
        return plain
    blocks = _bounded(index, tree, boosts).orderBy(F.desc("bound"), "segment", "low").limit(LISTED).collect()
    opening = blocks[:OPENING]
    if len(blocks) > OPENING:
        first = candidates(matched_ids(index.within(_joined(opening)), q, boosts), cap).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        least = first["least"] if first["n"] == cap else float("-inf")
        blocks = [b for b in blocks if b["bound"] * (1 + 1e-9) >= least] if len(blocks) < LISTED or blocks[-1]["bound"] * (1 + 1e-9) < least else []
        if not blocks:
            return plain
        opening = blocks
    ranges = _joined(opening)
    return candidates(matched_ids(index.within(ranges), q, boosts), cap) if len(ranges) <= RANGES else plain


def matched_ids(index: TextIndex, q: str, boosts: dict[str, float] | None = None) -> DataFrame:
    """doc_id and score of all matches. A query of words alone is answered by the postings, without the documents."""
    tree = parse(q)
    if tree is None or _only_negative(tree) or _has_filter(tree) or not _needs_text(tree):
        return matches(index, q, boosts).select("doc_id", "score")
    per_doc, present = _scores(index, tree, BOOSTS if boosts is None else boosts)
    return per_doc.where(_condition(tree, present)).select("doc_id", "score")


def matches(index: TextIndex, q: str, boosts: dict[str, float] | None = None) -> DataFrame:
    """All documents that match, with their score (0 for filters alone)."""
    boosts, tree = BOOSTS if boosts is None else boosts, parse(q)
    if tree is None or _only_negative(tree):
        return index.docs.where("false").withColumn("score", F.lit(0.0))
    filters, rest = _split(tree)
    docs = reduce(DataFrame.where, map(_compare, filters), index.docs)
    if not any(True for _ in leaves(tree)):
        return reduce(DataFrame.where, [_condition(p, {}) for p in rest], docs).withColumn("score", F.lit(0.0))
    per_doc, present = _scores(index, tree, boosts)
    flags = [c for c in per_doc.columns if c not in ("doc_id", "score")]
    rest_met = reduce(Column.__and__, [_condition(p, present) for p in rest])
    if any(map(_needs_text, rest)):
        # what needs no document's column is decided before the join
        plain = [_condition(p, present) for p in rest if not _has_filter(p)]
        joined = docs.join(reduce(DataFrame.where, plain, per_doc), "doc_id")
    else:
        joined = docs.join(per_doc, "doc_id", "left")
    return joined.where(rest_met).withColumn("score", F.coalesce("score", F.lit(0.0))).drop(*flags)


def candidates(matched: DataFrame, cap: int = CANDIDATES) -> DataFrame:
    """The best-scored window: a top-k, not a sort of all matches."""
    return matched.orderBy(F.desc("score"), "doc_id").limit(cap)


def collapse(window: DataFrame) -> DataFrame:
    """One row for each page URL of the window, its best capture, with capture_count; other documents never merge."""
    key = F.when((F.col("doc_type") == "page") & (F.col("url") != ""), F.col("url")).otherwise(F.concat(F.lit("#"), F.col("doc_id").cast("string")))
    own = Window.partitionBy("_key")
    ranked = window.withColumn("_key", key).withColumn("_rank", F.row_number().over(own.orderBy(F.desc("score"), "doc_id"))).withColumn("capture_count", F.count("*").over(own))
    return ranked.where("_rank = 1").drop("_key", "_rank")


def facets(docs: DataFrame, size: int = FACET_SIZE) -> DataFrame:
    """field, value, n: the most frequent values of each facet, blanks left out after the cut. One pass, one shuffle."""
    dims = list(FACETS)
    sets = docs.select(*[F.col(d).cast("string").alias(d) for d in dims]).groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.grouping_id(*[F.col(d) for d in dims]).alias("g"), F.count("*").alias("n"))
    bit = {d: (2 ** len(dims) - 1) ^ (1 << (len(dims) - 1 - i)) for i, d in enumerate(dims)}
    named = sets.select(X.either(*[(F.col("g") == bit[d], F.lit(d)) for d in dims], otherwise="").alias("field"), X.either(*[(F.col("g") == bit[d], F.col(d)) for d in dims], otherwise="").alias("value"), "n").where("value is not null")
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return named.withColumn("_rank", rank).where((F.col("_rank") <= size) & (F.col("value") != "")).drop("_rank")


def facet_overview(docs: DataFrame, collection: str | None = None, crawl_id: str | None = None) -> DataFrame:
    """Facets over all documents, or those of a collection or crawl."""
    if collection is not None:
        docs = docs.where(F.col("collection") == collection)
    if crawl_id is not None:
        docs = docs.where(F.col("crawl_id") == crawl_id)
    return facets(docs)


def timeline(docs: DataFrame, size: int = TIMELINE_SIZE) -> DataFrame:
    """month, n: the months with most documents, in order of time."""
    months = docs.where("month is not null").groupBy("month").agg(F.count("*").alias("n"))
    return months.orderBy(F.desc("n"), "month").limit(size).orderBy("month")


def facet_display(found: DataFrame, field: str, size: int) -> DataFrame:
    """The buckets of one facet in display order: by count, years latest first."""
    order = [F.col("value").cast("int").desc()] if field == "year" else [F.desc("n"), F.asc("value")]
    return found.where(F.col("field") == field).orderBy(*order).limit(size)


def snippet_of(terms: set[str], most: int = 350):
    """A function from text to its densest window of at most `most` characters, terms in <b>, all else escaped."""
    pattern = re.compile(r"[^\W_]+", re.UNICODE)

    def run(text: str) -> str:
        hits = [(m.start(), m.end()) for m in pattern.finditer(text or "") if m.group().lower() in terms]
        if not hits:
            return ""
        best, first = (0, 0), 0
        for last in range(len(hits)):
            while hits[last][1] - hits[first][0] > most:
                first += 1
                if first > last:
                    break
            if first <= last and last - first + 1 > best[0]:
                best = (last - first + 1, first)
        start = hits[best[1]][0] if best[0] else hits[0][0]
        end = min(len(text), start + most)
        spare = max(0, most - (max((e for s, e in hits if s >= start and e <= end), default=end) - start)) // 2
        start = max(0, start - spare)
        end = min(len(text), start + most)
        out, at = [], start
        for s, e in hits:
            if s >= start and e <= end:
                out += [html_lib.escape(text[at:s]), "<b>", html_lib.escape(text[s:e]), "</b>"]
                at = e
        return "".join([*out, html_lib.escape(text[at:end])])

    return run


def with_snippets(page: DataFrame, q: str) -> DataFrame:
    """snippet and display columns, for the rows of one page only."""
    terms = {t for leaf, positive in leaves(parse(q)) if positive for t in leaf.terms}
    run = snippet_of(terms)

    @F.pandas_udf("string")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(run)

    snip = cut("body_snip")
    title = F.coalesce(X.clean("title"), F.when(F.col("doc_type") == "collection", F.col("crawl_name")).otherwise(F.col("url")))
    return page.withColumn("snippet", snip).withColumn("body_excerpt", X.excerpt("body_snip")).withColumn("display_title", title).withColumn("display_text", F.coalesce(F.nullif("snippet", F.lit("")), X.clean("description"), F.nullif("body_excerpt", F.lit(""))))


@dataclass
class Response:
    """What a search gives; all lazy. hits: one page, in order, with snippets."""

    hits: DataFrame
    groups: DataFrame
    matched: DataFrame
    facets: DataFrame
    timeline: DataFrame
    index: TextIndex | None = None

    def keep(self) -> Response:
        """The same answer, with what facets, timeline and totals need of all matches kept in one narrow table; release() lets it go."""
        narrow = self.matched.select("doc_id", "score", *FACETS, "month").persist()
        return replace(self, matched=narrow, facets=facets(narrow), timeline=timeline(narrow))

    def release(self) -> None:
        self.matched.unpersist()

    def totals(self) -> dict:
        """total_hits (collapsed, within the window), total_captures (all matches), capped."""
        captures = self.matched.count()
        return {"total_hits": self.groups.count(), "total_captures": captures, "capped": captures > CANDIDATES}

    def to_json(self) -> DataFrame:
        """One JSON text for each hit."""
        return self.hits.select(F.to_json(F.struct("doc_type", "crawl_id", "crawl_name", "collection", "url", "domain", "timestamp", "title", "description", "snippet", "body_excerpt", "capture_count", "status")).alias("hit"))

    def document(self) -> dict:
        """The whole answer for a caller outside Spark: totals, one page of hits, facets in display order; no timeline."""
        import json

        shown: dict[str, list] = {f: [] for f in FACETS}
        for r in self.facets.collect():
            shown[r["field"]].append((r["value"], r["n"]))
        order = {f: (lambda x: -int(x[0])) if f == "year" else (lambda x: (-x[1], x[0])) for f in FACETS}
        return self.totals() | {"num_docs": self.index.docs.count() if self.index else None, "hits": [json.loads(r["hit"]) for r in self.to_json().collect()], "facets": [{"field": f, "title": FACETS[f], "values": [{"value": v, "count": n} for v, n in sorted(found, key=order[f])]} for f, found in shown.items() if found]}


def search(index: TextIndex, q: str, offset: int = 0, limit: int = 20) -> Response:
    """The window of best matches is found first and joined with its documents; only facets and timeline join all."""
    matched = matches(index, q)
    best = best_ids(index, q)
    groups = collapse(index.docs.join(best, "doc_id"))
    page = groups.orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)
    return Response(with_snippets(page, q), groups, matched, facets(matched), timeline(matched), index)


def collection_pages(index: TextIndex, collection: str, url: str | None = None, q: str | None = None, offset: int = 0, limit: int = 25) -> DataFrame:
    """A collection's pages, best first, without boosts; inside the returned page good captures (2xx) come first."""
    own = (F.col("collection") == collection) & (F.col("doc_type") == "page")
    if url is not None:
        own &= F.col("url") == url
    q = (q or "").strip()
    pages = matches(replace(index, docs=index.docs.where(own)), q, boosts={}) if q else index.docs.where(own).withColumn("score", F.lit(0.0))
    limit = min(200, max(1, limit))
    page = pages.orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)
    good = F.when(F.col("status").between(200, 299), 0).otherwise(1)
    return page.orderBy(good, F.desc("score"), "doc_id").select("doc_id", "url", "timestamp", "title", "crawl_id", "status", "score")
