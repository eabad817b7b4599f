"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is `window` consecutive words of an item (a shorter item is one window). A document holds a window only if
it holds all of its shingles, so one shingle of each window is enough to find it, and the rarest one costs least:

1. items' shingles are counted over all documents, and each distinct window keeps its rarest shingle (its prefix:
   exact containment needs a prefix of one), with the shingle's place in the window;
2. documents' shingles meet these prefix tokens; the place bounds where the window would begin, and its length where
   it would end, inside the document;
3. what is left is verified word by word.

Both steps are one scan of the documents in which tokens, bounds and verification share a stage of generated code:
no text and no shingle moves, only counts, verified places and one row for each document. Tokens go to the tasks in
blocks of at most BLOCK_BYTES, whose size is measured; a benchmark beyond that is met in several scans. Windows of one set of items stand
for the set, so a document meets it once.

Shingles are told by 64 bits of hash to find candidates, and by their words to verify them.

Defined results: null texts have no words, in documents and items; an item of null id counts as the item of the empty
id; rows that repeat an item id are one item; rows that repeat a document's id and text count one by one; ids of
several texts are rows of their own, a null id too; a very long document is read whole, as one row; equally rare
shingles go by their hash; an empty table of documents gives an empty result, an empty benchmark leaves all documents
clean; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webquarry.llm.common import columns, cut, text_or_empty

WINDOW, SHINGLE = 10, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word before A-Z are lower-cased: the same runs as afterwards.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of tokens and windows that one scan of the documents takes along.
BLOCK_BYTES = 32 << 20


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def token(k: int, at) -> Column:
    """Hash of the k words at(0), at(1), ...; null if there are fewer. Lower-casing all letters, not A-Z alone, only adds candidates."""
    some = [F.lower(at(j)) for j in range(k)]
    return F.when(some[-1].isNotNull(), F.xxhash64(F.lit(k), *some))


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id (as a string), words and start of every window; its words joined by a space."""
    items = columns(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.translate(text_or_empty(), UPPER, LOWER)).alias("w")).where(F.size("w") > 0)
    starts = items.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("i"))
    return starts.select("item_id", F.slice("w", F.col("i"), window).alias("w")).withColumn("phrase", F.array_join("w", " "))


def shingles(distinct: DataFrame, shingle: int) -> DataFrame:
    """distinct's columns, and token and place (words before it) of every shingle of each window; short windows are one shingle."""
    k = F.least(F.size("w"), F.lit(shingle))
    each = distinct.withColumn("k", k).withColumn("place", F.explode(F.sequence(F.lit(0), F.size("w") - k)))
    at = lambda j: F.get("w", F.col("place") + j)
    chosen = F.lit(None).cast("bigint")
    for j in range(1, shingle + 1):
        chosen = F.when(F.col("k") == j, token(j, at)).otherwise(chosen)
    return each.withColumn("token", chosen)


def places(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """docs (key, doc_id, w) by place: pos from 0, and the token of the shingle there. Place 0 is the document itself and has no token; the words count from 1."""
    each = docs.select("*", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "word"))
    at = lambda j: F.get("w", F.col("pos") - 1 + j)
    tokens = [F.when(F.col("pos") > 0, token(k, at)) for k in sizes]
    if len(tokens) == 1:
        return each.withColumn("token", tokens[0])
    # the document itself stays one row
    return each.withColumn("token", F.explode(F.when(F.col("pos") > 0, F.array(*tokens)).otherwise(F.array(F.lit(None).cast("bigint")))))


def in_blocks(tokens: DataFrame, weight: Column) -> list[DataFrame]:
    """tokens (token, ...) in parts of about BLOCK_BYTES at most, by the token's hash: one part at least."""
    total = tokens.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    many = -(-int(total) // BLOCK_BYTES) or 1
    return [tokens.where(F.pmod(F.xxhash64("token", F.lit("block")), F.lit(many)) == b) for b in range(many)]


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(found, sets), tables of their own.

    found: key, doc_id, n_words, copies for each document (start is null), and key, start, stop, set_id for each place
    where a window occurs, in words from 0. sets: set_id, item_id.
    """
    each = windows(benchmark, window)
    owners = each.groupBy("phrase").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.first("w").alias("w"))
    distinct = cut(owners.withColumn("set_id", F.md5(F.concat_ws(",", F.transform("items", lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x))).cast("binary"))), "windows")
    sets = distinct.select("set_id", "items").dropDuplicates(["set_id"]).select("set_id", F.explode("items").alias("item_id"))
    grams = shingles(distinct, shingle)
    sizes = [r[0] for r in grams.select("k").distinct().orderBy("k").collect()] or [shingle]  # `shingle` numbers at most

    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), text_or_empty())
    docs = columns(documents, "doc_id", "text").select(F.md5(own.cast("binary")).alias("key"), "doc_id", words(text_or_empty()).alias("w"))

    # 1. rarity of items' shingles over all documents
    known = in_blocks(grams.select("token").distinct(), F.lit(16))
    counts = None
    for block in known:  # in_blocks() bounds what is broadcast
        met = places(docs, sizes).where("token is not null").select("token").join(F.broadcast(block), "token").groupBy("token").agg(F.count("*").alias("many"))
        counts = met if counts is None else counts.union(met)
    rank = F.row_number().over(Window.partitionBy("phrase").orderBy(F.coalesce("many", F.lit(0)), "token"))
    prefix = grams.join(cut(counts, "rarity"), "token", "left").withColumn("rank", rank).where("rank = 1")
    prefix = cut(prefix.select("token", "place", "phrase", "set_id", F.size("w").alias("size")), "prefixes")

    # 2. and 3. places of prefix tokens, bounds, words
    found = None
    for number, block in enumerate(in_blocks(prefix, F.length("phrase") * 2 + 96)):  # in_blocks() bounds what is broadcast
        met = places(docs, sizes).join(F.broadcast(block), "token", "left")
        start = F.col("pos") - 1 - F.col("place")
        inside = (start >= 0) & (start + F.col("size") <= F.size("w"))
        same = F.translate(F.array_join(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("size")), " "), UPPER, LOWER) == F.col("phrase")
        itself = F.col("pos") == 0
        met = met.where((itself if number == 0 else F.lit(False)) | (inside & same))
        only = lambda x: F.when(itself, x)  # noqa: E731, B023
        met = met.select("key", only(F.col("doc_id")).alias("doc_id"), only(F.size("w")).alias("n_words"), F.when(~itself, start).alias("start"), F.when(~itself, start + F.col("size")).alias("stop"), F.when(~itself, F.col("set_id")).alias("set_id"))
        found = met if found is None else found.union(met)
    merged = found.groupBy("key", "doc_id", "start", "stop", "set_id").agg(F.max("n_words").alias("n_words"), F.count("*").alias("copies"))
    return cut(merged, "hits"), sets


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), spans (maximal hit runs, in words from 0) of every document."""
    found, sets = hits(documents, benchmark, window, shingle)
    by_doc = Window.partitionBy("key").orderBy("start", "stop")
    before = F.max("stop").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.where("start is not null").withColumn("before", before).withColumn("opens", F.when(F.col("before") >= F.col("start"), 0).otherwise(1))
    runs = apart.withColumn("run", F.sum("opens").over(by_doc.rowsBetween(Window.unboundedPreceding, 0))).groupBy("key", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = runs.groupBy("key").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    owners = found.where("start is not null").select("key", "set_id").distinct().join(sets, "set_id").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    docs = found.where("start is null").select("key", "doc_id", "n_words", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    nothing = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return docs.join(spans, "key", "left").join(owners, "key", "left").select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.coalesce(F.col("n_hit").cast("bigint"), F.lit(0).cast("bigint")).alias("n_hit"), nothing("items", "array<string>"), nothing("spans", "array<struct<start:int,stop:int>>"))


def verdicts(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """decontaminated() with digests: n_items, items_sha256, contaminated."""
    d = decontaminated(documents, benchmark, window)
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
