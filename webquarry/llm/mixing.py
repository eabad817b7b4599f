"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time: a base weight (5, 2, 1 in turn, sources in code
point order, null last) times a piecewise-linear shape. Targets follow the base weights and a cap of
`most` times the source's size; what a capped source can't take is reshared among the others by weight.
The integral of a source's schedule, scaled to its target, is its cumulative demand of words. A
document's first and last words sit at some cumulative counts of its source's words; inverting the demand
at these counts gives the stretch of training, in 0..1, over which the document is due; what the demand
grows by on that stretch is what the mix takes of it. Documents are range-sorted by the position of their
first word. A source whose target exceeds its size is walked a second time, each copy at the place where
the curve has the counts of that walk. The document that meets the end of training is taken up to that word.

The walk's order is by MD5 of the id, so reruns agree. Cumulative counts are taken in two levels, over
4096 parts of the hash for each source and then inside the parts: no task holds a source.

Defined results: null and empty texts have size 0 and take 0; a null source is a source of its own, in
last place; a very long text is one document like any other; an empty table gives an empty result;
repeated rows count one by one in `mixed`; in `curriculum` rows of one id share the place of the one of
most words; a null id is an id like any other; ties of position go by id; further columns are ignored by
`mixed` and kept by `curriculum`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webquarry.llm.common import WORD, columns, cut, fresh, partitions, text_or_empty

WEIGHTS = (5, 2, 1)
#: Shape of each weight's schedule as (relative rate at the start, at the end); its mean is 1.
SHAPES = {5: (1.5, 0.5), 2: (1.0, 1.0), 1: (0.5, 1.5)}


def targets(sizes: list[tuple[str | None, int]], share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> dict[str | None, tuple[int, float]]:
    """(weight, target) of each source; a target stops at most * size and the excess is reshared by weight."""
    order = sorted((s for s, _ in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [s for s, _ in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    size, open_, out = dict(sizes), list(order), {}
    left = share * sum(size.values())
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if rate * weight[s] > most * size[s]]
        if not full:
            out |= {s: rate * weight[s] for s in open_}
            break
        out |= {s: most * size[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return {s: (weight[s], float(out[s])) for s in order}


def due(at: Column, target: Column, start: Column, end: Column) -> Column:
    """Training position in 0..1 at which a cumulative demand of target * (start t + (end - start) t^2 / 2) reaches `at`."""
    x = at / target
    bend = end - start
    return F.when(F.abs(bend) < 1e-12, x / start).otherwise((F.sqrt(F.greatest(F.lit(0.0), start * start + 2 * bend * x)) - start) / bend)


def demand(t: Column, target: Column, start: Column, end: Column) -> Column:
    """Words that a source has given by the training position t, whole."""
    return F.round(target * (start * t + (end - start) * t * t / 2)).cast("bigint")


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document, sorted by position: doc_id, size, source_size, target, taken, position, source, copies.

    position is where the first copy begins, null for a document that isn't taken; copies holds the position
    and the words of each copy that the mix takes.
    """
    first = F.col("position").asc_nulls_last()
    return _walked(docs, share, most).repartitionByRange(partitions(docs.sparkSession), first, "doc_id").sortWithinPartitions(first, "doc_id")


def _walked(docs: DataFrame, share: float, most: float) -> DataFrame:
    spark = docs.sparkSession
    slim = columns(docs, "doc_id", "source", "text").select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("rank"))
    slim = cut(slim.withColumn("part", F.substring("rank", 1, 3)), "mix-sizes")
    parts = slim.groupBy("source", "part").agg(F.sum("size").alias("words"))
    sizes = [(r["source"], int(r["words"])) for r in parts.groupBy("source").agg(F.sum("words").alias("words")).collect()]
    plan = targets(sizes, share, most)
    rows = [(s, size, plan[s][1], int(plan[s][1] + 0.5), *SHAPES.get(plan[s][0], (1.0, 1.0))) for s, size in sizes]
    per_source = spark.createDataFrame(rows, "plan_source string, source_size bigint, target double, quota bigint, start double, end double")
    before = parts.select(F.col("source").alias("part_source"), F.col("part").alias("part_key"), (F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words")).alias("part_before"))
    inside = Window.partitionBy("source", "part").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    walk = slim.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    walk = walk.join(before, F.col("source").eqNullSafe(F.col("part_source")) & (F.col("part") == F.col("part_key"))).withColumn("before", F.col("part_before") + F.col("inside"))
    walk = walk.join(per_source, F.col("source").eqNullSafe(F.col("plan_source")))
    curve = ("quota", "start", "end")

    def copy(epoch: int) -> Column:
        first = F.col("before") + epoch * F.col("source_size")
        begins, ends = (due(c, *map(F.col, curve)) for c in (first, F.least(first + F.col("size"), F.col("quota"))))
        words = demand(ends, *map(F.col, curve)) - demand(begins, *map(F.col, curve))
        return F.when((F.col("size") > 0) & (first < F.col("quota")), F.struct(begins.alias("position"), words.alias("words")))

    # the share never needs more walks than the cap allows
    walk = walk.withColumn("copies", F.array_compact(F.array(*[copy(e) for e in range(-(-int(most * 1000) // 1000))])))
    walk = walk.withColumn("taken", F.aggregate("copies", F.lit(0).cast("bigint"), lambda n, c: n + c["words"])).withColumn("position", F.get("copies", F.lit(0))["position"])
    return walk.select("doc_id", "size", "source_size", "target", "taken", "position", "source", "copies")


def curriculum(docs: DataFrame, share: float = 1.5, most: float = 2.0, position: str | None = None) -> DataFrame:
    """The mix itself, sorted by training position over all partitions: a row for each copy, with the columns of docs.

    The one unfinished copy of each source holds the words up to the end of training. A name given as `position`
    adds a column of that name.
    """
    key, copy, facts = (fresh(docs, n) for n in ("key", "copy", "plan"))
    at = position or fresh(docs, "position")
    # rows that repeat an id are one document here
    per_id = _walked(docs, share, most).where("taken > 0").groupBy(F.col("doc_id").alias(key)).agg(F.max(F.struct("taken", "size", "copies")).alias(facts))
    out = docs.join(per_id, F.col("doc_id").eqNullSafe(F.col(key))).withColumn(copy, F.explode(F.col(f"{facts}.copies")))
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1))
    text = F.when(F.col(f"{copy}.words") < F.col(f"{facts}.size"), F.array_join(F.slice(words, 1, F.col(f"{copy}.words").cast("int")), " ")).otherwise(F.col("text"))
    out = out.withColumn("text", text).withColumn(at, F.col(f"{copy}.position"))
    out = out.repartitionByRange(partitions(docs.sparkSession), at, key).sortWithinPartitions(at, key)
    return out.select([F.col(f"`{c}`") for c in (*docs.columns, *([position] if position else []))])
