"""Exact top-k by inner product over norm-sorted vectors with rotated partial sums.

Vectors are quantised to integers and range-partitioned by descending length into slices of bounded size.
A rotation from the SVD of a bounded sample gathers most of a vector's length in its first components.
All queries meet the slice of the longest vectors first, which gives each a floor, the k-th score so far.
A query goes on only to those further slices whose greatest length times its own reaches its floor; as
slices are ordered by length, these are the first few. Queries of like reach form groups, and a slice is
dealt only to groups that reach it: whole slices are skipped, for most queries most of them. Inside a
slice a task passes a group's queries by, STEP at a time, and walks by descending length in growing blocks: a query whose length times the block's
greatest length is below its floor is done; for the others the partial product over the first components
plus the product of the residual lengths (Cauchy-Schwarz) bounds each score from above, and only
candidates whose bound reaches the floor get their exact integer product. The k best of all slices are
merged for each query.

The rotation only decides how much is pruned; bounds carry a margin for rounding, so results are exact.

Defined results: vectors that are null or hold null or non-finite components take no part, neither as
queries nor as candidates; shorter vectors count as padded with zeros; ties go to the smaller id; rows
that repeat a query's id are the query itself, and of its vectors the greatest by components asks; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webquarry.llm.common import columns, cut

SCALE, K = 256, 5
#: Bytes of a slice's components, queries of a group (in the opening slice, and beyond), queries of one pass over a slice, vectors that the rotation is fitted on, components of a partial sum.
SLICE_BYTES, OPENING, GROUP, STEP, SAMPLE, PARTIAL = 4 << 20, 256, 32_768, 2048, 4096, 16


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (integers), of the vectors that take part."""
    whole = columns(vectors, "vec_id", "embedding").where("embedding is not null and vec_id is not null")
    real = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return whole.where(real).select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint")).alias("v"))


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if len(col) == 0:
        return np.zeros((0, width), np.int64)
    size = col.value_lengths().to_numpy()
    out = np.zeros((len(col), width), np.int64)
    out[np.arange(width) < size[:, None]] = col.flatten().to_numpy()
    return out


def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, rotation: np.ndarray, k: int, partial: int = PARTIAL, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score) of each query's k best of x; below its floor a query may get fewer."""
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1]) < 2**53
    norm = np.sqrt((x.astype(float) ** 2).sum(1))
    order = np.lexsort((ids, -norm))
    x, ids, norm = x[order], ids[order], norm[order]
    xr, qr = x @ rotation, q @ rotation
    q_norm = np.sqrt((q.astype(float) ** 2).sum(1))
    rest = lambda full, part: np.sqrt(np.maximum(0.0, full**2 - (part**2).sum(1)))
    x_rest, q_rest = rest(norm, xr[:, :partial]), rest(q_norm, qr[:, :partial])
    xf, qf = x.astype(float), q.astype(float)
    kept = [np.zeros(0, np.int64), np.zeros(0, ids.dtype), np.zeros(0, np.int64)]
    floor = np.full(len(q), -np.inf) if floor is None else floor.copy()  # k-th score so far
    live, at, size = np.arange(len(q)), 0, 64
    while at < len(x) and len(live):
        b = slice(at, at + size)
        margin = 1e-6 * (1 + q_norm * norm[at])
        live = live[(q_norm * norm[at] + margin)[live] >= floor[live]]
        bound = qr[live, :partial] @ xr[b, :partial].T + np.outer(q_rest[live], x_rest[b]) + margin[live, None]
        i, j = np.nonzero(bound >= floor[live, None])
        own = q_ids[live[i]] != ids[at + j]
        i, j = live[i[own]], at + j[own]
        if len(i) > len(live) * size // 4:  # dense: all products of the block at once
            score = (qf[live] @ xf[b].T if exact else q[live] @ x[b].T)[np.searchsorted(live, i), j - at].astype(np.int64)
        else:
            score = np.concatenate([np.einsum("ij,ij->i", q[i[s : s + 50_000]], x[j[s : s + 50_000]]) for s in range(0, len(i), 50_000)] or [np.zeros(0, np.int64)])
        row, name, score = np.concatenate([kept[0], i]), np.concatenate([kept[1], ids[j]]), np.concatenate([kept[2], score])
        top = np.lexsort((name, -score, row))
        row, name, score = row[top], name[top], score[top]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        ok = rank < k
        full = rank == k - 1
        floor[row[full]] = np.maximum(floor[row[full]], score[full])
        kept = [row[ok], name[ok], score[ok]]
        at, size = at + size, min(2 * size, 1024)
    return kept[0], kept[1], kept[2]


def reaches(norm: np.ndarray, floor: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """How many slices each query must see: tops are the slices' greatest lengths, descending."""
    margin = 1e-6 * (1 + norm * (tops[0] if len(tops) else 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(norm > 0, (floor - margin) / norm, np.where(floor <= margin, -np.inf, np.inf))
    return np.searchsorted(-tops, -least, side="right")


def exact_topk(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all other vectors."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)["vec_id"]
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    whole = cut(quantised(vectors, scale).withColumn("is_query", F.coalesce(is_query, F.lit(False))).withColumn("norm", norm), "vectors")
    many, asked, width = whole.agg(F.count("*"), F.count_if("is_query"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)
    sample = whole.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 20)) < F.lit(min(1.0, SAMPLE / max(1, many)) * (1 << 20))).select("v").toArrow()
    m = _matrix(sample["v"], width).astype(float)
    rotation = np.linalg.svd(m.T @ m)[0]
    slices, groups = max(1, -(-many * width * 8 // SLICE_BYTES)), max(1, -(-asked // GROUP))
    longest_first = (F.desc("norm"), "vec_id")
    ranged = cut(whole.select("vec_id", "v", "norm").repartitionByRange(slices, *longest_first).withColumn("slice", F.spark_partition_id()), "slices")
    # one number for each slice of SLICE_BYTES
    bounds = ranged.groupBy("slice").agg(F.max("norm").alias("top")).orderBy("slice").toPandas()
    numbers, tops = bounds["slice"].to_numpy(), bounds["top"].to_numpy()
    # of several vectors of one id the greatest asks
    queries = whole.where("is_query").groupBy("vec_id").agg(F.max(F.struct("v", "norm")).alias("most")).select("vec_id", "most.v", "most.norm")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, ids = right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
        x, q, floor = _matrix(left["v"], width), _matrix(right["v"], width), right["floor"].to_numpy()
        found = [best(x, ids, q[at : at + STEP], q_ids[at : at + STEP], rotation, k, floor=floor[at : at + STEP]) for at in range(0, max(1, len(q)), STEP)]
        row = np.concatenate([f[0] + at for f, at in zip(found, range(0, max(1, len(q)), STEP), strict=True)])
        name, score = (np.concatenate([f[i] for f in found]) for i in (1, 2))
        return pa.table({"query_id": pa.array(q_ids[row], right.schema.field("vec_id").type), "vec_id": pa.array(name, left.schema.field("vec_id").type), "score": pa.array(score, pa.int64())})

    def meet(candidates: DataFrame, asking: DataFrame) -> DataFrame:
        return candidates.groupBy("slice", "group").cogroup(asking.groupBy("slice", "group")).applyInArrow(search, f"query_id {kind}, vec_id {kind}, score bigint")

    first = int(numbers[0]) if len(numbers) else 0
    openings = max(1, -(-asked // OPENING))
    every = F.explode(F.sequence(F.lit(0), F.lit(openings - 1))).alias("group")
    opening = queries.select("vec_id", "v", F.lit(float("-inf")).alias("floor"), F.pmod(F.xxhash64("vec_id"), F.lit(openings)).cast("int").alias("group"), F.lit(first).alias("slice"))
    found = cut(meet(ranged.where(F.col("slice") == first).select("vec_id", "v", "slice", every), opening), "first-slice")
    if len(numbers) > 1:
        floors = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("floor"))
        known = queries.join(floors, queries["vec_id"] == floors["query_id"], "left").select("vec_id", "v", "norm", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))

        def reach(batches):
            for b in batches:
                yield b.append_column("reach", pa.array(reaches(b["norm"].to_numpy(), b["floor"].to_numpy(), tops), pa.int32()))

        going = known.mapInArrow(reach, f"vec_id {kind}, v array<bigint>, norm double, floor double, reach int").where("reach > 1")
        going = cut(going.repartitionByRange(groups, "reach", "vec_id").withColumn("group", F.spark_partition_id()), "reaches")
        number = F.element_at(F.lit(numbers.tolist()).cast("array<int>"), F.col("at"))
        dealt = lambda df: df.withColumn("at", F.explode(F.sequence(F.lit(2), F.col("reach")))).withColumn("slice", number)
        pairs = dealt(going.groupBy(F.col("group").alias("dealt_to")).agg(F.max("reach").alias("reach"))).select("slice", (F.col("dealt_to") + 0).alias("group"))
        rest = meet(ranged.select("vec_id", "v", "slice").join(pairs, "slice"), dealt(going).select("vec_id", "v", "floor", "group", "slice"))
        found = found.union(rest)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
