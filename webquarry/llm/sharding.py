"""Sharding by longest-processing-time scheduling; equal texts stay together.

Groups (equal texts) are dealt to a bounded number of tasks by digest. Each task walks its groups by
descending size and gives each to the least-loaded of its bins through a heap, holding nothing but the
heap. The bins of all tasks, bounded in number whatever the input, are then scheduled onto the shards in
the same way on the driver: largest first, to the least-loaded shard. A group never leaves its bin, and
a bin never leaves its shard. A group too large for a bin simply is a large bin, placed first.

Slots are gapless in each shard: documents are counted by (shard, part of the id's hash), counts become
offsets, and ranks are taken inside the small parts.

Defined results: a null text has size 1 and groups with empty texts; an empty table gives an empty
result; repeated rows share a group and get slots of their own; a very long text counts with all its bytes; a null
id is an id like any other; groups of one size go by their digest, bins and shards of one load by their number;
further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webquarry.llm.common import columns, cut, partitions, text_or_empty

#: Tasks of the first level at most, and bins of each for every shard: their product times the shards bounds what the driver schedules.
TASKS, BINS = 512, 8


def lpt(sizes: Iterable[tuple[int, object]], bins: int) -> dict[object, int]:
    """Bin of each key; sizes must come in descending order."""
    heap = [(0, b) for b in range(bins)]
    out = {}
    for size, key in sizes:
        load, b = heap[0]
        heapq.heapreplace(heap, (load + size, b))
        out[key] = b
    return out


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    tasks, bins = min(TASKS, partitions(spark)), BINS * shards
    text = text_or_empty()
    slim = cut(columns(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "shard-keys")

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = [(0, b) for b in range(bins)]
        for b in batches:
            out = []
            for size in b["total"].to_pylist():
                load, k = heap[0]
                heapq.heapreplace(heap, (load + size, k))
                out.append(k)
            yield pa.RecordBatch.from_arrays([b["digest"], b["total"], b["task"], pa.array(out, pa.int32())], names=["digest", "total", "task", "bin"])

    by_text = slim.groupBy("digest").agg(F.sum("size").alias("total"))
    # by the digest itself: a hash of a few numbers would leave some tasks with two shares and some with none
    placed = by_text.repartition(tasks, "digest").withColumn("task", F.spark_partition_id()).sortWithinPartitions(F.desc("total"), "digest").mapInArrow(walk, "digest binary, total bigint, task int, bin int")
    placed = cut(placed, "shard-bins")
    loads = placed.groupBy("task", "bin").agg(F.sum("total").alias("load")).collect()
    order = sorted(loads, key=lambda r: (-r["load"], r["task"], r["bin"]))
    where = lpt(((r["load"], (r["task"], r["bin"])) for r in order), shards)
    plan = spark.createDataFrame([(t, b, s) for (t, b), s in where.items()], "task int, bin int, shard int")
    groups = placed.join(F.broadcast(plan), ["task", "bin"]).select("digest", "shard")

    parts = 4 * partitions(spark)
    dealt = slim.join(groups, "digest").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")))
    out = ranked.join(offsets, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
