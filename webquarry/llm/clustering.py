"""Centroid clustering: Lloyd's rounds over two trees.

Vectors are dealt into blocks of bounded size. Each block becomes a cover tree, once: a node of level i covers its
vectors within 2^i of its centre, and its children's centres are at least 2^(i-1) apart. Every round builds a tree
over the centroids (halved along the widest component) and walks pairs of nodes, level by level:

- the distance of two nodes' centres, less both radii, bounds the distance of any vector and centroid below from
  below, and with both radii added from above;
- a pair whose lower bound exceeds the least upper bound of the vectors' node is pruned;
- a node left with one centroid is settled as a whole, with sums of its vectors from running totals;
- leaf pairs that remain are compared exactly, on integers, ties to the smaller number.

Only the sums of a round (one row for each block and centroid) are shuffled, and only centroids, of which there are
as many as asked for, reach the driver. Bounds carry a margin for rounding, so a tie is never pruned.

Defined results: vectors that are null, of another width, or hold null or non-finite components take no part; with
fewer vectors than centroids asked for there are as many centroids as vectors; the start of a null id comes last,
rows of one id start in the order of their components; repeated rows count one by one; an empty table gives an
empty result; further columns are ignored. Components beyond 2^27 after scaling raise an error, as squared
distances would exceed a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import batch, columns, cut

SCALE, WIDTH, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, 3
#: Vectors of a block, and of a leaf of its tree; leaves that are compared exactly, and pairs whose distances are taken, at once.
BLOCK, LEAF, CUT, AT_ONCE = 2048, 24, 256, 1 << 16
LIMIT = 1 << 27


def quantised(vectors: DataFrame, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """vec_id, v (integers), of the vectors that take part."""
    whole = columns(vectors, "vec_id", "embedding").where(F.size("embedding") == width)
    real = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return whole.where(real).select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint")).alias("v"))


# ---------------------------------------------------------------- trees


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Order of x in which each node is a run, and the nodes: centre (row of x), radius, low, high, child (first one's number), children (0: a leaf)."""
    nodes: list[list] = []
    wide = x.astype(float)
    away = lambda rows, c: np.sqrt(squared(wide[rows], wide[c]))
    nodes.append([0, 0.0, 0, len(x), 0, 0])
    dist = away(np.arange(len(x)), 0)
    nodes[0][1] = float(dist.max(initial=0.0))
    open_ = [(0, np.arange(len(x)), dist)]  # nodes to split: number, vectors and their distances from the centre
    placed = np.arange(len(x))
    while open_:
        n, rows, dist = open_.pop()
        if len(rows) <= leaf or nodes[n][1] <= 0:
            placed[nodes[n][2] : nodes[n][3]] = rows
            continue
        reach = 2.0 ** (np.ceil(np.log2(nodes[n][1])) - 1)
        parts, centre, left = [], nodes[n][0], rows
        while len(left):  # the node's own centre first, then any vector that none covers
            near = dist <= reach
            parts.append((centre, left[near], dist[near]))
            left = left[~near]
            if len(left):
                centre = left[0]
                dist = away(left, centre)
                dist[0] = 0.0
        low = nodes[n][2]
        nodes[n][4:] = len(nodes), len(parts)
        for centre, mine, own in parts:
            open_.append((len(nodes), mine, own))
            nodes.append([centre, float(own.max(initial=0.0)), low, low + len(mine), 0, 0])
            low += len(mine)
    back = np.empty(len(x), np.int64)
    back[placed] = np.arange(len(x))
    kinds = (np.int64, float, *[np.int64] * 4)
    tree = {k: np.array([node[i] for node in nodes], kind) for i, (k, kind) in enumerate(zip(("centre", "radius", "low", "high", "child", "children"), kinds, strict=True))}
    tree["centre"] = back[tree["centre"]]
    return placed, tree


def centroid_tree(c: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes over centroids, halved along the widest component: centre, radius, child (of two neighbours; 0: a leaf), number (of a leaf's centroid)."""
    wide = c.astype(float)
    nodes: list[list] = [[np.arange(len(c)), 0, -1]]
    at = 0
    while at < len(nodes):
        rows = nodes[at][0]
        if len(rows) == 1:
            nodes[at][2] = int(rows[0])
        else:
            spread = np.ptp(wide[rows], 0)
            rows = rows[np.argsort(wide[rows, int(spread.argmax())], kind="stable")]
            nodes[at][1] = len(nodes)
            nodes += [[rows[: len(rows) // 2], 0, -1], [rows[len(rows) // 2 :], 0, -1]]
        at += 1
    centre = np.array([wide[n[0]].mean(0) for n in nodes])
    radius = np.array([float(np.sqrt(((wide[n[0]] - m) ** 2).sum(1)).max()) for n, m in zip(nodes, centre, strict=True)])
    return {"centre": centre, "radius": radius, "child": np.array([n[1] for n in nodes]), "number": np.array([n[2] for n in nodes])}


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of x from c."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def walk(x: np.ndarray, tree: dict[str, np.ndarray], c: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[np.ndarray, np.ndarray]], int]:
    """Pairs of nodes, level by level.

    Returns runs (low, high, centroid) that are settled as a whole, (rows, centroids) of leaves compared exactly, and
    how many exact distances that took. x is in the tree's order.
    """
    ct = centroid_tree(c)
    wide = x.astype(float)
    runs, exact, spent = [], [], 0
    n, m = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(n):
        # bounds of each pair
        d = np.sqrt(np.concatenate([squared(wide[tree["centre"][n[i : i + AT_ONCE]]], ct["centre"][m[i : i + AT_ONCE]]) for i in range(0, len(n), AT_ONCE)]))
        spread = tree["radius"][n] + ct["radius"][m]
        best = np.full(len(tree["centre"]), np.inf)
        np.minimum.at(best, n, d + spread)
        keep = d - spread <= best[n] * (1 + 1e-9) + 1e-6
        n, m = n[keep], m[keep]
        pairs = np.bincount(n, minlength=len(best))
        leaf = ct["child"][m] == 0
        alone = leaf & (pairs[n] == 1)
        runs += zip(tree["low"][n[alone]].tolist(), tree["high"][n[alone]].tolist(), ct["number"][m[alone]].tolist(), strict=True)
        n, m, leaf = n[~alone], m[~alone], leaf[~alone]
        # leaves of the vectors' tree whose centroids are all single
        inner = np.bincount(n, weights=~leaf, minlength=len(best)) > 0
        ready = (tree["children"][n] == 0) & ~inner[n]
        for part in np.array_split(np.flatnonzero(ready)[np.argsort(n[ready], kind="stable")], np.flatnonzero(np.diff(np.sort(n[ready])))[CUT - 1 :: CUT] + 1):
            if not len(part):
                continue
            low, size = tree["low"][n[part]], (tree["high"] - tree["low"])[n[part]]
            at = np.repeat(np.arange(len(part)), size)
            rows, own = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size), ct["number"][m[part]][at]
            dist = squared(x[rows], c[own])
            first = np.lexsort((own, dist, rows))  # of ties the smaller number comes first
            rows, own = rows[first], own[first]
            opens = np.concatenate([[True], rows[1:] != rows[:-1]])
            spent += len(dist)
            exact.append((rows[opens], own[opens]))
        n, m = n[~ready], m[~ready]
        # one step down: the vectors' side where it has children, the centroids' side where it does
        down = np.maximum(tree["children"][n], 1)
        at = np.repeat(np.arange(len(n)), down)
        step = np.arange(len(at)) - np.repeat(np.cumsum(down) - down, down)
        n, m = np.where(tree["children"][n[at]] > 0, tree["child"][n[at]] + step, n[at]), m[at]
        fork = np.where(ct["child"][m] > 0, 2, 1)
        at = np.repeat(np.arange(len(n)), fork)
        step = np.arange(len(at)) - np.repeat(np.cumsum(fork) - fork, fork)
        n, m = n[at], np.where(ct["child"][m[at]] > 0, ct["child"][m[at]] + step, m[at])
    return runs, exact, spent


def assigned(x: np.ndarray, tree: dict[str, np.ndarray], c: np.ndarray) -> np.ndarray:
    """Each vector's centroid."""
    out = np.zeros(len(x), np.int64)
    runs, exact, _ = walk(x, tree, c)
    for low, high, j in runs:
        out[low:high] = j
    for rows, own in exact:
        out[rows] = own
    return out


def sums(x: np.ndarray, tree: dict[str, np.ndarray], c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of each centroid, and their sums; settled runs come from running totals."""
    runs, exact, _ = walk(x, tree, c)
    total = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, 0)])
    count, add = np.zeros(len(c), np.int64), np.zeros((len(c), x.shape[1]), np.int64)
    for low, high, j in runs:
        count[j] += high - low
        add[j] += total[high] - total[low]
    for rows, own in exact:
        count += np.bincount(own, minlength=len(c))
        np.add.at(add, own, x[rows])
    return count, add


# ---------------------------------------------------------------- rounds

PARTS = ("centre", "radius", "low", "high", "child", "children")


def _planted(kind: pa.DataType, width: int):
    """Vectors to blocks: ids, the vectors in the tree's order, and the tree's arrays."""
    schema = pa.schema([("ids", pa.list_(kind)), ("v", pa.binary()), *[(p, pa.binary()) for p in PARTS]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(table: pa.Table) -> pa.RecordBatch:
            x = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, width)
            if len(x) and int(np.abs(x).max()) >= LIMIT:
                raise ValueError("a component is too large: squared distances must fit a long")
            order, tree = cover_tree(x)
            ids = table["vec_id"].combine_chunks().take(pa.array(order)).to_pylist()
            return batch(schema, [[ids], [x[order].tobytes()], *[[tree[p].tobytes()] for p in PARTS]])

        held, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                held.append(b.slice(at, BLOCK))
                size += held[-1].num_rows
                if size >= BLOCK:
                    yield block(pa.Table.from_batches(held))
                    held, size = [], 0
        if size:
            yield block(pa.Table.from_batches(held))

    return run


def blocks(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """vectors (vec_id, v) as blocks with their cover trees, in a table of their own."""
    kind = dict(vectors.dtypes)["vec_id"]
    arrow = vectors.select("vec_id").limit(0).toArrow().schema.field("vec_id").type
    return cut(vectors.mapInArrow(_planted(arrow, width), f"ids array<{kind}>, v binary, " + ", ".join(f"{p} binary" for p in PARTS)), "cover-trees")


def _opened(b: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, np.ndarray, dict[str, np.ndarray]]]:
    for i in range(b.num_rows):
        tree = {p: np.frombuffer(b[p][i].as_py(), float if p == "radius" else np.int64) for p in PARTS}
        yield b["ids"][i].values, np.frombuffer(b["v"][i].as_py(), np.int64).reshape(-1, width), tree


def starts(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of the smallest hashes, in ascending order; as many as are asked for, so few rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def moved(trees: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of exact means; empty ones stay."""
    width = c.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, add = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
            for _, x, tree in _opened(b, width):
                more = sums(x, tree, c)
                count, add = count + more[0], add + more[1]
            full = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(full, pa.int32()), "many": pa.array(count[full]), "total": pa.array(add[full].tolist(), pa.list_(pa.int64()))})

    parts = trees.mapInArrow(run, "cluster int, many bigint, total array<bigint>")
    exact = [F.sum(F.col("total")[i].cast("decimal(20,0)")).alias(f"t{i}") for i in range(width)]
    out = c.copy()
    for r in parts.groupBy("cluster").agg(F.sum("many").alias("many"), F.array(*exact).alias("total")).collect():  # a row for each centroid
        out[r["cluster"]] = [int(t) // r["many"] for t in r["total"]]
    return out


def lloyd(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, in a table of its own, and the final centroids."""
    kept = quantised(vectors, scale, width)
    kind = dict(kept.dtypes)["vec_id"]
    arrow = kept.select("vec_id").limit(0).toArrow().schema.field("vec_id").type
    trees = blocks(kept, width)
    c = starts(kept, clusters, seed)
    if not len(c):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0), c
    for _ in range(rounds):
        before, c = c, moved(trees, c)
        if (before == c).all():  # a fixed point: further rounds change nothing
            break

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x, tree in _opened(b, width):
                own = assigned(x, tree, c)
                yield pa.RecordBatch.from_arrays([ids.cast(arrow), pa.array(own, pa.int32()), pa.array(squared(x, c[own]))], ["vec_id", "cluster", "distance"])

    return cut(trees.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint"), "assigned"), c


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """lloyd() with the inertia of each cluster and of all, and a digest of each final centroid."""
    spark = vectors.sparkSession
    found, c = lloyd(vectors, clusters, rounds, scale, width, seed)
    inertia = {r["cluster"]: int(r["inertia"]) for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row for each centroid
    rows = [(j, i, sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j, i in sorted(inertia.items())]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # as many rows as centroids
