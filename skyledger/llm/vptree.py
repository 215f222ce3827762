"""Nearest neighbours by inner product with vantage-point trees per shard.

Inner product becomes a distance by one more coordinate: with ``m`` the greatest norm of all vectors, x stands at
(x, sqrt(m^2 - |x|^2)) and a query at (q, 0), so that |q' - x'|^2 = |q|^2 + m^2 - 2 qx. In each shard a tree halves its
vectors again and again by their distance to a vantage point of their own; each half keeps the range of those distances.
A query's distance to a vantage point and that range bound from below how near a vector of the half can be, and a leaf's
bound is the greatest on its path. A leaf is left out when ``factor`` times its bound exceeds the distance of the kth
vector found so far: with factor 1 that is the triangle inequality and the result is exact, greater factors leave out
more. Leaves are taken from the most promising on, and products of a leaf with its queries are one matrix product.

Equal vectors are one point with its k + 1 smallest ids, more can never be in a result, so a vector that a third of the
rows share costs one point. Shards are dealt by a hash of the vector. Queries meet every shard in blocks whose
broadcast size is bounded; equal query vectors are searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skyledger.llm.texts import tidy
from skyledger.operators.lineage import settle

LEAF = 64
#: Added to bounds for rounding, in units of the greatest norm.
SLACK = 1e-9


@dataclass
class Tree:
    """Vectors in leaf order; for each inner node its vantage point, and for each leaf the nodes and ranges of its path."""

    rows: np.ndarray  # places of the shard's vectors in leaf order
    leaf: np.ndarray  # limits of the leaves in rows
    vantage: np.ndarray  # place of each node's vantage point
    node: np.ndarray  # leaf x level: node, -1 if the path is shorter
    low: np.ndarray  # leaf x level: least and greatest distance to the vantage point
    high: np.ndarray


def distances(products: np.ndarray, squares: np.ndarray, m2: float) -> np.ndarray:
    return np.sqrt(np.maximum(squares + m2 - 2 * products, 0.0))


def plant(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """``points`` have the further coordinate already, so plain distances hold among them."""
    depth = max(0, math.ceil(math.log2(max(len(points), 1) / leaf)))
    ranges, nodes = [(np.arange(len(points)), [], [], [])], []
    for _ in range(depth):
        halves = []
        for rows, path, low, high in ranges:
            centre = points[rows].mean(axis=0)
            own = int(rows[np.argmax(((points[rows] - centre) ** 2).sum(axis=1))])  # the outermost splits best
            far = np.sqrt(((points[rows] - points[own]) ** 2).sum(axis=1))
            order = np.argsort(far, kind="stable")
            nodes.append(own)
            for half in (order[: len(order) // 2], order[len(order) // 2 :]):
                ends = (far[half[0]], far[half[-1]]) if len(half) else (0.0, 0.0)
                halves.append((rows[half], [*path, len(nodes) - 1], [*low, ends[0]], [*high, ends[1]]))
        ranges = halves
    return Tree(
        np.concatenate([r[0] for r in ranges]), np.cumsum([0, *[len(r[0]) for r in ranges]]), np.array(nodes, np.int64),
        np.array([r[1] for r in ranges], np.int64).reshape(len(ranges), depth),
        np.array([r[2] for r in ranges]).reshape(len(ranges), depth), np.array([r[3] for r in ranges]).reshape(len(ranges), depth))


def leaf_bounds(tree: Tree, to_vantage: np.ndarray) -> np.ndarray:
    """Query x leaf: no vector of the leaf is nearer."""
    out = np.zeros((len(to_vantage), len(tree.leaf) - 1))
    for level in range(tree.node.shape[1]):
        d = to_vantage[:, tree.node[:, level]]
        np.maximum(out, tree.low[:, level] - d, out=out)
        np.maximum(out, d - tree.high[:, level], out=out)
    return out


def nearest(vectors: np.ndarray, tree: Tree, queries: np.ndarray, m2: float, k: int, factor: float) -> tuple[np.ndarray, ...]:
    """(query, place) of vectors that can be among the k of the highest product, ties at the kth kept, and the leaves visited."""
    squares = (queries**2).sum(axis=1)
    bounds = leaf_bounds(tree, distances(queries @ vectors[tree.vantage].T, squares[:, None], m2)) * factor
    slack = SLACK * math.sqrt(m2)
    kth = np.full(len(queries), -np.inf)  # product of the kth found
    best = np.full((len(queries), k), -np.inf)
    order = np.argsort(bounds, axis=1, kind="stable")
    todo = np.ones_like(bounds, bool)
    found_query, found_row, found_score = [], [], []
    visits = 0
    ordered = vectors[tree.rows]

    def visit(leaf: int, who: np.ndarray) -> None:
        nonlocal visits
        a, b = tree.leaf[leaf], tree.leaf[leaf + 1]
        todo[who, leaf] = False
        visits += len(who)
        score = queries[who] @ ordered[a:b].T
        q, row = np.nonzero(score >= kth[who, None] - SLACK * m2)
        found_query.append(who[q])
        found_row.append(a + row)
        found_score.append(score[q, row])
        both = np.concatenate([best[who], score], axis=1)
        best[who] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
        kth[who] = best[who].min(axis=1)

    first = min(4, bounds.shape[1])
    for turn in range(first):  # the most promising leaves of each query
        for leaf in np.unique(order[:, turn]):
            visit(leaf, np.flatnonzero(order[:, turn] == leaf))
    for leaf in np.argsort(bounds.min(axis=0), kind="stable") if first < bounds.shape[1] else ():
        reach = distances(kth, squares, m2)  # infinite while fewer than k are found
        who = np.flatnonzero(todo[:, leaf] & (bounds[:, leaf] <= reach + slack))
        if len(who):
            visit(leaf, who)
    q, row, score = (np.concatenate(x) for x in (found_query, found_row, found_score))
    keep = score >= kth[q] - SLACK * m2
    return q[keep], tree.rows[row[keep]], visits


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last in double precision."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def valid(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """(id, v) of rows with an id and a finite vector other than zero; v in double precision."""
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return v.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(finite & F.exists("v", lambda x: x != 0.0))


def norm2(name: str = "v"):
    return F.aggregate(name, F.lit(0.0), lambda a, x: a + x * x)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


@dataclass
class Index:
    """Points (shard, v, ids) in as many shards, their dimension, and the square of the greatest norm."""

    points: DataFrame
    shards: int
    size: int
    m2: float
    most: int  # ids kept of equal vectors


def build_index(rows: DataFrame, k: int, shard_rows: int) -> Index:
    """``rows`` as of ``valid``. Vectors of another length than the most frequent one (ties: the longer) take no part."""
    facts = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("rows"), F.max(norm2()).alias("m2")).orderBy(
        F.desc("rows"), F.desc("size")).first()
    size, count, m2 = (facts["size"], facts["rows"], facts["m2"]) if facts else (0, 0, 1.0)
    shards = max(1, math.ceil(count / shard_rows))
    of_one = rows.filter(F.size("v") == size).distinct().withColumn(
        "place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("place") <= k + 1)
    points = of_one.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = points.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "ids")
    return Index(settle(points, "points"), shards, size, m2, k + 1)


def search_block(index: Index, queries: pa.Table, factor: float) -> DataFrame:
    """(query, id, score) of k + 1 rows for each query and shard; ``queries`` has (query, v)."""
    names, wanted = queries["query"].to_numpy(), matrix(queries["v"])
    m2, k = index.m2, index.most

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        vectors = matrix(rows["v"])
        ids = rows["ids"].combine_chunks()
        count, ids = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()
        start = np.append(0, np.cumsum(count))
        order = np.argsort(ids[start[:-1]])  # the tree does not depend on how rows arrive
        rest = np.sqrt(np.maximum(m2 - (vectors**2).sum(axis=1), 0.0))
        tree = plant(np.column_stack([vectors, rest])[order])
        outs = []
        for a in range(0, len(wanted), 1024):
            part = wanted[a : a + 1024]
            q, row, _ = nearest(vectors[order], tree, part, m2, k, factor)
            row = order[row]
            score = products(part[q], vectors[row])
            q, id_, score = np.repeat(q, count[row]), ids[np.repeat(start[row], count[row]) + within(count[row])], np.repeat(score, count[row])
            by = np.lexsort((id_, -score, q))
            q, id_, score = q[by], id_[by], score[by]
            best = np.arange(len(q)) - np.searchsorted(q, q) < k
            outs.append(pa.table({"query": names[a + q[best]], "id": id_[best], "score": score[best]}))
        return pa.concat_tables(outs) if outs else pa.table({
            "query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    return index.points.groupBy("shard").applyInArrow(one, "query long, id long, score double")


def within(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def search(
    vectors: DataFrame, k: int = 20, every: int = 20, factor: float = 6.0, vector: str = "embedding", key: str = "vec_id",
    shard_rows: int = 8192, block_bytes: int = 16 << 20,
) -> DataFrame:
    """For each row whose key ``every`` divides the ``k`` others of the highest inner product: ``query_id``, ``rank``, key, ``score``.

    Candidates are all rows but the query's own; nearest first, ties to the smaller key. Vectors that are null, zero or
    hold null or non-finite components, that have no key or another length than most, take no part, neither as query nor
    as candidate. Rows repeated whole count once; rows that share a key but not the vector are rows of their own, and none
    is a candidate of that key. An empty table, or one with a single row, gives an empty result. Other columns are not read.
    """
    rows = settle(valid(vectors, vector, key), "vectors")
    index = build_index(rows, k, shard_rows)
    asked = settle(rows.filter((F.size("v") == index.size) & (F.col("id") % every == 0)).distinct(), "asked")
    distinct = settle(asked.groupBy("v").agg(F.min("id").alias("query")), "queries")
    count = distinct.count()
    blocks = max(1, math.ceil(count * index.size * 8 / block_bytes))
    out = None
    for block in range(blocks):
        part = distinct.filter(F.pmod(F.xxhash64("v"), F.lit(blocks)) == block).select("query", "v").orderBy("query").toArrow()
        found = settle(search_block(index, part, factor), "found")
        out = found if out is None else out.union(found)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = out.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place")
    # Queries of one vector get the same list, each without itself.
    own = Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "id")
    return (
        asked.join(distinct, "v").select(F.col("id").alias("query_id"), F.col("query").alias("name")).join(
            top.withColumnRenamed("query", "name"), "name")
        .filter("id <> query_id").withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(key), "score"))
