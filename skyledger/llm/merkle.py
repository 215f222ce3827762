"""Merkle dataset manifest, kept as postorder append logs.

Leaves of a tree (one tree per language) stand in id order. Aligned builders each take 8**4 consecutive nodes and append
every node to their log when it completes: leaves, then the node over each finished run. A whole subtree is a contiguous
piece of that order, so the place of a node follows from the sizes of the subtrees before it (``position``) and no index
is stored. The tops of the builders are the nodes of the next round, until one node of each tree is left; the trees' tops
then make a tree of their own. A builder's log is one row of a written table.

Proofs go the other way. A round's logs, each with the path above its top, give the paths of its nodes; the last round
meets the rows themselves. A leaf reads the siblings of its levels at their closed-form positions.

Nothing comes to the driver but the number of leaves of the largest tree. A group is at most 8**4 rows, whatever the
table holds. Ranks come from a range partitioning and the counts of its parts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyledger.operators.lineage import settle

#: Nodes of a run, and levels that one builder completes.
FANOUT, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "struct<before:string,after:string>"


def position(level: int, index: int | np.ndarray, leaves: int, levels: int) -> int | np.ndarray:
    """Place in postorder of node ``index`` of ``level``, in a tree of ``leaves`` leaves and ``levels`` levels above them."""
    start = index * FANOUT**level
    end = np.minimum((index + 1) * FANOUT**level, leaves)
    inside = sum(-(-end // FANOUT**j) for j in range(level + 1))
    return inside - 1 + sum(start // FANOUT**j for j in range(level + 1, levels + 1))


def height(nodes: int) -> int:
    """Levels above the leaves until one node is left."""
    h = 0
    while nodes > 1:
        nodes, h = -(-nodes // FANOUT), h + 1
    return h


def levels_of(nodes: int, levels: int) -> int:
    """Levels that a builder of this tree completes: all, if one builder takes the whole tree."""
    return min(height(nodes), levels)


def digest(data: str) -> str:
    return sha256(data.encode()).hexdigest()


def append_log(leaves: list[str], levels: int) -> bytes:
    """All nodes over the leaves in completion order."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(levels + 1)]

    def complete(level: int, node: str) -> None:
        log.append(node)
        if level < levels:
            open_[level].append(node)
            if len(open_[level]) == FANOUT:
                close(level)

    def close(level: int) -> None:
        run, open_[level] = open_[level], []
        complete(level + 1, digest("".join(run)))

    for leaf in leaves:
        complete(0, leaf)
    for level in range(levels):  # last runs
        if open_[level]:
            close(level)
    return bytes.fromhex("".join(log))


class Log:
    """Reads nodes of one builder's log by level and index."""

    def __init__(self, body: bytes, leaves: int, levels: int):
        self.body, self.leaves, self.levels = body.hex(), leaves, levels
        self.runs: dict[tuple[int, int], str] = {}

    def run(self, level: int, number: int) -> str:
        """The digests of run ``number`` of a level, joined."""
        if (level, number) not in self.runs:
            width = -(-self.leaves // FANOUT**level)
            at = position(level, np.arange(number * FANOUT, min(width, (number + 1) * FANOUT)), self.leaves, self.levels)
            self.runs[level, number] = "".join(self.body[64 * p : 64 * p + 64] for p in at.tolist())
        return self.runs[level, number]

    def path(self, index: int) -> list[tuple[str, str]]:
        """Siblings before and after the leaf's ancestor on each level."""
        steps = []
        for level in range(self.levels):
            number, place = divmod(index // FANOUT**level, FANOUT)
            run = self.run(level, number)
            steps.append((run[: 64 * place], run[64 * (place + 1) :]))
        return steps


def encoded(name: str) -> Column:
    """``-`` for a null, else the length in bytes, a colon and the value."""
    value = F.col(name).cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(fields: tuple[str, ...] = FIELDS, **changed: Column) -> Column:
    return F.sha2(F.concat(*[changed.get(f, encoded(f)) for f in fields]), 256)


def positions(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``p``, the rank within ``tree`` by ``order`` from 0, and ``n``, the nodes of the tree."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = nodes.schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, seen = None, 0
        for batch in batches:
            if not len(batch):
                continue
            codes = batch.column(schema.names.index("tree")).dictionary_encode()
            code = codes.indices.to_numpy()
            head = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            size = np.diff(np.append(head, len(code)))
            first = np.zeros(len(head), np.int64)
            if codes.dictionary[code[0]].as_py() == tree:
                first[0] = seen
            local = np.arange(len(code)) - np.repeat(head - first, size)
            tree, seen = codes.dictionary[code[-1]].as_py(), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], [*batch.schema.names, "place"])

    placed = settle(
        nodes.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
        .mapInArrow(number, schema.simpleString()[7:-1] + ",place:bigint").withColumn("part", F.spark_partition_id()), "placed")
    counts = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("tree")
    # One row for each part and tree in it; written, so that the join knows how small it is.
    offsets = settle(counts.select(
        "tree", "part", F.sum("rows").over(whole).alias("n"),
        (F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("offset")),
        "offsets")
    return placed.join(offsets, ["tree", "part"]).select(
        *schema.names, (F.col("offset") + F.col("place")).alias("p"), "n")


def build(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Logs (tree, block, n, leaves, top, log) of each round over nodes (tree, p, n, digest), lowest first."""
    most, size = nodes.agg(F.max("n")).first()[0] or 0, FANOUT**levels

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("p")
        leaves, n = rows["digest"].to_pylist(), rows["n"][0].as_py()
        log = append_log(leaves, levels_of(n, levels))
        return pa.table({
            "tree": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()),
            "n": pa.array([n], pa.int64()), "leaves": pa.array([len(leaves)], pa.int32()),
            "top": [log[-32:].hex()], "log": pa.array([log], pa.binary())})

    rounds = []
    while True:
        blocks = nodes.select("tree", F.expr(f"p div {size}").alias("block"), "p", "n", "digest")
        rounds.append(settle(blocks.groupBy("tree", "block").applyInArrow(
            one, "tree string, block long, n long, leaves int, top string, log binary"), "log"))
        if most <= size:
            return rounds
        most = -(-most // size)
        nodes = rounds[-1].filter(f"n > {size}").select(
            "tree", F.col("block").alias("p"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("top").alias("digest"))


def tops(rounds: list[DataFrame], levels: int) -> DataFrame:
    """(tree, digest) of the one node left of each tree."""
    done = [r.filter(f"n <= {FANOUT**levels}").select("tree", F.col("top").alias("digest")) for r in rounds]
    return functools.reduce(DataFrame.union, done)


def expanded(logs: DataFrame, levels: int) -> DataFrame:
    """(tree, p, path) of every leaf of the logs, which have the path above their top."""
    steps = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                log = Log(row["log"], row["leaves"], levels_of(row["n"], levels))
                first = row["block"] * FANOUT**levels
                paths = [[{"before": b, "after": a} for b, a in log.path(i)] + row["path"] for i in range(row["leaves"])]
                yield pa.record_batch({
                    "tree": pa.array([row["tree"]] * len(paths), pa.string()),
                    "p": pa.array(range(first, first + len(paths)), pa.int64()),
                    "path": pa.array(paths, steps)})

    return logs.select("tree", "block", "n", "leaves", "log", "path").mapInArrow(
        expand, f"tree string, p long, path array<{STEP}>")


def with_paths(rounds: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The logs of the lowest round, each with the siblings from its top upwards; ``above`` has (tree, path) of each tree."""
    below = None
    for logs in reversed(rounds):
        whole = logs.filter(f"n <= {FANOUT**levels}").join(above, "tree")
        if below is not None:
            whole = whole.unionByName(logs.filter(f"n > {FANOUT**levels}").join(below, ["tree", "block"]))
        if logs is not rounds[0]:
            below = settle(expanded(whole, levels).withColumnRenamed("p", "block"), "paths")
    return whole


def manifest(docs: DataFrame, key: str = "doc_id", tree: str = "lang", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Every row with its leaf and place: key, ``tree`` (the encoded language), ``lang``, ``digest``, ``p``, ``n``, ``changed``.

    ``changed`` is the leaf after the letters A-Z of ``text`` are lower-cased where 3 divides the crc32 of the decimal
    key; elsewhere the leaf itself.
    """
    lowered = F.translate("text", UPPER, LOWER)
    low = F.when(lowered.isNull(), "-").otherwise(F.concat(F.octet_length("text").cast("string"), F.lit(":"), lowered))
    hit = F.crc32(F.col(key).cast("string")) % 3 == 0
    nodes = docs.select(
        F.col(key).alias("id"), encoded(tree).alias("tree"), F.col(tree).alias("lang"), leaf(fields).alias("digest"),
        F.when(hit, leaf(fields, text=low)).alias("changed"))
    # Written, as range bounds are sampled from it: the texts are read once.
    return positions(settle(nodes.withColumn("changed", F.coalesce("changed", "digest")), "digests"), ["id", "digest"])


def prove(
    docs: DataFrame, key: str = "doc_id", tree: str = "lang", fields: tuple[str, ...] = FIELDS,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per row: key, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``folded_root`` comes from the row as it is after tampering (see ``manifest``) and the siblings of the log. Rows with
    one id stand in the order of their leaves and each has its own proof; a row without an id comes first in its tree
    and is not tampered with, as it has no crc32. A null is a field of its own (``-``), so it differs from an empty text.
    Columns other than ``fields`` are not read. An empty table gives an empty result.
    """
    size = FANOUT**levels
    nodes = settle(manifest(docs, key, tree, fields), "leaves")
    rounds = build(nodes.select("tree", "p", "n", "digest"), levels)
    # Trees by name: null first, then bytewise, which is how Spark orders strings.
    name = F.when(F.col("tree") == "-", None).otherwise(F.regexp_replace("tree", "^[0-9]+:", ""))
    forest = positions(
        tops(rounds, levels).select(F.col("tree").alias("of"), name.alias("lang"), "digest").withColumn("tree", F.lit("")), ["lang"])
    forest = settle(forest, "forest")
    upper = build(forest.select("tree", "p", "n", "digest"), levels)
    root = tops(upper, levels).select(F.col("digest").alias("root"))
    logs = with_paths(upper, upper[-1].select("tree").distinct().withColumn("path", F.array().cast(f"array<{STEP}>")), levels)
    trees = expanded(logs, levels).drop("tree").join(forest.select("of", "p", F.col("digest").alias("subroot")), "p")
    above = settle(trees.join(F.broadcast(root)).select(F.col("of").alias("tree"), "subroot", "root", "path"), "trees")
    whole = with_paths(rounds, above.select("tree", "path"), levels).select("tree", "block", "leaves", "n", "log", "path").join(
        above.drop("path"), "tree")

    def one(key_: tuple, rows: pa.Table, logs_: pa.Table) -> pa.Table:
        found = logs_.to_pylist()[0]
        log = Log(found["log"], found["leaves"], levels_of(found["n"], levels))
        above_ = [(s["before"], s["after"]) for s in found["path"]]
        proofs, folded = [], []
        for p, start in zip(rows["p"].to_pylist(), rows["changed"].to_pylist()):
            path = log.path(p % size) + above_
            proofs.append(digest("".join(b + a for b, a in path)))
            for before, after in path:
                start = digest(before + start + after)
            folded.append(start)
        n = len(rows)
        root_ = found["root"]
        return pa.table({
            "id": rows["id"], "leaf": rows["digest"], "subroot": pa.array([found["subroot"]] * n, pa.string()),
            "root": pa.array([root_] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root_ for f in folded], pa.bool_())})

    kind = docs.schema[key].dataType.simpleString()
    rows = nodes.select("id", "tree", F.expr(f"p div {size}").alias("block"), "p", "digest", "changed")
    return rows.groupBy("tree", "block").cogroup(whole.groupBy("tree", "block")).applyInArrow(
        one, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    ).withColumnRenamed("id", key)
