"""Packing of documents into training sequences by non-negative least squares over the length histogram.

1. Documents are tokenized once; each is cut into full sequences and a rest, and only (start, length, checksum) of
   the pieces is written, never the ids.
2. Lengths fall into classes of ``unit`` tokens. All combinations of up to three classes that fill a sequence exactly
   are the columns of a least-squares problem whose right side is the histogram; its non-negative solution says how
   often each combination is used. Counts are rounded so that no class is overdrawn, and a greedy pass fills sequences
   with what is left, largest class first. The histogram has at most ``capacity / unit`` rows at any corpus size.
3. A piece's rank within its class says which combination, which sequence and which slot it gets. Ranks are counted
   in two levels, within (class, bucket) and over the buckets, so that a length which a third of all documents
   share is spread over many tasks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skyledger.llm.texts import tidy
from skyledger.llm.tokens import token_ids
from skyledger.operators.lineage import settle

#: Rows of one bucket of a class.
BUCKET_ROWS = 4_000


def token_pieces(docs: DataFrame, text: str, key: str, tokenizer: str, end_id: int, capacity: int,
                 added_tokens: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each document cut at multiples of the capacity."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).cast(pa.int64())
            out: list[list] = [[] for _ in range(5)]
            for first, ids, limits in token_ids(batch.column(1), tokenizer, added_tokens):
                for d in range(len(limits) - 1):
                    mine = np.append(ids[limits[d] : limits[d + 1]], np.uint32(end_id)).astype("<u4", copy=False)
                    for a in range(0, len(mine), capacity):
                        body = mine[a : a + capacity]
                        for c, v in zip(out, (first + d, a, len(body), zlib.crc32(body), len(mine))):
                            c.append(v)
            rows, start, length, crc, total = (np.array(c, np.int64) for c in out)
            yield pa.record_batch(
                [names.take(pa.array(rows)), pa.array(start), pa.array(length), pa.array(crc), pa.array(total)],
                names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(key, text).mapInArrow(
        tidy(one), "id long, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(classes: int, present: np.ndarray) -> np.ndarray:
    """Rows of three classes, descending, 0 for none, that sum to ``classes``; each class must be present."""
    a, b = np.meshgrid(np.arange(1, classes + 1), np.arange(classes), indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = classes - a - b
    keep = (a >= b) & (b >= c) & (c >= 0) & present[a] & (present[b] | (b == 0)) & (present[np.maximum(c, 0)] | (c == 0))
    return np.stack([a, b, c], 1)[keep]


def non_negative_least_squares(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |matrix x - target|, by the active-set method."""
    n = matrix.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gram_all, aim = matrix.T, matrix.T @ target
    floor = 1e-7 * max(1.0, float(np.abs(aim).max(initial=0)))
    for _ in range(4 * matrix.shape[0] + 8):
        slope = aim - gram_all @ (matrix[:, active] @ x[active])
        slope[active] = -np.inf
        j = int(slope.argmax()) if n else 0
        if not n or slope[j] <= floor:
            break
        active[j] = True
        while True:
            some = matrix[:, active]
            # The ridge keeps columns that depend on each other solvable.
            trial = np.linalg.solve(some.T @ some + 1e-10 * np.eye(some.shape[1]), some.T @ target)
            if (trial > 0).all():
                x[:] = 0
                x[active] = trial
                break
            now, low = x[active], trial <= 0
            step = float((now[low] / np.maximum(now[low] - trial[low], 1e-300)).min())
            now = now + step * (trial - now)
            now[now < 1e-9] = 0
            x[active] = now
            active &= x > 0
            if not active.any():
                break
    return x


def plan(histogram: np.ndarray) -> list[tuple[list[int], int]]:
    """[(classes of one sequence, number of such sequences)] that use every piece once.

    ``histogram[c]`` counts the pieces of class c; a sequence holds at most ``len(histogram) - 1`` units.
    """
    classes = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    rows = combinations(classes, left > 0)
    if len(rows):
        matrix = np.zeros((classes + 1, len(rows)))
        for k in range(3):
            np.add.at(matrix, (rows[:, k], np.arange(len(rows))), rows[:, k] > 0)
        scale = max(1, int(left.max()))
        times = non_negative_least_squares(matrix[1:], left[1:] / scale) * scale
        for j in np.argsort(-times, kind="stable"):
            if times[j] < 0.5:
                break
            need = matrix[:, j].astype(np.int64)
            used = need > 0
            n = min(int(times[j] + 0.5), int((left[used] // need[used]).min()))
            if n:
                left -= n * need
                out.append(([int(c) for c in rows[j] if c], n))
    while left.any():
        room, chosen, rest = classes, [], left.copy()
        while room:
            fits = np.flatnonzero(rest[: room + 1])
            if not len(fits):
                break
            c = int(fits[-1])
            chosen.append(c)
            rest[c] -= 1
            room -= c
        need = np.bincount(chosen, minlength=classes + 1)
        used = need > 0
        n = int((left[used] // need[used]).min())
        left -= n * need
        out.append((chosen, n))
    return out


def slots(made: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """Per class rows (first rank, places in one sequence, first sequence, first slot), by first rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    next_rank: dict[int, int] = {}
    for chosen, n in made:
        for slot, c in enumerate(chosen):
            if slot and chosen[slot - 1] == c:
                continue
            places = chosen.count(c)
            rank = next_rank.get(c, 0)
            out.setdefault(c, []).append((rank, places, base, slot))
            next_rank[c] = rank + places * n
        base += n
    return {c: np.array(rows, np.int64) for c, rows in out.items()}


def pack(
    docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 1, capacity: int = 2048,
    unit: int = 8, added_tokens: bool = False,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and
    ``padded_length`` (the sequence's length if that is a power of two, else the capacity).

    ``added_tokens``: the text of a token added to the tokenizer is that token's id, as by the tokenizer's default;
    otherwise it is ordinary text. Every document ends with ``end_id``; a null or empty text is that id alone. Repeated rows are packed each for
    itself; a row without an id keeps a null id. An empty table gives no rows. Other columns are not read.
    """
    pieces = settle(
        token_pieces(docs, text, key, tokenizer, end_id, capacity, added_tokens)
        .withColumn("class", F.ceil(F.col("length") / unit).cast("int")), "pieces")
    counts = pieces.groupBy("class").count().collect()  # one row per class at most
    histogram = np.zeros(math.ceil(capacity / unit) + 1, np.int64)
    for r in counts:
        histogram[r["class"]] = r["count"]
    table = slots(plan(histogram))
    buckets = max(1, math.ceil(int(histogram.sum()) / BUCKET_ROWS))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "start"), F.lit(buckets)))
    inside = Window.partitionBy("class", "bucket")
    ranked = dealt.withColumn("rank", F.row_number().over(inside.orderBy("id", "start")) - 1)
    sizes = dealt.groupBy("class", "bucket").count()
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("class", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("class").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for c in np.unique(kind).tolist():
                mine = kind == c
                rows = table[c]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                k = rank[mine] - row[:, 0]
                sequence[mine], slot[mine] = row[:, 2] + k // row[:, 1], row[:, 3] + k % row[:, 1]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.record_batch(
                [batch.column(n) for n in names] + [pa.array(sequence), pa.array(slot)], names=[*names, "sequence_id", "slot"])

    placed = (
        ranked.join(offsets, ["class", "bucket"])
        .select("id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("rank") + F.col("before")).alias("rank"))
        .mapInArrow(place, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    )
    whole = Window.partitionBy("sequence_id")
    total = F.sum("length").over(whole)
    return placed.select(
        F.col("id").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        (F.sum("length").over(whole.orderBy("slot")) - F.col("length")).alias("offset"),
        F.when(F.bit_count(total) == 1, total).otherwise(F.lit(capacity).cast("long")).alias("padded_length"),
    )
