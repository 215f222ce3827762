"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Both models count the words and word pairs of whole texts in a fixed number of hash buckets; a document's weight is the
sum of the log ratio target / raw over its n-grams, divided by their number to the power ``length_power`` so that long
documents do not win or lose by length alone. Adding standard Gumbel noise to the log weights and keeping the k largest
draws k documents without replacement in proportion to their weights. The raw model counts every document; the target
model is fitted on at most ``target_rows`` labelled ones, those with the least hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyledger.llm.texts import ALNUM, LOWER, WORDS, slices, tidy, window_hash, words
from skyledger.operators.lineage import settle

#: Ranges that one pass of the selection tells apart.
BINS = 4096


def _grams(body: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice: first and last document, then document and bucket of every word and word pair."""
    for part in slices(body):
        data = LOWER[part.data]
        found = words(data, part.bounds, ALNUM)
        values = found.hashes(data)
        pairs = found.starts_of(2)
        both = window_hash(values, 2, WORDS)[pairs] if len(pairs) else np.zeros(0, np.uint64)
        owner = found.owner()
        yield part.first, part.last, np.append(owner, owner[pairs]) + part.first, (
            np.append(values, both) % np.uint64(buckets)).astype(np.int64)


def gram_counts(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """(bucket, raw, target): counts over all documents and over those with ``is_target``."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            chosen = batch.column(1).to_numpy(zero_copy_only=False)
            for _, _, doc, bucket in _grams(batch.column(0), buckets):
                total[0] += np.bincount(bucket, minlength=buckets)
                total[1] += np.bincount(bucket[chosen[doc]], minlength=buckets)
        some = np.flatnonzero(total[0])
        yield pa.record_batch({"bucket": pa.array(some), "raw": pa.array(total[0][some]), "target": pa.array(total[1][some])})

    return docs.select(text, "is_target").mapInArrow(tidy(one), "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(counts: list, buckets: int) -> np.ndarray:
    """log(target / raw) per bucket, both smoothed by one count."""
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weights(docs: DataFrame, text: str, key: str, ratio: np.ndarray, length_power: float) -> DataFrame:
    """(id, n_grams, log_weight); without n-grams the weight is neutral."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, last, doc, bucket in _grams(batch.column(1), len(ratio)):
                count[first:last] = np.bincount(doc - first, minlength=last - first)
                total[first:last] = np.bincount(doc - first, ratio[bucket], minlength=last - first)
            yield pa.record_batch({
                "id": batch.column(0).cast(pa.int64()), "n_grams": pa.array(count),
                "log_weight": pa.array(total / np.maximum(count, 1) ** length_power),
            })

    return docs.select(key, text).mapInArrow(tidy(one), "id long, n_grams long, log_weight double")


def kth(rows: DataFrame, column: str, k: int, largest: bool) -> tuple[float | int, int]:
    """The k-th value of a written table in descending or ascending order, and how many of its rows belong to the k.

    Counts over at most ``BINS`` equal ranges narrow the place down until one value is left; 1 <= k <= rows.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    left = k
    while low < high:
        width = (high - low) / BINS
        found = (
            rows.filter(F.col(column).between(low, high))
            .groupBy(F.least(F.floor((F.col(column) - F.lit(low)) / width), F.lit(BINS - 1)).alias("bin"))
            .agg(F.count(F.lit(1)), F.min(column), F.max(column)).collect()
        )
        for _, n, first, last in sorted(found, key=lambda r: r[0], reverse=largest):
            if n >= left:
                low, high = first, last
                break
            left -= n
    return low, left


def gumbel_top_k(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """``selected``: the k largest of log weight plus noise; among equal keys the least ids.

    The noise is a hash of the id and the seed. Rows with one id and weight stand or fall together.
    """
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id")), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = settle(rows.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "keys")
    n = keyed.count()
    if k <= 0 or k >= n:
        return keyed.withColumn("selected", F.lit(k > 0))
    limit, ties = kth(keyed, "key", k, True)
    equal = keyed.filter((F.col("key") == limit) & F.col("id").isNotNull())
    last = kth(equal, "id", min(ties, n_equal), False)[0] if (n_equal := equal.count()) else -1
    return keyed.withColumn("selected", (F.col("key") > limit) | (
        (F.col("key") == limit) & F.coalesce(F.col("id") <= last, F.lit(False))))


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", share: float = 0.8,
    buckets: int = 1 << 15, target_rows: int = 20_000, length_power: float = 0.0, seed: int = 20,
) -> DataFrame:
    """(id, n_grams, log_weight, key, selected) per row; ``target`` holds ids of the target text, in column ``key``.

    A ``share`` of the rows is drawn. Null and empty texts have no n-grams and the neutral weight 0; without targets all
    weights are equal but for smoothing. Repeated target ids count once; repeated rows are drawn together. Rows
    without an id can be drawn. An empty table gives no rows. Other columns are not read.
    """
    chosen = target.select(key).dropna().distinct().orderBy(F.xxhash64(key), key).limit(target_rows)
    flagged = docs.select(key, text).join(
        F.broadcast(chosen.withColumn("is_target", F.lit(True))), key, "left").select(
        text, F.coalesce("is_target", F.lit(False)).alias("is_target"))
    ratio = log_ratio(gram_counts(flagged, text, buckets).collect(), buckets)  # one row per bucket
    weighted = settle(weights(docs, text, key, ratio, length_power), "weights")
    return gumbel_top_k(weighted, round(share * weighted.count()), seed).withColumnRenamed("id", key)
