"""Ranked lexical search: term at a time with a limited set of accumulators.

The documents are read once into a forward index of the query terms: per document its length and the terms it holds with
their counts. Collection counts come from that index. Then every shard of documents is turned into posting lists, and each
query goes through its terms rarest first. A document gets an accumulator when a posting first touches it; once the
greatest contributions that the remaining terms can make in the shard no longer reach the kth best partial score, or the
kth best score of the shards that the task has done before, no document without an accumulator can come into the result
and no more are created. The accumulators there are go on to be updated exactly. A task returns k rows for each query.

Only the terms of the queries are broadcast, in blocks of at most ``limit`` terms, each with a scan of the index; the
texts are tokenised once for each block. Terms are told apart by 64-bit hashes and their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skyledger.llm.texts import ALNUM, LOWER, slices, tidy, words
from skyledger.operators.lineage import settle

#: Documents of a shard, and their postings, at most (a shard is whole batches of the index).
SHARD_DOCS, SHARD_POSTINGS = 32_768, 8_000_000


def terms_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per slice of texts: its first text, each text's limits in its words, and keys of the words."""
    for part in slices(column):
        data = LOWER[part.data]
        found = words(data, part.bounds, ALNUM)
        yield part.first, found.doc, found.hashes(data) ^ (found.end - found.start).astype(np.uint64)


def query_terms(queries: DataFrame, text: str, key: str) -> DataFrame:
    """(item, term) once for each distinct term of a query; rows with one key are one query."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc, keys in terms_of(batch.column(1)):
                owner = np.repeat(np.arange(first, first + len(doc) - 1), np.diff(doc))
                yield pa.record_batch({"item": batch.column(0).take(pa.array(owner)), "term": pa.array(keys.view(np.int64))})

    kind = queries.schema[key].dataType.simpleString()
    return queries.filter(F.col(key).isNotNull()).select(key, text).mapInArrow(one, f"item {kind}, term long").distinct()


def forward_index(docs: DataFrame, vocabulary: np.ndarray, text: str, key: str) -> DataFrame:
    """(id, n, terms, counts) of documents with at least one term; ``terms`` are places in the sorted vocabulary."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc, keys in terms_of(batch.column(1)):
                n = np.diff(doc)
                at = np.minimum(np.searchsorted(vocabulary, keys), max(len(vocabulary) - 1, 0))
                hit = np.flatnonzero(vocabulary[at] == keys) if len(vocabulary) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(n)), n)[hit]
                pair, count = np.unique(owner * max(len(vocabulary), 1) + at[hit], return_counts=True)
                ends = np.searchsorted(pair, np.arange(len(n) + 1) * max(len(vocabulary), 1)).astype(np.int32)
                out = pa.record_batch({
                    "id": batch.column(0).slice(first, len(n)), "n": pa.array(n.astype(np.int64)),
                    "terms": pa.ListArray.from_arrays(pa.array(ends), pa.array((pair % max(len(vocabulary), 1)).astype(np.int32))),
                    "counts": pa.ListArray.from_arrays(pa.array(ends), pa.array(count.astype(np.int32)))})
                yield out.filter(pa.array(n > 0))

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(tidy(one), f"id {kind}, n long, terms array<int>, counts array<int>")


def document_counts(index: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term: one row for each term and task, summed."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        used = np.flatnonzero(total)
        yield pa.record_batch({"term": pa.array(used.astype(np.int32)), "df": pa.array(total[used])})

    out = np.zeros(size, np.int64)
    for row in index.select("terms").mapInArrow(one, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row.term] = row.df
    return out


class Shard:
    """Posting lists of some documents: for each term their places and contributions, and the greatest contribution."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, docs: int, words_: int):
        m = 50 + 50 * n * docs // words_
        doc = np.repeat(np.arange(len(n)), sizes)
        gain = weights[terms] * (1_000_000_000 * counts // (1000 * counts + 20 * m[doc]))
        order = np.argsort(terms, kind="stable")
        self.docs, self.gain = doc[order], gain[order]
        self.start = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.size = len(n)
        full = np.flatnonzero(np.diff(self.start))
        self.most = np.zeros(len(weights), np.int64)
        if len(full):
            self.most[full] = np.maximum.reduceat(self.gain, self.start[full])

    def search(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of documents that can be among the k best with a score of ``floor`` or more, and postings that made accumulators.

        ``terms`` are ordered from the rarest.
        """
        score, known = np.zeros(self.size, np.int64), np.zeros(self.size, bool)
        remaining = np.append(np.cumsum(self.most[terms][::-1])[::-1], 0)
        creating, made = True, 0
        for j, term in enumerate(terms):
            span = slice(self.start[term], self.start[term + 1])
            docs, gain = self.docs[span], self.gain[span]
            if creating:
                bar = floor
                if made >= k:
                    held = score[known]
                    bar = max(bar, int(np.partition(held, len(held) - k)[len(held) - k])) if len(held) >= k else bar
                creating = remaining[j] >= bar
            if creating:
                score[docs] += gain  # a document stands once in a list
                known[docs] = True
                made += len(docs)
            else:
                old = known[docs]
                score[docs[old]] += gain[old]
        held = np.flatnonzero(score > 0)
        return held, score[held], made


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties by ascending id."""
    if len(scores) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(
    docs: DataFrame, queries: DataFrame, k: int = 50, text: str = "text", key: str = "doc_id", query_key: str = "item_id",
    limit: int = 500_000,
) -> DataFrame:
    """The ``k`` best documents of each query: query key, ``rank`` from 1, key, ``score``.

    Terms are runs of digits, letters and characters beyond ASCII; A-Z are lower-cased. A null or empty text has none,
    counts in no statistic and is never found; a query without terms has no rows. Ties go to the smaller id.
    Documents without an id count in the statistics and are not ranked; of rows with one id each is ranked for itself.
    Query rows with one key are one query; those without a key are left out. Ids are integers. Other columns are not read.
    """
    spark = docs.sparkSession
    kinds = queries.schema[query_key].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    wanted = settle(query_terms(queries, text, query_key), "terms")
    blocks = max(1, math.ceil(wanted.count() / limit))
    out = None
    for block in range(blocks):
        pairs = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else wanted
        found = one_block(docs, pairs, k, text, key)
        out = found if out is None else out.union(found)
    best_ = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(best_)).filter(F.col("rank") <= k).select(
        F.col("item").cast(kinds[0]).alias(query_key), "rank", F.col("id").cast(kinds[1]).alias(key), "score")


def one_block(docs: DataFrame, pairs: DataFrame, k: int, text: str, key: str) -> DataFrame:
    """(item, id, score): k rows of every task for each of these queries."""
    table = pairs.toArrow()
    items, item = np.unique(table["item"].to_numpy().astype(np.int64), return_inverse=True)
    vocabulary, term = np.unique(table["term"].to_numpy().view(np.uint64), return_inverse=True)
    index = settle(forward_index(docs, vocabulary, text, key), "index")
    facts = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
    count, total = facts["docs"], facts["words"] or 1
    df = document_counts(index, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    order = np.lexsort((term, df[term], item))
    limits = np.searchsorted(item[order], np.arange(len(items) + 1))
    lists = [term[order][limits[i] : limits[i + 1]] for i in range(len(items))]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(lists)
        for parts in shards(batches):
            ids, n, sizes, terms, counts = (np.concatenate(x) for x in zip(*parts))
            shard = Shard(n, sizes, terms, counts.astype(np.int64), weights, count, total)
            for i, wanted in enumerate(lists):
                floor = int(top[i][1][-1]) if len(top[i][1]) >= k else 1
                place, score, _ = shard.search(wanted, k, floor)
                if len(place):
                    top[i] = best(np.append(top[i][0], ids[place]), np.append(top[i][1], score), k)
        yield pa.record_batch({
            "item": pa.array(np.repeat(items, [len(t[0]) for t in top])),
            "id": pa.array(np.concatenate([np.zeros(0, np.int64), *[t[0] for t in top]])),
            "score": pa.array(np.concatenate([np.zeros(0, np.int64), *[t[1] for t in top]]))})

    return index.filter("id IS NOT NULL AND size(terms) > 0").select(
        F.col("id").cast("long").alias("id"), "n", "terms", "counts").mapInArrow(tidy(one), "item long, id long, score long")


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """Batches as (ids, n, sizes, terms, counts), gathered up to the size of a shard."""
    held, docs, postings = [], 0, 0
    for batch in batches:
        if not len(batch):
            continue
        terms, counts = batch.column(2), batch.column(3)
        part = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.diff(terms.offsets.to_numpy()),
                terms.flatten().to_numpy(), counts.flatten().to_numpy())
        if held and (docs + len(batch) > SHARD_DOCS or postings + len(part[3]) > SHARD_POSTINGS):
            yield held
            held, docs, postings = [], 0, 0
        held.append(part)
        docs, postings = docs + len(batch), postings + len(part[3])
    if held:
        yield held
