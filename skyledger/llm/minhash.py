"""MinHash near-deduplication: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

A document's shingles are hashed once; the top bits of a hash choose one of ``bins`` bins and each bin keeps its least
hash. An empty bin copies a full one, found by a fixed sequence of hashed tries, so that every bin of two documents
agrees with the probability of their similarity. Bands of bins are the buckets.

Pair counts are bounded by stars. First every document is compared with the least of its buckets' centres, the
smallest id of each bucket: one edge for each document. Buckets whose members are in several classes after that are
open. Rounds follow in which each member outside the largest class of an open bucket is compared with the hub of that
class, the member with the most shingles that others of the open buckets have as well; a hub is near to many where the
smallest id is any variant. The rounds end when one merges nothing. Links that stars can miss lie between members that
are in different classes of an open bucket then; each member outside its largest class is compared with the members of
the other classes, a bucket's members being dealt over several tasks. Members of one class need no comparison, so a
group of near copies costs about one edge for each member, and no link of a bucket is lost.

Tests inside the joins keep pairs from being formed. Two bits of every bin must agree often enough; a pair as
similar as asked for misses that by five standard deviations. The shingles that a document has in common with any
other of the open buckets must be enough for the overlap: a variant with too many words of its own is like nobody,
however many it shares buckets with. And the documents of open buckets have a second, wide sketch, the parity of their
shingles in each of 2,048 places: each shingle that only one of two documents has changes one place, so the places that
differ are never more than such shingles, and for sets of up to some thousands nearly as many. All links are confirmed
on the full shingle sets.

Documents with equal sets are one class from the start and enter as one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skyledger.llm.repeats import spread, texts_and_ids
from skyledger.llm.texts import LOWER, SPACED, WORDS, mix, slices, tidy, window_hash, words
from skyledger.operators.lineage import settle

BINS, ROWS = 255, 5
#: Two bits of every bin, 32 bins in a word.
BIT_WORDS = 8
#: Places of the wide sketch, and members of an open bucket that one task compares with the others.
PLACES, DEALT = 2048, 1024


def _sets(body: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice: first and last document, then document and hash of its distinct shingles, both ascending."""
    for part in slices(body):
        data = LOWER[part.data]
        found = words(data, part.bounds, SPACED)
        values = found.hashes(data)
        count = np.diff(found.doc)
        per = np.maximum(count - size + 1, 0)
        doc = np.repeat(np.arange(part.docs), per)
        start = spread(found.doc[:-1], per)
        shingle = window_hash(values, size, WORDS)[start] if len(start) else np.zeros(0, np.uint64)
        few = np.flatnonzero((count > 0) & (count < size))  # the whole sequence as one shingle
        whole = np.zeros(len(few), np.uint64)
        for k in range(1, size):
            some = count[few] == k
            if some.any():
                whole[some] = mix(window_hash(values, k, WORDS)[found.doc[:-1][few[some]]] + np.uint64(k))
        doc, shingle = np.append(doc, few), np.append(shingle, whole)
        order = np.lexsort((shingle, doc))
        doc, shingle = doc[order], shingle[order]
        fresh = np.append(True, (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1]))[: len(doc)]
        yield part.first, part.last, doc[fresh] + part.first, shingle[fresh]


def densified(filled: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Fill empty bins (False in ``filled``) in place from full ones by a sequence of tries fixed per bin."""
    n = bins.shape[1]
    one = filled.sum(axis=1) == 1
    bins[one] = bins[one, filled[one].argmax(axis=1)][:, None]
    row, col = np.nonzero(~filled & (filled.any(axis=1) & ~one)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        tries = (mix(np.arange(n, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(attempt)) % np.uint64(n)).astype(np.int64)
        source = tries[col]
        done = filled[row, source]
        bins[row[done], col[done]] = bins[row[done], source[done]]
        row, col = row[~done], col[~done]
    return bins


def sketches(docs: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(id, n_shingles, two sums that name the set, bits of the bins, buckets); no buckets without shingles or id."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            body, _ = texts_and_ids(table, text, key)
            n = len(table)
            bins, filled = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
            count, sums = np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
            for first, last, doc, shingle in _sets(body, size):
                count[first:last] = np.bincount(doc - first, minlength=last - first)
                head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))[: len(doc)]
                if not len(doc):
                    continue
                for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                    sums[k, doc[head]] = np.add.reduceat(mix(shingle ^ np.uint64(salt)), head)
                place = ((shingle >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
                least = np.append(True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1]))
                bins[doc[least], place[least]] = shingle[least]
                filled[doc[least], place[least]] = True
            full = count > 0
            bins = densified(filled, bins)
            bands = bins.reshape(n, BINS // ROWS, ROWS)
            mark = np.broadcast_to(np.arange(BINS // ROWS, dtype=np.uint64), bands.shape[:2])
            for r in range(ROWS):
                mark = mix(mark * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
            ends = np.append(0, np.cumsum(full * (BINS // ROWS))).astype(np.int32)
            pair = np.zeros((n, BIT_WORDS * 32), np.uint64)
            pair[:, :BINS] = mix(bins) & np.uint64(3)
            pair <<= np.tile(np.arange(0, 64, 2, dtype=np.uint64), BIT_WORDS)
            bits = np.bitwise_or.reduce(pair.reshape(n, BIT_WORDS, 32), axis=2)
            yield pa.record_batch({
                "id": table[key].combine_chunks().cast(pa.int64()), "n_shingles": pa.array(count),
                "set1": pa.array(sums[0].view(np.int64)), "set2": pa.array(sums[1].view(np.int64)),
                "bits": pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * BIT_WORDS), pa.array(bits.reshape(-1).view(np.int64))),
                "buckets": pa.ListArray.from_arrays(pa.array(ends), pa.array(mark[full].reshape(-1).view(np.int64))),
            })

    return docs.select(key, text).mapInArrow(
        tidy(one), "id long, n_shingles long, set1 long, set2 long, bits array<long>, buckets array<long>")


def shingle_sets(docs: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(id, shingles) of every document."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            body, ids = texts_and_ids(table, text, key)
            for first, last, doc, shingle in _sets(body, size):
                ends = np.searchsorted(doc, np.arange(first, last + 1)).astype(np.int32)
                yield pa.record_batch({
                    "id": pa.array(ids[first:last]),
                    "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(shingle.view(np.int64))),
                })

    return docs.select(key, text).mapInArrow(tidy(one), "id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = sets.toDF("a", "of_a"), sets.toDF("b", "of_b")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b")).alias("sum"))
        .filter(F.col("both") * (100 + percent) >= F.col("sum") * percent)
        .select("a", "b").distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id reachable, for every id in the edges (a, b).

    Labels fall to the least neighbouring label and then to their label's label; rounds grow with the logarithm of
    the longest path. Each round is written, and only counts come to the driver.
    """
    links = settle(edges, "links")
    links = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select("b", "a"))
    labels = settle(links.groupBy("id").agg(F.min("other").alias("label"))
                    .select("id", F.least("id", "label").alias("label")), "labels")
    while True:
        near = (
            links.join(labels.toDF("other", "near"), "other").groupBy("id").agg(F.min("near").alias("near"))
            .join(labels, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        )
        above = labels.toDF("label", "above")
        step = settle(near.join(above, "label").select("id", "old", F.least("label", "above").alias("label")), "labels")
        labels = step.select("id", "label")
        if step.filter("label < old").isEmpty():
            return labels


def alike(a: str, b: str, percent: int) -> Column:
    """Whether two documents can be similar enough by n (shingles), bits, and common (shingles others have as well)."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    share = percent / 100
    expected = share + (1 - share) / 4
    agree = F.lit(0)
    for k in range(BIT_WORDS):
        differ = F.get(f"{a}bits", F.lit(k)).bitwiseXOR(F.get(f"{b}bits", F.lit(k)))
        agree = agree + F.bit_count(F.bitwise_not(
            differ.bitwiseOR(F.shiftrightunsigned(differ, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    least = BINS * (expected - 5 * F.sqrt(expected * (1 - expected) / F.least(n, m, F.lit(BINS))))
    overlap = F.least(f"{a}common", f"{b}common") * (100 + percent) >= (n + m) * percent
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & overlap & ((F.least(n, m) < 16) | (agree >= least))


def parities(sets: DataFrame) -> DataFrame:
    """(id, odd): for each of ``PLACES`` places by hash whether an odd number of the shingles fall into it."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 1024) for whole in batches for i in range(0, len(whole), 1024)):
            shingles = batch.column(1)
            owner = np.repeat(np.arange(len(batch)), np.diff(shingles.offsets.to_numpy()))
            place = (mix(shingles.flatten().to_numpy().view(np.uint64)) % np.uint64(PLACES)).astype(np.int64)
            odd = (np.bincount(owner * PLACES + place, minlength=len(batch) * PLACES) & 1).astype(np.uint8)
            packed = np.packbits(odd).view(np.int64)
            yield pa.record_batch({
                "id": batch.column(0), "odd": pa.ListArray.from_arrays(
                    pa.array(np.arange(len(batch) + 1, dtype=np.int32) * (PLACES // 64)), pa.array(packed))})

    return sets.select("id", "shingles").mapInArrow(one, "id long, odd array<long>")


def near_enough(a: str, b: str, percent: int) -> Column:
    """Whether no more places of the wide sketches differ than links allow; five deviations below where places overlap."""
    apart = (F.col(f"{a}n") + F.col(f"{b}n")) * ((100 - percent) / (100 + percent))
    differ = F.aggregate(
        F.zip_with(f"{a}odd", f"{b}odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    usual = (1 - F.exp(apart * (-2.0 / PLACES))) * (PLACES / 2) + 5 * PLACES**0.5 / 2
    return differ <= F.least(apart + 1e-6, usual)


def relabelled(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label) after more edges between ids; ids without a label are their own."""
    between = edges.join(names.toDF("a", "of_a"), "a", "left").join(names.toDF("b", "of_b"), "b", "left").select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).filter("a <> b").distinct()
    merged = components(between)
    return settle(
        names.join(merged.toDF("label", "final"), "label", "left").select("id", F.coalesce("final", "label").alias("label"))
        .union(merged.join(names, "id", "left_anti").select("id", "label")), "names")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 75,
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` and ``kept`` (it is its component's least id).

    Lower-cased words between blanks; documents are linked where intersection / union of their sets of
    ``size``-word shingles is ``percent`` / 100 or more. Fewer words are one shingle; a null or empty text has none
    and is linked with nothing. Rows with one id are one document in links. A row without an id is returned with
    a null component and kept. An empty table gives an empty result. Other columns are not read.
    """
    table = settle(sketches(docs, text, key, size), "sketches")
    full = table.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = full.groupBy("set1", "set2").agg(
        F.min("id").alias("rep"), F.min("n_shingles").alias("n"), F.min_by("bits", "id").alias("bits"),
        F.min_by("buckets", "id").alias("buckets"))
    rows = classes.select("rep", "n", F.explode("buckets").alias("bucket"))
    crowded = rows.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    pairs = settle(rows.join(crowded.select("bucket", "centre"), "bucket").select("bucket", "rep", "centre"), "members")
    known = settle(classes.join(pairs.select("rep").distinct(), "rep", "left_semi").select("rep", "n", "bits", "buckets"), "bits")
    # The ids grow with the corpus, so they are not to be broadcast, however few they are here.
    sets = settle(shingle_sets(
        docs.join(known.select(F.col("rep").alias(key)).hint("merge"), key, "left_semi"), text, key, size), "sets")

    def stars(some: DataFrame, facts: DataFrame) -> DataFrame:
        """Pairs of members and centres that can be alike."""
        both = some.filter("rep > centre").select("centre", "rep").distinct().join(facts, "rep").join(
            facts.select(F.col("rep").alias("centre"), F.struct("n", "bits", "common").alias("c")), "centre")
        return both.filter(alike("", "c.", percent)).select(F.col("centre").alias("a"), F.col("rep").alias("b"))

    nearest = stars(pairs.groupBy("rep").agg(F.min("centre").alias("centre")), known.withColumn("common", F.col("n")))
    names = relabelled(table.limit(0).select("id", F.col("id").alias("label")), confirmed(nearest, sets, percent))

    def placed(some: DataFrame, *facts: str) -> DataFrame:
        """Members of buckets with their class; a document that links with none is a class of its own."""
        return some.join(names.toDF("rep", "label"), "rep", "left").select(
            "bucket", "rep", *facts, F.coalesce("label", "rep").alias("label"))

    apart = placed(pairs).groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b")
    crowded_pairs = settle(pairs.join(settle(apart, "apart").select("bucket"), "bucket", "left_semi").select("bucket", "rep"), "open")
    crowd = settle(sets.join(crowded_pairs.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "crowd")
    own = (
        crowd.select("id", F.explode("shingles").alias("shingle"))
        .groupBy("shingle").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep = last")
        .groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
    )
    facts = settle(known.join(parities(crowd).withColumnRenamed("id", "rep"), "rep").join(own, "rep", "left").select(
        "rep", "n", "bits", "odd", "buckets", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common")), "facts")
    crowded_pairs = settle(crowded_pairs.join(facts.select("rep", "common"), "rep"), "open")
    far = facts.select(F.col("rep").alias("centre"), F.struct("n", "bits", "odd", "common").alias("c"))
    while True:
        members = settle(placed(crowded_pairs, "common"), "placed")
        largest = (
            members.groupBy("bucket", "label").agg(
                F.count(F.lit(1)).alias("size"), F.max(F.struct("common", (-F.col("rep")).alias("rep"))).alias("hub"))
            .groupBy("bucket").agg(F.max(F.struct("size", "label", "hub")).alias("top"), F.count(F.lit(1)).alias("classes"))
            .filter("classes > 1").select("bucket", F.col("top.label").alias("largest"), (-F.col("top.hub.rep")).alias("centre"))
        )
        members = members.join(largest, "bucket")
        star = members.filter("label <> largest").select("centre", "rep").distinct().join(facts, "rep").join(far, "centre").filter(
            alike("", "c.", percent) & near_enough("", "c.", percent)).select(F.col("centre").alias("a"), F.col("rep").alias("b"))
        edges = settle(confirmed(star, sets, percent), "edges")
        if edges.isEmpty():
            break
        names = relabelled(names, edges)

    open_ = settle(members.select("bucket", "rep", "label", "largest"), "open")
    tasks = open_.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("tasks"))
    traits = ("rep", "n", "bits", "odd", "common", "buckets", "label")
    rich = open_.join(tasks, "bucket").join(facts.drop("label"), "rep")
    outside = rich.filter("label <> largest").select(
        "bucket", F.pmod(F.xxhash64("rep"), "tasks").cast("int").alias("task"), F.struct(*traits).alias("m"))
    others = rich.select("bucket", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), *traits, "largest")
    rest = (
        outside.join(others, ["bucket", "task"])
        .filter((F.col("m.label") != F.col("label")) & alike("", "m.", percent))
        # Both outside: one direction is enough.
        .filter((F.col("label") == F.col("largest")) | (F.col("m.rep") < F.col("rep")))
        # Of the buckets that two documents share, the first one forms the pair; all of them are open.
        .filter(near_enough("", "m.", percent) & (F.array_min(F.array_intersect("buckets", "m.buckets")) == F.col("bucket")))
        .select(F.least("m.rep", "rep").alias("a"), F.greatest("m.rep", "rep").alias("b"))
    )
    names = relabelled(names, confirmed(rest, sets, percent))
    found = classes.select("set1", "set2", "rep").join(names.toDF("rep", "label"), "rep", "left").select(
        "set1", "set2", F.coalesce("label", "rep").alias("label"))
    linked = full.select("id", "n_shingles", "set1", "set2").join(found, ["set1", "set2"]).select(
        "id", "n_shingles", F.col("label").alias("component_id"))
    alone = table.filter("n_shingles = 0 OR id IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").alias(key), "n_shingles", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
