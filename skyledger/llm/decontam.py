"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, scanned over token windows.

Windows of a benchmark text are its runs of ``window`` words; a shorter text is one window of all its words. The
hashes of all windows are broadcast once their number is known to stay under ``limit``; a larger benchmark is cut into
blocks below it and the documents pass over the blocks in turn. Each document is read slice by slice: a rolling hash
proposes hits and the words themselves confirm them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from skyledger.llm.repeats import spread
from skyledger.llm.texts import ALNUM, LOWER, WORDS, cover, mix, pieces, slices, tidy, window_hash, words
from skyledger.operators.lineage import settle

RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>"


def benchmark_windows(benchmark: DataFrame, text: str, item: str, window: int) -> DataFrame:
    """(item, hash, words, content): the distinct windows of every benchmark text, normalised."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = table["item"].to_pylist()
            rows = []
            for part in slices(table["text"]):
                data = LOWER[part.data]
                found = words(data, part.bounds, ALNUM)
                values = found.hashes(data)
                for d in range(part.docs):
                    a, b = found.doc[d], found.doc[d + 1]
                    size = int(min(window, b - a))
                    for k in range(a, b - size + 1) if size else ():
                        mark = window_hash(values[k : k + size], size, WORDS)[0]
                        content = b" ".join(data[found.start[i] : found.end[i]].tobytes() for i in range(k, k + size))
                        rows.append((names[part.first + d], _keyed(mark, size), size, content))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.record_batch([
                pa.array(columns[0], pa.string()), pa.array([int(x) for x in columns[1]], pa.int64()),
                pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary()),
            ], names=["item", "mark", "size", "content"])

    source = benchmark.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    return source.mapInArrow(one, "item string, mark long, size int, content binary").distinct()


def _keyed(mark: np.ndarray | np.uint64, size: int):
    """A window's hash with its number of words, as a signed number."""
    return mix(np.atleast_1d(mark) + np.uint64(size)).view(np.int64) if np.ndim(mark) else mix(
        np.array([mark + np.uint64(size)], np.uint64)).view(np.int64)[0]


class Index:
    """Distinct window contents in order of their hash, each with the items that have it."""

    def __init__(self, rows: list):
        by: dict[tuple[int, bytes], list[str]] = {}
        for r in rows:
            by.setdefault((r["mark"], bytes(r["content"])), []).append(r["item"])
        self.sizes = sorted({r["size"] for r in rows})
        self.items: dict[int, list[tuple[bytes, list[str]]]] = {}
        for (mark, content), items in by.items():
            self.items.setdefault(mark, []).append((content, items))
        self.marks = np.array(sorted(self.items), np.int64)


def scan(docs: DataFrame, text: str, index: Index) -> DataFrame:
    """Add this index's hits to the results so far."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    before = {f.name for f in StructType.fromDDL(RESULT)} <= set(docs.columns)
    fields = [f for f in docs.schema if f.name not in StructType.fromDDL(RESULT).names]
    schema = StructType(fields + StructType.fromDDL(RESULT).fields)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            earlier = table["spans"].to_pylist() if before else [None] * len(table)
            had = table["items"].to_pylist() if before else [None] * len(table)
            n_words, n_hit, items, spans = [], [], [], []
            for part in slices(table[text]):
                data = LOWER[part.data]
                found = words(data, part.bounds, ALNUM)
                start, size, got = _hits(data, found, known)
                owner = np.searchsorted(found.doc, start, "right") - 1
                mine: dict[int, set[str]] = {}
                for d, names in zip(owner.tolist(), got):
                    mine.setdefault(d, set()).update(names)
                for d in range(part.docs):
                    if old := earlier[part.first + d]:
                        first = np.array([x["start"] for x in old]) + found.doc[d]
                        start = np.append(start, first)
                        size = np.append(size, np.array([x["stop"] for x in old]) + found.doc[d] - first)
                    if old := had[part.first + d]:
                        mine.setdefault(d, set()).update(old)
                hit = cover(len(found.start), start, size)
                n_words.append(np.diff(found.doc))
                n_hit.append(pieces(found.doc, hit))
                items += [sorted(mine.get(d, ())) for d in range(part.docs)]
                spans += _spans(hit, found.doc)
            new = {
                "n_words": pa.array(np.concatenate([np.zeros(0, np.int64), *n_words])),
                "n_hit": pa.array(np.concatenate([np.zeros(0, np.int64), *n_hit])),
                "items": pa.array(items, pa.list_(pa.string())),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            }
            out = pa.table([new[n] if n in new else table[n] for n in schema.names], names=schema.names)
            yield from out.to_batches()

    return docs.mapInArrow(tidy(one), schema)


def _hits(data: np.ndarray, found, known: Index) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Confirmed hits: first word, number of words, items."""
    starts, sizes, names = [], [], []
    values = found.hashes(data) if len(known.marks) else None
    for size in known.sizes:
        at = found.starts_of(size)
        if not len(at):
            continue
        mark = _keyed(window_hash(values, size, WORDS), size)[at]
        place = np.minimum(np.searchsorted(known.marks, mark), len(known.marks) - 1)
        for k in at[known.marks[place] == mark].tolist():
            content = b" ".join(data[found.start[i] : found.end[i]].tobytes() for i in range(k, k + size))
            key = int(_keyed(window_hash(values[k : k + size], size, WORDS), size)[0])
            for kept, items in known.items[key]:
                if kept == content:
                    starts.append(k)
                    sizes.append(size)
                    names.append(items)
    return np.array(starts, np.int64), np.array(sizes, np.int64), names


def _spans(hit: np.ndarray, limits: np.ndarray) -> list[list[dict]]:
    """Maximal runs of hit words per document, in words of the document."""
    out: list[list[dict]] = [[] for _ in range(len(limits) - 1)]
    cuts = np.zeros(len(hit) + 1, bool)
    cuts[limits] = True
    edge = hit.copy()
    edge[1:] &= ~hit[:-1] | cuts[1:-1]
    for a in np.flatnonzero(edge).tolist():
        d = int(np.searchsorted(limits, a, "right")) - 1
        rest = np.flatnonzero(~hit[a : limits[d + 1]])
        b = a + int(rest[0]) if len(rest) else int(limits[d + 1])
        out[d].append({"start": a - int(limits[d]), "stop": b - int(limits[d])})
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 13, share: int = 20,
    item: str = "item_id", item_text: str = "text", limit: int = 2_000_000, limit_bytes: int = 128 << 20,
) -> DataFrame:
    """All columns of the documents and ``n_words``, ``n_hit``, ``items`` (sorted strings), ``spans`` (runs of hit
    words, start and stop) and ``contaminated``: some word is hit, and one in ``share`` or more.

    Null and empty texts have no words and are clean; so is every document against an empty benchmark, or one whose
    texts are null. Items without an id are left out. Repeated rows and ties give the same result for each row. An
    input column with a result's name is replaced. ``limit`` and ``limit_bytes`` bound the windows that are broadcast at
    once, dealt into blocks by their hash, so that one long item spreads over blocks too.
    """
    results = [*StructType.fromDDL(RESULT).names, "contaminated"]
    docs = docs.drop(*[c for c in results if c in docs.columns])
    windows = settle(benchmark_windows(benchmark, item_text, item, window), "benchmark")
    size = windows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("content") + F.octet_length("item")).alias("bytes")).first()
    blocks = max(1, math.ceil(size["rows"] / limit), math.ceil((size["bytes"] or 0) / limit_bytes))
    for k in range(blocks):
        block = windows.filter(F.pmod(F.xxhash64("mark"), F.lit(blocks)) == k) if blocks > 1 else windows
        docs = scan(docs, text, Index(block.collect()))
        if k + 1 < blocks:
            docs = settle(docs, "scanned")
    return docs.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def without_contamination(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """Drop contaminated documents, or with ``remove="spans"`` cut their hit words out of the text.

    A cut goes from the first byte of its first word to the last byte of its last word. Columns stay as they are, also
    those that have the name of a result of ``find_contamination``.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: documents or spans, not {remove!r}")
    # Under names that no result has.
    names = {c: f"decontam_column_{i}" for i, c in enumerate(docs.columns) if c != text}
    found = find_contamination(docs.withColumnsRenamed(names), benchmark, text, **options)
    columns, names_out = [names.get(c, c) for c in docs.columns], docs.columns
    if remove == "documents":
        return found.filter(~F.col("contaminated")).select(*[F.col(n).alias(c) for n, c in zip(columns, docs.columns)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            spans, dirty = table["spans"].to_pylist(), table["contaminated"].to_numpy(zero_copy_only=False)
            bodies = []
            for part in slices(table[text]):
                parts = words(LOWER[part.data], part.bounds, ALNUM)
                keep = np.ones(len(part.data), bool)
                for d in np.flatnonzero(dirty[part.first : part.last]).tolist():
                    for s in spans[part.first + d]:
                        a, b = parts.doc[d] + s["start"], parts.doc[d] + s["stop"] - 1
                        keep[parts.start[a] : parts.end[b]] = False
                ends = np.append(0, np.cumsum(keep))[part.bounds].astype(np.int32)
                bodies.append(pa.Array.from_buffers(
                    pa.string(), part.docs, [None, pa.py_buffer(ends), pa.py_buffer(part.data[keep].tobytes())]))
            new = pa.chunked_array(bodies, pa.string()).combine_chunks()
            new = pc.if_else(pc.is_null(table[text].combine_chunks()), pa.scalar(None, pa.string()), new)
            out = pa.table([new if n == text else table[n] for n in columns], names=names_out)
            yield from out.to_batches()

    return found.mapInArrow(cut, docs.schema)
