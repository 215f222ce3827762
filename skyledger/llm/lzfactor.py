"""Substring deduplication by relative Lempel-Ziv parsing of documents against indexed reference blocks.

The corpus is its own reference, in blocks. Every block indexes the windows of words that other documents share
(``repeats.index``); the entries of one window from all blocks meet, and the first place of each window, the smallest
(document, position), is what a parse may copy from. A document is then factored greedily from left to right: a
factor copies as far as the windows that follow have their first place next to each other, the next factor begins where
it ends. Windows over the boundary of two factors are looked up as well, so a factor may go on behind the one before it
with fewer than ``window`` words of its own, and a passage that is pieced together from two sources is found whole. The
words of the factors are the duplicate spans, and they are what is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from skyledger.llm.repeats import (
    Lookup, Matches, Search, Symbols, entries, references, search, spread, texts_and_ids,
)
from skyledger.llm.texts import cover, pieces, slices

RESULT = "n_words long, n_removed long, kept string, factors array<struct<start:long,length:long,ref_doc:long,ref_start:long>>"


def result_schema(docs: DataFrame, text: str, result: str) -> StructType:
    """Columns of the documents without the text, then the results; a result replaces a column of its name."""
    new = StructType.fromDDL(result)
    return StructType([f for f in docs.schema if f.name != text and f.name not in new.names] + new.fields)


def first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First place of every window of words; equal windows have equal seeds and so meet in one partition."""
    e = entries(batches)
    if e is None:
        return
    count = np.diff(e.ends) // 8
    window = e.flat.view(np.uint64)
    row = np.repeat(np.arange(len(count)), count)
    at = spread(np.zeros(len(count), np.int64), count)
    doc, pos = e.doc[row], e.pos[row] + at
    order = np.lexsort((pos, doc, window))
    head = np.flatnonzero(np.append(True, window[order][1:] != window[order][:-1]))
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(order[head], np.diff(np.append(head, len(order))))
    yield from references(e, row, at, doc[first], pos[first]).to_batches()


def greedy_factors(m: Matches, window: int) -> np.ndarray:
    """Rows (start, length, document, source, source start), left to right, not overlapping."""
    if not len(m.start):
        return np.zeros((0, 5), np.int64)
    fresh = np.append(True, (m.start[1:] != (m.start + m.n)[:-1]) | (m.doc[1:] != m.doc[:-1])
                      | (m.ref_doc[1:] != m.ref_doc[:-1]) | (m.ref_pos[1:] != (m.ref_pos + m.n)[:-1]))
    head = np.flatnonzero(fresh)
    start, doc = m.start[head], m.doc[head]
    end = (m.start + m.n)[np.append(head[1:], len(m.start)) - 1] + window - 1
    begin = start.copy()
    same = doc[1:] == doc[:-1]
    begin[1:][same] = np.maximum(start[1:], end[:-1])[same]
    out = np.stack([begin, end - begin, doc, m.ref_doc[head], m.ref_pos[head] + begin - start], 1)
    return out[out[:, 1] > 0]


def joined(s: Symbols, keep: np.ndarray) -> pa.Array:
    """The kept words of each document with one blank between them."""
    start, end = s.words.start[keep], s.words.end[keep]
    width = end - start + 1
    flat = np.append(s.part.data, np.uint8(32))[spread(start, width)]
    stop = np.cumsum(width)
    flat[stop - 1] = 32
    before = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    limit = np.append(0, stop)[before[s.limits]]
    full = limit[1:] > limit[:-1]
    flat = np.delete(flat, limit[1:][full] - 1)
    ends = np.append(0, np.cumsum(np.diff(limit) - full)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(full), [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])


def remove_shared_passages(
    docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = 13, seed: int = 5, untouched: bool = False,
) -> DataFrame:
    """Remove every word covered by a window of words that also starts in a document with a smaller id.

    Returns the documents' columns without the text, and ``n_words``, ``n_removed``, ``kept`` (the kept words with
    one blank between them; with ``untouched`` the text itself where nothing is removed) and ``factors``, the
    copied factors (first word, words, source document, first word there).

    Null text: no words, ``kept`` empty (null with ``untouched``). A text shorter than a window loses nothing.
    Rows with one id count as one document and do not shorten each other. A row without an id is kept whole and
    is no source. An empty table gives an empty result. A column with a result's name is replaced.
    """
    how = Search("word", window, seed, within=False)
    schema = result_schema(docs, text, RESULT)

    def finish(table: pa.Table, refs: pa.Table) -> pa.Table:
        body, ids = texts_and_ids(table, text, key)
        nameless = pc.is_null(table[key]).to_numpy()
        look = Lookup(refs, how)
        n_words, n_removed, kept, found, found_in = [], [], [], [], []
        original = table[text].combine_chunks()
        for part in slices(original):
            s = how.symbols(part)
            m = look.matches(s, ids[part.first : part.last])
            if nameless.any():
                named = ~nameless[part.first : part.last][m.doc]
                m = Matches(*(x[named] for x in (m.start, m.n, m.doc, m.ref_doc, m.ref_pos)))
            f = greedy_factors(m, window)
            gone = cover(len(s.values), f[:, 0], f[:, 1])
            n_words.append(np.diff(s.limits))
            n_removed.append(pieces(s.limits, gone))
            kept.append(joined(s, ~gone))
            f[:, 0] -= s.limits[f[:, 2]]
            f[:, 2] += part.first
            found.append(f)
        n = len(table)
        factors = np.concatenate([np.zeros((0, 5), np.int64), *found])
        ends = np.searchsorted(factors[:, 2], np.arange(n + 1)).astype(np.int32)
        spans = pa.StructArray.from_arrays(
            [pa.array(factors[:, c]) for c in (0, 1, 3, 4)], ["start", "length", "ref_doc", "ref_start"]
        )
        removed = np.concatenate([np.zeros(0, np.int64), *n_removed])
        texts = pa.chunked_array(kept, pa.large_string()).combine_chunks().cast(pa.string())
        if untouched:
            texts = pc.if_else(pa.array(removed > 0), texts, original)
        new = {
            "n_words": pa.array(np.concatenate([np.zeros(0, np.int64), *n_words])), "n_removed": pa.array(removed),
            "kept": texts, "factors": pa.ListArray.from_arrays(pa.array(ends), spans),
        }
        return pa.table([new[f.name] if f.name in new else table[f.name] for f in schema], names=schema.names)

    return search(docs, text, key, how, first_places, finish, schema)
