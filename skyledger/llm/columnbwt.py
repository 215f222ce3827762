"""Suffix-array deduplication of bytes by column-wise construction over a collection of strings.

Candidate passages are cut into short strings that all lie around one seed (``repeats``); strings with one seed meet
in one partition. There a collection is sorted column by column: round j inserts the suffix of length j of every
string into the ordered list of all suffixes so far. Where it goes follows from the collection's Burrows-Wheeler
transform alone: a suffix c·s stands among those that begin with c as s stands among the suffixes preceded by c. The
common prefix with its new neighbours is one more than the least common prefix between the places of their tails.
In the end all suffixes that share their first ``window`` bytes are neighbours.

Strings are bounded by twice the window and collections by the number of strings of one seed, so the sequential
segments stay in memory; nothing is written to an executor's own disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from skyledger.llm.lzfactor import result_schema
from skyledger.llm.repeats import Lookup, Matches, Search, entries, references, search, spread, texts_and_ids
from skyledger.llm.texts import BYTES, cover, hash_rows, pieces, slices, window_hash

RESULT = "n_bytes long, n_removed long, n_spans long, kept binary"
COLLECTION = 1024


def collection_suffixes(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, length, common prefix with the one before) of all suffixes of a collection, in order.

    String i is ``flat[ends[i]:ends[i + 1]]``, of UTF-8 text and under 256 bytes. Equal suffixes stand in the order
    of their strings.
    """
    size = np.diff(ends)
    strings = len(size)
    # The list starts with the empty suffix of every string; a suffix is named by its string times 256 plus its length.
    name = np.arange(strings, dtype=np.int32) * 256
    common = np.zeros(strings, np.uint8)
    # A symbol is the byte before a suffix plus one, as UTF-8 has no byte 255; 0 stands before a whole string.
    symbol = np.zeros(strings, np.uint8)
    symbol[size > 0] = flat[ends[1:][size > 0] - 1] + 1
    place = np.arange(strings)
    who = np.flatnonzero(size > 0)
    for j in range(1, int(size.max(initial=0)) + 1):
        by_symbol = np.argsort(symbol, kind="stable")
        closed = len(symbol) - np.count_nonzero(symbol)
        rank = np.empty(len(symbol), np.int32)
        rank[by_symbol] = np.arange(len(symbol), dtype=np.int32)
        k = rank[place[who]].astype(np.int64)
        order = np.argsort(k)
        k, who = k[order], who[order]
        before, behind = (_common(symbol, common, by_symbol, k, step) for step in (0, 1))
        # The list without the empty suffixes is what the symbols sort to, so its places are ranks past the closed.
        spot = strings + k - closed
        old = np.ones(len(symbol) + len(who), bool)
        old[spot] = False
        more = size[who] > j
        fresh = np.zeros(len(who), np.uint8)
        fresh[more] = flat[ends[1:][who[more]] - j - 1] + 1
        name = _merged(name, old, spot, who * 256 + j)
        common = _merged(common, old, spot, before)
        symbol = _merged(symbol, old, spot, fresh)
        inside = spot + 1 < len(common)
        common[spot[inside] + 1] = behind[inside]
        place[who] = spot
        who = who[more]
    return name >> 8, name & 255, common


def _merged(values: np.ndarray, old: np.ndarray, spot: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = np.empty(len(old), values.dtype)
    out[old] = values
    out[spot] = new
    return out


def _common(symbol, common, by_symbol, k, step) -> np.ndarray:
    """Common prefix of the suffix of rank k with its neighbour before (step 0) or behind (step 1) in the new list."""
    high = k + step
    low = high - 1
    valid = (low >= 0) & (high < len(by_symbol))
    out = np.zeros(len(k), np.uint8)
    a, b = by_symbol[low[valid]], by_symbol[high[valid]]
    same = symbol[a] == symbol[b]
    a, b = a[same], b[same]
    if len(a):
        width = b - a
        least = np.minimum.reduceat(common[spread(a + 1, width)], np.cumsum(width) - width)
        out[np.flatnonzero(valid)[same]] = least + 1
    return out


def first_strings(window: int, seed: int):
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First place of every window of bytes."""
        e = entries(batches)
        if e is None:
            return
        content, part = e.table["content"].to_numpy(), e.table["part"].to_numpy()
        order = np.lexsort((e.pos, e.doc, content, part))
        head = np.flatnonzero(np.append(True, content[order][1:] != content[order][:-1]))
        kind = np.empty(len(order), np.int64)  # the class of equal strings of each entry
        kind[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
        first = order[head]
        width = np.diff(e.ends)[first]
        count = np.maximum(width - window + 1, 0)
        base = np.cumsum(count) - count
        doc, pos = np.repeat(e.doc[first], count), spread(e.pos[first], count)
        several = part[first]
        edges = np.flatnonzero(np.append(True, several[1:] != several[:-1]))
        groups = np.diff(np.append(edges, len(several)))
        todo = np.flatnonzero(np.repeat(groups > 1, groups))
        todo = todo[_akin(e.flat, e.ends[:-1][first[todo]], width[todo], several[todo], window, seed)]
        for some in _collections(todo, several):
            flat = e.flat[spread(e.ends[:-1][first[some]], width[some])]
            owner, length, common = collection_suffixes(flat, np.append(0, np.cumsum(width[some])))
            long = length >= window
            group = np.cumsum(common < window)[long]
            own = some[owner[long]]
            spot = base[own] + width[own] - length[long]
            by = np.lexsort((pos[spot], doc[spot], group))
            head2 = np.flatnonzero(np.append(True, group[by][1:] != group[by][:-1]))
            source = np.repeat(spot[by][head2], np.diff(np.append(head2, len(by))))
            doc[spot[by]], pos[spot[by]] = doc[source], pos[source]
        per = count[kind]
        row = np.repeat(np.arange(len(kind)), per)
        at = spread(np.zeros(len(kind), np.int64), per)
        where = base[kind][row] + at
        yield from references(e, row, at, doc[where], pos[where]).to_batches()

    return resolve


def _akin(flat: np.ndarray, start: np.ndarray, width: np.ndarray, part: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Strings that can share a window with another string of their seed.

    A window reaches half of what it holds beside its seed to the left of the seed, or to the right. Strings that
    differ from all others of their seed on both of these stretches share no window with them.
    """
    half = (window - seed + 1) // 2
    row = np.repeat(np.arange(len(start)), width - seed + 1)
    local = spread(np.zeros(len(start), np.int64), width - seed + 1)
    grams = window_hash(flat[spread(start, width)].astype(np.uint64) + np.uint64(1), seed, BYTES)
    base = np.cumsum(width) - width
    is_seed = grams[base[row] + local].view(np.int64) == part[row]
    # The first place from which a window still fits; a string holds its seed at least once.
    at = np.full(len(start), -1)
    hit = np.flatnonzero(is_seed)[::-1]
    at[row[hit]] = local[hit]
    twice = np.bincount(row[hit], minlength=len(start)) != 1
    keep = twice.copy()
    for shift in (-half, 0):
        lo = at + shift
        inside = (lo >= 0) & (lo + half + seed <= width) & ~twice
        some = np.flatnonzero(inside)
        if not len(some):
            continue
        size = np.full(len(some), half + seed)
        body = flat[spread(start[some] + lo[some], size)].reshape(len(some), half + seed)
        mark = hash_rows(body) ^ part[some].view(np.uint64)
        _, inverse, count = np.unique(mark, return_inverse=True, return_counts=True)
        keep[some[count[inverse] > 1]] = True
    # A seed with a string that holds it twice keeps all its strings.
    return keep | np.isin(part, part[twice])


def _collections(todo: np.ndarray, part: np.ndarray) -> Iterator[np.ndarray]:
    """Strings in turn, whole seeds together."""
    begin = 0
    while begin < len(todo):
        end = min(begin + COLLECTION, len(todo))
        end = int(np.searchsorted(part[todo], part[todo[end - 1]], "right"))
        yield todo[begin:end]
        begin = end


def remove_repeated_bytes(
    docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = 100, seed: int = 24,
) -> DataFrame:
    """Remove every byte covered by a string of ``window`` bytes that also starts earlier.

    Earlier is a smaller id, or a smaller place in the same document; overlaps count. Returns the documents'
    columns without the text, and ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept``, the
    remaining bytes, which need not be valid UTF-8.

    Null text: no bytes. Rows with one id and the same place do not shorten each other. A row without an id is kept
    whole and is no source. An empty table gives an empty result. A column with a result's name is replaced.
    """
    how = Search("byte", window, seed, within=True)
    schema = result_schema(docs, text, RESULT)

    def finish(table: pa.Table, refs: pa.Table) -> pa.Table:
        _, ids = texts_and_ids(table, text, key)
        nameless = pc.is_null(table[key]).to_numpy()
        look = Lookup(refs, how)
        n_bytes, n_removed, n_spans = ([np.zeros(0, np.int64)] for _ in range(3))
        bodies = []
        for part in slices(table[text]):
            s = how.symbols(part)
            m = look.matches(s, ids[part.first : part.last])
            if nameless.any():
                named = ~nameless[part.first : part.last][m.doc]
                m = Matches(*(x[named] for x in (m.start, m.n, m.doc, m.ref_doc, m.ref_pos)))
            gone = cover(len(s.values), m.start, m.n + window - 1)
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            edge = s.limits[:-1][s.limits[:-1] < len(gone)]
            head[edge] = gone[edge]
            n_bytes.append(np.diff(s.limits))
            n_removed.append(pieces(s.limits, gone))
            n_spans.append(pieces(s.limits, head))
            left = np.append(0, np.cumsum(n_bytes[-1] - n_removed[-1])).astype(np.int32)
            body = part.data[~gone] if gone.any() else part.data
            bodies.append(pa.Array.from_buffers(
                pa.binary(), len(left) - 1, [None, pa.py_buffer(left), pa.py_buffer(body.tobytes())]))
        new = {
            "n_bytes": pa.array(np.concatenate(n_bytes)), "n_removed": pa.array(np.concatenate(n_removed)),
            "n_spans": pa.array(np.concatenate(n_spans)),
            "kept": pa.chunked_array(bodies, pa.binary()),
        }
        return pa.table([new[f.name] if f.name in new else table[f.name] for f in schema], names=schema.names)

    return search(docs, text, key, how, first_strings(window, seed), finish, schema)
