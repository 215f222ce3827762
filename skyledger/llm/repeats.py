"""Windows that repeat between documents, found block by block.

Both removers of repeated passages share this search. A *window* is a fixed number of consecutive symbols
(words or bytes) of one document. The k-gram with the least hash in a window, leftmost on ties, is its *seed*, so
equal windows have equal seeds; consecutive windows with the same seed at the same place form a *run*.

1. Documents are dealt into blocks of bounded size by their id. Each block reports its distinct seeds once.
2. Seeds seen more than once in all go back to the blocks that have them.
3. Each block indexes its runs with such seeds: equal runs once, with their first place and last place. A seed with
   very many runs is indexed window by window instead, so that no group of rows grows with the corpus.
4. Per group of seeds, ``resolve`` finds where each window starts first. A task gets its seeds in order and resolves
   whole seeds by about ``RESOLVED`` bytes, so its memory follows the largest seed and not its share of the index.
5. Those references go back to the blocks, which hold the texts.

What is shuffled for one block never has more than one row per distinct seed or run, whatever the number of copies.
The texts are shuffled once; all steps read that one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from skyledger.llm.texts import (
    BYTES, SPACED, WORDS, Slice, Words, _Powers, give_back, mix, slices, sliding_min, tidy, window_hash, words,
)

BLOCK = "__block"
RESOLVED = 4 << 20
INDEX = (
    "part long, single boolean, content long, seed long, block long, doc long, pos long, last_doc long, last_pos long,"
    " body binary"
)
REFS = "block long, single boolean, content long, seed long, at int, n int, ref_doc long, ref_pos long"


@dataclass(frozen=True)
class Search:
    """Size of windows and seeds in symbols, and whether places in one document count as well."""

    unit: str
    window: int
    seed: int
    within: bool
    block_bytes: int = 8 << 20
    heavy: int = 4_000

    @property
    def powers(self) -> _Powers:
        return WORDS if self.unit == "word" else BYTES

    def symbols(self, part: Slice) -> "Symbols":
        if self.unit == "byte":
            return Symbols(part, None, part.data.astype(np.uint64) + np.uint64(1), part.bounds)
        found = words(part.data, part.bounds, SPACED)
        return Symbols(part, found, found.hashes(part.data), found.doc)


@dataclass
class Symbols:
    part: Slice
    words: Words | None
    values: np.ndarray
    limits: np.ndarray


@dataclass
class Runs:
    """Consecutive windows with one seed place: first window, number, seed, document within the slice."""

    start: np.ndarray
    count: np.ndarray
    seed: np.ndarray
    doc: np.ndarray

    def take(self, keep: np.ndarray) -> "Runs":
        return Runs(self.start[keep], self.count[keep], self.seed[keep], self.doc[keep])

    def windows(self) -> "Runs":
        """The same windows, each as a run of its own."""
        n = len(self.start)
        row = np.repeat(np.arange(n), self.count)
        return Runs(spread(self.start, self.count), np.ones(len(row), np.int64), self.seed[row], self.doc[row])


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every pair, one after the other."""
    total = int(count.sum())
    offset = np.repeat(start - (np.cumsum(count) - count), count)
    return offset + np.arange(total)


def runs_of(s: Symbols, how: Search) -> Runs:
    size = np.diff(s.limits)
    doc = np.repeat(np.arange(len(size)), np.maximum(size - how.window + 1, 0))
    start = spread(s.limits[:-1], np.maximum(size - how.window + 1, 0))
    if not len(start):
        return Runs(start, start, start, start)
    grams = window_hash(s.values, how.seed, how.powers)
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(order, how.window - how.seed + 1)[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return Runs(start[fresh], np.diff(np.append(fresh, len(start))), grams[at[fresh]].view(np.int64), doc[fresh])


def contents(s: Symbols, runs: Runs, how: Search) -> np.ndarray:
    """Hash of the symbols that a run's windows span, and of their number."""
    up, down = how.powers.get(len(s.values) + 1)
    total = np.zeros(len(s.values) + 1, np.uint64)
    np.cumsum(s.values * up[: len(s.values)], out=total[1:])
    span = (total[runs.start + runs.count + how.window - 1] - total[runs.start]) * down[runs.start]
    return mix(mix(span) + runs.count.astype(np.uint64)).view(np.int64)


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Place of each value in an ascending array, -1 where it is absent."""
    if not len(ordered):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at, -1)


def texts_and_ids(table: pa.Table, text: str, key: str) -> tuple[pa.Array, np.ndarray]:
    """Texts and ids of a block; a row without an id takes no part and counts as empty."""
    ids = table[key].combine_chunks()
    body = table[text].combine_chunks()
    if ids.null_count:
        body = pc.if_else(ids.is_valid(), body, pa.scalar(None, body.type))
        ids = ids.fill_null(0)
    return body, ids.cast(pa.int64()).to_numpy(zero_copy_only=False)


def blocked(docs: DataFrame, text: str, key: str, how: Search) -> tuple[DataFrame, str]:
    """Documents with the number of their block, and that column's name; the blocks follow the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    name = BLOCK
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.pmod(F.xxhash64(key), F.lit(max(1, math.ceil(total / how.block_bytes))))), name


def seeds(docs: DataFrame, by: str, text: str, key: str, how: Search) -> DataFrame:
    """(seed, block, n): every distinct seed of a block with its number of runs, or of documents."""

    def one(name: tuple, table: pa.Table) -> pa.Table:
        body, ids = texts_and_ids(table, text, key)
        found = [np.zeros(0, np.int64)]
        for part in slices(body):
            runs = runs_of(how.symbols(part), how)
            if how.within:
                found.append(runs.seed)
            else:
                order = np.lexsort((runs.doc, runs.seed))
                seed, doc = runs.seed[order], runs.doc[order]
                found.append(seed[np.append(True, (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1]))[: len(seed)]])
        value, n = np.unique(np.concatenate(found), return_counts=True)
        give_back()
        return pa.table({"seed": value, "block": np.full(len(value), name[0].as_py()), "n": n})

    return docs.groupBy(by).applyInArrow(one, "seed long, block long, n long")


def shared_seeds(found: DataFrame, how: Search) -> DataFrame:
    """Seeds that occur twice or more, once for each block that has them. A seed has one row per block at most."""
    every = Window.partitionBy("seed")
    return (
        found.withColumn("total", F.sum("n").over(every)).filter("total > 1")
        .select("seed", "block", (F.col("total") > how.heavy).alias("heavy"))
    )


def index(docs: DataFrame, by: str, shared: DataFrame, text: str, key: str, how: Search) -> DataFrame:
    """The index of each block: its distinct runs with shared seeds, with first and last place and their content."""

    def one(name: tuple, table: pa.Table, wanted: pa.Table) -> pa.Table:
        body, ids = texts_and_ids(table, text, key)
        seed, heavy = wanted["seed"].to_numpy(), wanted["heavy"].to_numpy()
        order = np.argsort(seed)
        seed, heavy = seed[order], heavy[order]
        kept: list[tuple] = []
        cols: list[list[np.ndarray]] = [[] for _ in range(8)]
        for part in slices(body) if len(seed) else ():
            s = how.symbols(part)
            runs = runs_of(s, how)
            at = member(runs.seed, seed)
            runs, at = runs.take(at >= 0), at[at >= 0]
            for single in (False, True):
                some = runs.take(heavy[at] == single)
                if single:
                    some = some.windows()
                if not len(some.start):
                    continue
                mark = contents(s, some, how)
                for c, v in zip(cols, (
                    mark, ids[part.first : part.last][some.doc], some.start - s.limits[some.doc],
                    mark if single else some.seed, np.full(len(mark), single), some.start, some.count,
                    some.seed if single else np.zeros(len(mark), np.int64),  # runs have their seed in ``part``
                )):
                    c.append(v)
                kept.append((s, len(mark)))
        if not kept:
            return pa.table({f.name: pa.array([], f.type) for f in INDEX_ARROW}, INDEX_ARROW)
        mark, doc, pos, part_key, single, start, count, own_seed = (np.concatenate(c) for c in cols)
        owner = np.repeat(np.arange(len(kept)), [n for _, n in kept])
        order = np.lexsort((pos, doc, mark))
        head = np.flatnonzero(np.append(True, mark[order][1:] != mark[order][:-1]))
        tail = order[np.append(head[1:], len(order)) - 1]
        head = order[head]
        turn = np.argsort(owner[head], kind="stable")
        head, tail = head[turn], tail[turn]
        bodies = []
        for k in np.unique(owner[head]):
            mine = head[owner[head] == k]
            bodies.append(body_of(kept[k][0], start[mine], count[mine], how))
        return pa.table({
            "part": part_key[head], "single": single[head], "content": mark[head], "seed": own_seed[head],
            "block": np.full(len(head), name[0].as_py()), "doc": doc[head], "pos": pos[head],
            "last_doc": doc[tail], "last_pos": pos[tail], "body": pa.chunked_array(bodies, pa.binary()),
        }).cast(INDEX_ARROW)

    return docs.groupBy(by).cogroup(shared.groupBy("block")).applyInArrow(one, INDEX)


INDEX_ARROW = pa.schema([
    ("part", pa.int64()), ("single", pa.bool_()), ("content", pa.int64()), ("seed", pa.int64()), ("block", pa.int64()),
    ("doc", pa.int64()), ("pos", pa.int64()), ("last_doc", pa.int64()), ("last_pos", pa.int64()), ("body", pa.binary()),
])
REFS_ARROW = pa.schema([
    ("block", pa.int64()), ("single", pa.bool_()), ("content", pa.int64()), ("seed", pa.int64()), ("at", pa.int32()),
    ("n", pa.int32()), ("ref_doc", pa.int64()), ("ref_pos", pa.int64()),
])


def body_of(s: Symbols, start: np.ndarray, count: np.ndarray, how: Search) -> pa.Array:
    """What ``resolve`` compares: the bytes that a run spans, or the hashes of its windows of words."""
    if how.unit == "byte":
        width = count + how.window - 1
        flat = s.part.data[spread(start, width)]
    else:
        width = count * 8
        flat = window_hash(s.values, how.window, how.powers)[spread(start, count)]
    ends = np.zeros(len(start) + 1, np.int32)
    np.cumsum(width, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])


@dataclass
class Entries:
    """The index entries of some seeds, as arrays."""

    table: pa.Table
    doc: np.ndarray
    pos: np.ndarray
    ends: np.ndarray
    flat: np.ndarray


def entries(batches: Iterator[pa.RecordBatch]) -> Entries | None:
    table = pa.Table.from_batches(list(batches), INDEX_ARROW) if (batches := list(batches)) else None
    if table is None or not len(table):
        return None
    body = table["body"].cast(pa.large_binary()).combine_chunks()
    ends = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
    flat = np.frombuffer(body.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return Entries(table, table["doc"].to_numpy(), table["pos"].to_numpy(), ends - ends[0], flat)


def by_part(resolve: Callable, limit: int = RESOLVED) -> Callable:
    """``resolve`` over entries in ascending order of ``part``, whole parts by about ``limit`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += batch.nbytes
            if size < limit:
                continue
            part = batch["part"].to_numpy()
            cut = int(np.searchsorted(part, part[-1]))
            if not cut and (len(held) == 1 or held[-2]["part"][-1].as_py() == part[-1]):
                continue
            held[-1] = batch.slice(0, cut)
            yield from resolve(iter(held))
            held = [batch.slice(cut)]
            size = held[0].nbytes
        if held:
            yield from resolve(iter(held))

    return run


def references(e: Entries, row: np.ndarray, at: np.ndarray, ref_doc: np.ndarray, ref_pos: np.ndarray) -> pa.Table:
    """Per window (entry ``row``, window ``at`` of it) the first place; neighbours with neighbouring places join."""
    last_doc, last_pos = e.table["last_doc"].to_numpy()[row], e.table["last_pos"].to_numpy()[row] + at
    useful = (ref_doc < last_doc) | ((ref_doc == last_doc) & (ref_pos < last_pos))
    row, at, ref_doc, ref_pos = row[useful], at[useful], ref_doc[useful], ref_pos[useful]
    if not len(row):
        return pa.table({f.name: pa.array([], f.type) for f in REFS_ARROW}, REFS_ARROW)
    fresh = np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (ref_doc[1:] != ref_doc[:-1])
                      | (ref_pos[1:] != ref_pos[:-1] + 1))
    head = np.flatnonzero(fresh)
    take = row[head]
    return pa.table({
        "block": e.table["block"].to_numpy()[take], "single": e.table["single"].to_numpy()[take],
        "content": e.table["content"].to_numpy()[take], "seed": e.table["seed"].to_numpy()[take], "at": at[head].astype(np.int32),
        "n": np.diff(np.append(head, len(row))).astype(np.int32), "ref_doc": ref_doc[head], "ref_pos": ref_pos[head],
    }).cast(REFS_ARROW)


def search(
    docs: DataFrame, text: str, key: str, how: Search,
    resolve: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    finish: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
) -> DataFrame:
    """``finish`` gets each block's documents and the references of its runs; its rows are the result."""
    dealt, by = blocked(docs, text, key, how)
    shared = shared_seeds(seeds(dealt, by, text, key, how), how)
    entered = index(dealt, by, shared, text, key, how).repartition("part").sortWithinPartitions("part")
    refs = entered.mapInArrow(tidy(by_part(resolve)), REFS)

    def one(table: pa.Table, found: pa.Table) -> pa.Table:
        out = finish(table.drop_columns([by]), found)
        give_back()
        return out

    return dealt.groupBy(by).cogroup(refs.groupBy("block")).applyInArrow(one, schema)


@dataclass
class Matches:
    """Windows of a slice with an earlier place: first window, number, document, that place."""

    start: np.ndarray
    n: np.ndarray
    doc: np.ndarray
    ref_doc: np.ndarray
    ref_pos: np.ndarray


class Lookup:
    """The references of one block."""

    def __init__(self, refs: pa.Table, how: Search):
        self.how = how
        single = refs["single"].to_numpy()
        #: Seeds whose windows stand for themselves.
        self.heavy = np.unique(refs["seed"].to_numpy()[single])
        self.kinds = []
        for kind in (False, True):
            some = refs.filter(pa.array(single == kind)).sort_by([("content", "ascending"), ("at", "ascending")])
            self.kinds.append({c: some[c].to_numpy() for c in ("content", "at", "n", "ref_doc", "ref_pos")})

    def matches(self, s: Symbols, ids: np.ndarray) -> Matches:
        """``ids``: of the slice's documents. Ordered by window."""
        found = [np.zeros((0, 5), np.int64)]
        runs = runs_of(s, self.how) if any(len(k["content"]) for k in self.kinds) else None
        for refs, single in zip(self.kinds, (False, True)):
            if not len(refs["content"]):
                continue
            some = runs.take(member(runs.seed, self.heavy) >= 0).windows() if single else runs
            mark = contents(s, some, self.how)
            lo, hi = (np.searchsorted(refs["content"], mark, side) for side in ("left", "right"))
            hit = np.flatnonzero(hi > lo)
            row, ref = np.repeat(hit, (hi - lo)[hit]), spread(lo[hit], (hi - lo)[hit])
            start = some.start[row] + refs["at"][ref]
            doc = some.doc[row]
            source, place = refs["ref_doc"][ref], refs["ref_pos"][ref]
            earlier = source < ids[doc]
            if self.how.within:
                earlier |= (source == ids[doc]) & (place < start - s.limits[doc])
            found.append(np.stack([start, refs["n"][ref], doc, source, place], 1)[earlier])
        every = np.concatenate(found)
        every = every[np.argsort(every[:, 0], kind="stable")]
        return Matches(*every.T)
