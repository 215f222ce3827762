"""Token ids of whole texts by a public byte-level tokenizer, each distinct chunk of text encoded once.

The tokenizer's splitting pattern never joins a non-blank with a blank that follows it, so a text may be cut before
every run of blanks and the ids of its chunks stand one after the other. Chunks repeat a great deal; a worker keeps
their ids. A text with blanks outside ASCII, or with control characters that some patterns take for blanks, is
encoded whole instead; so is, if added tokens are wanted, a text that holds the text of one of the tokenizer's added
tokens, such as <|endoftext|>, as the tokenizer reads it by default. Chunks are told apart by a 64-bit hash and their length.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from skyledger.llm.levels import Levels
from skyledger.llm.repeats import spread
from skyledger.llm.texts import BLANKS, BYTES, Slice, mix, slices

#: A worker forgets its chunks beyond this number.
KEPT = 4_000_000
_known: dict[str, "Chunks"] = {}


class Chunks:
    """A tokenizer with the ids of the chunks it has seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # In a byte-level vocabulary a token has one character for each of its bytes.
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.clear()

    @classmethod
    def of(cls, path: str) -> "Chunks":
        if path not in _known:
            _known[path] = cls(path)
        return _known[path]

    def clear(self) -> None:
        self.known, self.ids, self.used = Levels(np.int64, np.int64), np.zeros(0, np.uint32), 0

    def keep(self, ids: np.ndarray) -> None:
        """Append to the ids, whose room grows by doubling."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32))
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, texts: list[bytes], added_tokens: bool = False) -> list[np.ndarray]:
        self.tokenizer.encode_special_tokens = not added_tokens
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def learn(self, marks: np.ndarray, chunks: list[bytes]) -> None:
        """Encode new chunks. Those that begin with a blank and end without one are encoded many in one text; as
        every token stands for a known number of bytes, the ids of each chunk can be told from their sum."""
        plain = np.array([c[0] in b" \t\n\v\f\r" and c[-1] not in b" \t\n\v\f\r" for c in chunks], bool)
        order = np.append(np.flatnonzero(plain), np.flatnonzero(~plain))
        rows = order[: plain.sum()].tolist()
        joined = [b"".join(chunks[i] for i in rows[a : a + 512]) for a in range(0, len(rows), 512)]
        ids = np.concatenate([np.zeros(0, np.uint32), *self.encode(joined)])
        stops = np.cumsum([len(chunks[i]) for i in rows])
        last = np.searchsorted(np.cumsum(self.width[ids]), stops) + 1
        single = self.encode([chunks[i] for i in order[len(rows) :].tolist()])
        count = np.append(np.diff(np.append(0, last)), [len(x) for x in single]).astype(np.int64)
        first = np.cumsum(count) - count + self.used
        self.keep(np.concatenate([ids, *single]))
        self.known.add(marks[order], first, count)


def _unusual(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Documents with blanks outside ASCII or separators among the control characters."""
    odd = (data >= 28) & (data <= 31)
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    second, third = (np.append(data, np.zeros(2, np.uint8))[lead + k] for k in (1, 2))
    first = data[lead]
    blank = ((first == 0xC2) & ((second == 0x85) | (second == 0xA0))) | ((first == 0xE1) & (second == 0x9A)) | (
        (first == 0xE3) & (second == 0x80) & (third == 0x80)) | (
        (first == 0xE2) & (((second == 0x80) & ((third <= 0x8F) | ((third >= 0xA8) & (third <= 0xAF))))
                           | ((second == 0x81) & (third == 0x9F))))
    odd[lead[blank]] = True
    return np.unique(np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1)


def _holding(data: np.ndarray, bounds: np.ndarray, tokens: list[bytes]) -> np.ndarray:
    """Documents that hold one of the tokens' texts; one that begins such a text and ends within it may be among them."""
    text, found = data.tobytes(), []
    for token in tokens:
        at = text.find(token)
        while at >= 0:
            found.append(at)
            at = text.find(token, at + 1)
    return np.unique(np.searchsorted(bounds, np.array(found, np.int64), "right") - 1)


def _slice_ids(known: Chunks, part: Slice, added_tokens: bool) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = part.data, part.bounds
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(part.docs + 1, np.int64)
    blank = BLANKS[data]
    cut = blank.copy()
    cut[1:] &= ~blank[:-1]
    cut[bounds[:-1][bounds[:-1] < len(data)]] = True
    start = np.flatnonzero(cut)
    stop = np.append(start[1:], len(data))
    _, down = BYTES.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * BYTES.up[: len(data)], out=total[1:])
    marks = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
    distinct, where, inverse = np.unique(marks, return_index=True, return_inverse=True)
    old, first, count = known.known.find(distinct)
    if not old.all():
        if len(known.known) > KEPT:
            known.clear()
            old[:] = False
        known.learn(distinct[~old], [data[start[i] : stop[i]].tobytes() for i in where[~old].tolist()])
        _, first, count = known.known.find(distinct)
    first, count = first[inverse], count[inverse]
    ids = known.ids[spread(first, count)]
    limits = np.append(0, np.cumsum(count))[np.searchsorted(start, bounds)]
    odd = _unusual(data, bounds)
    if added_tokens:
        odd = np.union1d(odd, _holding(data, bounds, known.added))
    if len(odd):
        whole = known.encode([data[bounds[d] : bounds[d + 1]].tobytes() for d in odd.tolist()], added_tokens)
        parts, sizes, last = [], np.diff(limits), 0
        for d, got in zip(odd.tolist(), whole):
            parts += [ids[limits[last] : limits[d]], got]
            sizes[d], last = len(got), d + 1
        ids = np.concatenate([*parts, ids[limits[last] :]])
        limits = np.append(0, np.cumsum(sizes))
    return ids, limits


def token_ids(column: pa.Array | pa.ChunkedArray, path: str, added_tokens: bool = False):
    """(first document, ids, limits per document) slice by slice; a null text has no ids. ``added_tokens``: the text of
    an added token is its id, as by default in the tokenizer, instead of ordinary pieces."""
    known = Chunks.of(path)
    for part in slices(column, 2 << 20):
        yield part.first, *_slice_ids(known, part, added_tokens)
