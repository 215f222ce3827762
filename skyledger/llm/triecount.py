"""Token counts of a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens.

A text's pre-tokens are its words between blanks, each with the word mark in front. New distinct pre-tokens are sorted;
neighbours' common prefixes give the trie: position d of a word is a node of its own exactly if it shares fewer than d
bytes with the word before. The best segmentation score of a prefix needs the scores of its shorter prefixes only, so
each node is scored once, level by level, however many words pass through it. A word's last node holds its number of
tokens; a document's count is the sum over its words. Words over ``LONG`` bytes go by segments, each scored once for
all words that share it (``longwords``). Scores are integers, so equal ones are equal however they add up. Nothing is
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyledger.llm.levels import Levels
from skyledger.llm.longwords import Walker
from skyledger.llm.texts import BYTES, SPACED, hash_rows, mix, slices, tidy, words

MARK = "▁".encode()
#: Longer words are scored by segments; a worker forgets its words beyond this number.
LONG, KEPT = 64, 2_000_000
#: Unit of the scores, and one below all sums of them.
UNIT, FAR = 1 << 24, -(1 << 60)
_vocabularies: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """Pieces with their log probabilities and the words counted so far.

    The file gives an order of pieces, and the score is Zipf's law of the rank, rounded to 1 / ``UNIT``. Any single byte
    is a piece of last resort below all others.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scored = {
            model.id_to_piece(i).encode(): -round(float(np.log1p(-model.get_score(i))) * UNIT)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and model.get_score(i) > -1e6
        }
        self.setup(scored)

    def setup(self, scored: dict[bytes, int]) -> None:
        self.scored = scored
        self.fallback = min(scored.values(), default=0) - 10 * UNIT
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(p) for p in scored}, reverse=True):
            some = [p for p in scored if len(p) == size]
            marks = hash_rows(np.frombuffer(b"".join(some), np.uint8).reshape(-1, size))
            order = np.argsort(marks)
            self.by_size[size] = marks[order], np.array([scored[p] for p in some])[order]
        self.walker = Walker(scored, self.fallback)
        self.clear()

    def clear(self) -> None:
        self.known = Levels(np.int64)

    @classmethod
    def of(cls, path: str) -> "Vocabulary":
        if path not in _vocabularies:
            _vocabularies[path] = cls(path)
        return _vocabularies[path]

    def count_words(self, found: list[bytes]) -> np.ndarray:
        """Number of tokens of each distinct word (with its mark)."""
        out = np.zeros(len(found), np.int64)
        size = np.array([len(w) for w in found], np.int64)
        long = np.flatnonzero(size > LONG)
        out[long] = self.walker.count([found[i] for i in long.tolist()])
        short = np.flatnonzero(size <= LONG)
        short = short[np.array(sorted(range(len(short)), key=lambda k: found[short[k]]), np.int64)] if len(short) else short
        for begin in range(0, len(short), 20_000):
            some = short[begin : begin + 20_000]
            out[some] = self._trie([found[i] for i in some.tolist()])
        return out

    def _trie(self, found: list[bytes]) -> np.ndarray:
        """Words in ascending order, all at once."""
        n, size = len(found), np.array([len(w) for w in found])
        deep = int(size.max())
        grid = np.zeros((n, deep), np.uint8)
        grid[np.arange(deep) < size[:, None]] = np.frombuffer(b"".join(found), np.uint8)
        differ = grid[1:] != grid[:-1]
        shared = np.append(0, np.where(differ.any(axis=1), differ.argmax(axis=1), deep))
        up, down = BYTES.get(deep + 1)
        total = np.zeros((n, deep + 1), np.uint64)
        np.cumsum((grid.astype(np.uint64) + np.uint64(1)) * up[:deep], axis=1, out=total[:, 1:])
        best, tokens = np.zeros((n, deep + 1), np.int64), np.zeros((n, deep + 1), np.int64)
        for d in range(1, deep + 1):
            alive = size >= d
            own = alive & (shared < d)
            node = np.flatnonzero(own)
            score = best[node, d - 1] + self.fallback
            count = tokens[node, d - 1] + 1
            for width, (marks, scores) in self.by_size.items():
                if width > d:
                    continue
                key = mix((total[node, d] - total[node, d - width]) * down[d - width])
                at = np.minimum(np.searchsorted(marks, key), len(marks) - 1)
                value = np.where(marks[at] == key, best[node, d - width] + scores[at], FAR)
                better = value > score
                score[better] = value[better]
                count[better] = tokens[node[better], d - width] + 1
            # Every word through the node takes its values.
            at = np.maximum.accumulate(np.where(own, np.arange(n), 0))
            back = np.zeros(n, np.int64)
            back[node] = np.arange(len(node))
            rows = np.flatnonzero(alive)
            best[rows, d], tokens[rows, d] = score[back[at[rows]]], count[back[at[rows]]]
        return tokens[np.arange(n), size]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, n_pretokens, n_tokens) per row.

    Null and empty texts count zero. Among equal scores the longer last piece wins. Repeated rows are counted each;
    an id may be null; an empty table gives no rows. Other columns are not read.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary.of(vocabulary)
        for batch in batches:
            n_words, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for part in slices(batch.column(1), 2 << 20):
                found = words(part.data, part.bounds, SPACED)
                n_words.append(np.diff(found.doc))
                if not len(found.start):
                    n_tokens.append(np.zeros(part.docs, np.int64))
                    continue
                marks, where, inverse = np.unique(found.hashes(part.data), return_index=True, return_inverse=True)
                old, counts = known.known.find(marks)
                if not old.all():
                    if len(known.known) > KEPT:
                        known.clear()
                        old[:] = False
                    new = np.flatnonzero(~old)
                    counts[new] = known.count_words(
                        [MARK + part.data[found.start[i] : found.end[i]].tobytes() for i in where[new].tolist()])
                    known.known.add(marks[new], counts[new])
                total = np.append(0, np.cumsum(counts[inverse]))
                n_tokens.append(total[found.doc[1:]] - total[found.doc[:-1]])
            yield pa.record_batch({
                "id": batch.column(0), "n_pretokens": pa.array(np.concatenate(n_words)),
                "n_tokens": pa.array(np.concatenate(n_tokens)),
            })

    return docs.select(key, text).mapInArrow(
        tidy(one), f"id {docs.schema[key].dataType.simpleString()}, n_pretokens long, n_tokens long").withColumnRenamed("id", key)
