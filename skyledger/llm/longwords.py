"""Unigram token counts of words of any length, segment by segment.

A word is cut into segments of ``SEGMENT`` bytes. What the score of a segment needs from the bytes before it is its
state: the scores of the positions up to the longest piece before its start, relative to the score there. A segment
under one state is scored once, however many words or places share it. The segments of all words go through the
forward scores together, one byte of each a step, from the states that ``TAIL`` bytes before them suggest. A word's
count is the sum along the chain of its segments whose states have proved to be the ones that the segments before them
end in; those that were suggested wrongly are scored again. Scores are integers, so relative scores are exact.
"""

from __future__ import annotations

import numpy as np

SEGMENT, TAIL, CELLS, EAGER = 1024, 256, 1 << 19, 3
FAR = -(1 << 50)


class Walker:
    """The pieces as a trie: nodes in order of (depth, bytes), so that the edges (parent, byte) ascend with their node."""

    def __init__(self, scored: dict[bytes, int], fallback: int):
        nodes = sorted({p[:d] for p in scored for d in range(len(p) + 1)} | {b""}, key=lambda x: (len(x), x))
        number = {x: i for i, x in enumerate(nodes)}
        self.edges = np.array([number[x[:-1]] * 256 + x[-1] for x in nodes[1:]], np.int32 if len(nodes) < 1 << 22 else np.int64)
        self.value = np.array([scored.get(x, FAR) for x in nodes], np.int64)
        self.width, self.fallback = max(map(len, scored), default=1), fallback
        # Scores carry the width of the last piece in their low digit: among equal ones the longer piece wins, and
        # the single byte of last resort over all.
        self.base = self.width + 2
        self.states: dict[bytes, int] = {}
        self.state(np.append(np.full(self.width, FAR), 0), np.zeros(self.width + 1, np.int64))

    def state(self, best: np.ndarray, tokens: np.ndarray) -> int:
        return self.states.setdefault(best.astype(np.int64).tobytes() + tokens.tobytes(), len(self.states))

    def count(self, words: list[bytes], segment: int = SEGMENT, tail: int = TAIL) -> np.ndarray:
        """Tokens of the best segmentation of each word; ``segment`` and ``tail`` are no less than the longest piece."""
        segment, tail = max(segment, self.width), min(max(tail, self.width), max(segment, self.width))
        contents: dict[tuple[int, bytes], int] = {}
        chains, ends, tails = [], [], []
        for word in words:
            cuts = range(0, len(word), segment)
            chains.append([contents.setdefault(
                (min(b, self.width), word[max(0, b - self.width) : b + segment]), len(contents)) for b in cuts])
            tails.append([word[b - tail : b] for b in cuts[1:]])
        suggested = self._score([((0, t), 0) for t in dict.fromkeys(t for some in tails for t in some)])
        ends = [[suggested[(0, t), 0][1] for t in some] + [0] for some in tails]
        bodies = list(contents)
        memo: dict[tuple[int, int], tuple[int, int]] = {}
        proved = [(0, 0, 0)] * len(words)  # segments, the state after them, their tokens
        turn, open_words = 0, [w for w, chain in enumerate(chains) if chain]
        while open_words:
            wanted: dict[tuple[int, int], None] = {}
            used = []
            for w in open_words:
                k, state, total = proved[w]
                chain = chains[w]
                while k < len(chain) and (got := memo.get((chain[k], state))):
                    k, state, total = k + 1, got[1], total + got[0]
                proved[w] = k, state, total
                for j in range(k, len(chain) if turn < EAGER else min(k + 1, len(chain))):
                    pair = chain[j], state if j == k else ends[w][j - 1]
                    used.append((w, j, pair))
                    if pair not in memo:
                        wanted[pair] = None
            made = self._score([(bodies[c], s) for c, s in wanted])
            memo.update({(c, s): made[bodies[c], s] for c, s in wanted})
            for w, j, pair in used:
                ends[w][j] = memo[pair][1]
            open_words = [w for w in open_words if proved[w][0] < len(chains[w])]
            turn += 1
        if len(self.states) > 100_000:
            self.states = dict(list(self.states.items())[:1])
        return np.array([total for _, _, total in proved], np.int64)

    def _score(self, wanted: list) -> dict:
        """{(content, state): (tokens, state after it)}, contents with the number of bytes that only precede them."""
        out, known = {}, list(self.states)
        wanted.sort(key=lambda x: len(x[0][1]) - x[0][0])
        i = 0
        while i < len(wanted):
            j = i + 1
            while j < len(wanted) and (j - i + 1) * (len(wanted[j][0][1]) - wanted[j][0][0] + self.width) <= CELLS:
                j += 1
            for pair, got in zip(wanted[i:j], self._together(wanted[i:j], known)):
                out[pair] = got
            i = j
        return out

    def _together(self, wanted: list, known: list[bytes]) -> list[tuple[int, int]]:
        """Rows of a grid by columns: the cell of a row and a column is column * rows + row."""
        n, width, base = len(wanted), self.width, self.base
        own = np.array([len(c) - before for (before, c), _ in wanted])
        cols = width + int(own.max())
        data, first = np.zeros((cols, n), np.uint8), np.zeros(n, np.int64)
        best, tokens = np.full((cols + 1, n), FAR * base), np.zeros((cols + 1, n), np.int64)
        for r, ((before, c), s) in enumerate(wanted):
            first[r] = width - before
            data[width - before : width - before + len(c), r] = np.frombuffer(c, np.uint8)
            both = np.frombuffer(known[s], np.int64)
            best[: width + 1, r], tokens[: width + 1, r] = both[: width + 1] * base, both[width + 1 :]
        # Every place has its single byte besides the pieces that end there.
        column = np.arange(cols)[:, None]
        single = np.flatnonzero((column >= width) & (column < width + own)) + n
        ends, back, gain = (np.concatenate(x) for x in zip(
            (single, np.full(len(single), n), np.full(len(single), self.fallback * base + base - 1)),
            *self._pieces(data, first, width + own)))
        order = np.argsort(ends, kind="stable")
        ends, source, gain = ends[order], (ends - back)[order], gain[order]
        head = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
        target = ends[head]
        at = np.searchsorted(ends, np.arange(width + 1, cols + 2) * n)
        at_head = np.searchsorted(head, at)
        head -= np.repeat(at[:-1], np.diff(at_head))
        flat, counted = best.reshape(-1), tokens.reshape(-1)
        for k in range(cols - width):
            a, b, c, d = at[k], at[k + 1], at_head[k], at_head[k + 1]
            top = np.maximum.reduceat(flat[source[a:b]] + gain[a:b], head[c:d])
            last = top % base
            to = target[c:d]
            flat[to] = top - last
            last[last == base - 1] = 1
            counted[to] = counted[to - last * n] + 1
        out = []
        for r in range(n):
            end = width + int(own[r])
            b, t = best[end - width : end + 1, r] // base, tokens[end - width : end + 1, r]
            far = b < FAR // 2
            out.append((int(t[-1]), self.state(np.where(far, FAR, b - b[-1]), np.where(far, 0, t - t[-1]))))
        return out

    def _pieces(self, data: np.ndarray, first: np.ndarray, stop: np.ndarray):
        """For each width, the cells that pieces of it end in, past the column ``width``, the cells back to their start
        and their scores; all places descend the trie together."""
        cols, n = data.shape
        column = np.arange(cols)[:, None]
        at = np.flatnonzero((column >= first) & (column < stop))
        flat, node = data.reshape(-1), np.zeros(len(at), self.edges.dtype)
        lead = (self.width - at // n).astype(np.int32)
        room = (stop[at % n] - at // n).astype(np.int32)
        for w in range(1, self.width + 1):
            key = node * self.edges.dtype.type(256) + flat[at + (w - 1) * n]
            found = np.searchsorted(self.edges, key)
            found[found == len(self.edges)] = 0
            hit = np.flatnonzero(self.edges[found] == key)
            at, lead, room, node = at[hit], lead[hit], room[hit], found[hit] + 1
            value = self.value[node]
            piece = np.flatnonzero((value > FAR) & (lead < w))
            yield at[piece] + w * n, np.full(len(piece), w * n), value[piece] * self.base + w
            more = np.flatnonzero(room > w)
            at, lead, room, node = at[more], lead[more], room[more], node[more].astype(self.edges.dtype)
            if not len(at):
                return
