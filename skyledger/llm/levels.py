"""A growing table of 64-bit marks with values, in sorted levels of doubling size.

A new level is merged with the one before it as long as it is at least half as long, so an entry is sorted again only
a logarithmic number of times, however often the table grows.
"""

from __future__ import annotations

import numpy as np


class Levels:
    def __init__(self, *types: type):
        self.types, self.levels = types, []

    def __len__(self) -> int:
        return sum(len(level[0]) for level in self.levels)

    def add(self, marks: np.ndarray, *values: np.ndarray) -> None:
        """Marks must be new and distinct."""
        new = (marks, *values)
        while self.levels and 2 * len(new[0]) >= len(self.levels[-1][0]):
            new = tuple(np.append(a, b) for a, b in zip(self.levels.pop(), new))
        order = np.argsort(new[0], kind="stable")
        self.levels.append(tuple(x[order] for x in new))

    def find(self, marks: np.ndarray) -> tuple[np.ndarray, ...]:
        """Which marks are known, and their values (0 if not)."""
        known, out = np.zeros(len(marks), bool), [np.zeros(len(marks), t) for t in self.types]
        rest = np.arange(len(marks))
        for keys, *values in self.levels:
            at = np.searchsorted(keys, marks[rest])
            at[at == len(keys)] = 0
            hit = keys[at] == marks[rest]
            known[rest[hit]] = True
            for o, v in zip(out, values):
                o[rest[hit]] = v[at[hit]]
            rest = rest[~hit]
        return known, *out
