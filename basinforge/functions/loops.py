"""Energies of the loops between two neighbouring pairs of a hybrid, from tables of parameters."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

import numpy as np

from basinforge.functions import energy
from basinforge.functions.sequence import PAIRS

LETTERS = "ACGU"
#: Letters as numbers: others, and positions outside a strand, are the last.
OTHER = len(LETTERS)


def codes(seq: str) -> np.ndarray:
    found = np.full(len(seq), OTHER, np.int64)
    for k, c in enumerate(LETTERS):
        found[[i for i, x in enumerate(seq) if x == c]] = k
    return found


def pairable() -> np.ndarray:
    out = np.zeros((OTHER + 1, OTHER + 1), bool)
    for p in PAIRS:
        out[LETTERS.index(p[0]), LETTERS.index(p[1])] = True
    return out


@dataclass(frozen=True)
class LoopTable:
    """Parameters in hundredths of kcal/mol.

    ``stack`` by the letters of a pair and the next one; ``bulge`` and ``interior`` by the number of unpaired letters; ``asymmetry`` for each letter that one
    strand has more than the other, at most ``most_asymmetry``; ``mismatch`` by a pair and the two letters behind it, for both pairs of an interior
    loop, the second seen from its other side; ``terminal`` by a pair, for both pairs of a bulge of over one letter.
    ``stacked_bulge``: a bulge of one letter keeps the stack of its pairs.
    """

    stack: np.ndarray
    bulge: np.ndarray
    interior: np.ndarray
    asymmetry: int
    most_asymmetry: int
    mismatch: np.ndarray
    terminal: np.ndarray
    stacked_bulge: bool

    @classmethod
    def plain(cls, loop: int = 30) -> LoopTable:
        """The built-in model: published stacks, and loops by their sizes alone."""
        n, size = np.arange(loop + 1), OTHER + 1
        stack = np.zeros((size,) * 4)
        for letters, e in energy.stack_table().items():
            stack[tuple(LETTERS.index(c) for c in letters)] = e
        return cls(stack, 100 + 70 * n, 100 + 20 * n, 50, 1 << 30, np.zeros((size,) * 4), np.zeros((size,) * 2), False)

    @classmethod
    def from_rows(cls, rows: Iterable[tuple[str, str, int]], loop: int = 30) -> LoopTable:
        """The plain table with the values of (kind, key, value) rows.

        Kinds: "stack" and "mismatch" with four letters as key, "terminal" with two, "bulge" and "interior" with a number of letters,
        "asymmetry" with "each" or "most", "stacked_bulge" with value 0 or 1.  Loops longer than the greatest number given extend it by the plain model's step.
        An unknown kind or key is an error.
        """
        base = cls.plain(loop)
        held = {"stack": base.stack.copy(), "mismatch": base.mismatch.copy(), "terminal": base.terminal.copy()}
        sizes: dict[str, dict[int, int]] = {"bulge": {}, "interior": {}}
        single = {("asymmetry", "each"): base.asymmetry, ("asymmetry", "most"): base.most_asymmetry, ("stacked_bulge", ""): 0}
        for kind, key, value in rows:
            key = key or ""
            if kind in held and len(key) == held[kind].ndim and set(key) <= set(LETTERS):
                held[kind][tuple(LETTERS.index(c) for c in key)] = value
            elif kind in sizes and key.isdigit() and int(key) > 0:
                sizes[kind][int(key)] = value
            elif (kind, key) in single:
                single[kind, key] = value
            else:
                raise ValueError(f"no parameter {kind} {key!r}")
        made = []
        for kind, plain in (("bulge", base.bulge), ("interior", base.interior)):
            out, last = plain.astype(float), max(sizes[kind], default=0)
            for n, value in sizes[kind].items():
                if n <= loop:
                    out[n] = value
            if 0 < last < loop:
                out[last + 1 :] = out[last] + plain[last + 1 :] - plain[last]
            made.append(out)
        return cls(held["stack"], *made, single["asymmetry", "each"], single["asymmetry", "most"], held["mismatch"], held["terminal"], bool(single["stacked_bulge", ""]))

    def turned(self) -> LoopTable:
        """The parameters of the same loops with both strands turned round and exchanged."""
        return replace(self, stack=self.stack.transpose(3, 2, 1, 0), terminal=self.terminal.T)

    def energies(self, d1: int, d2: int, first: np.ndarray, second: np.ndarray, behind: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of loops whose second pair is d1 and d2 letters behind the first one, on each strand.

        The arrays have a column for each loop and a row for each strand: the letters of both pairs, those behind the first and those before the second pair.
        """
        n = d1 + d2 - 2
        if n == 0:
            return self.stack[first[0], first[1], second[0], second[1]]
        if d1 == 1 or d2 == 1:
            if n == 1 and self.stacked_bulge:
                return self.bulge[n] + self.stack[first[0], first[1], second[0], second[1]]
            ends = self.terminal[first[0], first[1]] + self.terminal[second[0], second[1]] if n > 1 else 0.0
            return self.bulge[n] + ends + np.zeros(first.shape[1])
        uneven = min(self.most_asymmetry, self.asymmetry * abs(d1 - d2))
        return self.interior[n] + uneven + self.mismatch[first[0], first[1], behind[0], behind[1]] + self.mismatch[second[1], second[0], before[1], before[0]]
