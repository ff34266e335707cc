"""Pairwise alignment with affine gaps and a substitution matrix."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

# BLOSUM62, rows and columns in the order of AMINO.
AMINO = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4 -1 -2 -2 0 -1 -1 0 -2 -1 -1 -1 -1 -2 -1 1 0 -3 -2 0
-1 5 0 -2 -3 1 0 -2 0 -3 -2 2 -1 -3 -2 -1 -1 -3 -2 -3
-2 0 6 1 -3 0 0 0 1 -3 -3 0 -2 -3 -2 1 0 -4 -2 -3
-2 -2 1 6 -3 0 2 -1 -1 -3 -4 -1 -3 -3 -1 0 -1 -4 -3 -3
0 -3 -3 -3 9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1
-1 1 0 0 -3 5 2 -2 0 -3 -2 1 0 -3 -1 0 -1 -2 -1 -2
-1 0 0 2 -4 2 5 -2 0 -3 -3 1 -2 -3 -1 0 -1 -3 -2 -2
0 -2 0 -1 -3 -2 -2 6 -2 -4 -4 -2 -3 -3 -2 0 -2 -2 -3 -3
-2 0 1 -1 -3 0 0 -2 8 -3 -3 -1 -2 -1 -2 -1 -2 -2 2 -3
-1 -3 -3 -3 -1 -3 -3 -4 -3 4 2 -3 1 0 -3 -2 -1 -3 -1 3
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4 -2 2 0 -3 -2 -1 -2 -1 1
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5 -1 -3 -1 0 -1 -3 -2 -2
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5 0 -2 -1 -1 -1 -1 1
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6 -4 -2 -2 1 3 -1
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7 -1 -1 -4 -3 -2
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4 1 -3 -2 -2
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5 -2 -2 0
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11 2 -3
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7 -1
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
MATRIX = np.array(BLOSUM62.split(), dtype=np.int64).reshape(20, 20)
#: Score of anything with a letter outside AMINO.
UNKNOWN = -1


@dataclass(frozen=True)
class Alignment:
    """score, the aligned rows, and counts over their columns."""

    score: int
    a: str
    b: str
    matches: int
    gaps: int
    a_start: int
    b_start: int

    @property
    def identity(self) -> float:
        return self.matches / len(self.a) if self.a else 0.0


def _codes(s: str) -> np.ndarray:
    return np.array([AMINO.find(c) for c in s.upper()], dtype=np.int64)


def align(a: str, b: str, local: bool = False, gap_open: int = 11, gap_extend: int = 1) -> Alignment:
    """Best global or local alignment; a gap of k costs gap_open + k * gap_extend.

    Of equal scores a match goes before a gap in b, and that before a gap in a.
    """
    n, m, low = len(a), len(b), -(1 << 40)
    ca, cb = _codes(a), _codes(b)
    first = gap_open + gap_extend
    h, x, y = (np.full((n + 1, m + 1), low, np.int64) for _ in range(3))
    h[0, 0] = 0
    if local:
        h[0, :] = h[:, 0] = 0
    else:
        x[1:, 0] = -gap_open - gap_extend * np.arange(1, n + 1)
        y[0, 1:] = -gap_open - gap_extend * np.arange(1, m + 1)
        h[1:, 0], h[0, 1:] = x[1:, 0], y[0, 1:]
    for i in range(1, n + 1):
        score = np.where((cb >= 0) & (ca[i - 1] >= 0), MATRIX[ca[i - 1], cb], UNKNOWN)
        x[i, 1:] = np.maximum(h[i - 1, 1:] - first, x[i - 1, 1:] - gap_extend)
        open_ = np.maximum(h[i - 1, :-1] + score, x[i, 1:])
        if local:
            open_ = np.maximum(open_, 0)
        # Gaps along the row: the best start so far, less what its length costs.
        steps = gap_extend * np.arange(m + 1)
        best = np.maximum.accumulate(np.concatenate(([h[i, 0]], open_)) + steps)
        y[i, 1:] = np.maximum(best[:-1] - steps[1:] - gap_open, y[i, 1:] if i == 0 else low)
        h[i, 1:] = np.maximum(open_, y[i, 1:])
    i, j = np.unravel_index(int(h.argmax()), h.shape) if local else (n, m)
    total = int(h[i, j])
    ra, rb, state = [], [], "h"
    while i > 0 or j > 0:
        if state == "h":
            if local and h[i, j] == 0:
                break
            s = MATRIX[ca[i - 1], cb[j - 1]] if i and j and ca[i - 1] >= 0 and cb[j - 1] >= 0 else UNKNOWN
            if i and j and h[i, j] == h[i - 1, j - 1] + s:
                i, j = i - 1, j - 1
                ra.append(a[i])
                rb.append(b[j])
            else:
                state = "x" if i and h[i, j] == x[i, j] else "y"
        elif state == "x":
            state = "h" if i == 1 and j == 0 or h[i - 1, j] - first == x[i, j] else "x"
            i -= 1
            ra.append(a[i])
            rb.append("-")
        else:
            state = "h" if j == 1 and i == 0 or h[i, j - 1] - first == y[i, j] else "y"
            j -= 1
            ra.append("-")
            rb.append(b[j])
    ra, rb = "".join(reversed(ra)), "".join(reversed(rb))
    return Alignment(total, ra, rb, sum(p == q for p, q in zip(ra, rb, strict=True)), ra.count("-") + rb.count("-"), int(i), int(j))


def bit_score(score: float, lam: float = 0.267, k: float = 0.041) -> float:
    return (lam * score - math.log(k)) / math.log(2)


def evalue(score: float, m: int, n: int, sequences: int, lam: float = 0.267, k: float = 0.041, h: float = 0.14) -> float:
    """Expected chance hits after length adjustment (at most 20 rounds)."""
    cut = 0.0
    for _ in range(20):
        space = max(m - cut, 1) * max(n - sequences * cut, 1)
        new = max(0.0, min(math.log(k * space) / h, m - 1))
        if abs(new - cut) < 0.5:
            break
        cut = new
    return k * max(m - cut, 1) * max(n - sequences * cut, 1) * math.exp(-lam * score)
