"""E8 lattice points: the nearest one to each row, and the cells around it."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two places of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1.0, 1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    for signs in product((-0.5, 0.5), repeat=8):
        if sum(s < 0 for s in signs) % 2 == 0:
            out.append(np.array(signs))
    return np.array(out)


ROOTS = _roots()


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum: round, and where the sum is odd round the worst coordinate the other way."""
    p = np.rint(y)
    off = y - p
    odd = np.flatnonzero(p.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    p[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return p


def nearest(y: np.ndarray) -> np.ndarray:
    """Nearest lattice points (rows of eight numbers)."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    closer = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def cells(y: np.ndarray, probes: int) -> np.ndarray:
    """The own point of each row and its ``probes`` nearest neighbouring points: rows x (1 + probes) x 8."""
    own = nearest(y)
    reach = (y - own) @ ROOTS.T
    near = np.argsort(-reach, axis=1, kind="stable")[:, :probes]
    return np.concatenate((own[:, None], own[:, None] + ROOTS[near]), axis=1)
