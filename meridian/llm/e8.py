"""The E8 lattice: nearest points and neighbouring cells, for arrays of 8-dimensional points."""

from __future__ import annotations

import itertools

import numpy as np


def roots() -> np.ndarray:
    """The 240 shortest vectors, doubled to integers: all (+-2, +-2, 0...) and all (+-1)^8 with an even count of minus."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in itertools.product((1, -1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(out, np.int64)


ROOTS = roots()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8, the integer points of even sum: round, and if the sum is odd round the worst entry the other way."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    if len(odd):
        miss = x[odd] - near[odd]
        worst = np.abs(miss).argmax(axis=1)
        near[odd, worst] += np.where(miss[np.arange(len(odd)), worst] < 0, -1, 1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of x, doubled to integers: the better of D8 and D8 shifted by a half."""
    a = _nearest_even(x)
    b = _nearest_even(x - 0.5) + 0.5
    use_a = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(use_a[:, None], a, b)).astype(np.int64)


def cells(x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Own cell and the ``probes`` nearest neighbouring cells of each row: (n, 1 + probes, 8) doubled points, and their squared distances."""
    own = decode(x)
    rest = x - own / 2
    base = (rest**2).sum(axis=1)
    gain = rest @ (ROOTS.T / 2.0)  # squared distance to own + root is base - 2 gain + 2
    pick = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
    near = own[:, None, :] + ROOTS[pick]
    far = base[:, None] - 2 * np.take_along_axis(gain, pick, axis=1) + 2
    return np.concatenate([own[:, None, :], near], axis=1), np.concatenate([base[:, None], far], axis=1)
