"""Peeling of difference sketches on the driver: bounded by the number of cells, not by the tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions import hashing as H
from .sketch import estimate_array


@dataclass
class Decoded:
    plus: list[tuple[int, int]] = field(default_factory=list)  # (fp, id) found on the first side only
    minus: list[tuple[int, int]] = field(default_factory=list)
    residual: int = 0
    d_hat: float = 0.0

    @property
    def complete(self) -> bool:
        return self.residual == 0


def peel(views: list[np.ndarray], seeds: list[int]) -> Decoded:
    """Joint peel of one or more 4 x M views of the same difference, each with its own size and seed.

    Rounds are vectorised: all pure cells of all views are found at once, each distinct symbol is taken out of every view.
    """
    work = [v.copy() for v in views]
    out = Decoded(d_hat=estimate_array(views[0]))
    seen: set[tuple[int, int, int]] = set()
    while True:
        found: dict[tuple[int, int], int] = {}
        for v in work:
            counts = v[0].view(np.int64)
            pure = np.flatnonzero((np.abs(counts) == 1) & (v[3] == H.checksum(v[1])))
            for i in pure:
                found.setdefault((int(v[1, i]), int(v[2, i])), int(counts[i]))
        fresh = [(fp, rid, s) for (fp, rid), s in found.items() if (fp, rid, s) not in seen]
        if not fresh:
            break
        seen.update(fresh)
        fp = np.array([f for f, _, _ in fresh], np.uint64)
        rid, sign = np.array([r for _, r, _ in fresh], np.uint64), np.array([s for _, _, s in fresh], np.int64)
        check = H.checksum(fp)
        for v, seed in zip(work, seeds, strict=True):
            at = H.positions(fp, v.shape[1], seed)
            for k in range(H.K):
                np.subtract.at(v[0].view(np.int64), at[:, k], sign)
                np.bitwise_xor.at(v[1], at[:, k], fp)
                np.bitwise_xor.at(v[2], at[:, k], rid)
                np.bitwise_xor.at(v[3], at[:, k], check)
        out.plus += [(f, r) for f, r, s in fresh if s > 0]
        out.minus += [(f, r) for f, r, s in fresh if s < 0]
    out.residual = int(sum(v.any(0).sum() for v in work))
    return out
