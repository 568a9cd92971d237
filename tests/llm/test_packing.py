"""Packed counts of op12 take few bytes in a shuffle."""

from __future__ import annotations

import zlib

import numpy as np

from brookcheck.llm import collocations


def test_packed_hashes_and_counts_come_back_and_take_less_than_the_hashes():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**64 - 1, 20_000, dtype=np.uint64) & collocations.MINED)
    n = rng.integers(1, 5, len(h))
    rows = collocations._packed(["x"], np.zeros(len(h), np.int64), h, 4, {"h": h, "n": n}, 0)
    assert len(rows) == 4 and rows["total"].sum() == n.sum()
    assert (np.concatenate([collocations._hashes_of(x) for x in rows["h"]]) == h).all()
    assert (np.concatenate([collocations._numbers(x, np.int64) for x in rows["n"]]) == n).all()
    assert sum(len(zlib.compress(x, 1)) for c in ("h", "n") for x in rows[c]) < 0.75 * 8 * len(h)
