"""op6: recall against brute force, and rows that link with nothing."""

from __future__ import annotations

import numpy as np

from brookcheck.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, v string"


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((300, 64))
    x = np.repeat(centres, 5, axis=0) + 0.27 * rng.standard_normal((1500, 64))
    x = np.concatenate([x, rng.standard_normal((1500, 64))]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2 if i >= 1500 else 0, "x") for i, v in enumerate(x)]
    got = {r.vec_id: r for r in embed_dedup.similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (y @ y.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    want = link.sum(axis=1)
    have = np.array([got[i].n_links for i in range(len(x))])
    assert want.sum() > 500 and (have <= want).all() and have.sum() >= 0.99 * want.sum()


def test_recall_of_vectors_with_a_common_direction(spark):
    rng = np.random.default_rng(1)
    unit = lambda z: z / np.linalg.norm(z, axis=-1, keepdims=True)
    common = unit(rng.standard_normal(64))
    x = unit(np.sqrt(0.65) * common + np.sqrt(0.35) * unit(rng.standard_normal((1200, 64))))
    off = rng.standard_normal(x.shape)
    y = 0.932 * x + np.sqrt(1 - 0.932**2) * unit(off - (off * x).sum(axis=1, keepdims=True) * x)
    z = np.concatenate([x, y]).astype(np.float32)
    got = {r.vec_id: r.n_links for r in embed_dedup.similar_vectors(spark.createDataFrame([(i, v.tolist(), 0, "x") for i, v in enumerate(z)], SCHEMA)).collect()}
    w = unit(z.astype(float))
    link = w @ w.T >= 0.93
    np.fill_diagonal(link, False)
    want = link.sum(axis=1)
    have = np.array([got[i] for i in range(len(z))])
    assert want.sum() >= 2400 and (have <= want).all() and have.sum() >= 0.99 * want.sum(), have.sum() / want.sum()


def test_rows_that_repeat_an_id(spark):
    a, b = [1.0, 0.0, 0.5], [-1.0, 0.2, 0.0]
    rows = [(1, a, 1), (1, a, 1), (1, b, 1), (2, a, 1), (3, b, 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.similar_vectors(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1)]


def test_odd_vectors(spark):
    a = [1.0, 2.0, 3.0]
    rows = [(5, a, 1), (2, a, 1), (9, [2.0, 4.0, 6.0], 1), (3, a, 2), (4, a, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (10, [float("nan"), 2.0, 3.0], 1), (11, [float("inf"), 2.0, 3.0], 1), (12, [], 1), (13, [1.0, 2.0], 1), (None, a, 1)]
    got = {r[0]: tuple(r)[1:] for r in embed_dedup.similar_vectors(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    alone = {i: (0, i, True) for i in (3, 4, 6, 7, 8, 10, 11, 12, 13)}
    assert got == {5: (2, 2, False), 2: (2, 2, True), 9: (2, 2, False), None: (0, None, False)} | alone
    assert embed_dedup.similar_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def _brute(rows, cosine=0.93):
    """vec_id -> (n_links, component) over all pairs."""
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= cosine) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    ids = np.array([r[0] for r in rows])
    comp = ids.copy()
    while True:
        low = np.where(link, comp, comp.max()).min(axis=1)
        new = np.minimum(comp, low)
        if (new == comp).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, link.sum(axis=1), comp, strict=True)}
        comp = new


def _groups(rng, sizes, alone, spread):
    """Rows of near-equal groups, copies among them, and of vectors on their own."""
    x = [c + spread * rng.standard_normal((n, 32)) for n, c in zip(sizes, rng.standard_normal((len(sizes), 32)), strict=True)]
    x = np.concatenate([*x, rng.standard_normal((alone, 32))]).astype(np.float32)
    x = np.concatenate([x, x[::50]])
    return [(int(i), v.tolist(), k % 2 if k >= sizes[0] else 0, "x") for k, (i, v) in enumerate(zip(rng.permutation(len(x)), x, strict=True))]


def test_dense_groups_are_counted_once_over_all_tables(spark, monkeypatch):
    rows = _groups(np.random.default_rng(4), [700, 300, 90], 800, 0.12)
    monkeypatch.setattr(embed_dedup, "BLOCK", 128)  # many pairs of blocks
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = _brute(rows)
    assert sum(n for n, _ in want.values()) > 400_000
    assert got == want


def test_thousands_of_near_equal_vectors(spark):
    rows = _groups(np.random.default_rng(5), [5000], 100, 0.02)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == _brute(rows)


def test_fingerprints_that_agree_in_64_bits(spark):
    from brookcheck.llm.common import told_apart

    rows = [(1, 7, 1), (2, 7, 2), (3, 7, 1), (4, 8, 5), (5, None, None)]
    got = {r.i: r.v for r in told_apart(spark.createDataFrame(rows, "i int, v long, v2 long")).collect()}
    assert got[1] == got[3] == 7 and got[4] == 8 and got[5] is None and got[2] not in (7, 8)
