"""Whitening against plain numpy in double precision, and exact sums against whole numbers."""

import numpy as np
import pytest

from linkfold.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, id string, x string, n string, component string"


def _run(spark, rows, **more):
    vectors = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    return whitening.whitened(vectors, "vec_id", "embedding", **more).toPandas()


def _plain(rows, components):
    """vec_id -> (deviation, whitened), eigenvalue shares, n; signs are free."""
    x = [(i, [int(np.floor(64.0 * np.float64(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(v) for _, v in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = lambda v: np.array([float(n * a - s) / n for a, s in zip(v, sums)])
    c = np.array([centred(v) for v in fit])
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1], vector[:, ::-1]
    out = [(i, sum((n * a - s) ** 2 for a, s in zip(v, sums)), centred(v) @ vector[:, :components] / np.sqrt(value[:components])) for i, v in x]
    return out, value / value.sum(), n


def test_against_plain_numpy(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.normal(size=24) * np.linspace(0.1, 3, 24)]) for i in range(300)]
    good += [(500 + i, good[5][1]) for i in range(90)] + [(None, good[6][1]), (7, good[7][1])]  # copies, a null id, a repeated row
    bad = [(900, None), (901, []), (902, [None] * 24), (903, [float("nan")] * 24), (904, [float("inf")] + [0.0] * 23), (905, [1.0] * 23), (906, [3e38] + [0.0] * 23)]
    got = _run(spark, good + bad)
    want, share, n = _plain(good, 16)
    assert n == 300 and len(got) == 16 * len(good) and set(got.n) == {300}
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    sign = {}
    by_id = {(-1 if i is None else i): (d, w) for i, d, w in want}
    for r in got.fillna({"vec_id": -1}).itertuples():
        deviation, values = by_id[int(r.vec_id)]
        assert r.deviation == deviation and abs(r.explained - share[r.component - 1]) < 1e-12
        s = sign.setdefault(r.component, np.sign(values[r.component - 1] * r.whitened))
        assert abs(r.whitened - s * values[r.component - 1]) < 1e-9


def test_large_entries_are_exact(spark):
    rows = [(0, [1e9, 0.0]), (1, [-2e9, 1.0]), (2, [3e9, 5.0]), (3, [1e17, 2.0])]
    got = _run(spark, rows)
    want = {i: d for i, d, _ in _plain(rows, 2)[0]}
    assert got.drop_duplicates("vec_id").set_index("vec_id").deviation.isna().all()  # all are beyond a long here
    assert all(d >= 2**63 for d in want.values())
    rows = rows[:3]
    got = _run(spark, [(i, [c / 1e4 for c in v]) for i, v in rows]).drop_duplicates("vec_id").set_index("vec_id").deviation.to_dict()
    assert got == {i: d for i, d, _ in _plain([(i, [c / 1e4 for c in v]) for i, v in rows], 2)[0]}


def test_few_and_none(spark):
    assert len(_run(spark, [])) == 0
    assert len(_run(spark, [(0, None)])) == 0
    assert len(_run(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0])])) == 0  # no variance
    got = _run(spark, [(0, [1.0, 2.0, 0.0]), (1, [2.0, 5.0, 0.0]), (2, [2.0, 5.0, 0.0])])
    assert list(got.component) == [1, 1, 1] and set(got.n) == {2} and got.explained[0] == pytest.approx(1)


def _matrix(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 2, 64),
        [5.0, 5.0, 5.0, 3.0, 3.0, 1.0],  # multiple
        [5.0, 5.0 + 1e-9, 5.0 + 2e-9, 3.0, 3.0 + 1e-12, 1e-3, 0.0, 0.0],  # clusters that float32 cannot tell apart
        [1.0] * 40 + [2.0],
        [7.0],
        np.concatenate([1 + np.arange(30) * 1e-8, 2 + np.arange(30) * 1e-7, [1e4]]),
    ],
)
def test_refinement_reaches_double_precision(values):
    a = _matrix(np.asarray(values, float))
    value, x = whitening.eigen(a)
    scale = np.abs(a).max() * len(a)
    assert np.all(np.diff(value) <= 1e-14 * scale)
    assert np.allclose(value, np.sort(values)[::-1], rtol=0, atol=1e-13 * scale)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-13
    assert np.abs(a @ x - x * value).max() < 1e-13 * scale


def test_refinement_tells_near_eigenvalues_apart():
    """Gaps of 1e-6 are below float32; the corrected vectors still agree with those of a double solver."""
    a = _matrix(1 + np.arange(12) * 1e-6, seed=4)
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    want = np.linalg.eigh(a)[1][:, ::-1]
    _, x = whitening.eigen(a)
    assert np.abs(np.abs((want * x).sum(axis=0)) - 1).max() < 1e-12
    assert np.abs(np.abs((want * rough[:, ::-1]).sum(axis=0)) - 1).max() > 1e-6
