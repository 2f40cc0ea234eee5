import math

import numpy as np
import pytest

from tallyloom.llm import whitening


def plain(vectors, components=16):
    """(n, [(deviation, whitened)], explained) by one dense eigendecomposition."""
    x = np.array([[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    y = fit - total / n
    e, q = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)[:components]
    order = order[e[order] > 1e-12 * e.max()]
    apart = n * x - total
    return n, (apart.astype(object) ** 2).sum(1), (apart / n) @ q[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, component string, x int")


def compare(spark, rows, components=16):
    got = whitening.whiten(frame(spark, rows).repartition(3), components=components).toPandas().sort_values(["vec_id", "component"])
    good = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    good.sort(key=lambda r: r[0])
    n, deviation, white, explained = plain([np.float32(r[1]) for r in good], components)
    k = len(explained)
    assert len(got) == len(good) * k
    assert got["n"].eq(n).all()
    assert [int(d) for d in got["deviation"][::k]] == list(deviation)
    assert np.allclose(got["explained"].to_numpy().reshape(-1, k)[0], explained, rtol=1e-9)
    w = got["whitened"].to_numpy().reshape(-1, k)
    sign = np.sign((w * white).sum(0))
    assert np.allclose(w * sign, white, atol=1e-8)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    return got


def test_equal_to_a_dense_eigendecomposition(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=20) * np.arange(1, 21)], "s", 1) for i in range(300)]
    rows += [(1000 + i, rows[0][1], "s", 1) for i in range(200)]  # copies weigh once
    rows += [(2000, None, "s", 1), (2001, [None] * 20, "s", 1), (2002, [float("nan")] * 20, "s", 1), (2003, [float("inf")] * 20, "s", 1), (2004, [], "s", 1)]
    compare(spark, rows)


def test_low_rank_and_fewer_dimensions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(a), float(b), float(a + b)], "s", 1) for i, (a, b) in enumerate(rng.integers(-9, 9, (60, 2)))]
    assert compare(spark, rows)["component"].max() == 2


def test_nothing_to_whiten(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], "s", 1), (2, [1.0, 2.0], "s", 1)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None, None, None)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_null_and_repeated_ids_keep_their_rows(spark):
    rows = [(None, [1.0, 5.0], "s", 1), (1, [2.0, 4.0], "s", 1), (1, [2.0, 4.0], "s", 1), (2, [9.0, 1.0], "s", 1)]
    assert whitening.whiten(frame(spark, rows)).count() == 4 * 2


def test_mixed_lengths_and_huge_entries_raise(spark):
    with pytest.raises(ValueError):
        whitening.whiten(frame(spark, [(1, [1.0], "s", 1), (2, [1.0, 2.0], "s", 1)]))
    with pytest.raises(OverflowError):
        whitening.whiten(frame(spark, [(1, [1e30], "s", 1), (2, [1.0], "s", 1)]))


@pytest.mark.parametrize("seed", range(5))
def test_secular_update_with_deflation(seed):
    rng = np.random.default_rng(seed)
    lam = np.sort(rng.integers(0, 4, 12).astype(float))  # many equal poles
    z = rng.normal(size=12) * (rng.random(12) > 0.3)
    value, turn = whitening.secular_update(lam, z, 0.7)
    whole = np.diag(lam) + 0.7 * np.outer(z, z)
    assert np.abs(turn.T @ turn - np.eye(12)).max() < 1e-12
    assert np.abs(turn @ np.diag(value) @ turn.T - whole).max() < 1e-11


def test_merged_spectra_equal_one_pass():
    rng = np.random.default_rng(9)
    x = rng.integers(-50, 50, (90, 7)) + 1000000
    parts = [whitening.Spectrum(7) for _ in range(3)]
    for i, v in enumerate(x):
        parts[i % 3].add(v)
    for other in parts[1:]:
        parts[0].merge(other)
    y = x - x.mean(0)
    own = parts[0]
    assert own.n == 90 and list(own.total) == list(x.sum(0))
    assert np.abs(own.basis @ np.diag(own.lam) @ own.basis.T - y.T @ y).max() < 1e-9 * own.lam.max()


def test_many_partitions_merge_into_one_spectrum(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(-50, 50, (400, 6)) + 1000000
    fit = spark.createDataFrame([([int(c) for c in v],) for v in x], "x array<bigint>").repartition(40)
    own = whitening.fit_spectrum(fit, 6)
    y = x - x.mean(0)
    assert own.n == 400 and np.abs(own.basis @ np.diag(own.lam) @ own.basis.T - y.T @ y).max() < 1e-9 * own.lam.max()
    cov, trace = whitening.projected_covariance(fit, np.eye(6), 400, own.total)
    assert np.allclose(cov, y.T @ y / 400) and np.isclose(trace, np.trace(y.T @ y) / 400)
