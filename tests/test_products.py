"""Products within an assay, in feature blocks and cell salts, against dense matrices."""

import numpy as np
import pytest

from regweave.operators import correlation as C


@pytest.fixture(scope="module")
def assay(spark):
    r = np.random.default_rng(2)
    m = np.where(r.random((60, 23)) < 0.3, r.integers(-3, 5, (60, 23)), 0).astype(float)
    m[:, 4] = 0
    m[:, 0] = 1 + np.arange(60)  # stored in every cell
    rows = [(f"c{i}", f"f{j}", float(m[i, j])) for i in range(60) for j in range(23) if m[i, j]]
    return m, spark.createDataFrame(rows, "cell string, feature string, value double").repartition(7)


@pytest.mark.parametrize("block, values", [(1024, 200_000), (4, 20), (1, 5), (50, 10)])
@pytest.mark.parametrize("weighted", [False, True])
def test_against_dense(spark, assay, monkeypatch, block, values, weighted):
    monkeypatch.setattr(C, "FEATURE_BLOCK", block)
    monkeypatch.setattr(C, "SLICE_VALUES", values)
    m, x = assay
    w = np.arange(60) % 3 + 1.0 if weighted else np.ones(60)
    obs = spark.createDataFrame([(f"c{i}", float(w[i])) for i in range(60)], "cell string, weight double") if weighted else None
    got = {(r.x, r.y): r.sxy for r in C.cross_products_within(x, obs).collect() if r.sxy}  # partial sums may cancel
    full = m.T @ (m * w[:, None])
    expected = {tuple(sorted((f"f{i}", f"f{j}"))): full[i, j] for i in range(23) for j in range(i, 23) if full[i, j]}
    assert all(a <= b for a, b in got) and set(got) == set(expected)
    assert all(got[k] == pytest.approx(v) for k, v in expected.items())


def test_no_values(assay):
    assert C.cross_products_within(assay[1].filter("false")).count() == 0
