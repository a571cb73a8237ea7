"""Boosted trees against a plain booster on the dense matrix."""

import math

import numpy as np
import pyarrow as pa
import pytest

from regweave.operators import boosting
from regweave.operators import models as M
from regweave.operators.gram import RESPONSE

N = 90


@pytest.fixture(scope="module")
def dense():
    r = np.random.default_rng(5)
    x = np.round(np.where(r.random((2, N, 3)) < 0.6, r.normal(0, 1, (2, N, 3)), 0), 1)
    y = np.stack([np.maximum(0, np.round(2 + x[k, :, 0] - (x[k, :, 1] > 0.3) + r.normal(0, 0.5, N))) for k in (0, 1)])
    y[:, -4:], x[:, -4:] = 0, 0
    return x, y


@pytest.fixture(scope="module")
def design(spark, dense):
    x, y = dense
    rows = [(f"t{k}", i, j + 1, float(x[k, i, j]), 1.0) for k in (0, 1) for i in range(N) for j in range(3) if x[k, i, j]]
    rows += [(f"t{k}", i, RESPONSE, float(y[k, i]), 1.0) for k in (0, 1) for i in range(N) if y[k, i]]
    return spark.createDataFrame(rows, "target string, cell long, j int, v double, w double"), spark.range(N).toDF("cell")


def plain(x, y, nrounds, eta, depth, objective, lam=1.0, least=1.0, base=0.5):
    """Greedy trees over all cuts between observed values; ties go to the smaller term and value."""
    f = [{"gaussian": base, "poisson": math.log(base), "binomial": math.log(base / (1 - base))}[objective]] * len(y)
    found = {}

    def mean(v):
        return v if objective == "gaussian" else math.exp(v) if objective == "poisson" else 1 / (1 + math.exp(-v))

    def split(rows, level):
        G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = None
        for j in range(x.shape[1]):
            for cut in sorted({x[i, j] for i in rows}):
                gl, hl = sum(g[i] for i in rows if x[i, j] <= cut), sum(h[i] for i in rows if x[i, j] <= cut)
                if hl < least or H - hl < least:
                    continue
                gain = gl * gl / (hl + lam) + (G - gl) ** 2 / (H - hl + lam) - G * G / (H + lam)
                if best is None or round(gain, 9) > round(best[0], 9):
                    best = gain, j, cut
        if level == depth or best is None or best[0] <= 1e-9:
            for i in rows:
                f[i] += eta * G / (H + lam)
            return
        gain, j, cut = best
        found[j + 1] = [a + b for a, b in zip(found.get(j + 1, [0, 0, 0]), (gain, H, 1))]
        split([i for i in rows if x[i, j] <= cut], level + 1)
        split([i for i in rows if x[i, j] > cut], level + 1)

    for _ in range(nrounds):
        mu = [mean(v) for v in f]
        g = [a - m for a, m in zip(y, mu)]
        h = [1.0 if objective == "gaussian" else m * math.exp(0.7) if objective == "poisson" else m * (1 - m) for m in mu]
        split(list(range(len(y))), 0)
    totals = [sum(v[k] for v in found.values()) for k in range(3)]
    rss, around = sum((a - mean(v)) ** 2 for a, v in zip(y, f)), sum((a - np.mean(y)) ** 2 for a in y)
    return {j: [a / t for a, t in zip(v, totals)] for j, v in found.items()}, 1 - rss / around


@pytest.mark.parametrize("held", [8_000_000, 100], ids=["alone", "barrier"])
@pytest.mark.parametrize("objective, depth", [("gaussian", 3), ("poisson", 2), ("binomial", 2)])
def test_against_plain_booster(design, dense, monkeypatch, held, objective, depth):
    monkeypatch.setattr(boosting, "HELD", held)
    (rows, obs), (x, y) = design, dense
    if objective == "binomial":
        y = np.minimum(y, 1)
        rows = rows.selectExpr("target", "cell", "j", f"if(j = {RESPONSE}, least(v, 1), v) as v", "w")
    options = {"nrounds": 12, "eta": 0.3, "max_depth": depth, "bins": 200}
    got = M.fit_models(rows, obs, "xgb", objective, **options).collect()
    for k in (0, 1):
        shares, rsq = plain(x[k], y[k], 12, 0.3, depth, objective)
        own = {r.j: r for r in got if r.target == f"t{k}"}
        assert set(own) == set(shares) | {-1}
        assert own[-1].rsq == pytest.approx(rsq, abs=1e-9)
        for j, v in shares.items():
            assert [own[j].gain, own[j].cover, own[j].frequency] == pytest.approx(v, abs=1e-9)


def test_usual_rounds(design, dense):
    rows, obs = design
    got = {(r.target, r.j): r for r in M.fit_models(rows, obs, "xgb").collect()}
    assert all(got[t, -1].rsq > 0.8 for t in ("t0", "t1"))
    assert sum(r.gain for k, r in got.items() if k[0] == "t0" and k[1] > 0) == pytest.approx(1)


def test_slices_bound_what_a_task_sends():
    large = [(f"t{i}", list(range(1, 500)), 10) for i in range(20)]
    parts = list(boosting._slices(large, boosting.Options(), 4))
    size = 16 * (499 * 129 + 1) * 2
    assert sum(map(len, parts)) == 20 and all(len(p) * size <= max(size, boosting.SENT) for p in parts)


def test_empty_design(spark, design):
    rows, obs = design
    assert M.fit_models(rows.filter("false"), obs, "xgb").count() == 0
    with pytest.raises(ValueError):
        M.fit_models(rows, obs, "xgb", "other")


def test_histograms_are_sums_by_place_and_root_weights_are_added_once():
    rng, bins = np.random.default_rng(5), 4
    js = [np.flatnonzero(rng.random(3) < 0.6) + 1 for _ in range(40)]
    own = [rng.integers(-bins, bins + 1, len(j)) for j in js]
    table = pa.table({"y": rng.random(40), "w": rng.random(40), "js": pa.array(js, pa.list_(pa.int32())),
                      "bins": pa.array(own, pa.list_(pa.int32()))})
    held = boosting.Held(table, np.arange(1, 4), bins)
    slot, g = rng.integers(-1, 2, 40), rng.normal(size=40)
    for slots, n, values in ((np.zeros(40, int), 1, (g, held.w)), (slot, 2, (g, held.w)), (slot, 2, (g, g * g))):
        want = np.zeros((n, 2, 3 * (2 * bins + 1) + 1))
        for k, v in enumerate(values):
            for r in np.flatnonzero(slots >= 0):
                want[slots[r], k, -1] += v[r]
                for j, b in zip(js[r], own[r]):
                    want[slots[r], k, (j - 1) * (2 * bins + 1) + b + bins] += v[r]
        assert np.allclose(held.histograms(slots, n, values), want)
    assert held.weights is not None      # not summed again by the next tree
    for cut in range(-bins, bins + 1):
        left = [dict(zip(j, b)).get(2, 0) <= cut for j, b in zip(js, own)]
        assert (held.goes_left(np.zeros(40, int), 0, 1, cut) == left).all()
