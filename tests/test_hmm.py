"""Hidden chains: transfer matrices over blocks and chunks against a plain pass over the whole series."""

import math

import numpy as np
import pandas as pd
import pytest

from barloom.plans import hmm, models


def plain(x, m):
    """Posterior, most likely path and log-likelihood of one series, row by row in log space."""
    lp, lt = hmm.log_density(x, m), np.log(m.trans + 1e-300)
    n, k = lp.shape
    add = lambda v: np.logaddexp.reduce(v, axis=0)
    a, b, d, back = np.empty((n, k)), np.zeros((n, k)), np.empty((n, k)), np.zeros((n, k), int)
    a[0] = d[0] = np.log(m.start + 1e-300) + lp[0]
    for t in range(1, n):
        a[t] = add(a[t - 1][:, None] + lt) + lp[t]
        back[t] = (d[t - 1][:, None] + lt).argmax(0)
        d[t] = (d[t - 1][:, None] + lt).max(0) + lp[t]
    for t in range(n - 2, -1, -1):
        b[t] = add((lt + (lp[t + 1] + b[t + 1])[None]).T)
    ll = add(a[-1])
    path = [int(d[-1].argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.exp(a + b - ll), np.array(path[::-1]), ll


def series(n, seed):
    r = np.random.default_rng(seed)
    s = np.zeros(n, int)
    for t in range(1, n):
        s[t] = s[t - 1] if r.random() < 0.9 else r.integers(0, 3)
    x = r.normal(size=(n, 2)) * 0.7 + np.array([[0, 0], [3, 0], [0, 3]])[s]
    return s, x


@pytest.fixture(scope="module")
def rows(spark):
    parts = []
    for pair, n, seed in (("long", 1000, 1), ("short", 40, 2), ("one", 1, 3)):
        s, x = series(n, seed)
        parts.append(pd.DataFrame({"pair": pair, "timeframe": "1h", "swing_no": range(1, n + 1), "u": x[:, 0], "v": x[:, 1], "true": s}))
    return spark.createDataFrame(pd.concat(parts, ignore_index=True)).cache()


@pytest.mark.parametrize(("block", "chunk"), [(32768, 128), (64, 16), (100, 7)])
def test_one_step_equals_a_plain_pass(rows, block, chunk, monkeypatch):
    monkeypatch.setattr(hmm, "CHUNK", chunk)
    m = hmm.Chain(np.array([[-0.5, -0.4], [1.5, -0.6], [-0.7, 1.4]]), np.full((3, 2), 0.5), np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.05, 0.05, 0.9]]), np.array([0.5, 0.3, 0.2]))
    blocks = hmm._Blocks(rows, ["u", "v"], ["pair", "timeframe", "swing_no"], "swing_no", block)
    whole = blocks.rows.toPandas()
    got = blocks.connected(m).groupBy("pair", "timeframe", "_blk").applyInPandas(hmm._decode(m, ["u", "v"], blocks.keep), "pair string, timeframe string, swing_no long, regime int, probability double").toPandas()
    ll = blocks.connected(m).groupBy("pair").agg({"ll": "max"}).toPandas().set_index("pair").iloc[:, 0]
    for pair, g in whole.sort_values("swing_no").groupby("pair"):
        post, path, want = plain(g[["u", "v"]].to_numpy(), m)
        mine = got[got.pair == pair].sort_values("swing_no")
        np.testing.assert_array_equal(mine["regime"], path)
        np.testing.assert_allclose(mine["probability"], post.max(1), rtol=1e-9)
        assert math.isclose(blocks.connected(m).where(f"pair = '{pair}' and ll <> 0").first()["ll"] if pair in ll.index else 0, want, rel_tol=1e-9)


def test_fit_rises_and_does_not_depend_on_blocks(rows):
    fits = [hmm.fit_chain(rows, ["u", "v"], ["true"], states=3, block_rows=b, centers=np.array([[-0.5, -0.5], [1.0, -0.5], [-0.5, 1.0]])) for b in (32768, 64)]
    for (_, a) in fits:
        assert all(y >= x - 1e-9 for x, y in zip(a["log_likelihood"], a["log_likelihood"][1:])) and 2 < len(a["log_likelihood"]) < 200
    np.testing.assert_allclose(fits[0][1]["log_likelihood"], fits[1][1]["log_likelihood"], rtol=1e-9)
    got = fits[1][0].toPandas()
    best = got.groupby("regime")["true"].agg(lambda v: v.mode()[0])
    assert (got["regime"].map(best) == got["true"]).mean() > 0.95 and got["probability"].between(0.3, 1.0001).all()


def test_few_rows(rows):
    out, model = hmm.fit_chain(rows.where("pair = 'one'"), ["u", "v"])
    assert out.count() == 0 and model["log_likelihood"] == []
    assert len(hmm.fit_chain(rows.where("pair = 'short' and swing_no <= 14"), ["u", "v"])[1]["means"]) == 2


def test_states_per_bar(bars):
    swings = models.swing_registry(bars).cache()
    regimes, model = models.hmm_regimes(swings)
    assert model["means"].shape[1] == 17 and len(model["means"]) <= 6
    got = models.hmm_states(bars, regimes.cache(), block_rows=64).toPandas().sort_values(["pair", "ts"])
    for _, g in got.groupby("pair"):
        changed = (g["hmm_regime"] != g["hmm_regime"].shift(1)).astype(int)
        assert (g["regime_changed"] == changed).all()
        assert (g["bars_in_regime"] == g.groupby(changed.cumsum()).cumcount() + 1).all()
