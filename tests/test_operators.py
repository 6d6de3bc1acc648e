"""Operators against a NumPy restatement on small panels with gaps, constants and ties."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from quantaloom.plans.compiler import evaluate

M, T = 4, 12


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(M, T)), rng.normal(size=(M, T)) * 3
    x[0, [0, 3, 4]] = np.nan
    x[1] = 2.0
    y[2, 5:9] = np.nan
    x[3] = np.round(x[3])
    y[3] = np.nan
    return x, y


@pytest.fixture(scope="module")
def panel(spark, data):
    x, y = data
    rows = [(f"a{i}", dt.date(2020, 1, 1) + dt.timedelta(t), t, None if np.isnan(x[i, t]) else float(x[i, t]), None if np.isnan(y[i, t]) else float(y[i, t])) for i in range(M) for t in range(T)]
    return spark.createDataFrame(rows, "code string, date date, t int, x double, y double").repartition(3).cache()


def windows(a, d):
    for t in range(a.shape[1]):
        yield t, a[:, max(0, t - d + 1) : t + 1]


def nanagg(f, a, d, need=1):
    out = np.full(a.shape, np.nan)
    for t, w in windows(a, d):
        for i in range(len(a)):
            v = w[i][~np.isnan(w[i])]
            if len(v) >= need:
                out[i, t] = f(v)
    return out


def mean(a, d):
    return nanagg(np.mean, a, d)


def corr(x, y, d):
    mx, my = mean(x, d), mean(y, d)
    sx, sy = (np.sqrt(np.maximum(mean(a * a, d) - m * m, 1e-10)) for a, m in ((x, mx), (y, my)))
    return np.clip((mean(x * y, d) - mx * my) / (sx * sy), -1, 1)


def rank(x, d):
    out = np.full(x.shape, np.nan)
    for t, w in windows(x, d):
        for i in range(len(x)):
            v, n = w[i][~np.isnan(w[i])], (~np.isnan(w[i])).sum()
            if not np.isnan(x[i, t]):
                less, same = (v < x[i, t]).sum(), (v == x[i, t]).sum()
                out[i, t] = 0 if n == 1 else 2 * ((less + (same - 1) / 2) / (n - 1) - 0.5)
    return out


def newest(pick, x, d):
    out = np.full(x.shape, np.nan)
    for t, w in windows(x, d):
        for i in range(len(x)):
            if (~np.isnan(w[i])).any():
                out[i, t] = min(k for k in range(w.shape[1]) if w[i][::-1][k] == pick(w[i][~np.isnan(w[i])]))
    return out


def moment(x, d, p):
    e = x - mean(x, d)
    m2 = mean(e**2, d)
    return mean(e**3, d) / (m2 + 1e-10) ** 1.5 if p == 3 else mean(e**4, d) / (m2**2 + 1e-10) - 3


def full(a, d):
    a = a.copy()
    a[:, : d - 1] = np.nan
    return a


def residual(x, y, d):
    out = np.full(x.shape, np.nan)
    for t in range(d - 1, T):
        for i in range(len(x)):
            wx, wy = x[i, t - d + 1 : t + 1], y[i, t - d + 1 : t + 1]
            if np.isnan(wx).all() or np.isnan(wy).all():
                continue
            dx, dy = wx - np.nanmean(wx), wy - np.nanmean(wy)
            b = np.nansum(dx * dy) / (np.nansum(dx**2) + 1e-10)
            out[i, t] = y[i, t] - b * x[i, t] - (np.nanmean(wy) - b * np.nanmean(wx))
    return out


def lag(x, d):
    out = np.full(x.shape, np.nan)
    out[:, d:] = x[:, :-d]
    return out


def cross(f, x):
    out = np.full(x.shape, np.nan)
    for t in range(T):
        ok = ~np.isnan(x[:, t])
        out[ok, t] = f(x[ok, t])
    return out


W = np.arange(1, 5) / 10
CASES = {
    "ts_mean(x, 4)": lambda x, y: mean(x, 4),
    "ts_sum(x, 4)": lambda x, y: nanagg(np.sum, x, 4),
    "ts_min(x, 4)": lambda x, y: nanagg(np.min, x, 4),
    "ts_max(x, 4)": lambda x, y: nanagg(np.max, x, 4),
    "ts_std(x, 4)": lambda x, y: nanagg(lambda v: v.std(ddof=1), x, 4, 2),
    "ts_lag(x, 3)": lambda x, y: lag(x, 3),
    "ts_delta(x, 3)": lambda x, y: x - lag(x, 3),
    "ts_rank(x, 4)": lambda x, y: rank(x, 4),
    "ts_argmax(x, 4)": lambda x, y: newest(np.max, x, 4),
    "ts_argmin(x, 4)": lambda x, y: newest(np.min, x, 4),
    "ts_skew(x, 4)": lambda x, y: moment(x, 4, 3),
    "ts_kurt(x, 4)": lambda x, y: moment(x, 4, 4),
    "ts_cov(x, y, 4)": lambda x, y: mean(x * y, 4) - mean(x, 4) * mean(y, 4),
    "ts_corr(x, y, 4)": lambda x, y: corr(x, y, 4),
    "ts_rsquare(x, y, 4)": lambda x, y: corr(x, y, 4) ** 2,
    "ts_product(x, 4)": lambda x, y: full(np.stack([[np.nanprod(x[i, max(0, t - 3) : t + 1]) for t in range(T)] for i in range(M)]), 4),
    "ts_decay_linear(x, 4)": lambda x, y: full(np.stack([[np.nansum(x[i, max(0, t - 3) : t + 1] * W[-min(4, t + 1) :]) for t in range(T)] for i in range(M)]), 4),
    "ts_regression_residual(x, y, 4)": lambda x, y: residual(x, y, 4),
    "cs_rank(y)": lambda x, y: cross(lambda v: (np.argsort(np.argsort(v, kind="stable"), kind="stable") + 1) / len(v), y),
    "cs_zscore(x)": lambda x, y: cross(lambda v: (v - v.mean()) / (v.std() + 1e-10), x),
    "cs_scale(x)": lambda x, y: cross(lambda v: v / (np.abs(v).sum() + 1e-10), x),
    "cs_demean(x)": lambda x, y: cross(lambda v: v - v.mean(), x),
    "log(x)": lambda x, y: np.log(np.abs(x) + 1e-10),
    "sqrt(x)": lambda x, y: np.sqrt(np.abs(x)),
    "sign(x)": lambda x, y: np.sign(x),
    "abs(x) + -x": lambda x, y: np.abs(x) - x,
    "inv(x - 2)": lambda x, y: 1 / ((x - 2) + 1e-10 * np.sign(x - 2 + 1e-10)),
    "x / y": lambda x, y: x / (y + 1e-10 * np.sign(y + 1e-10)),
    "x * y": lambda x, y: x * y,
    "power(x, 2.5)": lambda x, y: (np.abs(x) + 1e-10) ** 2.5 * np.sign(x),
    "max(x, y)": lambda x, y: np.fmax(x, y),
    "min(x, y)": lambda x, y: np.fmin(x, y),
    "3 + 4": lambda x, y: np.full(x.shape, 7.0),
    "ts_mean(x, 500)": lambda x, y: mean(x, T),
    "cs_demean(ts_mean(cs_zscore(x), 3))": lambda x, y: cross(lambda v: v - v.mean(), mean(cross(lambda v: (v - v.mean()) / (v.std() + 1e-10), x), 3)),
}


@pytest.fixture(scope="module")
def found(panel):
    names = {f"c{i}": f for i, f in enumerate(CASES)}
    return evaluate(panel, names, T).toPandas().sort_values(["code", "t"])


@pytest.mark.parametrize("i", range(len(CASES)), ids=list(CASES))
@pytest.mark.filterwarnings("ignore")
def test_against_numpy(found, data, i):
    want = list(CASES.values())[i](*data)
    want = np.where(np.isfinite(want), want, np.nan)
    got = found[f"c{i}"].to_numpy(float).reshape(M, T)
    np.testing.assert_allclose(got, want, rtol=1e-7, atol=2e-6)


def test_full_warm_up(panel, data):
    got = evaluate(panel, {"m": "ts_mean(x, 4)", "k": "ts_argmax(x, 4)", "r": "ts_rank(x, 4)"}, T, full=True).toPandas().sort_values(["code", "t"])
    assert got[got.t < 3][["m", "k", "r"]].isna().all().all()
    x = data[0]
    for i in (0, 2, 3):
        w = x[i, 2:6]
        row = got[(got.code == f"a{i}") & (got.t == 5)].iloc[0]
        assert row.k == np.nanargmax(w)
        if not np.isnan(x[i, 5]):
            v = w[~np.isnan(w)]
            assert row.r == pytest.approx(((v < x[i, 5]).sum() + ((v == x[i, 5]).sum() + 1) / 2) / len(v))


def test_no_look_ahead(panel):
    cut = panel.where("t < 8")
    names = {"a": "ts_corr(x, y, 4)", "b": "cs_rank(ts_mean(x, 3))", "c": "ts_skew(x, 4)"}
    early = evaluate(cut, names, 8).toPandas().sort_values(["code", "t"], ignore_index=True)
    late = evaluate(panel, names, T).where("t < 8").toPandas().sort_values(["code", "t"], ignore_index=True)
    pd.testing.assert_frame_equal(early, late)


def test_one_exchange_for_a_batch(panel):
    names = {f"f{i}": f"{op}(x, {d})" for i, (op, d) in enumerate((o, w) for o in ("ts_mean", "ts_std", "ts_max", "ts_rank") for w in (3, 5, 7))}
    plan = evaluate(panel, names, T)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    chain = evaluate(panel, {"x1": "cs_rank(ts_mean(cs_zscore(x), 3))"}, T)._jdf.queryExecution().executedPlan().toString()
    assert chain.count("Exchange hashpartitioning") == 3


def test_only_needed_columns_are_read(spark, panel, tmp_path):
    panel.write.parquet(f"{tmp_path}/p")
    plan = evaluate(spark.read.parquet(f"{tmp_path}/p"), {"v": "ts_mean(x, 3)"}, T)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<code:string,date:date,t:int,x:double>" in plan
