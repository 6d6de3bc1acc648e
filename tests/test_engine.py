"""Panels, metrics, back-tests, combiners, library and mining on small panels."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantaloom import backtest as bt
from quantaloom import combine as cb
from quantaloom import queries
from quantaloom.functions import analytics, ic, performance
from quantaloom.library import FactorLibrary, FactorRecord, Screened, dedup, screen
from quantaloom.memory import ExperienceMemory, domain
from quantaloom.mine import Miner, Proposal, parse_proposals
from quantaloom.plans.compiler import evaluate
from quantaloom.service import Service
from quantaloom.sources.fundamentals import asof_join, join_daily
from quantaloom.sources.panel import Panel, build_panel, densify, parse_date, read_bars, with_forward
from quantaloom.sources.stores import constituents, load_panel, read_records, save_panel, strongest

DAY = dt.date(2021, 1, 4)


def bars(spark, m=12, t=90, drift=0.0):
    rng = np.random.default_rng(1)
    price = 10 * np.exp(np.cumsum(rng.normal(0, 0.02, (m, t)) + drift * np.arange(m)[:, None] / m, 1))
    rows = [
        (f"{i:06d}.SZ", DAY + dt.timedelta(k), *(float(price[i, k] * f) for f in (0.99, 1.02, 0.97, 1)), float(rng.integers(1, 99)), None)
        for i in range(m) for k in range(t)
    ]
    return spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double, amount double")


@pytest.fixture(scope="module")
def panel(spark):
    p = with_forward(build_panel(bars(spark, drift=0.02).withColumn("amount", F.col("close") * F.col("volume")), min_days=60))
    return Panel(p.df.cache(), p.n_dates)


def series(spark, r, name="x"):
    return spark.createDataFrame([(name, DAY + dt.timedelta(i), i, None if v is None else float(v)) for i, v in enumerate(r)], "name string, date date, t int, r double")


def test_panel(spark, panel, tmp_path):
    row = panel.df.where("t = 5").first()
    assert panel.n_dates == 90 and "." not in row.code and row.vwap == pytest.approx(row.close)
    holes = bars(spark, 3, 70).where("not (code = '000001.SZ' and day(date) = 9)")
    assert build_panel(holes, min_days=50).n_dates == 70 - 3
    with pytest.raises(ValueError, match="common dates"):
        build_panel(holes.where("date < '2021-02-10'"), min_days=5)
    dense = densify(holes)
    assert dense.df.count() == 3 * 70 and dense.df.where("close is null").count() == 3
    save_panel(panel, f"{tmp_path}/p")
    assert load_panel(spark, f"{tmp_path}/p").n_dates == 90 and load_panel(spark, f"{tmp_path}/none") is None
    assert panel.head(4).df.select("code").distinct().count() == 4


def test_vendor_bars(spark, tmp_path):
    spark.createDataFrame([("1", 20210104, "1.5", 2.0), ("1", 20210105, "bad", 3.0)], "ts_code string, trade_date int, close string, vol double").write.parquet(f"{tmp_path}/b")
    got = read_bars(spark, f"{tmp_path}/b").orderBy("date").collect()
    assert [(r.close, r.amount) for r in got] == [(1.5, 3.0), (None, None)]
    dates = spark.createDataFrame([("20210131",), ("2021-01-31 00:00:00",), ("20211399",), (None,)], "d string").select(parse_date(F.col("d")).alias("d")).collect()
    assert [r.d for r in dates] == [dt.date(2021, 1, 31)] * 2 + [None] * 2
    assert {r.code for r in constituents(spark.createDataFrame([(1,), (600000,)], "code int")).collect()} == {"000001", "600000"}


def test_asof_and_daily_joins(spark):
    left = spark.createDataFrame([("a", dt.date(2021, 3, d), i) for i, d in enumerate((1, 15, 17, 31))] + [("b", dt.date(2021, 3, 1), 0)], "code string, date date, t int")
    right = spark.createDataFrame([("a", dt.date(2021, 1, 15), 1.0, 5), ("a", dt.date(2021, 1, 31), None, 6), ("a", None, 9.0, 9)], "code string, report_date date, eps double, n int")
    got = {(r.code, r.t): (r.eps, r.n) for r in asof_join(left, right, ["eps", "n", "missing"]).collect()}
    assert got == {("a", 0): (1.0, 5), ("a", 1): (1.0, 5), ("a", 2): (None, 6), ("a", 3): (None, 6), ("b", 0): (None, None)}
    assert "eps" in join_daily(left, left.withColumn("eps", F.lit(1.0)), ["eps"]).columns
    assert "eps" not in join_daily(left, left.where("code = 'a'").withColumn("eps", F.lit(1.0)), ["eps"]).columns


def test_rank_ic(spark, panel):
    wide = evaluate(panel.df, {"good": "cs_rank(close)", "odd": "ts_mean(returns, 3)"}, panel.n_dates, keep=["fwd"])
    long = ic.to_long(wide, ["good", "odd"])
    got = {(r["name"], r.t): r.ic for r in ic.ic_series(long).collect()}
    frame = wide.where("t = 40").toPandas()
    a, b = (frame[c].rank(method="first").to_numpy() for c in ("odd", "fwd"))
    assert got["odd", 40] == pytest.approx(np.corrcoef(a, b)[0, 1])
    s = {r["name"]: r for r in ic.ic_summary(ic.ic_series(long)).collect()}
    v = np.array([x for (n, _), x in got.items() if n == "odd" and x is not None])
    assert s["odd"].ic_mean == pytest.approx(v.mean()) and s["odd"].icir == pytest.approx(v.mean() / v.std()) and s["odd"].n_days == len(v)
    mono = ic.to_long(evaluate(panel.df, {"x": "close", "y": "power(close, 3)"}, panel.n_dates, keep=["fwd"]), ["x", "y"])
    pair = ic.ic_series(mono).groupBy("t").agg(F.max("ic") - F.min("ic")).collect()
    assert max(r[1] or 0 for r in pair) < 1e-12
    assert ic.ic_series(long, least=13).where("ic is not null").count() == 0


def test_thresholds():
    assert ic.hlz_threshold(1) == 1.96 and ic.hlz_threshold(10) == 3.0 and ic.hlz_threshold(22110) == pytest.approx(4.73, abs=0.02)


def test_out_of_sample(spark):
    rows = [("x", DAY, t, 20, 0.1 if t < 60 else 0.05) for t in range(100)]
    s = spark.createDataFrame(rows, "name string, date date, t int, n int, ic double")
    r = ic.out_of_sample(s, 100).first()
    assert (r.is_ic, r.oos_ic, r.oos_days, r.valid) == (pytest.approx(0.1), pytest.approx(0.05), 35, True) and r.degradation == pytest.approx(0.5)
    assert not ic.out_of_sample(s, 50).first().valid


def test_smoothing_is_a_centred_convolution(spark):
    v = np.random.default_rng(2).normal(size=60)
    s = spark.createDataFrame([("x", DAY + dt.timedelta(i), i, 20, float(x)) for i, x in enumerate(v)], "name string, date date, t int, n int, ic double")
    got = [r.smooth for r in ic.smoothed(s).orderBy("date").collect()]
    assert np.allclose(got, np.convolve(v, np.ones(20) / 20, "same"))
    h = ic.histogram(s, 10).collect()
    assert sum(r.density for r in h) * (v.max() - v.min()) / 10 == pytest.approx(1)


def fold_cap(r, most):
    out, equity, peak = [], 1.0, 1.0
    for x in r:
        if x is not None:
            if (peak - equity * (1 + x)) / (peak + 1e-10) > most:
                x = 0.0
            equity *= 1 + x
            peak = max(peak, equity)
        out.append(x)
    return out


def test_overlays(spark):
    rng = np.random.default_rng(3)
    r = [None if i % 13 == 5 else float(x) for i, x in enumerate(rng.normal(0, 0.03, 120))]
    got = [x.r for x in performance.drawdown_cap(series(spark, r), 0.05).orderBy("date").collect()]
    assert got == pytest.approx(fold_cap(r, 0.05))
    capped = performance.performance(performance.drawdown_cap(series(spark, r), 0.05)).first()
    assert capped.max_drawdown >= -0.05 - 1e-9
    scaled = [x.r for x in performance.vol_target(series(spark, r), 0.1).orderBy("date").collect()]
    for t in (3, 40, 90):
        past = np.array([x for x in r[max(0, t - 20) : t] if x is not None])
        want = r[t] if len(past) < 5 else r[t] * min(1, 0.1 / (past.std() * math.sqrt(252)))
        assert scaled[t] == pytest.approx(want)


def test_performance_and_events(spark):
    r = [0.01, -0.02, 0.005, None, 0.03, -0.001, 0.0, -0.05, 0.01, 0.02, 0.03, 0.01]
    v = np.array([x for x in r if x is not None])
    p = performance.performance(series(spark, r)).first()
    curve = np.cumprod(1 + v)
    assert p.sharpe == pytest.approx(v.mean() / v.std() * math.sqrt(252)) and p.total_return == pytest.approx(curve[-1] - 1)
    assert p.max_drawdown == pytest.approx(((curve - np.maximum.accumulate(curve)) / np.maximum.accumulate(curve)).min())
    assert p.win_ratio == pytest.approx((v > 0).mean()) and p.annual_return == pytest.approx(curve[-1] ** (252 / len(v)) - 1)
    e = analytics.drawdown_events(series(spark, r)).orderBy("started").collect()
    assert [(x.started, x.over) for x in e] == [(DAY + dt.timedelta(1), True), (DAY + dt.timedelta(7), True)] and e[1].depth < -0.04
    assert performance.performance(series(spark, [None, None])).first().n_days == 0
    tail = analytics.tail_risk(series(spark, r)).first()
    assert tail.cvar == pytest.approx(-0.05) and tail.profit_factor == pytest.approx(v[v > 0].sum() / -v[v < 0].sum())
    assert {x.period: round(x.r, 9) for x in analytics.compounded(series(spark, r), "yyyy").collect()} == {"2021": round(curve[-1] - 1, 9)}


def test_quantile_backtest_with_ties(spark):
    rows = [("x", f"c{i:02d}", DAY, 0, float(i // 2), i / 100) for i in range(12)] + [("x", "c99", DAY, 0, None, 9.0)]
    rows += [("x", f"c{i:02d}", DAY + dt.timedelta(1), 1, 1.0, 0.1 if i < 9 else None) for i in range(12)]
    s = spark.createDataFrame(rows, "name string, code string, date date, t int, value double, fwd double")
    ls = {r.t: r.r for r in bt.long_short(s).collect()}
    assert ls == {0: pytest.approx((0.10 + 0.11) / 2 - (0.0 + 0.01) / 2), 1: None}
    w = {(r.code, r.date): r.w for r in bt.positions(s).collect()}
    assert w["c11", DAY] == 0.5 and w["c00", DAY] == -0.5 and w["c05", DAY] == 0 and w["c99", DAY] == 0
    assert bt.group_returns(s).count() == 5
    assert performance.turnover(bt.positions(s)).first().turnover == pytest.approx(2.0)


def test_combinations(spark, panel):
    wide = evaluate(panel.df, {"a": "cs_rank(close)", "b": "neg(cs_rank(close))", "c": "ts_mean(returns, 5)"}, panel.n_dates, keep=["fwd"]).cache()
    names = ["a", "b", "c"]
    w = bt.combination_weights({"a": (0.2, 1.0), "b": (-0.1, -2.0)}, ["a", "b", "c"], "ic_weighted")
    assert w == {"a": pytest.approx(2 / 3), "b": pytest.approx(-1 / 3), "c": 0}
    assert bt.combination_weights({}, ["a", "b"], "anything") == {"a": 0.5, "b": 0.5}
    for method in ("equal", "icir_weighted"):
        assert bt.combine(wide, names, method).where("value is null").count() == 0
    mixed = bt.combine(wide, names, "adaptive")
    assert mixed.where("value is not null").agg(F.min("t")).first()[0] == 60
    report = cb.walk_forward(wide, names, train=40, step=20, purge=5, least=10)
    assert report.folds == 3 and len(report.ic) > 30 and sum(report.importance.values()) == pytest.approx(1)
    with pytest.raises(ValueError, match="Not enough data"):
        cb.walk_forward(wide, names)
    with pytest.raises(ValueError, match="backend"):
        cb.walk_forward(wide, names, backend="none", train=40)
    assert bt.library_backtest(wide, names, "ic_weighted", target_vol=0.1, max_drawdown=0.1).count() == 1


def test_ridge_from_moments():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3)) * [1, 5, 0.1] + 2
    y = x @ [0.5, -0.2, 3] + rng.normal(size=500)
    z = np.c_[np.ones(500), x, y]
    beta, b0 = cb.ridge_coefficients(z.T @ z, 1.0)
    s = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(s.T @ s + np.eye(3), s.T @ (y - y.mean()))
    assert np.allclose(beta * x.std(0), want) and b0 == pytest.approx(y.mean() - beta @ x.mean(0))


def many_signals(spark, m=20, t=80, k=12, seed=5):
    """A wide frame of k signals with gaps, and the same as arrays [dates, assets, signals] and [dates, assets]."""
    rng = np.random.default_rng(seed)
    x, y = np.round(rng.normal(size=(t, m, k)), 1), rng.normal(size=(t, m))
    x[rng.random(x.shape) < 0.1] = np.nan
    y[rng.random(y.shape) < 0.05] = np.nan
    none = lambda v: None if np.isnan(v) else float(v)
    rows = [(f"{j:03d}", DAY + dt.timedelta(i), i, none(y[i, j]), *map(none, x[i, j])) for i in range(t) for j in range(m)]
    return spark.createDataFrame(rows, "code string, date date, t int, fwd double, " + ", ".join(f"s{i} double" for i in range(k))), x, y


def test_ic_of_columns_equals_ic_of_rows(spark):
    wide, _, _ = many_signals(spark, m=14)
    names = [f"s{i}" for i in range(12)]
    long = ic.to_long(wide, names)
    for ties, of in (("code", ic.ic_series), ("average", ic.spearman_series)):
        a, b = ({(r.name, r.t): (r.n, r.ic) for r in d.select("name", "t", "n", "ic").collect()} for d in (ic.ic_wide(wide, names, ties=ties), of(long)))
        assert a.keys() == b.keys() and any(v[1] is None for v in a.values())
        assert all(a[k][0] == b[k][0] and a[k][1] == (None if b[k][1] is None else pytest.approx(b[k][1], abs=1e-12)) for k in a)


def test_adaptive_combination_against_direct_solution(spark):
    wide, x, y = many_signals(spark)
    names = [f"s{i}" for i in range(12)]
    got = {(r.t, int(r.code)): r.value for r in cb.adaptive_combine(wide, names, lookback=30, top_k=3, min_train=40).collect()}
    ics = {(r.name, r.t): r.ic for r in ic.ic_wide(wide, names).collect()}
    series = np.array([[np.nan if ics.get((n, t)) is None else ics[n, t] for t in range(80)] for n in names])
    visits, w = np.zeros(12), None
    for t in range(80):
        if t >= 40 and t % 5 == 0:
            past = series[:, t - 30 : t]
            mean, sd = np.nanmean(past, 1), np.nanstd(past, 1)
            chosen = np.argsort(-(mean**2 / sd + 0.1 / (1 + visits)), kind="stable")[:3]
            visits[chosen] += 1
            a, b = np.nan_to_num(x[t - 30 : t][..., chosen]).reshape(-1, 3), y[t - 30 : t].ravel()
            a, b = a[~np.isnan(b)], b[~np.isnan(b)]
            w = np.zeros(12)
            w[chosen] = np.linalg.solve(a.T @ a + 1e-4 * np.eye(3), a.T @ b)
        for j in range(20):
            assert got[t, j] is None if w is None else got[t, j] == pytest.approx(np.nan_to_num(x[t, j]) @ w)


def test_walk_forward_ridge_against_direct_solution(spark):
    wide, x, y = many_signals(spark, m=40, t=90)
    names = [f"s{i}" for i in range(12)]
    r = cb.walk_forward(wide, names, train=40, step=20, purge=5, least=5)
    ok = ~np.isnan(x).any(2) & ~np.isnan(y)
    ok &= (ok.sum(1) >= 5)[:, None]
    want = []
    for s in range(45, 90, 20):
        a, b = x[max(0, s - 40) : s - 5][ok[max(0, s - 40) : s - 5]], y[max(0, s - 40) : s - 5][ok[max(0, s - 40) : s - 5]]
        z = (a - a.mean(0)) / a.std(0)
        beta = np.linalg.solve(z.T @ z + np.eye(12), z.T @ (b - b.mean()))
        for t in range(s, min(s + 20, 90)):
            if ok[t].sum() >= 5:
                told = (x[t][ok[t]] - a.mean(0)) / a.std(0) @ beta
                want.append(np.corrcoef(told.argsort().argsort(), y[t][ok[t]].argsort().argsort())[0, 1])
    assert r.folds == 3 and np.allclose(r.ic, want) and set(r.individual) == set(names)


def test_moments_of_windows(spark):
    wide, x, y = many_signals(spark)
    names = [f"s{i}" for i in range(12)]
    filled = wide.select("t", "fwd", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
    windows = [(0, 10, np.array([3, 1])), (5, 80, np.arange(12)), (79, 79, np.array([0]))]
    for (a, b, cols), m in zip(windows, cb.window_moments(filled, names, windows), strict=True):
        z = np.concatenate([np.ones((b - a, 20, 1)), np.nan_to_num(x[a:b])[..., cols], y[a:b, :, None]], 2).reshape(-1, len(cols) + 2)
        z = z[~np.isnan(z).any(1)]
        assert np.allclose(m, z.T @ z)


def test_registered_screen_takes_every_candidate(spark, panel, monkeypatch):
    asked = []
    monkeypatch.setattr(queries.fixtures, "panel", lambda *_: Panel(panel.df.select("*"), panel.n_dates))
    monkeypatch.setattr(queries.lib, "screen", lambda p, formulas, **_: asked.extend(formulas) or [Screened("x", 0.1, 0.2, 3.0, 0.1, np.zeros(2))])
    assert queries.QUERIES["screen_factors"].run(spark, "").count() == 1 and queries.QUERIES["screen_near_ties"].run(spark, "").count() == 1
    assert sorted(asked) == queries.candidates(1) and len(asked) == 864  # deeper ones take long, see the README


def test_screen_in_batches_equals_one_batch(panel):
    chosen = ["cs_rank(close)", "ts_mean(close, 5)", "ts_std(returns, 10)", "cs_rank(volume)", "neg(close)"]
    one, many = (screen(panel, chosen, ic_threshold=0.0, batch=n) for n in (64, 2))
    assert len(one) == 5 and [(s.expression, round(s.ic_mean, 12)) for s in one] == [(s.expression, round(s.ic_mean, 12)) for s in many]


def test_registered_walk_forward_has_the_reference_configuration(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(queries, "_wide", lambda *_: None)
    monkeypatch.setattr(queries.cb, "walk_forward", lambda *_, **how: asked.update(how) or cb.CombinerReport("gbt", np.ones(3), {}, {}, 4))
    assert queries.walked(spark, "", "gbt").count() == 1
    assert (asked["step"], asked["trees"]) == (60, 300) and len(cb.folds(345, asked["train"], asked["step"])) == 4


def test_screen_library_mining_service(spark, panel, tmp_path):
    found = screen(panel, ["cs_rank(close)", "neg(cs_rank(close))", "ts_mean(close, 90) - ts_mean(close, 90)", "nope(close)"], ic_threshold=0.01)
    assert {s.expression for s in found} >= {"cs_rank(close)"} and found[0].ic_mean >= found[-1].ic_mean
    assert all(s.ic_mean > 0 for s in screen(panel, ["cs_rank(close)", "neg(cs_rank(close))"], ic_threshold=0.01, positive_only=True))
    lib, memory = FactorLibrary(tmp_path / "lib.json"), ExperienceMemory(tmp_path / "mem.json")

    class Fixed:
        def propose(self, context, n):
            return [Proposal("cs_rank(close)", "level"), Proposal("cs_rank(close * 2)"), Proposal("bad(close)"), Proposal("ts_delta(close, 89)")]

        def insights(self, admitted, rejected):
            return ["levels work"]

    lines = []
    service = Service(panel, lib, memory)
    service.listen(lines.append)
    service.listen(lambda _: 1 / 0)
    miner = service.start(proposer=Fixed(), max_rounds=1, ic_threshold=0.001, corr_threshold=0.9)
    lib_check = miner.library.check
    miner.library.check = lambda *a, **k: lib_check(*a, **(k | {"use_hlz": False}))
    miner.run()
    assert [f.expression for f in lib.factors] == ["cs_rank(close)"] and lib.factors[0].factor_id == "F000001"
    codes = {n.text: n.code for n in memory.notes["rejected"]}
    assert codes == {"cs_rank(close * 2)": "alike", "bad(close)": "invalid", "ts_delta(close, 89)": "missing"}
    assert len(service.listeners) == 1 and lines and service.status()["status"] == "completed"
    assert len(FactorLibrary(tmp_path / "lib.json")) == 1 and ExperienceMemory(tmp_path / "mem.json").tally.admitted == 1
    detail = service.detail("F000001")["analysis"]
    assert detail["n_days"] > 50 and set(detail["group_cumulative_returns"]) == {f"Q{i}" for i in range(1, 6)}
    assert "error" in service.detail("F9") and service.backtest(method="equal")["name"].startswith("Library (1")
    assert strongest(read_records(spark, str(tmp_path / "lib.json")), 1).first().expression == "cs_rank(close)"
    lib.admit(FactorRecord("cs_rank(open)"), replace=0)
    assert [(f.expression, f.factor_id) for f in lib.factors] == [("cs_rank(open)", "F000002")]


def test_dedup_and_memory(tmp_path):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=50), rng.normal(size=50)
    ranked = [Screened(n, 1 - i / 10, 0, 0, 0, x) for i, (n, x) in enumerate((("a", a), ("a2", a + 0.01 * b), ("minus a", -a), ("b", b), ("flat", a * 0)))]
    assert [s.expression for s in dedup(ranked)] == ["a", "b", "flat"] and len(dedup(ranked, max_keep=1)) == 1
    now = [0.0]
    m = ExperienceMemory(tmp_path / "m.json", clock=lambda: now[0])
    m.formation([{"expression": f"ts_std(close, {i})", "admitted": i < 40, "code": "alike", "figures": {"ic": 0.1}, "logic": ""} for i in range(100)])
    assert m.tally.fullness() == {"volatility": 1.0} and (len(m.notes["worked"]), len(m.notes["alike"]), len(m.notes["rejected"])) == (30, 50, 30)
    assert "volatility: 100% full" in m.retrieve(3)["state"] and m.retrieve(3)["worked"].splitlines()[-1] == "- ts_std(close, 39): alike, ic 0.1"
    again = ExperienceMemory(tmp_path / "m.json")
    assert again.dump() == m.dump() and len(again.snapshot()["rejected"]) == 10
    now[0] = 8 * 86400.0
    m.evolution(["x", "x", "y"])
    assert not m.notes["worked"] and [n.text for n in m.notes["insights"]] == ["x", "y"]
    assert domain("ts_delta(volume, 3)") == "momentum" and domain("abs(open)") == "other"
    assert [p.expression for p in parse_proposals('text [{"expression": "cs_rank(close)", "logic": "l"}, {"expression": "bad("}, "abs(open)"] more')] == ["cs_rank(close)", "abs(open)"]
    assert parse_proposals("no json") == [] and parse_proposals("[broken") == []
    (tmp_path / "m.json").write_text("{broken")
    assert ExperienceMemory(tmp_path / "m.json").tally.proposed == 0
