"""Queries on inputs that the fixtures at their smallest size don't hold, against their SQL twins."""

import datetime as dt
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


def by_sql(name, d):
    con = duckdb.connect()
    for f in os.listdir(d):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")
    return con.sql(entry.oracle_sql()[name])


def test_panel_with_closes_of_zero(spark, tmp_path):
    """A close of zero makes the ratio of vwap to it infinite, or NaN, as in SQL; it is no error."""
    con, day = duckdb.connect(), dt.datetime(2024, 1, 1)
    con.sql("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    values = [(1, 0, 5.0), (1, 0, 0.0), (1, 1, 0.0), (1, 2, 3.0), (2, 0, 4.0), (2, 1, -2.0), (2, 1, 0.0)]
    con.executemany("INSERT INTO e VALUES (?, ?, ?, 'view', ?, '')", [(i, day + dt.timedelta(d, i), u, v) for i, (u, d, v) in enumerate(values)])
    con.sql(f"COPY e TO '{tmp_path}/events.parquet'")
    columns = "code, t, open, close, amount, vwap, returns, fwd"
    got = {tuple(map(repr, r)) for r in entry.queries()["panel_f2"](spark, str(tmp_path)).select(*columns.split(", ")).collect()}
    assert got == {tuple(map(repr, r)) for r in by_sql("panel_f2", tmp_path).select(columns).fetchall()}
    assert {r[5] for r in got} == {"inf", "nan", "-inf", "1.0", "None"}


def test_panel_rounds_as_sql(spark, tmp_path):
    """Ratios that are nearly a half of the last digit are rounded as doubles, as SQL does it, and not by their decimal digits."""
    con, day = duckdb.connect(), dt.datetime(2024, 1, 1)
    con.sql("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    closes = [(u, d, v) for u, c in enumerate((3.17, 9.63, 9.73, 12.81, 13.01)) for d, v in enumerate((6.4, c))]
    pairs = [(9 + u, 0, v) for u, a in enumerate((0.03, 0.13, 3.21, 3.31, 3.51)) for v in (a, 3.2)]
    con.executemany("INSERT INTO e VALUES (?, ?, ?, 'view', ?, '')", [(i, day + dt.timedelta(d, i), u, v) for i, (u, d, v) in enumerate(closes + pairs)])
    con.sql(f"COPY e TO '{tmp_path}/events.parquet'")
    columns = "code, t, close, amount, vwap, returns, fwd"
    got = {tuple(map(repr, r)) for r in entry.queries()["panel_f2"](spark, str(tmp_path)).select(*columns.split(", ")).collect()}
    assert got == {tuple(map(repr, r)) for r in by_sql("panel_f2", tmp_path).select(columns).fetchall()}


def test_digits_of_all_sizes(spark):
    from quantaloom.fixtures import to_digits

    rng = np.random.default_rng(5)
    x = [*(rng.integers(-999, 999, 500) / 128 - 1), *(10 ** rng.uniform(-9, 17, 500)), -0.0, 0.0, -1e-7, 0.5e-6, -0.49999999999999994e-6, 1e302, -1e305, math.inf, -math.inf, math.nan, None]
    got = [r[0] for r in spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(x)], "i int, x double").coalesce(1).select(to_digits(F.col("x"), 6)).collect()]
    con = duckdb.connect()
    assert list(map(repr, got)) == [repr(con.execute("SELECT round(CAST(? AS DOUBLE), 6)", [None if v is None else float(v)]).fetchone()[0]) for v in x]


def test_amount_does_not_depend_on_the_place_of_rows(spark, tmp_path):
    """Values are added up in the order of events, wherever the file has them."""
    from quantaloom.fixtures import bars

    rng = np.random.default_rng(2)
    values = rng.exponential(50, (40, 7)).round(2)
    rows = [(u * 7 + i, dt.datetime(2024, 1, 1, i), u, float(values[u, i])) for u in range(40) for i in range(7)] + [(999, dt.datetime(2024, 1, 1), 40, None)]
    spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "event_id long, ts timestamp_ntz, user_id long, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    want = {str(u): float(np.add.accumulate(v)[-1]) for u, v in enumerate(values)} | {"40": None}
    assert {r.code: r.amount for r in bars(spark, str(tmp_path), "f2").collect()} == want


EVERY = [
    "ts_mean(close, 7)", "ts_sum(volume, 5)", "ts_std(returns, 9)", "ts_min(low, 6)", "ts_max(high, 40)", "ts_lag(close, 3)", "ts_delta(close, 4)", "ts_rank(close, 10)", "ts_argmin(close, 8)", "ts_argmax(volume, 120)",
    "ts_decay_linear(returns, 6)", "ts_product(close / 10, 3)", "ts_cov(close, volume, 8)", "ts_corr(close, volume, 10)", "ts_rsquare(close, volume, 10)", "ts_regression_residual(close, volume, 10)", "ts_skew(returns, 9)",
    "ts_kurt(returns, 9)", "cs_rank(ts_rank(close / vwap, 10)) - cs_rank(volume)", "cs_zscore(ts_mean(returns, 5))", "cs_scale(close)", "cs_demean(cs_rank(close))", "max(open, returns) + min(returns, -0.001) * sign(returns)",
    "power(returns, 2) / (inv(close) + log(volume)) - sqrt(abs(returns))", "cs_rank(high) * ts_std(volume, 20)", "close - close",
]


def holey(spark, n=23, dates=30):
    from quantaloom.sources.panel import densify, with_forward

    rng = np.random.default_rng(7)
    price = 10 * np.exp(np.cumsum(rng.normal(0, 0.02, (n, dates)), 1)).round(1)
    rows = [(f"{i}", dt.date(2024, 1, 1) + dt.timedelta(k), *(float(price[i, k] * f) for f in (0.99, 1.02, 0.97, 1)), float(rng.integers(1, 5)), float(rng.integers(1, 99))) for i in range(n) for k in range(dates) if rng.random() > 0.1]
    return with_forward(densify(spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double, amount double")))


def test_blocks_equal_the_engine(spark, monkeypatch):
    """Every operator over gaps and ties: the kernels of blocks give the ICs, the missing cells and the totals of the columns of the engine."""
    from quantaloom.functions import ic
    from quantaloom.plans import blocks
    from quantaloom.plans.compiler import evaluate

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 100)
    p = holey(spark)
    named = {f"f{i}": f for i, f in enumerate(EVERY)}
    trees = blocks.trees_of(named, None, p.n_dates)
    assert all(map(blocks.fits, trees.values())) and not blocks.fits(blocks.trees_of({"x": "ts_mean(cs_rank(close), 3)"}, None, 30)["x"])
    packed = blocks.pack(p.df, {*blocks.needed(trees), "fwd"})
    wide = evaluate(p.df, named, p.n_dates, keep=["fwd"]).persist()
    found = blocks.ics(packed, trees, ic.MIN_ASSETS, ic.FLAT).collect()
    want = {(r.name, r.t): (r.n, r.ic) for r in ic.ic_series(ic.to_long(wide, list(named))).collect()}
    assert {(r.name, r.t) for r in found if r.n} == set(want)
    for r in found:
        if r.n:
            assert r.n == want[r.name, r.t][0] and (r.ic is None) == (want[r.name, r.t][1] is None) and (r.ic is None or math.isclose(r.ic, want[r.name, r.t][1], abs_tol=1e-9)), named[r.name]
    cells = {n: [(r.missing, r.cells) for r in found if r.name == n] for n in named}
    sums = wide.agg(*[f(n).alias(f"{n}{k}") for n in named for k, f in enumerate((F.count, F.sum, lambda c: F.max(F.abs(c))))]).first()
    totals = {}
    for r in blocks.totals(packed, trees).collect():
        totals.setdefault(r.name, []).append(r)
    for n in named:
        assert sum(c for _, c in cells[n]) == 23 * 30 and sum(m for m, _ in cells[n]) == 23 * 30 - sums[f"{n}0"]
        assert sum(r.n for r in totals[n]) == sums[f"{n}0"] and max(r.most for r in totals[n] if r.n) == pytest.approx(sums[f"{n}2"], rel=1e-9, abs=1e-12)
        assert sum(r.total for r in totals[n] if r.n) == pytest.approx(sums[f"{n}1"], rel=1e-7, abs=1e-7), named[n]


def test_screen_makes_no_window_per_candidate(spark, monkeypatch):
    """The screen of what does not roll over ranks is done in blocks; what does goes through the engine still."""
    from quantaloom import library

    p, used, engine = holey(spark), [], library.evaluate
    monkeypatch.setattr(library, "evaluate", lambda df, named, *a, **k: used.extend(named.values()) or engine(df, named, *a, **k))
    formulas = ["ts_mean(close, 3)", "ts_mean(cs_rank(close), 3)", "cs_rank(ts_std(close, 5))", "ts_skew(returns, 5)"]
    found = library.screen(p, formulas, ic_threshold=0.0, least_days=10, batch=3)
    assert {s.expression for s in found} == set(formulas) and used == ["ts_mean(cs_rank(close), 3)"]


def test_screen_gives_back_its_disk(spark, monkeypatch):
    """Shuffle files go round by round and the packed panel at the end: after the screen none are left, and a round takes no more than one chunk of signals."""
    from quantaloom import library
    from quantaloom.plans import blocks

    def files():
        where = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
        return {f for d in where for _, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_") and f.endswith(".data")}

    monkeypatch.setattr(blocks, "DEALT", 1)
    p, formulas, dealt, one = holey(spark), [f"ts_mean(close, {k})" for k in range(2, 26)], [], blocks.ics
    before = files()
    monkeypatch.setattr(blocks, "ics", lambda b, trees, *a: dealt.append((len(trees), len(files() - before))) or one(b, trees, *a))
    found = library.screen(p, formulas, ic_threshold=0.0, least_days=10)
    assert {s.expression for s in found} == set(formulas)
    assert dealt == [(8, 0), (8, 0), (8, 0)]
    assert os.path.isdir(path := spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) and all(os.path.getsize(os.path.join(at, f)) < 10_000 for at, _, fs in os.walk(path) if "/blocks-" in at for f in fs)


def test_screen_reads_line_items_once(spark, monkeypatch):
    """The panel of the registered screens is made of a table of bars, which is emptied at the end."""
    from quantaloom import queries

    seen = []
    monkeypatch.setattr(queries.lib, "screen", lambda p, formulas, **_: seen.append((p.df.inputFiles(), p.df.count())) or [])
    assert queries.screened(spark, "/root/testdata/sf0.001").count() == 0
    (files, n) = seen[0]
    assert n == 830 and all("/bars-" in f for f in files) and not any("lineitem" in f for f in files)
    assert not spark.read.parquet(os.path.dirname(files[0])).count()


@pytest.mark.parametrize("name", ["alpha_corpus", "engineered_features", "combiner_features"])
def test_no_sort_of_a_date_per_signal(spark, name):
    """Plans hold the windows of the panel and of the summary, not one per ranked signal, each of which would sort a date's assets in one task."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 4 and plan.count("Sort [") <= 12


def test_walk_forward_makes_its_rows_once(spark):
    """Trees go over rows that are kept, not over the tables again: the source is read as often for many trees as for few."""
    from quantaloom.combine import walk_forward

    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        reads.add(1)
        yield from batches

    rng = np.random.default_rng(3)
    rows = [(f"{i}", dt.date(2024, 1, 1) + dt.timedelta(t), t, float(x), float(x + rng.normal())) for t in range(40) for i, x in enumerate(rng.normal(size=25))]
    wide = spark.createDataFrame(rows, "code string, date date, t int, x double, fwd double").coalesce(1).mapInArrow(seen, "code string, date date, t int, x double, fwd double")
    r = walk_forward(wide, ["x"], backend="gbt", train=25, step=10, trees=2)
    assert r.folds >= 1 and reads.value <= 2


def test_power_has_the_last_digit_of_the_engine(spark):
    """Near ties of skews are ranked by it."""
    from quantaloom.plans.blocks import power_of_three_halves

    rng = np.random.default_rng(11)
    x = np.concatenate([np.exp(rng.uniform(-30, 40, 20_000)), rng.uniform(0.9, 1.1, 2_000), [1e-10, 1.0, 2.0, 0.25]])
    got = np.array([r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").coalesce(1).select(F.pow("x", F.lit(1.5))).collect()])
    assert (got == power_of_three_halves(x)).all()


def test_dedup_needs_no_ranks_of_the_engine(spark, monkeypatch):
    """The corpus is de-duplicated from ICs of blocks, without a window for each ranked signal."""
    from quantaloom import library, queries

    monkeypatch.setattr(library, "evaluate", None)
    assert {r[0] for r in queries.chosen(spark, "/root/testdata/sf0.001").collect()} <= set(queries.CORPUS)
