"""Models that combine signals: adaptive ridge, and walk-forward ridge or boosted trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaloom.functions.ic import MANY, average_rank, ic_wide, series_of, spearman_series, to_long


#: Rows of a task of the training of trees.
TASK_ROWS = 50_000


def window_moments(rows: DataFrame, names: Sequence[str], windows: Sequence[tuple[int, int, np.ndarray]], least: int = 1) -> list[np.ndarray]:
    """For each window (first date, end, numbers of signals) the moments of [1, these signals, fwd] over its rows with a fwd.

    Dates with fewer than ``least`` rows are left out.  Rows move once, by date.  A task multiplies a date's matrix and adds it up for the windows that hold the
    date; what leaves it is one matrix per window, and these are added per window.  What comes back is (signals + 2)^2 numbers a window.
    """
    names = list(names)
    starts, ends = (np.array([w[k] for w in windows]) for k in (0, 1))
    columns = [np.r_[0, np.asarray(w[2]) + 1, len(names) + 1] for w in windows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        held: list[np.ndarray] = []
        at: int | None = None

        def settle() -> None:
            x = np.concatenate(held) if held else np.empty((0, 0))
            if len(x) < max(least, 1):
                return
            x = np.concatenate([np.ones((len(x), 1)), x], 1)
            inside = np.flatnonzero((starts <= at) & (at < ends)).tolist()
            whole = x.T @ x if any(len(columns[w]) == x.shape[1] for w in inside) else None
            for w in inside:
                if len(columns[w]) == x.shape[1]:
                    own = whole
                else:
                    part = x[:, columns[w]]
                    own = part.T @ part
                sums[w] = sums[w] + own if w in sums else own.copy()

        for b in batches:
            t = b.column(0).to_numpy()
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(1, b.num_columns)], 1) if b.num_rows else None
            for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(np.r_[0, np.flatnonzero(np.diff(t)) + 1, len(t)]), strict=True):
                if lo == hi:
                    continue
                if t[lo] != at:
                    settle()
                    held, at = [], int(t[lo])
                held.append(x[lo:hi])
        settle()
        for w, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["w", "m"])

    ready = rows.where("fwd is not null").select("t", *[F.col(f"`{n}`").cast("double") for n in names], F.col("fwd").cast("double"))
    parts = ready.repartition("t").sortWithinPartitions("t").mapInArrow(run, "w int, m array<double>")
    added = parts.groupBy("w").applyInPandas(lambda f: pd.DataFrame({"w": f["w"].iloc[:1], "m": [np.sum(f["m"].to_list(), 0)]}), "w int, m array<double>")
    out = [np.zeros((len(c), len(c))) for c in columns]
    for r in added.collect():  # one matrix per window
        out[r["w"]] = np.array(r["m"]).reshape(out[r["w"]].shape)
    return out


def weighted(columns: Column, at: Column | None, w: Column) -> Column:
    """The sum of ``w`` times the elements of the array ``columns``, at the places ``at`` if given; missing elements count as 0.  One expression, however many there are."""
    pairs = F.zip_with(columns, w, lambda x, v: v * F.coalesce(x, F.lit(0.0))) if at is None else F.zip_with(at, w, lambda i, v: v * F.coalesce(F.get(columns, i), F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def adaptive_plan(
    ic: np.ndarray, rows: np.ndarray, n_dates: int, *, lookback: int = 120, top_k: int = 50, min_train: int = 60, refit: int = 5, explore: float = 0.1,
) -> list[tuple[int, int, np.ndarray]]:
    """The refits (window's first date, date, chosen signals) from ``min_train`` on.

    ``ic``: signals x dates; ``rows``: with a forward return, by date.  At each refit, signals are chosen by mean IC times ICIR over the
    look-back, plus a bonus for those seldom chosen.  A window of too few rows is no refit; then the next date tries, if there was none before.
    """
    upto = np.r_[0, np.cumsum(rows)]
    visits, out = np.zeros(len(ic)), []
    for t in range(min_train, n_dates):
        if t % refit and out:
            continue
        start = max(0, t - lookback)
        seen = ic[:, start:t]
        some = ~np.isnan(seen)
        n = np.maximum(some.sum(1), 1)
        mean = np.where(some, seen, 0).sum(1) / n
        sd = np.sqrt((np.where(some, seen - mean[:, None], 0) ** 2).sum(1) / n)
        score = np.abs(mean) * np.abs(mean) / np.where(sd < 1e-10, 1.0, sd) + explore / (1 + visits)
        chosen = np.argsort(-score, kind="stable")[:top_k]
        visits[chosen] += 1
        if upto[t] - upto[start] >= len(chosen) + 10:
            out.append((start, t, chosen))
    return out


def adaptive_combine(wide: DataFrame, names: Sequence[str], *, alpha: float = 1e-4, **how) -> DataFrame:
    """(name, code, date, t, value, fwd) of the adaptive mix; missing before it has weights.

    The cluster computes ICs, then the moments of each refit's chosen signals over its look-back; a ridge without intercept is solved for
    each.  Between refits the last weights hold.  The choice of signals, date after date, works on the ICs alone, one number per signal and date.
    """
    spark, names = wide.sparkSession, list(names)
    ics = series_of(wide, names).select("name", "t", "ic").toPandas()
    counts = wide.groupBy("t").agg(F.count("fwd").alias("n")).toPandas()  # one row per date
    n_dates = int(counts["t"].max()) + 1
    rows = np.zeros(n_dates)
    rows[counts["t"].to_numpy(int)] = counts["n"].to_numpy(float)
    ic = np.full((len(names), n_dates), np.nan)
    place = {n: i for i, n in enumerate(names)}
    ic[[place[n] for n in ics["name"]], ics["t"].to_numpy(int)] = ics["ic"].to_numpy(float)
    plan = adaptive_plan(ic, rows, n_dates, **how)
    filled = wide.select("t", "fwd", *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names])
    fitted = []
    for (_, t, chosen), m in zip(plan, window_moments(filled, names, plan), strict=True):
        x = m[1:-1, 1:-1] + alpha * np.eye(len(chosen))
        fitted.append((t, chosen.tolist(), np.linalg.solve(x, m[1:-1, -1]).tolist()))
    ends = [t for t, _, _ in fitted[1:]] + [n_dates]
    table = spark.createDataFrame([(d, at, w) for (t, at, w), end in zip(fitted, ends, strict=True) for d in range(t, end)] if fitted else [], "t int, __at array<int>, __w array<double>")
    value = F.when(F.col("__w").isNotNull(), weighted(F.array(*[F.col(f"`{n}`") for n in names]), F.col("__at"), F.col("__w")))
    return wide.join(F.broadcast(table), "t", "left").select(F.lit("adaptive").alias("name"), "code", "date", "t", value.alias("value"), "fwd")  # one row per date is broadcast


@dataclass
class CombinerReport:
    """Daily rank ICs of the out-of-sample predictions, and what follows from them."""

    backend: str
    ic: np.ndarray
    individual: dict[str, float]
    importance: dict[str, float] = field(default_factory=dict)
    folds: int = 0

    @property
    def ic_mean(self) -> float:
        return float(self.ic.mean()) if len(self.ic) else 0.0

    @property
    def icir(self) -> float:
        sd = float(self.ic.std()) if len(self.ic) else 0.0
        return self.ic_mean / sd if sd > 1e-10 else 0.0

    @property
    def positive(self) -> float:
        return float((self.ic > 0).mean()) if len(self.ic) else 0.0

    @property
    def improvement(self) -> float:
        """Percent by which |ic_mean| exceeds that of the best lone signal."""
        best = max(map(abs, self.individual.values()), default=0.0)
        return (abs(self.ic_mean) - best) / best * 100 if best > 0 else 0.0

    @property
    def verdict(self) -> str:
        size = abs(self.ic_mean)
        if size >= 0.05 and abs(self.icir) >= 0.5:
            return "good"
        return "pass" if size >= 0.03 else "weak"


def folds(n_dates: int, train: int = 500, step: int = 60, purge: int = 5) -> list[tuple[int, int, int, int]]:
    """(train start, train end, test start, test end) by date index; an error if no test date is left."""
    if train + purge >= n_dates:
        raise ValueError(f"Not enough data: need {train + purge} days but have {n_dates}")
    return [(max(0, s - train), s - purge, s, min(s + step, n_dates)) for s in range(train + purge, n_dates, step)]


def ridge_coefficients(m: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) on raw signals of a ridge on standardised ones, from the moments of [1, signals, fwd]."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    sd[sd < 1e-12] = 1.0
    x = cov[:-1, :-1] / np.outer(sd, sd) * n + alpha * np.eye(len(sd))
    beta = np.linalg.solve(x, cov[:-1, -1] / sd * n) / sd
    return beta, float(mean[-1] - beta @ mean[:-1])


def walk_forward(wide: DataFrame, names: Sequence[str], *, backend: str = "ridge", train: int = 500, step: int = 60, purge: int = 5, alpha: float = 1.0, least: int = 20, trees: int = 30) -> CombinerReport:
    """Fit on a window, skip a purge gap, predict the next dates, move on; daily Spearman of predictions and fwd.

    Rows with every signal and fwd count, on dates with at least ``least`` of them.  'ridge' is exact: one pass
    gives the moments of every fold's window.  'gbt' trains one MLlib model per fold,
    of ``trees`` trees or fewer: it ends at the first one that makes the error of the held-out rows larger.  'auto' is 'gbt', the trees that are always there.
    """
    cols = [f"`{n}`" for n in names]
    # Every tree of every fold goes over these rows in jobs of its own: what made them is not done again, and no broadcast of it goes through the driver, for each.
    own = wide.select("code", "date", "t", "fwd", *cols).persist()
    try:
        return _walked(own, names, cols, backend, train, step, purge, alpha, least, trees)
    finally:
        own.unpersist()


def _walked(own: DataFrame, names: Sequence[str], cols: list[str], backend: str, train: int, step: int, purge: int, alpha: float, least: int, trees: int) -> CombinerReport:
    n_dates = own.agg(F.max("t")).first()[0] + 1
    plan = folds(n_dates, train, step, purge)
    whole = own.na.drop(subset=["fwd", *names])
    # One number per date.
    busy = [r["t"] for r in whole.groupBy("t").count().where(F.col("count") >= least).select("t").collect()]
    rows = whole.where(F.col("t").isin(busy))
    alone = ic_wide(own, names, least=least, ties="average") if len(names) >= MANY else spearman_series(to_long(own, names), least=least)
    individual = {r["name"]: r["ic"] or 0.0 for r in alone.groupBy("name").agg(F.avg("ic").alias("ic")).collect()}
    importance, used, predictions = np.zeros(len(names)), 0, None
    if backend == "auto":
        backend = "gbt"
    if backend == "ridge":
        models = []
        every = np.arange(len(names))
        for (_, _, s, e), m in zip(plan, window_moments(rows, names, [(a, b, every) for a, b, _, _ in plan], least), strict=True):
            if m[0, 0] < 100:
                continue
            beta, intercept = ridge_coefficients(m, alpha)
            used += 1
            importance += np.abs(beta) * np.sqrt(np.maximum(np.diag(m)[1:-1] / m[0, 0] - (m[0, 1:-1] / m[0, 0]) ** 2, 0))
            models += [(t, beta.tolist(), intercept) for t in range(s, e)]
        table = own.sparkSession.createDataFrame(models, "t int, __w array<double>, __intercept double")
        predictions = rows.join(F.broadcast(table), "t").select("code", "date", "t", "fwd", (weighted(F.array(*cols), None, F.col("__w")) + F.col("__intercept")).alias("value"))
    elif backend == "gbt":
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor

        # A job per level of a tree: what its tasks report to the driver should follow the rows, not the partitions that these came from.
        few = rows.coalesce(max(1, -(-own.count() // TASK_ROWS)))
        vectors = VectorAssembler(inputCols=list(names), outputCol="__features").transform(few)
        for a, b, s, e in plan:
            sample = vectors.where((F.col("t") >= a) & (F.col("t") < b)).withColumn("__check", F.pmod(F.xxhash64("code", "date"), F.lit(100)) < 15)
            if sample.limit(100).count() < 100:
                continue
            model = GBTRegressor(featuresCol="__features", labelCol="fwd", maxIter=trees, maxDepth=6, maxBins=128, stepSize=0.05, seed=42, validationIndicatorCol="__check", validationTol=0.0).fit(sample)
            used += 1
            importance += model.featureImportances.toArray()
            part = model.transform(vectors.where((F.col("t") >= s) & (F.col("t") < e))).select("code", "date", "t", "fwd", F.col("prediction").alias("value"))
            predictions = part if predictions is None else predictions.unionByName(part)
    else:
        raise ValueError(f"Unknown backend: {backend}")
    ic = np.empty(0)
    if predictions is not None and used:
        daily = spearman_series(predictions.withColumn("name", F.lit(backend)), least=least).where("ic is not null").orderBy("t")
        ic = np.array([r["ic"] for r in daily.select("ic").collect()])
    total = importance.sum() or 1.0
    return CombinerReport(backend, ic, individual, {n: float(v / total) for n, v in zip(names, importance, strict=True)} if used else {}, used)


__all__ = ["CombinerReport", "adaptive_combine", "adaptive_plan", "average_rank", "folds", "ridge_coefficients", "walk_forward", "weighted", "window_moments"]
