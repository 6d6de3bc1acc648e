"""Batches of formulas that end in figures, in Arrow kernels over blocks of assets.

A panel is packed once: a row holds all dates of a few hundred assets.  What rolls is computed there, a matrix operation per place in a window, in the order in which
the engine's windows add.  What goes across assets is dealt out by date and by a few signals, so that a task holds those of one date at a time, however many
signals there are; what leaves it is one row of figures per signal and date.  Formulas that roll over what goes across are not for this module (``fits``).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.operators.registry import EPS
from quantaloom.scratch import dropping_shuffles

from .compiler import Stages, lower
from .expression import Call, Field, Node, Number, fields, parse, resolve

#: Rows of a block, and signals that are dealt out together.
BLOCK_ROWS = 32_768
CHUNK = 8
#: Bytes of cells that are dealt out before their shuffle files go, unless those of one chunk of signals are more.
DEALT = 1 << 30
_BODY = "t int, chunk int, body binary"


def trees_of(formulas: Mapping[str, str], known: set[str] | None, n_dates: int) -> dict[str, Node]:
    return {name: lower(resolve(parse(text), known, n_dates)) for name, text in formulas.items()}


def fits(tree: Node) -> bool:
    """Whether nothing rolls over what goes across assets."""
    return Stages().place(tree)[0] <= 1


def _crosses(node: Node) -> bool:
    return isinstance(node, Call) and (node.op.startswith("cs_") or any(map(_crosses, node.args)))


def _inputs(node: Node) -> list[Node]:
    """What an asset's own past gives to a tree: its largest parts that do not go across."""
    if not _crosses(node):
        return [] if isinstance(node, Number) else [node]
    return [x for a in node.args for x in _inputs(a)]


# ---- values: matrices of doubles, dates down and assets across, NaN for missing ------------------------------------


def _div(x, y):
    return np.where(y == 0, np.nan, x / np.where(y == 0, 1.0, y))


def _safe(y):
    return y + EPS * np.sign(y + EPS)


def _high(x: np.ndarray) -> np.ndarray:
    """``x`` without the lower half of its bits."""
    return (np.ascontiguousarray(x).view(np.int64) & ~np.int64(0xFFFFFFFF)).view(np.float64)


def power_of_three_halves(x: np.ndarray) -> np.ndarray:
    """``x ** 1.5`` of normal positive numbers with the last digit of the engine's power (Java's, which is FDLIBM's), as ranks of skews go by it."""
    x = np.asarray(x, float)
    ok = np.isfinite(x) & (x > 1e-200) & (x < 1e200)
    ax = np.where(ok, x, 1.0)
    bits = np.ascontiguousarray(ax).view(np.int64)
    n, j = (bits >> 52) - 0x3FF, (bits >> 32) & 0xFFFFF
    up = j >= 0xBB67A
    k = (j > 0x3988E) & ~up
    n = n + up
    bits = (bits & 0xFFFFFFFFFFFFF) | np.where(up, np.int64(0x3FE) << 52, np.int64(0x3FF) << 52)
    ax, b = bits.view(np.float64), np.where(k, 1.5, 1.0)
    u, v = ax - b, 1.0 / (ax + b)
    ss = u * v
    s_h = _high(ss)
    t_h = ((((bits >> 33) | 0x20000000) + 0x00080000 + (k.astype(np.int64) << 18)) << 32).view(np.float64)
    s_l = v * ((u - s_h * t_h) - s_h * (ax - (t_h - b)))
    s2 = ss * ss
    r = s2 * s2 * (5.99999999999994648725e-01 + s2 * (4.28571428578550184252e-01 + s2 * (3.33333329818377432918e-01 + s2 * (2.72728123808534006489e-01 + s2 * (2.30660745775561754067e-01 + s2 * 2.06975017800338417784e-01)))))
    r = r + s_l * (s_h + ss)
    s2 = s_h * s_h
    t_h = _high(3.0 + s2 + r)
    t_l = r - ((t_h - 3.0) - s2)
    u, v = s_h * t_h, s_l * t_h + t_l * ss
    p_h = _high(u + v)
    p_l = v - (p_h - u)
    z_h, z_l = 9.61796700954437255859e-01 * p_h, -7.02846165095275826516e-09 * p_h + p_l * 9.61796693925975554329e-01 + np.where(k, 1.35003920212974897128e-08, 0.0)
    t, dp = n.astype(float), np.where(k, 5.84962487220764160156e-01, 0.0)
    t1 = _high(((z_h + z_l) + dp) + t)
    p_l, p_h = 1.5 * (z_l - (((t1 - t) - dp) - z_h)), 1.5 * t1
    z = p_l + p_h
    n = np.where(np.abs(z) > 0.5, np.copysign(np.floor(np.abs(z) + 0.5), z), 0.0)
    p_h = p_h - n
    t = _high(p_l + p_h)
    u, v = t * 6.93147182464599609375e-01, (p_l - (t - p_h)) * 6.93147180559945286227e-01 + t * -1.90465429995776804525e-09
    z = u + v
    w, t = v - (z - u), z * z
    t1 = z - t * (1.66666666666666019037e-01 + t * (-2.77777777770155933842e-03 + t * (6.61375632143793436117e-05 + t * (-1.65339022054652515390e-06 + t * 4.13813679705723846039e-08))))
    r = (z * t1) / (t1 - 2.0) - (w + z * w)
    return np.where(ok, np.ldexp(1.0 - (r - z), n.astype(int)), np.power(x, 1.5))


_MAPS: dict[str, Callable] = {
    "abs": np.abs, "sign": np.sign, "neg": np.negative, "log": lambda x: np.log(np.abs(x) + EPS), "sqrt": lambda x: np.sqrt(np.abs(x)), "inv": lambda x: _div(np.ones_like(x), _safe(x)),
    "add": np.add, "sub": np.subtract, "mul": np.multiply, "div": lambda x, y: _div(x, _safe(y)), "max": np.fmax, "min": np.fmin,
    "power": lambda x, n: np.power(np.abs(x) + EPS, n) * np.sign(x),
    "_ratio": lambda third, second: third / power_of_three_halves(second + EPS), "_excess": lambda fourth, second: fourth / (second * second + EPS) - 3,
}


class Rolling:
    """The rolling operators over the rows of each column, oldest first; ``t``: the date's index of every cell."""

    def __init__(self, t: np.ndarray) -> None:
        self.t, self.place = t, np.arange(len(t))[:, None]

    def back(self, d: int) -> Iterator[tuple[slice, slice]]:
        """(rows, the rows some places before) for each place of a window of d, the oldest first."""
        for j in range(min(d, len(self.t)) - 1, -1, -1):
            yield slice(j, None), slice(0, len(self.t) - j)

    def total(self, x: np.ndarray, d: int) -> np.ndarray:
        """The sum of what is present, 0 of nothing."""
        x, out = np.where(np.isnan(x), 0.0, x), np.zeros(x.shape)
        for now, old in self.back(d):
            out[now] += x[old]
        return out

    def count(self, x: np.ndarray, d: int) -> np.ndarray:
        n = np.cumsum(~np.isnan(x), 0)
        n[d:] -= n[:-d].copy() if d < len(n) else 0
        return n.astype(float)

    def sums(self, x: np.ndarray, d: int) -> np.ndarray:
        return np.where(self.count(x, d) > 0, self.total(x, d), np.nan)

    def mean(self, x: np.ndarray, d: int) -> np.ndarray:
        return _div(self.total(x, d), self.count(x, d))

    def filled(self, d: int, x: np.ndarray) -> np.ndarray:
        return np.where(self.t >= d - 1, x, np.nan)

    def std(self, x: np.ndarray, d: int) -> np.ndarray:
        n, mean, m2, here = np.zeros(x.shape), np.zeros(x.shape), np.zeros(x.shape), ~np.isnan(x)
        for now, old in self.back(d):
            use = here[old]
            k = n[now] + use
            delta = np.where(use, x[old] - mean[now], 0.0)
            step = delta / np.maximum(k, 1.0)
            n[now] = k
            mean[now] += step
            m2[now] += delta * (delta - step)
        return np.where(n > 1, np.sqrt(m2 / np.maximum(n - 1, 1.0)), np.nan)

    def least(self, x: np.ndarray, d: int, pick: Callable = np.fmin) -> np.ndarray:
        out = np.full(x.shape, np.nan)
        for now, old in self.back(d):
            out[now] = pick(out[now], x[old])
        return out

    def lag(self, x: np.ndarray, d: int) -> np.ndarray:
        out = np.full(x.shape, np.nan)
        if d < len(x):
            out[d:] = x[:-d]
        return out

    def rank(self, x: np.ndarray, d: int) -> np.ndarray:
        less, same, n = np.zeros(x.shape), np.zeros(x.shape), self.count(x, d)
        for now, old in self.back(d):
            less[now] += x[old] < x[now]
            same[now] += x[old] == x[now]
        spread = np.where(n == 1, 0.5, _div(less + (same - 1) / 2, n - 1))
        return np.where(np.isnan(x), np.nan, 2 * (spread - 0.5))

    def since(self, x: np.ndarray, d: int, sign: float) -> np.ndarray:
        """Dates since the newest of the least values (of ``sign`` times x)."""
        x, best, at = sign * x, np.full(x.shape, np.inf), np.full(x.shape, np.nan)
        for now, old in self.back(d):
            better = x[old] <= best[now]
            best[now] = np.where(better, x[old], best[now])
            at[now] = np.where(better, self.t[old], at[now])
        return self.t - at

    def decay(self, x: np.ndarray, d: int) -> np.ndarray:
        x, out, n = np.where(np.isnan(x), 0.0, x), np.zeros(x.shape), np.minimum(self.place + 1, d)
        for now, old in self.back(d):
            out[now] += x[old] * (n[now] - (len(x) - old.stop))
        return self.filled(d, out / (d * (d + 1) / 2))

    def product(self, x: np.ndarray, d: int) -> np.ndarray:
        x, out = np.where(np.isnan(x), 1.0, x), np.ones(x.shape)
        for now, old in self.back(d):
            out[now] *= x[old]
        return self.filled(d, out)

    def cov(self, x: np.ndarray, y: np.ndarray, d: int) -> np.ndarray:
        return self.mean(x * y, d) - self.mean(x, d) * self.mean(y, d)

    def corr(self, x: np.ndarray, y: np.ndarray, d: int) -> np.ndarray:
        def spread(v: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(self.mean(v * v, d) - self.mean(v, d) * self.mean(v, d), EPS))

        return np.clip(self.cov(x, y, d) / (spread(x) * spread(y)), -1.0, 1.0)

    def residual(self, x: np.ndarray, y: np.ndarray, d: int) -> np.ndarray:
        gone = np.isnan(x) | np.isnan(y)
        mx, my = self.mean(x, d), self.mean(y, d)
        xx = self.sums(x * x, d) - self.count(x, d) * mx * mx
        x2, y2 = np.where(gone, np.nan, x), np.where(gone, np.nan, y)
        xy = self.sums(x * y, d) - my * self.sums(x2, d) - mx * self.sums(y2, d) + self.count(x2, d) * mx * my
        beta = np.where(np.isnan(xy), 0.0, xy) / (np.where(np.isnan(xx), 0.0, xx) + EPS)
        return self.filled(d, y - beta * x - (my - beta * mx))


_ROLLS: dict[str, Callable] = {
    "ts_mean": Rolling.mean, "ts_sum": Rolling.sums, "ts_std": Rolling.std, "ts_min": Rolling.least, "ts_max": lambda r, x, d: r.least(x, d, np.fmax), "ts_lag": Rolling.lag, "ts_rank": Rolling.rank,
    "ts_delta": lambda r, x, d: x - r.lag(x, d), "ts_argmin": lambda r, x, d: r.since(x, d, 1.0), "ts_argmax": lambda r, x, d: r.since(x, d, -1.0), "ts_decay_linear": Rolling.decay,
    "ts_product": Rolling.product, "ts_cov": Rolling.cov, "ts_corr": Rolling.corr, "ts_rsquare": lambda r, x, y, d: r.corr(x, y, d) ** 2, "ts_regression_residual": Rolling.residual,
}


def ordinal(x: np.ndarray) -> np.ndarray:
    """1-based rank of each value, ties as they come, missing ones last."""
    out = np.empty(len(x))
    out[np.argsort(x, kind="stable")] = np.arange(1, len(x) + 1)
    return out


def _mean(x: np.ndarray) -> float:
    here = x[~np.isnan(x)]
    return here.mean() if len(here) else np.nan


def _zscore(x: np.ndarray) -> np.ndarray:
    here = x[~np.isnan(x)]
    return (x - here.mean()) / (here.std() + EPS) if len(here) else x


_CROSSES: dict[str, Callable] = {
    "cs_rank": lambda x: np.where(np.isnan(x), np.nan, ordinal(x) / max((~np.isnan(x)).sum(), 1)), "cs_zscore": _zscore, "cs_scale": lambda x: x / (np.nansum(np.abs(x)) + EPS), "cs_demean": lambda x: x - _mean(x),
}


def _value(node: Node, known: dict[Node, np.ndarray], rolling: Rolling | None, keep: set[Node] | None = None) -> np.ndarray:
    """A node's cells; those of window nodes, and of ``keep``, are remembered in ``known``."""
    if node in known:
        return known[node]
    if isinstance(node, Number):
        return np.float64(node.value)
    if node.op in _MAPS:
        n = len(node.args) - (node.op == "power")
        out = _MAPS[node.op](*[_value(a, known, rolling) for a in node.args[:n]], *[a.value for a in node.args[n:]])
    elif node.op in _CROSSES:
        out = _CROSSES[node.op](_value(node.args[0], known, rolling))
    else:
        out = _ROLLS[node.op](rolling, *[_value(a, known, rolling) for a in node.args[:-1]], int(node.args[-1].value))
    if node.op not in _MAPS or (node.op in ("sub", "mul") and rolling is not None):
        known[node] = out
    return out


def _finite(x: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    x = np.broadcast_to(x, shape)
    return np.where(np.isfinite(x), x, np.nan)


# ---- blocks ----------------------------------------------------------------------------------------------------------


def pack(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(body binary): blocks of whole assets of a panel with code, t and ``columns``."""
    columns = sorted(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def cut(last: bool) -> pa.RecordBatch | None:
            nonlocal held, rows
            whole = pa.Table.from_batches(held).combine_chunks()
            ids = whole.column(0).combine_chunks().dictionary_encode()
            ids = (ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids).indices.to_pandas().fillna(-1).to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(ids)) + 1, len(ids)]
            if not last:
                rest = whole.slice(int(edges[-2]))
                whole, ids, edges = whole.slice(0, int(edges[-2])), ids[: edges[-2]], edges[:-1]
                held, rows = rest.to_batches(), rest.num_rows
            if not len(ids):
                return None
            sizes = np.diff(edges)
            col, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(ids)) - np.repeat(edges[:-1], sizes)
            out = {}
            for name in whole.column_names[1:]:
                x = np.full((int(sizes.max()), len(sizes)), np.nan)
                x[at, col] = whole.column(name).to_pandas().to_numpy(dtype=float, na_value=np.nan)
                out[name] = x
            codes = whole.column(0).take(pa.array(edges[:-1])).to_pylist()
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps((codes, out), protocol=5)], pa.binary())], names=["body"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= BLOCK_ROWS and (made := cut(False)) is not None:
                yield made
        if rows and (made := cut(True)) is not None:
            yield made

    cells = panel.select("code", F.col("t").cast("double").alias("t"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return cells.repartition("code").sortWithinPartitions("code", "t").mapInArrow(run, "body binary")


def _figures(blocks: DataFrame, trees: Mapping[str, Node], of: Callable, schema: str, extra: Sequence[str] = (), alone: Callable | None = None, joined: Callable | None = None) -> DataFrame:
    """Figures of signals by date: ``of(name, t, cells, extra)`` gives a row for the cells of a date, its assets in order of their codes.

    ``alone``, if given, gives a row's figures of signals that go across nothing, from the cells of a block; ``joined`` adds up such rows by name.
    """
    across = [n for n in trees if alone is None or _crosses(trees[n])]
    own = [n for n in trees if n not in set(across)]
    chunks = [across[i : i + CHUNK] for i in range(0, len(across), CHUNK)]
    inputs = [list(dict.fromkeys(x for n in c for x in _inputs(trees[n]))) for c in chunks]

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for b in batches:
                for i in range(b.num_rows):
                    codes, x = pickle.loads(b.column(0)[i].as_buffer())
                    t = x.pop("t")
                    rolling, base = Rolling(t), {Field(n): v for n, v in x.items()}
                    order = np.array(sorted(range(len(codes)), key=lambda k: (codes[k] is not None, (codes[k] or "").encode())))
                    if own:
                        known = dict(base)
                        rows = [alone(n, _finite(_value(trees[n], known, rolling), t.shape)[~np.isnan(t)]) for n in own]
                        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([pickle.dumps(rows, protocol=5)], pa.binary())], names=["t", "chunk", "body"])
                    for k, parts in enumerate(inputs):
                        known = dict(base)
                        cells = np.stack([np.broadcast_to(_value(n, known, rolling), t.shape) for n in parts] + [x[e] for e in extra])[:, :, order] if parts or extra else np.zeros((0, *t.shape))
                        out_t, out_b = [], []
                        dates = t[:, order]
                        for r in range(len(t)):
                            for when in np.unique(dates[r][~np.isnan(dates[r])]):
                                here = np.flatnonzero(dates[r] == when)
                                out_t.append(int(when))
                                out_b.append(pickle.dumps(([codes[j] for j in order[here]], np.ascontiguousarray(cells[:, r, here])), protocol=5))
                        yield pa.RecordBatch.from_arrays([pa.array(out_t, pa.int32()), pa.array([k] * len(out_t), pa.int32()), pa.array(out_b, pa.binary())], names=["t", "chunk", "body"])

    def cross(key: tuple, rows: pa.Table) -> pa.Table:
        t, k = key[0].as_py(), key[1].as_py()
        bodies = [pickle.loads(v.as_buffer()) for v in rows.column("body")]
        if k < 0:
            return pd.DataFrame(joined([r for b in bodies for r in b]), columns=names)
        order = np.argsort(np.array([(c or "").encode() for codes, _ in bodies for c in codes]), kind="stable")
        cells = np.concatenate([x for _, x in bodies], 1)[:, order]
        known, n = dict(zip(inputs[k], cells, strict=False)), len(order)
        ends = cells[len(inputs[k]) :]
        with np.errstate(all="ignore"):
            return pd.DataFrame(of([(c, _finite(_value(trees[c], known, None), (n,))) for c in chunks[k]], t, ends), columns=names)

    names = [part.split()[0] for part in schema.split(", ")]
    target = pa.schema([(part.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[part.split()[1]]) for part in schema.split(", ")])
    return blocks.mapInArrow(roll, _BODY).groupBy("t", "chunk").applyInArrow(lambda key, rows: pa.Table.from_pandas(cross(key, rows), target, preserve_index=False), schema)


def ics(blocks: DataFrame, trees: Mapping[str, Node], least: int, flat: float) -> DataFrame:
    """(name, t, n, ic, cells, missing): the rank IC of ``ic_series`` with fwd, which the blocks hold, and the numbers of cells and of missing ones."""

    def of(signals: list[tuple[str, np.ndarray]], t: int, ends: np.ndarray) -> list[tuple]:
        y, out, ranked = ends[0], [], {}
        here = ~np.isnan(y)
        for name, x in signals:
            both = here & ~np.isnan(x)
            n, value = int(both.sum()), None
            if n >= max(least, 1):
                mark = both.tobytes()
                if mark not in ranked:
                    b = ordinal(y[both])
                    ranked = {mark: b - b.mean()}  # one at a time: neighbouring signals mostly share it
                a, b = ordinal(x[both]), ranked[mark]
                a -= a.mean()
                va, vb = (a * a).sum(), (b * b).sum()
                if va > flat and vb > flat:
                    value = float((a * b).sum() / np.sqrt(va * vb))
            out.append((name, t, n, value, len(x), int(np.isnan(x).sum())))
        return out

    return _figures(blocks, trees, of, "name string, t int, n long, ic double, cells long, missing long", ["fwd"])


def cells_of(blocks: DataFrame, columns: int) -> int:
    """About how many cells of a panel the blocks hold for each of their columns."""
    with dropping_shuffles(blocks.sparkSession):
        held = blocks.agg(F.sum(F.octet_length("body")).alias("bytes")).toArrow()["bytes"][0].as_py() or 0
    return held // 8 // (columns + 1)


def ics_by_rounds(blocks: DataFrame, trees: Mapping[str, Node], least: int, flat: float, cells: int) -> DataFrame:
    """``ics``, dealt out in rounds of as many signals as fit ``DEALT``, and gathered: a row of figures a signal and date.

    The disk that a round takes is given back before the next, so that it does not grow with the number of signals.
    """
    names, spark = list(trees), blocks.sparkSession
    step = CHUNK * max(1, DEALT // max(1, cells * 8 * (CHUNK + 1)))
    with dropping_shuffles(spark):
        found = [ics(blocks, {n: trees[n] for n in names[i : i + step]}, least, flat).toArrow() for i in range(0, len(names), step)]
    return spark.createDataFrame(pa.concat_tables(found))


def totals(blocks: DataFrame, trees: Mapping[str, Node]) -> DataFrame:
    """(name, n, total, most): parts of the number of present cells, their sum and largest size, to be added up by name."""

    def one(name: str, x: np.ndarray) -> tuple:
        x = x[~np.isnan(x)]
        return (name, len(x), float(x.sum()) if len(x) else None, float(np.abs(x).max()) if len(x) else None)

    def joined(rows: list[tuple]) -> list[tuple]:
        return rows

    return _figures(blocks, trees, lambda signals, t, ends: [one(n, x) for n, x in signals], "name string, n long, total double, most double", (), one, joined)


def needed(trees: Mapping[str, Node]) -> set[str]:
    return set().union(*map(fields, trees.values()))
