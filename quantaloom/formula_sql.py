"""Formulas as DuckDB SQL, for the SQL twins of queries: a second reading of the operators, with other means than the compiler's.

Windows can't nest in SQL, so each window is a column of a stage, and a stage's windows look at the columns of the stages before it.
"""

from __future__ import annotations

from collections.abc import Mapping

from quantaloom.plans.expression import Field, Node, Number, parse, resolve

EPS = "1e-10"
_DAY = "(PARTITION BY date)"
_MAPS = {
    "abs": "abs({0})", "sign": "CAST(sign({0}) AS DOUBLE)", "neg": "(-{0})", "log": "ln(abs({0}) + 1e-10)", "sqrt": "sqrt(abs({0}))", "add": "({0} + {1})", "sub": "({0} - {1})", "mul": "({0} * {1})",
    "max": "greatest({0}, {1})", "min": "least({0}, {1})", "power": "(power(abs({0}) + 1e-10, {1}) * sign({0}))", "inv": "(1.0 / nullif({0} + 1e-10 * sign({0} + 1e-10), 0))", "div": "({0} / nullif({1} + 1e-10 * sign({1} + 1e-10), 0))",
}
_AGGREGATES = {"ts_mean": "avg", "ts_sum": "sum", "ts_min": "min", "ts_max": "max", "ts_std": "stddev_samp"}


class Stages:
    """The window columns of a batch of formulas, stage by stage; equal ones are one column."""

    def __init__(self) -> None:
        self.stages: list[dict[str, str]] = []

    def window(self, expression: str, at: int) -> tuple[str, int]:
        """A column for a window over what stage ``at`` has: its name, and the stage that has it."""
        while len(self.stages) <= at:
            self.stages.append({})
        own = self.stages[at]
        return own.setdefault(expression, f"w{at}_{len(own)}"), at + 1

    def column(self, value: tuple[str, int]) -> tuple[str, int]:
        """A value as a column, NaN made missing, so that windows and lambdas can look at it."""
        text, at = value
        return value if text.isidentifier() else self.window(f"CASE WHEN NOT isnan({text}) THEN {text} END", at)

    def value(self, node: Node) -> tuple[str, int]:
        """A node as SQL text, and the stage from which its columns are there."""
        if isinstance(node, Number):
            return repr(float(node.value)), 0
        if isinstance(node, Field):
            return node.name, 0
        if node.op in _MAPS:
            args = [self.value(a) for a in node.args]
            return _MAPS[node.op].format(*(t for t, _ in args)), max(at for _, at in args)
        if node.op.startswith("cs_"):
            return self.across(node.op, self.column(self.value(node.args[0])))
        *arrays, d = node.args
        return self.rolling(node.op, [self.column(self.value(a)) for a in arrays], int(d.value))

    def across(self, op: str, x: tuple[str, int]) -> tuple[str, int]:
        v, at = x
        if op == "cs_rank":
            place, _ = self.window(f"row_number() OVER (PARTITION BY date ORDER BY {v} ASC NULLS LAST, code)", at)
            n, at = self.window(f"count({v}) OVER {_DAY}", at)
            return f"CASE WHEN {v} IS NOT NULL THEN CAST({place} AS DOUBLE) / {n} END", at
        if op == "cs_scale":
            size, at = self.window(f"sum(abs({v})) OVER {_DAY}", at)
            return f"({v} / ({size} + {EPS}))", at
        mean, _ = self.window(f"avg({v}) OVER {_DAY}", at)
        if op == "cs_demean":
            return f"({v} - {mean})", at + 1
        sd, at = self.window(f"stddev_pop({v}) OVER {_DAY}", at)
        return f"(({v} - {mean}) / ({sd} + {EPS}))", at

    def rolling(self, op: str, args: list[tuple[str, int]], d: int) -> tuple[str, int]:
        x, at = args[0][0], max(a for _, a in args)
        past = f"(PARTITION BY code ORDER BY date ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"

        def over(expression: str, stage: int) -> tuple[str, int]:
            return self.window(f"{expression} OVER {past}", stage)

        if op in _AGGREGATES:
            return over(f"{_AGGREGATES[op]}({x})", at)
        if op in ("ts_lag", "ts_delta"):
            old, at = self.window(f"lag({x}, {d}) OVER (PARTITION BY code ORDER BY date)", at)
            return (old if op == "ts_lag" else f"({x} - {old})"), at
        if op in ("ts_argmin", "ts_argmax"):
            pick, sign = ("arg_min", "-") if op == "ts_argmin" else ("arg_max", "")
            best, at = over(f"{pick}(t, CASE WHEN {x} IS NOT NULL THEN row({x}, {sign}t) END)", at)
            return f"CAST(t - {best} AS DOUBLE)", at
        if op == "ts_rank":
            seen, at = over(f"list({x})", at)
            n = f"len(list_filter({seen}, lambda v: v IS NOT NULL))"
            less, same = f"len(list_filter({seen}, lambda v: v < {x}))", f"len(list_filter({seen}, lambda v: v = {x}))"
            return f"CASE WHEN {x} IS NULL THEN NULL WHEN {n} = 1 THEN 0.0 ELSE 2 * (({less} + ({same} - 1) / 2.0) / ({n} - 1) - 0.5) END", at
        if op == "ts_decay_linear":
            seen, at = over(f"list(coalesce({x}, 0.0))", at)
            return f"CASE WHEN t >= {d - 1} THEN list_sum(list_transform({seen}, lambda v, i: v * i)) / {d * (d + 1) / 2} END", at
        if op == "ts_product":
            whole, at = over(f"product(coalesce({x}, 1.0))", at)
            return f"CASE WHEN t >= {d - 1} THEN {whole} END", at
        if op in ("ts_skew", "ts_kurt"):
            mean, _ = over(f"avg({x})", at)
            e = f"({x} - {mean})"
            second, _ = over(f"avg({e} * {e})", at + 1)
            if op == "ts_skew":
                third, at = over(f"avg({e} * {e} * {e})", at + 1)
                return f"({third} / power({second} + {EPS}, 1.5))", at
            fourth, at = over(f"avg(({e} * {e}) * ({e} * {e}))", at + 1)
            return f"({fourth} / ({second} * {second} + {EPS}) - 3)", at
        y = args[1][0]
        mx, my = over(f"avg({x})", at)[0], over(f"avg({y})", at)[0]
        if op == "ts_regression_residual":
            pairs, at = over(f"list({{'x': {x}, 'y': {y}}})", at)
            xy = f"coalesce(list_sum(list_transform({pairs}, lambda v: (v.x - {mx}) * (v.y - {my}))), 0)"
            xx = f"coalesce(list_sum(list_transform({pairs}, lambda v: (v.x - {mx}) * (v.x - {mx}))), 0)"
            slope, at = self.window(f"{xy} / ({xx} + {EPS})", at)
            return f"CASE WHEN t >= {d - 1} THEN {y} - {slope} * {x} - ({my} - {slope} * {mx}) END", at
        cov = f"({over(f'avg({x} * {y})', at)[0]} - {mx} * {my})"
        if op == "ts_cov":
            return cov, at + 1
        xx, yy = (over(f"avg({v} * {v})", at)[0] for v in (x, y))
        raw, at = self.window(f"{cov} / (sqrt(greatest({xx} - {mx} * {mx}, {EPS})) * sqrt(greatest({yy} - {my} * {my}, {EPS})))", at + 1)
        r = f"CASE WHEN {raw} IS NOT NULL AND {xx} IS NOT NULL AND {yy} IS NOT NULL THEN greatest(-1.0, least(1.0, {raw})) END"
        return (r, at) if op == "ts_corr" else (f"({r} * {r})", at)


def ctes(formulas: Mapping[str, str], n_dates: int, source: str = "p", keep: str = "code, date, t, fwd", into: str = "wide") -> str:
    """CTEs, without WITH, that end with ``into``: ``keep`` and one column per formula, over the panel ``source`` of ``n_dates`` dates."""
    s = Stages()
    values = {name: s.value(resolve(parse(text), None, n_dates))[0] for name, text in formulas.items()}
    parts, before = [], source
    for i, own in enumerate(s.stages):
        parts.append(f"{into}_{i} AS (SELECT *, {', '.join(f'{e} AS {name}' for e, name in own.items())} FROM {before})")
        before = f"{into}_{i}"
    columns = ", ".join(f'CASE WHEN isfinite({v}) THEN {v} END AS "{name}"' for name, v in values.items())
    return ",\n".join([*parts, f"{into} AS (SELECT {keep}, {columns} FROM {before})"])


def long(names: list[str], source: str = "wide", into: str = "s") -> str:
    """The CTE ``into`` (code, date, t, fwd, name, value) of a wide one, missing values included."""
    columns = ", ".join(f'"{n}"' for n in names)
    return f"{into} AS (SELECT code, date, t, fwd, name, value FROM {source} UNPIVOT INCLUDE NULLS (value FOR name IN ({columns})))"
