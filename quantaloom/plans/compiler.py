"""Formulas to DataFrame plans, a batch at a time.

Equal sub-trees of a batch are one node.  Window nodes are put into stages: a rolling node after its rolling and
cross-sectional inputs, so that all rolling nodes of a stage share one exchange and sort by (asset, date), and all
cross-sectional ones one exchange by date.  Cost follows the number of alternations between the two, not
the number of operators.  Element-wise nodes are expressions inside the stages.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaloom.operators.registry import ASSET, DATE, INDEX, OPERATORS, clean, finite
from quantaloom.operators.rolling import PARTS

from .expression import Call, Field, FormulaError, Node, Number, fields, parse, resolve

KEYS = (ASSET, DATE, INDEX)


def lower(node: Node) -> Node:
    """A tree without macros."""
    if not isinstance(node, Call):
        return node
    args = tuple(lower(a) for a in node.args)
    op = OPERATORS.get(node.op)
    if op is not None and op.kind == "macro":
        return lower(op.build(lambda name, *a: Call(name, a), *args))
    return Call(node.op, args)


def _kind(node: Node) -> str:
    return ("map" if node.op in PARTS else OPERATORS[node.op].kind) if isinstance(node, Call) else "leaf"


class Stages:
    """The window nodes of a batch by (phase, step): even phases roll, odd ones go across; steps nest within a phase."""

    def __init__(self) -> None:
        self.at: dict[Node, tuple[int, int]] = {}

    def place(self, node: Node) -> tuple[int, int]:
        """Where a node's value is there: (-1, 0) for what needs no window."""
        if node in self.at:
            return self.at[node]
        below = max([(-1, 0), *(self.place(a) for a in node.args)]) if isinstance(node, Call) else (-1, 0)
        kind = _kind(node)
        if kind in ("roll", "cross"):
            side = int(kind == "cross")
            if below[0] >= 0 and below[0] % 2 == side:
                below = (below[0], below[1] + 1)
            else:
                phase = below[0] + 1
                below = (phase + (phase % 2 != side), 0)
        self.at[node] = below
        return below

    def windows(self) -> dict[tuple[int, int], list[Node]]:
        found: dict[tuple[int, int], list[Node]] = {}
        for node, at in self.at.items():
            if _kind(node) in ("roll", "cross"):
                found.setdefault(at, []).append(node)
        return dict(sorted(found.items()))


def evaluate(panel: DataFrame, formulas: Mapping[str, str] | Sequence[str], n_dates: int, *, full: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """(code, date, t, ``keep`` ..., one double column per formula) of a dense panel with columns code, date, t and fields.

    ``formulas``: texts by column name, or texts alone, which are then their own names.  ``n_dates``: dates of the
    panel, the upper bound of windows.  ``full``: see ``operators.rolling``.  Infinite and NaN results are missing.
    """
    named = dict(formulas) if isinstance(formulas, Mapping) else {f: f for f in formulas}
    known = {c for c, kind in panel.dtypes if c not in KEYS and kind in ("double", "float", "bigint", "int")}
    trees = {name: lower(resolve(parse(text), known, n_dates)) for name, text in named.items()}
    if clash := set(named) & {*KEYS, *keep}:
        raise FormulaError(f"Formulas can't be named {sorted(clash)}")
    stages = Stages()
    for tree in trees.values():
        stages.place(tree)
    needed = sorted(set().union(*map(fields, trees.values()), keep))
    frame = panel.select(*KEYS, *[F.col(c).cast("double").alias(c) if c in known else F.col(c) for c in needed])
    names: dict[Node, str] = {}

    def column(node: Node) -> Column:
        if node in names:
            return F.col(names[node])
        if isinstance(node, Number):
            return F.lit(node.value)
        if isinstance(node, Field):
            return F.col(f"`{node.name}`")
        build = PARTS[node.op] if node.op in PARTS else OPERATORS[node.op].build
        n = len(node.args) if node.op in PARTS else OPERATORS[node.op].arrays
        return build(*[column(a) for a in node.args[:n]], *[a.value for a in node.args[n:]])

    for nodes in stages.windows().values():
        # What windows look at is a column of its own, computed once, NaN made missing.
        seen = {a: None for node in nodes for a in node.args[: OPERATORS[node.op].arrays] if a not in names and not isinstance(a, Field)}
        inputs = {a: f"__x{len(names) + i}" for i, a in enumerate(seen)}
        if inputs:
            frame = frame.select("*", *[clean(column(a).cast("double")).alias(name) for a, name in inputs.items()])
            names |= inputs
        made = {}
        for node in nodes:
            op = OPERATORS[node.op]
            args = [column(a) for a in node.args[: op.arrays]]
            made[node] = op.build(*args, *[int(a.value) for a in node.args[op.arrays :]], full) if op.kind == "roll" else op.build(*args)
        outputs = {node: f"__w{len(names) + i}" for i, node in enumerate(made)}
        frame = frame.select("*", *[made[node].alias(name) for node, name in outputs.items()])
        names |= outputs
    return frame.select(*KEYS, *keep, *[finite(column(tree).cast("double")).alias(name) for name, tree in trees.items()])
