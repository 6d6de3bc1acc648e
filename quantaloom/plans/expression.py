"""The formula language: text -> syntax tree -> checked, folded tree of operator calls.

Grammar: sums of products of unary terms; a term is a number, a field, a call or a parenthesised sum.  A
number swallows a minus that touches it (``close -1`` is two operands in a row, hence an error; ``close - 1`` is fine),
and ``1e5`` is not a number.  Characters outside the language are an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from quantaloom.operators.registry import OPERATORS, Operator

MAX_DEPTH = 20
_INFIX = {"+": ("add", 1), "-": ("sub", 1), "*": ("mul", 2), "/": ("div", 2)}
_LEXEME = re.compile(r"\s*(?:(?P<number>-?\d+\.?\d*)|(?P<name>[A-Za-z_]\w*)|(?P<mark>[()+\-*/,])|(?P<end>$))", re.ASCII)


class FormulaError(ValueError):
    """A formula that cannot be parsed or compiled."""


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple[Node, ...]


Node = Number | Field | Call


def lexemes(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of each lexeme, 'end' last."""
    at = 0
    while True:
        m = _LEXEME.match(text, at)
        if m is None:
            raise FormulaError(f"Unexpected character {text[at:].lstrip()[:1]!r} in {text!r}")
        yield m.lastgroup, m.group(m.lastgroup)
        if m.lastgroup == "end":
            return
        at = m.end()


class _Reader:
    """Precedence climbing over the lexemes."""

    def __init__(self, text: str) -> None:
        self.items = list(lexemes(text))
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at]

    def take(self, mark: str | None = None) -> tuple[str, str]:
        item = self.items[self.at]
        if mark is not None and item != ("mark", mark):
            raise FormulaError(f"Expected {mark!r}, got {item[1] or 'end of formula'!r}")
        self.at += 1
        return item

    def sum(self, least: int = 1) -> Node:
        left = self.term()
        while self.peek()[0] == "mark" and (found := _INFIX.get(self.peek()[1])) and found[1] >= least:
            self.take()
            left = Call(found[0], (left, self.sum(found[1] + 1)))
        return left

    def term(self) -> Node:
        kind, text = self.take()
        if kind == "number":
            return Number(float(text))
        if kind == "mark" and text == "-":
            return Call("neg", (self.term(),))
        if kind == "mark" and text == "(":
            inner = self.sum()
            self.take(")")
            return inner
        if kind == "name":
            if self.peek() != ("mark", "("):
                return Field(text)
            self.take("(")
            args = []
            if self.peek() != ("mark", ")"):
                args.append(self.sum())
                while self.peek() == ("mark", ","):
                    self.take()
                    args.append(self.sum())
            self.take(")")
            return Call(text, tuple(args))
        raise FormulaError(f"Unexpected {text or 'end of formula'!r}")


@lru_cache(maxsize=65536)
def parse(text: str) -> Node:
    """The syntax tree of a formula; infix operators and unary minus are calls."""
    reader = _Reader(text)
    if len(reader.items) == 1:
        raise FormulaError("Empty formula")
    try:
        tree = reader.sum()
    except RecursionError:
        raise FormulaError(f"Formula is nested deeper than {MAX_DEPTH}") from None
    if reader.peek()[0] != "end":
        raise FormulaError(f"Unexpected {reader.peek()[1]!r}")
    return tree


def show(node: Node) -> str:
    """A formula that parses to ``node``."""
    if isinstance(node, Number):
        return repr(int(node.value)) if node.value == int(node.value) else repr(node.value)
    return node.name if isinstance(node, Field) else f"{node.op}({', '.join(map(show, node.args))})"


def depth(node: Node) -> int:
    return 1 + max(map(depth, node.args), default=0) if isinstance(node, Call) else 1


def fields(node: Node) -> set[str]:
    if isinstance(node, Field):
        return {node.name}
    return set().union(*map(fields, node.args)) if isinstance(node, Call) else set()


def _constant(node: Node) -> float | None:
    """The value of a formula without fields, if it is arithmetic alone."""
    if isinstance(node, Number):
        return node.value
    if isinstance(node, Field):
        return None
    args = [_constant(a) for a in node.args]
    if None in args:
        return None
    op = OPERATORS.get(node.op)
    return op.fold(*args) if op and op.fold and len(args) == op.arrays else None


def validate(text: str, known: set[str] | None = None) -> tuple[bool, str]:
    """(whether a formula is acceptable, why not): syntax, operators, arities, depth, and fields if ``known`` is given."""
    try:
        resolve(parse(text), known)
    except FormulaError as e:
        return False, str(e)
    return True, ""


def resolve(node: Node, known: set[str] | None = None, n_dates: int | None = None) -> Node:
    """Check a tree, and replace window and exponent arguments by numbers.

    Windows are truncated to integers and clamped to [2, ``n_dates``].  A window that depends on data is an error.
    """
    if depth(node) > MAX_DEPTH:
        raise FormulaError(f"Formula is nested deeper than {MAX_DEPTH}")
    return _resolve(node, known, n_dates)


def _resolve(node: Node, known: set[str] | None, n_dates: int | None) -> Node:
    if isinstance(node, Number):
        return node
    if isinstance(node, Field):
        if known is not None and node.name not in known:
            raise FormulaError(f"Unknown field: {node.name}")
        return node
    op: Operator | None = OPERATORS.get(node.op)
    if op is None:
        raise FormulaError(f"Unknown operator: {node.op}")
    if len(node.args) != op.arrays + op.scalars:
        raise FormulaError(f"{node.op} expects {op.arrays + op.scalars} arguments, got {len(node.args)}")
    args = [_resolve(a, known, n_dates) for a in node.args[: op.arrays]]
    for a in node.args[op.arrays :]:
        value = _constant(a)
        if value is None:
            raise FormulaError(f"{node.op}: the last argument must be a number, not {show(a)}")
        if op.window:
            value = max(2, int(value) if n_dates is None else min(int(value), n_dates))
        args.append(Number(float(value)))
    return Call(node.op, tuple(args))
