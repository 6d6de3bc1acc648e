"""The operators of the formula language."""

from . import crosssection, elementwise, rolling
from .registry import OPERATORS, Operator, operator_names, register

__all__ = ["OPERATORS", "Operator", "crosssection", "elementwise", "operator_names", "register", "rolling"]
