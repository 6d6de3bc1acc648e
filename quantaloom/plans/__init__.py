"""Formulas and their plans."""
