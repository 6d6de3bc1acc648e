"""Metrics of signals and of return series."""
