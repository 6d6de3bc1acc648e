"""Cross-sectional operators: over the assets of a date."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .registry import ASSET, DATE, EPS, across, register


def ordinal(x: Column) -> Column:
    """1-based rank of present values within a date; ties go by asset; missing values rank last."""
    return F.row_number().over(Window.partitionBy(DATE).orderBy(x.asc_nulls_last(), ASSET))


@register("cs_rank", "cross")
def cs_rank(x: Column) -> Column:
    """Ordinal rank over the number of present values, in (0, 1]."""
    return F.when(x.isNotNull(), ordinal(x) / F.count(x).over(across()))


@register("cs_zscore", "cross")
def cs_zscore(x: Column) -> Column:
    return (x - F.avg(x).over(across())) / (F.stddev_pop(x).over(across()) + F.lit(EPS))


@register("cs_scale", "cross")
def cs_scale(x: Column) -> Column:
    return x / (F.sum(F.abs(x)).over(across()) + F.lit(EPS))


@register("cs_demean", "cross")
def cs_demean(x: Column) -> Column:
    return x - F.avg(x).over(across())
