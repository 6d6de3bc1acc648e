"""Connected components of an edge table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import free, materialize


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Alternates large-star and small-star steps, each a map-side combined minimum and a join,
    until the edges are stars around the minima.  Null ends and loops are ignored.  Rounds grow with the
    logarithm of the longest shortest path, not with the size of a component; every round is written to the
    shared folder.  A hub's neighbours are never gathered in one row.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u != v").distinct()
    e = materialize(e, "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u != v").distinct(), "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "stars")
        # Stars around the minima: nobody has two parents, and no parent has a parent of its own.
        parents = small.groupBy("u").agg(F.count("*").alias("n"))
        several = parents.where("n > 1").limit(1).count()
        chained = small.join(parents.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        free(e, large)
        if not several and not chained:
            break
        e = small
    roots = small.select(F.col("v").alias("u"), "v").distinct()
    return small.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))


def labelled(rows: DataFrame, labels: DataFrame, key: str | list[str], how: str = "left") -> DataFrame:
    """``rows`` joined ('left' or 'inner') to the columns of ``labels`` (key, rows, ...) but for ``rows``, which says how many rows have a key.

    Keys of many rows are few, at most 10,000 by the way they are chosen: their labels are broadcast, so that these rows stay where they
    are.  Only rows of the other keys are shuffled.  ``labels`` is read three times.
    """
    whole = labels.agg(F.sum("rows")).first()[0] or 0
    most = max(1000, whole // 10_000)
    common = F.broadcast(labels.where(F.col("rows") > most).drop("rows"))
    rare = labels.where(F.col("rows") <= most).drop("rows")
    return rows.join(common, key).unionByName(rows.join(common, key, "left_anti").join(rare, key, how))
