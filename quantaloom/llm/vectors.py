"""Vectors in Arrow kernels: validity, packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is neither null nor zero and holds neither null nor non-finite components."""
    c = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(c.isNotNull() & F.forall(c, finite) & F.exists(c, lambda x: x != 0), F.lit(False))


def of_one_length(rows: DataFrame, vector: str = "v") -> tuple[DataFrame, int, int]:
    """The rows whose vectors have the commonest length (of several the longest), that length (0 without rows) and their number.

    Vectors of other lengths have no cosine with these.
    """
    lengths = rows.groupBy(F.size(vector).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if lengths is None:
        return rows, 0, 0
    return rows.where(F.size(vector) == lengths["length"]), lengths["length"], lengths["count"]


def pivots(rows: DataFrame, n: int, k: int, sample_rows: int) -> np.ndarray:
    """k unit vectors by a few rounds of k-means on about ``sample_rows`` of n vectors (id, v), drawn by a hash of the id; those side by side have numbers side by side."""
    share = min(1.0, sample_rows / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 20)) < share * (1 << 20)).orderBy("id").limit(2 * sample_rows).select("v").toPandas()
    x = unit(np.stack(drawn["v"].to_list()) if len(drawn) else np.stack([rows.first()["v"]]))
    c = x[np.random.default_rng(5).permutation(len(x))[:k]]
    for _ in range(5):
        near = np.argmax(x @ c.T, 1)
        c = unit(np.stack([m if (m := x[near == i].sum(0)).any() else c[i] for i in range(len(c))]))
    return c[np.argsort(c @ np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0], kind="stable")]


def in_cells(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` (id, v) with ``pivot``, the number of the nearest of ``centres``."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, near = matrix(b.column(1)), []
                for at in range(0, len(x), 4096):
                    near.append(np.argmax(unit(x[at : at + 4096]) @ sent.value.T, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(near).astype(np.int32))], names=["id", "v", "pivot"])

    return rows.select("id", "v").mapInArrow(assign, f"id long, v {rows.schema['v'].dataType.simpleString()}, pivot int")


def deal(sizes: dict[int, int], most: int) -> tuple[dict[int, int], dict[int, int], int]:
    """The first tile of each pivot, the number of tiles that it is dealt to, and the number of all tiles, of at most ``most`` rows or so.

    Pivots in order fill a tile; one that alone has more rows than a tile gets tiles of its own.
    """
    first, parts, at, held = {}, {}, 0, 0
    for pivot, n in sorted(sizes.items()):
        if held and held + n > most:
            at, held = at + 1, 0
        first[pivot], parts[pivot] = at, max(1, -(-n // most))
        held += n
        if parts[pivot] > 1:
            at, held = at + parts[pivot], 0
    return first, parts, at + (held > 0)


def in_tiles(cells: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``cells`` (id, v, pivot) with ``tile``, of at most ``most`` rows or so and made of neighbouring cells, and the number of tiles."""
    sizes = {r["pivot"]: r["count"] for r in cells.groupBy("pivot").count().collect()}  # one row per pivot
    firsts, parts, total = deal(sizes, most)
    of = lambda by: F.element_at(F.create_map(*[F.lit(x) for kv in by.items() for x in kv]), F.col("pivot"))
    return cells.withColumn("tile", (of(firsts) + F.pmod(F.xxhash64(F.lit(11), "id"), of(parts))).cast("int")), total


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in its own precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = len(column)
    if n and len(flat) % n:
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision; very small and large rows keep their direction."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the rows of ``a`` with those of ``b``, row by row, in double precision; equal inputs give equal results."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
