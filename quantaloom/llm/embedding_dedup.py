"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors, cosine >= t means a squared distance <= 2 - 2t.  The vectors are turned by one
random rotation and split into blocks of few dimensions; if the whole squared distance keeps within its budget, then
some block keeps within the share of the budget that is proportional to its dimensions.  So each block is joined by range
under its share, and the union of what the blocks find is verified on the original vectors in double precision: no
link is lost, none is made up.

The range joins run over tiles of bounded size, made of the cells of a few pivots (fitted on a bounded sample) that lie side by side; a
cell of too many rows is dealt to several tiles.  Tiles, and the parts of a tile, have a ball around each of their blocks: two of them are joined in
the blocks only whose balls come within the share, and skipped if there is none.  A left tile meets several right tiles in one task, so that
it is sent once for these.  Equal vectors of a tile are joined once, with their number.  What leaves a task is, per row, a count of links
and one edge towards the smallest row of its group: pairs are never written out.

Why blocks are not of two or three dimensions: for vectors without structure the share of all pairs that comes within a block's share of the budget is
that of a chi-squared variable of so many dimensions to be below (1 - threshold) times its mean: at 0.9 it is 1.8 % for blocks of 4, 0.08 % for 8 and
0.0003 % for 16 of 64 dimensions.  Sixteen blocks of 4 would have a quarter of all pairs verified.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .vectors import in_cells, in_tiles, of_one_length, pivots, unit, usable
from .workspace import free, materialize, table

#: Bytes of a tile's vectors at most, and the least number of tiles that a larger table is dealt to.
TILE_BYTES, TILES = 8 << 20, 8
PART_ROWS = 512
BLOCKS = 4
#: Pivots at most, half a MiB of them at 64 dimensions: what is broadcast has a bound.  More rows than they have cells for lose no link.
PIVOTS = 1024
SAMPLE_ROWS = 10_000
#: Tiles whose balls may be broadcast (half a KiB each at 64 dimensions).
BALLS = 16_384


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def splits(dims: int, blocks: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dims, min(blocks, dims) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


@dataclass
class Tile:
    """A tile's rows: ``ids``, for each the number of its vector, and the distinct vectors, part by part.

    ``edges``: where parts begin and end; ``centres`` and ``radii``: of each part's ball in each block, of the rotated vectors.
    """

    ids: np.ndarray
    vector: np.ndarray
    raw: np.ndarray
    edges: np.ndarray
    centres: np.ndarray
    radii: np.ndarray

    def unpack(self) -> None:
        self.unit = unit(self.raw)
        self.turned = (self.unit @ rotation(self.raw.shape[1])).astype(np.float32)
        self.weight = np.bincount(self.vector, minlength=len(self.raw))
        self.least = np.full(len(self.raw), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.vector, self.ids)


def _balls(x: np.ndarray, edges: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres [parts, dims] and radii [parts, blocks] of the parts of ``x`` between ``edges``."""
    centres = np.stack([x[a:b].mean(0) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    radii = np.stack([[np.sqrt(((x[a:b, p:q] - c[p:q]) ** 2).sum(1).max()) for p, q in splits(x.shape[1], blocks)] for a, b, c in zip(edges[:-1], edges[1:], centres, strict=True)])
    return centres, radii


def _tile(ids: np.ndarray, raw: np.ndarray, cell: np.ndarray, blocks: int, part_rows: int = PART_ROWS) -> tuple[Tile, np.ndarray, np.ndarray]:
    """A tile of rows in ``cell`` each, and the centre and block radii of the whole."""
    order = np.lexsort((ids, cell))
    ids, cell, raw = ids[order], cell[order], np.ascontiguousarray(raw[order]) + np.zeros(1, raw.dtype)  # -0.0 equals 0.0
    _, first, vector = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel(), return_index=True, return_inverse=True)
    place = np.argsort(first)  # distinct vectors in order of their cells
    number = np.empty(len(first), np.int64)
    number[place] = np.arange(len(first))
    first, vector = first[place], number[vector.ravel()]
    raw, cell = raw[first], cell[first]
    edges = [0]
    for end in [*np.flatnonzero(np.diff(cell)) + 1, len(raw)]:
        edges += [*range(edges[-1] + part_rows, end, part_rows), end]
    x = unit(raw) @ rotation(raw.shape[1])
    edges = np.array(edges)
    centres, radii = _balls(x, np.array([0, len(x)]), blocks)
    return Tile(ids, vector, raw, edges, *_balls(x, edges, blocks)), centres[0], radii[0]


def _links(a: Tile, b: Tile, threshold: float, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors i of ``a`` and j of ``b`` (i < j if these are the same) with cosine >= threshold, found block by block."""
    dims, budget, same = a.raw.shape[1], 2 - 2 * threshold, a is b
    meets = []
    for k, (p, q) in enumerate(splits(dims, blocks)):
        u, v = a.centres[:, p:q], b.centres[:, p:q]
        gap = np.sqrt(np.maximum(0, (u * u).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * u @ v.T))
        meets.append(gap - a.radii[:, k, None] - b.radii[None, :, k] <= np.sqrt(budget * (q - p) / dims) + 1e-6)
    left, right = [], []
    for p, q in splits(dims, blocks):
        u, v = a.turned[:, p:q], b.turned[:, p:q]
        left.append(np.concatenate([u * -2, (u * u).sum(1, keepdims=True), np.ones((len(u), 1), np.float32)], 1))
        right.append(np.concatenate([v, np.ones((len(v), 1), np.float32), (v * v).sum(1, keepdims=True)], 1).T.copy())
    found_i, found_j = [], []
    for s, t in zip(*np.nonzero(np.any(meets, 0)), strict=True):
        if same and t < s:
            continue
        rows, columns = slice(a.edges[s], a.edges[s + 1]), slice(b.edges[t], b.edges[t + 1])
        near = None
        for k, (p, q) in enumerate(splits(dims, blocks)):
            if meets[k][s, t]:
                # The slack covers single precision; what it lets in is verified.
                own = left[k][rows] @ right[k][:, columns] <= np.float32(budget * (q - p) / dims + 1e-5)
                near = own if near is None else near | own
        i, j = np.divmod(np.flatnonzero(near), near.shape[1])
        i, j = i + rows.start, j + columns.start
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 15):
            ii, jj = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            good = (a.unit[ii] * b.unit[jj]).sum(1) >= threshold
            found_i.append(ii[good])
            found_j.append(jj[good])
    none = np.empty(0, np.int64)
    return (np.concatenate(found_i) if found_i else none), (np.concatenate(found_j) if found_j else none)


def _least(n: int, i: np.ndarray, j: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each of n nodes the least start value in its component under edges (i, j)."""
    label = start.copy()
    while len(i):
        before = label.copy()
        m = np.minimum(label[i], label[j])
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        if (label == before).all():
            break
    return label


def _join(a: Tile, b: Tile, threshold: float, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, least id of its group) of every row that has a link within the pair of tiles."""
    i, j = _links(a, b, threshold, blocks)
    links_a = np.bincount(i, b.weight[j], len(a.raw)).astype(np.int64)
    links_b = np.bincount(j, a.weight[i], len(b.raw)).astype(np.int64)
    if a is b:
        links = links_a + links_b + a.weight - 1
        least = _least(len(a.raw), i, j, a.least)
        rows = links[a.vector] > 0
        return a.ids[rows], links[a.vector][rows], least[a.vector][rows]
    least = _least(len(a.raw) + len(b.raw), i, j + len(a.raw), np.concatenate([a.least, b.least]))
    in_a, in_b = links_a[a.vector] > 0, links_b[b.vector] > 0
    return (
        np.concatenate([a.ids[in_a], b.ids[in_b]]), np.concatenate([links_a[a.vector][in_a], links_b[b.vector][in_b]]),
        np.concatenate([least[a.vector][in_a], least[len(a.raw) + b.vector][in_b]]),
    )


def near_duplicates(
    vectors: DataFrame, *, threshold: float = 0.9, blocks: int = BLOCKS, tile_rows: int | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``.

    A row links with every other row of cosine >= threshold.  Unusable vectors (null, zero, null or non-finite components, another length than the
    commonest, of equally common ones the longest) link with nothing and stay.  Ids are expected to be unique; rows that repeat an id share its links and its component.  Null ids keep
    null components.  An empty table gives an empty result.

    ``tile_rows``: by default an eighth of the rows, at most as many as TILE_BYTES hold.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    out = base.select(F.col("id").alias("vec_id"))
    rows, dims, n = of_one_length(base.where(usable("v") & F.col("id").isNotNull()))
    if not n:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    tile_rows = tile_rows or max(1, min(TILE_BYTES // (4 * dims), -(-n // TILES)))
    cells, total = in_tiles(in_cells(rows, pivots(rows, n, min(PIVOTS, max(1, n // PART_ROWS)), sample_rows)), tile_rows)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        body, centre, radii = _tile(frame["id"].to_numpy(), np.stack(frame["v"].to_list()), frame["pivot"].to_numpy(), blocks)
        return pd.DataFrame({"tile": [int(frame["tile"].iloc[0])], "body": [pickle.dumps(body, protocol=5)], "centre": [centre.tolist()], "radii": [radii.tolist()]})

    tiles = cells.repartition(min(total, 1 << 14), "tile").groupBy("tile")
    tiles = materialize(tiles.applyInPandas(pack, "tile int, body binary, centre array<double>, radii array<double>"), "vector-tiles")

    # Every pair of tiles once; those whose balls are too far apart in all blocks fall out before any vector moves.
    balls = tiles.select(F.col("tile").alias("j"), F.col("centre").alias("cj"), F.col("radii").alias("rj"))
    balls = F.broadcast(balls) if total <= BALLS else balls
    pairs = tiles.select(F.col("tile").alias("i"), F.col("centre").alias("ci"), F.col("radii").alias("ri"), F.explode(F.sequence("tile", F.lit(total - 1))).alias("j")).join(balls, "j")
    near_blocks = []
    for k, (p, q) in enumerate(splits(dims, blocks)):
        gap = F.sqrt(F.aggregate(F.zip_with(F.slice("ci", p + 1, q - p), F.slice("cj", p + 1, q - p), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        near_blocks.append(gap - F.get("ri", F.lit(k)) - F.get("rj", F.lit(k)) <= float(np.sqrt((2 - 2 * threshold) * (q - p) / dims)) + 1e-6)
    meets = near_blocks[0]
    for c in near_blocks[1:]:
        meets = meets | c
    # A task has a left tile and the right tiles of one span, the left one first; it meets itself where that is the first span.
    span = max(2, total // 64)
    pairs = materialize(pairs.where(meets | (F.col("i") == F.col("j"))).select("i", F.floor((F.col("j") - F.col("i")) / span).cast("int").alias("part"), "j"), "tile-pairs")
    lefts = pairs.select("i", "part").distinct().join(tiles.select(F.col("tile").alias("i"), "body"), "i").select("i", "part", F.lit(-1).alias("j"), "body")
    rights = pairs.where("i < j").join(tiles.select(F.col("tile").alias("j"), "body"), "j").select("i", "part", "j", "body")
    tasks = min(1 << 14, pairs.select("i", "part").distinct().count())
    met = lefts.unionByName(rights).repartition(max(1, tasks), "i", "part").sortWithinPartitions("i", "part", "j")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, at = None, None
        for b in batches:
            for k in range(b.num_rows):
                i, part, j = (b.column(c)[k].as_py() for c in range(3))
                other = pickle.loads(b.column(3)[k].as_buffer())
                other.unpack()
                if j < 0:
                    left, at = other, (i, part)
                    if part:
                        continue
                elif at != (i, part):
                    raise ValueError("a right tile without its left one")
                ids, links, least = _join(left, other, threshold, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(least)], names=["id", "links", "least"])

    found = materialize(met.mapInArrow(join, "id long, links long, least long"), "vector-links")
    free(tiles, pairs)
    links = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    groups = connected_components(found, "id", "least")
    out = out.join(links.withColumnRenamed("id", "vec_id"), "vec_id", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) n ON n.x = e.vec_id LEFT JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON c.x = e.vec_id
"""
