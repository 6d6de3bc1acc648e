"""Approximate nearest neighbours by cosine: one vantage-point tree per shard, pruning relaxed by a factor.

Rows are dealt to shards of bounded size, made of the cells of a few pivots (fitted on a bounded sample) that lie side by side; a
shard's tree is built where the shard is and packed with its vectors into one row of the index, beside the ball around them.  Query
vectors, packed in blocks of bounded size by their nearest shard, meet that one first.  The distance to the nearest found there is a bound: by the
triangle inequality, relaxed by the factor, only shards whose balls come that near are asked as well.  What the shards find is merged per query.

In a shard, all queries of a block descend together: a query without a bound asks the leaf on its own side of every vantage point first; then, at a
node, its own side, and the other side only if ``factor * |distance - radius|`` is within its current search radius.  By the triangle
inequality factor 1 loses nothing; a larger factor skips more.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vectors import cosine, in_cells, in_tiles, matrix, of_one_length, pivots, unit, usable
from .workspace import materialize, table

#: Rows of a shard at least, and shards (or so) at most, so that their centres can be broadcast.
SHARD_ROWS, SHARDS = 4096, 16_384
#: Beyond FEW * SHARD_ROWS rows shards grow up to WIDE rows before they become more: where no shard can be skipped, the blocks of queries are sent to each.
FEW, WIDE = 64, 65_536
#: Pairs that are measured in double precision at a time.
PAIRS = 1 << 15
BLOCK_QUERIES = 1024
SAMPLE_ROWS = 10_000
PIVOTS = 1024
LEAF = 192
FACTOR = 1.05


def build_tree(x: np.ndarray, leaf: int = LEAF, seed: int = 1) -> list[tuple]:
    """A vantage-point tree over the rows of ``x`` (unit vectors), as nodes in a list, the root first.

    A node is (row of the vantage point, radius, inside node, outside node) or, at a leaf, (None, rows).
    """
    rng = np.random.default_rng(seed)
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), None, 0)]
    while todo:
        rows, parent, side = todo.pop()
        at = len(nodes)
        if parent is not None:
            nodes[parent] = (*nodes[parent][: 2 + side], at, *nodes[parent][3 + side :])
        if len(rows) <= leaf:
            nodes.append((None, rows))
            continue
        tries = rng.choice(rows, 4, replace=False)
        probe = rng.choice(rows, min(len(rows), 128), replace=False)
        spread = [np.sqrt(np.maximum(0, 2 - 2 * x[probe] @ x[v])).std() for v in tries]
        v = tries[int(np.argmax(spread))]
        rest = rows[rows != v]
        d = np.sqrt(np.maximum(0, 2 - 2 * x[rest] @ x[v]))
        half = np.argsort(d, kind="stable")
        inside, outside = rest[half[: len(rest) // 2]], rest[half[len(rest) // 2 :]]
        radius = float((d[half[len(rest) // 2 - 1]] + d[half[len(rest) // 2]]) / 2)
        nodes.append((int(v), radius, -1, -1))
        todo += [(outside, at, 1), (inside, at, 0)]
    return nodes


class Search:
    """The nearest ``k`` rows of a shard for each query of a block.

    A leaf is met once by all queries that ask for it.  Cosines in single precision, one matrix product, say which of its rows can be nearer
    than what a query has; only these, few beside all, are measured in double precision.
    """

    def __init__(self, x: np.ndarray, nodes: list[tuple], q: np.ndarray, own: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> None:
        """``own``: for each query the row that it is itself in the shard, or -1; ``bound``: the distance beyond which nothing is wanted."""
        self.x, self.nodes, self.q, self.own, self.k, self.factor = x, nodes, q, own, k, factor
        self.d = np.full((len(q), k), np.inf) if bound is None else np.repeat(bound[:, None], k, 1)
        self.row = np.full((len(q), k), -1)
        self.compared = 0
        if not len(x) or not len(q):
            return
        self.x32, self.q32 = x.astype(np.float32), q.astype(np.float32)
        #: What cosines of unit vectors in single precision are off at most.
        self.off = (x.shape[1] + 8) * 2.0**-23
        points = np.array([n[0] for n in nodes if n[0] is not None], dtype=np.int64)
        self.column = {int(v): i for i, v in enumerate(points)}
        self.to_points = np.sqrt(np.maximum(0, 2 - 2 * q @ x[points].T))
        everyone, self.met = np.arange(len(q)), np.full(len(q), -1)
        if len(points):
            self.offer(everyone, points)
        if (lost := np.flatnonzero(np.isinf(self.d[:, -1]) | (bound is None))).size:
            self.descend(0, lost)
        self.visit(0, everyone)

    def offer(self, who: np.ndarray, rows: np.ndarray) -> None:
        c = (self.q32 if len(who) == len(self.q) else self.q32[who]) @ self.x32[rows].T
        self.compared += c.size
        least = 1 - self.d[who, -1] ** 2 / 2 - self.off
        bare = np.flatnonzero(np.isneginf(least))
        if len(bare) and len(rows) > self.k + 1:  # the k-th of these rows, beside the query's own, is a bound
            least[bare] = np.partition(c[bare], len(rows) - self.k - 1, axis=1)[:, len(rows) - self.k - 1] - 2 * self.off
        hit = np.flatnonzero((c >= least.astype(np.float32)[:, None]).ravel())
        for at in range(0, len(hit), PAIRS):
            i, j = np.divmod(hit[at : at + PAIRS], len(rows))
            self.take(who[i], rows[j])

    def take(self, who: np.ndarray, rows: np.ndarray) -> None:
        """Put pairs of queries and rows among what has been found."""
        d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", self.q[who], self.x[rows])))
        near = (d < self.d[who, -1]) & (self.own[who] != rows)
        who, rows, d = who[near], rows[near], d[near]
        if not len(who):
            return
        some = np.unique(who)
        every_q, every_d, every_r = np.r_[np.repeat(some, self.k), who], np.r_[self.d[some].ravel(), d], np.r_[self.row[some].ravel(), rows]
        order = np.lexsort((every_d, every_q))
        best = order[(np.searchsorted(every_q[order], some)[:, None] + np.arange(self.k)).ravel()]
        self.d[some], self.row[some] = every_d[best].reshape(-1, self.k), every_r[best].reshape(-1, self.k)

    def descend(self, node: int, who: np.ndarray) -> None:
        """The leaf on a query's own side of every vantage point, for a first bound."""
        n = self.nodes[node]
        if n[0] is None:
            self.met[who] = node
            self.offer(who, n[1])
            return
        within = self.to_points[who, self.column[n[0]]] < n[1]
        for side, mine in ((n[2], within), (n[3], ~within)):
            if mine.any():
                self.descend(side, who[mine])

    def visit(self, node: int, who: np.ndarray) -> None:
        n = self.nodes[node]
        if n[0] is None:
            who = who[self.met[who] != node]
            if len(who) and len(n[1]):
                self.offer(who, n[1])
            return
        v, radius, inside, outside = n
        d = self.to_points[who, self.column[v]]
        for side, mine in ((inside, d < radius), (outside, d >= radius)):
            asked = who[mine | (self.factor * np.abs(d - radius) <= self.d[who, -1])]
            if len(asked):
                self.visit(side, asked)


def _shard(ids: np.ndarray, raw: np.ndarray, keep: int) -> dict:
    """A shard's packed form: its distinct vectors, a tree over them, and of each the ``keep`` smallest ids (``ids`` from ``cut`` to the next)."""
    raw = np.ascontiguousarray(raw)
    raw = raw + np.zeros(1, raw.dtype)  # -0.0 equals 0.0
    _, first, inverse = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel(), return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([inverse.ravel(), ids]), axis=1)
    starts = np.searchsorted(pairs[0], np.arange(len(first)))
    pairs = pairs[:, np.arange(pairs.shape[1]) - starts[pairs[0]] < keep]
    return {"raw": raw[first], "ids": pairs[1], "cut": np.searchsorted(pairs[0], np.arange(len(first) + 1)), "tree": build_tree(unit(raw[first]))}


def _nearest(s: dict, ids: np.ndarray, raw: np.ndarray, bound: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the k nearest in a shard within each query's bound, ties to the smaller id."""
    sizes = np.diff(s["cut"])
    # A query may be one of several equal vectors: then only its own id is left out, not the row.
    rows = np.flatnonzero(sizes == 1)
    single = s["ids"][s["cut"][rows]]
    by = np.argsort(single, kind="stable")
    at = np.minimum(np.searchsorted(single[by], ids), max(0, len(by) - 1))
    alone = np.where(single[by][at] == ids, rows[by][at], -1) if len(by) else np.full(len(ids), -1)
    # Some more than k are taken, as distances near 0 are rounded; the scores decide.
    found = Search(unit(s["raw"]), s["tree"], unit(raw), alone, k + 4, factor, bound)
    who, place = np.nonzero(found.row >= 0)
    rows = found.row[who, place]
    score = cosine(raw[who], s["raw"][rows])
    n = sizes[rows]
    held = np.repeat(s["cut"][rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    who, score, other = np.repeat(who, n), np.repeat(score, n), s["ids"][held]
    mine = other != ids[who]
    who, score, other = who[mine], score[mine], other[mine]
    order = np.lexsort((other, -score, who))
    who, score, other = who[order], score[order], other[order]
    best = np.arange(len(who)) - np.searchsorted(who, who) < k
    return ids[who[best]], other[best], score[best]


def build_index(vectors: DataFrame, *, k: int = 5, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(shard int, dims int, centre, radius, body binary), one row per shard of about ``shard_rows`` vectors, written to the shared folder.

    Equal vectors of a shard are held once with their k + 1 smallest ids, which is all that k neighbours can need.
    Null ids and unusable vectors (null, zero, null or non-finite components, another length than the commonest) are left out.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(usable("v") & F.col("id").isNotNull())
    schema = "shard int, dims int, centre array<double>, radius double, body binary"
    rows, dims, n = of_one_length(rows)
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    most = max(shard_rows, min(WIDE, -(-n // FEW)), -(-n // SHARDS))
    cells, total = in_tiles(in_cells(rows, pivots(rows, n, min(PIVOTS, max(1, n // (shard_rows // 4 or 1))), sample_rows)), most)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        raw = np.stack(frame["v"].to_list())
        x = unit(raw)
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
        body = pickle.dumps(_shard(frame["id"].to_numpy(), raw, k + 1), protocol=5)
        return pd.DataFrame({"shard": [int(frame["tile"].iloc[0])], "dims": [raw.shape[1]], "centre": [centre.tolist()], "radius": [radius], "body": [body]})

    return materialize(cells.repartition(total, "tile").groupBy("tile").applyInPandas(pack, schema), "ann-index")


def _block(own: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and bounds of a block of queries."""
    return own.field("id").to_numpy(zero_copy_only=False), matrix(own.field("v")), own.field("bound").to_numpy(zero_copy_only=False)


def _answers(met: DataFrame, k: int, factor: float) -> DataFrame:
    """(query_id, vec_id, score) of blocks of queries ``own`` (id, v, bound; or pickled arrays of these) that meet a shard's ``body``; of the nearest within each query's bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = pickle.loads(b.column(1)[i].as_buffer())
                own = b.column(0)[i]
                found = _nearest(s, *(pickle.loads(own.as_buffer()) if isinstance(own, pa.BinaryScalar) else _block(own.values)), k, factor)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return met.select("own", "body").mapInArrow(run, "query_id long, vec_id long, score double")


def search(
    index: DataFrame, queries: DataFrame, *, k: int = 5, factor: float = FACTOR, block: int = BLOCK_QUERIES, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by cosine, itself (its id) left out, ties to the smaller id.

    ``index`` must have been built for this k or a larger one.  Unusable queries, those of another length than the index's vectors and null ids
    take no part; a repeated query id with one vector counts once.  Fewer candidates than k: all of them; none or no query: an empty result.
    """
    spark = queries.sparkSession
    shards = index.select("shard", "dims", "centre", "radius").orderBy("shard").toPandas()  # at most SHARDS or so, and as many as have a pivot
    dims = int(shards["dims"].iloc[0]) if len(shards) else 0
    q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(usable("v") & F.col("id").isNotNull() & (F.size("v") == dims)).distinct()
    kind = q.schema["v"].dataType.simpleString()
    sent = spark.sparkContext.broadcast((shards["shard"].to_numpy(), np.stack(shards["centre"].to_list()) if len(shards) else np.zeros((0, 1)), shards["radius"].to_numpy(float)))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centres, _ = sent.value
        for b in batches:
            if b.num_rows:
                home = names[np.argmin((centres**2).sum(1) - 2 * unit(matrix(b.column(1))) @ centres.T, 1)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32))], names=["id", "v", "shard"])

    homes = materialize(q.mapInArrow(at_home, f"id long, v {kind}, shard int"), "ann-queries")
    blocks = homes.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = homes.join(F.broadcast(blocks), "shard").withColumn("block", F.pmod(F.xxhash64(F.lit(9), "id"), F.col("blocks")))  # one row per shard is broadcast
    item = F.struct("id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    packed = dealt.withColumn("bound", F.lit(None).cast("double")).groupBy("shard", "block").agg(F.collect_list(item).alias("own"))
    bodies = index.select("shard", "body")
    first = materialize(_answers(packed.join(bodies, "shard"), k, factor), "ann-first")

    # The k-th best of the own shard bounds what the others can add; some slack covers rounding.
    best = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("best"))
    far = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.get("best", F.lit(k - 1)))) + F.lit(1e-6)
    bounded = homes.join(best.select(F.col("query_id").alias("id"), far.alias("bound")), "id", "left")
    # Blocks of queries of neighbouring shards, as they ask the same others; few, as a shard is sent and unpacked for each.
    count, block = homes.count(), 4 * block
    bounded = materialize(bounded.withColumn("range", F.floor(F.col("shard") * F.lit(-(-count // block) / max(1, len(shards)))).cast("int")), "ann-bounds")
    ranges = bounded.groupBy("range").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    ranges = bounded.join(F.broadcast(ranges), "range").withColumn("block", F.pmod(F.xxhash64(F.lit(9), "id"), F.col("blocks")))  # no more rows than shards are broadcast
    packed = ranges.groupBy("range", "block").agg(F.collect_list(F.struct("id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), "shard")).alias("own"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centres, radii = sent.value
        for b in batches:
            for i in range(b.num_rows):
                own = b.column(0)[i].values
                ids, raw, bound = _block(own)
                u, home = unit(raw), own.field("shard").to_numpy(zero_copy_only=False)
                gap = np.sqrt(np.maximum(0, 1 + (centres**2).sum(1)[None] - 2 * u @ centres.T)) - radii[None]
                wanted = (factor * gap <= bound[:, None] + 1e-9) & (names[None] != home[:, None])
                for s in np.flatnonzero(wanted.any(0)).tolist():
                    asked = wanted[:, s]
                    body = pickle.dumps((ids[asked], raw[asked], bound[asked]), protocol=5)
                    yield pa.RecordBatch.from_arrays([pa.array([int(names[s])], pa.int32()), pa.array([body], pa.binary())], names=["shard", "own"])

    visits = packed.select("own").mapInArrow(others, "shard int, own binary")
    # Blocks that are sent to many shards are many times the queries: Spark, which does not see that, must not broadcast them.
    near = first.unionByName(_answers(visits.join(bodies.hint("merge"), "shard"), k, factor))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(build_index(vectors), vectors.where("vec_id % 50 = 0"))


def exact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of ``query`` without relaxation, which loses nothing."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(build_index(vectors), vectors.where("vec_id % 50 = 0"), factor=1.0).withColumn("score", F.round("score", 9))


EXACT_ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 9) AS score FROM r WHERE rank <= 5
"""
