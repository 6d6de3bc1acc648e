"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every source gets a target number of words: its weight's share of all words, but at most ``cap`` times what
it has, the excess going to the others by weight (a water level, found by prefix sums over the sources).
A document is first due ``target / source_size`` copies; the fraction is settled by pivotal
rounding: two documents with fractional copies trade words, in a random direction whose odds keep both
expectations, until one is integral; the other meets the next.

A source's few largest documents go first, each trading with all the smaller ones as a whole: its fraction becomes integral, and what
it gave or took changes the fraction of the rest.  The rest meets in a reduction tree: documents of like size (within a factor of two) meet
in blocks of about ``block`` rows, each block leaves one fractional document, and these meet again in blocks, level by level.  No task holds
more than some blocks whatever a source's share of the rows; the number of levels grows with the logarithm of the rows.

What is open in the end is one document for each class of sizes; these are settled from the largest to the smallest.  Where the
smaller documents could not make up for one of the outcomes, the document goes to the side that leaves the source nearer to its
target.  A source's words so miss the target by about the length of a small document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of a source that are settled before all others, the largest ones.
HEADS = 16


def _running(rows: DataFrame, order: list[Column], sums: list[str], label: str) -> DataFrame:
    """``rows`` with ``at``, their number in ``order`` from 0, and ``before_x`` for each x of ``sums``: its sum over the rows before.

    Rows are dealt by ranges of the order; within a range they are counted by a window, and the ranges' totals, one row for each, are added.
    """
    dealt = materialize(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), label)
    within = Window.partitionBy("range").orderBy(*order)
    ranges = dealt.groupBy("range").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"all_{x}") for x in sums])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"skip_{c}") for c in ("n", *(f"all_{x}" for x in sums))])
    rows = dealt.join(F.broadcast(ranges), "range")  # as many rows as there are shuffle partitions
    at = (F.row_number().over(within) - 1 + F.col("skip_n")).alias("at")
    before = [(F.sum(x).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(x) + F.col(f"skip_all_{x}")).alias(f"before_{x}") for x in sums]
    return rows.select(*[c for c in dealt.columns if c != "range"], at, *before)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) per source of ``sizes`` (source, size).

    Sources stand in code point order, null last, and take ``weights`` in turn, repeating.
    A source of size 0 has target 0.
    """
    name = F.col("source").asc_nulls_last()
    per = _running(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [name], [], "mix-sources")
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("at"), F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).drop("at").withColumn("most", F.col("source_size") * F.lit(float(cap)))
    per = materialize(_running(per.withColumn("full_at", F.col("most") / F.col("w")), [F.col("full_at"), name], ["most", "w"], "mix-levels"), "mix-levels")
    whole = per.agg(F.sum("source_size").alias("words"), F.sum("w").alias("weight"))
    water = (F.col("words") - F.col("before_most")) / (F.col("weight") - F.col("before_w"))
    level = per.join(F.broadcast(whole)).select("full_at", water.alias("water"))  # one row is broadcast
    level = level.where("water <= full_at").agg(F.min_by("water", "full_at").alias("level"))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("w")))
    return per.join(F.broadcast(level)).select("source", "source_size", target.alias("target"))


def _chance(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))


def _meet(seed: int):
    """The pivotal step as the merge function of an aggregate over a block's items."""

    def settle(item: Column, bit: int) -> Column:
        return F.struct(item["doc_id"].alias("doc_id"), item["h"].alias("h"), item["size"].alias("size"), F.lit(bit).alias("bit"))

    def left(item: Column, p: Column) -> Column:
        return F.struct(item["order"].alias("order"), item["h"].alias("h"), item["doc_id"].alias("doc_id"), item["size"].alias("size"), p.alias("p"))

    def merge(acc: Column, b: Column) -> Column:
        a = acc["open"]
        has_a, lacks_a = a["size"] * a["p"], a["size"] * (1 - a["p"])
        has_b, lacks_b = b["size"] * b["p"], b["size"] * (1 - b["p"])
        to_a, to_b = F.least(lacks_a, has_b), F.least(has_a, lacks_b)
        gains = _chance(seed, a["h"], b["h"]) * (to_a + to_b) <= to_b

        def then(done: Column, still: Column) -> Column:
            return F.struct(still.alias("open"), F.array_append(acc["done"], done).alias("done"))

        return (
            F.when(gains & (lacks_a <= has_b), then(settle(a, 1), left(b, b["p"] - to_a / b["size"])))
            .when(gains, then(settle(b, 0), left(a, a["p"] + to_a / a["size"])))
            .when(has_a <= lacks_b, then(settle(a, 0), left(b, b["p"] + to_b / b["size"])))
            .otherwise(then(settle(b, 1), left(a, a["p"] - to_b / a["size"])))
        )

    return merge


def _in_turn(seed: int, kind: str, due: Column, rest: Column, chance) -> Column:
    """``items`` (order, h, doc_id, size, p), a few, settled in order: (due, rest, done), the words still due and those of the documents still to come, and the decisions.

    ``chance``: of the state and an item, its odds while the documents still to come can make up for either outcome.
    """
    start = F.struct(due.alias("due"), rest.alias("rest"), F.expr(f"cast(array() as array<struct<doc_id:{kind},size:bigint,bit:int>>)").alias("done"))

    def step(s: Column, x: Column) -> Column:
        left = s["rest"] - x["size"]
        over, short = F.greatest(x["size"] - s["due"], F.lit(0.0)), F.greatest(s["due"] - left, F.lit(0.0))
        near = F.abs(over - short) < 1e-6  # as a rule because both are 0
        bit = F.when(near, (_chance(seed, x["h"]) < chance(s, x)).cast("int")).otherwise((over < short).cast("int"))
        done = F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), bit.alias("bit"))
        return F.struct((s["due"] - x["size"] * bit).alias("due"), left.alias("rest"), F.array_append(s["done"], done).alias("done"))

    return F.aggregate("items", start, step)


def mix(
    docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, block: int = 48, seed: int = 20,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row of ``docs``.

    ``size``: words of the text (0 if null or empty; such rows get the whole part of the source's copies and take 0 words).
    Null sources form one source; null ids are kept; rows that repeat an id each get a decision of their own, by
    the order of (size, hash), so identical rows are interchangeable.  An empty table gives an empty result.
    Other columns of ``docs`` are ignored.  Same rows, same result, however they are partitioned.
    """
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = materialize(sizes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("class", F.floor(F.log2(F.greatest("size", F.lit(1).cast("long")))).cast("int")), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, cap), "mix-targets")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = targets.select(F.col("source").alias("s"), "source_size", "target", due.alias("copies")).withColumn("whole", F.floor(F.col("copies") + F.lit(1e-12)))
    t = t.withColumn("p", F.greatest(F.lit(0.0), F.col("copies") - F.col("whole"))).drop("copies").withColumn("p", F.when(F.col("p") > 1e-12, F.col("p")).otherwise(F.lit(0.0)))
    t = t.withColumn("words", F.when(F.col("p") > 0, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0)))
    rows = sizes.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    fractional = (F.col("size") > 0) & (F.col("p") > 0)
    settled = [rows.where(~fractional).select("doc_id", "source", "size", F.lit(0).alias("bit"))]
    open_ones = rows.where(fractional).withColumn("item", F.struct((-F.col("size")).alias("order"), "h", "doc_id", "size", "p"))
    kind = dict(sizes.dtypes)["doc_id"]

    # The largest documents: those before the HEADS-th (and its equals); all of a source that has fewer.
    largest = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("size"), "h"))
    place = F.struct((-F.col("size")).alias("order"), "h")
    cuts = open_ones.select("source", "size", "h", largest.alias("k")).where(F.col("k") <= HEADS)
    cuts = materialize(cuts.groupBy(F.col("source").alias("s")).agg(F.max(F.when(F.col("k") == HEADS, place)).alias("cut")), "mix-cuts")
    open_ones = open_ones.join(cuts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    before = F.col("cut").isNull() | (place < F.col("cut"))
    heads = open_ones.where(before).groupBy("source").agg(F.array_sort(F.collect_list("item")).alias("items"), F.first("words").alias("words"), F.first("source_size").alias("source_size"))
    share = lambda s, _: s["due"] / s["rest"]
    heads = materialize(heads.select(F.col("source").alias("s"), _in_turn(seed - 2, kind, F.col("words"), F.col("source_size").cast("double"), share).alias("x")), "mix-heads")
    settled.append(heads.select(F.col("s").alias("source"), F.explode("x.done").alias("d")).select("d.doc_id", "source", "d.size", "d.bit"))
    tails = open_ones.where(~before).join(heads.select("s", "x.due", "x.rest"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("due") / F.col("rest"), F.col("p"))))
    tails = tails.select("source", "class", "size", F.col("item").withField("p", p).alias("item"))

    # Blocks by source and class of sizes: as many as the rows that are to be settled need.
    need = materialize(sizes.where("size > 0").groupBy(F.col("source").alias("s"), F.col("class").alias("c")).agg(F.ceil(F.count("*") / block).cast("long").alias("blocks")), "mix-blocks")
    blocks = need.agg(F.max("blocks")).first()[0] or 0
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))
    level = tails.join(need, same).select("source", "class", "item", "blocks")
    depth = 0
    while True:
        key = F.pmod(F.xxhash64(F.lit(depth), "item.h"), F.greatest("blocks", F.lit(1).cast("long")))
        met = level.groupBy("source", "class", "blocks", key.alias("key")).agg(F.array_sort(F.collect_list("item")).alias("items"))
        none = F.expr(f"cast(array() as array<struct<doc_id:{kind},h:bigint,size:bigint,bit:int>>)")
        start = F.struct(F.element_at("items", 1).alias("open"), none.alias("done"))
        met = met.withColumn("acc", F.aggregate(F.slice("items", F.lit(2), F.size("items")), start, _meet(seed + depth)))
        met = materialize(met.select("source", "class", "blocks", "acc.open", "acc.done"), "mix-level")
        settled.append(met.select("source", F.explode("done").alias("d")).select("d.doc_id", "source", "d.size", "d.bit"))
        if blocks <= 1:
            last = met.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("open.size")).alias("order"), "open.h", "open.doc_id", "open.size", "open.p"))).alias("items"))  # fewer than 64 a source
            sum_of = lambda of: F.aggregate("items", F.lit(0.0), lambda s, x: s + of(x))
            last = last.select("source", _in_turn(seed - 1, kind, sum_of(lambda x: x["size"] * x["p"]), sum_of(lambda x: x["size"].cast("double")), lambda _, x: x["p"])["done"].alias("done"))
            settled.append(last.select("source", F.explode("done").alias("d")).select("d.doc_id", "source", "d.size", "d.bit"))
            break
        level = met.select("source", "class", F.col("open").alias("item"), F.ceil(F.col("blocks") / block).cast("long").alias("blocks"))
        blocks, depth = -(-blocks // block), depth + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    out = out.join(t.select("s", "source_size", "target", "whole"), F.col("source").eqNullSafe(F.col("s")))
    copies = (F.col("whole") + F.col("bit")).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def targets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every source has and is to give."""
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return source_targets(sizes).select("source", "source_size", F.round("target", 6).alias("target"))


TARGETS_ORACLE = r"""
WITH d AS (SELECT source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 3.0::DOUBLE * source_size AS most FROM p),
f AS (SELECT *, most / w AS full_at FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM p) - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM f WINDOW o AS (ORDER BY full_at, source NULLS LAST)),
x AS (SELECT arg_min(water, full_at) AS level FROM l WHERE water <= full_at)
SELECT source, source_size, round(CASE WHEN level IS NULL THEN most ELSE least(most, level * w) END, 6) AS target FROM f, x"""
