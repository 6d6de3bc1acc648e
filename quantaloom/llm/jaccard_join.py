"""Exact Jaccard join of shingle sets by PartEnum signatures, down to connected components.

Sets fall into size bands; sets that are similar enough lie in one band or in neighbouring ones.  A band has an instance of
PartEnum for the largest symmetric difference ``k`` that two similar sets of it can have: the domain of shingle hashes is
cut into ``n1`` parts, so that in one of them the sets differ in at most one element, and each part into three, so that two
of the three agree there.  A signature is the content of two of three: similar sets share one for certain.
A set has signatures for its own band and for the next.

1. Equal sets are one class, told by 128 bits and named by 64 of them, or by others if two classes share these; a task sends a class's signatures once.
2. Signatures are shuffled and sorted; classes that share one form a bucket.  Buckets of equal members are told once.
3. In a few rounds every class is compared, exactly, with the hub (least member of a bucket) that it shares most signatures with and
   that is not yet in its component; the links found form components.
4. Hubs whose buckets' members are still of several components have them compared across these, in square blocks, and what may
   link is compared exactly.

Before contents move, sizes and parity sketches (the parities of hash bits, whose distance never exceeds the symmetric
difference) rule out what can't link.

No bucket's pairs are written out, nothing is capped, and no link between different sets is lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components, labelled
from .hashing import groups, mix64, salts, shingles, word_hashes
from .workspace import free, materialize, table

_SALT = salts(64, 31)
SEEN = 1 << 20
RUN = 1 << 16
BLOCK = 2048
#: Pairs of a hub that are compared in one task, about.
PAIRS = 256
ROUNDS = 3
#: Classes that share the first 64 bits of their hashes with another: 3 are expected in 10^10.  More than so many are an error.
TWINS = 100_000


@dataclass
class Scheme:
    """Two sets link when ``den * intersection >= num * union``; sets are of ``width``-word shingles.

    ``bits``: of the hash that names a class; ``twins``: the names of classes, by (hash, second hash), that share a hash with another.
    """

    width: int = 5
    num: int = 80
    den: int = 100
    bits: int = 64
    ends: list[int] = field(default_factory=lambda: [0])
    twins: dict[tuple[int, int], int] = field(default_factory=dict)
    shared: frozenset[int] = frozenset()

    def hash(self, u: np.ndarray, which: int = 0) -> int:
        """One of two hashes of a set, as a signed 64-bit number."""
        x = mix64(mix64(u ^ _SALT[5 + 8 * which]).sum(dtype=np.uint64, keepdims=True) + np.array([len(u)], np.uint64) * _SALT[6 + 8 * which])
        return int((x >> np.uint64(64 - self.bits) if which == 0 else x).view(np.int64)[0])

    def name(self, u: np.ndarray) -> int:
        """The name of the class of a set."""
        h = self.hash(u)
        return self.twins[h, self.hash(u, 1)] if h in self.shared else h

    def band(self, n: int) -> int:
        """The number of the size band of sets of n elements, from 1."""
        while self.ends[-1] < n:
            self.ends.append((self.ends[-1] + 1) * self.den // self.num)
        return bisect_left(self.ends, n)

    def differ(self, a, b):
        """The largest symmetric difference of two linked sets of sizes a and b."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def signatures(self, u: np.ndarray) -> np.ndarray:
        """Signatures of a set of distinct hashes."""
        own = self.band(len(u))
        self.band(self.ends[own] + 1)
        out = []
        value = mix64(u ^ _SALT[0])
        for band in (own, own + 1):
            k = self.differ(self.ends[band], self.ends[band])
            if not k:  # only equal sets link here, and those are one class
                continue
            n1 = k // 2 + 1
            x = mix64(u + _SALT[1:2] * np.uint64(band))
            p = (x % np.uint64(n1)).astype(np.int64) * 3 + (x // np.uint64(n1) % np.uint64(3)).astype(np.int64)
            part = np.zeros(n1 * 3, np.uint64)
            np.add.at(part, p, value)
            rest = part.reshape(n1, 3).sum(1, dtype=np.uint64)[:, None] - part.reshape(n1, 3)
            name = np.arange(n1 * 3, dtype=np.uint64).reshape(n1, 3) * _SALT[2] + np.array([band], np.uint64) * _SALT[3]
            out.append(mix64(rest + mix64(name)).ravel())
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def sketch(self, u: np.ndarray) -> np.ndarray:
        """Parities of the set's hash bits, as 64-bit words; a power of two of them, by the size of the set."""
        bits = 256
        while bits < 4 * self.differ(len(u), len(u)):
            bits *= 2
        x = mix64(u ^ _SALT[4])
        flips = np.bincount((x % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
        return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def _sets(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in groups(batch, batch.schema.names[column]):
        yield part, shingles(*word_hashes(part.column(column)), width)


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches, one a row, as if they had been made with fewer words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def set_sizes(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(id, n, h, g, sketch) of documents (id, text): size of the shingle set, its two hashes and its sketch (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, sets in _sets(b, 1, scheme.width):
                h, g = (pa.array([scheme.hash(u, k) if len(u) else None for u in sets], pa.int64()) for k in (0, 1))
                sketch = pa.array([scheme.sketch(u).tobytes() if len(u) else None for u in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(u) for u in sets], pa.int64()), h, g, sketch], names=["id", "n", "h", "g", "sketch"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n long, h long, g long, sketch binary")


def _named(sizes: DataFrame, scheme: Scheme) -> DataFrame:
    """``sizes`` (id, n, h, sketch), h being the name of the class; classes that share a hash get names of their own, which ``scheme`` is told."""
    twins = sizes.where("h is not null").groupBy("h").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x < y").select("h").limit(TWINS + 1)
    shared = [r["h"] for r in twins.collect()]
    if len(shared) > TWINS:
        raise ValueError("too many classes share a hash")
    if not shared:
        return sizes.drop("g")
    few = sizes.sparkSession.createDataFrame([(h,) for h in shared], "h long")
    pairs = sizes.join(F.broadcast(few), "h", "left_semi").select("h", "g").distinct().collect()
    for h, g in sorted(map(tuple, pairs)):
        both = np.array([h, g], np.int64).view(np.uint64)
        scheme.twins[h, g] = int(mix64(mix64(both[:1]) + both[1:]).view(np.int64)[0])
    scheme.shared = frozenset(shared)
    names = sizes.sparkSession.createDataFrame([(*k, v) for k, v in scheme.twins.items()], "h long, g long, own long")
    return sizes.join(F.broadcast(names), ["h", "g"], "left").select("id", "n", F.coalesce("own", "h").alias("h"), "sketch")


def _signed(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(sig, h): the signatures of every class, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, sets in _sets(b, 1, scheme.width):
                sigs, owners = [], []
                for u in sets:
                    if not len(u) or (h := scheme.name(u)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(h)
                    s = scheme.signatures(u)
                    sigs.append(s)
                    owners.append(np.full(len(s), h))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owners))], names=["sig", "h"])

    return docs.mapInArrow(run, "sig long, h long")


def _bucketed(signed: DataFrame) -> DataFrame:
    """(bucket, hub, member, votes) of signatures that several classes share; the hub is the least member and a member itself.

    ``votes`` is the number of signatures of a batch that have these very members.  Rows come in order of (sig, h).  Of buckets with equal members a task tells one.  A bucket of more than RUN members is told in
    pieces under one name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        held_s, held_h = np.empty(0, np.int64), np.empty(0, np.int64)
        long_hub: tuple[int, int] | None = None  # (sig, hub) of a run that is being told in pieces

        def tell(s: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal long_hub
            keep = np.r_[True, (s[1:] != s[:-1]) | (h[1:] != h[:-1])]
            s, h = s[keep], h[keep]
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            size = np.diff(np.r_[starts, len(s)])
            name = np.add.reduceat(mix64(h.view(np.uint64)), starts).view(np.int64)
            hub = h[starts].copy()
            some = size > 1
            if long_hub and s[0] == long_hub[0]:
                name[0], hub[0], some[0] = long_hub[0], long_hub[1], True
            elif size[0] >= RUN:
                name[0] = s[0]
            _, first, times = np.unique(name, return_index=True, return_counts=True)
            fresh, votes = np.zeros(len(name), bool), np.ones(len(name), np.int64)
            fresh[first], votes[first] = True, times
            fresh &= some
            for i in np.flatnonzero(fresh).tolist():
                if (key := int(name[i])) in told and not (long_hub and key == long_hub[0]):
                    fresh[i] = False
                elif size[i] < RUN:
                    if len(told) >= SEEN:
                        told.clear()
                    told.add(key)
            rows = np.repeat(fresh, size)
            if rows.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[rows]), pa.array(np.repeat(hub, size)[rows]), pa.array(h[rows]), pa.array(np.repeat(votes, size)[rows])], names=["bucket", "hub", "member", "votes"])

        for b in batches:
            if not b.num_rows:
                continue
            s = np.concatenate([held_s, b.column(0).to_numpy(zero_copy_only=False)])
            h = np.concatenate([held_h, b.column(1).to_numpy(zero_copy_only=False)])
            last = int(np.searchsorted(s, s[-1]))  # the last run may go on in the next batch
            if last:
                yield from tell(s[:last], h[:last])
                long_hub = None
                s, h = s[last:], h[last:]
            if len(h) > RUN:
                hub = long_hub if long_hub and long_hub[0] == s[0] else (int(s[0]), int(h[0]))
                yield from tell(s, h)
                long_hub = hub
                s, h = s[:0], h[:0]
            held_s, held_h = s, h
        if len(held_s):
            yield from tell(held_s, held_h)

    return signed.repartition("sig").sortWithinPartitions("sig", "h").mapInArrow(run, "bucket long, hub long, member long, votes long")


def _contents(docs: DataFrame, classes: DataFrame, pairs: DataFrame, scheme: Scheme) -> DataFrame:
    """(h, items binary) of the classes in ``pairs`` (a, b), from one document of each, written to the shared folder."""
    wanted = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct()
    chosen = materialize(classes.select("h", "id").join(wanted, "h", "left_semi").select(F.col("id").alias("c")).distinct(), "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, sets in _sets(b, 1, scheme.width):
                h, items = [], []
                for u in sets:
                    if len(u) and (key := scheme.name(u)) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        h.append(key)
                        items.append(u.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(items, pa.binary())], names=["h", "items"])

    found = docs.join(chosen, docs["id"].eqNullSafe(chosen["c"]), "left_semi").select("id", "text").mapInArrow(run, "h long, items binary")
    found = materialize(found, "contents")
    free(chosen)
    return found


def _verified(pairs: DataFrame, contents: DataFrame, scheme: Scheme) -> DataFrame:
    """Those of ``pairs`` (a, b) that link.  A hub's content goes to its pairs' tasks, at most PAIRS pairs or so to one."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts"))
    mine = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    mine = mine.join(contents.select(F.col("h").alias("b"), "items"), "b").select("a", "part", "b", "items")
    hubs = parts.join(contents.select(F.col("h").alias("a"), "items"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                items = np.frombuffer(raw.as_buffer(), np.uint64)
                if b is None:
                    hub, own = a, items.copy()
                    continue
                if a != hub:
                    raise ValueError("a pair without its hub")
                x, y = (own, items) if len(own) <= len(items) else (items, own)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if scheme.den * both >= scheme.num * (len(x) + len(y) - both):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return mine.unionByName(hubs).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select("a", "b", "items").mapInArrow(run, "a long, b long")


def _may_link(pairs: DataFrame, classes: DataFrame, scheme: Scheme) -> DataFrame:
    """``pairs`` (a, b, votes) without those that sizes and sketches rule out."""
    side = lambda x: classes.select(F.col("h").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [batch.column(i).to_numpy() for i in (3, 4)]
            width = [pc.binary_length(batch.column(i)).to_numpy() // 8 for i in (5, 6)]
            most = scheme.differ(*n)
            keep = np.abs(n[0] - n[1]) <= most
            for wide in np.unique(np.stack(width)[:, keep], axis=1).T.tolist():  # sketches of two widths at a time
                rows = np.flatnonzero(keep & (width[0] == wide[0]) & (width[1] == wide[1]))
                for at in range(0, len(rows), 4096):
                    own = rows[at : at + 4096]
                    x, y = (_folded(np.frombuffer(b"".join(batch.column(i).take(pa.array(own)).to_pylist()), np.uint64).reshape(len(own), -1), min(wide)) for i in (5, 6))
                    keep[own] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most[own]
            yield batch.select(["a", "b", "votes"]).filter(pa.array(keep))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "votes", "na", "nb", "sa", "sb")
    return joined.mapInArrow(run, "a long, b long, votes long")


def _across(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs (a, b) of members of one bucket and different components that sizes and sketches don't rule out.

    ``rows``: (bucket, member, comp, n, sketch, hubs), the hubs being all buckets of the member.  A pair is told by the least bucket
    that it shares, hence once.  A large bucket is dealt to square blocks.
    """
    blocks = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    dealt = rows.join(blocks, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "member", "comp", "n", "sketch", "hubs")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("member", ignore_index=True).drop_duplicates("member", ignore_index=True)
        least = min(len(s) for s in f["sketch"]) // 8
        words = np.concatenate([_folded(np.frombuffer(s, np.uint64).reshape(1, -1), least) for s in f["sketch"]])
        n, comp, member, side = (f[c].to_numpy() for c in ("n", "comp", "member", "own"))
        lo, hi = int(f["lo"].iloc[0]), int(f["hi"].iloc[0])
        left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        bucket, hubs = int(f["bucket"].iloc[0]), [set(x.tolist()) for x in f["hubs"]]
        a, b = [], []
        for at in range(0, len(left), 64):
            rows = left[at : at + 64]
            most = scheme.differ(n[rows][:, None], n[right][None, :])
            may = (comp[rows][:, None] != comp[right][None, :]) & (np.abs(n[rows][:, None] - n[right][None, :]) <= most)
            if lo == hi:
                may &= rows[:, None] < right[None, :]
            i, j = np.nonzero(may)
            for k in range(0, len(i), 1 << 16):
                x, y = rows[i[k : k + (1 << 16)]], right[j[k : k + (1 << 16)]]
                near = np.bitwise_count(words[x] ^ words[y]).sum(1, dtype=np.int64) <= scheme.differ(n[x], n[y])
                for u, v in zip(x[near].tolist(), y[near].tolist(), strict=True):
                    if min(hubs[u] & hubs[v]) == bucket:
                        a.append(min(member[u], member[v]))
                        b.append(max(member[u], member[v]))
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return dealt.groupBy("bucket", "lo", "hi").applyInPandas(run, "a long, b long")


def jaccard_components(docs: DataFrame, scheme: Scheme | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``.

    Words are runs other than 0x20 and 0x09-0x0D, A-Z lowered; a text of fewer words than a shingle has one shingle, its whole
    sequence; an empty or null text has none, links with nothing, and is its own component.  Ids are expected to be unique: rows that
    repeat one are each compared, and share the smaller of their components' ids only if their sets link.  Rows with a null id
    take part; a component of null ids alone is null.
    """
    scheme = scheme or Scheme()
    scheme = Scheme(scheme.width, scheme.num, scheme.den, scheme.bits)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = materialize(set_sizes(base, scheme), "set-sizes")
    sizes = _named(hashed, scheme)
    buckets = materialize(_bucketed(_signed(base.where("text is not null"), scheme)), "buckets")
    classes = sizes.join(buckets.select(F.col("member").alias("h")).distinct(), "h", "left_semi").groupBy("h")
    classes = materialize(classes.agg(F.first("n").alias("n"), F.min("id").alias("id"), F.first("sketch").alias("sketch")), "classes")
    pairs = buckets.where("hub < member").groupBy(F.col("hub").alias("a"), F.col("member").alias("b")).agg(F.sum("votes").alias("votes"))
    pairs = materialize(_may_link(pairs, classes, scheme), "hub-pairs")
    contents = _contents(base, classes, pairs, scheme)
    tested = links = comps = None
    for _ in range(ROUNDS):
        ask = pairs
        if comps is not None:
            ask = pairs.join(tested, ["a", "b"], "left_anti").join(comps.withColumnsRenamed({"member": "a", "comp": "ca"}), "a", "left").join(comps.withColumnsRenamed({"member": "b", "comp": "cb"}), "b", "left")
            ask = ask.where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        ask = materialize(ask.groupBy("b").agg(F.max_by("a", F.struct("votes", "a")).alias("a")).select("a", "b"), "asked")
        found = materialize(_verified(ask, contents, scheme), "links")
        tested, links = (ask, found) if links is None else (tested.unionByName(ask), links.unionByName(found))
        if comps is not None:
            free(comps)
        comps = materialize(connected_components(links).select(F.col("node").alias("member"), F.col("component").alias("comp")), "comps")
        if not found.limit(1).count():
            break
    free(contents)
    # What the rounds left open: pairs with hubs, and pairs without.  The buckets of a hub are joined to one, since they mostly
    # have the same members, whose pairs would otherwise be looked at for each signature.
    apart = pairs.join(comps.withColumnsRenamed({"member": "a", "comp": "ca"}), "a", "left").join(comps.withColumnsRenamed({"member": "b", "comp": "cb"}), "b", "left")
    apart = apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    rows = buckets.where("hub < member").select(F.col("hub").alias("bucket"), "member").distinct().join(comps, "member", "left").withColumn("comp", F.coalesce("comp", "member"))
    rows = materialize(rows, "bucket-comps")
    open_ones = rows.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("bucket")
    still = rows.join(open_ones, "bucket").join(classes.select(F.col("h").alias("member"), "n", "sketch"), "member")
    # A member has no more hubs than signatures.
    hubs = buckets.where("hub < member").groupBy("member").agg(F.collect_set("hub").alias("hubs"))
    still = still.join(hubs, "member")
    more = materialize(_across(still, scheme).unionByName(apart).distinct().join(tested, ["a", "b"], "left_anti"), "more-pairs")
    free(rows, buckets, pairs, comps)
    contents = _contents(base, classes, more, scheme)
    late = materialize(_verified(more, contents, scheme), "links")
    free(contents, more, classes)
    comps = materialize(connected_components(links.unionByName(late)).select(F.col("node").alias("h"), F.col("component").alias("comp")), "comps")

    named = sizes.join(comps, "h", "left").withColumn("comp", F.coalesce("comp", "h"))
    named = materialize(named.select("id", "n", "comp"), "set-comps")
    least = named.where("comp is not null").groupBy("comp").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    free(hashed, comps, late)
    out = labelled(named, materialize(least, "least-ids"), "comp")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), Scheme(width=4, num=85, den=100))


_UPPER = "".join(map(chr, range(65, 91)))
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * c >= 85 * (na + nb - c)), u AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.m, s.doc_id)) AS component_id FROM s LEFT JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) m ON m.x = s.doc_id
"""
