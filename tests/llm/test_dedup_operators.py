"""WARC, Jaccard join, embedding joins and search, substring dedup, components, against brute force."""

import hashlib
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantaloom.llm import ann, embedding_dedup, hashing, jaccard_join, substring_dedup, warc
from quantaloom.llm.components import connected_components, labelled
from quantaloom.llm.vectors import deal
from quantaloom.llm.workspace import free, materialize, shared_dir


class Sets:
    """Union-find by least member."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


@pytest.mark.parametrize("kind", ["chain", "star", "random", "empty", "loops"])
def test_components(spark, kind):
    rng = np.random.default_rng(1)
    edges = {
        "chain": [(i, i + 1) for i in range(40)], "star": [(7, i) for i in range(50)], "random": [tuple(map(int, rng.integers(0, 80, 2))) for _ in range(50)],
        "empty": [], "loops": [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4)],
    }[kind]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    sets = Sets()
    for a, b in edges:
        if a is not None and a != b:
            sets.join(a, b)
    assert got == {x: sets.find(x) for x in list(sets.up)}


# ---- WARC


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")


def run_warc(spark, df, **how):
    a, b = shared_dir(spark, "t"), shared_dir(spark, "t")
    warc.write_warc(warc.page_records(df), a)
    warc.resolve_revisits(spark, a, b, **how)
    return a, b


TRICKY = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc" * 3


def test_warc_against_sql(spark):
    big = "é" * 700
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (9, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", TRICKY), (10, "u", TRICKY + "\r\n"), (11, "u", TRICKY * 20), (12, "u", TRICKY * 20), (13, "u", "\r\n\r\n" * 500)]
    _, out = run_warc(spark, pages(spark, rows))
    heads = warc.resolved(warc.read_warc(spark, out)).toPandas()
    heads["page_id"] = [int(r.rpartition(":")[2]) for r in heads.record_id]
    with duckdb.connect() as con:
        con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
        want = con.sql(warc.ORACLE).df().set_index("page_id")
    assert len(heads) == len(rows)
    for r in heads.itertuples():
        w = want.loc[r.page_id]
        assert (r.length, r.computed, r.record_type) == (w.payload_bytes, w.payload_digest, w.record_type)
        assert (r.refers_to or ":").rpartition(":")[2] == ("" if pd.isna(w.refers_to) else str(int(w.refers_to))) or r.record_type == "response"
    kept = {r.record_id: bytes(r.payload) for r in warc.read_warc(spark, out, payload=True).where("record_type = 'response'").collect()}
    assert all(hashlib.sha1(v).hexdigest() in k for k, v in kept.items())


def test_warc_again_keeps_revisits(spark):
    big = "z" * 2000
    _, out = run_warc(spark, pages(spark, [(1, "u", big), (2, "u", big), (None, "u", big)]))
    again = shared_dir(spark, "t")
    warc.resolve_revisits(spark, out, again)
    a, b = (warc.read_warc(spark, p).drop("file").orderBy("record_id").collect() for p in (out, again))
    assert a == b and sorted(r.record_type for r in a) == ["response", "revisit", "revisit"]


def test_warc_payload_that_ends_like_a_separator(spark):
    end = "x" * 1200 + "\r\n\r\nWARC/1.1"
    rows = [(1, "u", end), (2, "u", "second"), (3, "u", "\r\n\r\nWARC/1.1"), (4, "u", "\r\n\r\nWARC/1.1"), (5, "u", end), (6, "u", "last")]
    path = shared_dir(spark, "t")
    warc.write_warc(warc.page_records(pages(spark, rows).coalesce(1)), path)
    got = {int(r.record_id.rpartition(":")[2]): bytes(r.payload).decode() for r in warc.read_warc(spark, path, payload=True).collect()}
    assert got == {i: t for i, _, t in rows}


def test_warc_decisions_in_groups_of_archives(spark, monkeypatch):
    rows = [(i, "u", "z" * (1000 + i % 7)) for i in range(60)]
    _, whole = run_warc(spark, pages(spark, rows).repartition(6))
    monkeypatch.setattr(warc, "DECISIONS", 3)
    _, parts = run_warc(spark, pages(spark, rows).repartition(6))
    a, b = (warc.read_warc(spark, p, payload=True).drop("file").orderBy("record_id").collect() for p in (whole, parts))
    assert a == b and sum(r.record_type == "response" for r in a) == 7
    assert list(warc._archive_groups([("a", 2), ("b", 9), ("c", 1), ("d", 2)], 3)) == [["a"], ["b"], ["c", "d"]] and not list(warc._archive_groups([]))


def test_warc_long_payload_full_of_breaks_and_older_version():
    """A payload of very many pieces is joined once; records of version 1.0 are read as well."""
    body = b"\r\n\r\nWARC/1.1\r\nx" * 60_000
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    data = record % (len(body), body) + record.replace(b"1.0", b"1.1") % (2, b"ok")
    reader, got, began = warc._Reader(), [], time.monotonic()
    for piece in data.split(warc.BREAK):
        got += [p for _, _, p in reader.feed("f", piece)]
    reader.close()
    assert got == [body, b"ok"] and time.monotonic() - began < 20


def test_warc_long_text(spark):
    text = "é\r\n\r\nWARC/1.1\r\n" * 200_000
    _, out = run_warc(spark, pages(spark, [(1, "u", text), (2, "u", text), (3, "u", text + "!")]))
    got = {int(r.record_id.rpartition(":")[2]): (r.record_type, r.payload and bytes(r.payload).decode()) for r in warc.read_warc(spark, out, payload=True).collect()}
    assert got == {1: ("revisit", None), 2: ("response", text), 3: ("response", text + "!")}


def test_warc_empty_and_truncated(spark):
    _, out = run_warc(spark, pages(spark, []))
    assert warc.read_warc(spark, out).count() == 0
    reader = warc._Reader()
    with pytest.raises(ValueError, match="cut short"):
        list(reader.feed("f", b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))
        reader.close()


# ---- Jaccard join


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_jaccard(rows, width, num, den):
    sets = [shingle_set(t, width) for _, t in rows]
    comp = Sets()
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                comp.join(rows[i][0], rows[j][0])
    return sorted((i, len(s), comp.find(i)) for (i, _), s in zip(rows, sets, strict=True))


def mutate(rng, words, share):
    return [w if rng.random() > share else f"m{rng.integers(1000)}" for w in words]


@pytest.fixture(scope="module")
def copies():
    rng = np.random.default_rng(4)
    rows = []
    for n in (3, 5, 9, 20, 60, 300, 900):
        for _ in range(3):
            base = [f"w{rng.integers(200)}" for _ in range(n)]
            for share in (0, 0, 0.01, 0.02, 0.03, 0.05):
                rows.append(" ".join(mutate(rng, base, share)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [f"a{i} b{i} {passage} c{i} d{i} e{i}" for i in range(25)]
    rows += ["", None, "one", "One", "ONE\ttwo", "one  two\n", "K one two", "K one two", "x" * 5000]
    return list(enumerate(rows))


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80), (2, 95)])
def test_jaccard_components(spark, copies, width, num):
    df = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in copies], "doc_id long, text string, source string, h long, n long").repartition(5)
    got = jaccard_join.jaccard_components(df, jaccard_join.Scheme(width, num, 100))
    assert sorted(map(tuple, got.collect())) == brute_jaccard(copies, width, num, 100)


def test_jaccard_small_blocks_and_runs(spark, copies, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    df = spark.createDataFrame(copies, "doc_id long, text string")
    got = jaccard_join.jaccard_components(df, jaccard_join.Scheme(4, 85, 100))
    assert sorted(map(tuple, got.collect())) == brute_jaccard(copies, 4, 85, 100)


def test_jaccard_classes_that_share_a_hash(spark, copies):
    """With hashes of few bits most classes share theirs with another, and are told apart all the same."""
    df = spark.createDataFrame(copies, "doc_id long, text string")
    got = jaccard_join.jaccard_components(df, jaccard_join.Scheme(4, 85, 100, bits=4))
    assert sorted(map(tuple, got.collect())) == brute_jaccard(copies, 4, 85, 100)


def test_labels_of_common_and_rare_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 50 == 0 else 7 if i % 2 else i) for i in range(4000)], "id long, k long")
    labels = rows.where("k is not null").groupBy("k").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    got = {r.id: r.least for r in labelled(rows, labels, "k").collect()}
    assert got == {i: None if i % 50 == 0 else 1 if i % 2 else i for i in range(4000)}


def test_free_empties_scratch_tables_alone(spark):
    t = materialize(spark.range(10), "t")
    path = t.inputFiles()[0].rpartition("/")[0]
    free(t)
    assert spark.read.parquet(path).count() == 0
    with pytest.raises(ValueError, match="no scratch"):
        free(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))


def test_jaccard_awkward(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A B C D E F"), (5, None)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == [("2", 2, 2), ("3", 2, 2), ("3", 2, 2), ("5", 0, 5), ("None", 2, 2)]
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_partenum_guarantee():
    """Sets within the threshold share a signature, whatever their sizes."""
    rng = np.random.default_rng(6)
    scheme = jaccard_join.Scheme(4, 85, 100)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = int(rng.integers(0, max(1, int(0.15 * n) + 1)))
        b = np.unique(np.r_[a[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(1, int(0.15 * n) + 1)))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both) and both != len(a) + len(b) - both:
            assert np.intersect1d(scheme.signatures(a), scheme.signatures(b)).size


def test_sketch_distance_never_exceeds_difference():
    rng = np.random.default_rng(7)
    scheme = jaccard_join.Scheme()
    for n in (5, 300, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: n // 2], rng.integers(0, 2**63, n // 3).astype(np.uint64)])
        x, y = scheme.sketch(a), scheme.sketch(b)
        k = min(len(x), len(y))
        far = int(np.bitwise_count(jaccard_join._folded(x.reshape(1, -1), k) ^ jaccard_join._folded(y.reshape(1, -1), k)).sum())
        assert far <= len(np.setxor1d(a, b))


def test_runs_over_batches():
    """Buckets are told whole when a run of one signature spans batches, and in pieces when it is long."""
    sig = np.repeat([1, 2, 3], [5, 1, 4])
    h = np.array([1, 2, 3, 4, 5, 9, 1, 1, 2, 7])

    class Fake:
        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

        def mapInArrow(self, f, _):
            parts = [pa.RecordBatch.from_arrays([pa.array(sig[i : i + 3]), pa.array(h[i : i + 3])], names=["sig", "h"]) for i in range(0, 10, 3)]
            return [tuple(r.values())[1:3] for b in f(iter(parts)) for r in b.to_pylist()]

    want = [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 1), (1, 2), (1, 7)]
    assert jaccard_join._bucketed(Fake()) == want
    old, jaccard_join.RUN = jaccard_join.RUN, 2
    try:
        assert sorted(set(jaccard_join._bucketed(Fake()))) == sorted(set(want))
    finally:
        jaccard_join.RUN = old


def test_long_runs_that_meet_at_a_batch_border(monkeypatch):
    """Two long runs in turn, the first of which ends with its batch: every piece of the second is told under its least member."""
    sig, h = np.repeat([1, 2], [3, 9]), np.r_[1:4, 1:10]

    class Fake:
        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

        def mapInArrow(self, f, _):
            parts = [pa.RecordBatch.from_arrays([pa.array(sig[i : i + 3]), pa.array(h[i : i + 3])], names=["sig", "h"]) for i in range(0, 12, 3)]
            return [tuple(r.values())[:3] for b in f(iter(parts)) for r in b.to_pylist()]

    monkeypatch.setattr(jaccard_join, "RUN", 2)
    assert {x for x in jaccard_join._bucketed(Fake()) if x[0] == 2} == {(2, 1, k) for k in range(1, 10)}


def test_word_hashes_in_pieces(monkeypatch):
    texts = pa.array(["a bb  ccc\td\n", None, "", "ddd" * 50 + " e " * 60, "é A"])
    want, offsets = hashing.word_hashes(texts)
    monkeypatch.setattr(hashing, "PIECE_BYTES", 7)
    got, again = hashing.word_hashes(texts)
    assert (want == got).all() and offsets.tolist() == again.tolist() == [0, 4, 4, 4, 65, 67]
    assert want[0] == want[-1] and len(set(want.tolist())) == 7


# ---- vectors


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(160, 16))
    for i in range(0, 100, 4):
        x[i + 1] = x[i] + rng.normal(size=16) * 0.25
        x[i + 2] = x[i]
    x[100:120] = x[0] + rng.normal(size=(20, 16)) * 0.3
    x[120:140] = x[4]
    rows = [(i, list(map(float, v)), 1) for i, v in enumerate(x.astype(np.float32))]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [1.0] * 15 + [None], 1), (203, [float("nan")] + [1.0] * 15, 1), (204, [float("inf")] + [1.0] * 15, 1), (205, [-0.0] * 15 + [1e-30], None), (206, [0.0] * 15 + [2e-30], None)]
    rows += [(207, [1.0] * 7, 1), (208, [1.0] * 7, 1), (209, [], 1)]  # of other lengths
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def good(rows):
    ids = [i for i, v, _ in rows if v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([v for i, v, _ in rows if i in set(ids)], np.float32).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return ids, x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("tile", [16, 4096])
def test_embedding_links(spark, vectors, tile):
    ids, x = good(vectors)
    near = x @ x.T >= 0.9
    comp = Sets()
    links = dict.fromkeys([r[0] for r in vectors], 0)
    for i, a in enumerate(ids):
        links[a] = int(near[i].sum()) - 1
        for j in np.flatnonzero(near[i]):
            if j != i:
                comp.join(a, ids[j])
    got = embedding_dedup.near_duplicates(frame(spark, vectors), tile_rows=tile).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((i, links[i], comp.find(i), comp.find(i) == i) for i in links)


def test_embedding_empty(spark, vectors):
    assert embedding_dedup.near_duplicates(frame(spark, [])).count() == 0
    got = embedding_dedup.near_duplicates(frame(spark, vectors[160:163])).collect()
    assert [(r.n_links, r.kept) for r in got] == [(0, True)] * 3


def brute_nearest(rows, queries, k):
    ids, x = good(rows)
    c = x @ x.T
    return {i: [(ids[j], c[ids.index(i), j]) for j in np.lexsort((ids, -np.round(c[ids.index(i)], 12))) if ids[j] != i][:k] for i in queries if i in ids}


def test_search_is_exact_at_factor_one(spark, vectors):
    df = frame(spark, vectors)
    index = ann.build_index(df, shard_rows=40)
    got = ann.search(index, df.where("vec_id % 10 = 0"), factor=1.0, block=7).toPandas()
    want = brute_nearest(vectors, range(0, 210, 10), 5)
    assert set(got.query_id) == set(want)
    for q, g in got.sort_values("rank").groupby("query_id"):
        assert g.vec_id.tolist() == [i for i, _ in want[q]] and np.allclose(g.score, [s for _, s in want[q]], atol=1e-12) and g["rank"].tolist() == [1, 2, 3, 4, 5]


def test_search_recall_and_few_candidates(spark, vectors):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 16))
    rows = [(i, list(map(float, v)), 0) for i, v in enumerate(x)]
    df = frame(spark, rows)
    got = ann.search(ann.build_index(df, shard_rows=300), df.where("vec_id % 50 = 0")).toPandas()
    want = brute_nearest([(i, np.float32(v).tolist(), 0) for i, v, _ in rows], range(0, 600, 50), 5)
    hit = sum(len({i for i, _ in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hit >= 0.9 * 60
    few = frame(spark, rows[:3])
    assert ann.search(ann.build_index(few), few).count() == 6
    assert ann.search(ann.build_index(frame(spark, [])), few).count() == 0
    assert ann.search(ann.build_index(few), frame(spark, vectors[160:163])).count() == 0


def test_deal_makes_tiles_of_bounded_size():
    rng = np.random.default_rng(3)
    sizes = {i: int(n) for i, n in enumerate(rng.integers(1, 90, 40))} | {40: 1000, 41: 3}
    first, parts, total = deal(sizes, 100)
    held = {}
    for p, n in sizes.items():
        assert parts[p] == -(-n // 100)
        for k in range(parts[p]):
            held[first[p] + k] = held.get(first[p] + k, 0) + n / parts[p]
    assert sorted(held) == list(range(total)) and max(held.values()) <= 100 and total < 1.7 * sum(sizes.values()) / 100
    assert deal({}, 5) == ({}, {}, 0)


def test_clustered_vectors_skip_parts_and_shards(spark):
    """Far clusters: the join skips pairs of parts, the search asks few shards, and nothing is lost."""
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(24, 32)) * 4
    x = np.repeat(centres, 50, 0) + rng.normal(size=(1200, 32)) * 0.35
    rows = [(i, list(map(float, v)), 0) for i, v in enumerate(x.astype(np.float32))]
    df = frame(spark, rows)
    u = vectors_of(x.astype(np.float32))
    near = u @ u.T >= 0.95
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, threshold=0.95, tile_rows=100).collect()}
    assert got == {i: int(near[i].sum()) - 1 for i in range(1200)}
    tile, centre, radii = embedding_dedup._tile(np.arange(1200), x.astype(np.float32), np.repeat(np.arange(24), 50), 4, part_rows=30)
    assert len(tile.edges) == 49 and centre.shape == (32,) and radii.shape == (4,)
    found = ann.search(ann.build_index(df, shard_rows=100), df.where("vec_id % 40 = 0"), factor=1.0).toPandas()
    c = u @ u.T
    for q, g in found.sort_values("rank").groupby("query_id"):
        order = [j for j in np.argsort(-c[q], kind="stable") if j != q][:5]
        assert g.vec_id.tolist() == order


def vectors_of(x):
    x = x.astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_relaxed_pruning_compares_less():
    x = np.random.default_rng(10).normal(size=(3000, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree, q, own = ann.build_tree(x, leaf=32), x[:50], np.arange(50)
    exact, loose = (ann.Search(x, tree, q, own, 5, f) for f in (1.0, 3.0))
    d = 2 - 2 * q @ x.T
    d[own, own] = np.inf
    assert np.allclose(np.sort(d, 1)[:, :5], exact.d**2, atol=1e-9)
    assert loose.compared < exact.compared < 50 * 3000


def test_a_leaf_is_met_once_by_a_block():
    """Where nothing is skipped, the matrix products of a block are as many as the leaves, not their square; near ties are told apart in double precision."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 24))
    x[1::2] = x[::2] + rng.normal(size=(2000, 24)) * 1e-8
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    class Counted(ann.Search):
        calls = 0

        def offer(self, *args):
            Counted.calls += 1
            super().offer(*args)

    tree, q, own = ann.build_tree(x, leaf=32), x[:300], np.arange(300)
    got = Counted(x, tree, q, own, 9, 1.0)
    leaves = sum(n[0] is None for n in tree)
    assert leaves > 100 and Counted.calls <= 2 * leaves + 1
    c = q @ x.T
    c[own, own] = -2
    want = np.argsort(-c, axis=1, kind="stable")[:, 1:9]  # the first is the copy, at distance 0 but for rounding
    assert (np.sort(got.row[:, 0]) == np.sort(own ^ 1)).all() and np.allclose(np.sort(np.take_along_axis(c, got.row[:, 1:], 1), 1), np.sort(np.take_along_axis(c, want, 1), 1), atol=1e-13)


def test_shards_grow_before_they_become_more(spark, vectors, monkeypatch):
    """Blocks of queries are sent to every shard that cannot be skipped, and Spark is kept from broadcasting them."""
    monkeypatch.setattr(ann, "FEW", 3)
    df = frame(spark, vectors)
    index = ann.build_index(df, shard_rows=20)
    assert index.count() <= 5
    got = ann.search(index, df.where("vec_id % 10 = 0"), factor=1.0, block=2)
    assert "strategy=merge" in got._jdf.queryExecution().analyzed().toString()
    want = brute_nearest(vectors, range(0, 210, 10), 5)
    for q, g in got.toPandas().sort_values("rank").groupby("query_id"):
        assert g.vec_id.tolist() == [i for i, _ in want[q]]


# ---- substrings


def brute_substrings(rows):
    seen, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        found, at = substring_dedup.pieces(t)
        words = [found[k].lower().split() for k in at]
        for n, least in substring_dedup.SPANS:
            for k in range(len(at) - n + 1):
                key = tuple(map(tuple, words[k : k + n]))
                if sum(map(len, key)) >= least:
                    seen.setdefault(key, (i, k))
                    if seen[key] != (i, k):
                        out.setdefault(i, set()).update(range(k, k + n))
    return out


def test_substrings(spark):
    rng = np.random.default_rng(11)
    sentence = lambda: " ".join(f"w{rng.integers(5000)}" for _ in range(int(rng.integers(3, 9)))) + "."
    passage = [sentence() for _ in range(9)]
    rows = []
    for i in range(30):
        own = [sentence() for _ in range(int(rng.integers(1, 12)))]
        if i % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = passage
        if i % 10 == 0:
            own += own[:4]
        rows.append((i, ("\n" if i % 2 else " ").join(own)))
    rows += [(40, rows[0][1].upper()), (41, ""), (42, None), (None, rows[0][1]), (43, "no stop here"), (44, "a.b? c! d\n\n\ne")]
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, h long, n_removed int")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df).collect()}
    want = brute_substrings(rows)
    assert {i: r.n_removed for i, r in got.items() if r.n_removed} == {i: len(s) for i, s in want.items()}
    for i, t in rows:
        found, at = substring_dedup.pieces(t or "")
        gone = {at[k] for k in want.get(i, ())}
        assert got[i].text == (t if not gone else "".join(p for k, p in enumerate(found) if k - k % 2 not in gone))
        assert got[i].n_sentences == len(at)
    assert got[3].n_removed >= 9 and len(got[40].text) < 40 and passage[4] in got[0].text
    assert set(df.columns) | {"n_sentences"} == set(substring_dedup.remove_repeats(df).columns)
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def brute_passages(rows):
    """Sentences in any repeated run of 2 sentences and 20 words, or of 3 or more, whatever its length."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        found, at = substring_dedup.pieces(t)
        words = [found[k].lower().split() for k in at]
        size = [1 + len(s[0].rstrip("\u3002")) // 2 if s[0][0] > "\u3000" else len(s) for s in words]
        for k in range(len(at)):
            for e in range(k + 2, len(at) + 1):
                if sum(size[k:e]) >= (20 if e == k + 2 else 1):
                    key = tuple(map(tuple, words[k:e]))
                    seen.setdefault(key, (i, k))
                    if seen[key] != (i, k):
                        out.setdefault(i, set()).update(range(k, e))
    return out


def test_passages_of_short_sentences(spark):
    rng = np.random.default_rng(12)
    word = lambda: f"w{rng.integers(4000)}"
    shout = " ".join(f"Stop{i}!" for i in range(40))
    menu = "\n".join(f"Soup {i}" for i in range(20))
    ends = "Yes. No. " + " ".join(f"{word()} {word()} {word()} {word()} {word()} {word()}." for _ in range(4)) + " Oh. Ah."
    unspaced = "".join("".join(chr(0x4E00 + int(rng.integers(9000))) for _ in range(9)) + "\u3002" for _ in range(3))
    few = " ".join(f"Go{i}." for i in range(11))
    rows = []
    for i in range(24):
        lead, tail = (" ".join(word() for _ in range(int(rng.integers(1, 7)))) + "." for _ in range(2))
        rows.append((i, "\n".join([lead, (shout, menu, ends, unspaced, few, "Ha. " * 30)[i % 6], tail])))
    rows += [(50 + i, " ".join(f"{'ab'[int(b)]}." for b in rng.integers(0, 2, 25))) for i in range(6)]
    want = brute_passages(rows)
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: len(want.get(i, ())) for i, _ in rows}
    assert [got[i] for i in range(6, 11)] == [40, 20, 8, 3, 11] and got[5] >= 18


def test_passages_without_spaces_in_other_scripts():
    lines = [f"{i}" * 76 for i in range(8)]
    assert substring_dedup.sizes(lines).tolist() == [3] * 8 and substring_dedup.sizes(["one two", "\u4e00" * 9]).tolist() == [2, 5]
    assert len(substring_dedup.spans("\n".join(lines))[0])
