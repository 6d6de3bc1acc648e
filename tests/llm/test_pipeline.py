import sys
from pathlib import Path

import numpy as np
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline as cp
from quantaloom.llm import bpe
from quantaloom.llm.substring_dedup import pieces

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_dedup_operators import brute_jaccard, brute_substrings
from test_text_operators import brute_targets


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_on_a_small_corpus(spark, tmp_path):
    base = "The thing with the other thing was said. It was there on that day. They went to the river with it. " * 3
    rows = [(i, f"Number {i} said that word{i} was the one. " + " ".join(f"the thing{i}{k} was with that{k}." for k in range(12)), "en", f"s{i % 3}", 400) for i in range(60)]
    rows += [(100, base, "en", "s0", 1), (101, base, "en", "s1", 1), (102, None, None, None, None), (103, "", "en", "s0", 0), (104, "1234 ----", None, "s1", 9)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = cp.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) <= set(range(60)) | {100} and out.n_tokens.gt(0).all()
    assert (out.ids.str.len() == out.n_tokens).all()
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == cp.COLUMNS
    assert len(cp.STAGES) == 5


def test_stages_on_no_rows(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_mixture_keeps_what_is_drawn_for_null_and_repeated_ids(spark):
    rows = [(None if i % 3 == 0 else i // 2, " ".join(f"w{i}x{k}" for k in range(3 + i % 4)), "en", None if i % 5 == 0 else f"s{i % 2}", i) for i in range(60)]
    df = docs(spark, rows)
    drawn = cp.source_mixing.mix(df).groupBy("doc_id", "source", "size").sum("copies").collect()
    want = {tuple(r)[:3]: r[3] for r in drawn if r[3]}
    got = {}
    for r in cp.mixture(spark, df, "").collect():
        key = (r.doc_id, r.source, len(r.text.split()))
        got[key] = got.get(key, 0) + 1
    assert got == want and any(k[0] is None for k in got)


def test_stages_against_brute_force(spark):
    """Languages by sure text, components by all pairs, passages by all runs, tokens by tiktoken; the mix by its targets."""
    rng = np.random.default_rng(21)
    vocabulary = {"en": "the thing with that shore was said they river day".split(), "de": "nicht schön über und zeit haus gegen stadt wasser".split()}
    passage = " ".join(f"shared{i} line{i} stands{i} here{i}." for i in range(5))
    rows = []
    for i in range(40):
        lang = ("en", "de")[i % 2]
        words = [f"{rng.choice(vocabulary[lang])}" for _ in range(60)]
        rows.append([i, " ".join(f"{' '.join(words[k : k + 6])} {lang}{i}x{k}." for k in range(0, 60, 6)), lang, f"s{i % 3}", 0])
    rows += [[100 + i, rows[i][1] + (" once more." if i % 2 else ""), rows[i][2], "s1", 0] for i in range(8)]
    changed = lambda t, i: " ".join(f"{w}{i}" if k % 4 == 0 else w for k, w in enumerate(t.split(" ")))
    rows += [[200 + i, f"{changed(rows[i][1], i)}\n{passage}\nown end {i}.", rows[i][2], "s0", 0] for i in range(20, 24)]
    rows += [[300, "", None, "s0", 0], [301, None, None, None, 0], [302, "1 2 3", None, "s0", 0]]
    frame = docs(spark, [tuple(r) for r in rows])

    kept = cp.languages(spark, frame, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows if r[0] < 300)

    groups = {i: c for i, _, c in brute_jaccard([(r[0], r[1]) for r in rows if r[0] < 300], 5, 80, 100)}
    alone = cp.near_duplicates(spark, kept, "")
    assert sorted(r.doc_id for r in alone.collect()) == sorted(i for i, c in groups.items() if i == c) and len(set(groups.values())) < len(groups)

    left = {r.doc_id: r.text for r in alone.collect()}
    gone = brute_substrings(list(left.items()))
    cut = cp.repeated_passages(spark, alone, "")
    got = {r.doc_id: r.text for r in cut.collect()}
    assert any(gone.values())
    for i, text in left.items():
        found, at = pieces(text)
        drop = {at[k] for k in gone.get(i, ())}
        assert got[i] == "".join(p for k, p in enumerate(found) if k - k % 2 not in drop)

    mixed = cp.mixture(spark, cut, "").collect()
    sizes = {r.doc_id: len(r.text.split()) for r in cut.collect()}
    taken, held = {}, {}
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + sizes[r.doc_id]
    for r in cut.collect():
        held[r.source] = held.get(r.source, 0) + sizes[r.doc_id]
    for s, want in brute_targets(held).items():
        assert abs(taken.get(s, 0) - want) <= max(sizes.values())

    path, pattern = bpe.default_vocabulary()
    want = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(path))}, special_tokens={})
    for r in cp.tokens(spark, cut, "").collect():
        assert r.ids == want.encode_ordinary(got[r.doc_id])
