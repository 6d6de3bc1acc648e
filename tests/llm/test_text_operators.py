"""Language ID, quality rules, BPE, mixing and license scans on small tables, awkward ones included."""

import hashlib
import time
import zlib

import numpy as np
import pandas as pd
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantaloom.llm import bpe, language_id, license_scan, quality_rules, source_mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, component_id long"


def docs(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, 1, 2, 0.5, 3) for r in rows], DOCS)


AWKWARD = [(1, None, None, None), (2, "", "en", ""), (None, "the cat", "en", "b"), (4, "a " * 30_000, None, "a"), (5, "12 34 !!", "fr", "a"), (5, "12 34 !!", "fr", "a"), (6, "Kİ \U0001f600 x", "fr", None)]


# ---- language ID


def corpus(n=200):
    rng = np.random.default_rng(0)
    words = {"en": ["the", "thing", "with", "that", "shore"], "de": ["nicht", "schön", "über", "und", "zeit"], "fr": ["leau", "été", "où", "que", "être"]}
    return [(i, " ".join(rng.choice(words[k], 12)), k, "s") for i, k in enumerate(np.repeat(list(words), n // 3))]


def naive_buckets(text):
    """Buckets of all n-grams of a text, one after the other, in plain integers."""
    chars = [0, 0, *(ord(c) if ord(c) > 127 or c.isalpha() or c == "\0" else 32 for c in text.lower()), 0, 0]
    mask, out = (1 << 64) - 1, []
    for i in range(len(chars) - 2):
        h = 0
        for k in range(3):
            h = (h + chars[i + k] + k + 1) * 0x9E3779B97F4A7C15 & mask
            h ^= h >> 29
            out.append((h * 0xBF58476D1CE4E5B9 & mask) >> (64 - language_id.BITS))
    return out


def test_language_model_is_that_of_plain_counts(spark):
    rows = corpus(60)
    model = language_id.fit(docs(spark, rows), smoothing=0.3)
    counts = {k: np.full(1 << language_id.BITS, 0.3) for k in ("de", "en", "fr")}
    for _, text, lang, _ in rows:
        np.add.at(counts[lang], naive_buckets(text), 1)
    asked = ["the shore", "über nicht und", "été où", "thé und the", "x" * 7]
    _, scores = model.score(asked)
    for text, got in zip(asked, scores, strict=True):
        z = np.array([np.log(1 / 3) + np.log(c[naive_buckets(text)] / c.sum()).sum() for c in counts.values()])
        assert got == pytest.approx(np.exp(z.max() - np.logaddexp.reduce(z)), rel=1e-3)


def test_language_of_a_text_depends_on_that_text_alone(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcé ß\U0001f600"), n)) for n in (1, 5, 900, 1000, 1001, 2500, 0, 30)]
    whole = [sorted(naive_buckets(t)) for t in texts]
    for piece in (7, 1000, 1 << 17):
        monkeypatch.setattr(language_id, "PIECE_CHARS", piece)
        got = {i: [] for i in range(len(texts))}
        for who, starts, ids in language_id._grams(texts):
            for i, a, b in zip(who, starts, [*starts[1:], len(ids)], strict=True):
                got[i] += ids[a:b].ravel().tolist()
        assert [sorted(got[i]) for i in range(len(texts)) if texts[i]] == [w for w, t in zip(whole, texts, strict=True) if t]


def test_more_languages_than_a_block(spark):
    rows = [(i, f"{chr(0x4E00 + i)}a{chr(0x4E00 + i)} " * 3, f"l{i:03d}", "s") for i in range(70)]
    langs, scores = language_id.fit(docs(spark, rows)).score([r[1] for r in rows])
    assert langs == [r[2] for r in rows] and min(scores) > 0.9
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(docs(spark, rows), max_languages=69)


def test_equally_likely_languages_go_by_name(spark):
    model = language_id.fit(docs(spark, [(1, "same text", "b", "s"), (2, "same text", "a", "s")]))
    assert model.score(["same text"]) == (["a"], [pytest.approx(0.5)])


def test_language_held_out(spark):
    rows = corpus()
    df = docs(spark, rows)
    model = language_id.fit(df.where(~language_id.held_out("doc_id", 4, 2)))
    out = language_id.predict(df, model).toPandas()
    unseen = out[[zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]]
    assert len(unseen) > 20 and (unseen.lang_pred == unseen.lang).mean() > 0.95
    assert out.score.between(0, 1).all() and set(df.columns) <= set(out.columns)


def test_language_awkward_and_empty(spark):
    df = docs(spark, AWKWARD + corpus(30))
    model = language_id.fit(df)
    out = language_id.predict(docs(spark, AWKWARD), model).toPandas()
    assert len(out) == len(AWKWARD)
    assert list(out[out.text.isna() | out.text.isin(["", "12 34 !!"])].lang_pred.unique()) == ["und"]
    nothing = language_id.fit(docs(spark, []))
    assert nothing.languages == [] and set(language_id.predict(docs(spark, AWKWARD), nothing).toPandas().lang_pred) == {"und"}
    assert language_id.predict(docs(spark, []), model).count() == 0


def test_long_text_scores_as_its_pieces():
    m = language_id.LanguageModel(["a", "b"], np.random.default_rng(1).normal(size=(1 << language_id.BITS, 2)).astype(np.float32), np.zeros(2))
    text = "abc def " * (language_id.PIECE_CHARS // 4)
    assert m.score([text, "abc def"])[0][0] == m.score([text])[0][0]


# ---- quality


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(2)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    y = ((x["a"] > 0.5) & (x["b"] <= 0.4)).astype(int)
    m = quality_rules.fit_rules(x, y)
    z = m.intercept + sum(r.weight * r.holds(x) for r in m.rules)
    assert 0 < len(m.rules) <= quality_rules.RULES and ((z > 0) == y).mean() > 0.98


def test_quality_learns_and_handles_awkward_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, "A plain line of words. " * int(rng.integers(2, 9)), "en", "s") for i in range(120)]
    bad = [(1000 + i, "w*** x&&& y%%% " * int(rng.integers(2, 9)), "en", "s") for i in range(120)]
    df = docs(spark, good + bad)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in good + bad] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = quality_rules.fit(df, labels)
    out = quality_rules.score(df, model).toPandas()
    assert ((out.doc_id < 1000) == (out.predicted == 1)).mean() > 0.98 and out.score.between(0, 1).all()
    assert quality_rules.score(docs(spark, AWKWARD), model).toPandas().score.notna().all()
    assert quality_rules.score(docs(spark, []), model).count() == 0
    assert quality_rules.fit(df, labels.limit(0)).rules == ()
    assert quality_rules.fit(df, labels.where("quality = 1")).intercept > 2


# ---- BPE

PATH, PATTERN = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def oracle():
    keys = bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={k: i for i, k in enumerate(keys)}, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.MinimalPerfectHash(bpe.read_ranks(PATH)), PATTERN)


def test_hash_is_minimal_and_perfect(encoder):
    m = encoder.mph
    assert sorted(m.at.tolist()) == list(range(len(m.keys)))
    assert all(m.find(k) == i for i, k in enumerate(m.keys)) and m.find(b"no such entry at all") == -1
    for n in range(5):
        small = bpe.MinimalPerfectHash([bytes([i]) for i in range(n)])
        assert [small.find(bytes([i])) for i in range(n)] == list(range(n)) and small.find(b"zz") == -1


def test_hash_of_small_vocabularies_ends():
    """Key sets of every small size find a displacement or another seed, within seconds."""
    rng = np.random.default_rng(3)
    began = time.monotonic()
    for n in (*range(40), *rng.integers(40, 200, 60).tolist()):
        keys = list({rng.bytes(int(rng.integers(1, 5))) for _ in range(n)})
        m = bpe.MinimalPerfectHash(keys)
        assert [m.find(k) for k in keys] == list(range(len(keys))) and sorted(m.at[m.at >= 0].tolist()) == list(range(len(keys)))
    assert time.monotonic() - began < 60
    with pytest.raises(ValueError, match="repeated"):
        bpe.MinimalPerfectHash([b"a", b"a"])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab \n'sé日1", max_size=300))
def test_encodes_as_tiktoken(text):
    enc, want = test_encodes_as_tiktoken.pair
    packed = b"".join(enc.encode(text))
    assert np.frombuffer(packed, "<u4").tolist() == want.encode_ordinary(text)
    assert enc.decode(packed) == text.encode()


@pytest.fixture(autouse=True)
def _pair(encoder, oracle):
    test_encodes_as_tiktoken.pair = (encoder, oracle)


def test_memo_is_bounded(monkeypatch, oracle):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 10)
    enc = bpe.Encoder(bpe.MinimalPerfectHash(bpe.read_ranks(PATH)), PATTERN)
    text = " ".join(f"word{i} again" for i in range(100))
    assert np.frombuffer(b"".join(enc.encode(text)), "<u4").tolist() == oracle.encode_ordinary(text)
    assert len(enc) <= 10 and len(enc.older) <= 10


def test_long_text_in_chunks(monkeypatch, encoder, oracle):
    monkeypatch.setattr(bpe, "CHUNK_TOKENS", 7)
    text = "Some words, 123 and more!  " * 20
    assert len(list(encoder.encode(text))) > 1
    assert np.frombuffer(b"".join(encoder.encode(text)), "<u4").tolist() == oracle.encode_ordinary(text)


def test_bpe_tables(spark, oracle):
    df = docs(spark, AWKWARD)
    got = bpe.round_trip(df).toPandas()
    ids = bpe.encode(df)
    assert len(got) == len(AWKWARD) == ids.count()
    texts = {r[0]: r[1] or "" for r in AWKWARD}
    for r in got.itertuples():
        key = None if pd.isna(r.doc_id) else int(r.doc_id)
        want = oracle.encode_ordinary(texts[key])
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[key].encode()).hexdigest()
    back = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(ids).collect()}
    assert back == texts
    assert bpe.encode(docs(spark, [])).count() == 0 == bpe.round_trip(docs(spark, [])).count()


# ---- mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {s: share.get(s, cap * sizes[s]) for s in names}
        capped |= over


def test_mix(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(0, 40)), "en", [None, "a", "b", "é", "Z", "tiny"][min(5, int(rng.integers(0, 30)))]) for i in range(3000)]
    df = docs(spark, rows)
    got = source_mixing.mix(df, block=8).toPandas()
    words = {r[0]: len(r[1].split()) for r in rows}
    assert len(got) == 3000 and all(words[r.doc_id] == r.size for r in got.itertuples())
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    per = {}
    for r in rows:
        per[r[3]] = per.get(r[3], 0) + words[r[0]]
    want = brute_targets(per)
    for s, g in got.groupby("source", dropna=False):
        s = None if pd.isna(s) else s
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.source_size.iloc[0] == per[s]
        assert abs(g.taken.sum() - want[s]) <= 40
        assert g[g["size"] > 0].copies.max() - g[g["size"] > 0].copies.min() <= 1
    again = source_mixing.mix(df.repartition(7), block=8).toPandas()
    assert got.set_index("doc_id").taken.sort_index().equals(again.set_index("doc_id").taken.sort_index())


def test_sources_of_few_documents_come_near_their_targets(spark):
    """Fifty documents of very different lengths a source, one of them with a third of the words."""
    rng = np.random.default_rng(8)
    rows = []
    for s in range(12):
        sizes = np.maximum(1, np.exp(rng.normal(4.5, 1.2, 49))).astype(int).tolist()
        rows += [(len(rows) + i, "w " * n, "en", f"s{s:02d}") for i, n in enumerate([*sizes, sum(sizes) // 2])]
    got = source_mixing.mix(docs(spark, rows)).toPandas()
    off = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    off = (off.taken / off.target - 1).abs()
    assert off.max() < 0.03 and off.median() < 0.005
    assert (got.taken <= 3 * got["size"]).all()


def test_running_sums_over_ranges(spark):
    rows = [(None if i == 7 else f"k{i * 37 % 101:03d}", i % 5) for i in range(101)]
    df = spark.createDataFrame(rows, "source string, size long").repartition(5)
    got = source_mixing._running(df, [F.col("source").asc_nulls_last()], ["size"], "test-running").collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    assert [(r.source, r.at, r.before_size) for r in sorted(got, key=lambda r: r["at"])] == [(s, i, sum(x[1] for x in order[:i])) for i, (s, _) in enumerate(order)]


def test_mix_expectation(spark):
    rows = [(i, "w " * (1 + i % 5), "en", "a" if i % 3 else "b") for i in range(600)]
    taken = [source_mixing.mix(docs(spark, rows), seed=s).toPandas().set_index("doc_id").copies.sort_index() for s in range(4)]
    mean = sum(taken) / 4
    assert 0.8 < mean[[i for i in range(600) if i % 5 == 0]].mean() / mean[[i for i in range(600) if i % 5 == 4]].mean() < 1.25
    assert not taken[0].equals(taken[1])


def test_mix_awkward_and_empty(spark):
    got = source_mixing.mix(docs(spark, AWKWARD)).toPandas()
    assert len(got) == len(AWKWARD) and got[got["size"] == 0].taken.eq(0).all()
    assert source_mixing.mix(docs(spark, [])).count() == 0
    none = source_mixing.mix(docs(spark, [(1, "", "en", "a"), (2, None, "en", "b")])).toPandas()
    assert none.taken.eq(0).all() and none.target.eq(0).all()


# ---- licenses

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), found


TEXTS = [
    None, "", "...", "cc by nc", "CC-BY/NC cc by nc by nc", "x under the MIT license. under THE mit License under the mit licenses", "apache license version 2.0; Apache License, Version 20", "cc by nKc cc by nc",
    "under the mitİ license", "é cc by nc é", "  cc by nc", "cc by nc\n", "under the under the mit license", "under the mit under the mit license license", "word " * 5000 + "cc by nc", "K cc by nc under the mit license",
]


def test_licenses_against_brute_force(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(3, "cc by nc", "en", "s"), (3, "no phrase", "en", "s"), (None, "cc by nc", "en", "s")]
    got = license_scan.scan(docs(spark, rows)).collect()
    want = sorted((str(i), n, sorted(p)) for i, t, *_ in rows for n, p in [brute_base(t)])
    assert sorted((str(r.doc_id), r.n_words, sorted((x["first"], x["label"]) for x in r.spans if x["kind"] == "phrase")) for r in got) == want
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_edited_templates_are_found(spark):
    text = license_scan.TEMPLATES[0][0].split()
    edited = text[:8] + ["new"] + text[8:20] + text[21:]
    rows = [(1, "intro " + " ".join(edited) + " end", "en", "s"), (2, " ".join(text[:6]), "en", "s"), (3, " filler ".join(text), "en", "s")]
    got = {r.doc_id: r.spans for r in license_scan.scan(docs(spark, rows)).collect()}
    assert [x["label"] for x in got[1]] == ["mit"] and got[1][0]["first"] == 1 and got[1][0]["cover"] > 0.6
    assert not got[2] and not got[3]


def labels(spark, texts):
    rows = license_scan.scan(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    return {r.doc_id: sorted({x["label"] for x in r.spans}) for r in sorted(rows, key=lambda r: r.doc_id)}


def test_notices_and_their_relatives(spark):
    texts = {
        "This work is licensed under the GNU General Public License, version 3.": ["gpl"],
        "It may be used under the terms of the GNU General Public License v2 or later": ["gpl"],
        "licensed under the GNU Lesser General Public License": ["lgpl"],
        "Licensed under the GNU Affero General Public License, version 3": ["agpl"],
        "Licensed under CC BY 4.0.": ["cc-by"],
        "Licensed under CC BY-SA 4.0.": ["cc-by-sa"],
        "Licensed under CC BY-NC 4.0.": ["cc-by-nc"],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": ["cc-by-sa"],
        "This work is licensed under a Creative Commons Attribution 4.0 International License": ["cc-by"],
        "Licensed under the BSD 3-Clause License": ["bsd"],
        "Licensed under the Mozilla Public License, Version 2.0": ["mpl-2"],
        "Released under the MIT License.": ["mit"],
        "see the GNU General Public License for more details": [],
        "the mit campus is under construction and the license is not": [],
        "license under cc": [],
    }
    assert list(labels(spark, texts).values()) == [texts[t] for t in texts]


def test_notices_with_edits(spark):
    """A changed, lost or added word leaves a notice a notice, unless it is one of the words that tell licenses apart."""
    edits = {
        "this work is available under the gnu general public license version 3": ["gpl"],
        "licensed under gnu general public license terms": [],
        "licensed under our gnu general public license": [],
        "dual licensed under the the gnu general public license": ["gpl"],
        "licensed under the gnu general private license": [],
        "this work is licenced under a creative commons attribution sharealike 4 0 international license": ["cc-by-sa"],
        "this work is licensed under a creative commons attribution sharealike 4 0 worldwide license": ["cc-by-sa"],
        "this is free and unencumbered software put into the public domain": ["unlicense"],
    }
    assert list(labels(spark, edits).values()) == [edits[t] for t in edits]


def test_languages_beyond_the_bound_are_an_error(spark):
    df = spark.createDataFrame([(i, f"text {i} in l{i % 3}", f"l{i % 3}") for i in range(30)], "doc_id long, text string, lang string")
    assert language_id.fit(df, max_languages=3).languages == ["l0", "l1", "l2"]
    with pytest.raises(ValueError, match="More than 2 languages"):
        language_id.fit(df, max_languages=2)
