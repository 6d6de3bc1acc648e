"""License scans by diagonal voting (DataFrame functions only).

All rolling word trigrams of all texts are joined, by hash, to the positions at which license
templates hold them.  A hit at word ``i`` of a text and word ``j`` of a template votes for diagonal ``i - j``.
Votes are counted per diagonal; a phrase stands where all of its trigrams vote for one
diagonal.  Templates, the notices that people write and the openings of license texts, survive small edits: neighbouring
diagonals are merged into spans.  A span is verified: it must cover a share of the template, and all of the words that
tell the license from its relatives (a GPL from an LGPL, CC BY from CC BY-SA).

The trigrams are formed, hashed and probed inside one generated stage, text by text; only the hits, and one
row per text, are shuffled.  The templates are constants of a few hundred words, which is the size of what is
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import table

K = 3
#: The base phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: License notices and opening words of public license texts, their labels, and the words that no edit may touch.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit", ""),
    ("released under the mit license", "mit", "the mit license"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2", "apache license version 2"),
    ("licensed under the apache license version 2 0", "apache-2", "apache license version 2"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc", "commons attribution noncommercial"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa", "commons attribution sharealike"),
    ("this work is licensed under a creative commons attribution noderivatives 4 0 international license", "cc-by-nd", "commons attribution noderivatives"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by", "commons attribution 4"),
    ("this work is licensed under a creative commons attribution 3 0 unported license", "cc-by", "commons attribution 3"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc by sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd", "cc by nd"),
    ("licensed under cc by 4 0", "cc-by", "cc by 4"),
    ("this work is dedicated to the public domain under cc0 1 0 universal", "cc0", "cc0 1 0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", ""),
    ("licensed under the bsd license", "bsd", "the bsd license"),
    ("licensed under the bsd 3 clause license", "bsd", "bsd 3 clause"),
    ("licensed under the bsd 2 clause license", "bsd", "bsd 2 clause"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl", "gnu general public license"),
    ("under the terms of the gnu general public license", "gpl", "gnu general public license"),
    ("licensed under the gnu general public license", "gpl", "gnu general public license"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl", "gnu lesser general public license"),
    ("licensed under the gnu lesser general public license", "lgpl", "gnu lesser general public license"),
    ("under the terms of the gnu affero general public license", "agpl", "gnu affero general public license"),
    ("licensed under the gnu affero general public license", "agpl", "gnu affero general public license"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", "mozilla public license"),
    ("licensed under the mozilla public license version 2 0", "mpl-2", "mozilla public license"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", ""),
    ("licensed under the isc license", "isc", "the isc license"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "free and unencumbered software"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "epl-2", "eclipse public license"),
    ("licensed under the eclipse public license version 2 0", "epl-2", "eclipse public license"),
    ("distributed under the boost software license version 1 0", "boost", "boost software license"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib", ""),
)
#: ASCII that separates words; A-Z are letters, lowered before comparing.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The share of a template's trigrams that must be met; more of a template of at most SHORT trigrams, most of which are the license's name, as names are also mentioned.
COVER, SHORT_COVER, SHORT = 0.6, 0.8, 6
DRIFT = 2


def postings() -> list[tuple]:
    """(template, kind, label, n_grams, n_keys, at, key, three words) of every position of the phrases and templates."""
    rows = []
    for kind, texts in (("phrase", [(*p, "") for p in PHRASES]), ("template", TEMPLATES)):
        for text, label, key in texts:
            w, k = text.split(), key.split()
            n = len(w) - K + 1
            first = next((i for i in range(len(w)) if k and w[i : i + len(k)] == k), n)
            keys = range(first, first + len(k) - K + 1)
            rows += [(f"{kind[0]}:{text}", kind, label, n, len(keys), j, j in keys, *w[j : j + K]) for j in range(n)]
    return rows


def _postings(spark: SparkSession) -> DataFrame:
    t = spark.createDataFrame(postings(), "template string, kind string, label string, n_grams int, n_keys int, at int, key boolean, t0 string, t1 string, t2 string")
    return t.withColumn("gram", F.xxhash64("t0", "t1", "t2"))


def scan(docs: DataFrame, *, min_cover: float = COVER, short_cover: float = SHORT_COVER, drift: int = DRIFT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, spans (template, kind, label, first, last, cover) and n_words' digest columns.

    ``drift``: how many words two neighbouring diagonals may lie apart to be merged; ``min_cover``: the share of a
    template's trigrams that a merged span must hold, ``short_cover`` that of a short template's.  A span must hold the template's own words, too.  A text that is null or has no word has n_words 0 and no span.
    Repeated rows each come back; rows of one id with different texts are scanned apart; null ids are kept.
    Other columns are ignored, whatever their names.  Whole texts are scanned.
    """
    spark = docs.sparkSession
    # U+212A is the one character outside ASCII that lower() turns into an ASCII letter; U+0138 keeps it a foreign letter.
    raw = F.coalesce(F.col(text_col), F.lit(""))
    words = F.split(F.lower(F.replace(raw, F.lit("K"), F.lit("ĸ"))), SEPARATORS)
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(raw).alias("body"), F.octet_length(raw).alias("octets"), words.alias("w"))
    # Leading or trailing separators leave an empty first or last element.
    d = d.withColumn("w", F.filter("w", lambda x: x != "")).withColumn("w", F.when(F.size("w") == 0, F.array(F.lit(""))).otherwise(F.col("w")))
    g = d.select("doc_id", "body", "octets", "w", F.posexplode("w").alias("i", "w0"))
    g = g.withColumn("w1", F.get("w", F.col("i") + 1)).withColumn("w2", F.get("w", F.col("i") + 2))
    n_words = F.when((F.size("w") == 1) & (F.col("w0") == ""), F.lit(0)).otherwise(F.size("w"))
    g = g.select("doc_id", "body", "octets", "i", n_words.alias("n_words"), "w0", "w1", "w2", F.xxhash64("w0", "w1", "w2").alias("gram"))
    p = F.broadcast(_postings(spark))
    same = (g["gram"] == p["gram"]) & (g["w0"] == p["t0"]) & (g["w1"] == p["t1"]) & (g["w2"] == p["t2"])
    hits = g.join(p, same, "left").where("template is not null or i = 0")
    hits = hits.select("doc_id", "body", "octets", "n_words", "i", "template", "kind", "label", "n_grams", "n_keys", "at", "key", (F.col("i") - F.col("at")).alias("diagonal"))

    key = ["doc_id", "body", "octets"]
    # A row whose first word is a hit of several templates comes more than once: rows of a text are told by the least such hit.
    first = F.col("i") == 0
    lone = hits.groupBy(*key, "n_words", "i", "template", "kind", "label", "n_grams", "n_keys", "at", "key", "diagonal").agg(F.count("*").alias("times"))
    votes = lone.groupBy(*key, "n_words", "template", "kind", "label", "n_grams", "n_keys", "diagonal").agg(
        F.collect_list(F.when(F.col("key"), F.col("at"))).alias("keys"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.collect_list("at").alias("ats"), F.max(F.when(first, F.col("times"))).alias("copies"),
    )
    near = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(near)
    joined = (F.col("kind") == "template") & (apart <= drift)
    votes = votes.withColumn("fresh", F.when(joined, 0).otherwise(1)).withColumn("span", F.sum("fresh").over(near))
    spans = votes.groupBy(*key, "n_words", "template", "kind", "label", "n_grams", "n_keys", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("held"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"), F.max("copies").alias("copies"), F.min("diagonal").alias("diagonal"),
    )
    cover = F.col("covered") / F.col("n_grams")
    least = F.when(F.col("n_grams") <= SHORT, F.lit(short_cover)).otherwise(F.lit(min_cover))
    verified = (cover >= least) & (F.col("held") == F.col("n_keys")) & (F.col("hi") - F.col("lo") <= F.col("n_grams") * 2)
    good = F.when(F.col("kind") == "phrase", F.col("covered") == F.col("n_grams")).otherwise(verified)
    # A phrase of one trigram has no diagonal but its own; all votes of a phrase's diagonal stand for one place.
    start = F.when(F.col("kind") == "phrase", F.col("diagonal")).otherwise(F.col("lo"))
    span = F.struct("template", "kind", "label", start.cast("long").alias("first"), (F.col("hi") + K - 1).cast("long").alias("last"), cover.alias("cover"))
    out = spans.groupBy(*key, "n_words").agg(F.collect_list(F.when(good, span)).alias("spans"), F.coalesce(F.max(F.col("copies")), F.lit(1)).alias("copies"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] == "phrase")
    starts = F.transform(base, lambda x: x["first"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    return s.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda x: x["cover"])), F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    text = lambda x: "'" + x + "'"
    rows = ", ".join(f"({text(t)}, {text(kind)}, {text(label)}, {n}, {n_keys}, {at}, {str(key).lower()}, {text(' '.join(w))})" for t, kind, label, n, n_keys, at, key, *w in postings())
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH p(template, kind, label, n_grams, n_keys, pos, is_key, gram) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i - 1, 'gram': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}})) AS x FROM d),
h AS (SELECT g.doc_id, g.x.i AS i, p.* EXCLUDE (gram), g.x.i - p.pos AS diagonal FROM g JOIN p ON p.gram = g.x.gram),
v AS (SELECT doc_id, template, kind, label, n_grams, n_keys, diagonal, min(i) AS lo, max(i) AS hi, list(pos) AS ats, list(pos) FILTER (is_key) AS keys FROM h GROUP BY ALL),
m AS (SELECT *, CASE WHEN kind = 'template' AND diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {DRIFT} THEN 0 ELSE 1 END AS fresh FROM v),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM m),
s AS (SELECT doc_id, template, kind, label, n_grams, n_keys, span, min(lo) AS lo, max(hi) AS hi, min(diagonal) AS diagonal, len(list_distinct(flatten(list(ats)))) AS covered, len(list_distinct(flatten(list(coalesce(keys, []))))) AS held FROM n GROUP BY ALL),
k AS (SELECT *, covered / n_grams AS cover FROM s WHERE CASE WHEN kind = 'phrase' THEN covered = n_grams
  ELSE covered / n_grams >= CASE WHEN n_grams <= {SHORT} THEN {SHORT_COVER} ELSE {COVER} END AND held = n_keys AND hi - lo <= n_grams * 2 END),
a AS (SELECT doc_id, count(*) FILTER (kind = 'phrase') AS n_base, min(diagonal) FILTER (kind = 'phrase') AS first_word, max(diagonal) FILTER (kind = 'phrase') AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'phrase') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(a.n_base, 0) AS n_base, a.first_word, a.last_word, coalesce(a.base_labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(a.score, 0.0) AS score
FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""


ORACLE = _oracle()
