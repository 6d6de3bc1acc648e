"""Substring deduplication by sliding sentence spans.

A text is cut into sentences, and every run of several consecutive sentences is hashed, in lower case and with single spaces.  The
hashes are reduced to the first document of each, joined back to the runs globally, and every sentence that a run other than the first
occurrence covers is removed.  Documents are ordered by id, occurrences within one by position.

Several are three or more, of whatever length, and two that hold enough words.  Of these runs the shortest from each sentence on, and up
to each, stand for all: a repeated longer run repeats the ones that it is made of, and these cover it.

Runs are told apart by 128 bits.  Hashes are pre-aggregated before they move, so a passage that is in very many documents is one row per
task; the hashes with the most runs are joined by broadcast, so that no task gets all runs of one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .components import labelled
from .hashing import mix64, salts
from .workspace import materialize, table

#: (sentences, least words): every run of so many consecutive sentences or more with so many words at least is compared.
SPANS = ((3, 1), (2, 20))
#: Scripts written without spaces: Thai, Lao, Burmese, Khmer, kana, Chinese characters.  Two characters count as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: So many characters count as a word at least, for what has no spaces in other scripts (encoded data, addresses).
LONG_WORD = 20
_CUT = re.compile(r"((?<=[.!?])\s+|(?<=[。！？])|\s*\n\s*)")


def pieces(text: str) -> tuple[list[str], list[int]]:
    """A text's pieces, sentences and the gaps between them in turn, and where its sentences (not blank) stand among them."""
    found = _CUT.split(text)
    return found, [i for i in range(0, len(found), 2) if found[i] and not found[i].isspace()]


def sizes(sentences: list[str]) -> np.ndarray:
    """The words of each sentence (lower case, single spaces), one at least; by characters where there are no spaces."""
    own = [max(t.count(" ") + 1, len(t) // LONG_WORD) for t in sentences]
    if _UNSPACED.search("".join(sentences)):
        own = [n + len(_UNSPACED.findall(t)) // 2 for n, t in zip(own, sentences, strict=True)]
    return np.array(own, np.int64)


@cache
def _minima(lengths: tuple[tuple[int, int], ...]) -> list[tuple[int, int]]:
    """``lengths`` without those that others imply."""
    return [(k, w) for k, w in set(lengths) if not any(j <= k and v <= w for j, v in set(lengths) - {(k, w)})]


def shortest_runs(size: np.ndarray, lengths: tuple[tuple[int, int], ...] = SPANS) -> tuple[np.ndarray, np.ndarray]:
    """(first sentence, sentences) of the shortest run from each sentence on, and up to each, that reaches one of ``lengths``; each once."""
    n = len(size)
    total = np.r_[0, np.cumsum(size)]
    at = np.arange(n + 1)
    end, start = np.full(n + 1, n + 1), np.full(n + 1, -1)
    for k, least in _minima(tuple(lengths)):
        end = np.minimum(end, np.maximum(at + k, np.searchsorted(total, total + least)))
        start = np.maximum(start, np.minimum(at - k, np.searchsorted(total, total - least, side="right") - 1))
    on, back = end <= n, start >= 0
    runs = np.unique(np.r_[at[on] * (n + 1) + end[on], start[back] * (n + 1) + at[back]])
    return runs // (n + 1), runs % (n + 1) - runs // (n + 1)


def spans(text: str, lengths: tuple[tuple[int, int], ...] = SPANS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two 64-bit hashes [runs, 2], first sentence, sentences, whether the text has it earlier) of each run of a text."""
    found, at = pieces(text)
    sentences = [" ".join(found[i].lower().split()) for i in at]
    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in sentences), np.uint64).reshape(-1, 2)
    where, size = shortest_runs(sizes(sentences), lengths)
    hashes = np.empty((len(where), 2), np.uint64)
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        run = np.full((len(own), 2), n, np.uint64)
        for k, c in enumerate(salts(2 * n, 900 + n).reshape(n, 2)):
            run += h[where[own] + k] * c
        hashes[own] = mix64(run)
    again = np.ones(len(hashes), bool)
    again[np.unique(hashes, axis=0, return_index=True)[1]] = False  # the first place of each: runs stand in order
    return hashes, where, size, again


def repeated_runs(docs: DataFrame, *, lengths: tuple[tuple[int, int], ...] = SPANS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs array<struct<at, size>>) of documents that hold a run whose first occurrence is elsewhere, or earlier in the same text."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    kind = dict(base.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, columns, held = [], [[], [], [], []], 0

            def flush() -> pa.RecordBatch:
                h, at, size, again = (np.concatenate(c) for c in columns)
                ids = b.column(0).take(pa.array(np.concatenate(rows)))
                h = np.ascontiguousarray(h.T).view(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), ids, pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(again)], names=["h", "g", "id", "at", "size", "again"])

            for i, t in enumerate(b.column(1)):
                found = spans(t.as_py(), lengths)
                if n := len(found[0]):
                    rows.append(np.full(n, i))
                    for c, x in zip(columns, found, strict=True):
                        c.append(x)
                    held += n
                if held > 1 << 17:
                    yield flush()
                    rows, columns, held = [], [[], [], [], []], 0
            if held:
                yield flush()

    runs = materialize(base.mapInArrow(run, f"h long, g long, id {kind}, at int, size int, again boolean"), "sentence-runs")
    first = runs.groupBy("h", "g").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("again").cast("int")).alias("twice"), F.count("*").alias("rows"))
    first = materialize(first.where("first < last or twice = 1").select("h", "g", "first", "rows"), "repeated-runs")
    later = labelled(runs, first, ["h", "g"], "inner").where("id != first or again")
    return later.groupBy("id").agg(F.collect_list(F.struct("at", "size")).alias("runs"))


def remove_repeats(docs: DataFrame, *, lengths: tuple[tuple[int, int], ...] = SPANS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated sentences cut out of the text, and n_sentences and n_removed (int) added (replaced if there).

    A document's sentence goes if a run that covers it, of any length that reaches one of ``lengths``, occurs in a document of smaller id or
    earlier in its own text.  Texts without such
    a sentence come back unchanged, null as null; a text wholly repeated becomes empty.  Rows with a null id are neither
    compared nor changed; rows that repeat an id count as one document.  Other columns are kept.
    """
    keep = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    found = repeated_runs(docs, lengths=lengths, id_col=id_col, text_col=text_col)
    where = keep.index(text_col)
    # Columns travel under names of their own, so that theirs clash with nothing.
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    joined = rows.join(found, F.col(f"c{keep.index(id_col)}") == F.col("id"), "left").drop("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                texts, count, gone = [], [], []
                for t, runs in zip(b.column(where), b.column(len(keep)), strict=True):
                    text = t.as_py()
                    found, at = pieces(text or "")
                    out = np.zeros(len(at), bool)
                    if runs.is_valid:
                        for r in runs.as_py():
                            out[r["at"] : r["at"] + r["size"]] = True
                    if out.any():
                        drop = {i for i, x in zip(at, out.tolist(), strict=True) if x}
                        text = "".join(p for i, p in enumerate(found) if i - i % 2 not in drop)
                    texts.append(text)
                    count.append(len(at))
                    gone.append(int(out.sum()))
                columns = list(b.columns[: len(keep)])
                columns[where] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int32()), pa.array(gone, pa.int32())], names=[*keep, "n_sentences", "n_removed"])

    schema = StructType([docs.schema[c] for c in keep]).add("n_sentences", IntegerType()).add("n_removed", IntegerType())
    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "text")


#: Fixed marks stand for the cuts: char 2 before, char 3 after the gap between two sentences.
ORACLE = """
WITH t AS (SELECT doc_id, text, regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])(\\s+)|(\\s*\\n\\s*)', '\\1' || chr(2) || '\\2\\3' || chr(3), 'g'), '([。！？])', '\\1' || chr(2) || chr(3), 'g') AS marked FROM documents),
p AS (SELECT doc_id, unnest(string_split(marked, chr(3))) AS piece, unnest(range(len(string_split(marked, chr(3))))) AS place FROM t),
q AS (SELECT doc_id, place, piece, split_part(piece, chr(2), 1) AS said FROM p),
s AS (SELECT doc_id, place, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i, lower(regexp_replace(trim(said, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\s+', ' ', 'g')) AS said FROM q WHERE regexp_matches(said, '\\S')),
z AS (SELECT *, greatest(length(said) - length(replace(said, ' ', '')) + 1, length(said) // 20) AS size FROM s),
r AS (SELECT doc_id, i, 3 AS n, said || chr(1) || lead(said) OVER o || chr(1) || lead(said, 2) OVER o AS run FROM z WINDOW o AS (PARTITION BY doc_id ORDER BY i)
  UNION ALL SELECT doc_id, i, 2, CASE WHEN size + lead(size) OVER o >= 20 THEN said || chr(1) || lead(said) OVER o END FROM z WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
a AS (SELECT *, row_number() OVER (PARTITION BY n, run ORDER BY doc_id, i) AS k FROM r WHERE run IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM a WHERE k > 1),
c AS (SELECT s.doc_id, s.place, g.i IS NOT NULL AS gone FROM s LEFT JOIN g ON g.doc_id = s.doc_id AND g.i = s.i),
o AS (SELECT q.doc_id, count(c.gone) AS n_sentences, count(*) FILTER (c.gone) AS n_removed, string_agg(replace(q.piece, chr(2), ''), '' ORDER BY q.place) FILTER (NOT coalesce(c.gone, false)) AS left_ FROM q LEFT JOIN c ON c.doc_id = q.doc_id AND c.place = q.place GROUP BY q.doc_id)
SELECT t.doc_id, CAST(o.n_sentences AS INTEGER) AS n_sentences, CAST(o.n_removed AS INTEGER) AS n_removed, CASE WHEN o.n_removed > 0 THEN coalesce(o.left_, '') ELSE t.text END AS text FROM t JOIN o ON o.doc_id = t.doc_id
"""
