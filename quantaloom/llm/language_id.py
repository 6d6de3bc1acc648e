"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities, buckets x languages, of fixed size (``2**BITS`` rows); it is broadcast and
a batch of texts is scored in numpy: the n-gram buckets of all its texts are gathered from the
matrix and summed text by text.  Only n-grams that occur are touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import table

BITS = 15
ORDERS = (1, 2, 3)
#: Characters whose n-grams are held at a time, and languages whose weights are: bounds the memory of a task, not what is read.
PIECE_CHARS = 1 << 17
LANGUAGE_BLOCK = 32
#: Rows that a language's counts are learned from, about; a language with fewer rows is learned from all of them.
ROWS_PER_LANGUAGE = 8000
#: Languages that a model may hold, 128 KiB each; a corpus with more is an error, none is left out.
LANGUAGES = 4096
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32
_FOLD[0] = 0
_GAP, _AHEAD = "\0\0", max(ORDERS) - 1


def _codes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    low = cp < 128
    cp[low] = _FOLD[cp[low]]
    return cp


def _buckets(codes: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams that begin at each of ``codes`` but the last ``_AHEAD``, orders side by side."""
    c = codes.astype(np.uint64)
    n = len(c) - _AHEAD
    out, h = [], np.zeros(n, np.uint64)
    for k in range(max(ORDERS)):
        h = (h + c[k : k + n] + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if k + 1 in ORDERS:
            out.append((h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.stack(out, 1)


def _grams(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(text numbers, each one's first row, buckets): the n-grams of all texts, about PIECE_CHARS characters at a time.

    A text stands between two pairs of zeros, the pair before it being its own, so that no n-gram holds characters of two texts
    and a text's n-grams are the same in any company.  A longer text comes in pieces, no n-gram of which is lost.
    """
    who, held, size = [], [], 0

    def together() -> tuple[list[int], np.ndarray, np.ndarray]:
        starts = np.cumsum([0, *(len(t) for t in held[:-1])])
        return who, starts, _buckets(_codes("".join([*held, _GAP])))

    for i, t in enumerate(texts):
        if not t:
            continue
        own = _GAP + t.lower()
        if len(own) > PIECE_CHARS:
            for at in range(0, len(own), PIECE_CHARS):
                piece = own[at : at + PIECE_CHARS + _AHEAD]
                short = min(PIECE_CHARS, len(own) - at) + _AHEAD - len(piece)
                yield [i], np.zeros(1, int), _buckets(_codes(piece + _GAP[:short]))
            continue
        if size + len(own) > PIECE_CHARS and who:
            yield together()
            who, held, size = [], [], 0
        who.append(i)
        held.append(own)
        size += len(own)
    if who:
        yield together()


@dataclass
class LanguageModel:
    """``languages`` in ascending order; ``weights`` float32 [2**BITS, languages]; ``prior`` [languages]."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior; of equally likely ones the first by name; ('und', 0.0) for a text without letters."""
        total = np.tile(self.prior, (len(texts), 1)) if self.languages else np.zeros((len(texts), 0))
        if self.languages:
            for who, starts, ids in _grams(texts):
                for lo in range(0, len(self.languages), LANGUAGE_BLOCK):
                    block = slice(lo, lo + LANGUAGE_BLOCK)
                    own = self.weights if len(self.languages) <= LANGUAGE_BLOCK else self.weights[:, block]
                    per_char = own[ids[:, 0]]
                    for k in range(1, ids.shape[1]):
                        per_char += own[ids[:, k]]
                    total[who, block] += np.add.reduceat(per_char, starts, axis=0, dtype=np.float64)
        langs, scores = [], []
        for t, row in zip(texts, total, strict=True):
            if not self.languages or not t or not _LETTER.search(t):
                langs.append("und")
                scores.append(0.0)
            else:
                best = int(np.argmax(row))
                langs.append(self.languages[best])
                scores.append(float(1.0 / np.exp(row - row[best]).sum()))
        return langs, scores


def fit(
    rows: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    rows_per_language: int = ROWS_PER_LANGUAGE, smoothing: float = 0.3, max_languages: int = LANGUAGES,
) -> LanguageModel:
    """Learn from rows with a language and a text, at most about ``rows_per_language`` of each language, drawn by a hash of the id.

    Rows with a null text or language teach nothing; without any row the model knows no language and answers 'und'.
    The languages' odds come from the counts of all rows.  Every language that occurs is learned.  The model takes 128 KiB a language, which is what
    ``max_languages`` bounds: more languages are a ValueError, and nothing is learned.
    """
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(5)).alias("h")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"More than {max_languages} languages: raise max_languages to learn all of them")
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, rows_per_language / counts[k]))]), F.col("lang"))
    drawn = rows.where(F.pmod("h", F.lit(1 << 20)) < share * float(1 << 20)).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}

        def told() -> Iterator[pa.RecordBatch]:
            for own, mine in sorted(found.items()):
                at = np.flatnonzero(mine)
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(mine[at])], names=["lang", "bucket", "n"])
            found.clear()

        for b in batches:
            if len(found) > 8 * LANGUAGE_BLOCK:  # counts so far go on, as a task has room for so many languages
                yield from told()
            lang = np.array(b.column(0).to_pylist(), object)
            for own in set(lang.tolist()):
                if own not in found:
                    found[own] = np.zeros(1 << BITS, np.int64)
                mine = found[own]
                for _, _, ids in _grams(b.column(1).filter(pa.array(lang == own)).to_pylist()):
                    mine += np.bincount(ids.ravel(), minlength=1 << BITS)
        yield from told()

    summed = drawn.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table_ = np.zeros((1 << BITS, len(languages)))
    table_[summed["bucket"].to_numpy(int), np.searchsorted(languages, summed["lang"].to_numpy(str))] = summed["n"].to_numpy(float)
    table_ += smoothing
    weights = np.log(table_ / table_.sum(0)).astype(np.float32)
    n = np.array([counts[k] for k in languages], float)
    return LanguageModel(languages, weights, np.log(n / n.sum()))


def predict(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two more columns, the language and its posterior in [0, 1]; see ``LanguageModel.score``.

    Whole texts are scored.  A column of ``docs`` named as one of the new ones is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                langs, scores = m.score(part.column(keep.index(text_col)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *into])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([docs.schema[c] for c in keep]).add(into[0], StringType()).add(into[1], DoubleType())
    return docs.select(*keep).mapInArrow(run, schema)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id's text falls into the given part; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    rows = predict(docs.select("doc_id", "text"), model).select("doc_id", "lang_pred", "score")
    return rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
