"""A training-data pipeline over ``documents``: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantaloom import ship
from quantaloom.llm import bpe, jaccard_join, language_id, source_mixing, substring_dedup
from quantaloom.llm.workspace import materialize

#: Documents whose language is told with less certainty are rejected, as are those without any letter.
LEAST_CERTAINTY = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with enough certainty by a model of the labelled documents.

    The model is learned from the stage's own documents that have a language.
    """
    model = language_id.fit(docs)
    told = language_id.predict(docs.select(*COLUMNS), model, into=("lang_told", "certainty"))
    return told.where((F.col("lang_told") != "und") & (F.col("certainty") >= LEAST_CERTAINTY)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more, the one of the smallest id.

    Rows that repeat that id all stay, and so do copies with a null id.
    """
    found = jaccard_join.jaccard_components(docs, jaccard_join.Scheme(width=5, num=80, den=100))
    others = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(others, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentences that repeat an earlier document's or their own; a document that is left without text goes."""
    cut = substring_dedup.remove_repeats(docs.select(*COLUMNS))
    kept = cut.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none, once, or up to three times.

    Every row gets a number of copies of its own, those with a null id and those that repeat an id too: what is drawn for an id, source and
    number of words is dealt to the rows that have them, the order of which does not matter to the mix.
    """
    key = ["doc_id", "source", "size"]
    mixed = source_mixing.mix(docs).select(*key, "copies", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("copies"))).alias("nth")).where("copies > 0")
    mixed = mixed.select(*[F.col(c).alias(f"__{c}") for c in (*key, "nth")], "copies")
    rows = docs.select(*COLUMNS, F.coalesce(F.regexp_count("text", F.lit(source_mixing.WORD)), F.lit(0)).cast("long").alias("size"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text", "lang", "n_chars"))))
    taken = rows.join(mixed, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*key, "nth")])
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    return bpe.encode(docs)


STAGES = [
    ("language ID", languages),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE", tokens),
]

#: The language model, the random mix and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each result written and read again before the next."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs
