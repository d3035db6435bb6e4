"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

Documents in a language that can't be told and toxic ones go, one document of
each group of near duplicates stays, passages that repeat earlier ones are cut,
and what is left is packed into sequences. Each stage's rows are written as
Parquet and read again as the next one's documents, and what the stage wrote for
itself is deleted then.

Results: a null text, or one without a letter, goes in the first stage; an empty
table passes through all of them; extra columns stay, whatever their names. Rows
that repeat a doc_id are judged one by one for language and toxicity; after that
they are one document, which goes if a row of it is a copy of an earlier one and
loses the passages that any of its rows loses. The near-duplicate stage keeps
rows without a doc_id, as nothing tells which one is meant, and they lose what
repeats earlier passages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm import langid, ngram_join, packing, substring, toxicity
from sitewright.llm.common import cut, release_kept, table
from sitewright.session import passing, path_of


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among ``gone``."""
    return docs.join(gone.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_anti").select(*docs.columns)


def _apart(docs: DataFrame, *read: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but those that an operator reads under names that it can't have, and the way back."""
    names = {c: f"__kept_{i}" for i, c in enumerate(docs.columns) if c not in read}
    return docs.withColumnsRenamed(names), {v: k for k, v in names.items()}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and those whose two nearest languages can't be told apart."""
    model = langid.train(docs.where(~langid.held_out(5, 0)))
    rows, back = _apart(docs, "doc_id", "text")
    found = langid.annotate(rows, model).where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).drop("lang_pred", "score", "ambiguous")
    return found.withColumnsRenamed(back).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the nearest labelled ones vote toxic."""
    rows, back = _apart(docs, "doc_id", "text")
    found = toxicity.annotate(rows, table(spark, sf_dir, "labels")).where("predicted = 0")
    return found.drop("score", "neighbours", "nearest", "predicted").withColumnsRenamed(back).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of documents that share word 5-grams at Jaccard 0.8 or more."""
    return _without(docs, ngram_join.join(docs, words=5, percent=80).where("component_id <> doc_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words inside repeats of earlier passages; other texts stay as they are, and documents of which nothing stays go."""
    rows, back = _apart(docs, "doc_id", "text", "n_chars")
    out = substring.deduplicate(rows).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", chars)
    return out.drop("n_words", "n_removed").withColumnsRenamed(back).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing(spark) as kept:
            docs = cut(stage(spark, docs, sf_dir), name)
            kept.append(path_of(docs))
        release_kept()
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenizing and packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None
