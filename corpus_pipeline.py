"""Cleaning and packing of `documents`: language, quality, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; `docs` has the
columns of documents and may have others, whatever their names, which pass through. A row whose text is
null or has no letter goes in the first stage, so the later ones never meet it when they run in order; by
itself each stage handles it. No stage needs ids to be there or to differ. An empty table gives an empty
table in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, langid, line_dedup, near_join, packing, quality

#: Words that the base test of the quality rules asks for.
LEAST_WORDS = 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled ones teach; the model is fitted on `docs` itself.

    Goes: null and empty texts, texts without a letter, and texts whose language is less sure than one
    half. Rows without a label are judged like others; without any label in the table no language is known
    and only rows without a letter go. Long texts are read whole, in parts; repeated rows are judged alike.
    """
    return langid.keep(docs, langid.learned(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base test and all rules.

    Null and empty texts fail the base test; long texts count whole; repeated rows are judged alike.
    """
    return quality.keep(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; n_chars follows the text.

    A document that loses lines and is left with fewer words than the base test asks for goes. Null and
    empty texts and texts without a repeated run stay as they are. Of documents that share a run the first
    by doc_id, then by place, keeps it, null ids last; rows that repeat id and text are rewritten alike.
    """
    lines, removed = (common.free_name(docs.columns, c) for c in ("_lines", "_removed"))
    out = line_dedup.rewrite(docs, numbers=(lines, removed))
    out = out.filter((F.col(removed) == 0) | (F.regexp_count("text", F.lit(line_dedup.WORD)) >= LEAST_WORDS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one of the smallest doc_id, then the first row.

    Null ids come last. Texts without a word are no duplicates of anything; a short text is one n-gram.
    """
    return near_join.keep(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids.

    Null and empty texts are their end id alone; long texts fill sequences of their own; null and repeated
    ids are packed row by row.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("packing", packed),
]
#: SQL expresses neither the model of the first stage nor packing; tests hold each stage to a brute-force twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; a stage's input is removed once its output is written."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with common.scratch(spark) as keep:
            out = keep(stage(spark, docs, sf_dir), name)
        common.remove(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
