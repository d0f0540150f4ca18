"""From raw documents to packed sequences: the stages of the corpus pipeline in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.attention_quality import fit, keep_good
from plumbline.llm.disclosure import sanitise
from plumbline.llm.packing import pack_documents
from plumbline.llm.passages import remove_repeats
from plumbline.llm.simhash import keep_one
from plumbline.session import cut_lineage, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of passages, taught by the labels, does not reject.

    All columns stay.  Null texts are judged as empty ones; repeated rows go or stay together; empty tables stay empty."""
    return keep_good(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies by SimHash.

    All columns stay.  Texts without words, null ones too, are one group; rows are told apart by id and text, and a row
    without an id stays only where no row of its group has one; empty tables stay empty."""
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has.

    All rows and columns stay, null texts as they are; rows that share an id are cut each by its own text."""
    return remove_repeats(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without personal data and the terms that disclose it.

    All rows and columns stay, null texts as they are; repeated rows are treated alike."""
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2,048 tokens.

    A null or empty text is its end id alone; rows that share an id are documents of their own; empty tables give no pieces."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("privacy", privacy),
    ("packing", packing),
]

# The stages train models, walk links and merge tokens: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; every stage before it is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
