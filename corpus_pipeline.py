"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

Each stage works on all documents that its predecessor kept. All but the last return the columns of
documents, extra ones too, whatever their names; the last returns the packed pieces with their ids.

Cases, in every stage: an empty table gives an empty result; repeated rows are copies of each other (one
doc_id and one text: what is decided for one holds for all), rows that share a doc_id but not the text are
told apart by their text; ties go to the smaller doc_id; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import stored, table
from tessera.llm.jaccard import one_of_each_group
from tessera.llm.lines import dedup_lines
from tessera.llm.packing import packed_pieces
from tessera.llm.quality import good_documents
from tessera.llm.suffixes import dedup_passages


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose perplexity is over their language's threshold, and those without a text (null or empty).
    A null doc_id is never trusted but judged like others; a null language is one of its own."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier line matches; a document goes if all its lines do. Blank lines stay, and a null
    doc_id comes first."""
    return dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one of the smallest doc_id; a null one is smaller than all
    and stays. Documents without a word are copies of nothing."""
    return one_of_each_group(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop passages of 50 bytes and more that a document of a smaller doc_id has too (a null one is the smallest); a
    document goes if nothing is left of it. Shorter texts stay whole."""
    return dedup_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of tokens; a text without any is its end token alone."""
    return packed_pieces(docs, "word_bpe_49k.json")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("passages", passages), ("packing", packing)]

#: The quality and packing stages have no SQL form; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, through the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
