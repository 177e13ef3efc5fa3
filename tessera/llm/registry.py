"""Queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import codes, fingerprint, lines, phrases
from tessera.llm.automaton import score_documents
from tessera.llm.bpe import encode_documents
from tessera.llm.common import table
from tessera.llm.embeddings import near_vectors
from tessera.llm.html import extract_pages
from tessera.llm.jaccard import near_documents
from tessera.llm.packing import pack_documents
from tessera.llm.quality import classify
from tessera.llm.sharding import shard_documents
from tessera.llm.suffixes import passage_report


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress_vectors(table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lines, op2_fingerprints, op3_suffixes, op4_bpe, op5_html, op6_quality, op7_shards, op8_packing, op9_jaccard, op10_embeddings, op11_codes, op12_phrases, op13_automaton)
}
SQL: dict[str, str] = {"op1_lines": lines.SQL, "op2_fingerprints": fingerprint.SQL, "op11_codes": codes.SQL, "op12_phrases": phrases.SQL}
