"""The operators' queries, each applied to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coppice.llm import align, chat, containment, crf, divergence, gru, licenses, lines, mixing, near, secrets, structure, urls
from coppice.plans.registry import Checked

QUERIES: dict[str, Checked] = {}


def _query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = Checked(function, sql)
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return crf.scored(docs, crf.trained(docs, _table(spark, sf_dir, "labels")))


@_query("op2_lm_scoring")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.read_and_scored(_table(spark, sf_dir, "documents"))


@_query("op3_mixing", mixing.sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


@_query("op4_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.grouped(_table(spark, sf_dir, "documents"))


@_query("op5_url_filter", urls.SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.judged(pages, urls.junk_titled(pages))


@_query("op6_decontamination", containment.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.found(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op7_chat")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_marks_conversation(_table(spark, sf_dir, "conversations"))
    return chat.digests(chat.formatted_turns(turns))


@_query("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(licenses.as_files(_table(spark, sf_dir, "documents")))


@_query("op9_line_dedup", lines.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated(_table(spark, sf_dir, "documents"))


@_query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judged(_table(spark, sf_dir, "documents"))


@_query("op11_structure_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.audited(_table(spark, sf_dir, "conversations"))


@_query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(_table(spark, sf_dir, "documents"))


@_query("op13_secret_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(_table(spark, sf_dir, "documents"))
