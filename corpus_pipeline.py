"""A corpus pipeline of five stages: quality rules, line dedup, near-dedup, benchmark decontamination, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieline.llm import decontam, line_dedup, neardup, packing, quality_rules
from tieline.llm.common import cut, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the learned decision list keep; the list is learned from the documents' quality labels.

    Each row is judged by itself, so repeated rows share a verdict; a null or empty text fails the base and goes.
    """
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match an earlier line; n_chars follows the text.

    Null texts and rows without an id stay as they are. Rows equal in id and text are one document and get the same text.
    """
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.

    Rows without an id are in no group and stay. Of rows that share id and text the smallest of the other columns stays;
    rows that share an id but not the text are different texts of one document and all stay if it does.
    """
    found = cut(neardup.near_duplicates(docs).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_rows")))
    stay = docs.join(found, F.col("doc_id") == F.col("_kept"))
    single, several = stay.where("_rows = 1"), stay.where("_rows > 1")  # only repeated ids are shuffled by text
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    several = several.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("o")).select("doc_id", "text", *[F.col(f"o.{c}").alias(c) for c in others])
    return single.select(*COLUMNS).unionByName(several.select(*COLUMNS)).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items do not contaminate; null and empty texts have no words and stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, repeated rows and null texts too, and their places in sequences."""
    return packing.pack(docs.select("doc_id", "text"), packing.default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The learned list and the packing are not SQL; tests/llm/test_pipeline.py compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
