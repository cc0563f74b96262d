"""The corpus pipeline: stages that each apply one operator to what the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowweir.llm.exact_dedup import exact_dedup
from flowweir.llm.mixing import mixed_documents
from flowweir.llm.packing import pack
from flowweir.llm.quality import clean_lines
from flowweir.llm.simhash import simhash_groups
from flowweir.llm.text import frozen_rows, shared_table
from flowweir.llm.vocabularies import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and with them the documents that the quality rules reject."""
    packed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"), "text")
    judged = clean_lines(packed, id_col="doc", text_col="text").filter("kept")
    cleaned = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return judged.select(
        *[cleaned.get(c, F.col(f"doc_id.`{c}`")).alias(c) for c in docs.columns]
    )


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup(docs, carry=True).filter("kept").select("doc.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the row with the smallest doc_id stays."""
    rows = frozen_rows(docs, "near-rows")
    named = rows.select(F.struct("doc.doc_id", "row").alias("key"), F.col("doc.text").alias("text"))
    groups = simhash_groups(named, id_col="key")
    kept = groups.filter(F.col("id.row") == F.col("component_id.row")).select("id.row")
    return rows.join(kept, "row", "left_semi").select("doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words the mix takes, in their documents; a document taken again has a row again."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their places in sequences of 4096 tokens."""
    return pack(docs, vocabulary("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("source mix", mixing_stage),
    ("packing", packing_stage),
]

# The mix draws pseudorandom blocks and packing runs a tokenizer: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again.

    Null and empty texts are rejected by the first stage, so no stage after it
    has any. Texts of any length are worked on whole. Rows that repeat are one
    after the second stage, whichever ids they have. A table that is empty, or
    of which nothing is kept, gives an empty result with the same columns.
    Further columns are carried to the mix, with the names that they have.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
