"""One query per operator: it reads its whole table and returns the full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowweir.llm.chat import format_conversations
from flowweir.llm.decontaminate import find_contamination
from flowweir.llm.exact_dedup import exact_dedup
from flowweir.llm.language import identify, train
from flowweir.llm.licences import scan_licences
from flowweir.llm.manifest import build_manifest, multiproofs
from flowweir.llm.mixing import mix_sizes
from flowweir.llm.packing import pack
from flowweir.llm.passages import shared_passages
from flowweir.llm.pii import KINDS, find_personal_data
from flowweir.llm.quality import clean_lines
from flowweir.llm.simhash import simhash_groups
from flowweir.llm.text import ascii_lower
from flowweir.llm.vocabularies import vocabulary
from flowweir.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


@query
def op5_quality_rules(spark, sf_dir):
    return clean_lines(_table(spark, sf_dir, "documents")).drop("clean_text")


@query
def op7_personal_data(spark, sf_dir):
    found = find_personal_data(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin(*KINDS[:4]))
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ","
    )

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS[:4]],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        # In hundredths, in the order of the spans.
        F.array_join(
            F.transform("spans", lambda s: F.round(s.score * 100).cast("int").cast("string")), ","
        ).alias("scores"),
    )


@query
def op2_simhash(spark, sf_dir):
    groups = simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@query
def op4_source_mix(spark, sf_dir):
    return mix_sizes(_table(spark, sf_dir, "documents"))


@query
def op9_packing(spark, sf_dir):
    packed = pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.withColumnRenamed("id", "doc_id")


CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query
def op10_chat(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    formatted = format_conversations(
        turns.unionByName(extra), vocabulary("byte_bpe_50k.json"), outputs=False
    )
    return formatted.withColumnRenamed("id", "conv_id")


@query
def op8_language(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).withColumnRenamed("id", "doc_id")


@query
def op3_licences(spark, sf_dir):
    return scan_licences(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
    )


@query
def op6_substring_dedup(spark, sf_dir):
    return shared_passages(_table(spark, sf_dir, "documents"))


@query
def op11_decontamination(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return found.select(
        "doc.doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "longest",
        "longest_start",
    )


@query
def op12_merkle_manifest(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lowered = F.when(fifth, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    proofs = multiproofs(build_manifest(docs, tampered={"text": lowered}))
    return proofs.withColumnRenamed("id", "doc_id")


@query
def op13_whitening(spark, sf_dir):
    return whiten(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
