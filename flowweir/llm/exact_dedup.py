"""Exact deduplication by a stream with keyed state on disk.

The rows are written once with a number, the locator of their content. A stream
reads them and keeps, for each digest of a normalised text, the identifier that
stays, its locator and the number of rows. The state is in RocksDB under the
shared checkpoint folder and never expires, so that later files can be added to
the same folder. Rows whose digest is already known (hits) are compared with the
kept row byte by byte; only they carry their text through the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowweir.llm.text import ascii_lower, full_text, numbered_rows, shared_table, shared_write
from flowweir.session import stage_path

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A run takes all files in few batches: a store need not stay open between them.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def _order(ident: Column, kind: str) -> Column:
    """Ids in their order with null first; plain numbers keep aggregation hashed."""
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return F.coalesce(ident.cast("long"), F.lit(-(2**63)))
    return F.struct(ident)


def _run_stream(rows: DataFrame, source: str, checkpoint: str, ident: Column, kind: str) -> None:
    """Feed all rows of the folder ``source`` to the keyed state, then stop."""
    spark = rows.sparkSession
    seen = (
        spark.readStream.schema(rows.schema)
        .parquet(source)
        .groupBy("digest", "n_bytes")
        .agg(
            F.max(ident).alias("keep_id"),
            F.max_by("row", _order(ident, kind)).alias("keep_row"),
            F.count(F.lit(1)).alias("group_size"),
        )
    )
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        # The running query has its own copy of the settings.
        running = (
            seen.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    running.awaitTermination()


def _state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row per digest, as the state holds it after the last batch."""
    held = spark.read.format("statestore").load(checkpoint)
    # The value holds the buffers of max, max_by (value, order) and count, in this order.
    buffers = held.schema["value"].dataType.names
    return held.select(
        F.col("key.digest").alias("digest"),
        F.col("key.n_bytes").alias("n_bytes"),
        *[
            F.col(f"value.`{buffers[at]}`").alias(name)
            for name, at in (("keep_id", 0), ("keep_row", 1), ("group_size", 3))
        ],
    )


def _split_collisions(decided: DataFrame, colliding: DataFrame, kind: str) -> DataFrame:
    """Group the rows of digests that stand for several texts by their full text."""
    rows = decided.join(colliding, ["digest", "n_bytes"], "left_semi")
    groups = rows.groupBy("digest", "n_bytes", "folded").agg(
        F.max("doc_id").alias("keep_id"),
        F.max_by("row", _order(F.col("doc_id"), kind)).alias("keep_row"),
        F.count(F.lit(1)).alias("group_size"),
    )
    mended = rows.drop("keep_id", "keep_row", "group_size").join(
        groups, ["digest", "n_bytes", "folded"]
    )
    others = decided.join(colliding, ["digest", "n_bytes"], "left_anti")
    return others.unionByName(mended)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256_hex,
    carry: bool = False,
) -> DataFrame:
    """One row per input row: the row of its group of equal texts that stays.

    Texts are equal when they are the same after lower-casing A-Z; a null text
    counts as empty. Of equal texts the row with the largest id stays (null is
    below every id; of rows that also share that id exactly one stays, and
    which one is not defined). An empty table gives an empty result. Texts of any
    length are digested and compared whole. Columns other than id and text are not
    read.

    Returns ``row``, the id column as ``doc_id``, ``keep_id``, ``group_size``,
    ``kept`` and ``digest``. With ``carry`` also ``doc``, a struct of all given
    columns. ``digest`` may replace SHA-256 as key of the state; a weak one only
    costs time, as texts of equal digests are compared.
    """
    spark = docs.sparkSession
    columns = docs.columns if carry else [id_col, text_col]
    wanted = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys(columns)])
    kind = dict(wanted.dtypes)[id_col]
    folded = ascii_lower(full_text(f"`{text_col}`"))
    numbered = numbered_rows(wanted, digest=digest(folded), n_bytes=F.octet_length(folded))
    source = shared_write(numbered, "dedup-rows")
    rows = spark.read.schema(numbered.schema).parquet(source)
    ident = F.col(f"doc.`{id_col}`")
    checkpoint = stage_path(spark, "dedup-state")
    _run_stream(rows, source, checkpoint, ident, kind)

    decided = rows.join(_state(spark, checkpoint), ["digest", "n_bytes"]).select(
        "row",
        ident.alias("doc_id"),
        "digest",
        "n_bytes",
        "keep_id",
        "keep_row",
        "group_size",
        F.when(F.col("group_size") > 1, ascii_lower(full_text(f"doc.`{text_col}`"))).alias(
            "folded"
        ),
        *([F.col("doc")] if carry else []),
    )
    decided = shared_table(decided, "dedup-decided")
    stays = F.col("row") == F.col("keep_row")
    hits = decided.filter(F.col("group_size") > 1)
    first = hits.filter(stays).select("digest", "n_bytes", F.col("folded").alias("kept_text"))
    differing = (
        hits.filter(~stays)
        .join(first, ["digest", "n_bytes"])
        .filter(F.col("folded") != F.col("kept_text"))
        .select("digest", "n_bytes")
    )
    if not differing.isEmpty():
        decided = _split_collisions(decided, differing.distinct(), kind)
    return decided.select(
        "row",
        "doc_id",
        "keep_id",
        "group_size",
        stays.alias("kept"),
        "digest",
        *(["doc"] if carry else []),
    )
