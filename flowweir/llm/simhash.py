"""SimHash fingerprints linked by multi-index hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowweir.llm.components import connected_components
from flowweir.llm.text import full_text, shared_table

SEED = 42
SEGMENTS, SEGMENT_BITS = 2, 32


def _fingerprint_batches(shingle_words: int):
    """Function over Arrow batches: ids stay, texts become 64-bit fingerprints."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        def fingerprint(text: str) -> int:
            # Lower-cases A-Z only and splits at the six ASCII white-space characters.
            tokens = text.encode().lower().split()
            if not tokens:
                return 0
            line = b" ".join(tokens)
            if len(tokens) <= shingle_words:
                hashes = [xxh64_intdigest(line, SEED)]
            else:
                widths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
                ends = np.cumsum(widths) - 1
                starts = (ends - widths + 1).tolist()
                ends = ends[shingle_words - 1 :].tolist()
                hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends)]
            ones = np.zeros(64, np.int64)
            values = np.array(hashes, ">u8")
            for at in range(0, len(values), 65536):
                block = values[at : at + 65536].view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
            bits = np.packbits(2 * ones > len(values))
            return int.from_bytes(bits.tobytes(), "big", signed=True)

        for batch in batches:
            values = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.int64())], names=["id", "fingerprint"]
            )

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int = 3) -> DataFrame:
    """``id`` and ``fingerprint`` (64 bits as a signed number) of each row."""
    read = docs.select(F.col(f"`{id_col}`").alias("id"), full_text(f"`{text_col}`").alias("text"))
    schema = T.StructType(
        [read.schema["id"], T.StructField("fingerprint", T.LongType(), False)]
    )
    return read.mapInArrow(_fingerprint_batches(shingle_words), schema)


def _segment(fingerprint: Column, segment: int) -> Column:
    return F.shiftright(fingerprint, segment * SEGMENT_BITS).bitwiseAND(
        F.lit(2**SEGMENT_BITS - 1)
    )


def _ball(value: Column) -> Column:
    """The value and those with one more bit set.

    This is half of the ball of radius 1: of two values one bit apart, the one
    without the bit finds the other, so each pair is met once per segment.
    """
    bits = F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1))
    set_one = lambda j: value.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), j))
    return F.array_distinct(F.concat(F.array(value), F.transform(bits, set_one)))


def fingerprint_links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints that differ in at most ``max_bits`` bits.

    With two segments, one of them differs in at most ``max_bits // 2`` bits; the
    balls enumerated here have radius 1, so ``max_bits`` may be 3 at most. A pair
    that both segments find comes twice. A fingerprint has at most 43,744 others
    within 3 bits, so the links stay proportional to the distinct fingerprints.
    Both sides are sorted and merged: Spark sizes the balls as if they had one row a fingerprint,
    and would send all 33 to every executor.
    """
    if max_bits > 2 * SEGMENTS - 1:
        raise ValueError("balls of radius 1 in two segments find at most 3 differing bits")
    table, probes = [], []
    for s in range(SEGMENTS):
        value = _segment(F.col("fingerprint"), s)
        table.append(
            distinct.select(
                F.lit(s).alias("segment"), value.alias("value"), F.col("fingerprint").alias("b")
            )
        )
        probes.append(
            distinct.select(
                F.lit(s).alias("segment"),
                F.explode(_ball(value)).alias("value"),
                F.col("fingerprint").alias("a"),
            )
        )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    own = (_segment_equal(F.col("a"), F.col("b"), F.col("p.segment"))) & (F.col("a") >= F.col("b"))
    left = probes[0].unionByName(probes[1]).alias("p")
    right = table[0].unionByName(table[1]).alias("t")
    same = (F.col("p.segment") == F.col("t.segment")) & (F.col("p.value") == F.col("t.value"))
    return left.hint("merge").join(right, same & near & ~own).select("a", "b")


def _segment_equal(a: Column, b: Column, segment: Column) -> Column:
    differing = a.bitwiseXOR(b)
    return F.when(segment == 0, _segment(differing, 0) == 0).otherwise(_segment(differing, 1) == 0)


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    max_bits: int = 3,
) -> DataFrame:
    """``id``, ``fingerprint`` and ``component_id`` of each row.

    Fingerprints within ``max_bits`` bits are linked; a row's component is the
    smallest id it reaches over links, its own included (null ids are passed
    over; null if there is no other). A null text counts as empty; texts without
    a word have fingerprint 0 and link like any other. Rows with equal
    fingerprints are merged before linking, so copies cost nothing more. Very
    long texts are read whole, inside their row. An empty table gives an empty result. Columns other than id and text are
    ignored, so none can clash.
    """
    marked = shared_table(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    distinct = shared_table(
        marked.groupBy("fingerprint").agg(F.min("id").alias("first")), "distinct-fingerprints"
    )
    components = connected_components(fingerprint_links(distinct, max_bits), "a", "b")
    members = distinct.join(
        components.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).withColumn("component", F.coalesce("component", "fingerprint"))
    smallest = members.groupBy("component").agg(F.min("first").alias("component_id"))
    named = members.join(smallest, "component").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select("id", "fingerprint", "component_id")
