"""Mixing sources to target weights in blocks of words.

Each source's documents are laid end to end and cut into blocks of a fixed
number of words. The mix is a sequence of slots in shards of a fixed length. A
slot names a source and a number; the number is mapped to a block by a
pseudorandom permutation of the source's block numbers, a fresh one each time
the source has been used up, and blocks are joined by that number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowweir.functions.ordered import ordered_blocks, with_rank
from flowweir.llm.text import frozen_rows, full_text, shared_table

WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 4096
SLOT_SCHEMA = "source_no long, block long, shard long, place int"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _sources(sized: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """One row per source: number, size, weight and target.

    Weights repeat over the sources in code point order, null last. What a
    source cannot take beyond ``cap`` times its size goes to the others by
    weight. That is one water level: every source gets the smaller of weight *
    level and its cap. Each round fixes the sources above the level and raises
    it for the rest; the driver only sees two sums.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_rank(
        totals.withColumn("unnamed", F.col("source").isNull()), [], ["unnamed", "source"]
    ).select("source", "source_size", (F.col("rank") - 1).alias("source_no"))
    weight = F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]),
        (F.col("source_no") % len(weights) + 1).cast("int"),
    )
    sources = shared_table(ranked.withColumn("weight", weight), "mix-sources")
    limit = F.col("source_size") * cap
    level, full_before = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > limit
        found = sources.agg(
            F.sum("source_size"),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
            F.count_if(full),
        ).first()
        if found[3] == full_before or not found[2]:
            break
        full_before = found[3]
        level = (found[0] - found[1]) / found[2]
    target = F.least(F.col("weight") * F.lit(float(level)), limit.cast("double"))
    return sources.withColumn("target", target)


def _slot_batches(seed: int, shard_slots: int):
    """Expand chunks of slot numbers to (source, block, shard, place) rows."""

    def run(frames):
        import numpy as np
        import pandas as pd

        def mixed(x):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

        def permuted(index, size: int, key: int):
            """A Feistel network over the next even number of bits, walked into range."""
            half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
            mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
            out = index.astype(np.uint64)
            outside = np.ones(len(out), bool)
            while outside.any():
                left, right = out[outside] >> shift, out[outside] & mask
                for turn in range(4):
                    salt = np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1342543DE82EF95) % 2**64)
                    left, right = right, left ^ (mixed(right ^ salt) & mask)
                out[outside] = (left << shift) | right
                outside = out >= np.uint64(size)
            return out.astype(np.int64)

        for frame in frames:
            for c in frame.itertuples(index=False):
                slots = np.arange(c.first, c.last, dtype=np.int64)
                epochs = slots // c.n_blocks
                blocks = np.empty_like(slots)
                for epoch in np.unique(epochs):
                    here = epochs == epoch
                    key = seed + (int(c.source_no) << 20) + int(epoch) + 1
                    blocks[here] = permuted(slots[here] % c.n_blocks, int(c.n_blocks), key)
                at = permuted(slots + c.slots_before, int(c.all_slots), seed)
                yield pd.DataFrame(
                    {
                        "source_no": c.source_no,
                        "block": blocks,
                        "shard": at // shard_slots,
                        "place": (at % shard_slots).astype(np.int32),
                    }
                )

    return run


def slot_table(sources: DataFrame, cap: int, block_words: int, shard_slots: int, seed: int):
    """One row per slot of the mix: its source, block, shard and place in the shard.

    A source gets as many slots as come nearest to its target, at most ``cap``
    per block. All slots are dealt to places by one pseudorandom permutation, so
    the source counts of the shards are multinomial draws under the condition
    that they add up to the slots of each source.
    """
    n_blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    wanted = F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long")
    counted = (
        sources.filter("source_size > 0")
        .withColumn("n_blocks", n_blocks)
        .withColumn("slots", F.least(wanted, F.col("n_blocks") * cap))
    )
    # One row per source: a table of counts, not of documents.
    earlier = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn(
        "slots_before", F.coalesce(F.sum("slots").over(earlier), F.lit(0))
    )
    total = counted.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    chunks = (
        numbered.filter("slots > 0")
        .select(
            "source_no",
            "n_blocks",
            "slots_before",
            "slots",
            F.lit(int(total)).alias("all_slots"),
            F.explode(
                F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / F.lit(CHUNK)))
            ).alias("chunk"),
        )
        .withColumn("first", F.col("chunk") * CHUNK)
        .withColumn("last", F.least(F.col("first") + CHUNK, F.col("slots")))
    )
    # A chunk is one row and becomes thousands: by its size alone all would meet in one task.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunks.repartition(tasks, "source_no", "chunk")
    return chunks.mapInPandas(_slot_batches(seed, shard_slots), SLOT_SCHEMA)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    block_words: int = 64,
    shard_slots: int = 4096,
    seed: int = 20,
    carry: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plan a mix: tables of documents, of their block parts, and of slots.

    Documents: ``row``, ``doc_id``, ``size`` (words; null text 0),
    ``source_size``, ``target``, and ``doc``, a struct of the ``carry`` columns.
    Parts: ``row``, ``source_no``, ``block``, ``from_word``, ``n_words`` for each
    block that a document with words lies in. Slots: ``source_no``, ``block``,
    ``shard``, ``place``.

    A null source is one of its own, after all others. Documents are laid out in
    order of id, then of text, so reruns agree, whatever the partitions; rows
    equal in both are alike. Words of very long texts are all counted and lie in
    as many blocks as they fill. Documents without words have no parts, sources
    without words no slots, and an empty table gives empty results.
    """
    text = full_text(f"`{text_col}`")
    sized = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(text).alias("tie"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc")] if carry else []),
    )
    laid = ordered_blocks(sized, ["source"], ["doc_id", "tie", "size"], "mix-layout")
    sources = shared_table(_sources(laid.select("source", "size"), weights, cap), "mix-targets")
    by_source = Window.partitionBy("source")
    pieces = laid.groupBy("source", "_block").agg(F.sum("size").alias("piece_size"))
    earlier = by_source.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("piece_size").over(earlier), F.lit(0)))
    inside = (
        Window.partitionBy("source", "_block")
        .orderBy("_position")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = laid.withColumn("end", F.sum("size").over(inside))
    p, s, d = pieces.alias("p"), sources.alias("s"), running.alias("d")
    placed = (
        d.join(
            p,
            F.col("d.source").eqNullSafe(F.col("p.source"))
            & (F.col("d._block") == F.col("p._block")),
        )
        .join(s, F.col("d.source").eqNullSafe(F.col("s.source")))
        .select(
            F.col("d._position").alias("row"),
            "d.doc_id",
            "d.size",
            "s.source_no",
            "s.source_size",
            "s.target",
            (F.col("before") + F.col("end") - F.col("d.size")).alias("start"),
            *(["d.doc"] if carry else []),
        )
    )
    placed = shared_table(placed, "mix-documents")
    block, start, size = F.col("block"), F.col("start"), F.col("size")
    first = F.greatest(block * block_words - start, F.lit(0))
    last = F.least((block + 1) * block_words - start, size)
    parts = (
        placed.filter("size > 0")
        .select(
            "row",
            "source_no",
            "start",
            "size",
            F.explode(
                F.sequence(
                    F.floor(start / F.lit(block_words)),
                    F.floor((start + size - 1) / F.lit(block_words)),
                )
            ).alias("block"),
        )
        .select("row", "source_no", "block", first.alias("from_word"), (last - first).alias("n_words"))
    )
    return placed, parts, slot_table(sources, cap, block_words, shard_slots, seed)


def taken_parts(parts: DataFrame, slots: DataFrame) -> DataFrame:
    """Parts whose block the mix uses, with ``times``."""
    times = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    # Written once. Both sides grow with the corpus, but Spark sizes files by what they have on disk,
    # where numbers take little, and the parts as if each document had one: no size is to be trusted.
    times = shared_table(times, "mix-times")
    return parts.hint("merge").join(times, ["source_no", "block"])


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` of each row."""
    placed, parts, slots = mix(docs, **options)
    taken = (
        taken_parts(parts, slots)
        .groupBy("row")
        .agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    )
    return placed.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    chars_col: str = "n_chars",
    **options,
) -> DataFrame:
    """The words that the mix takes, as rows with the columns of ``docs``.

    The n-th row of a document has, in their order, the words of those of its
    blocks that are used at least n times; it has its own text unchanged when
    these are all its words, else the words are joined by single spaces. A
    document of which nothing is taken has no row.
    """
    cap = options.get("cap", 3)
    # The plan works on row numbers; the texts are joined to it once, at the end.
    rows = frozen_rows(docs, "mix-rows")
    flat = rows.select(
        F.col(f"doc.`{id_col}`").alias("doc_id"),
        F.col(f"doc.`{source_col}`").alias("source"),
        F.col(f"doc.`{text_col}`").alias("text"),
        "row",
    )
    placed, parts, slots = mix(flat, carry=["row"], **options)
    used = (
        taken_parts(parts, slots)
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words", "times"))).alias("used"))
    )
    planned = placed.select("row", "size", F.col("doc.row").alias("original")).join(used, "row")
    planned = shared_table(planned.select(F.col("original").alias("row"), "size", "used"), "mix-used")
    rounds = F.explode(F.sequence(F.lit(1), F.lit(cap))).alias("turn")
    here = F.filter("used", lambda u: u.times >= F.col("turn"))
    # The arrays are small on disk only: by their files Spark would send them all to every executor.
    repeated = rows.hint("merge").join(planned, "row").select("doc", "size", "used", rounds)
    chosen = repeated.select("doc", "size", here.alias("chosen")).filter(F.size("chosen") > 0)
    tokens = F.regexp_extract_all(full_text(f"doc.`{text_col}`"), F.lit(WORD), F.lit(0))
    some = F.array_join(
        F.transform(
            F.array(tokens),
            lambda w: F.flatten(
                F.transform(
                    "chosen",
                    lambda u: F.slice(w, (u.from_word + 1).cast("int"), u.n_words.cast("int")),
                )
            ),
        )[0],
        " ",
    )
    whole = F.aggregate("chosen", F.lit(0).cast("long"), lambda n, u: n + u.n_words) == F.col("size")
    texts = chosen.select(
        "doc", F.when(whole, F.col(f"doc.`{text_col}`")).otherwise(some).alias("mixed")
    )
    changed = {text_col: F.col("mixed"), chars_col: F.length("mixed").cast("long")}
    return texts.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
