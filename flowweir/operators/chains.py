"""Chains of starts: each start is the first time more than a limit after the one before.

The rule is sequential along a group. Here times are cut into range blocks, so that a
group of any size spreads over many tasks. Inside a block every time learns where the
chain through it ends; a group that lies in one block is done with that. Only the first
and last group of a block can reach over its border: the ends of their chains point to
the time that comes after them in a later block, and those on the chain are found by
pointer doubling, in the logarithm of the number of blocks. All groups go this one way.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowweir.functions.ordered import ordered_blocks
from flowweir.session import stage_table

_BLOCK = "_block"


def _groups(table, keys) -> np.ndarray:
    """Where a new group begins among sorted rows."""
    import pyarrow.compute as pc

    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for key in keys:
        column = table[key].combine_chunks()
        other = pc.not_equal(column.slice(1), column.slice(0, n - 1))
        new[1:] |= other.to_numpy(zero_copy_only=False)
    return new


def _next_times(times: np.ndarray, new: np.ndarray, limit: int) -> np.ndarray:
    """Place of the first time of the group more than ``limit`` later; its own place if none."""
    n = len(times)
    firsts = np.flatnonzero(new)
    ends = np.append(firsts[1:], n)
    span = int((times[ends - 1] - times[firsts]).max()) + limit + 1
    own = np.arange(n)
    result = np.empty(n, np.int64)
    # Groups are laid end to end on one axis, as many as a long can hold.
    step = max(1, (1 << 62) // span)
    for low in range(0, len(firsts), step):
        first, end = firsts[low : low + step], ends[low : low + step]
        a, b = first[0], end[-1]
        sizes = end - first
        axis = times[a:b] - np.repeat(times[first], sizes) + np.repeat(np.arange(len(first)), sizes) * span
        found = np.searchsorted(axis, axis + limit, side="right") + a
        last = np.repeat(end, sizes)
        result[a:b] = np.where(found < last, found, own[a:b])
    return result


def _marked(next_place: np.ndarray, at: np.ndarray) -> np.ndarray:
    """All places on the chains that begin at the given places."""
    mark = np.zeros(len(next_place), bool)
    while len(at):
        mark[at] = True
        ahead = next_place[at]
        at = ahead[ahead != at]
    return mark


def _chain_batches(keys, limit: int):
    """Function over the sorted times of one block: starts from the first time of each group,
    and all times of its first and last group, with the ends of their chains."""

    def run(batches):
        import pyarrow as pa

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        # One range block at a time, of a partition's size.
        table = pa.Table.from_batches(batches)
        times = table["ts_us"].to_numpy()
        new = _groups(table, keys)
        next_place = _next_times(times, new, limit)
        end = next_place
        while not np.array_equal(end, end[end]):
            end = end[end]
        firsts = np.flatnonzero(new)
        starts = _marked(next_place, firsts)
        border = np.arange(len(times)) >= firsts[-1]
        border[: firsts[1] if len(firsts) > 1 else len(times)] = True
        table = table.append_column("end_us", pa.array(times[end]))
        table = table.append_column("starts", pa.array(starts))
        table = table.append_column("border", pa.array(border))
        yield from table.filter(pa.array(starts | border)).to_batches()

    return run


def _continued_batches(keys, limit: int):
    """Function over sorted (keys, block, ts_us, entry_us): the starts from each entry."""

    def run(batches):
        import pyarrow as pa

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        times = table["ts_us"].to_numpy()
        next_place = _next_times(times, _groups(table, [*keys, _BLOCK]), limit)
        entries = np.flatnonzero(times == table["entry_us"].to_numpy())
        mark = pa.array(_marked(next_place, entries))
        yield from table.select([*keys, "ts_us"]).filter(mark).to_batches()

    return run


def next_times(sources: DataFrame, targets: DataFrame, keys, name: str) -> DataFrame:
    """For each source (keys, ``node_us``, ``at_us``) the least target ``ts_us`` behind ``at_us``.

    Sources and targets are walked together in range blocks from late to early; each
    block takes over the last target of the blocks before it, so a hot group is no
    single task's work. Sources without such a target are left out.
    """
    nothing = F.lit(None).cast("long")
    rows = sources.select(
        *keys, "at_us", F.lit(0).alias("is_target"), "node_us", nothing.alias("target_us")
    ).unionByName(
        targets.select(
            *keys,
            F.col("ts_us").alias("at_us"),
            F.lit(1).alias("is_target"),
            nothing.alias("node_us"),
            F.col("ts_us").alias("target_us"),
        )
    )
    # A target at exactly ``at_us`` comes after its source and is not seen.
    walk = ordered_blocks(rows, keys, [F.desc("at_us"), F.asc("is_target")], name)
    inside = (
        Window.partitionBy(*keys, _BLOCK)
        .orderBy("_position")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = F.when(F.col("target_us").isNotNull(), F.col("_position"))
    ends = walk.groupBy(*keys, _BLOCK).agg(F.max_by("target_us", seen).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys, _BLOCK, F.last("_last", ignorenulls=True).over(earlier).alias("_carried")
    )
    near = F.coalesce(F.last("target_us", ignorenulls=True).over(inside), F.col("_carried"))
    return (
        walk.join(carried, [*keys, _BLOCK])
        .withColumn("next_us", near)
        .filter((F.col("is_target") == 0) & F.col("next_us").isNotNull())
        .select(*keys, "node_us", "next_us")
    )


def chain_starts(times: DataFrame, keys, limit: int) -> DataFrame:
    """Starts (keys, ``start_us``) of each group's chain from its first time on.

    ``times`` has distinct (keys, ``ts_us``); keys are not null.
    """
    keys = list(keys)
    order = [*keys, "ts_us"]
    sorted_times = (
        times.select(*order)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(_BLOCK, F.spark_partition_id())
    )
    schema = T.StructType(
        [
            *sorted_times.schema.fields,
            T.StructField("end_us", T.LongType()),
            T.StructField("starts", T.BooleanType()),
            T.StructField("border", T.BooleanType()),
        ]
    )
    rows = stage_table(sorted_times.mapInArrow(_chain_batches(keys, limit), schema), "chains")
    borders = rows.filter("border")
    several = stage_table(
        borders.groupBy(*keys)
        .agg(
            F.min(_BLOCK).alias("first_block"),
            F.count_distinct(_BLOCK).alias("blocks"),
            F.min("ts_us").alias("root_us"),
        )
        .filter(F.col("blocks") > 1),
        "several-blocks",
    )
    longest = several.agg(F.max("blocks")).first()[0]
    if not longest:
        return rows.filter("starts").select(*keys, F.col("ts_us").alias("start_us"))
    # A hop leads to a later block, so there are fewer hops than blocks.
    rounds = int(longest - 1).bit_length()
    spread = borders.join(several, keys)
    nodes = spread.select(*keys, F.col("end_us").alias("node_us")).distinct()
    ahead = next_times(
        nodes.withColumn("at_us", F.col("node_us") + limit), spread, keys, "ends"
    )
    landed = spread.select(*keys, F.col("ts_us").alias("next_us"), _BLOCK, "end_us")
    edges = stage_table(ahead.join(landed, [*keys, "next_us"]), "edges")
    jumps = edges.select(*keys, "node_us", F.col("end_us").alias("to_us"))
    reached = spread.filter(F.col("ts_us") == F.col("root_us")).select(
        *keys, F.col("end_us").alias("node_us")
    )
    for step in range(rounds):
        further = reached.join(jumps, [*keys, "node_us"]).select(
            *keys, F.col("to_us").alias("node_us")
        )
        reached = reached.unionByName(further).distinct()
        if step == rounds - 1:
            break
        reached = stage_table(reached, f"reached{step}")
        hop = jumps.select(*keys, F.col("node_us").alias("to_us"), F.col("to_us").alias("far_us"))
        jumps = stage_table(
            jumps.join(hop, [*keys, "to_us"]).select(
                *keys, "node_us", F.col("far_us").alias("to_us")
            ),
            f"jumps{step}",
        )
    entries = edges.join(reached, [*keys, "node_us"], "left_semi").select(
        *keys, _BLOCK, F.col("next_us").alias("entry_us")
    )
    dealt = (
        borders.select(*order, _BLOCK)
        .join(entries, [*keys, _BLOCK])
        .repartition(*keys, _BLOCK)
        .sortWithinPartitions(*keys, _BLOCK, "ts_us")
    )
    kept = T.StructType([f for f in rows.schema.fields if f.name in order])
    continued = dealt.select(*kept.names, _BLOCK, "entry_us").mapInArrow(
        _continued_batches(keys, limit), T.StructType([*[rows.schema[k] for k in keys], rows.schema["ts_us"]])
    )
    # In a group's first block the chain starts with the block; later ones have their entry.
    own = rows.filter("starts").join(
        several.select(*keys, F.col("first_block").alias("_only")), keys, "left"
    )
    own = own.filter(F.col("_only").isNull() | (F.col("_only") == F.col(_BLOCK)))
    return own.select(*keys, "ts_us").unionByName(continued).withColumnRenamed("ts_us", "start_us")
