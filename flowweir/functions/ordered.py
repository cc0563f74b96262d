"""Ranks, running totals and exact quantiles that never put one group in one task.

A window over a whole group sends that group to a single task. Here rows are
range-partitioned on (group, order) instead, so a hot group is cut into many
blocks; each block is numbered on its own and shifted by the totals of the
blocks before it. The only table that is gathered per group is the one of block
totals, with at most one row per (block, group) pair.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowweir.session import stage_table

_POSITION = "_position"
_BLOCK = "_block"
_BUCKET = "_bucket"


def _join_null_safe(left: DataFrame, right: DataFrame, names, how="inner") -> DataFrame:
    renamed = right.select(
        *[F.col(n).alias(f"_r_{n}") for n in names],
        *[F.col(c) for c in right.columns if c not in names],
    )
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).eqNullSafe(F.col(f"_r_{name}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{n}" for n in names])


def ordered_blocks(df: DataFrame, by, order, name: str) -> DataFrame:
    """Range-partition by (by, order) and number the rows of each partition.

    The result is written out before use: a block number is a property of one
    physical run, and every later pass has to see the same one.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in [*by, *order]]
    rows = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(_POSITION, F.monotonically_increasing_id())
        .withColumn(_BLOCK, F.shiftright(_POSITION, 33).cast("int"))
    )
    return stage_table(rows, name)


def with_rank(df: DataFrame, by, order, rank: str = "rank") -> DataFrame:
    """1-based row number inside each ``by`` group, in ``order``.

    ``order`` must be total (end it with a unique column) for a stable result.
    """
    by = list(by)
    rows = ordered_blocks(df, by, list(order), "rank")
    blocks = rows.groupBy(*by, _BLOCK).agg(
        F.min(_POSITION).alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = Window.partitionBy(*by).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    return (
        _join_null_safe(rows, offsets, [*by, _BLOCK])
        .withColumn(rank, F.col(_POSITION) - F.col("_first") + F.col("_before") + 1)
        .drop(_POSITION, _BLOCK, "_first", "_rows", "_before")
    )


def _running_sums(names):
    """Function over the Arrow batches of one partition that adds running sums.

    The sums run over the whole partition; the caller takes off what came before
    the group.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        before = dict.fromkeys(names, 0)
        for batch in batches:
            columns = list(batch.columns)
            for name in names:
                own = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
                sums = np.cumsum(own) + before[name]
                if len(sums):
                    before[name] = sums[-1]
                columns.append(pa.array(sums))
            yield pa.RecordBatch.from_arrays(
                columns, names=[*batch.schema.names, *[f"_{n}_run" for n in names]]
            )

    return run


def cumulative(df: DataFrame, by, value: str, totals: dict[str, Column]) -> DataFrame:
    """Running totals over the distinct values of each group.

    Returns one row per (by, value) with, for each named total ``t`` (a count):
    ``t`` (at this value), ``t_upto`` (this value and all smaller ones) and
    ``t_all``. Equal values are merged on the map side before anything is moved,
    and the sums are taken inside the range partitions before they are written.
    """
    by, names = list(by), list(totals)
    merged = df.groupBy(*by, value).agg(*[e.cast("long").alias(n) for n, e in totals.items()])
    keys = [*by, value]
    sorted_rows = (
        merged.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(_BLOCK, F.spark_partition_id())
    )
    schema = T.StructType(
        [*sorted_rows.schema.fields, *[T.StructField(f"_{n}_run", T.LongType()) for n in names]]
    )
    rows = stage_table(sorted_rows.mapInArrow(_running_sums(names), schema), "cumulative")
    blocks = rows.groupBy(*by, _BLOCK).agg(
        *[F.sum(n).alias(f"_{n}_block") for n in names],
        # Counts are not negative, so the least is that of the group's first row.
        *[F.min(F.col(f"_{n}_run") - F.col(n)).alias(f"_{n}_base") for n in names],
    )
    group = Window.partitionBy(*by)
    earlier = group.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *by,
        _BLOCK,
        *[
            (F.coalesce(F.sum(f"_{n}_block").over(earlier), F.lit(0)) - F.col(f"_{n}_base")).alias(
                f"_{n}_shift"
            )
            for n in names
        ],
        *[F.sum(f"_{n}_block").over(group).alias(f"{n}_all") for n in names],
    )
    joined = _join_null_safe(rows, offsets, [*by, _BLOCK])
    return joined.select(
        *by,
        value,
        *names,
        *[(F.col(f"_{n}_run") + F.col(f"_{n}_shift")).alias(f"{n}_upto") for n in names],
        *[f"{n}_all" for n in names],
    )


def _value_bucket(value: str) -> Column:
    """A whole number that never falls as the value grows: 512 buckets per power of two."""
    x = F.col(value).cast("double")
    size = F.floor(F.log2(F.abs(x)) * 512) + 1_000_000
    endless = F.lit(float("inf"))
    return (
        F.when(F.isnan(x), 1 << 40)
        .when(x == 0, 0)
        .when(x == endless, 1 << 39)
        .when(x == -endless, -(1 << 39))
        .when(x > 0, size)
        .otherwise(-size)
        .cast("long")
    )


def _neighbours(probs):
    """The two ranks (from 0) beside each quantile, over ``n_all`` values."""
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("n_all") - 1)
        yield name, position, F.floor(position), F.ceil(position)


def runs_near(df: DataFrame, by, value: str, probs) -> DataFrame:
    """The rows of ``cumulative`` (count ``n``) that hold the ranks beside the quantiles.

    Counts per bucket of the value, merged on the map side, tell which buckets hold those
    ranks; only values in these are moved and sorted. ``n_upto`` and ``n_all`` are those of
    all values. A group that lies in one bucket is sorted whole.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(
        *by, value, _value_bucket(value).alias(_BUCKET)
    )
    counts = stage_table(
        rows.groupBy(*by, _BUCKET).agg(F.count(F.lit(1)).alias("_n")), "buckets"
    )
    # Buckets of a group are bounded by the range of doubles, whatever its size.
    whole = Window.partitionBy(*by)
    laid = counts.withColumn("_upto", F.sum("_n").over(whole.orderBy(_BUCKET))).withColumn(
        "n_all", F.sum("_n").over(whole)
    )
    start, hit = F.col("_upto") - F.col("_n"), F.lit(False)
    for _, _, low, high in _neighbours(probs):
        for rank in (low, high):
            hit = hit | ((start <= rank) & (rank < F.col("_upto")))
    kept = F.sum("_n").over(whole.orderBy(_BUCKET)) - F.col("_n")
    wanted = stage_table(
        laid.filter(hit).select(*by, _BUCKET, "n_all", (start - kept).alias("_skipped")),
        "wanted-buckets",
    )
    near = _join_null_safe(rows, wanted.select(*by, _BUCKET), [*by, _BUCKET], "left_semi")
    runs = cumulative(near, by, value, {"n": F.count(F.lit(1))}).drop("n_all")
    placed = _join_null_safe(
        runs.withColumn(_BUCKET, _value_bucket(value)), wanted, [*by, _BUCKET]
    )
    return placed.select(
        *by, value, "n", (F.col("n_upto") + F.col("_skipped")).alias("n_upto"), "n_all"
    )


def order_bucket(df: DataFrame, order: str) -> Column:
    """Something that never falls as ``order`` grows, with a small part of the rows each."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.NumericType):
        return _value_bucket(order)
    if not isinstance(kind, T.StringType):
        return F.lit(0)
    ends = df.agg(F.min(order), F.max(order)).first()
    # Four characters behind those that all rows begin with.
    return F.substring(order, len(commonprefix([end or "" for end in ends])) + 1, 4)


def rank_cuts(
    df: DataFrame, by, value: str, order: str, bucket: Column, probs: dict[str, float]
) -> DataFrame:
    """The row at rank 1 + floor((n-1)p) of each group, in the order of (value, order).

    One row per (by, ``cut``), ``cut`` a name of ``probs``: ``value`` and ``last``, the
    order of that row, or null if all rows of that value are up to it. Only rows of the
    value at a cut are compared by ``order``, and of these only the ones in the bucket
    of the cut are moved and sorted. ``order`` is unique in a group, ``bucket`` that of
    ``order_bucket``. ``df`` is read four times.
    """
    by = list(by)
    runs = runs_near(df, by, value, probs)
    start = F.col("n_upto") - F.col("n")
    hits = F.array(
        *[
            F.struct(F.lit(name).alias("cut"), (low - start + 1).cast("long").alias("take"))
            for name, _, low, _ in _neighbours(probs)
        ]
    )
    own = F.filter(hits, lambda h: (h["take"] >= 1) & (h["take"] <= F.col("n")))
    cuts = stage_table(runs.select(*by, value, "n", F.inline(own)), "cuts")
    split = cuts.filter(F.col("take") < F.col("n"))
    group = [*by, value]
    # A few rows per group, as many as there are probabilities.
    tied = _join_null_safe(
        df.select(*group, order, bucket.alias(_BUCKET)),
        F.broadcast(split.select(*group).distinct()),
        group,
        "left_semi",
    )
    counts = stage_table(tied.groupBy(*group, _BUCKET).agg(F.count(F.lit(1)).alias("_n")), "ties")
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy(_BUCKET))
    laid = counts.withColumn("_before", upto - F.col("_n"))
    place = F.col("take") - F.col("_before")
    wanted = stage_table(
        _join_null_safe(laid, split, group)
        .filter((place >= 1) & (place <= F.col("_n")))
        .select(*group, _BUCKET, "cut", place.alias("_place")),
        "wanted-ties",
    )
    inside = [*group, _BUCKET]
    near = _join_null_safe(
        tied, F.broadcast(wanted.select(*inside).distinct()), inside, "left_semi"
    )
    ranked = with_rank(near, inside, [order], "_place")
    found = _join_null_safe(ranked, wanted, [*inside, "_place"]).select(
        *by, "cut", F.col(order).alias("last")
    )
    return _join_null_safe(cuts.select(*group, "cut"), found, [*by, "cut"], "left")


def exact_quantiles(df: DataFrame, by, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    The built-in exact percentile keeps every distinct value of a group in one
    buffer; this picks the two neighbouring ranks from running counts instead, of the
    values near them only. Null values are ignored. Adds ``n``, the number of values.
    ``df`` is read twice.
    """
    return quantiles_of_runs(runs_near(df, by, value, probs), by, value, probs)


def quantiles_of_runs(runs: DataFrame, by, value: str, probs: dict[str, float]):
    """Quantiles from the running counts ``n`` of ``cumulative``."""
    by = list(by)
    upto, start = F.col("n_upto"), F.col("n_upto") - F.col("n")
    picks, outputs = [], []
    for name, position, below, above in _neighbours(probs):
        for side, rank in (("lo", below), ("hi", above)):
            hit = (start <= rank) & (rank < F.col("n_upto"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outputs.append((low + (position - F.floor(position)) * (high - low)).alias(name))
    picked = runs.groupBy(*by).agg(F.max("n_all").alias("n_all"), *picks)
    return picked.select(*by, F.col("n_all").alias("n"), *outputs)


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` smallest rows by ``order``, nulls first.

    Each partition sorts its order column alone and passes on its first ``n``
    values. Their ``n``-th one overall is the bound, a filter on the whole rows:
    only rows up to it are moved, and no full sort is made. Among rows equal to
    the last one any may stay.
    """
    place = F.monotonically_increasing_id()
    own = (
        df.select(order)
        .sortWithinPartitions(order)
        .withColumn(_POSITION, place.bitwiseAND((1 << 33) - 1))
        .filter(F.col(_POSITION) < n)
    )
    last = with_rank(own.select(order), [], [order], "_rank").filter(F.col("_rank") == n)
    head, bound = df, last.select(order).head()
    if bound is not None:
        head = df.filter(F.col(order).isNull() | (F.col(order) <= F.lit(bound[0])))
    return with_rank(head, [], [order], "_rank").filter(F.col("_rank") <= n).drop("_rank")
