"""Raw flow records -> clean labelled table, and generic table cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowweir.functions.columns import (
    finite_or_null,
    is_finite,
    label_not_benign,
    number_or_null,
    trimmed,
)
from flowweir.functions.ordered import exact_quantiles, first_rows, with_rank
from flowweir.schema import (
    DIRECT_COLUMNS,
    FEATURES,
    NON_NEGATIVE_PREPARED,
    SUMMED_COLUMNS,
    require_columns,
)
from flowweir.session import stage_table


def canonical_text(raw: DataFrame, *carry) -> DataFrame:
    """Raw columns under canonical names, still unchecked numbers.

    A generator makes the columns: filters on them stay above it, so that each
    text is parsed once and not again inside the filter.
    """
    number = lambda c: number_or_null(F.col(f"`{c}`"))
    columns = {f: number(c) for f, c in DIRECT_COLUMNS.items()}
    for feature, (first, second) in SUMMED_COLUMNS.items():
        columns[feature] = number(first) + number(second)
    numbers = F.struct(*[columns[f].alias(f) for f in FEATURES])
    return raw.select(*carry, F.inline(F.array(numbers)))


def clean_flow_records(raw: DataFrame, *carry) -> DataFrame:
    """Typed features; rows with a missing, infinite or impossible value go.

    Narrow: one projection and one filter over the scan.
    """
    infinity = F.lit(float("inf"))
    tests = [
        (F.col(f) >= 0) & (F.col(f) < infinity) if f in NON_NEGATIVE_PREPARED else is_finite(f)
        for f in FEATURES
    ]
    return canonical_text(raw, *carry, "Label").filter(reduce(lambda a, b: a & b, tests))


def stored_types(df: DataFrame, *carry, label="label") -> DataFrame:
    """float32 features and an int8 label."""
    return df.select(
        *carry, *[F.col(f).cast("float").alias(f) for f in FEATURES], F.col(label).cast("tinyint")
    )


def prepare_canonical(raw: DataFrame) -> DataFrame:
    """Clean labelled table: rows are unique before the narrowing to float32."""
    clean = clean_flow_records(raw).select(*FEATURES, label_not_benign("Label").alias("label"))
    return stored_types(clean.dropDuplicates())


def provenance_dedup(raw: DataFrame, order: str = "row_key") -> DataFrame:
    """First row of each (features, label) with the source it came from.

    "First" is the least (source_file, ``order``). Rows move once, by a digest of what is
    compared, and are sorted once, behind the move, in the shares it makes. Merging on
    the map side would sort whole input splits instead and spill them: the minimum has texts,
    and rows with few copies do not shrink. Copies of one row meet in one task, which
    keeps the first of them as it reads.
    """
    # Both zeros compare as equal, so they are made one before the digest.
    clean = clean_flow_records(raw, "source_file", order).select(
        "source_file",
        order,
        *[(F.col(f) + F.lit(0.0)).alias(f) for f in FEATURES],
        label_not_benign("Label").alias("binary_label"),
        trimmed("Label").alias("source_label"),
    )
    compared = [*FEATURES, "binary_label"]
    routed = clean.withColumn("_route", F.xxhash64(*compared)).repartition("_route")
    copies = Window.partitionBy("_route", *compared).orderBy("source_file", order, "source_label")
    first = routed.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") == 1)
    return first.select(
        *[F.col(f).cast("float").alias(f) for f in FEATURES],
        "binary_label",
        "source_label",
        "source_file",
        order,
    )


def canonical_scan(table: DataFrame, target: str = "label") -> DataFrame:
    """Contract check, projection to the 21 columns, incomplete rows dropped."""
    require_columns(table, [*FEATURES, target])
    complete = reduce(lambda a, b: a & b, [is_finite(f) for f in FEATURES])
    return table.select(*FEATURES, target).filter(complete & F.col(target).isNotNull())


def _numeric_columns(df: DataFrame):
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN becomes null, so that equal rows compare equal."""
    fractional = {f.name for f in df.schema if isinstance(f.dataType, T.FractionalType)}
    nan = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    decimals = {f.name for f in df.schema if isinstance(f.dataType, T.DecimalType)}
    return df.select(*[nan(c) if c in fractional - decimals else c for c in df.columns])


def clean_impute(df: DataFrame) -> DataFrame:
    """Unique rows; infinities are missing; numbers get the median, the rest the mode.

    Fill values come from running counts (numbers) and value counts (text), both
    merged before the shuffle. The driver reads one fill value per column.
    """
    numeric = _numeric_columns(df)
    other = [c for c in df.columns if c not in numeric]
    # Three uses: medians, modes and the result.
    unique = stage_table(missing_as_null(df).dropDuplicates(), "unique")
    kinds = dict(unique.dtypes)
    rows = unique.select(
        *[
            finite_or_null(c).alias(c) if kinds[c] in ("double", "float") else F.col(c)
            for c in df.columns
        ]
    )
    fills = {}
    if numeric:
        long = rows.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
            [], numeric, "column", "value"
        )
        medians = exact_quantiles(long, ["column"], "value", {"median": 0.5})
        fills.update({r["column"]: F.lit(r["median"]) for r in medians.collect()})
    if other:
        text = rows.select(*[F.col(c).cast("string").alias(c) for c in other]).unpivot(
            [], other, "column", "value"
        )
        counts = text.filter(F.col("value").isNotNull()).groupBy("column", "value").count()
        # Most frequent first, the lowest value on a tie.
        modes = counts.groupBy("column").agg(
            F.min(F.struct((-F.col("count")).alias("rank"), "value")).alias("top")
        )
        fills.update(dict.fromkeys(other, F.lit("Unknown")))
        fills.update({r["column"]: F.lit(r["top"]["value"]) for r in modes.collect()})

    def filled(c):
        if c not in fills:
            return F.col(c)
        if c in numeric and kinds[c] not in ("double", "float"):
            return F.coalesce(F.col(c).cast("double"), fills[c]).alias(c)
        return F.coalesce(F.col(c), fills[c].cast(kinds[c])).alias(c)

    return rows.select(*[filled(c) for c in df.columns])


def _encoded_columns(df: DataFrame, label: str | None) -> list[str]:
    kinds = (T.StringType, T.BooleanType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name != label]


def one_hot(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """Columns as 0/1 columns for the named categories, the first one left out.

    Categories become columns, so the caller names them; a null or any other
    value has zeros only. ``category_positions`` takes any number of categories.
    """
    encoded = [
        F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c, values in categories.items()
        for v in sorted(values)[1:]
    ]
    return df.select(*[c for c in df.columns if c not in categories], *encoded)


def category_positions(df: DataFrame, label: str | None = None) -> DataFrame:
    """The one-hot encoding as positions of its ones, for any number of categories.

    Text and boolean columns give way to ``positions``, the sorted places (from
    0) of the ones in a vector over all categories of all columns, each
    column's first category left out. Categories are numbered by rank over the
    distinct values and joined back: none goes through the driver.
    """
    wanted = _encoded_columns(df, label)
    if not wanted:
        return df.withColumn("positions", F.array().cast("array<long>"))
    text = [F.col(c).cast("string").alias(c) for c in wanted]
    rows = stage_table(
        df.select("*", F.monotonically_increasing_id().alias("_row"), F.struct(*text).alias("_text")),
        "encoded-rows",
    )
    long = rows.select("_row", *[F.col(f"_text.{c}").alias(c) for c in wanted]).unpivot(
        ["_row"], wanted, "column", "value"
    ).filter(F.col("value").isNotNull())
    ranked = with_rank(long.select("column", "value").distinct(), [], ["column", "value"])
    by_column = ranked.groupBy("column").agg(F.min("rank").alias("first"))
    order = Window.orderBy("column")
    # One row per encoded column.
    columns = by_column.withColumn("skipped", F.row_number().over(order))
    numbered = (
        ranked.join(F.broadcast(columns), "column")
        .filter(F.col("rank") > F.col("first"))
        .select("column", "value", (F.col("rank") - F.col("skipped") - 1).alias("position"))
    )
    found = (
        long.join(numbered, ["column", "value"])
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list("position")).alias("positions"))
    )
    kept = [c for c in df.columns if c not in wanted]
    return rows.join(found, "_row", "left").select(
        *kept, F.coalesce("positions", F.array().cast("array<long>")).alias("positions")
    )


def split_features(df: DataFrame, label: str):
    """(features, label) frames."""
    if label not in df.columns:
        raise ValueError(f"label column {label!r} not found")
    return df.drop(label), df.select(label)


def prepared_features(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """Clean, then encode; ``split_features`` separates the label afterwards."""
    return one_hot(clean_impute(df), categories)


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row per column: type and number of missing values, in one pass."""
    marked = missing_as_null(df)
    counts = marked.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return counts.unpivot(["_rows"], df.columns, "column_name", "missing").select(
        "column_name", kinds[F.col("column_name")].alias("dtype"), "missing", F.col("_rows").alias("rows")
    )


def dataset_head(df: DataFrame, order: str, rows: int = 5) -> DataFrame:
    """First rows of a dataset, as a profile shows them."""
    return first_rows(df, order, rows)


def reproduction_diff(regenerated: DataFrame, frozen: DataFrame, key: str) -> DataFrame:
    """Keyed comparison of two builds of the labelled table, one summary row."""
    # Features move as one array: floats take four bytes each there, eight as columns.
    mine = regenerated.select(key, F.array(*FEATURES).alias("_l"), F.col("label").alias("_l_label"))
    theirs = frozen.select(key, F.array(*FEATURES).alias("_r"), F.col("label").alias("_r_label"))
    both = mine.withColumn("_in_l", F.lit(True)).join(
        theirs.withColumn("_in_r", F.lit(True)), key, "full_outer"
    )
    matched = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
    cells = sum(
        F.when(F.get("_l", F.lit(i)).eqNullSafe(F.get("_r", F.lit(i))), 0).otherwise(1)
        for i in range(len(FEATURES))
    )
    label_differs = ~F.col("_l_label").eqNullSafe(F.col("_r_label"))
    count = lambda c: F.count_if(c)
    totals = both.select("*", F.when(matched, cells).otherwise(0).alias("_cells")).agg(
        count(F.col("_in_l").isNotNull()).alias("regenerated_rows"),
        count(F.col("_in_r").isNotNull()).alias("frozen_rows"),
        count(F.col("_in_r").isNull()).alias("only_regenerated"),
        count(F.col("_in_l").isNull()).alias("only_frozen"),
        F.coalesce(F.sum("_cells"), F.lit(0)).alias("differing_cells"),
        count(F.col("_cells") > 0).alias("differing_rows"),
        count(matched & label_differs).alias("differing_labels"),
    )
    same = reduce(
        lambda a, b: a & b,
        [
            F.col(c) == 0
            for c in (
                "only_regenerated",
                "only_frozen",
                "differing_cells",
                "differing_labels",
            )
        ],
    )
    return totals.withColumn("status", F.when(same, "PASS").otherwise("FAIL"))


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Order-free check: number of rows on one side only, repeats counted.

    Rows are compared by two digests of 64 bits with different seeds, so that no column is
    moved. Columns are taken in the order and types of ``left``.
    """
    kinds = left.dtypes
    columns = [F.col(f"`{c}`").cast(t) for c, t in kinds]
    # A digest passes over nulls: where they are counts as well.
    marked = [*columns, F.array(*[c.isNull() for c in columns])]
    digests = [F.xxhash64(*marked).alias("_h1"), F.xxhash64(F.lit(1), *marked).alias("_h2")]
    sides = left.select(*digests, F.lit(1).alias("_n")).unionByName(
        right.select(*digests, F.lit(-1).alias("_n"))
    )
    balance = sides.groupBy("_h1", "_h2").agg(F.sum("_n").alias("_n"))
    return balance.agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 0, F.col("_n"))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.when(F.col("_n") < 0, -F.col("_n"))), F.lit(0)).alias("only_right"),
    )


def benign_sample(table: DataFrame, order: str, rows: int = 40_000) -> DataFrame:
    """First benign rows in ``order``; the cap applies before incomplete rows go."""
    benign = F.lower(trimmed("label")).isin("benign", "normal", "0")
    head = first_rows(table.filter(benign), order, rows)
    typed = head.select(order, *[number_or_null(F.col(f)).alias(f) for f in FEATURES])
    return missing_as_null(typed).na.drop(subset=FEATURES)


