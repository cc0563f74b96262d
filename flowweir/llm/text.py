"""Text rules that several operators share, as Spark expressions.

White space is the six ASCII characters space, tab, line feed, vertical tab, form
feed and carriage return; a word is a longest run of other characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowweir.session import stage_path

GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once.

    An expression named inside the lambda of a higher-order function is worked
    out again for every element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def full_text(name: str) -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` does just that when every character is one byte long, and is much
    faster than ``translate``.
    """
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def shared_write(df: DataFrame, name: str) -> str:
    """Write ``df`` to the shared folder and return its path."""
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back with its schema.

    Reading it needs no job of its own, and a lost executor costs a second read.
    """
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(shared_write(df, name))


def numbered_rows(docs: DataFrame, **derived: Column) -> DataFrame:
    """Columns ``row`` (a number of its own for each row), ``doc`` and ``derived``.

    The given columns go into the struct ``doc``: no name of theirs can clash.
    The numbers hold for one run; write the rows before they are used twice.
    """
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        *[e.alias(n) for n, e in derived.items()],
    )


def frozen_rows(docs: DataFrame, name: str, **derived: Column) -> DataFrame:
    """``numbered_rows``, written and read back: the same numbers in every pass."""
    return shared_table(numbered_rows(docs, **derived), name)
