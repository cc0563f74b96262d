"""Connected components of a link table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowweir.llm.text import shared_table


def _star(edges: DataFrame, centre: str, leaf: str) -> DataFrame:
    """Each edge with ``least``, the smallest node among its centre and the centre's leaves."""
    least = edges.groupBy(centre).agg(F.least(F.min(leaf), F.col(centre)).alias("least"))
    return edges.join(least, centre)


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node that has a link.

    Alternates two steps until the links stop changing: every node ties its
    larger neighbours to the smallest one, then its smaller neighbours and
    itself. Each step is an aggregation and a join over the links; their number
    never grows, and the rounds are logarithmic in practice. Each round is
    written to the shared folder; the driver only sees a count and a checksum.
    """
    edges = links.select(
        F.greatest(a, b).alias("high"), F.least(a, b).alias("low")
    ).filter("high != low")
    edges = shared_table(edges.distinct(), "links")
    signature = None
    while True:
        found = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
        ).first()
        if tuple(found) == signature:
            break
        signature = tuple(found)
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        large = (
            _star(both, "high", "low")
            .filter("low > high")
            .select(F.col("low").alias("high"), F.col("least").alias("low"))
            .distinct()
        )
        small = _star(large, "high", "low").select(
            F.explode(
                F.array(
                    F.struct(F.col("high").alias("high"), F.col("least").alias("low")),
                    F.struct(F.col("low").alias("high"), F.col("least").alias("low")),
                )
            ).alias("e")
        )
        edges = shared_table(small.select("e.*").filter("high != low").distinct(), "links")
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    )
