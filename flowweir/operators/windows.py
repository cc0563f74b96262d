"""Attribute flows to labelled capture windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowweir.functions.columns import floor_div
from flowweir.functions.ordered import cumulative, with_rank

SLOT_US = 600_000_000


def _bounds(windows: DataFrame) -> DataFrame:
    return windows.select(
        "scenario",
        F.col("label").alias("window_label"),
        F.regexp_replace(F.substring_index("pcap", "/", -1), r"\.pcap(ng)?$", "").alias("_capture"),
        F.round(F.col("start_epoch") * 1e6).cast("long").alias("_from"),
        F.round(F.col("end_epoch") * 1e6).cast("long").alias("_to"),
    )


def label_flows_by_window(
    flows: DataFrame, windows: DataFrame, start="flow_start_us", slot_us: int = SLOT_US
) -> DataFrame:
    """Left interval join: a flow belongs to every window of its capture its start lies in.

    The capture of a window is the file name of its ``pcap`` without the ending.
    Windows are cut into time slots and joined on (capture, slot), so neither
    side has to be small and no pair outside a common slot is ever formed.
    """
    bounds = _bounds(windows)
    slots = bounds.withColumn(
        "_slot",
        F.explode(F.sequence(floor_div("_from", slot_us), floor_div("_to", slot_us))),
    )
    placed = flows.withColumn("_slot", floor_div(start, slot_us))
    inside = (F.col(start) >= F.col("_from")) & (F.col(start) <= F.col("_to"))
    same = (F.col("f.capture_id") == F.col("w._capture")) & (F.col("f._slot") == F.col("w._slot"))
    return (
        placed.alias("f")
        .join(slots.alias("w"), same & inside, "left")
        .drop("_slot", "_from", "_to", "_capture")
    )


def window_pieces(windows: DataFrame) -> DataFrame:
    """The time under the windows of each capture, cut into pieces that do not overlap.

    Columns ``_capture``, ``_at``, ``_next`` (end exclusive), ``windows`` (how many
    cover the piece), ``scenario`` (of the only window, else null), ``window_label``
    (the one they agree on, else null) and ``conflict``. Windows open and close at
    places of a time line; running counts of both, of the attack labels and of the
    window numbers tell what covers the stretch up to the next place. A window without
    a bound or a capture, or that ends before it starts, covers nothing; labels are 0 or 1.
    """
    known = _bounds(windows).filter("_capture is not null and _from <= _to")
    numbered = with_rank(known, [], ["_capture", "_from", "_to", "scenario"], "_number")
    open_at = F.struct(F.col("_from").alias("_at"), F.lit(1).alias("_opens"))
    close_at = F.struct((F.col("_to") + 1).alias("_at"), F.lit(0).alias("_opens"))
    events = numbered.select(
        "_capture", "window_label", "_number", F.inline(F.array(open_at, close_at))
    )
    weights = {"all": F.lit(1), "attack": F.col("window_label"), "number": F.col("_number")}
    totals = {
        f"_{name}_{side}": F.coalesce(F.sum(F.when(F.col("_opens") == flag, w)), F.lit(0))
        for name, w in weights.items()
        for side, flag in (("in", 1), ("out", 0))
    }
    runs = cumulative(events, ["_capture"], "_at", totals)
    inside = {n: F.col(f"_{n}_in_upto") - F.col(f"_{n}_out_upto") for n in weights}
    places = with_rank(
        runs.select("_capture", "_at", *[c.alias(f"_{n}") for n, c in inside.items()]),
        ["_capture"],
        ["_at"],
        "_place",
    )
    following = places.select(
        "_capture", (F.col("_place") - 1).alias("_place"), F.col("_at").alias("_next")
    )
    agreed = F.when(F.col("_attack") == F.col("_all"), 1).when(F.col("_attack") == 0, 0)
    only = numbered.select("_number", "scenario")
    return (
        places.filter("_all > 0")
        .join(following, ["_capture", "_place"])
        .withColumn("_number", F.when(F.col("_all") == 1, F.col("_number")))
        .join(only, "_number", "left")
        .select(
            "_capture",
            "_at",
            "_next",
            F.col("_all").alias("windows"),
            "scenario",
            agreed.cast("int").alias("window_label"),
            agreed.isNull().alias("conflict"),
        )
    )


def label_flows_once(
    flows: DataFrame, windows: DataFrame, start="flow_start_us", slot_us: int = SLOT_US
) -> DataFrame:
    """Each flow once, with the label that all windows over its start agree on.

    Adds the columns of ``window_pieces``; ``windows`` is 0 and ``conflict`` false
    outside every window. Pieces do not overlap, so however many windows cover a
    time, a flow meets one piece and is never multiplied.
    """
    slots = window_pieces(windows).withColumn(
        "_slot",
        F.explode(F.sequence(floor_div("_at", slot_us), floor_div(F.col("_next") - 1, slot_us))),
    )
    placed = flows.withColumn("_slot", floor_div(start, slot_us))
    inside = (F.col(start) >= F.col("w._at")) & (F.col(start) < F.col("w._next"))
    same = (F.col("f.capture_id") == F.col("w._capture")) & (F.col("f._slot") == F.col("w._slot"))
    return (
        placed.alias("f")
        .join(slots.alias("w"), same & inside, "left")
        .withColumn("windows", F.coalesce("windows", F.lit(0)))
        .withColumn("conflict", F.coalesce("conflict", F.lit(False)))
        .drop("_slot", "_at", "_next", "_capture")
    )
