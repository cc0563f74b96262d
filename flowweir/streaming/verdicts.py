"""A verdict for every live capture window.

Packets become flows of their window, flows are scored, scores are rolled up per window,
and the roll-up is joined to the windows themselves by an outer join, so that a window
without any flow to score is still judged. One plan serves tables and streams; on a
stream its steps are chained stateful operators that share one watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowweir.functions.columns import floor_div
from flowweir.operators.captures import judged, top_flow
from flowweir.operators.flows import eligible_flows, features_from_aggregates
from flowweir.operators.packets import flow_keys, packet_measures
from flowweir.schema import ACTIVITY_GAP_US, FLOW_TIMEOUT_US, KEY
from flowweir.streaming.windows import LATENESS, with_event_time

WINDOW_US = 8_000_000
WINDOW_KEYS = ("window", "capture_id")


def _windowed(packets: DataFrame, width_us: int, lateness: str) -> DataFrame:
    timed = with_event_time(packets)
    if packets.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    return timed.withColumn("window", F.window("ts", f"{width_us} microseconds"))


def window_flows(windowed: DataFrame, width_us: int, gap_us: int = ACTIVITY_GAP_US) -> DataFrame:
    """One flow per window and key, with its features; ``windowed`` has ``window``.

    A window is no longer than the flow timeout, so its packets of one key are one flow.
    Gaps are found from the first and last time of each slot as wide as the gap: state is
    one row of counters per open flow.
    """
    slots = range(-(-width_us // gap_us))
    measured = packet_measures(flow_keys(windowed)).withColumn(
        "slot", floor_div(F.col("ts_us") - F.unix_micros("window.start"), gap_us)
    )
    lo, hi = F.col("from_lo"), ~F.col("from_lo")
    place = F.struct("ts_us", "packet_id")
    inside = lambda k: F.when(F.col("slot") == k, F.col("ts_us"))
    flows = measured.groupBy("window", *KEY).agg(
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.min("packet_id").alias("first_packet_id"),
        F.min_by("from_lo", place).alias("forward_is_lo"),
        F.min_by("payload_bytes", place).alias("first_payload"),
        F.count_if(lo).alias("lo_packets"),
        F.count_if(hi).alias("hi_packets"),
        F.sum(F.when(lo, F.col("payload_bytes")).otherwise(0)).alias("lo_bytes"),
        F.sum(F.when(hi, F.col("payload_bytes")).otherwise(0)).alias("hi_bytes"),
        *[
            end(F.when(side, F.col("ts_us"))).alias(f"{name}_{which}_us")
            for name, side in (("lo", lo), ("hi", hi))
            for which, end in (("first", F.min), ("last", F.max))
        ],
        F.sum("header_bytes").alias("header_bytes"),
        *[F.sum(f).alias(f) for f in ("syn", "ack", "rst", "fin")],
        *[F.min(inside(k)).alias(f"slot{k}_first") for k in slots],
        *[F.max(inside(k)).alias(f"slot{k}_last") for k in slots],
    )
    ends = F.array(
        *[F.struct(F.col(f"slot{k}_first").alias("first"), F.col(f"slot{k}_last").alias("last")) for k in slots]
    )
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.col("first_us").alias("opened"),
        F.col("first_us").alias("last"),
        *[zero.alias(n) for n in ("active_us", "active_periods", "idle_us", "idle_periods")],
    )

    def step(state, slot):
        quiet = slot.first - state.last > gap_us
        span = state.last - state.opened
        return F.struct(
            F.when(quiet, slot.first).otherwise(state.opened).alias("opened"),
            slot.last.alias("last"),
            (state.active_us + F.when(quiet, span).otherwise(zero)).alias("active_us"),
            (state.active_periods + F.when(quiet & (span > 0), 1).otherwise(0)).alias(
                "active_periods"
            ),
            (state.idle_us + F.when(quiet, slot.first - state.last).otherwise(zero)).alias(
                "idle_us"
            ),
            (state.idle_periods + F.when(quiet, 1).otherwise(0)).alias("idle_periods"),
        )

    seen = F.filter(ends, lambda s: s.first.isNotNull())
    counted = flows.withColumn("_activity", F.aggregate(seen, start, step)).select(
        "*",
        F.col("first_us").alias("flow_start_us"),
        *[f"_activity.{n}" for n in ("active_us", "active_periods", "idle_us", "idle_periods")],
    )
    return features_from_aggregates(counted, ["window"])


def window_verdicts(
    packets: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    width_us: int = WINDOW_US,
    gap_us: int = ACTIVITY_GAP_US,
    lateness: str = LATENESS,
) -> DataFrame:
    """Verdict per tumbling window and capture point, as the batch roll-up gives it.

    ``score`` adds ``prediction`` and ``probabilities`` to flows, row by row, as a fitted model
    does. A window whose flows are all too short to score, or that has none, is LOW. On a
    stream a window is judged once the watermark has passed its end; packets behind
    the watermark are dropped.
    """
    if not 0 < width_us <= FLOW_TIMEOUT_US:
        raise ValueError(f"a window is at most as long as the flow timeout, {FLOW_TIMEOUT_US} us")
    windowed = _windowed(packets, width_us, lateness)
    scored = score(eligible_flows(window_flows(windowed, width_us, gap_us)))
    flows = scored.select(
        *WINDOW_KEYS,
        top_flow("first_packet_id").alias("top"),
        F.col("prediction").alias("attack"),
        F.lit(1).alias("flow"),
    )
    seen = windowed.select(*WINDOW_KEYS, "ts_us")
    # One roll-up of flows and packets: a join of two streams keeps four more states.
    both = flows.unionByName(seen, allowMissingColumns=True)
    rolled = both.groupBy(*WINDOW_KEYS).agg(
        F.min("top").alias("top"),
        F.max("attack").alias("any_attack"),
        F.nullif(F.count("flow"), F.lit(0)).alias("n"),
        F.count("ts_us").alias("packet_count"),
        ((F.max("ts_us") - F.min("ts_us")) / F.lit(1e6)).alias("capture_duration"),
    )
    verdicts = judged(rolled, WINDOW_KEYS)
    return verdicts.select(
        F.unix_micros("window.start").alias("window_start_us"),
        F.unix_micros("window.end").alias("window_end_us"),
        *[c for c in verdicts.columns if c != "window"],
    )
