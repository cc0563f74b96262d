"""Packets -> bidirectional flows -> the twenty features.

A flow starts at a packet and takes every later packet of its key up to the
timeout, counted from that first packet; the next packet after that starts the
next flow. The starts of a key are a chain, found in range blocks (``chains``).
Time is cut into buckets as wide as the timeout: each holds at most one start, and a
flow reaches no further than the next one, so packets are labelled by an equi join
on (key, bucket) that spreads a hot key over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowweir.functions.columns import floor_div, safe_divide
from flowweir.functions.ordered import with_rank
from flowweir.operators.chains import chain_starts
from flowweir.operators.packets import flow_keys, packet_measures
from flowweir.schema import ACTIVITY_GAP_US, FEATURES, FLOW, FLOW_TIMEOUT_US, KEY
from flowweir.session import stage_table

BUCKET = [*KEY, "bucket"]


def _bucketed(keyed: DataFrame, timeout_us: int) -> DataFrame:
    return keyed.withColumn("bucket", floor_div("ts_us", timeout_us))


def bucket_labels(keyed: DataFrame, timeout_us: int) -> DataFrame:
    """Per (key, bucket): the flow running on entry and the one starting inside."""
    # Range partitioning samples its input: keep that from being the packets.
    times = stage_table(keyed.select(*KEY, "ts_us").distinct(), "times")
    starts = chain_starts(times, KEY, timeout_us).withColumn(
        "bucket", floor_div("start_us", timeout_us)
    )
    nothing = F.lit(None).cast("long")
    # A flow ends in the bucket it starts in or in the next one.
    inner = starts.select(*BUCKET, F.col("start_us").alias("inner_us"), nothing.alias("entry_us"))
    entry = starts.select(
        *KEY,
        (F.col("bucket") + 1).alias("bucket"),
        nothing.alias("inner_us"),
        F.col("start_us").alias("entry_us"),
    )
    return (
        inner.unionByName(entry)
        .groupBy(*BUCKET)
        .agg(F.max("inner_us").alias("inner_us"), F.max("entry_us").alias("entry_us"))
    )


def assign_flows(packets: DataFrame, timeout_us: int = FLOW_TIMEOUT_US) -> DataFrame:
    """Label every IP packet with its flow key and ``flow_start_us``."""
    keyed = flow_keys(packets)
    labels = bucket_labels(keyed, timeout_us)
    inside = F.col("inner_us").isNotNull() & (F.col("ts_us") >= F.col("inner_us"))
    return (
        _bucketed(keyed, timeout_us)
        .join(labels, BUCKET)
        .withColumn("flow_start_us", F.when(inside, F.col("inner_us")).otherwise(F.col("entry_us")))
        .drop("bucket", "inner_us", "entry_us")
    )


def _flow_slots(assigned: DataFrame, gap_us: int) -> DataFrame:
    """Partial aggregates per (flow, slot), slots as wide as the activity gap.

    Two packets of one slot are never further apart than the gap, so the first
    and last time of each slot are all the activity rule needs; a flow has at
    most timeout / gap + 2 slots, which bounds every later step.
    """
    measured = packet_measures(assigned)
    at_start = F.when(F.col("ts_us") == F.col("flow_start_us"), F.col("packet_id"))
    lo, hi = F.col("from_lo"), ~F.col("from_lo")
    return (
        measured.withColumn("slot", floor_div("ts_us", gap_us))
        .groupBy(*FLOW, "slot")
        .agg(
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.min("packet_id").alias("first_packet_id"),
            F.min_by("from_lo", at_start).alias("forward_is_lo"),
            F.min_by("payload_bytes", at_start).alias("first_payload"),
            F.count_if(lo).alias("lo_packets"),
            F.count_if(hi).alias("hi_packets"),
            F.sum(F.when(lo, F.col("payload_bytes")).otherwise(0)).alias("lo_bytes"),
            F.sum(F.when(hi, F.col("payload_bytes")).otherwise(0)).alias("hi_bytes"),
            F.min(F.when(lo, F.col("ts_us"))).alias("lo_first_us"),
            F.max(F.when(lo, F.col("ts_us"))).alias("lo_last_us"),
            F.min(F.when(hi, F.col("ts_us"))).alias("hi_first_us"),
            F.max(F.when(hi, F.col("ts_us"))).alias("hi_last_us"),
            F.sum("header_bytes").alias("header_bytes"),
            *[F.sum(f).alias(f) for f in ("syn", "ack", "rst", "fin")],
        )
    )


_SUMMED = ["lo_packets", "hi_packets", "lo_bytes", "hi_bytes", "header_bytes", "syn", "ack", "rst", "fin"]
_LEAST = ["first_us", "first_packet_id", "lo_first_us", "hi_first_us"]
_GREATEST = ["last_us", "lo_last_us", "hi_last_us", "forward_is_lo", "first_payload"]


def flow_aggregates(assigned: DataFrame, gap_us: int = ACTIVITY_GAP_US) -> DataFrame:
    """One row per flow: counts, sums, time bounds and activity totals."""
    in_flow = Window.partitionBy(*FLOW).orderBy("slot")
    merge = [
        *[F.sum(c).alias(c) for c in _SUMMED],
        *[F.min(c).alias(c) for c in _LEAST],
        *[F.max(c).alias(c) for c in _GREATEST],
    ]
    gap = F.col("first_us") - F.lag("last_us").over(in_flow)
    slots = _flow_slots(assigned, gap_us).withColumn("idle_us", F.when(gap > gap_us, gap))
    periods = (
        slots.withColumn("period", F.count("idle_us").over(in_flow))
        .groupBy(*FLOW, "period")
        .agg(*merge, F.max("idle_us").alias("idle_us"))
        .withColumn("span_us", F.col("last_us") - F.col("first_us"))
    )
    # The last period is still open and never counts as an active one.
    open_span = F.max_by("span_us", "period")
    return periods.groupBy(*FLOW).agg(
        *merge,
        (F.sum("span_us") - open_span).alias("active_us"),
        (F.count_if(F.col("span_us") > 0) - F.when(open_span > 0, 1).otherwise(0)).alias(
            "active_periods"
        ),
        F.coalesce(F.sum("idle_us"), F.lit(0)).alias("idle_us"),
        F.count("idle_us").alias("idle_periods"),
    )


def features_from_aggregates(flows: DataFrame, keys=()) -> DataFrame:
    """The twenty canonical features from per-flow aggregates, with ``keys`` beside the flow's."""
    forward_lo = F.col("forward_is_lo")

    def side(forward: bool, what: str):
        on_lo, on_hi = F.col(f"lo_{what}"), F.col(f"hi_{what}")
        first, second = (on_lo, on_hi) if forward else (on_hi, on_lo)
        return F.when(forward_lo, first).otherwise(second)

    sided = flows.select(
        "*",
        *[
            side(forward, what).alias(f"{name}_{what}")
            for forward, name in ((True, "fwd"), (False, "bwd"))
            for what in ("packets", "bytes", "first_us", "last_us")
        ],
        (F.col("last_us") - F.col("first_us")).alias("duration_us"),
    )
    packets = F.col("fwd_packets") + F.col("bwd_packets")
    total = F.col("fwd_bytes") + F.col("bwd_bytes")
    seconds = F.col("duration_us") / F.lit(1e6)

    def mean_gap(name):
        n = F.col(f"{name}_packets")
        return F.when(
            n >= 2, (F.col(f"{name}_last_us") - F.col(f"{name}_first_us")) / (n - 1)
        ).otherwise(0.0)

    values = {
        "flow_duration": F.col("duration_us"),
        "total_fwd_packets": F.col("fwd_packets"),
        "total_bwd_packets": F.col("bwd_packets"),
        "fwd_packet_length": safe_divide("fwd_bytes", "fwd_packets"),
        "bwd_packet_length": safe_divide("bwd_bytes", "bwd_packets"),
        "flow_bytes": total,
        "flow_packets": packets,
        "flow_rate": safe_divide(total, seconds),
        "packet_rate": safe_divide(packets, seconds),
        "avg_packet_size": (total + F.col("first_payload")) / packets,
        "syn_count": F.col("syn"),
        "ack_count": F.col("ack"),
        "rst_count": F.col("rst"),
        "fin_count": F.col("fin"),
        "active_time": safe_divide("active_us", "active_periods"),
        "idle_time": safe_divide("idle_us", "idle_periods"),
        "header_length": F.col("header_bytes"),
        "down_up_ratio": F.when(
            F.col("fwd_packets") > 0, F.call_function("div", F.col("bwd_packets"), F.col("fwd_packets"))
        ).otherwise(0),
        "fwd_iat_mean": mean_gap("fwd"),
        "bwd_iat_mean": mean_gap("bwd"),
    }
    return sided.select(
        *keys,
        *FLOW,
        F.col("first_packet_id"),
        F.when(forward_lo, F.col("lo_ip")).otherwise(F.col("hi_ip")).alias("forward_ip"),
        F.when(forward_lo, F.col("lo_port")).otherwise(F.col("hi_port")).alias("forward_port"),
        *[values[f].cast("double").alias(f) for f in FEATURES],
    )


def flow_features(
    packets: DataFrame, timeout_us: int = FLOW_TIMEOUT_US, gap_us: int = ACTIVITY_GAP_US
) -> DataFrame:
    """Packets to one feature row per flow."""
    assigned = assign_flows(packets, timeout_us)
    return features_from_aggregates(flow_aggregates(assigned, gap_us))


def with_flow_seq(flows: DataFrame) -> DataFrame:
    """Number the flows of a capture: keys in first-seen order, then by time."""
    # A key has few flows, one per timeout at most; the rank reads its input twice.
    first = F.min("first_packet_id").over(Window.partitionBy(*KEY))
    seen = stage_table(flows.withColumn("key_first_packet", first), "flow-order")
    return with_rank(
        seen, ["capture_id"], ["key_first_packet", "flow_start_us"], "flow_seq"
    ).drop("key_first_packet")


def eligible_flows(flows: DataFrame) -> DataFrame:
    """Flows with more than one packet, the only ones a model may score."""
    return flows.filter(F.col("total_fwd_packets") + F.col("total_bwd_packets") > 1)


def eligibility_counts(flows: DataFrame) -> DataFrame:
    kept = F.col("total_fwd_packets") + F.col("total_bwd_packets") > 1
    return flows.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("flows"),
        F.count_if(kept).alias("eligible"),
        F.count_if(~kept).alias("excluded"),
    )


def flow_groups(assigned: DataFrame) -> DataFrame:
    """Packets with their flow, its forward endpoint and their place in it.

    Kept as rows rather than one array per flow: a flow has no size bound.
    """
    first = (
        assigned.filter(F.col("ts_us") == F.col("flow_start_us"))
        .groupBy(*FLOW)
        .agg(F.min_by("from_lo", "packet_id").alias("forward_is_lo"))
    )
    return assigned.join(first, FLOW)


def export_rows(flows: DataFrame) -> DataFrame:
    """Flow file rows: zero-based padded id, the features, an empty label."""
    numbered = with_flow_seq(flows)
    return numbered.select(
        "capture_id",
        F.format_string("flow-%05d", F.col("flow_seq") - 1).alias("flow_id"),
        *FEATURES,
        F.lit("").alias("label"),
    )


def export_flow_file(packets: DataFrame, flows: DataFrame, path: str) -> DataFrame:
    """Write the flow file as CSV; one row with packets, seconds and flows.

    The flows are counted in the file that was written.
    """
    spark = packets.sparkSession
    export_rows(flows).write.mode("overwrite").option("header", True).csv(path)
    written = spark.read.option("header", True).csv(path).agg(F.count(F.lit(1)).alias("flows"))
    seen = packets.agg(
        F.count(F.lit(1)).alias("packets"),
        ((F.max("ts_us") - F.min("ts_us")) / F.lit(1e6)).alias("seconds"),
    )
    one = F.lit(1).alias("one")
    return seen.select("*", one).join(written.select("*", one), "one").drop("one")
