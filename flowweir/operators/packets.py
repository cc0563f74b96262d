"""Packet-level projections: flow key, measures, detail listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowweir.functions.ordered import with_rank
from flowweir.schema import FLOW

TCP, UDP = 6, 17


def _is_tcp() -> Column:
    """Has a TCP header; a later IP fragment carries the number but no ports."""
    return (F.col("ip_proto") == TCP) & F.col("src_port").isNotNull()


def _is_udp() -> Column:
    return (F.col("ip_proto") == UDP) & F.col("src_port").isNotNull()


def _header_words(c: str) -> Column:
    """Header length field in 32-bit words, 5 when absent or zero."""
    return F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(5))


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def flow_keys(packets: DataFrame) -> DataFrame:
    """Add the direction-free flow key; frames without an IP layer are dropped.

    ``from_lo`` says whether the packet was sent by the smaller endpoint. It
    stands in for the endpoint comparison later on, so the direction of a packet
    stays a boolean however the flow turns out to be oriented. Key columns are
    never null (a missing value reads as empty), so that no later join on the
    key loses a packet or re-evaluates the key to test it for null.
    """
    transport = _is_tcp() | _is_udp()
    port = lambda c: F.when(transport, F.coalesce(F.col(c), F.lit(0))).otherwise(0)
    ends = packets.filter(F.col("src_ip").isNotNull()).select(
        "*",
        F.when(_is_tcp(), "TCP")
        .when(_is_udp(), "UDP")
        .otherwise(_filled(F.col("ip_proto").cast("string")))
        .alias("protocol"),
        port("src_port").alias("src_end_port"),
        port("dst_port").alias("dst_end_port"),
    )
    src_ip, dst_ip = F.col("src_ip"), F.col("dst_ip")
    src_port, dst_port = F.col("src_end_port"), F.col("dst_end_port")
    from_lo = (src_ip < dst_ip) | ((src_ip == dst_ip) & (src_port <= dst_port))
    return ends.withColumn("from_lo", F.coalesce(from_lo, F.lit(True))).select(
        *[_filled(F.col(c)).alias(c) if c == "capture_id" else c for c in packets.columns],
        "protocol",
        F.when(F.col("from_lo"), _filled(src_ip)).otherwise(_filled(dst_ip)).alias("lo_ip"),
        F.when(F.col("from_lo"), src_port).otherwise(dst_port).alias("lo_port"),
        F.when(F.col("from_lo"), _filled(dst_ip)).otherwise(_filled(src_ip)).alias("hi_ip"),
        F.when(F.col("from_lo"), dst_port).otherwise(src_port).alias("hi_port"),
        "from_lo",
    )


def payload_bytes() -> Column:
    return F.coalesce(F.col("payload_len"), F.lit(0)).cast("long")


def header_bytes() -> Column:
    """Transport header only; the IP header counts just for other protocols."""
    return (
        F.when(F.col("src_ip").isNull(), 0)
        .when(_is_tcp(), _header_words("tcp_dataofs") * 4)
        .when(_is_udp(), 8)
        .otherwise(_header_words("ip_ihl") * 4)
        .cast("long")
    )


def full_header_bytes() -> Column:
    """IP header plus transport header, as the inspection listing shows it."""
    ip = F.when(F.col("src_ip").isNull(), 0).otherwise(_header_words("ip_ihl") * 4)
    transport = (
        F.when(_is_tcp(), _header_words("tcp_dataofs") * 4).when(_is_udp(), 8).otherwise(0)
    )
    return (ip + transport).cast("long")


def tcp_flag(mask: int) -> Column:
    on = F.coalesce(F.col("tcp_flags"), F.lit(0)).bitwiseAND(F.lit(mask)) != 0
    return F.when(_is_tcp() & on, 1).otherwise(0)


def packet_measures(packets: DataFrame) -> DataFrame:
    """Payload, header length and the four TCP flag bits of each packet."""
    return packets.select(
        "*",
        payload_bytes().alias("payload_bytes"),
        header_bytes().alias("header_bytes"),
        tcp_flag(0x02).alias("syn"),
        tcp_flag(0x10).alias("ack"),
        tcp_flag(0x04).alias("rst"),
        tcp_flag(0x01).alias("fin"),
    )


# One letter per TCP flag bit, lowest bit first.
TCP_FLAG_LETTERS = "FSRPAUEC"


def flag_text() -> Column:
    letters = [
        F.when(F.col("tcp_flags").bitwiseAND(F.lit(1 << bit)) != 0, letter).otherwise("")
        for bit, letter in enumerate(TCP_FLAG_LETTERS)
    ]
    return F.when(_is_tcp(), F.concat(*letters)).when(_is_udp(), "UDP").otherwise("OTHER")


def endpoint_text(ip: str, port: str) -> Column:
    with_port = F.concat(F.col(ip), F.lit(":"), F.col(port).cast("string"))
    return F.when(_is_tcp() | _is_udp(), with_port).otherwise(F.col(ip))


def packet_listing(flow_packets: DataFrame) -> DataFrame:
    """Numbered packets of each flow with direction and display fields.

    ``flow_packets`` carries ``FLOW`` columns and ``forward_is_lo``.
    """
    shown = flow_packets.select(
        *FLOW,
        "packet_id",
        "ts_us",
        F.when(F.col("from_lo") == F.col("forward_is_lo"), "FORWARD")
        .otherwise("BACKWARD")
        .alias("direction"),
        payload_bytes().alias("payload"),
        full_header_bytes().alias("header"),
        flag_text().alias("flags"),
        endpoint_text("src_ip", "src_port").alias("source"),
        endpoint_text("dst_ip", "dst_port").alias("destination"),
        F.when(F.col("forward_is_lo"), F.col("lo_ip")).otherwise(F.col("hi_ip")).alias("forward_ip"),
        F.when(F.col("forward_is_lo"), F.col("lo_port"))
        .otherwise(F.col("hi_port"))
        .alias("forward_port"),
    )
    return with_rank(shown, FLOW, ["ts_us", "packet_id"], "packet_index")
