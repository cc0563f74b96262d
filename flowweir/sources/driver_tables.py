"""Packet, raw-record and score tables derived from the star-schema test tables.

The test data holds no network traffic, so these projections give every operator
a whole table of realistic shape. Each is one narrow pass over its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowweir.schema import DIRECT_COLUMNS, FEATURES, RAW_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _epoch_us(df: DataFrame, name: str) -> str:
    """Microseconds since 1970, whatever the session time zone is."""
    kind = dict(df.dtypes)[name]
    if kind == "timestamp_ntz":
        return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name})"
    return f"unix_micros({name})"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as packets: one client endpoint per user, four servers."""
    events = table(spark, sf_dir, "events")
    base = events.selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "value",
        f"{_epoch_us(events, 'ts')} div 5000 AS ts_us",
        "CASE WHEN user_id % 10 = 9 THEN 1 WHEN user_id % 3 = 2 THEN 17 ELSE 6 END AS ip_proto",
        "concat('10.0.', user_id div 256, '.', user_id % 256) AS client_ip",
        "concat('198.51.100.', user_id % 4) AS server_ip",
        "cast(40000 + user_id % 1000 AS int) AS client_port",
        "CASE user_id % 3 WHEN 0 THEN 443 WHEN 1 THEN 80 ELSE 53 END AS server_port",
        "event_id % 3 = 0 AS reply",
        "event_id % 97 = 0 AS non_ip",
        "cast(floor(value) AS int) AS payload_len",
    )
    typed = base.selectExpr(
        "*",
        "CASE WHEN ip_proto = 6 THEN cast(5 + event_id % 4 AS int) END AS tcp_dataofs",
        "CASE WHEN ip_proto = 6 THEN CASE event_type WHEN 'signup' THEN 2 WHEN 'view' THEN 16 "
        "WHEN 'click' THEN 24 WHEN 'purchase' THEN 17 WHEN 'error' THEN 4 END END AS tcp_flags",
    )
    return typed.selectExpr(
        "concat('cap-', user_id % 8) AS capture_id",
        "event_id AS packet_id",
        "ts_us",
        "CASE WHEN non_ip THEN NULL WHEN reply THEN server_ip ELSE client_ip END AS src_ip",
        "CASE WHEN non_ip THEN NULL WHEN reply THEN client_ip ELSE server_ip END AS dst_ip",
        "ip_proto",
        "5 AS ip_ihl",
        "CASE WHEN ip_proto = 1 THEN NULL WHEN reply THEN server_port ELSE client_port END AS src_port",
        "CASE WHEN ip_proto = 1 THEN NULL WHEN reply THEN client_port ELSE server_port END AS dst_port",
        "tcp_dataofs",
        "tcp_flags",
        "payload_len",
        "payload_len + 34 + CASE ip_proto WHEN 6 THEN tcp_dataofs * 4 WHEN 17 THEN 8 ELSE 0 END "
        "AS frame_len",
    )


def client_spelling(address: str) -> str:
    """SQL that spells an address of a frame as ``packets`` does.

    The third part of a client is its user over 256, without bound; a frame's four bytes
    carry what is above 255 into the parts before it.
    """
    part = lambda i: f"cast(split_part({address}, '.', {i}) AS bigint)"
    user = f"(({part(1)} - 10) * 256 + {part(2)}) * 256 + {part(3)}"
    return (
        f"CASE WHEN {address} LIKE '198.51.100.%' THEN {address} "
        f"ELSE concat('10.0.', {user}, '.', {part(4)}) END"
    )


# Raw column name -> expression over q, x, k, m, n, bw, dur, fl, bl.
_RAW_EXPRESSIONS = {
    "Flow Duration": "dur",
    "Total Fwd Packets": "q",
    "Total Backward Packets": "bw",
    "Fwd Packet Length Mean": "x % 1500",
    "Bwd Packet Length Mean": "(k * 7) % 1460",
    "Total Length of Fwd Packets": "fl",
    "Total Length of Bwd Packets": "bl",
    "Fwd Header Length": "q * 20",
    "Bwd Header Length": "bw * 20",
    "Flow Bytes/s": "(fl + bl) * 1e6D / dur",
    "Flow Packets/s": "(q + bw) * 1e6D / dur",
    "Average Packet Size": "(fl + bl) / cast(q + bw AS double)",
    "SYN Flag Count": "cast(n = 1 AS bigint)",
    "ACK Flag Count": "k % 2",
    "RST Flag Count": "cast(k % 29 = 0 AS bigint)",
    "FIN Flag Count": "cast(m % 3 = 0 AS bigint)",
    "Active Mean": "(x % 5000) * 100",
    "Idle Mean": "CASE WHEN k % 4 = 0 THEN 5000001 + x ELSE 0 END",
    "Down/Up Ratio": "bw div q",
    "Fwd IAT Mean": "dur div q",
    "Bwd IAT Mean": "dur div greatest(bw, 1)",
}

_LABEL = (
    "CASE WHEN l_returnflag = 'N' THEN 'BENIGN' WHEN l_returnflag = 'A' THEN 'PortScan' "
    "WHEN l_linestatus = 'F' THEN 'Bot' ELSE 'Web Attack ? XSS' END"
)

# The driver's lineitem has no unique pair of columns; these five are unique.
_ROW_KEY = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "date_format(l_shipdate, 'yyyyMMdd'))"
)


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "lineitem").selectExpr(
        f"{_ROW_KEY} AS row_key",
        f"{_LABEL} AS source_label",
        "concat('day', l_suppkey % 5) AS source_file",
        "cast(l_quantity AS bigint) AS q",
        "cast(round(l_extendedprice * 100) AS bigint) AS x",
        "l_partkey AS k",
        "l_suppkey AS m",
        "cast(l_linenumber AS bigint) AS n",
        "l_orderkey AS o",
        "l_partkey % 40 AS bw",
    )
    return base.selectExpr(
        "*",
        "x * 10 AS dur",
        "q * (x % 1500) AS fl",
        "bw * ((k * 7) % 1460) AS bl",
    )


def raw_flow_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as raw flow-meter records (text), with faults and repeats."""
    shown = _measured(spark, sf_dir).selectExpr(
        "row_key",
        "source_file",
        "o",
        "n",
        *[f"{e} AS `{c}`" for c, e in _RAW_EXPRESSIONS.items()],
        "source_label AS Label",
    )
    faults = {
        "Flow Bytes/s": "CASE WHEN o % 50 = 0 AND n = 1 THEN 'Infinity' ELSE cast(`Flow Bytes/s` AS string) END",
        "Flow Packets/s": "CASE WHEN o % 53 = 0 THEN '' ELSE cast(`Flow Packets/s` AS string) END",
        "Flow Duration": "cast(CASE WHEN o % 71 = 0 THEN -`Flow Duration` ELSE `Flow Duration` END AS string)",
    }
    text = shown.selectExpr(
        "row_key",
        "source_file",
        *[f"{faults.get(c, f'cast(`{c}` AS string)')} AS `{c}`" for c in RAW_COLUMNS],
        "explode(CASE WHEN o % 100 = 1 THEN array(1, 2) ELSE array(1) END) AS copy",
    )
    return text


def scored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as labelled flows with a score from two fixed formulas."""
    sums = {
        "flow_bytes": "fl + bl",
        "flow_packets": "q + bw",
        "header_length": "q * 20 + bw * 20",
    }
    expressions = {
        f: sums[f] if f in sums else _RAW_EXPRESSIONS[DIRECT_COLUMNS[f]] for f in FEATURES
    }
    scored = _measured(spark, sf_dir).selectExpr(
        "row_key",
        "source_label",
        "source_file",
        "concat('cap-', o % 500) AS capture_id",
        "m % 6 AS run",
        "k",
        "m",
        *[f"cast({e} AS double) AS {f}" for f, e in expressions.items()],
        "cast(source_label <> 'BENIGN' AS int) AS binary_label",
        "((o * 7919 + n * 104729) % 1000) / 1000.0D AS u",
        "((o * 31 + k * 17) % 1000) / 1000.0D AS v",
    )
    return (
        scored.selectExpr(
            "*",
            "0.3D * binary_label + 0.7D * u AS attack_probability",
            "0.5D * binary_label + 0.5D * v AS candidate_probability",
        )
        .selectExpr(
            "*",
            "cast(attack_probability > 0.5D AS int) AS prediction",
            "cast(candidate_probability > 0.5D AS int) AS candidate_prediction",
            "array(1.0D - attack_probability, attack_probability) AS probabilities",
        )
        .drop("u", "v")
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as captures with packet totals; some have no scored flow."""
    return (
        table(spark, sf_dir, "orders")
        .selectExpr("concat('cap-', o_orderkey % 520) AS capture_id")
        .groupBy("capture_id")
        .agg(F.count(F.lit(1)).alias("packet_count"))
        .withColumn("capture_duration", F.col("packet_count") * F.lit(0.25))
    )


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as (label, prediction) pairs."""
    return table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "toxic AS label", "1 - quality AS prediction"
    )


def label_windows(spark: SparkSession, sf_dir: str, parts: int = 10) -> DataFrame:
    """Equal time windows over each capture, alternately benign and attack.

    The captures overlap in time and start with different labels.
    """
    span = packets(spark, sf_dir).groupBy("capture_id").agg(
        F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi")
    )
    cut = span.selectExpr(
        "capture_id",
        "lo",
        f"(hi - lo) div {parts} AS width",
        f"explode(sequence(0, {parts - 1})) AS i",
    )
    return cut.selectExpr(
        "concat(capture_id, '-', i) AS scenario",
        "cast((i + cast(substring(capture_id, 5) AS int)) % 2 AS int) AS label",
        "(lo + i * width) / 1e6D AS start_epoch",
        "(lo + (i + 1) * width - 1) / 1e6D AS end_epoch",
        "concat(capture_id, '.pcap') AS pcap",
    )


def mixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a mixed table with gaps, infinities and repeats."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS order_no",
        "CASE WHEN l_orderkey % 37 = 0 THEN NULL WHEN l_partkey % 43 = 0 THEN double('Infinity') "
        "ELSE l_quantity END AS quantity",
        "CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE l_extendedprice END AS price",
        "CASE WHEN l_suppkey % 29 = 0 THEN NULL ELSE l_returnflag END AS flag",
        "l_linestatus AS status",
        "explode(CASE WHEN l_orderkey % 100 = 1 THEN array(1, 2) ELSE array(1) END) AS copy",
    ).drop("copy")


# Leaf of tree j for part k and supplier m, in place of a fitted forest.
LEAF_TREES = 10


def leaf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored flows with ten leaf numbers each."""
    leaves = ", ".join(f"cast((k div {j + 1} + {j} * m) % 17 AS int)" for j in range(LEAF_TREES))
    return scored_flows(spark, sf_dir).withColumn("leaves", F.expr(f"array({leaves})"))
