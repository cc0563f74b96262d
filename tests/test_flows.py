import random

import pytest
from conftest import packet

from flowweir.operators import flows as FL
from flowweir.operators.chains import chain_starts
from flowweir.operators import packets as PK
from flowweir.schema import FEATURES

CLIENT = dict(src="10.0.0.1", dst="10.0.0.2", sport=12345, dport=80)
SERVER = dict(src="10.0.0.2", dst="10.0.0.1", sport=80, dport=12345)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_hand_computed_tcp_flow(packets):
    got = one(
        FL.flow_features(
            packets(
                [
                    packet(0, 100.0, flags=2, payload=10, **CLIENT),
                    packet(1, 100.001, flags=18, payload=6, **SERVER),
                    packet(2, 100.003, flags=16, payload=8, **CLIENT),
                ]
            )
        )
    )
    expected = dict(
        flow_duration=3000,
        total_fwd_packets=2,
        total_bwd_packets=1,
        fwd_packet_length=9,
        bwd_packet_length=6,
        flow_bytes=24,
        flow_packets=3,
        flow_rate=8000,
        packet_rate=1000,
        avg_packet_size=34 / 3,
        syn_count=2,
        ack_count=2,
        rst_count=0,
        fin_count=0,
        active_time=0,
        idle_time=0,
        header_length=60,
        down_up_ratio=0,
        fwd_iat_mean=3000,
        bwd_iat_mean=0,
    )
    assert list(expected) == FEATURES
    for name, value in expected.items():
        assert got[name] == pytest.approx(value), name
    assert (got["forward_ip"], got["forward_port"]) == ("10.0.0.1", 12345)


def test_idle_gap_record(packets):
    got = one(
        FL.flow_features(
            packets(
                [
                    packet(0, 0.0, flags=2, payload=4, **CLIENT),
                    packet(1, 0.001, flags=18, payload=8, **SERVER),
                    packet(2, 6.0, flags=16, payload=8, **CLIENT),
                    packet(3, 6.001, flags=16, payload=8, **SERVER),
                ]
            )
        )
    )
    assert got["active_time"] == 1000 and got["idle_time"] == 5_999_000
    assert got["flow_duration"] == 6_001_000
    assert got["fwd_iat_mean"] == 6_000_000 and got["bwd_iat_mean"] == 6_000_000
    assert got["avg_packet_size"] == 8 and got["down_up_ratio"] == 1


def test_active_idle_leaves_the_last_period_out(packets):
    got = one(FL.flow_features(packets([packet(i, t) for i, t in enumerate([0, 1, 2, 8, 9])])))
    assert got["active_time"] == 2_000_000 and got["idle_time"] == 6_000_000


BOUNDARY_CASES = [
    ([0, 1, 120], [3]),
    ([0, 1, 120.000001], [2, 1]),
    ([0, 120.000001], [1, 1]),
    ([0, 10, 130], [2, 1]),
    ([0, 100, 200, 300], [2, 2]),
    ([5], [1]),
]


def test_timeout_boundary(packets):
    rows = [
        packet(i, t, capture=f"c{case}")
        for case, (times, _) in enumerate(BOUNDARY_CASES)
        for i, t in enumerate(times)
    ]
    got = FL.flow_features(packets(rows)).orderBy("flow_start_us").collect()
    for case, (_, expected) in enumerate(BOUNDARY_CASES):
        assert [int(r.flow_packets) for r in got if r.capture_id == f"c{case}"] == expected


def test_header_lengths(packets):
    rows = [
        packet(0, 0, proto=17, capture="udp"),
        packet(1, 0, proto=1, capture="icmp"),
        packet(2, 0, dataofs=0, capture="tcp"),
    ]
    got = {r.capture_id: r.header_length for r in FL.flow_features(packets(rows)).collect()}
    assert got == {"udp": 8, "icmp": 20, "tcp": 20}


def test_average_counts_first_payload_twice(packets):
    got = one(FL.flow_features(packets([packet(0, 0, payload=6), packet(1, 1, payload=6)])))
    assert got["flow_bytes"] == 12 and got["avg_packet_size"] == 9


def test_non_ip_frames_are_left_out(packets):
    assert FL.flow_features(packets([packet(0, 0, src=None, dst=None)])).count() == 0


def test_same_endpoint_on_both_sides_is_all_forward(packets):
    both = dict(src="10.0.0.1", dst="10.0.0.1", sport=7, dport=7)
    got = one(FL.flow_features(packets([packet(0, 0, **both), packet(1, 1, **both)])))
    assert got["total_fwd_packets"] == 2 and got["total_bwd_packets"] == 0


def test_key_orders_addresses_as_text(packets):
    row = one(PK.flow_keys(packets([packet(0, 0, src="10.0.0.2", dst="10.0.0.10")])))
    assert (row["lo_ip"], row["hi_ip"], row["from_lo"]) == ("10.0.0.10", "10.0.0.2", False)


def greedy(times, timeout):
    """Flow start per time, the plain sequential rule."""
    starts, current = {}, None
    for t in sorted(set(times)):
        if current is None or t - current > timeout:
            current = t
        starts[t] = current
    return starts


def test_assignment_equals_sequential_rule_with_a_hot_key(packets):
    rng = random.Random(7)
    rows, i = [], 0
    for key in range(12):
        # Key 0 holds well over a third of all rows.
        n = 400 if key == 0 else rng.randrange(1, 60)
        at = -50.0
        for _ in range(n):
            at += rng.choice([0.0, 0.4, 3.0, 7.0, 59.9, 120.0, 121.0, 400.0]) * rng.random() * 2
            reply = rng.random() < 0.4
            ends = dict(src=f"10.0.0.{key}", dst="10.9.9.9")
            if reply:
                ends = dict(src="10.9.9.9", dst=f"10.0.0.{key}", sport=80, dport=1000)
            rows.append(packet(i, at, payload=rng.randrange(50), **ends))
            i += 1
    rng.shuffle(rows)
    got = FL.assign_flows(packets(rows)).collect()
    assert len(got) == len(rows)
    by_key = {}
    for r in got:
        by_key.setdefault((r.lo_ip, r.hi_ip), []).append(r)
    for members in by_key.values():
        expected = greedy([r.ts_us for r in members], 120_000_000)
        assert all(r.flow_start_us == expected[r.ts_us] for r in members)


def test_a_flooded_slot_spreads_over_blocks(spark, packets):
    # 3,000 times of one key in three slots; small partitions that are not merged.
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",)}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(3)
        rows = [packet(i, rng.random() * 360) for i in range(3000)]
        got = FL.assign_flows(packets(rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before["spark.sql.shuffle.partitions"])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected = greedy([r.ts_us for r in got], 120_000_000)
    assert len(got) == 3000
    assert all(r.flow_start_us == expected[r.ts_us] for r in got)


@pytest.mark.parametrize("limit", [7, 40, 1000])
def test_chains_over_many_blocks_equal_the_plain_rule(spark, limit):
    rng = random.Random(limit)
    groups = {("hot", 1): {rng.randrange(20_000) for _ in range(4000)}}
    # An even beat never falls in with chains that begin elsewhere.
    groups["beat", 1] = set(range(0, 9000, 3))
    groups |= {("k", i): {rng.randrange(500) for _ in range(rng.randrange(1, 40))} for i in range(60)}
    rows = [(*k, t) for k, times in groups.items() for t in times]
    rng.shuffle(rows)
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        times = spark.createDataFrame(rows, "name string, n int, ts_us long")
        got = chain_starts(times, ["name", "n"], limit).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [(*k, t) for k, ts in groups.items() for t in set(greedy(ts, limit).values())]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_chains_of_no_times(spark):
    times = spark.createDataFrame([], "name string, ts_us long")
    assert chain_starts(times, ["name"], 5).count() == 0


def test_flow_numbers_follow_first_seen_order(packets):
    rows = [
        packet(0, 10, src="10.0.0.9", dst="10.0.0.1"),
        packet(1, 0, src="10.0.0.3", dst="10.0.0.1"),
        packet(2, 300, src="10.0.0.9", dst="10.0.0.1"),
    ]
    exported = FL.export_rows(FL.flow_features(packets(rows)))
    got = {r.flow_id: r.flow_duration for r in exported.collect()}
    assert sorted(got) == ["flow-00000", "flow-00001", "flow-00002"]
    numbered = FL.with_flow_seq(FL.flow_features(packets(rows))).orderBy("flow_seq").collect()
    assert [r.flow_start_us for r in numbered] == [10_000_000, 300_000_000, 0]


def test_eligibility(packets):
    rows = [packet(0, 0), packet(1, 1), packet(2, 0, src="10.0.0.7")]
    flows = FL.flow_features(packets(rows))
    assert FL.eligible_flows(flows).count() == 1
    counts = one(FL.eligibility_counts(flows))
    assert (counts["flows"], counts["eligible"], counts["excluded"]) == (2, 1, 1)
