import random
import struct

import pytest
from conftest import packet
from pyspark.sql import functions as F

from flowweir.operators import flows as FL
from flowweir.operators import scoring as SC
from flowweir.schema import FEATURES, FLOW
from flowweir.plans import inputs as IN
from flowweir.sources import captures as CF
from flowweir.streaming import sinks as SK
from flowweir.streaming import tracker as TK
from flowweir.streaming import windows as SW


@pytest.fixture(scope="module")
def traffic():
    rng = random.Random(11)
    rows, at = [], 0.0
    for i in range(300):
        at += rng.choice([0.01, 1.0, 4.0, 9.0])
        key = 0 if rng.random() < 0.4 else rng.randrange(1, 6)
        proto = (6, 17, 1)[key % 3]
        a, b = f"10.0.0.{key}", "10.9.9.9"
        ends = dict(src=a, dst=b) if rng.random() < 0.6 else dict(src=b, dst=a, sport=80, dport=1000)
        rows.append(packet(i, at, proto=proto, flags=rng.choice([2, 16, 17, 4]), payload=rng.randrange(60), **ends))
    return rows


@pytest.mark.parametrize("split_bytes", [1 << 20, 1000, 300])
def test_capture_file_round_trip(spark, packets, traffic, tmp_path, split_bytes):
    df = packets(traffic)
    IN.write_captures(df.coalesce(1), str(tmp_path))
    back = CF.read_captures(spark, str(tmp_path), split_bytes=split_bytes)
    drop = ["capture_id", "frame_len", "packet_id"]
    assert back.drop(*drop).exceptAll(df.drop(*drop)).count() == 0
    assert back.count() == len(traffic)


def test_capture_folder_and_padding(spark, tmp_path):
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 28 + 3, 0, 0, 64, 17, 0) + bytes([10, 0, 0, 1, 10, 0, 0, 2])
    udp = struct.pack(">HHHH", 5000, 53, 11, 0) + b"abc"
    frame = bytes(12) + b"\x08\x00" + ip + udp + bytes(15)
    tagged = bytes(12) + b"\x81\x00\x00\x07\x08\x00" + ip + udp
    other = bytes(12) + b"\x08\x06" + bytes(28)
    body = struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1)
    for n, f in enumerate((frame, tagged, other)):
        body += struct.pack(">IIII", 7, 5000 * n, len(f), len(f)) + f
    (tmp_path / "one.pcap").write_bytes(body + b"\x00\x01")
    got = CF.read_captures(spark, str(tmp_path)).orderBy("packet_id").collect()
    assert [r.ts_us for r in got] == [7_000_000, 7_000_005, 7_000_010]
    assert [(r.src_ip, r.src_port, r.payload_len) for r in got[:2]] == [("10.0.0.1", 5000, 3)] * 2
    assert got[2].src_ip is None and got[0].frame_len == len(frame)
    assert got[0].capture_id.endswith("/one.pcap")
    damage = CF.capture_damage(spark, str(tmp_path)).collect()
    assert [(r.offset, r.reason) for r in damage] == [(len(body), "record header is cut")]


def _udp_frame(src, dst, sport, dport, data):
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 28 + len(data), 0, 0, 64, 17, 0) + bytes(src) + bytes(dst)
    return bytes(12) + b"\x08\x00" + ip + struct.pack(">HHHH", sport, dport, 8 + len(data), 0) + data


def _block(kind, body):
    body += bytes(-len(body) % 4)
    size = struct.pack("<I", 12 + len(body))
    return struct.pack("<I", kind) + size + body + size


def test_both_formats_and_rotated_files_give_one_flow(spark, tmp_path):
    there = _udp_frame([10, 0, 0, 1], [10, 0, 0, 2], 5000, 53, b"abc")
    back = _udp_frame([10, 0, 0, 2], [10, 0, 0, 1], 53, 5000, b"defgh")
    plain = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    plain += struct.pack("<IIII", 7, 10, len(there), len(there)) + there
    (tmp_path / "run_001.pcap").write_bytes(plain)
    nanoseconds = struct.pack("<HHB3xHH", 9, 1, 9, 0, 0)
    blocks = _block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    blocks += _block(1, struct.pack("<HHI", 1, 0, 65535) + nanoseconds)
    at = 8_000_020_000
    blocks += _block(6, struct.pack("<IIIII", 0, at >> 32, at & 0xFFFFFFFF, len(back), len(back)) + back)
    (tmp_path / "run_002.pcapng").write_bytes(blocks)
    whole = lambda path: F.regexp_extract(path, r"/([^/]+)_\d+\.[a-z]+$", 1)
    got = CF.read_captures(spark, str(tmp_path), capture_of=whole)
    assert [(r.capture_id, r.ts_us, r.payload_len) for r in got.orderBy("packet_id").collect()] == [
        ("run", 7_000_010, 3),
        ("run", 8_000_020, 5),
    ]
    flows = FL.flow_features(got).collect()
    assert [(r.total_fwd_packets, r.total_bwd_packets, r.flow_duration) for r in flows] == [(1, 1, 1_000_010)]
    assert CF.capture_damage(spark, str(tmp_path)).isEmpty()


def test_bad_capture_is_an_error(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"z" * 64)
    with pytest.raises(Exception, match="not a packet capture"):
        CF.read_captures(spark, str(tmp_path)).collect()


def _tracked(spark, batches, folder, **options):
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(folder)
    IN.end_marker(spark, 10**10).coalesce(1).write.mode("append").parquet(folder)
    stream = SK.packet_stream(spark, folder, maxFilesPerTrigger=1)
    return SK.run_available(TK.track_flows(stream, **options), "tracked")


def test_stream_flow_tracker_equals_batch(spark, packets, traffic, tmp_path):
    # Arrival in four batches, each packet up to nine seconds late; all flows are closed.
    rng = random.Random(4)
    arriving = sorted(traffic, key=lambda r: r[2] + rng.randrange(9_000_000))
    batches = [packets(arriving[n : n + 75]) for n in range(0, 300, 75)]
    got = _tracked(spark, batches, str(tmp_path / "in"))
    expected = FL.flow_features(packets(traffic)).select(*FLOW, *FEATURES)
    assert got.count() == expected.count()
    assert got.exceptAll(expected).count() == 0


def test_stream_flow_tracker_keeps_all_flows_of_a_share(spark, packets, traffic, tmp_path):
    arriving = sorted(traffic, key=lambda r: r[2])
    batches = [packets(arriving[:150]), packets(arriving[150:])]
    got = _tracked(spark, batches, str(tmp_path / "in"), shares=1)
    expected = FL.flow_features(packets(traffic)).select(*FLOW, *FEATURES)
    assert got.exceptAll(expected).count() == 0 and got.count() == expected.count()


def test_stream_flow_starts_at_its_first_packet_in_time(spark, packets, tmp_path):
    late = packet(2, 1000.0, src="10.0.0.2", dst="10.0.0.1", sport=80, dport=1000, payload=9)
    rows = [packet(1, 1003.0, payload=5), late]
    got = _tracked(spark, [packets([r]) for r in rows], str(tmp_path / "in")).collect()
    assert [(r.flow_start_us, r.flow_duration) for r in got] == [(1_000_000_000, 3_000_000.0)]
    assert got[0].fwd_packet_length == 9


def test_stream_windows_equal_batch(spark, packets, traffic, tmp_path):
    folder = str(tmp_path / "in")
    packets([*traffic, packet(999, 5000.0)]).write.parquet(folder)
    got = SK.run_available(SW.capture_windows(SK.packet_stream(spark, folder)), "windows")
    expected = SW.capture_windows(packets(traffic))
    assert got.exceptAll(expected).count() == 0 and got.count() == expected.count()


def test_log_batch_is_written_once(spark, tmp_path):
    write = SK.log_batches(str(tmp_path / "log"))
    df = spark.range(3)
    write(df, 0)
    write(df, 0)
    write(df, 1)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6


def test_forest_scoring_and_gate(spark):
    df = spark.range(200).select(
        *[(F.col("id") % 50).cast("double").alias(f) for f in FEATURES],
        (F.col("id") % 50 > 25).cast("int").alias("label"),
    )
    model = SC.train_forest(df, numTrees=5, maxDepth=4)
    with pytest.raises(RuntimeError):
        SC.detect_flows(model, df)
    rows = SC.detect_flows(model, df, enabled=True).collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 and len(r.leaves) == 5 for r in rows)
    assert sum(r.prediction == r.label for r in rows) > 190


def test_forest_keeps_the_node_of_each_row_between_levels(spark):
    df = spark.range(60).select(
        *[((F.col("id") * (i + 3)) % 17).cast("double").alias(f) for i, f in enumerate(FEATURES)],
        (F.col("id") % 2).cast("int").alias("label"),
    )
    model = SC.train_forest(df, numTrees=2, maxDepth=3)
    assert model.stages[-1].getCacheNodeIds()


def test_forest_in_parts_votes_as_one(spark, monkeypatch):
    """Parts have the trees of the whole forest, no more nodes than wanted, and add up their votes."""
    df = spark.range(300).select(
        "id",
        *[((F.col("id") * (i + 3)) % 17).cast("double").alias(f) for i, f in enumerate(FEATURES)],
        (F.col("id") % 5 % 2).cast("int").alias("label"),
    )
    params = {"numTrees": 14, "maxDepth": 4}
    (first, *_) = parts = list(SC.forest_parts(df, **params))
    assert [m.stages[-1].getNumTrees for m in parts] == [10, 4]
    monkeypatch.setattr(SC, "PART_NODES", first.stages[-1].totalNumNodes // 4)
    parts = list(SC.forest_parts(df, **params))
    trees = [m.stages[-1].getNumTrees for m in parts]
    assert sum(trees) == 14 and trees[0] == 10 and len(trees) > 2
    votes = {}
    for model in parts:
        for r in model.transform(df).select("id", "rawPrediction").collect():
            own = votes.setdefault(r.id, [0.0, 0.0])
            votes[r.id] = [a + b for a, b in zip(own, r.rawPrediction)]
    scored = SC.predict_parts(iter(parts), df)
    assert scored.columns == [*df.columns, "prediction"]
    got = {r.id: r.prediction for r in scored.collect()}
    assert got == {i: int(b > a) for i, (a, b) in votes.items()} and set(got.values()) == {0, 1}
    benign = SC.predict_parts(SC.forest_parts(df.withColumn("label", F.lit(0)), numTrees=2), df)
    assert {r.prediction for r in benign.collect()} == {0}
