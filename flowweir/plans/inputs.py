"""Inputs that queries and tests make from packet tables: capture files, late arrivals."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowweir.schema import PACKET_SCHEMA
from flowweir.sources.capture_files import ETHERNET, TCP, UDP


def _address_bytes(text: str) -> bytes:
    """Four bytes of a dotted address; a part above 255 carries into the one before it."""
    number = 0
    for part in text.split("."):
        number = number * 256 + int(part)
    return number.to_bytes(4, "big")


def _frame_bytes(p) -> bytes:
    """Ethernet frame with the header fields of one packet row."""
    if p.src_ip is None:
        body = bytes(max(int(p.frame_len) - 14, 0))
        return bytes(12) + b"\x08\x06" + body
    payload = bytes(int(p.payload_len))
    proto = int(p.ip_proto)
    if proto == TCP:
        offset = int(p.tcp_dataofs)
        head = struct.pack(
            ">HHIIBBHHH", int(p.src_port), int(p.dst_port), 0, 0, offset << 4, int(p.tcp_flags), 0, 0, 0
        ) + bytes(offset * 4 - 20)
    elif proto == UDP:
        head = struct.pack(">HHHH", int(p.src_port), int(p.dst_port), 8 + len(payload), 0)
    else:
        head = b""
    words = int(p.ip_ihl)
    ip = struct.pack(
        ">BBHHHBBH", 4 << 4 | words, 0, words * 4 + len(head) + len(payload), 0, 0, 64, proto, 0
    )
    ip += _address_bytes(p.src_ip) + _address_bytes(p.dst_ip) + bytes(words * 4 - 20)
    return bytes(12) + b"\x08\x00" + ip + head + payload


def write_captures(packets: DataFrame, folder: str) -> None:
    """Write packets as capture files, some of each capture in every partition.

    A file is named by its capture, partition and batch; a task that runs again writes
    the same file again.
    """

    def run(batches):
        from pyspark import TaskContext

        from flowweir.sources.capture_files import file_system

        files, where = file_system(folder)
        files.create_dir(where)
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            for capture, rows in batch.groupby("capture_id", sort=False):
                parts = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262_144, ETHERNET)]
                for p in rows.itertuples(index=False):
                    frame = _frame_bytes(p)
                    seconds, micros = divmod(int(p.ts_us), 1_000_000)
                    parts.append(struct.pack("<IIII", seconds, micros, len(frame), len(frame)))
                    parts.append(frame)
                name = f"{capture}_{part:05d}_{number:05d}.pcap"
                with files.open_output_stream(f"{where}/{name}") as out:
                    out.write(b"".join(parts))
                yield pd.DataFrame({"name": [name]})

    packets.select(*PACKET_SCHEMA.names).mapInPandas(run, "name string").count()


def end_marker(spark: SparkSession, ts_us: int) -> DataFrame:
    """One packet of its own key that moves the watermark past all others.

    Written after the last input file, with a time beyond every timeout and
    window. Its own flow and window stay open, so it never shows in a result.
    """
    marker = ("end of input", -1, ts_us, "0.0.0.0", "0.0.0.0", 17, 5, 0, 0, None, None, 0, 42)
    return spark.createDataFrame([marker], PACKET_SCHEMA)


def arrival_files(packets: DataFrame, folder: str, batches: int, jitter_us: int, close_us: int) -> int:
    """Write packets in the order of a delayed arrival, then the end marker.

    Each packet is late by a hash of its id, up to ``jitter_us``. Returns the
    number of files of one batch, for ``maxFilesPerTrigger``.
    """
    spark = packets.sparkSession
    late = F.pmod(F.xxhash64("packet_id"), F.lit(jitter_us))
    arriving = packets.withColumn("_at", F.col("ts_us") + late)
    first, last, end = arriving.agg(F.min("_at"), F.max("_at"), F.max("ts_us")).first()
    if first is None:
        packets.write.parquet(folder)
        return 1
    width = (last - first) // batches + 1
    for n in range(batches):
        low = first + n * width
        part = arriving.filter((F.col("_at") >= low) & (F.col("_at") < low + width))
        part.drop("_at").write.mode("append").parquet(folder)
    files = len(spark.read.schema(PACKET_SCHEMA).parquet(folder).inputFiles())
    end_marker(spark, end + close_us).coalesce(1).write.mode("append").parquet(folder)
    return -(-files // batches)
