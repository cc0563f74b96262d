"""Capture files of any size: byte ranges to records, records to packet rows.

A file is cut into byte ranges, a task each. The first record boundary of a range is
found by headers that follow each other plausibly; each range is walked to the first
boundary behind its end, and where that is not the place the next range began at, the
next one is walked again from it. So records are those of a walk through the whole file,
whatever a payload looks like. Python gives the place, time and first bytes of each record;
header fields are read by Spark's own binary functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowweir.functions.ordered import with_rank
from flowweir.schema import PACKET_SCHEMA
from flowweir.session import stage_table
from flowweir.sources.capture_files import (
    ETHERNET,
    IPV4,
    LINK_HEADER,
    TCP,
    UDP,
    VLAN,
    CaptureFile,
    Walk,
    find_boundary,
    interfaces_at,
    walk,
)

PATTERN = "*.{pcap,pcapng,cap}"
SPLIT_BYTES = 256 << 20
STEP_BYTES = 4 << 20
# Packet ids are the number of the file times this, plus the record's place in the file.
FILE_SPAN = 1 << 40

_PLACE = T.StructType([T.StructField("at", T.LongType()), T.StructField("reason", T.StringType())])
_DEFINITION = T.StructType(
    [
        T.StructField("at", T.LongType()),
        T.StructField("order", T.StringType()),
        T.StructField("link", T.IntegerType()),
        T.StructField("per_second", T.LongType()),
    ]
)
# A walked range: from ``entry`` (a boundary) to ``exit`` (the next range's), null if none.
_RANGE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("low", T.LongType()),
        T.StructField("high", T.LongType()),
        T.StructField("entry", T.LongType()),
        T.StructField("entry_order", T.StringType()),
        T.StructField("exit", T.LongType()),
        T.StructField("exit_order", T.StringType()),
        T.StructField("damage", _PLACE),
        T.StructField("definitions", T.ArrayType(_DEFINITION)),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("packet_id", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("frame_len", T.IntegerType()),
        T.StructField("link", T.IntegerType()),
        T.StructField("head", T.BinaryType()),
    ]
)


def _walked(row: dict) -> dict:
    """Walk one range; without ``entry`` its boundary is looked for."""
    file = CaptureFile(row["path"], row["size"])
    result = {**row, "exit": None, "exit_order": None, "damage": None, "definitions": []}
    if file.problem:
        result["damage"] = dict(zip(("at", "reason"), file.problem))
        return result
    if row["entry"] is None:
        first = row["low"] == 0
        result["entry"] = file.first if first else find_boundary(file, row["low"], row["high"])
        result["entry_order"] = file.order
    if result["entry"] is not None:
        done = walk(file, result["entry"], row["high"], result["entry_order"])
        if done.damage:
            result["damage"] = {"at": done.exit, "reason": done.damage}
        else:
            result["exit"], result["exit_order"] = done.exit, done.order
        names = _DEFINITION.names
        result["definitions"] = [dict(zip(names, d)) for d in done.definitions]
    file.close()
    return result


def _walk_ranges(batches):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_RANGE)
    for batch in batches:
        yield pa.RecordBatch.from_pylist([_walked(r) for r in batch.to_pylist()], schema)


def _dealt(ranges: DataFrame, number: int) -> DataFrame:
    """A task per range, as far as the scheduler's tables allow."""
    return ranges.repartition(max(1, min(number, 20_000)))


def _chained(ranges: DataFrame) -> DataFrame:
    """Each range with the ``real`` entry: where the ranges before it in its file end.

    Null where one of them is damaged. A range that a record spans has its end as entry.
    """
    before = Window.partitionBy("path").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.struct("exit", "exit_order")
    cut = F.coalesce(F.max(F.col("damage").isNotNull()).over(before), F.lit(False))
    last = F.max(F.when(F.col("exit").isNotNull(), ends)).over(before)
    return ranges.withColumns(
        {
            "cut": cut,
            "real": F.when(F.col("low") == 0, F.col("entry")).otherwise(last["exit"]),
            "real_order": F.when(F.col("low") == 0, F.col("entry_order")).otherwise(
                last["exit_order"]
            ),
        }
    )


def capture_ranges(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Ranges of files (``path``, ``length``) whose walks join on to each other.

    Files that cannot be read at all keep their first range, without ``entry``. Each round walks again the ranges that began at another place than the one before
    ended at; the first such range of a file is right after it, so this ends. Mostly
    there is no such range. Ranges behind a damaged place are left out.
    """
    cuts = F.sequence(
        F.lit(0).cast("long"),
        F.greatest(F.col("length") - 1, F.lit(0)),
        F.lit(split_bytes).cast("long"),
    )
    ranges = files.select("path", F.col("length").alias("size"), F.explode(cuts).alias("low")).select(
        "path",
        "size",
        "low",
        F.least(F.col("low") + split_bytes, F.col("size")).alias("high"),
        F.lit(None).cast("long").alias("entry"),
        F.lit(None).cast("string").alias("entry_order"),
    )
    ranges = stage_table(ranges, "ranges")
    walked = stage_table(
        _dealt(ranges, ranges.count()).mapInArrow(_walk_ranges, _RANGE), "walked"
    )
    while True:
        chained = _chained(walked)
        # A record may span whole ranges: what it ends in begins behind it.
        inside = F.col("real") < F.col("high")
        same = F.col("entry").eqNullSafe(F.col("real")) & F.col("entry_order").eqNullSafe(
            F.col("real_order")
        )
        wrong = ~F.col("cut") & F.col("real").isNotNull() & ~same & (
            inside | F.col("exit").isNotNull() | F.col("damage").isNotNull()
        )
        marked = stage_table(chained.withColumn("wrong", wrong), "chained")
        again = marked.filter("wrong")
        number = again.count()
        if not number:
            readable = F.col("entry").isNull() & (F.col("low") == 0) | inside
            return marked.filter(~F.col("cut") & readable).select(*_RANGE.names)
        renewed = again.select(
            "path",
            "size",
            "low",
            "high",
            F.when(inside, F.col("real")).otherwise(F.col("high")).alias("entry"),
            F.col("real_order").alias("entry_order"),
            inside.alias("inside"),
        )
        repaired = _dealt(renewed.filter("inside").drop("inside"), number).mapInArrow(
            _walk_ranges, _RANGE
        )
        # Nothing starts in a range that one record spans.
        empty = renewed.filter("not inside").select(
            "path",
            "size",
            "low",
            "high",
            F.lit(None).cast("long").alias("entry"),
            F.lit(None).cast("string").alias("entry_order"),
            F.lit(None).cast("long").alias("exit"),
            F.lit(None).cast("string").alias("exit_order"),
            F.lit(None).cast(_PLACE).alias("damage"),
            F.array().cast(T.ArrayType(_DEFINITION)).alias("definitions"),
        )
        kept = marked.filter("not wrong").select(*_RANGE.names)
        walked = stage_table(kept.unionByName(repaired).unionByName(empty), "walked")


def range_walks(row: dict):
    """Walks through one range a few MB each, as (walk, records), so memory is bounded."""
    file = CaptureFile(row["path"], row["size"])
    if file.problem:
        yield Walk(file.problem[0], file.order, file.problem[1]), []
        return
    held = interfaces_at([tuple(d.values()) for d in row["known"]], row["entry"])
    at, order = row["entry"], row["entry_order"]
    while at < row["high"]:
        found: list[tuple] = []
        done = walk(file, at, min(row["high"], at + STEP_BYTES), order, held, found.append)
        for _, _, link, ticks in done.definitions:
            held = [] if link is None else [*held, (link, ticks)]
        yield done, found
        at, order = done.exit, done.order
        if done.damage:
            break
    file.close()


def record_batch(found: list[tuple], capture: str, first_id: int):
    """``RECORD`` batch of what a walk has emitted."""
    import pyarrow as pa

    offset, micros, kept, link, head = zip(*found)
    columns = [
        pa.array([capture] * len(found), pa.string()),
        pa.array([first_id + o for o in offset], pa.int64()),
        pa.array(micros, pa.int64()),
        pa.array(kept, pa.int32()),
        pa.array(link, pa.int32()),
        pa.array(head, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=RECORD.names)


def _record_batches(batches):
    for batch in batches:
        for row in batch.to_pylist():
            for done, found in range_walks(row):
                if done.damage and row["entry"] is None:
                    raise ValueError(f"{row['path']}: {done.damage}")
                if found:
                    yield record_batch(found, row["capture_id"], row["first_id"])


def _damage_batches(batches):
    import pyarrow as pa

    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            for done, _ in range_walks(row):
                rows += [(row["path"], *s) for s in done.skipped]
                if done.damage:
                    rows.append((row["path"], done.exit, done.damage))
        columns = zip(*rows) if rows else ([], [], [])
        types = (pa.string(), pa.int64(), pa.string())
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        yield pa.RecordBatch.from_arrays(arrays, names=["path", "offset", "reason"])


def _located(files: DataFrame, split_bytes: int) -> DataFrame:
    """Ranges to read, with the columns of ``files`` and the definitions before them."""
    before = Window.partitionBy("path").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    ranges = capture_ranges(files, split_bytes).withColumn(
        "known", F.flatten(F.collect_list("definitions").over(before))
    )
    located = ranges.drop("definitions").join(files.drop("length"), "path")
    located = stage_table(located, "located")
    return _dealt(located, located.count())


def read_records(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``RECORD`` rows of capture files, by ranges of about ``split_bytes``.

    ``files`` has ``path``, ``length``, ``capture_id`` and ``first_id``, to which the place of a record
    is added. A file that is no capture, or of an unknown link type, is an error.
    """
    return _located(files, split_bytes).mapInArrow(_record_batches, RECORD)


def header_fields(records: DataFrame) -> DataFrame:
    """Packet columns from ``link``, ``frame_len`` and the first bytes of each record."""
    kept = F.col("frame_len")
    base = F.create_map(*[F.lit(x) for pair in LINK_HEADER.items() for x in pair])
    digits = records.withColumn("_hex", F.hex("head"))

    def number(at: Column | int, size: int) -> Column:
        at = F.lit(at) if isinstance(at, int) else at
        return F.conv(F.substr("_hex", at * 2 + 1, F.lit(2 * size)), 16, 10).cast("int")

    ethernet = F.col("link") == ETHERNET
    tag = F.when(ethernet & (number(12, 2) == VLAN), 4).otherwise(0)
    based = digits.withColumn("_net", base[F.col("link")] + tag)
    net = F.col("_net")
    is_ip = (
        F.when(ethernet, number(net - 2, 2) == IPV4)
        .when(F.col("link") == 113, number(14, 2) == IPV4)
        .otherwise(F.shiftright(number(net, 1), 4) == 4)
    )
    size = number(net + 2, 2)
    network = based.withColumns(
        {
            "_ip": F.coalesce(is_ip & (net + 20 <= kept), F.lit(False)),
            "_words": number(net, 1).bitwiseAND(15),
            "_proto": number(net + 9, 1),
            "_whole": number(net + 6, 2).bitwiseAND(0x1FFF) == 0,
            # Trailing padding is not payload; a zero length means segmentation offload.
            "_end": F.when(size > 0, F.least(kept, net + size)).otherwise(kept),
        }
    ).withColumn("_top", net + F.greatest(F.col("_words"), F.lit(5)) * 4)
    ip, top, end = F.col("_ip"), F.col("_top"), F.col("_end")
    whole = ip & F.col("_whole")
    transport = network.withColumns(
        {
            "_tcp": F.coalesce(whole & (F.col("_proto") == TCP) & (top + 20 <= end), F.lit(False)),
            "_udp": F.coalesce(whole & (F.col("_proto") == UDP) & (top + 8 <= end), F.lit(False)),
            "_offset": F.shiftright(number(top + 12, 1), 4),
            "_udp_size": number(top + 4, 2),
        }
    )
    tcp, udp, udp_size = F.col("_tcp"), F.col("_udp"), F.col("_udp_size")
    udp_end = F.when(udp_size >= 8, F.least(end, top + udp_size)).otherwise(end)
    payload = (
        F.when(tcp, end - top - F.greatest(F.col("_offset"), F.lit(5)) * 4)
        .when(udp, udp_end - top - 8)
        .otherwise(end - top)
    )

    def address(at: Column) -> Column:
        return F.when(ip, F.concat_ws(".", *[number(at + i, 1) for i in range(4)]))

    fields = {
        "src_ip": address(net + 12),
        "dst_ip": address(net + 16),
        "ip_proto": F.when(ip, F.col("_proto")),
        "ip_ihl": F.when(ip, F.col("_words")),
        "src_port": F.when(tcp | udp, number(top, 2)),
        "dst_port": F.when(tcp | udp, number(top + 2, 2)),
        "tcp_dataofs": F.when(tcp, F.col("_offset")),
        "tcp_flags": F.when(tcp, number(top + 13, 1)),
        "payload_len": F.when(ip, F.greatest(payload, F.lit(0))),
    }
    typed = {f.name: f.dataType for f in PACKET_SCHEMA.fields}
    return transport.select(
        *[c for c in records.columns if c not in ("link", "head")],
        *[e.cast(typed[n]).alias(n) for n, e in fields.items()],
    )


def _capture_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Paths and lengths; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length")
    )


def read_captures(
    spark: SparkSession,
    path: str,
    pattern: str = PATTERN,
    capture_of: Callable[[Column], Column] | None = None,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Packets of all capture files under a folder.

    ``capture_of`` maps the path of a file to its capture; without it every file
    is a capture, named by its full path. The files of a capture, rotated ones
    for instance, follow each other in the order of their paths: packet ids grow
    over (file, place), and a conversation over two files is one. Files of any size are
    read by many tasks. Records after a damaged place are not read, and packets of unknown
    interfaces or link types are left out; ``capture_damage`` lists both.
    """
    places = with_rank(_capture_files(spark, path, pattern), [], ["path"], "file_number")
    files = places.select(
        "path",
        "length",
        (F.col("path") if capture_of is None else capture_of(F.col("path"))).alias("capture_id"),
        ((F.col("file_number") - 1) * F.lit(FILE_SPAN)).alias("first_id"),
    )
    records = read_records(stage_table(files, "files"), split_bytes)
    return header_fields(records).select(*PACKET_SCHEMA.names)


def capture_damage(
    spark: SparkSession, path: str, pattern: str = PATTERN, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Path, offset and reason of every place that cannot be read."""
    ranges = _located(_capture_files(spark, path, pattern), split_bytes)
    return ranges.mapInArrow(_damage_batches, "path string, offset bigint, reason string")
