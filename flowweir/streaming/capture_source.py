"""Capture files that still grow, as a stream.

An offset says for every file the boundary behind its last whole record, so a record that
is only half written waits for the next batch and none is read twice. Boundaries are
found by a walk over record headers; the records are read by tasks, a byte range each.
"""

from __future__ import annotations

import json
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from flowweir.schema import PACKET_SCHEMA
from flowweir.sources.capture_files import FILE_HEADER, CaptureFile, file_system, walk
from flowweir.sources.captures import FILE_SPAN, RECORD, header_fields, range_walks, record_batch

FORMAT = "capture_records"
SPLIT_BYTES = 64 << 20
# What opening a file counts as when ranges are put together, as Spark counts it.
OPEN_BYTES = 4 << 20


class CaptureRanges(InputPartition):
    """The byte ranges of one task."""

    def __init__(self, ranges: list):
        self.ranges = ranges


class CaptureRange:
    """Records of [low, high) of one file; both are boundaries."""

    def __init__(self, path: str, low: int, high: int, order: str, held: list, first_id: int):
        self.path, self.low, self.high = path, low, high
        self.order, self.held, self.first_id = order, held, first_id


def _pack(held) -> str:
    return ",".join(f"{link}:{ticks}" for link, ticks in held)


def _unpack(text: str) -> list[tuple[int, int]]:
    return [tuple(map(int, pair.split(":"))) for pair in text.split(",") if pair]


def _after(definitions, held) -> list[tuple[int, int]]:
    """Interfaces that hold after these definitions."""
    for _, _, link, ticks in definitions:
        held = [] if link is None else [*held, (link, ticks)]
    return held


class CaptureStreamReader(DataSourceStreamReader):
    """Options: ``path`` (folder), ``progress`` (folder of its own), ``patterns`` (by comma),
    ``splitBytes``.

    What is known of each file, its number included, is kept in ``progress``, written before
    an offset is given out: a restart goes on from there, and a lost or older
    progress costs a walk over more headers. A file that is deleted leaves the offsets.
    """

    def __init__(self, options):
        self.folder = options["path"]
        self.progress = options["progress"]
        self.patterns = options.get("patterns", "*.pcap,*.pcapng,*.cap").split(",")
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.known: dict[str, dict] | None = None
        self.marks: dict[str, list[tuple]] = {}

    def __getstate__(self) -> dict:
        """Tasks get the reader without what it knows of every file: they need their ranges only."""
        return {**self.__dict__, "known": None, "marks": {}}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        known = self._load() if self.known is None else self.known
        found, number = {}, max((f["number"] for f in known.values()), default=-1)
        for path, size in self._files():
            state = known.get(path)
            if state is None:
                if size < FILE_HEADER:
                    # Its header is still to be written.
                    continue
                number += 1
                state = {"number": number, "at": 0, "order": "<", "interfaces": ""}
            found[path] = self._advanced(path, size, state)
        if found != known:
            self._store(found)
        self.known = found
        return {"files": found}

    def _advanced(self, path: str, size: int, state: dict) -> dict:
        """The state of a file after its last whole record among the first ``size`` bytes."""
        if size < state["at"]:
            raise ValueError(f"{path}: shorter than what was read of it")
        if size == state["at"]:
            return state
        file = CaptureFile(path, size)
        if file.problem:
            raise ValueError(f"{path}: {file.problem[1]}")
        at, order, held = state["at"], state["order"], _unpack(state["interfaces"])
        if at == 0:
            at, order = file.first, file.order
        marks = self.marks.setdefault(path, [])
        while at < size:
            done = walk(file, at, min(size, at + self.split_bytes), order)
            at, order, held = done.exit, done.order, _after(done.definitions, held)
            if done.damage:
                break
            marks.append((at, order, held))
        file.close()
        return {**state, "at": at, "order": order, "interfaces": _pack(held)}

    def partitions(self, start: dict, end: dict) -> list[CaptureRanges]:
        """Ranges in the order of files, small ones together up to the split size."""
        tasks, filled = [], 0
        for found in self._ranges(start, end):
            cost = found.high - found.low + OPEN_BYTES
            if not tasks or filled + cost > self.split_bytes:
                tasks.append([])
                filled = 0
            tasks[-1].append(found)
            filled += cost
        return [CaptureRanges(ranges) for ranges in tasks]

    def _ranges(self, start: dict, end: dict) -> list[CaptureRange]:
        ranges = []
        for path, state in sorted(end["files"].items()):
            before = start["files"].get(path, {"at": 0, "order": "<", "interfaces": ""})
            low, order, held = before["at"], before["order"], _unpack(before["interfaces"])
            stops = [m for m in self.marks.get(path, []) if low < m[0] < state["at"]]
            stops.append((state["at"], None, None))
            for high, next_order, next_held in stops:
                if low < high:
                    first_id = state["number"] * FILE_SPAN
                    ranges.append(CaptureRange(path, low, high, order, held, first_id))
                low, order, held = high, next_order, next_held
        return ranges

    def read(self, partition: CaptureRanges):
        for part in partition.ranges:
            yield from self._read_range(part)

    def _read_range(self, partition: CaptureRange):
        low, order = partition.low, partition.order
        if low == 0:
            file = CaptureFile(partition.path, partition.high)
            low, order = file.first, file.order
            file.close()
        names = ("at", "order", "link", "per_second")
        row = {
            "path": partition.path,
            "size": partition.high,
            "high": partition.high,
            "entry": low,
            "entry_order": order,
            "known": [dict(zip(names, (-1, order, *held))) for held in partition.held],
        }
        for _, found in range_walks(row):
            if found:
                yield record_batch(found, partition.path, partition.first_id)

    def commit(self, end: dict) -> None:
        for path, state in end["files"].items():
            self.marks[path] = [m for m in self.marks.get(path, []) if m[0] > state["at"]]

    def _files(self) -> list[tuple[str, int]]:
        from pyarrow.fs import FileSelector, FileType

        files, where = file_system(self.folder)
        infos = files.get_file_info(FileSelector(where, recursive=True))
        scheme = self.folder.split("://")[0] + "://" if "://" in self.folder else ""
        if scheme == "file://":
            scheme = ""
        listed = [
            (scheme + i.path, i.size)
            for i in infos
            if i.type == FileType.File and any(fnmatch(i.base_name, p) for p in self.patterns)
        ]
        return sorted(listed)

    def _names(self):
        files, where = file_system(self.progress)
        return files, where, [f"{where}/files.json", f"{where}/files.new"]

    def _load(self) -> dict:
        from pyarrow.fs import FileType

        files, _, names = self._names()
        for info in files.get_file_info(names):
            if info.type == FileType.File:
                with files.open_input_stream(info.path) as stream:
                    return json.loads(stream.read())
        return {}

    def _store(self, known: dict) -> None:
        from pyarrow.fs import FileType

        files, where, (final, new) = self._names()
        files.create_dir(where)
        with files.open_output_stream(new) as stream:
            stream.write(json.dumps(known).encode())
        if files.get_file_info(final).type == FileType.File:
            files.delete_file(final)
        files.move(new, final)


class CaptureSource(DataSource):
    """Records of capture files in a folder, as they grow and are rotated."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return RECORD

    def streamReader(self, schema) -> CaptureStreamReader:
        return CaptureStreamReader(self.options)


def capture_stream(spark: SparkSession, path: str, progress: str, **options) -> DataFrame:
    """Packets of a folder of growing, rotated capture files as a stream.

    ``capture_id`` is the path of the file. Packet ids grow over (file as discovered, place).
    ``progress`` is a folder for this stream alone, beside its checkpoint.
    """
    spark.dataSource.register(CaptureSource)
    reader = spark.readStream.format(FORMAT).option("path", path).option("progress", progress)
    for name, value in options.items():
        reader = reader.option(name, value)
    return header_fields(reader.load()).select(*PACKET_SCHEMA.names)
