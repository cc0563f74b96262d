"""Byte ranges of capture files: finding record boundaries, and walking over records.

Both common formats are read: the one of plain records and the newer one of typed
blocks. Nothing here needs a whole file: a walk goes from one record boundary to the
first one at or behind the end of its range, a window of bytes at a time.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

# File magics (little-endian value) -> ticks per second.
MAGICS = {0xA1B2C3D4: 1_000_000, 0xA1B23C4D: 1_000_000_000}
# Block types of the newer format, its byte order mark, and the option
# that holds the time resolution.
SECTION, INTERFACE, SIMPLE_PACKET, PACKET = 0x0A0D0D0A, 1, 3, 6
ORDER_MARK, RESOLUTION_OPTION = 0x1A2B3C4D, 9
# Link type -> bytes before the network header.
LINK_HEADER = {0: 4, 1: 14, 12: 0, 101: 0, 108: 4, 113: 16}
ETHERNET, VLAN, IPV4 = 1, 0x8100, 0x0800
TCP, UDP = 6, 17
FILE_HEADER = 24
# Bytes of a frame that hold all header fields: link, tag, longest network header, transport.
HEAD = 16 + 4 + 60 + 20
WINDOW = 8 << 20
# Records in a row that must look right before a place counts as a boundary.
CHAIN = 12
LARGEST = 1 << 24


def file_system(path: str):
    """Arrow file system and the path in it, for local paths and URIs."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class CaptureFile:
    """Bytes of a file, a window at a time; those behind ``size`` do not count."""

    def __init__(self, path: str, size: int | None = None):
        files, name = file_system(path)
        self.path = path
        self.file = files.open_input_file(name)
        self.size = self.file.size() if size is None else size
        self.base, self.data = 0, b""
        start = self.take(0, FILE_HEADER)
        head = self.data[start : start + FILE_HEADER]
        self.blocks, self.order, self.per_micro, self.link, self.problem = False, "<", 1, None, None
        if len(head) < FILE_HEADER:
            self.problem = (0, "file header is cut")
        elif struct.unpack_from("<I", head)[0] == SECTION:
            self.blocks, self.first = True, 0
            self.order = _section_order(head, 0)
        else:
            self._plain_header(head)

    def _plain_header(self, head: bytes) -> None:
        self.first = FILE_HEADER
        for order in "<>":
            magic = struct.unpack_from(order + "I", head)[0]
            if magic in MAGICS:
                self.order, self.per_micro = order, MAGICS[magic] // 1_000_000
                self.link = struct.unpack_from(order + "I", head, 20)[0] & 0xFFFF
                if self.link not in LINK_HEADER:
                    self.problem = (20, f"unsupported link type {self.link}")
                return
        self.problem = (0, "not a packet capture")

    def take(self, offset: int, n: int) -> int:
        """Place in ``data`` of ``n`` bytes at ``offset``; fewer at the end."""
        n = min(n, self.size - offset)
        if offset < self.base or offset + n > self.base + len(self.data):
            size = min(max(n, WINDOW), self.size - offset)
            self.base, self.data = offset, self.file.read_at(size, offset)
        return offset - self.base

    def close(self) -> None:
        self.file.close()


def _section_order(data: bytes, at: int) -> str:
    return "<" if struct.unpack_from("<I", data, at + 8)[0] == ORDER_MARK else ">"


@dataclass
class Walk:
    """Result of a walk: where it ended, what is damaged there, and what was defined."""

    exit: int
    order: str
    damage: str | None = None
    # (place, order, link, ticks per second); a section has no link and ends earlier ones.
    definitions: list[tuple] = field(default_factory=list)
    # (place, reason) of packets that are left out.
    skipped: list[tuple] = field(default_factory=list)


def interfaces_at(definitions, place: int) -> list[tuple]:
    """(link, ticks per second) of the interfaces that hold at a place."""
    held: list[tuple] = []
    for at, _, link, per_second in definitions:
        if at >= place:
            break
        if link is None:
            held = []
        else:
            held.append((link, per_second))
    return held


def walk(file: CaptureFile, at: int, stop: int, order: str, interfaces=None, emit=None) -> Walk:
    """Walk the records that start in [at, stop), where ``at`` is a boundary.

    ``emit`` gets (offset, microseconds, length, link, first bytes) of each packet.
    Without ``interfaces`` and ``emit`` only boundaries and definitions are read.
    """
    if file.blocks:
        return _walk_blocks(file, at, stop, order, interfaces, emit)
    return _walk_plain(file, at, stop, emit)


def _walk_plain(file: CaptureFile, at: int, stop: int, emit) -> Walk:
    unpack = struct.Struct(file.order + "IIII").unpack_from
    per_micro, link, limit = file.per_micro, file.link, file.size
    while at < stop:
        if at + 16 > limit:
            return Walk(at, file.order, "record header is cut")
        place = file.take(at, 16 + HEAD)
        seconds, fraction, kept, _ = unpack(file.data, place)
        if at + 16 + kept > limit:
            return Walk(at, file.order, "record is cut")
        if emit:
            head = file.data[place + 16 : place + 16 + min(kept, HEAD)]
            emit((at, seconds * 1_000_000 + fraction // per_micro, kept, link, head))
        at += 16 + kept
    return Walk(at, file.order)


def _resolution(data: bytes, at: int, end: int, order: str) -> int:
    """Ticks per second of an interface: a power of ten or of two, a million by default."""
    while at + 4 <= end:
        code, size = struct.unpack_from(order + "HH", data, at)
        if code == RESOLUTION_OPTION and size:
            value = data[at + 4]
            return 2 ** (value & 127) if value & 128 else 10**value
        if code == 0:
            break
        at += 4 + size + (-size % 4)
    return 1_000_000


def _walk_blocks(file: CaptureFile, at: int, stop: int, order: str, interfaces, emit) -> Walk:
    held, result = list(interfaces or []), Walk(at, order)
    limit = file.size
    while at < stop:
        result.exit = at
        if at + 12 > limit:
            result.damage = "block header is cut"
            return result
        place = file.take(at, 28 + HEAD)
        kind = struct.unpack_from(order + "I", file.data, place)[0]
        if kind == SECTION:
            order = result.order = _section_order(file.data, place)
            held = []
            result.definitions.append((at, order, None, None))
        size = struct.unpack_from(order + "I", file.data, place + 4)[0]
        if size < 12 or at + size > limit:
            result.damage = "block is cut"
            return result
        if size < {INTERFACE: 20, PACKET: 32, SIMPLE_PACKET: 16}.get(kind, 12):
            result.skipped.append((at, "block is too short"))
        elif kind == INTERFACE:
            place = file.take(at, size)
            link = struct.unpack_from(order + "H", file.data, place + 8)[0]
            ticks = _resolution(file.data, place + 16, place + size - 4, order)
            held.append((link, ticks))
            result.definitions.append((at, order, link, ticks))
        elif emit and kind in (PACKET, SIMPLE_PACKET):
            _block_packet(file, at, place, size, kind, order, held, emit, result)
        at += size
    result.exit = at
    return result


def _block_packet(file, at, place, size, kind, order, held, emit, result) -> None:
    data = file.data
    if kind == PACKET:
        number, high, low, kept, _ = struct.unpack_from(order + "IIIII", data, place + 8)
        body = 28
    else:
        # No time of its own: at the start of the epoch.
        number, high, low, body = 0, 0, 0, 12
        kept = min(struct.unpack_from(order + "I", data, place + 8)[0], size - 16)
    if number >= len(held):
        result.skipped.append((at, f"unknown interface {number}"))
        return
    link, per_second = held[number]
    if link not in LINK_HEADER:
        result.skipped.append((at, f"unsupported link type {link}"))
    elif body + kept > size - 4:
        result.skipped.append((at, "packet is cut"))
    else:
        micros = (high << 32 | low) * 1_000_000 // per_second
        head = data[place + body : place + body + min(kept, HEAD)]
        emit((at, micros, kept, link, head))


def _numbers(data: bytes, order: str) -> np.ndarray:
    """The 32-bit number at every byte place."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    parts = (b[:-3], b[1:-2], b[2:-1], b[3:])
    if order == ">":
        parts = parts[::-1]
    return parts[0] | parts[1] << 8 | parts[2] << 16 | parts[3] << 24


def find_boundary(file: CaptureFile, low: int, high: int) -> int | None:
    """First place in [low, high) that looks like a record boundary.

    Headers there and behind it must follow each other plausibly ``CHAIN`` times or
    up to the end. Payload can look so too: the caller checks the place against the
    walk of the range before.
    """
    step = 1 << 20
    for start in range(low, high, step):
        end = min(start + step, high)
        data = file.file.read_at(min(end + 16, file.size) - start, start)
        if len(data) < 16:
            return None
        number = _numbers(data, file.order)
        if file.blocks:
            aligned = np.arange(-start % 4, len(number) - 4, 4)
            size = number[aligned + 4]
            good = aligned[(size % 4 == 0) & (size >= 12) & (size <= LARGEST)]
        else:
            n = len(number) - 12
            fraction, kept, whole = (number[k : k + n] for k in (4, 8, 12))
            good = np.flatnonzero(
                (fraction < file.per_micro * 1_000_000) & (kept <= whole) & (whole <= LARGEST)
            )
        for place in good.tolist():
            if start + place < end and _chain(file, start + place):
                return start + place
    return None


def _chain(file: CaptureFile, at: int) -> bool:
    earlier = None
    for _ in range(CHAIN):
        if at == file.size:
            return True
        if at + 16 > file.size:
            return False
        place = file.take(at, 16)
        if file.blocks:
            size = struct.unpack_from(file.order + "I", file.data, place + 4)[0]
            if size < 12 or size % 4 or size > LARGEST or at + size > file.size:
                return False
            place = file.take(at + size - 4, 4)
            if struct.unpack_from(file.order + "I", file.data, place)[0] != size:
                return False
            at += size
            continue
        seconds, fraction, kept, whole = struct.unpack_from(file.order + "IIII", file.data, place)
        late = earlier is not None and abs(seconds - earlier) > 86_400
        if fraction >= file.per_micro * 1_000_000 or not kept <= whole <= LARGEST or late:
            return False
        earlier = seconds
        at += 16 + kept
        if at > file.size:
            return False
    return True
