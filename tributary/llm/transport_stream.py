"""MPEG transport streams as media columns.

``mux`` wraps a byte payload into 188-byte transport packets: a program association table
and a program map table before each random-access point, then one elementary packet with a
presentation timestamp for each access unit.  ``demux`` reads transport streams: it parses
the program tables, checks continuity counters, reassembles elementary packets and lists
timestamps and random-access points.  Lost, repeated and damaged packets are counted; a unit
that misses some is marked and left out, and reading goes on at the next start.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_id, slices, stored, utf8_list, whole_text

# Fixed values of the format.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID = 0x0000, 0x1000, 0x0100
PRIVATE_STREAM, PRIVATE_DATA = 0xBD, 0x06
CLOCK = 90_000
#: Elementary packets without a header of flags: map, padding, private 2, ECM, EMM, DSMCC, H.222.1 E, directory.
HEADLESS = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}
PADDING = 0xBE


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ x]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


_PAT = _section(0x00, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(
    0x02, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
)


def _table_packet(pid: int, counter: int, section: bytes) -> np.ndarray:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 255, 0x01 | pts << 1 & 0xFE])


def mux(payload: bytes, unit: int = 1920, gop: int = 12, rate: int = 25) -> bytes:
    """Transport stream of ``payload``, cut into access units of ``unit`` bytes, every
    ``gop``-th of them a random-access point."""
    out: list[np.ndarray] = []
    counter = 0
    for k, at in enumerate(range(0, len(payload), unit)):
        if k % gop == 0:
            out += [_table_packet(PAT_PID, k // gop, _PAT)[None], _table_packet(PMT_PID, k // gop, _PMT)[None]]
        piece = payload[at : at + unit]
        pts = k * CLOCK // rate & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(piece) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + piece
        data = np.frombuffer(pes, np.uint8)
        # A random-access unit's first packet starts with an adaptation field: flag and clock.
        lead = b""
        if k % gop == 0:
            base = pts << 15 | 0x7E00
            lead = b"\x07\x50" + base.to_bytes(6, "big")
        room = 184 - len(lead)
        n = 1 + max(0, -(-(len(data) - room) // 184))
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1] = ES_PID >> 8
        packets[0, 1] |= 0x40
        packets[:, 2] = ES_PID & 255
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        full = n - 1
        if full:
            packets[0, 4 + len(lead) :] = data[:room]
            packets[1:full, 4:] = data[room : room + (full - 1) * 184].reshape(-1, 184)
        if lead:
            packets[0, 3] |= 0x20
            packets[0, 4 : 4 + len(lead)] = np.frombuffer(lead, np.uint8)
        rest = data[room + (full - 1) * 184 :] if full else data
        stuff = 184 - len(rest) - (len(lead) if not full else 0)
        tail = packets[-1]
        if stuff and lead and not full:  # lengthen the field that is there
            tail[4] += stuff
            tail[4 + len(lead) : PACKET - len(rest)] = 255
        elif stuff:
            tail[3] |= 0x20
            tail[4 : 4 + stuff] = 255
            tail[4] = stuff - 1
            if stuff > 1:
                tail[5] = 0
        tail[PACKET - len(rest) :] = rest
        out.append(packets)
    return np.concatenate(out).tobytes() if out else b""


@lru_cache(maxsize=4096)
def intact(section: bytes) -> bool:
    return not crc32_mpeg(section)


@dataclass
class Elementary:
    """One elementary stream: bytes of its whole access units, and for each of those the
    timestamp (None where it states none) and whether it is a random-access point."""

    program: int
    pid: int
    kind: int
    payload: bytes = b""
    pts: list[int | None] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)
    damaged_units: int = 0


@dataclass
class Stream:
    """What a transport stream holds, and what is wrong with it."""

    streams: list[Elementary] = field(default_factory=list)
    packets: int = 0
    programs: int = 0
    continuity_errors: int = 0
    repeats: int = 0
    error_packets: int = 0
    lost_bytes: int = 0
    damaged_tables: int = 0

    @property
    def status(self) -> str:
        """``ok``, or all that is wrong."""
        found = [
            ("no packets", not self.packets), ("no program", not self.streams), ("lost sync", self.lost_bytes), ("error packets", self.error_packets),
            ("damaged tables", self.damaged_tables), ("lost packets", self.continuity_errors), ("damaged units", sum(e.damaged_units for e in self.streams)),
        ]
        return "; ".join(name for name, bad in found if bad) or "ok"


def packets_of(stream: bytes) -> tuple[np.ndarray, int]:
    """Whole packets, and bytes that belong to none: where the sync byte is lost, reading
    goes on at the next that another one, or the end, follows a packet later."""
    whole = np.frombuffer(stream, np.uint8, len(stream) // PACKET * PACKET).reshape(-1, PACKET)
    if len(stream) % PACKET == 0 and (whole[:, 0] == SYNC).all():
        return whole, 0
    at, found = 0, []
    while at + PACKET <= len(stream):
        if stream[at] != SYNC:
            at = stream.find(SYNC, at + 1)
            while at >= 0 and at + PACKET < len(stream) and stream[at + PACKET] != SYNC:
                at = stream.find(SYNC, at + 1)
            if at < 0:
                break
            continue
        found.append(stream[at : at + PACKET])
        at += PACKET
    return np.frombuffer(b"".join(found), np.uint8).reshape(-1, PACKET), len(stream) - PACKET * len(found)


class _Packets:
    """The packets of a stream by pid, without repeats and those marked as errors."""

    def __init__(self, stream: bytes, out: Stream):
        p, out.lost_bytes = packets_of(stream)
        out.packets = len(p)
        wrong = p[:, 1] & 0x80 != 0
        out.error_packets = int(wrong.sum())
        self.p, self.out = p[~wrong], out
        p = self.p
        self.pid = (p[:, 1].astype(np.int32) & 31) << 8 | p[:, 2]
        self.start, control, self.counter = p[:, 1] & 0x40 != 0, p[:, 3] >> 4 & 3, (p[:, 3] & 15).astype(np.int32)
        self.begin = np.minimum(PACKET, 4 + np.where(control & 2, p[:, 4].astype(np.int32) + 1, 0))
        self.has = control & 1 != 0
        flags = np.where((control & 2 != 0) & (p[:, 4] > 0), p[:, 5], 0)
        self.random, self.jumps = flags & 0x40 != 0, flags & 0x80 != 0

    def of(self, pid: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a pid's packets, and before which of them some are missing."""
        at = np.flatnonzero((self.pid == pid) & self.has)
        again = np.zeros(len(at), bool)
        same = np.flatnonzero(self.counter[at[1:]] == self.counter[at[:-1]]) + 1
        again[same] = (self.p[at[same]] == self.p[at[same - 1]]).all(1)
        self.out.repeats += int(again.sum())
        at = at[~again]
        gap = np.zeros(len(at), bool)
        gap[1:] = ((self.counter[at[1:]] - self.counter[at[:-1]]) % 16 != 1) & ~self.jumps[at[1:]]
        self.out.continuity_errors += int(gap.sum())
        return at, gap

    def sections(self, pid: int) -> list[bytes]:
        """Whole table sections of a pid, which may begin and end anywhere in packets."""
        at, gap = self.of(pid)
        found: dict[bytes, None] = {}
        held: bytes | None = None

        def taken(data: bytes) -> bytes | None:
            while len(data) >= 3 and data[0] != 0xFF:
                n = 3 + ((data[1] & 15) << 8 | data[2])
                if len(data) < n:
                    return data
                if intact(data[:n]):
                    found[data[:n]] = None
                else:
                    self.out.damaged_tables += 1
                data = data[n:]
            return data if data and data[0] != 0xFF else None

        for i, lost in zip(at.tolist(), gap.tolist()):
            data = self.p[i, self.begin[i] :].tobytes()
            if lost:
                held = None
            if self.start[i] and data:
                if held is not None:
                    taken(held + data[1 : 1 + data[0]])
                held = taken(data[1 + data[0] :])
            elif held is not None:
                held = taken(held + data)
        return list(found)

    def units(self, e: Elementary) -> None:
        """Reassembles an elementary stream's packets."""
        at, gap = self.of(e.pid)
        first = np.flatnonzero(self.start[at])
        if len(at) and (not len(first) or first[0]):
            e.damaged_units += 1  # its start is missing
        if not len(first):
            return
        at, gap = at[first[0] :], gap[first[0] :]
        q, begin, start = self.p[at], self.begin[at], self.start[at]
        data = q[np.arange(PACKET) >= begin[:, None]].tobytes()
        size = PACKET - begin
        place = (np.cumsum(size) - size)[start]
        number = np.cumsum(start) - 1
        broken = np.zeros(len(place), bool)
        broken[number[gap & ~start]] = True
        unsure = np.zeros(len(place), bool)  # what follows is missing, maybe of this unit
        unsure[number[gap & start] - 1] = True
        pieces = []
        for a, b, bad, open_, point in zip(place.tolist(), [*place[1:].tolist(), len(data)], broken.tolist(), unsure.tolist(), self.random[at][start].tolist()):
            unit = data[a:b]
            length = unit[4] << 8 | unit[5] if len(unit) >= 6 else -1
            plain = len(unit) >= 6 and unit[3] in HEADLESS
            if bad or unit[:3] != b"\0\0\1" or length + 6 != len(unit) and (length or open_) or not plain and (len(unit) < 9 or len(unit) < 9 + unit[8]):
                e.damaged_units += 1
                continue
            if unit[3] == PADDING:
                continue
            stamp = None
            if not plain and unit[7] & 0x80 and unit[8] >= 5:
                s = unit[9:14]
                stamp = (s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1
            e.pts.append(stamp)
            e.random_access.append(point)
            pieces.append(unit[6 if plain else 9 + unit[8] :])
        e.payload = b"".join(pieces)


def demux(stream: bytes) -> Stream:
    """All elementary streams of all programs, in the order of the tables."""
    out = Stream()
    packets = _Packets(stream, out)
    programs = {}
    for s in packets.sections(PAT_PID):
        if s[0] == 0x00 and s[5] & 1:  # in force now
            programs |= {s[i] << 8 | s[i + 1]: (s[i + 2] & 31) << 8 | s[i + 3] for i in range(8, len(s) - 4, 4)}
    programs.pop(0, None)  # the network's own
    out.programs = len(programs)
    for pid in dict.fromkeys(programs.values()):
        for s in packets.sections(pid):
            if s[0] != 0x02 or not s[5] & 1 or programs.get(number := s[3] << 8 | s[4]) != pid:
                continue
            i = 12 + ((s[10] & 15) << 8 | s[11])
            while i + 5 <= len(s) - 4:
                e = Elementary(number, (s[i + 1] & 31) << 8 | s[i + 2], s[i])
                if all((x.program, x.pid) != (e.program, e.pid) for x in out.streams):
                    out.streams.append(e)
                i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
    for e in out.streams:
        packets.units(e)
    return out


def padded(text: bytes, multiple: int = 192) -> bytes:
    """Spaces up to a positive multiple."""
    return text.ljust(max(1, -(-len(text) // multiple)) * multiple, b" ")


def store_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8, padded, as a transport stream, written as a
    table in the shared folder.  Null texts count as empty, ids that are no numbers as null;
    other columns are not read."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", 256):
            texts = utf8_list(b.column("_text"))
            media = [mux(padded(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["_id", "n_bytes", "media"]
            )

    rows = docs.select(row_id(docs, id_col).alias("_id"), whole_text(text_col).alias("_text"))
    return stored(rows.mapInArrow(build, "_id long, n_bytes long, media binary"), "streams").withColumnRenamed("_id", id_col)


def stream_features(streams: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Reads stored streams: payload figures and digests of the first elementary stream, the
    transport stream's own, timestamps (90 kHz) of all access units and of the random-access
    points among them, and a status.  A damaged stream, and a null one, gives a row with what
    could be read and a status that says what is wrong."""
    schema = "_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access_pts array<long>, status string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_media", 256):
            rows = []
            for one, size, media in zip(b.column("_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("_media").to_pylist()):
                media = media or b""
                d = demux(media)
                e = d.streams[0] if d.streams else Elementary(0, 0, 0)
                data = e.payload
                points = [t for t, r in zip(e.pts, e.random_access) if r]
                feature = f"programs={d.programs};streams={len(d.streams)};packets={d.packets};units={len(e.pts)};random_access={len(points)};last_pts={e.pts[-1] if e.pts else None};continuity_errors={d.continuity_errors};repeats={d.repeats};damaged={e.damaged_units}"
                rows.append((one, size, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, e.pts, points, d.status))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return streams.select(F.col(id_col).alias("_id"), "n_bytes", F.col(media_col).alias("_media")).mapInArrow(read, schema).withColumnRenamed("_id", id_col)
