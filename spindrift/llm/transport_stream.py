"""Media columns: MPEG transport streams.

``write_stream`` packs a payload into 188-byte packets: a program association
table, a program map table and packetised elementary stream (PES) packets with
presentation times, continuity counters, clock references and random-access
flags. ``read_stream`` parses the tables with their CRCs, checks the counters,
reassembles the elementary packets and lists times and random-access points.
Both work on arrays of packets, not byte by byte.

The payload of a text is its UTF-8 followed by zeros up to a positive multiple
of 64 bytes, carried as 8-bit units, so the round trip is lossless. A null text
counts as empty (64 zeros). Equal texts give equal streams.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PACKET, BODY = 188, 184
#: Fixed values of the format: sync byte, packet identifiers, stream type of private data, stream id.
SYNC, PAT_PID, PMT_PID, DATA_PID, PRIVATE, STREAM_ID, PROGRAM = 0x47, 0, 0x100, 0x101, 0x06, 0xBD, 1
#: Bytes of payload in an elementary packet; 90 kHz ticks between two; every so many start a random-access point.
UNIT, TICKS, KEY_EVERY = 32_768, 3_600, 4


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 1 << 31 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2, most significant bit first."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(t: int) -> bytes:
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, 1 | t >> 14 & 0xFE, t >> 7 & 0xFF, 1 | t << 1 & 0xFE])


def _unstamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def write_stream(payload: bytes) -> bytes:
    """One program with one elementary stream that carries ``payload``."""
    parts, count = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, t = payload[at : at + UNIT], k * TICKS
        length = len(unit) + 8
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (length if length < 65_536 else 0).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(t) + unit
        # first packet: adaptation field with clock reference; last one: stuffing
        clock = (t << 15 | 0x7E00).to_bytes(6, "big")
        field = bytes([7, 0x50 if k % KEY_EVERY == 0 else 0x10]) + clock
        room = BODY - len(field)
        if len(pes) < room:
            field = bytes([7 + room - len(pes)]) + field[1:] + b"\xff" * (room - len(pes))
        lead, rest = pes[: BODY - len(field)], pes[BODY - len(field) :]
        parts.append(bytes([SYNC]) + (0x4000 | DATA_PID).to_bytes(2, "big") + bytes([0x30 | count]) + field + lead)
        whole, tail = divmod(len(rest), BODY)
        if whole:
            block = np.empty((whole, PACKET), dtype=np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            block[:, 3] = 0x10 | (count + 1 + np.arange(whole)) % 16
            block[:, 4:] = np.frombuffer(rest, np.uint8, whole * BODY).reshape(whole, BODY)
            parts.append(block.tobytes())
        if tail:
            gap = BODY - tail
            stuff = bytes([gap - 1]) + (b"\0" + b"\xff" * (gap - 2) if gap > 1 else b"")
            parts.append(bytes([SYNC]) + DATA_PID.to_bytes(2, "big") + bytes([0x30 | (count + 1 + whole) % 16]) + stuff + rest[whole * BODY :])
        count = (count + 1 + whole + (tail > 0)) % 16
    return b"".join(parts)


class Stream(NamedTuple):
    payload: bytes
    programs: dict[int, int]
    streams: dict[int, int]
    packets: int
    discontinuities: int
    times: list[int]
    access_points: list[tuple[int, int]]  # (packet number, time)


def _tables(packets: np.ndarray, pids: np.ndarray, pid: int) -> list[bytes]:
    out = []
    for row in packets[(pids == pid) & (packets[:, 1] & 0x40 > 0)]:
        data = row.tobytes()[4:]
        data = data[1 + data[0] :]
        size = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
        if section_crc(data[:size]):
            raise ValueError("a table's CRC is wrong")
        out.append(data[:size])
    return out


def read_stream(media: bytes) -> Stream:
    """Parse a transport stream with one data stream; damaged tables or sync bytes are errors."""
    if len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("a sync byte is missing")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    programs, streams = {}, {}
    for section in _tables(packets, pids, PAT_PID):
        for i in range(8, len(section) - 4, 4):
            programs[int.from_bytes(section[i : i + 2], "big")] = int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF
    for pid in programs.values():
        for section in _tables(packets, pids, pid):
            i = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
            while i < len(section) - 4:
                streams[int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF] = section[i]
                i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0xFFF)
    data_pid = min(streams)
    at = np.flatnonzero(pids == data_pid)
    own = packets[at]
    control = own[:, 3] >> 4 & 3
    counters = own[:, 3][control & 1 > 0] & 15
    breaks = int(((counters[1:] - counters[:-1]) % 16 != 1).sum())
    begin = np.where(control & 2 > 0, 5 + own[:, 4].astype(np.int32), 4)
    keep = np.arange(PACKET)[None, :] >= begin[:, None]
    body = own[keep].tobytes()  # all payload bytes in order
    sizes = PACKET - begin
    places = np.cumsum(sizes) - sizes
    opening = np.flatnonzero(own[:, 1] & 0x40)
    keyed = (control & 2 > 0) & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    parts, times, points = [], [], []
    for j, o in enumerate(opening):
        a, b = int(places[o]), int(places[opening[j + 1]]) if j + 1 < len(opening) else len(body)
        if body[a : a + 3] != b"\0\0\1":
            raise ValueError("an elementary packet's start code is missing")
        head, declared = 9 + body[a + 8], int.from_bytes(body[a + 4 : a + 6], "big")
        if declared and declared + 6 != b - a:
            raise ValueError("an elementary packet's length is wrong")
        times.append(_unstamp(body[a + 9 : a + 14]))
        parts.append(body[a + head : b])
        if keyed[o]:
            points.append((int(at[o]), times[-1]))
    return Stream(b"".join(parts), programs, streams, len(packets), breaks, times, points)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media: bool = True) -> DataFrame:
    """Per text: id, sizes, digests, feature (JSON), times of its units, access points and, with ``media``, the stream."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, times array<bigint>, access_packet array<bigint>, access_time array<bigint>"
    if media:
        schema += ", media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = []
                for text in part.column(1):
                    raw = (text.as_py() or "").encode()
                    stored = write_stream(payload_of(raw))
                    got = read_stream(stored)
                    if got.discontinuities:
                        raise ValueError("a continuity counter is wrong")
                    gain = np.bincount(np.frombuffer(got.payload, np.uint8) >> 5, minlength=8)
                    feature = {"packets": got.packets, "programs": got.programs, "streams": got.streams, "units": len(got.times), "last_time": got.times[-1], "access_points": len(got.access_points), "discontinuities": got.discontinuities, "byte_bands": gain.tolist()}
                    row = [len(raw), len(got.payload), hashlib.sha256(got.payload).hexdigest(), zlib.crc32(got.payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), json.dumps(feature, sort_keys=True), got.times, [p for p, _ in got.access_points], [t for _, t in got.access_points]]
                    rows.append([*row, stored] if media else row)
                names = [x.strip().split(" ")[0] for x in schema.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
