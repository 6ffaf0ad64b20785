"""MPEG transport streams as media columns.

`mux` makes a stream of 188-byte packets: one private data stream whose access units are packetized elementary packets with
presentation times. Every few units a random-access point carries a clock reference, and the program association and
program map tables stand before it, so that a reader can join there. `demux` reads a stream: it parses all programs of
the tables and their streams, verifies checksums, checks the continuity counters of every packet identifier, tables
included, reassembles the elementary packets of one stream, and keeps times and random-access points. `store` writes the
streams to the shared folder, reads them back with the parser, and describes what it has read.

Defined results: null and empty texts are one padded block; equal texts give equal bytes; repeated rows are stored each;
very long texts are streams of many units, held one at a time; columns of other names are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import materialize, slices, texts_of, tidy

PACKET, PMT_PID, ES_PID, PRIVATE = 188, 0x1000, 0x101, 0x06
#: Bytes of an access unit, 90 kHz ticks between units, units between random-access points.
UNIT, TICKS, RANDOM_EVERY = 19_200, 3_600, 8


@lru_cache(maxsize=64)
def crc32_mpeg(data: bytes) -> int:
    """CRC-32 of program tables: polynomial 0x04C11DB7, all ones first, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def section_packet(pid: int, table_id: int, body: bytes, counter: int = 0) -> bytes:
    section = bytes([table_id]) + (0xB000 | len(body) + 4).to_bytes(2, "big") + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0]) + section).ljust(PACKET, b"\xff")


@lru_cache(maxsize=16)
def tables(counter: int) -> bytes:
    """Both tables, for the time that their counters are at `counter`."""
    pat = section_packet(0, 0, b"\x00\x01\xc1\x00\x00" + b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"), counter)
    pmt = section_packet(PMT_PID, 2, b"\x00\x01\xc1\x00\x00" + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00", counter)
    return pat + pmt


def stamp(pts: int) -> bytes:
    """The 33-bit time in the five bytes of an elementary packet's header."""
    pts &= (1 << 33) - 1
    return bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, 1 | pts >> 14 & 254, pts >> 7 & 255, 1 | pts << 1 & 254])


def unit_packets(data: bytes, pts: int, random: bool, counter: int) -> np.ndarray:
    """The packets of one access unit."""
    length = 8 + len(data)
    pes = b"\x00\x00\x01\xbd" + (length if length < 65_536 else 0).to_bytes(2, "big") + b"\x80\x80\x05" + stamp(pts) + data
    lead = 8 if random else 0  # adaptation field with flags and a clock reference
    n = -(-(len(pes) + lead) // 184)
    out = np.full((n, PACKET), 255, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    body = np.frombuffer(pes, np.uint8)
    spare = n * 184 - lead - len(pes)  # bytes of stuffing, in an adaptation field of the last packet
    first = 184 - lead
    if random:
        clock = pts & (1 << 33) - 1
        head = bytes([7, 0x50]) + (clock << 15 | 0x7E00).to_bytes(6, "big")
    if n == 1:
        field = lead + spare
        if field:
            out[0, 3] |= 0x20
            out[0, 4] = field - 1
            if random:
                out[0, 5:12] = np.frombuffer(head, np.uint8)[1:]
            elif field > 1:
                out[0, 5] = 0
        out[0, 4 + field :] = body
        return out
    if random:
        out[0, 3] |= 0x20
        out[0, 4:12] = np.frombuffer(head, np.uint8)
    out[0, 4 + lead :] = body[:first]
    middle = body[first : first + (n - 2) * 184]
    out[1:-1, 4:] = middle.reshape(n - 2, 184)
    if spare:
        out[-1, 3] |= 0x20
        out[-1, 4] = spare - 1
        if spare > 1:
            out[-1, 5] = 0
    out[-1, 4 + spare :] = body[first + (n - 2) * 184 :]
    return out


def mux(payload: bytes) -> bytes:
    """The stream of a payload, whose length must be positive."""
    out, counter = [], 0
    for k, a in enumerate(range(0, len(payload), UNIT)):
        random = k % RANDOM_EVERY == 0
        if random:
            out.append(tables(k // RANDOM_EVERY & 15))
        packets = unit_packets(payload[a : a + UNIT], k * TICKS, random, counter)
        counter += len(packets)
        out.append(packets.tobytes())
    return b"".join(out)


def section(packet: np.ndarray, table_id: int) -> bytes:
    at = 5 + int(packet[4])
    length = (int(packet[at + 1]) & 15) << 8 | int(packet[at + 2])
    data = packet[at : at + 3 + length].tobytes()
    if data[0] != table_id or crc32_mpeg(data):
        raise ValueError("a program table is damaged")
    return data[8:-4]


def programs(p: np.ndarray, pid: np.ndarray) -> dict[int, tuple[int, list[tuple[int, int]]]]:
    """program number -> (identifier of its map, its streams as (type, identifier)), from the first tables of whole packets."""
    first = np.flatnonzero(pid == 0)
    if not len(first):
        raise ValueError("no program association table")
    association = section(p[first[0]], 0)
    out = {}
    for i in range(0, len(association), 4):
        number, map_pid = int.from_bytes(association[i : i + 2], "big"), int.from_bytes(association[i + 2 : i + 4], "big") & 0x1FFF
        if not number:  # the network's own table
            continue
        at = np.flatnonzero(pid == map_pid)
        if not len(at):
            raise ValueError("no program map table")
        body = section(p[at[0]], 2)
        j, streams = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF), []
        while j < len(body):
            streams.append((body[j], int.from_bytes(body[j + 1 : j + 3], "big") & 0x1FFF))
            j += 5 + (int.from_bytes(body[j + 3 : j + 5], "big") & 0xFFF)
        out[number] = (map_pid, streams)
    return out


def demux(stream: bytes, late: bool = False, stream_pid: int | None = None) -> tuple[bytes, list[int], list[int], dict[str, int]]:
    """(payload, times of its units, indexes of random-access units, counts) of one elementary stream, the first listed if
    none is named. A late reader has joined within the stream and begins at its first random-access point behind the tables.
    Damage raises ValueError."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not whole packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any() or (p[:, 1] & 0x80).any():
        raise ValueError("lost synchronization")
    pid = (p[:, 1].astype(np.int32) & 31) << 8 | p[:, 2]
    if late:
        begin = np.flatnonzero(pid == 0)
        p, pid = (x[begin[0] if len(begin) else 0 :] for x in (p, pid))
    found = programs(p, pid)
    streams = [s for _, own in found.values() for s in own]
    if not streams:
        raise ValueError("no stream")
    stream_type, es_pid = next((s for s in streams if s[1] == stream_pid), streams[0])
    map_pid = next(m for m, own in found.values() if (stream_type, es_pid) in own)
    for one in {0, *(m for m, _ in found.values()), *(s[1] for s in streams)}:
        counter = p[(pid == one) & ((p[:, 3] & 0x10) > 0), 3] & 15  # packets without payload do not count
        gaps = int(((np.diff(counter.astype(np.int16)) & 15) != 1).sum())
        if gaps:
            raise ValueError(f"{gaps} gaps in continuity of {one}")
    for table, at in ((0, 0), *((2, m) for m, _ in found.values())):
        for packet in {x.tobytes() for x in p[pid == at]}:  # every copy of a table is whole
            section(np.frombuffer(packet, np.uint8), table)
    es = p[pid == es_pid]
    adapted = (es[:, 3] & 0x20) > 0
    skip = 4 + np.where(adapted, es[:, 4].astype(np.int64) + 1, 0)
    flags = np.where(adapted & (es[:, 4] > 0), es[:, 5], 0)
    starts = np.flatnonzero(es[:, 1] & 0x40)
    if late:
        starts = starts[np.cumsum(flags[starts] & 0x40) > 0]
    plain = skip == 4
    payload, times, points = [], [], []
    for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(es)])):
        parts, i = [], a
        while i < z:
            if plain[i]:  # a run of packets without adaptation is one copy
                j = i + int(np.argmin(plain[i:z])) if not plain[i:z].all() else z
                parts.append(es[i:j, 4:].tobytes())
                i = j
            else:
                parts.append(es[i, skip[i] :].tobytes())
                i += 1
        pes = b"".join(parts)
        if pes[:3] != b"\x00\x00\x01":
            raise ValueError("not an elementary packet")
        length, header = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
        if length and length + 6 != len(pes):
            raise ValueError("an elementary packet is cut short")
        t = pes[9:14]
        times.append((t[0] & 14) << 29 | t[1] << 22 | (t[2] & 254) << 14 | t[3] << 7 | t[4] >> 1)
        if flags[a] & 0x40:
            points.append(k)
        payload.append(pes[header:])
    return b"".join(payload), times, points, {"packets": len(p), "es_packets": len(es), "pmt_pid": map_pid, "es_pid": es_pid, "stream_type": stream_type, "programs": len(found)}


def padded(raw: bytes, block: int = 192) -> bytes:
    return raw + b" " * (max(block, -(-len(raw) // block) * block) - len(raw))


def describe(times: list[int], points: list[int], counts: dict[str, int]) -> str:
    return f"packets={counts['packets']} programs={counts['programs']} pid={counts['es_pid']} type={counts['stream_type']} units={len(times)} pts={times[0]}..{times[-1]} random_access={','.join(map(str, points))}"


def write_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the stream of each text, stored in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = texts_of(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    d = docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text")
    return materialize(d.mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary"), "media", "zstd")


def read_media(stored: DataFrame, keep_media: bool = False) -> DataFrame:
    """What the parser reads from stored streams: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, units (time and random-access flag of each) and, with keep_media, the stream itself as `media`."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("units", pa.list_(pa.struct([("pts", pa.int64()), ("random_access", pa.bool_())])))] + [("media", pa.binary())] * keep_media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media"):
            rows = []
            for doc, n, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2))):
                payload, times, points, counts = demux(media)
                at = set(points)
                row = (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(times, points, counts), [{"pts": t, "random_access": k in at} for k, t in enumerate(times)])
                rows.append(row + (media,) * keep_media)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return stored.mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units array<struct<pts:long,random_access:boolean>>" + ", media binary" * keep_media)


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_media: bool = True) -> DataFrame:
    """The texts of docs stored as streams and read back."""
    return read_media(write_media(docs, doc_id, text), keep_media)
