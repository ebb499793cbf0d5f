"""MPEG transport streams as a media column.

``mux`` stores a payload as the elementary stream of a one-program transport stream (PAT, PMT,
PES packets with presentation timestamps, random-access points with PCR); ``demux`` parses the
program tables, checks continuity counters, reassembles the PES packets and returns the payload
with its timestamps and random-access points.  Both work on whole arrays of 188-byte packets.

Defined results: null text is the empty text (a payload of 64 zero bytes); equal payloads give
equal streams; a damaged stream is reported by counters (sync, continuity, table CRC) and never
raises for bad counters; a stream without a program gives an empty payload.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# Fixed values of the transport stream format.
PACKET = 188
SYNC = 0x47
PAT_PID = 0
STREAM_ID_PRIVATE_1 = 0xBD
STREAM_TYPE_PRIVATE_PES = 0x06
CRC_POLY = 0x04C11DB7

# Our own layout.
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0101, 1
UNIT = 16 * 1024  # payload bytes of a PES packet
GOP = 8  # every so many PES packets a random-access point, with the tables before it
TICKS = 3600  # of the 90 kHz clock between PES packets


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLY if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    section += crc32_mpeg(section).to_bytes(4, "big")
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


@lru_cache(1)
def _tables() -> np.ndarray:
    def section(table_id: int, ident: int, body: bytes) -> bytes:
        return bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0]) + body

    pat = section(0x00, 1, bytes([PROGRAM >> 8, PROGRAM & 0xFF, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))
    pmt = section(0x02, PROGRAM, bytes([0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0, STREAM_TYPE_PRIVATE_PES, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0]))
    return np.stack([_table_packet(PAT_PID, pat), _table_packet(PMT_PID, pmt)])


@lru_cache(1024)
def _layout(size: int, rap: bool) -> tuple[np.ndarray, np.ndarray]:
    """Packets of a PES packet with ``size`` payload bytes, zeroed; flat places of header + payload.

    The first packet carries an adaptation field (random-access flag and PCR) if ``rap``; the
    last one is filled up by adaptation stuffing.
    """
    rest, rows, places, first = size + 14, [], [], True
    while rest:
        head = bytearray([SYNC, (0x40 if first else 0) | ES_PID >> 8, ES_PID & 0xFF, 0x10])
        field = bytearray([7, 0x50, 0, 0, 0, 0, 0, 0]) if first and rap else bytearray()
        spare = PACKET - 4 - len(field) - rest
        if spare > 0:
            if not field:
                field = bytearray([0]) if spare == 1 else bytearray([1, 0])
                spare -= len(field)
            field += b"\xff" * spare
            field[0] = len(field) - 1
        if field:
            head[3] |= 0x20
        take = PACKET - 4 - len(field)
        places.append(np.arange(take) + len(rows) * PACKET + 4 + len(field))
        rows.append(np.frombuffer(bytes(head + field).ljust(PACKET, b"\0"), np.uint8))
        rest -= take
        first = False
    return np.concatenate(rows), np.concatenate(places)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    out, counter = [], 0
    for n, at in enumerate(range(0, max(1, len(payload)), UNIT)):
        unit = payload[at : at + UNIT]
        rap = n % GOP == 0
        pts = n * TICKS & (1 << 33) - 1
        if rap:
            tables = _tables().copy()
            tables[:, 3] |= n // GOP & 15
            out.append(tables.tobytes())
        base, places = _layout(len(unit), rap)
        packets = base.copy()
        length = len(unit) + 8
        packets[places] = np.frombuffer(b"\0\0\1" + bytes([STREAM_ID_PRIVATE_1, length >> 8, length & 0xFF, 0x84 if rap else 0x80, 0x80, 5]) + _stamp(pts) + unit, np.uint8)
        if rap:  # PCR base, as the timestamp; 6 reserved bits; extension 0
            packets[6:12] = np.frombuffer((pts << 15 | 0x3F << 9).to_bytes(6, "big"), np.uint8)
        m = len(packets) // PACKET
        packets[3::PACKET] |= (np.arange(counter, counter + m) & 15).astype(np.uint8)
        counter = counter + m & 15
        out.append(packets.tobytes())
    return b"".join(out)


def _section(packet: np.ndarray) -> tuple[bytes, bool]:
    raw = packet.tobytes()
    at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
    at += 1 + raw[at]
    size = 3 + ((raw[at + 1] & 0x0F) << 8 | raw[at + 2])
    body = raw[at : at + size]
    return body, _crc_ok(body)


@lru_cache(256)
def _crc_ok(section: bytes) -> bool:
    return crc32_mpeg(section) == 0


def demux(media: bytes) -> dict:
    """payload; units: (pts, random_access, payload offset); programs, and counters of faults."""
    whole = len(media) // PACKET
    packets = np.frombuffer(media, np.uint8, whole * PACKET).reshape(whole, PACKET)
    got = {"payload": b"", "units": [], "packets": whole, "pmt_pid": None, "es_pid": None, "stream_type": None, "sync_errors": int((packets[:, 0] != SYNC).sum()) + (len(media) % PACKET > 0), "continuity_errors": 0, "table_errors": 0, "pes_errors": 0}
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    starts = packets[:, 1] & 0x40 > 0
    for p in packets[(pid == PAT_PID) & starts]:
        body, ok = _section(p)
        got["table_errors"] += not ok
        if ok and got["pmt_pid"] is None:
            for i in range(8, len(body) - 4, 4):
                if body[i] << 8 | body[i + 1]:
                    got["pmt_pid"] = (body[i + 2] & 0x1F) << 8 | body[i + 3]
                    break
    if got["pmt_pid"] is None:
        return got
    for p in packets[(pid == got["pmt_pid"]) & starts]:
        body, ok = _section(p)
        got["table_errors"] += not ok
        if ok and got["es_pid"] is None:
            i = 12 + ((body[10] & 0x0F) << 8 | body[11])
            if i + 5 <= len(body) - 4:
                got["stream_type"], got["es_pid"] = body[i], (body[i + 1] & 0x1F) << 8 | body[i + 2]
    if got["es_pid"] is None:
        return got
    for table_pid in (PAT_PID, got["pmt_pid"]):
        c = packets[pid == table_pid, 3] & 15
        got["continuity_errors"] += int(((c[1:].astype(int) - c[:-1]) % 16 != 1).sum())
    es = packets[(pid == got["es_pid"]) & (packets[:, 3] & 0x10 > 0)]
    if not len(es):
        return got
    c = es[:, 3] & 15
    got["continuity_errors"] += int(((c[1:].astype(int) - c[:-1]) % 16 != 1).sum())
    adapted = es[:, 3] & 0x20 > 0
    skip = np.where(adapted, 5 + es[:, 4].astype(np.int32), 4)
    rap = adapted & (es[:, 4] > 0) & (es[:, 5] & 0x40 > 0)
    stream = es[np.arange(PACKET) >= skip[:, None]].tobytes()
    offsets = np.concatenate([[0], np.cumsum(PACKET - np.minimum(skip, PACKET))])
    first = np.flatnonzero(es[:, 1] & 0x40)
    bounds = [*offsets[first].tolist(), int(offsets[-1])]
    parts, at = [], 0
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        size = stream[a + 4] << 8 | stream[a + 5] if b - a >= 9 else 0
        if b - a < 9 or stream[a : a + 3] != b"\0\0\1" or size and size + 6 != b - a:
            got["pes_errors"] += 1
            continue
        t = stream[a + 9 : a + 14]
        pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1 if stream[a + 7] & 0x80 else None
        unit = stream[a + 9 + stream[a + 8] : b]
        got["units"].append((pts, bool(rap[first[k]]), at))
        parts.append(unit)
        at += len(unit)
    got["payload"] = b"".join(parts)
    return got


def padded(data: bytes, block: int = 64) -> bytes:
    return data.ljust(max(1, -(-len(data) // block)) * block, b"\0")


def feature(got: dict, payload: bytes) -> str:
    """What the stream says of itself, and the bytes' mean and spread."""
    x = np.frombuffer(payload, np.uint8)
    stamps = [u[0] for u in got["units"] if u[0] is not None]
    return ";".join([
        f"pmt={got['pmt_pid']}", f"es={got['es_pid']}", f"type={got['stream_type']}", f"packets={got['packets']}", f"pes={len(got['units'])}",
        f"rap={sum(u[1] for u in got['units'])}", f"pts={min(stamps, default=0)}-{max(stamps, default=0)}",
        f"faults={got['sync_errors'] + got['continuity_errors'] + got['table_errors'] + got['pes_errors']}",
        f"mean={int(x.sum(dtype=np.int64)) / max(1, len(x)):.4f}", f"adler={zlib.adler32(payload)}",
    ])


def mux_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary): each text as UTF-8, zero-padded to 64, in a stream."""

    def run(batches):
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < len(texts):
                sizes, media, held, begin = [], [], 0, at
                while at < len(texts) and held < 1 << 22:
                    raw = (texts[at].as_py() or "").encode()
                    sizes.append(len(raw))
                    media.append(mux(padded(raw)))
                    held += len(media[-1])
                    at += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, at - begin), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def store(media: DataFrame) -> DataFrame:
    """The media written as Parquet in the shared folder; the rows that are read from there."""
    return written(media, "media")


def read_media(media: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Parse the ``media`` column: digests, features, timestamps with random-access points, and
    the payload if kept."""
    kept = ["payload binary"] if keep_payload else []
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units array<struct<pts:long,random_access:boolean,at:long>>"

    def run(batches):
        unit = pa.list_(pa.struct([("pts", pa.int64()), ("random_access", pa.bool_()), ("at", pa.int64())]))
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for raw in batch.column(2):
                raw = raw.as_py() or b""
                got = demux(raw)
                p = got["payload"]
                row = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(got, p), [dict(zip(("pts", "random_access", "at"), u, strict=True)) for u in got["units"]], p if keep_payload else None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), unit, pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)][: 8 if keep_payload else 7]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "units", "payload"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=names[: 2 + len(arrays)])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ", ".join([schema, *kept]))
