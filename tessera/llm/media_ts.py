"""Media columns: MPEG transport streams.

``to_transport_stream`` stores a payload column losslessly: packetised elementary
stream (PES) packets with 33-bit time stamps in 188-byte transport packets, with program
association and map tables, a program clock and random-access marks. ``parse`` reads such
a column back: it parses the tables, finds the elementary streams, checks continuity
counters, reassembles PES packets and returns their payload, time stamps and
random-access points. Both work on whole Arrow columns; packets are NumPy rows, so the
work for one is a few vector operations a stream.

Defined cases: a null or empty payload is stored as 64 zero bytes by the query (the
operator stores an empty payload as tables only); a packet counts if a sync byte follows
it; where none does, the reader goes on at the next sync byte that repeats every 188 bytes
and counts what it skips in lost_bytes; a stream without tables has no payload. A packet
sent twice in a row is legal and taken once; a gap in the counters, a packet that the
demodulator marked as broken and one that is scrambled count in continuity_errors, and no
payload is taken from the latter two. Equal payloads give equal streams.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text, table

PACKET, SYNC = 188, 0x47
PMT_PID, STREAM_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 0x06, 0xBD
ACCESS_UNIT, CLOCK = 16_384, 90_000
#: Time stamps of neighbouring access units differ by a 25th of a second.
TICKS = CLOCK // 25
FIELDS = "payload binary, n_packets long, continuity_errors long, lost_bytes long, pts array<long>, random_access array<long>"
#: Sync bytes in a row, 188 bytes apart, that show where packets begin.
SYNCS = 4


@lru_cache(maxsize=1)
def crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def crc32_mpeg(data: bytes) -> int:
    c, t = 0xFFFFFFFF, crc_table()
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ t[(c >> 24) ^ b]
    return c


def section_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    """One table section in one packet."""
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    section = head + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return packet.ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def tables() -> bytes:
    association = section_packet(0, 0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    programme = section_packet(PMT_PID, 0x02, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")
    return association + programme


def stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    """A transport stream that carries payload as one private elementary stream."""
    out, counter = [tables()], 0
    for k, at in enumerate(range(0, len(payload), ACCESS_UNIT)):
        pts = CLOCK + k * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID])
        unit = payload[at : at + ACCESS_UNIT]
        pes += (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(pts) + unit
        # first packet: adaptation field with random access and the clock
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
        room = PACKET - 4 - 8
        first, rest = pes[:room], pes[room:]
        stuff = room - len(first)
        out.append(bytes([SYNC, 0x40 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0x30 | counter & 15, 7 + stuff, 0x50]) + clock + b"\xff" * stuff + first)
        counter += 1
        whole = len(rest) // (PACKET - 4)
        if whole:
            rows = np.empty((whole, PACKET), np.uint8)
            rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
            rows[:, 3] = 0x10 | (np.arange(counter, counter + whole) & 15)
            rows[:, 4:] = np.frombuffer(rest, np.uint8, whole * (PACKET - 4)).reshape(whole, -1)
            out.append(rows.tobytes())
            counter += whole
        if last := rest[whole * (PACKET - 4) :]:
            stuff = PACKET - 4 - len(last)
            field = b"\x00" if stuff == 1 else bytes([stuff - 1, 0]) + b"\xff" * (stuff - 2)
            out.append(bytes([SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF, 0x30 | counter & 15]) + field + last)
            counter += 1
    return b"".join(out)


def sync_at(data: np.ndarray, at: int) -> int:
    """The first offset from ``at`` on where packets begin; the end if there is none."""
    found = np.flatnonzero(data[at:] == SYNC) + at
    found = found[found + PACKET <= len(data)]
    for k in range(1, SYNCS):
        later = found + k * PACKET
        found = found[(later >= len(data)) | (data[np.minimum(later, len(data) - 1)] == SYNC)]
    return int(found[0]) if len(found) else len(data)


def aligned(stream: bytes) -> tuple[np.ndarray, int]:
    """Packets as rows, and the bytes that belong to none."""
    data = np.frombuffer(stream, np.uint8)
    parts, at, used = [], 0, 0
    while (at := sync_at(data, at)) < len(data):
        rows = data[at : at + (len(data) - at) // PACKET * PACKET].reshape(-1, PACKET)
        # a packet is whole if the next one, or nothing, follows where it ends
        next_sync = np.append(rows[1:, 0] == SYNC, at + rows.size == len(data) or data[min(at + rows.size, len(data) - 1)] == SYNC)
        torn = np.flatnonzero(~next_sync)
        rows = rows[: torn[0]] if len(torn) else rows
        parts.append(rows)
        used += rows.size
        at += rows.size + 1 if len(torn) else rows.size
        if not len(torn):
            break
    return np.concatenate(parts) if parts else np.zeros((0, PACKET), np.uint8), len(data) - used


def sections(rows: np.ndarray):
    """The table sections that one packet id's packets carry, however many packets each takes, if their check sums are right."""
    buffer = None
    for row in rows:
        if not row[3] & 0x10:
            continue
        data = row[5 + int(row[4]) if row[3] & 0x20 else 4 :].tobytes()
        starts = bool(row[1] & 0x40) and len(data) > 0
        if starts:
            before, data = data[1 : 1 + data[0]], data[1 + data[0] :]
            if buffer is not None:
                buffer += before
        elif buffer is not None:
            buffer += data
        for stage in (0, 1):
            while buffer and buffer[0] != 0xFF and len(buffer) >= 3 and len(buffer) >= (end := 3 + ((buffer[1] & 15) << 8 | buffer[2])):
                if crc32_mpeg(buffer[:end]) == 0:
                    yield buffer[:end]
                buffer = buffer[end:]
            if not starts or stage:
                break
            buffer = data


def table_body(rows: np.ndarray, table_id: int) -> bytes:
    """The bodies of a table's sections, in order, of the first version that is complete."""
    parts: dict[tuple[int, int], bytes] = {}
    for section in sections(rows):
        if section[0] == table_id and len(section) >= 12:
            version, number, last = section[5], section[6], section[7]
            parts[version, number] = section[8:-4]
            if all((version, k) in parts for k in range(last + 1)):
                first = [parts[version, k] for k in range(last + 1)]
                return first[0] + b"".join(x[4 + ((x[2] & 15) << 8 | x[3]) :] if table_id == 0x02 and len(x) > 3 else x for x in first[1:])
    return b""


def programmes(rows: np.ndarray, pids: np.ndarray) -> dict[int, int]:
    """Elementary streams of all programs: packet id to stream type."""
    found: dict[int, int] = {}
    association = table_body(rows[pids == 0], 0x00)
    for k in range(0, len(association) - 3, 4):
        if association[k : k + 2] == b"\0\0":
            continue
        body = table_body(rows[pids == ((association[k + 2] & 31) << 8 | association[k + 3])], 0x02)
        at = 4 + ((body[2] & 15) << 8 | body[3]) if len(body) > 3 else 0
        while at + 5 <= len(body) and at:
            found[(body[at + 1] & 31) << 8 | body[at + 2]] = body[at]
            at += 5 + ((body[at + 3] & 15) << 8 | body[at + 4])
    return found


def demux(stream: bytes | None) -> tuple[bytes, int, int, int, list[int], list[int]]:
    """Payload, packets, continuity errors, lost bytes, time stamps, and the payload offsets of random-access points."""
    rows, lost = aligned(stream or b"")
    bad = (rows[:, 1] & 0x80) > 0
    errors, payload, stamps, access, size = int(bad.sum()), [], [], [], 0
    n_packets, rows = len(rows), rows[~bad]
    pids = (rows[:, 1].astype(np.int32) & 31) << 8 | rows[:, 2]
    for pid in programmes(rows, pids):
        own = rows[pids == pid]
        own = own[(own[:, 3] & 0x10) > 0]
        if not len(own):
            continue
        step = np.diff((own[:, 3] & 15).astype(np.int16)) & 15
        repeat = np.append(False, (step == 0) & (own[1:] == own[:-1]).all(axis=1))
        repeat[1:] &= ~repeat[:-1]  # once is legal, twice is not
        own = own[~repeat]
        step = np.diff((own[:, 3] & 15).astype(np.int16)) & 15
        marked = ((own[:, 3] & 0x20) > 0) & (own[:, 4] > 0) & ((own[:, 5] & 0x80) > 0)  # the sender says that the counter starts anew
        errors += int(((step != 1) & ~marked[1:]).sum())
        scrambled = (own[:, 3] & 0xC0) > 0
        errors += int(scrambled.sum())
        own = own[~scrambled]
        if not len(own):
            continue
        adapted = (own[:, 3] & 0x20) > 0
        skip = np.where(adapted, 5 + own[:, 4].astype(np.int32), 4)
        flags = np.where(adapted & (own[:, 4] > 0), own[:, 5], 0)
        begins = np.flatnonzero(own[:, 1] & 0x40)
        for a, b in zip(begins, np.append(begins[1:], len(own)), strict=True):
            plain = own[a:b][skip[a:b] == 4][:, 4:]
            if skip[a] > 4 and len(plain) >= b - a - 2:  # the usual shape: only the first and last packets have an adaptation field
                tail = own[b - 1, skip[b - 1] :].tobytes() if b - 1 > a and skip[b - 1] > 4 else b""
                middle = plain.tobytes() if len(plain) == b - a - 1 - bool(tail) else None
            else:
                tail, middle = b"", None
            if middle is None:
                pes = b"".join(r[s:].tobytes() for r, s in zip(own[a:b], skip[a:b], strict=True))
            else:
                pes = own[a, skip[a] :].tobytes() + middle + tail
            if pes[:3] != b"\0\0\1" or len(pes) < 9:
                errors += 1
                continue
            length = pes[4] << 8 | pes[5]
            if flags[a] & 0x40:
                access.append(size)
            if pes[7] & 0x80:
                p = pes[9:14]
                stamps.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
            unit = pes[9 + pes[8] : 6 + length if length else None]
            payload.append(unit)
            size += len(unit)
    return b"".join(payload), n_packets, errors, lost, stamps, access


def to_transport_stream(df: DataFrame, payload_col: str, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """df with media_col: the binary payload column as transport streams."""
    make = lambda: lambda column: [pa.array([mux(x or b"") for x in column.to_pylist()], pa.binary())]
    return map_text(df, f"`{media_col}` binary", make, payload_col, keep)


def parse(df: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """df with payload, n_packets, continuity_errors, lost_bytes, pts (90 kHz) and random_access (payload offsets)."""

    def make():
        def work(column):
            found = [demux(x) for x in column.to_pylist()]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]

        return work

    return map_text(df, FIELDS, make, media_col, keep)


def padded(text_col: str = "text"):
    """The text as UTF-8 with zero bytes up to a positive multiple of 64; null is empty."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    short = F.greatest(F.lit(64), F.ceil(F.octet_length(raw) / 64) * 64) - F.octet_length(raw)
    return F.concat(raw, F.substring(F.unhex(F.lit("00" * 64)), F.lit(1), short.cast("int")))


def op4_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    payload = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), padded().alias("raw"))
    media = to_transport_stream(payload, "raw", "media", ["doc_id", "n_bytes"])
    back = parse(media, "media", ["doc_id", "n_bytes", "media"])
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("packets="), "n_packets"), F.concat(F.lit("errors="), "continuity_errors"), F.concat(F.lit("pes="), F.size("pts")), F.concat(F.lit("pts="), F.coalesce(F.element_at("pts", 1), F.lit(-1)), F.lit("-"), F.coalesce(F.element_at("pts", -1), F.lit(-1))), F.concat(F.lit("rap="), F.size("random_access"))).alias("feature"),
        "pts",
        "random_access",
    )


QUERIES = {"op4_media_ts": op4_media_ts}
ORACLES: dict = {}
