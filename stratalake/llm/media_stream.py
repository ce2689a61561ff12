"""MPEG transport streams as a binary column.

`mux` stores a payload as one program: a PAT, a PMT and PES packets of a private data stream, cut into access units
that each start with a random-access point, a PCR and a PTS. `demux` reads the stored bytes: it follows the program
tables to the elementary stream, checks continuity counters and reassembles the PES packets.

Null text counts as empty. Every payload is padded with bytes 0 to a positive multiple of 64, so an empty text gives a
stream of one access unit. Equal texts give equal streams. Extra columns pass through `add_stream` untouched.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, word_texts

# Fixed values of the transport stream format (ISO/IEC 13818-1) and of this layout.
PACKET, SYNC, PAT_PID, PMT_PID, ES_PID = 188, 0x47, 0x0000, 0x1000, 0x0100
PRIVATE_TYPE, PRIVATE_ID, CLOCK_HZ, UNIT_TICKS = 0x06, 0xBD, 90_000, 3_600
UNIT_BYTES = 32_768


class StreamError(ValueError):
    pass


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    head = struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0)
    return (head + section).ljust(PACKET, b"\xff")


PAT = _table_packet(PAT_PID, _section(0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID)))
PMT = _table_packet(PMT_PID, _section(0x02, 1, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE_TYPE, 0xE000 | ES_PID, 0xF000)))


def _pts_bytes(pts: int) -> bytes:
    return bytes((0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, 0x01 | (pts >> 14 & 0xFE), pts >> 7 & 0xFF, 0x01 | (pts << 1 & 0xFE)))


def _pcr_bytes(pts: int) -> bytes:
    return struct.pack(">Q", (pts << 15 | 0x3F << 9) & 0xFFFFFFFFFFFF)[2:]


def _unit_packets(unit: bytes, index: int, counter: int) -> tuple[bytes, int]:
    """One access unit as transport packets; the counter goes on from the last packet."""
    pts = index * UNIT_TICKS & 0x1FFFFFFFF
    pes = struct.pack(">IHBBB", 0x100 | PRIVATE_ID, len(unit) + 8, 0x80, 0x80, 5) + _pts_bytes(pts) + unit
    adapt = b"\x50" + _pcr_bytes(pts)
    room = PACKET - 5 - len(adapt)
    adapt += b"\xff" * max(0, room - len(pes))
    out = [struct.pack(">BHBB", SYNC, 0x4000 | ES_PID, 0x30 | counter, len(adapt)), adapt, pes[:room]]
    rest, counter = pes[room:], counter + 1
    whole, tail = divmod(len(rest), 184)
    if whole:
        grid = np.empty((whole, PACKET), np.uint8)
        grid[:, 0], grid[:, 1], grid[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        grid[:, 3] = 0x10 | (np.arange(counter, counter + whole) & 15)
        grid[:, 4:] = np.frombuffer(rest, np.uint8, whole * 184).reshape(whole, 184)
        out.append(grid.tobytes())
        counter += whole
    if tail:
        fill = 183 - tail
        stuffing = b"\x00" + b"\xff" * (fill - 1) if fill else b""
        out.append(struct.pack(">BHBB", SYNC, ES_PID, 0x30 | (counter & 15), fill) + stuffing + rest[whole * 184 :])
        counter += 1
    return b"".join(out), counter & 15


def padded(text: bytes) -> bytes:
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def mux(payload: bytes) -> bytes:
    out, counter = [PAT, PMT], 0
    for index, start in enumerate(range(0, len(payload), UNIT_BYTES)):
        packets, counter = _unit_packets(payload[start : start + UNIT_BYTES], index, counter)
        out.append(packets)
    return b"".join(out)


def _tables(grid: np.ndarray, pids: np.ndarray) -> tuple[int, int, int]:
    """PMT PID, elementary PID and stream type, followed from the PAT."""

    def section(pid: int) -> bytes:
        found = np.flatnonzero((pids == pid) & (grid[:, 1] & 0x40 > 0))
        if not len(found):
            raise StreamError(f"no table on PID {pid}")
        raw = grid[found[0], 5 + grid[found[0], 4] :].tobytes()
        size = 3 + (struct.unpack(">H", raw[1:3])[0] & 0x0FFF)
        if crc32_mpeg(raw[:size]):
            raise StreamError(f"table on PID {pid} fails its CRC")
        return raw[:size]

    pmt_pid = struct.unpack(">H", section(PAT_PID)[10:12])[0] & 0x1FFF
    pmt = section(pmt_pid)
    skip = 12 + (struct.unpack(">H", pmt[10:12])[0] & 0x0FFF)
    kind, es_pid = struct.unpack(">BH", pmt[skip : skip + 3])
    return pmt_pid, es_pid & 0x1FFF, kind


def demux(media: bytes) -> dict:
    """The payload and what the stream says about itself; raises StreamError on a broken stream."""
    if not media or len(media) % PACKET:
        raise StreamError("not whole transport packets")
    grid = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (grid[:, 0] != SYNC).any():
        raise StreamError("lost sync")
    pids = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    tables = media[: 2 * PACKET]
    pmt_pid, es_pid, kind = _known_tables(tables) if tables == PAT + PMT else _tables(grid, pids)
    rows = grid[pids == es_pid]
    if not len(rows):
        raise StreamError("no elementary packets")
    counters = rows[:, 3].astype(np.int16) & 15
    gaps = int(np.count_nonzero((counters[1:] - counters[:-1]) & 15 != 1))
    starts = rows[:, 1] & 0x40 > 0
    adapted = rows[:, 3] & 0x20 > 0
    points, times, parts, at = 0, [], [], 0
    first = np.flatnonzero(starts)
    if not len(first) or first[0]:
        raise StreamError("does not begin with a PES packet")
    for begin, end in zip(first, [*first[1:], len(rows)]):
        pes = []
        at = begin
        for i in (begin + np.flatnonzero(adapted[begin:end])).tolist():
            if i > at:
                pes.append(rows[at:i, 4:].tobytes())
            size = int(rows[i, 4])
            points += bool(size and rows[i, 5] & 0x40)
            pes.append(rows[i, 5 + size :].tobytes())
            at = i + 1
        if end > at:
            pes.append(rows[at:end, 4:].tobytes())
        unit = b"".join(pes)
        code, length, _, flags, extra = struct.unpack(">IHBBB", unit[:9])
        if code >> 8 != 1:
            raise StreamError("no PES start code")
        if flags & 0x80:
            p = unit[9:14]
            times.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
        parts.append(unit[9 + extra : 6 + length])
    return {"payload": b"".join(parts), "pmt_pid": pmt_pid, "es_pid": es_pid, "type": kind, "packets": len(grid), "units": len(parts), "points": points, "first_pts": times[0], "last_pts": times[-1], "gaps": gaps}


_SEEN: dict[bytes, tuple[int, int, int]] = {}


def _known_tables(tables: bytes) -> tuple[int, int, int]:
    """Equal table packets parse once a process."""
    if tables not in _SEEN:
        grid = np.frombuffer(tables, np.uint8).reshape(-1, PACKET)
        _SEEN[tables] = _tables(grid, (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2])
    return _SEEN[tables]


def feature(stream: dict) -> str:
    return "program={pmt_pid};pid={es_pid};type={type};packets={packets};units={units};random_access={points};pts={first_pts}-{last_pts};gaps={gaps}".format(**stream)


def _mux_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        texts = word_texts(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([mux(padded(x)) for x in texts], pa.binary())],
            names=["doc_id", "n_bytes", "media"],
        )


def add_stream(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of every row; nulls, repeats and ties stay rows of their own."""
    return docs.select(docs[id_column].cast("long"), docs[text_column]).mapInArrow(_mux_batches, "doc_id long, n_bytes long, media binary")


def _read_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        rows = []
        for media in batch.column(2).to_pylist():
            stream = demux(media)
            payload = stream["payload"]
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream)))
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def read_streams(streams: DataFrame) -> DataFrame:
    """Digests and features of the stored streams, from their bytes alone."""
    return streams.select("doc_id", "n_bytes", "media").mapInArrow(
        _read_batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
