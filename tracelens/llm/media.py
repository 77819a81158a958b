"""Media columns: bytes stored as MPEG transport streams and read back.

Writing wraps the payload in access units, one PES packet each, with a presentation time stamp; a program association
table and a program map table precede every random-access point, which carries the program's clock. Reading parses the
tables, which may go over several packets, checks the continuity counters, reassembles the elementary packets and lists
time stamps with their random-access flags. A packet sent twice counts once, null packets are passed over, and a PES
packet without a length ends where the next one begins.

Defined cases: a null text is the empty text; the payload is padded with zero bytes to a positive multiple of 64; equal
texts give equal streams; texts of any length are stored whole, and time stamps start again at 2**33 as the format has
it; an empty table gives an empty result; repeated rows each have theirs; other columns are ignored. A stream that
breaks the format (sync byte, missing table, counter gap, short packet) raises ValueError in ``read_stream``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import map_batches, table

# Fixed values of the transport-stream format (ISO/IEC 13818-1) and of this writer.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, NULL_PID = 0x0000, 0x0100, 0x0101, 0x1FFF
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in PES packets, private_stream_1
UNIT, RAP_EVERY, TICKS = 4096, 8, 3003  # bytes an access unit, units between random-access points, 90 kHz ticks a unit


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


_PAT = _section(0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
_PMT = _section(0x02, 1, struct.pack(">HH", 0xE000 | DATA_PID, 0xF000) + struct.pack(">BHH", STREAM_TYPE, 0xE000 | DATA_PID, 0xF000))


def _table_packet(pid: int, section: bytes, cc: int) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | cc & 15) + b"\x00" + section).ljust(PACKET, b"\xff")


def _pts_bytes(pts: int) -> bytes:
    return bytes((0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE))


_HEADS = {start: [struct.pack(">BHB", SYNC, (0x4000 if start else 0) | DATA_PID, 0x10 | cc) for cc in range(16)] for start in (False, True)}
_HEADS_AF = {start: [struct.pack(">BHB", SYNC, (0x4000 if start else 0) | DATA_PID, 0x30 | cc) for cc in range(16)] for start in (False, True)}


def _adaptation(size: int, pcr: int | None) -> bytes:
    """An adaptation field of `size` bytes in all, its length byte included; with a clock it marks a random-access point."""
    if size == 1:
        return b"\x00"
    if pcr is None:
        return bytes((size - 1, 0x00)) + b"\xff" * (size - 2)
    clock = ((pcr & (1 << 33) - 1) << 15 | 0x3F << 9).to_bytes(6)  # 33 bits of base, 6 reserved, extension 0
    return (bytes((size - 1, 0x50)) + clock).ljust(size, b"\xff")


def write_stream(payload: bytes, first: int = 0) -> bytes:
    """The payload as access units; ``first`` is the number of the first one on the clock."""
    out, cc, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        rap = k % RAP_EVERY == 0
        if rap:
            out += [_table_packet(PAT_PID, _PAT, tables), _table_packet(PMT_PID, _PMT, tables)]
            tables += 1
        unit = payload[at : at + UNIT]
        stamp = (first + k) * TICKS & (1 << 33) - 1
        pes = struct.pack(">BBBBHBBB", 0, 0, 1, STREAM_ID, len(unit) + 8, 0x84, 0x80, 5) + _pts_bytes(stamp) + unit
        # the first packet has an adaptation field, with the clock at a random-access point; later ones only where bytes are missing
        least = 8 if rap else 2
        room = PACKET - 4 - least
        out += [_HEADS_AF[True][cc], _adaptation(least + max(0, room - len(pes)), stamp if rap else None), pes[:room]]
        cc, done = cc + 1 & 15, room
        while done < len(pes):
            part = pes[done : done + 184]
            if len(part) == 184:
                out += [_HEADS[False][cc], part]
            else:
                out += [_HEADS_AF[False][cc], _adaptation(184 - len(part), None), part]
            cc, done = cc + 1 & 15, done + 184
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    packets: int = 0
    units: list[tuple[int, bool, int]] = field(default_factory=list)  # time stamp, random access, bytes
    program: dict[int, int] = field(default_factory=dict)  # elementary pid: stream type


_CRC: dict[bytes, int] = {}


def crc32_cached(section: bytes) -> int:
    if section not in _CRC:
        if len(_CRC) > 1000:
            _CRC.clear()
        _CRC[section] = crc32_mpeg(section)
    return _CRC[section]


class _Tables:
    """Sections of one PID, put together over packets."""

    def __init__(self, table_id: int):
        self.table_id, self.held = table_id, b""

    def feed(self, data: bytes, start: bool) -> bytes | None:
        """The section that the packet's payload completes, if any."""
        if start:
            self.held = data[1 + data[0] :]
        elif self.held:
            self.held += data
        if len(self.held) < 3:
            return None
        size = 3 + ((self.held[1] & 0x0F) << 8 | self.held[2])
        if len(self.held) < size:
            return None
        section, self.held = self.held[:size], b""
        if section[0] != self.table_id or crc32_cached(section):
            raise ValueError("damaged program table")
        return section


def read_stream(media: bytes) -> Stream:
    if len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    s, pmt_pid, seen, parts, rap, chunks = Stream(), None, {}, None, False, []
    s.packets = len(media) // PACKET
    pat, pmt = _Tables(0x00), _Tables(0x02)

    def close():
        if parts is None:
            return
        pes = b"".join(parts)
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            raise ValueError("damaged elementary packet")
        size = pes[4] << 8 | pes[5]
        if size and len(pes) != size + 6 or not pes[7] & 0x80 or len(pes) < 9 + pes[8]:
            raise ValueError("damaged elementary packet")
        p = pes[9:14]
        pts = (p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1
        data = pes[9 + pes[8] :]
        chunks.append(data)
        s.units.append((pts, rap, len(data)))

    for at in range(0, len(media), PACKET):
        sync, b1, b2, b3 = media[at : at + 4]
        if sync != SYNC:
            raise ValueError("lost sync")
        pid, cc, body = (b1 & 0x1F) << 8 | b2, b3 & 15, at + 4
        if pid == NULL_PID:
            continue
        if b3 & 0x10:
            before = seen.get(pid)
            if before is not None:
                if cc == before[0] and media[at : at + PACKET] == media[before[1] : before[1] + PACKET] and not before[2]:
                    seen[pid] = (cc, before[1], True)  # the format allows a packet twice, and no more
                    continue
                if cc != before[0] + 1 & 15:
                    raise ValueError("continuity counter gap")
            seen[pid] = (cc, at, False)
        flag = False
        if b3 & 0x20:
            size = media[body]
            flag = bool(size and media[body + 1] & 0x40)
            body += 1 + size
        if not b3 & 0x10:
            continue
        if pid == PAT_PID:
            section = pat.feed(media[body : at + PACKET], bool(b1 & 0x40))
            if section:
                pmt_pid = (section[10] & 0x1F) << 8 | section[11]
        elif pid == pmt_pid:
            section = pmt.feed(media[body : at + PACKET], bool(b1 & 0x40))
            if section:
                i = 12 + ((section[10] & 0x0F) << 8 | section[11])
                while i < len(section) - 4:
                    s.program[(section[i + 1] & 0x1F) << 8 | section[i + 2]] = section[i]
                    i += 5 + ((section[i + 3] & 0x0F) << 8 | section[i + 4])
        elif pid in s.program:
            if b1 & 0x40:
                close()
                parts, rap = [], flag
            if parts is None:
                raise ValueError("no start of an elementary packet")
            parts.append(media[body : at + PACKET])
    close()
    if not s.program:
        raise ValueError("no program map")
    s.payload = b"".join(chunks)
    return s


def pad(data: bytes | None) -> bytes:
    data = data or b""
    return data + b"\x00" * (-len(data) % 64 or (0 if data else 64))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded UTF-8 as a transport stream."""

    def make():
        def f(c):
            return {"doc_id": c["doc_id"], "n_bytes": [len(t or b"") for t in c["text"]], "media": [write_stream(pad(t)) for t in c["text"]]}

        return f

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(cols, make, "doc_id long, n_bytes long, media binary", binary=("text",))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<boolean>"


def features(stored: DataFrame) -> DataFrame:
    """Reads ``store``'s streams back: digests, a feature string, and time stamps with random-access flags."""

    def make():
        def f(c):
            rows = []
            for i, n, m in zip(c["doc_id"], c["n_bytes"], c["media"], strict=True):
                s = read_stream(m)
                ones = sum(r for _, r, _ in s.units)
                text = f"packets={s.packets};units={len(s.units)};random_access={ones};first_pts={s.units[0][0]};last_pts={s.units[-1][0]};streams={len(s.program)};adler32={zlib.adler32(s.payload):08x}"
                rows.append((i, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), text, [u[0] for u in s.units], [u[1] for u in s.units]))
            return dict(zip([x.split()[0] for x in FEATURES.split(", ")], map(list, zip(*rows, strict=True)), strict=True))

        return f

    return map_batches(stored, make, FEATURES)


def op4_media_ts(spark, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents")))
